"""Sketches of lines: never apart for near lines, nearly always apart for others."""

import random

from pyspark.sql import functions as F

from factloom.llm import line_dedup as ld


def edited(draw, line, edits):
    for _ in range(edits):
        at = draw.randrange(len(line) + 1)
        line = line[:at] + draw.choice(["", "x", "é", "ab", " "])[:1] + line[at + draw.randrange(2) :]
    return line


def test_near_lines_have_like_sketches(spark):
    draw = random.Random(5)
    letters = "abcdefghij klmnopé東"
    rows = []
    for k in range(3000):
        a = "".join(draw.choices(letters[: draw.choice([2, 5, 20])], k=draw.randrange(1, 80)))
        edits = draw.randrange(3)
        rows.append((k, edits, a, edited(draw, a, edits)))
    other = [(-k, 9, "the same beginning " + "".join(draw.choices(letters, k=40)), "the same beginning " + "".join(draw.choices(letters, k=40))) for k in range(1, 1000)]
    df = spark.createDataFrame(rows + other, "k int, edits int, a string, b string")
    got = df.withColumn("like", ld.alike(ld.sketch(F.col("a")), ld.sketch(F.col("b")), 2)).collect()
    assert all(r["like"] for r in got if r.edits <= 2)
    assert sum(r["like"] for r in got if r.edits == 9) <= 5
