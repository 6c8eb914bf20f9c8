import hashlib
import heapq
import random
import re
from itertools import count
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from factloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not found else "d" if (role, text) in seen else "" if found[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, repaired) by a best-first search over whole edit strings and what they leave."""
    faults, order = plain_faults(rows), count()
    heap, done = [(0, "", 0, "", next(order), ())], set()
    while heap:
        cost, audit, at, roles, _, made = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(made)
        # What matters of the roles so far is where they may go on.
        state = (at, roles[-1:])
        if state in done:
            continue
        done.add(state)
        legal = lambda r: (r == "s" and not roles) or (r == "u" and roles[-1:] != "u") or (r == "a" and roles[-1:] == "u")
        for role in ("user", "assistant"):
            if legal(role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", at, roles + role[0], next(order), (*made, f"{role}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles, next(order), made))
            if faults[at] not in ("b", "d"):
                more = faults[at] == "t"
                if role[:1] and legal(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[:1], next(order), (*made, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if legal(new[0]):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, roles + new[0], next(order), (*made, f"{new}:{text}")))
    raise AssertionError


def plain(rows):
    """{conv: result} of undamaged rows."""
    out, left = {}, plain_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted([r[1:] for r in left if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = plain_faults(own)
        turns = {r[0] for r in own if r[0] is not None}
        roles = [r[1][:1] for r in own]
        cost, audit, made = plain_repair(own)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("piece", F.lit("x")).withColumn("present", F.lit(False)).repartition(3)
    pieces = cr.repair(cr.damaged(df), conv="conv", present=F.col("present"), **how)
    got = cr.outcomes(pieces, conv="conv").collect()
    assert len(got) == len({r.conv for r in got})
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def conversations(seed, n, turns):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]
    texts = ["Yes.", "No", "Well?", "", " \t", None, "a.b", "Is it?\n", "é。", "Yes."]
    rows = []
    for conv in [*range(n), None]:
        for k in range(draw.randrange(turns)):
            rows.append((conv, draw.choice([None, k, k, k, k + 3, k - 1]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.6 else f"{k} words."))
    return rows + draw.sample(rows, len(rows) // 10)


@pytest.mark.parametrize("most", [1, 2, 400])
def test_same_as_a_search_over_edit_strings(spark, most):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = conversations(most, 150, 9)
        assert found(spark, rows, piece_rows=most) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_of_most_rows(spark):
    """One conversation holds nearly all rows, a third of them equal, some of one turn: it is cut and chained."""
    rows = [(1, k, "user" if k % 3 else "assistant", "Again." if k % 3 == 1 else f"{k} it is{'.' if k % 5 else ''}") for k in range(1500)]
    rows += [(1, 7, "user", "Same.")] * 300 + [(2, 0, "user", "Hello.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, piece_rows=50) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_are_given(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "So?"), (1, 2, "assistant", ""), (1, 3, "tool", "Long " * 50_000 + ".")], SCHEMA)
    row = cr.repair(df).collect()[0]
    # A turn is made an assistant's, or one is put in: the cheapest edits, of equal ones the first by letters.
    assert (row.edits, row.cost, row.roles) == ("KIKDR", 7, ["user", "assistant", "user", "assistant"])
    assert row.texts[:3] == ["Hi.", "", "So?"] and len(row.texts[3]) == 250_001 and row.final and row.piece == 0


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.outcomes(cr.repair(empty)).collect() == []
    gone = spark.createDataFrame([(5, 1, "user", "Hi.")], SCHEMA)
    row = cr.outcomes(cr.repair(gone, present=F.lit(False))).collect()[0]
    assert (row.conv_id, row.cost, row.audit, row.gaps, row.repaired_sha256) == (5, 0, "", 0, hashlib.sha256(b"").hexdigest())
    names = spark.createDataFrame([("a", 1, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert cr.outcomes(cr.repair(names)).collect()[0].audit == "KI"
