import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import embedding_dedup, line_dedup, minhash
from factloom.llm.graph import components


def groups(n, links):
    least = list(range(n))
    for _ in range(n):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_components_of_chains_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + list(itertools.combinations(range(200, 212), 2)) + [(300, 300), (301, None)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 212), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "One", "one", "one two", "ONE\ttwo", "É x", "é x"]
    for size in (4, 6, 12, 60, 300):
        base = [word() for _ in range(size)]
        for _ in range(8):
            other = list(base)
            for _ in range(rng.randint(0, max(1, size // 15))):
                other[rng.randrange(size)] = word()
            texts += [" ".join(other)]
        texts += [" ".join(base)] * 3
    return texts


@pytest.mark.parametrize("words", [2, 5])
def test_minhash_finds_the_links_of_a_full_comparison(spark, words):
    texts = near_texts()
    sets = [shingles(t, words) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = groups(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n": F.lit("x"), "kept": F.lit(1)})
    rows = minhash.near_duplicates(docs, shape=minhash.Shape(words=words)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows] == [(i, len(sets[i]), least[i], least[i] == i) for i in range(len(texts))]


def test_minhash_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "z")], "doc_id long, text string")
    rows = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert rows == {(None, 3, False), (3, 3, True), (None, None, True)}


@pytest.mark.parametrize("few, block, held", [(2, 3, 40), (100, 512, 1_000_000)])
def test_minhash_blocks_change_nothing(spark, few, block, held):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = minhash.near_duplicates(docs).orderBy("doc_id").collect()
    assert minhash.near_duplicates(docs, shape=minhash.Shape(few=few, block=block, held=held)).orderBy("doc_id").collect() == want


def test_minhash_of_a_repeated_key_meets_each_text_once(spark):
    """A third of the rows, all near, share a key, and others have none: one set is made for each class."""
    base = [f"w{k}" for k in range(60)]
    rows = [(7 if k % 2 else None, " ".join([*base, f"x{k}"])) for k in range(60)] + [(100 + k, f"other {k} " + " ".join(f"{k}v{j}" for j in range(30))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = minhash.signed(docs, "doc_id", "text", minhash.Shape())
    wanted = signed.groupBy("h1", "h2").agg(F.min(F.struct("key", "row")).alias("first")).withColumn("id", F.monotonically_increasing_id())
    plan = minhash._sets_of(docs, "doc_id", "text", wanted, minhash.Shape())
    assert plan.count() == 120
    met = minhash._keyed(docs, "doc_id", "text").join(wanted.select(F.col("first.row").alias("row")), "row")
    assert met.count() == 120
    got = minhash.near_duplicates(docs).collect()
    assert sum(r.component_id == 7 for r in got) == 60 and len(got) == 120


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = minhash.signatures([np.concatenate([common, left]), np.concatenate([common, right])], 512, 1)
    assert abs((a == b).mean() - 0.8) < 0.06
    # Ranks fill every position, once each, for a single element.
    one = minhash.signatures([np.array([5], dtype=np.uint64)], 130, 1)[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(130))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [1, 2, 5, 30])
def test_bit_parallel_distance_as_the_whole_matrix(spark, threshold):
    rng = random.Random(threshold)
    pairs = [("", ""), ("", "a"), ("a", "a"), ("a" * 900, "a" * 899 + "b"), ("ab" * 200, "ba" * 200), ("x" * threshold, ""), ("x" * (threshold + 1), "")]
    for _ in range(400):
        x = [rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 40))]
        y = list(x)
        for _ in range(rng.randint(0, 2 * threshold)):
            k = rng.randrange(len(y) + 1)
            y[k : k + 1] = rng.choice([["z"], [], [*y[k : k + 1], "b"]])
        pairs.append(("".join(x), "".join(y)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string")
    got = {r.i: (r.there, r.back) for r in df.select("i", line_dedup.within(F.col("a"), F.col("b"), threshold).alias("there"), line_dedup.within(F.col("b"), F.col("a"), threshold).alias("back")).collect()}
    assert all(got[i] == (near, near) for i, (a, b) in enumerate(pairs) for near in [distance(a, b) <= threshold])


@pytest.mark.parametrize("block", [line_dedup.BLOCK, 3])
def test_line_dedup_as_a_full_comparison(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    pool = [line(n) for n in (12, 13, 20, 21, 30, 45)]
    texts = [None, "", "short", "\n\n"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            x = list(rng.choice([*pool, line(15)]))
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([["z"], [], [x[k], "y"]])
            lines.append("".join(x))
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_dropped", F.lit("clash"))
    rows = line_dedup.line_dedup(docs, least=10).orderBy("doc_id").collect()
    earlier = []
    for row, text in zip(rows, texts, strict=True):
        lines, stay = [] if text is None else text.split("\n"), []
        for x in lines:
            if len(x) < 10 or not any(distance(x, y) <= 2 for y in earlier):
                stay.append(x)
            if len(x) >= 10:
                earlier.append(x)
        assert (row.n_lines, row.n_dropped) == (len(lines), len(lines) - len(stay))
        assert row.text == (None if text is None else "\n".join(stay))
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_odd_keys(spark):
    text = "x" * 50
    docs = spark.createDataFrame([(None, text), (2, text), (2, text), (1, text + "\nshort")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.text) for r in line_dedup.line_dedup(docs).collect())
    assert rows == [(-1, text), (1, "short"), (2, ""), (2, "")]


@pytest.mark.parametrize("block", [line_dedup.BLOCK, 3])
def test_line_dedup_of_short_lines_as_a_full_comparison(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(11)
    texts = ["ab\nab\n\n \n\t\n\u00a0", "ab\nac\n\n \n\t\n\u00a0", "All rights reserved.", "All rights reserved!"]
    texts += ["\n".join("".join(rng.choice("abcdefghijklmnop é") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 14]))) for _ in range(3)) for _ in range(40)]
    rows = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    earlier = []
    for row, text in zip(rows, texts, strict=True):
        stay = []
        for x in text.split("\n"):
            if not x.strip() or not any(x == y or min(len(x), len(y)) > 2 and distance(x, y) <= 2 for y in earlier):
                stay.append(x)
            if x.strip():
                earlier.append(x)
        assert (row.text, row.n_dropped) == ("\n".join(stay), len(text.split("\n")) - len(stay))
    assert rows[1].text == "ac\n\n \n\t\n\u00a0" and rows[3].n_dropped == 1


def test_line_dedup_of_lines_with_a_common_segment(spark):
    """Many lines share a third and nothing else, so all are open and few are near."""
    rng = random.Random(23)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    head = word(20)
    rows = [head + word(40) for _ in range(150)]
    rows += [r[:-1] + "z" for r in rows[40:80]] + ["y" + r for r in rows[80:90]] + [r[:33] + r[34:] for r in rows[100:110]]
    got = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    late = [any(distance(x, y) <= 2 for y in rows[:k] if abs(len(x) - len(y)) <= 2) for k, x in enumerate(rows)]
    assert [r.n_dropped for r in got] == [int(x) for x in late] and sum(late) >= 60


def vectors():
    rng = np.random.default_rng(2)
    out = []
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=24)
            out += [(base + rng.normal(size=24) * s, label) for s in (0, 0.02, 0.1, 0.14, 0.2)]
        out += [(base, label)] * 4 + [(base * 3, label)]
    rows = [([float(x) for x in v], label) for v, label in out]
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None], [float("inf"), 1.0]]
    return rows + [(v, 0) for v in bad] + [(rows[0][0], None), ([1.0], 0), ([2.0], 0), ([-1.0], 0)]


def test_embeddings_as_a_full_comparison(spark):
    rows = vectors()
    good = [label is not None and bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v) for v, label in rows]
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        (x, k), (y, m) = rows[a], rows[b]
        if good[a] and good[b] and k == m and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
            links.append((a, b))
    least = groups(len(rows), links)
    df = spark.createDataFrame([(i, v, label) for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    named = df.withColumn("label", F.concat(F.lit("topic "), "label")).withColumn("n_links", F.lit("clash"))
    for table, shape in [
        (named, embedding_dedup.Shape()),
        (df, embedding_dedup.Shape(block=3)),
        (df, embedding_dedup.Shape(small=1, together=40, hashes=1, tables=8)),
    ]:
        got = embedding_dedup.near_duplicates(table.repartition(3), shape=shape).orderBy("vec_id").collect()
        assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(i, sum(i in e for e in links), least[i], least[i] == i) for i in range(len(rows))]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = 0.9801 * u + np.sqrt(1 - 0.9801**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    none = np.zeros(1500, dtype=np.int64)
    # More vectors, more hashes in a table, and more tables: as few pairs are missed.
    shapes = [embedding_dedup.fitted(embedding_dedup.Shape(), n, 64) for n in (1000, 100_000_000)]
    assert (shapes[0].hashes, shapes[1].hashes) == (2, 3) and shapes[0].tables < shapes[1].tables < 30
    for shape in shapes:
        a, b = embedding_dedup.buckets(u, none, shape), embedding_dedup.buckets(v, none, shape)
        met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2))
        assert met.mean() > 0.999


def test_embeddings_with_null_and_repeated_keys(spark):
    x = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, x, 1), ("b", x, 1), ("b", x, 1), ("a", [1.0, 2.0, 3.0001], 1), ("c", [3.0, 0.0, 0.0], 1)], "vec_id string, embedding array<float>, label int")
    got = sorted((r.vec_id or "", r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [("", 3, "a", False), ("a", 3, "a", True), ("b", 3, "a", False), ("b", 3, "a", False), ("c", 0, "c", True)]
