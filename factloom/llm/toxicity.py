"""Toxicity by weak supervision (operator 6).

Voters are single words of a lexicon and prefix patterns that go together with the label on a
bounded sample of labelled documents; the given label is one more voter. A generative model
learns by expectation maximization how often each voter speaks in either class, and how voters
that speak together are correlated, which lessens their say. Its posterior labels train a
linear classifier over words and prefixes, which scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import added, lean, settled, slices, without

#: Bytes of text that are cut into words together.
TEXT_BYTES = 2_000_000


@dataclass(frozen=True)
class Shape:
    """sample: labelled rows to learn from, at most (expected; they are drawn by a hash of their key).
    voters and features: how many terms vote and how many the classifier weighs, at most.
    prefix: letters of a prefix pattern. support: sampled documents that a term must be in.
    trust: least accuracy of the given labels. sway: most that all other voters count, in log odds."""

    sample: int = 24_000
    voters: int = 400
    features: int = 4_000
    prefix: int = 5
    support: int = 5
    rounds: int = 12
    steps: int = 400
    penalty: float = 2e-5
    trust: float = 0.99
    sway: float = 2.0


@dataclass(frozen=True)
class Model:
    """Weights of the terms that a text holds, each counted once, and the bias."""

    weights: dict[str, float]
    bias: float
    prefix: int


def _words(texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """The runs of letters and digits of each text in lower case, and their dictionary encoding."""
    words = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    return words, words.values.dictionary_encode()


def _terms(word: str, prefix: int) -> list[str]:
    """A word as a term of the lexicon and, if it is longer, the pattern of its first letters."""
    return [word, f"{word[:prefix]}*"] if len(word) > prefix else [word] if word else []


def in_sample(key: Column, of: int, shape: Shape) -> Column:
    """True for about shape.sample of `of` rows, by a hash of the key."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(1_000_000 * min(1.0, shape.sample / max(1, of)))


def _pairs(df: DataFrame, prefix: int) -> DataFrame:
    """(key, y, term), distinct, of labelled rows (key, text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, "text", TEXT_BYTES):
            words, coded = _words(batch.column("text"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            codes = coded.indices.to_numpy()
            terms = [_terms(w, prefix) for w in coded.dictionary.to_pylist()]
            seen = np.unique(owner * max(1, len(terms)) + codes)
            rows = sorted({(int(k) // len(terms), t) for k in seen for t in terms[int(k) % len(terms)]})
            at = pa.array([r[0] for r in rows], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("y").take(at), pa.array([r[1] for r in rows], type=pa.string())], names=["key", "y", "term"])

    return df.select("key", "text", "y").mapInArrow(lean(run), "key long, y int, term string")


def label_model(votes, given, shape: Shape):
    """Posterior probabilities of class 1 from votes (rows x voters of 0 or 1) and given labels.

    Each voter speaks with a probability of its own in either class; that of the given label is
    its accuracy, which is at least shape.trust. A voter's log odds are divided by 1 plus the sum
    of its positive correlations with the others within the classes, and all voters together
    count for at most shape.sway. So the classes stay those of the labels: words that go with a
    language or with a group of copies can't take them over, however many they are.
    """
    import numpy as np

    # One more voter for class 0: silence of all others.
    x = np.column_stack([votes, votes.sum(axis=1) == 0]).astype(np.float64)
    p = np.clip(given.astype(np.float64), 0.02, 0.98)
    for _ in range(shape.rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        one = (p @ x + 0.5) / (p.sum() + 1)
        zero = ((1 - p) @ x + 0.5) / ((1 - p).sum() + 1)
        right = [np.clip((q @ (given == y) + 0.5) / (q.sum() + 1), shape.trust, 0.9999) for y, q in ((0, 1 - p), (1, p))]
        # What is left of the votes when the classes are known shows which voters say the same.
        left = x - np.outer(p, one) - np.outer(1 - p, zero)
        spread = np.sqrt((left**2).mean(axis=0)) + 1e-9
        together = (left.T @ left) / len(x) / np.outer(spread, spread)
        np.fill_diagonal(together, 0)
        say = 1 / (1 + np.where(together > 0.1, together, 0).sum(axis=0))
        # A voter that doesn't speak abstains: it says nothing of either class.
        spoken = np.clip(x @ (say * np.log(one / zero)), -shape.sway, shape.sway)
        told = np.where(given == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        odds = np.log(prior / (1 - prior)) + told + spoken
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def _logistic(rows, columns, n: int, width: int, target, shape: Shape):
    """Weights and bias of a penalized logistic regression on binary features, by accelerated descent."""
    import numpy as np

    weights, bias, speed, lead = np.zeros(width), 0.0, np.zeros(width), 0.0
    often = np.bincount(columns, minlength=width) / n
    # Rare features take steps as large as frequent ones.
    scale = 1 / np.sqrt(often + 1e-4)
    for step in range(shape.steps):
        margin = bias + np.bincount(rows, weights=weights[columns], minlength=n)
        gap = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        slope = np.bincount(columns, weights=gap[rows], minlength=width) / n + shape.penalty * weights
        rate = 0.5
        speed = 0.9 * speed - rate * scale * slope
        lead = 0.9 * lead - rate * gap.mean()
        weights, bias = weights + speed, bias + lead
    return weights, bias


def fit(df: DataFrame, labels: DataFrame, shape: Shape = Shape(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from rows of df that labels name with 0 or 1 and whose crc32(key as text) mod 5 isn't 0.

    Only the label, by its key, and the texts are used. Terms are counted by Spark; the driver
    gets the counts of the chosen terms and where they occur in the bounded sample. Without
    labels of both classes the model scores all texts alike: 0 for none, else the class's share.
    """
    import numpy as np

    usable = labels.filter(learnable(F.col(key)) & F.col(label).isin(0, 1)).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(label).cast("int").alias("y"))
    total = usable.count()
    usable = usable.filter(in_sample(F.col("key"), total, shape))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL").join(usable, "key").dropDuplicates(["key"])
    pairs = settled(_pairs(rows, shape.prefix), "terms")
    counts = dict(pairs.select("key", "y").distinct().groupBy("y").count().collect())
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros:
        return Model({}, 30.0 if ones else -30.0, shape.prefix)
    terms = pairs.groupBy("term").agg(F.sum("y").alias("one"), F.sum(1 - F.col("y")).alias("zero")).filter(F.col("one") + F.col("zero") >= shape.support)
    odds = F.log((F.col("one") + 0.5) / (ones + 1)) - F.log((F.col("zero") + 0.5) / (zeros + 1))
    certain = odds / F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("zero") + 0.5))
    chosen = terms.withColumn("z", certain).filter("abs(z) >= 3").orderBy(F.abs("z").desc(), "term").limit(shape.features).select("term", "z").collect()
    if not chosen:
        return Model({}, float(np.log(ones / zeros)), shape.prefix)
    number = {r.term: k for k, r in enumerate(chosen)}
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(number.items()), "term string, f int")
    # At most `features` short rows.
    held = pairs.join(F.broadcast(wanted), "term", "left").groupBy("key", "y").agg(F.collect_list("f").alias("f")).orderBy("key").select("y", "f").collect()
    n, width = len(held), len(chosen)
    given = np.array([r.y for r in held])
    at = np.repeat(np.arange(n), [len(r.f) for r in held])
    columns = np.array([f for r in held for f in r.f], dtype=np.int64)
    # Voters speak for class 1; terms that speak for class 0 are left to the classifier.
    voters = [k for k, r in enumerate(chosen) if r.z > 0][: shape.voters]
    place = np.full(width, -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((n, len(voters)), dtype=np.int8)
    spoken = place[columns] >= 0
    votes[at[spoken], place[columns[spoken]]] = 1
    posterior = label_model(votes, given, shape) if voters else given.astype(float)
    weights, bias = _logistic(at, columns, n, width, posterior, shape)
    return Model({r.term: float(w) for r, w in zip(chosen, weights)}, float(bias), shape.prefix)


def learnable(key: Column) -> Column:
    """Rows that may be learnt from: crc32 of the key as text, mod 5, isn't 0; a null key never is."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with `score` (double, 0 to 1) of each whole text; null and empty texts have the bias alone.

    An existing column `score` is replaced.
    """
    df = without(df, ["score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number = {t: k for k, t in enumerate(model.weights)}
        weights = np.array(list(model.weights.values()))
        width = max(1, len(number))
        for batch in slices(batches, text, TEXT_BYTES):
            words, coded = _words(batch.column(text))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            codes = coded.indices.to_numpy()
            margin = np.full(batch.num_rows, model.bias)
            found = [[number[t] for t in _terms(w, model.prefix) if t in number] for w in coded.dictionary.to_pylist()]
            for k in (0, 1):
                own = np.array([f[k] if len(f) > k else -1 for f in found], dtype=np.int64)
                hit = own[codes] >= 0 if len(own) else np.zeros(0, bool)
                places = owner[hit] * width + own[codes[hit]] if len(own) else np.zeros(0, np.int64)
                seen = places if k == 0 else np.concatenate([seen, places])
            seen = np.unique(seen)
            np.add.at(margin, seen // width, weights[seen % width] if len(seen) else 0.0)
            scores = pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    return df.mapInArrow(lean(run), added(df, score=T.DoubleType()))
