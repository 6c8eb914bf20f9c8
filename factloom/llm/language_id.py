"""Language identification (operator 12).

A text is the mean of the embeddings of its hashed subwords (runs of two to four letters of its
words, with the words' borders), and a linear softmax gives its language. Embeddings and softmax
are trained in numpy by stochastic gradient descent on a bounded sample; a part of the sample
that isn't trained on calibrates the scores and the score below which an answer is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import added, lean, settled, slices, without

#: Bytes of text that are cut into subwords together, and code points of a text that are hashed at once.
TEXT_BYTES, BLOCK = 500_000, 500_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Shape:
    """sample: distinct texts of each language to learn from, at most (expected; drawn by a hash of the text).
    buckets: hashed subwords (a power of two). width: of the embeddings. words: of the short pieces that
    each sampled text also gives. held: one in so many sampled texts calibrates. reject: share of
    correct calibration answers that rejection may lose."""

    sample: int = 600
    buckets: int = 1 << 16
    width: int = 16
    words: int = 6
    least: int = 2
    most: int = 4
    epochs: int = 6
    rate: float = 4.0
    batch: int = 32
    held: int = 5
    reject: float = 0.01


@dataclass(frozen=True)
class Model:
    """Languages by name, what each subword says for each of them, and the score below which an answer is rejected."""

    languages: list[str]
    says: np.ndarray
    bias: np.ndarray
    floor: float
    shape: Shape


def learnable(key: Column) -> Column:
    """Rows that may be learnt from: crc32 of the key as text, mod 4, isn't 2; a null key never is."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def letters(texts: pa.Array) -> pa.Array:
    """Lower-case words of letters, each between single spaces; without letters empty or spaces."""
    spread = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    return pc.binary_join_element_wise("", spread, "", " ")


def subwords(texts: list[str], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each subword of each text, in parts of bounded size."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(t) for t in texts])
    for at in range(0, len(code), BLOCK):
        part = code[at : at + BLOCK + shape.most - 1].astype(np.uint64)
        size = min(BLOCK, len(code) - at)
        owner = np.searchsorted(ends, np.arange(at, at + size), side="right")
        border = part == 32
        mixed = np.zeros(len(part), np.uint64)
        inner = np.ones(len(part), bool)
        for n in range(1, shape.most + 1):
            reach = len(part) - n + 1
            if reach <= 0:
                break
            # The hash of n code points goes on from that of the first n - 1.
            mixed = mixed[:reach] * np.uint64(0x100000001B3) + part[n - 1 :]
            mixed = mixed ^ (mixed >> np.uint64(29))
            # No border inside, and the text goes on far enough.
            inner = inner[:reach] & (~border[n - 2 : n - 2 + reach] if n > 2 else True)
            if n < shape.least:
                continue
            starts = np.flatnonzero(inner[: min(size, reach)])
            starts = starts[at + starts + n <= ends[owner[starts]]]
            hashed = mixed[starts] * np.uint64(0x9E3779B97F4A7C15)
            yield owner[starts], (hashed >> np.uint64(40)).astype(np.int64) & (shape.buckets - 1)


def _bags(df: DataFrame, shape: Shape) -> DataFrame:
    """(y, part, buckets, counts) of each text as a whole and of a few of its words."""
    kinds = "y int, part int, buckets array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            texts = letters(batch.column("text")).to_pylist()
            every, from_row = [], []
            for row, (text, drawn) in enumerate(zip(texts, batch.column("draw").to_pylist())):
                words = text.split()
                start = drawn % max(1, len(words) - shape.words + 1)
                every += [text, f" {' '.join(words[start : start + shape.words])} "]
                from_row += [row, row]
            # Rows are a few bytes of counts for each distinct subword.
            keys = [o * shape.buckets + b for o, b in subwords(every, shape)]
            keys, counts = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
            heads = np.searchsorted(keys, np.arange(len(every) + 1) * shape.buckets).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(heads), pa.array(v.astype(np.int32))) for v in (keys % shape.buckets, counts)]
            from_row = pa.array(from_row)
            yield pa.RecordBatch.from_arrays([batch.column("y").take(from_row), batch.column("part").take(from_row), *lists], names=["y", "part", "buckets", "counts"])

    return df.select("y", "part", "draw", "text").mapInArrow(lean(run), kinds)


def _spread(columns: np.ndarray, values: np.ndarray, height: int) -> np.ndarray:
    """Rows of values added up by their column."""
    return np.column_stack([np.bincount(columns, weights=v, minlength=height) for v in values.T])


def trained(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times softmax weights (buckets x classes), and the bias, by stochastic gradient descent.

    rows are (buckets, shares) of each text, shares adding up to 1. Classes weigh alike.
    """
    draw = np.random.default_rng(7)
    embedding = draw.normal(0, 1 / shape.width, (shape.buckets, shape.width))
    seen = np.zeros(shape.buckets, bool)
    for columns, _ in rows:
        seen[columns] = True
    # A subword that training never met says nothing.
    embedding[~seen] = 0
    top, bias = np.zeros((shape.width, classes)), np.zeros(classes)
    weight = len(y) / (classes * np.maximum(np.bincount(y, minlength=classes), 1))
    steps = shape.epochs * -(-len(rows) // shape.batch)
    done = 0
    for _ in range(shape.epochs):
        order = draw.permutation(len(rows))
        for at in range(0, len(rows), shape.batch):
            chosen = order[at : at + shape.batch]
            columns = np.concatenate([rows[k][0] for k in chosen])
            shares = np.concatenate([rows[k][1] for k in chosen])
            place = np.repeat(np.arange(len(chosen)), [len(rows[k][0]) for k in chosen])
            mean = _spread(place, embedding[columns] * shares[:, None], len(chosen))
            gap = _softmax(mean @ top + bias)
            gap[np.arange(len(chosen)), y[chosen]] -= 1
            gap *= weight[y[chosen], None] / len(chosen)
            rate = shape.rate * (1 - done / steps)
            back = gap @ top.T
            touched, where = np.unique(columns, return_inverse=True)
            embedding[touched] -= rate * _spread(where, back[place] * shares[:, None], len(touched))
            top -= rate * (mean.T @ gap)
            bias -= rate * gap.sum(axis=0)
            done += 1
    return embedding @ top, bias


def _softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def calibrated(logits: np.ndarray, y: np.ndarray, reject: float) -> tuple[float, float]:
    """The factor of the logits under which they say best how often they are right, and the score that all but `reject` of the right answers reach."""
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(_softmax(logits * g)[np.arange(len(y)), y] + 1e-12).mean() for g in grid]
    factor = float(grid[int(np.argmin(loss))])
    scores = _softmax(logits * factor)
    right = scores.argmax(axis=1) == y
    return factor, float(np.quantile(scores.max(axis=1)[right], reject)) if right.any() else 0.0


def fit(df: DataFrame, shape: Shape = Shape(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows with a language and a text whose crc32(key as text) mod 4 isn't 2.

    Only text and language of these rows are used. Rows of each language are counted by Spark;
    the sample is drawn by a hash of the text, each text and language once, so copies don't crowd it
    out, and reaches the driver as counts of buckets. The model has a column for each language of
    the table. Without such rows it knows no language.
    """
    usable = df.filter(learnable(F.col(key)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((shape.buckets, 0)), np.zeros(0), 0.0, shape)
    spark = df.sparkSession
    rates = spark.createDataFrame([(name, k, int(1_000_000 * min(1.0, shape.sample / sizes[name]))) for k, name in enumerate(languages)], "lang string, y int, rate int")
    draw = F.pmod(F.xxhash64(F.lit("language"), "text"), F.lit(1_000_000))
    drawn = usable.withColumn("draw", draw).join(F.broadcast(rates), "lang").filter("draw < rate")
    chosen = drawn.groupBy("y", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.first("text").alias("text"), F.first("draw").alias("draw"))
    bags = settled(_bags(chosen.withColumn("part", F.pmod(F.col("h2"), F.lit(shape.held)).cast("int")), shape), "bags").toArrow()
    y, part = (bags.column(c).to_numpy() for c in ("y", "part"))
    buckets, counts = (bags.column(c).combine_chunks() for c in ("buckets", "counts"))
    ends, buckets, counts = buckets.offsets.to_numpy(), buckets.values.to_numpy(), counts.values.to_numpy()
    rows = []
    for a, b in zip(ends[:-1], ends[1:]):
        rows.append((buckets[a:b], counts[a:b] / max(1, counts[a:b].sum())))
    order = np.array(sorted(range(len(rows)), key=lambda k: (y[k], part[k], len(rows[k][0]), rows[k][0].tobytes(), rows[k][1].tobytes())), dtype=np.int64)
    fitted = [k for k in order if part[k] != 0] or list(order)
    held = [k for k in order if part[k] == 0] or list(order)
    says, bias = trained([rows[k] for k in fitted], y[fitted], len(languages), shape)
    logits = np.array([rows[k][1] @ says[rows[k][0]] + bias for k in held])
    factor, floor = calibrated(logits, y[held], shape.reject)
    return Model(languages, says * factor, bias * factor, floor, shape)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with `lang_pred`, `score` (calibrated, 0 to 1) and `accepted` of each whole text.

    A null text or one without a letter is `und` with score 0 and not accepted; so is all without a
    learned language. Any other text gets the likeliest language (of equal ones the first by
    name); it is accepted if its score reaches the calibrated least. Columns of these names are
    replaced; others stay.
    """
    df = without(df, ["lang_pred", "score", "accepted"])
    languages, shape = np.array([*model.languages, UNKNOWN], dtype=object), model.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        says = np.ascontiguousarray(model.says.T.astype(np.float32))
        for batch in slices(batches, text, TEXT_BYTES):
            column = batch.column(text)
            has = pc.match_substring_regex(pc.fill_null(column, ""), r"\p{L}").to_numpy(zero_copy_only=False)
            best, scores = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
            if len(model.languages):
                total, n = np.zeros((len(says), batch.num_rows)), np.zeros(batch.num_rows)
                for owner, hashed in subwords(letters(column).to_pylist(), shape):
                    n += np.bincount(owner, minlength=batch.num_rows)
                    for k, line in enumerate(says):
                        total[k] += np.bincount(owner, weights=line[hashed], minlength=batch.num_rows)
                odds = _softmax((total / np.maximum(n, 1)).T + model.bias)
                best, scores = np.where(has, odds.argmax(axis=1), best), np.where(has, odds.max(axis=1), 0.0)
            made = [pa.array(languages[best], pa.string()), pa.array(scores), pa.array(has & (scores >= model.floor) & (best < len(model.languages)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "lang_pred", "score", "accepted"])

    return df.mapInArrow(lean(run), added(df, lang_pred=T.StringType(), score=T.DoubleType(), accepted=T.BooleanType()))
