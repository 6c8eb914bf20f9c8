"""Embedding whitening (operator 11).

Each partition computes the count, mean and centred scatter of its vectors, batch by batch; the
pairwise merge of Chan, Golub and LeVeque joins them in a treeReduce. The driver gets one matrix
of the vectors' dimension and finds its eigenvectors; a second pass over the whitened vectors
measures how far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import added, lean, settled, without

#: Grid values are below this size, so that doubles hold them and sums of SLICE of them fit a long.
LARGEST = 2.0**50
SLICE = 4096
#: Share of the trace below which a component has no spread of its own.
FLAT = 1e-12


@dataclass(frozen=True)
class Moments:
    """n vectors, their exact sums (Python ints, where entries are whole), mean and centred scatter."""

    n: int
    sums: list
    mean: np.ndarray
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        if self.sums:
            # Means of whole numbers far from 0 lose digits that their sums have.
            gap = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        share = other.n / n
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * share)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + gap * share, scatter)


NOTHING = Moments(0, [], np.empty(0), np.empty((0, 0)))


@dataclass(frozen=True)
class Model:
    """What the fit list gives: n, exact sums, falling eigenvalues and their unit vectors (columns), trace, and the largest entry of the whitened covariance minus the identity."""

    n: int
    sums: list
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace else 0.0 for e in self.values]

    @property
    def spread(self) -> np.ndarray:
        """Components that have a spread of their own."""
        return self.values > FLAT * max(self.trace, 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, centred, on the components, each over the root of its eigenvalue; 0 where that is 0."""
        base = [s // self.n for s in self.sums]
        rest = np.array([(s - b * self.n) / self.n for s, b in zip(self.sums, base)])
        centred = (x - np.array(base, dtype=np.int64)).astype(np.float64) - rest
        return centred @ (self.vectors / np.sqrt(np.where(self.spread, self.values, np.inf)))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2 of each row, exactly."""
        base = [s // self.n for s in self.sums]
        near = x - np.array(base, dtype=np.int64)
        rest = [s - b * self.n for s, b in zip(self.sums, base)]
        if float(np.abs(near).max(initial=0) + 1) ** 2 * float(self.n) ** 2 * max(1, x.shape[1]) < 2.0**62:
            gap = near * self.n - np.array(rest, dtype=np.int64)
            return (gap * gap).sum(axis=1).tolist()
        gap = near.astype(object) * self.n - np.array(rest, dtype=object)
        return (gap * gap).sum(axis=1).tolist()


def on_grid(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * entry) + shift as longs; null if the vector is null, empty, or holds an entry that is null, not finite or too large for the grid (2^50)."""
    fits = F.forall(vector, lambda c: F.abs(c.cast("double") * scale) < LARGEST)
    grid = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    return F.when(F.coalesce(fits, F.lit(False)) & (F.size(vector) > 0), grid)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """A list column without nulls, of equally long lists, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _block(x: np.ndarray) -> Moments:
    """Moments of one block; whole numbers are taken relative to a row of it, so that nothing is rounded before centring."""
    whole = x.dtype.kind == "i"
    sums = x.sum(axis=0).tolist() if whole else []
    base = x[0]
    near = (x - base).astype(np.float64)
    middle = near.mean(axis=0)
    near -= middle
    return Moments(len(x), sums, base + middle, near.T @ near)


def moments(df: DataFrame, column: str, through=None) -> Moments:
    """Moments of a list column of equally long lists without nulls, or of what `through` makes of the rows; NOTHING for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = NOTHING
        for batch in _cut(batches):
            x = _matrix(batch.column(column), np.int64)
            held = held.merged(_block(x if through is None else through(x)))
        sums, mean, scatter = [[str(s) for s in held.sums]], [held.mean.tolist()], [held.scatter.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([held.n]), pa.array(sums, pa.list_(pa.string())), pa.array(mean, pa.list_(pa.float64())), pa.array(scatter)], names=["n", "sums", "mean", "scatter"])

    def of(row) -> Moments:
        mean = np.array(row.mean)
        return Moments(row.n, [int(s) for s in row.sums], mean, np.frombuffer(row.scatter).reshape(len(mean), len(mean)))

    parts = df.select(column).mapInArrow(lean(run), "n long, sums array<string>, mean array<double>, scatter binary").rdd.map(of)
    return parts.treeReduce(Moments.merged) if parts.getNumPartitions() else NOTHING


def fit(df: DataFrame, column: str, components: int = 16) -> Model | None:
    """The whitening of the distinct vectors of a column of longs; None if there are none.

    Equal vectors count once: they are combined before the shuffle, so a vector that a third of
    the rows hold is no hot key. The list of distinct vectors is written, as both passes read it.
    """
    listed = settled(df.select(column).distinct(), "vectors")
    found = moments(listed, column)
    if not found.n:
        return None
    covariance = found.scatter / found.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    first = np.argsort(-values, kind="stable")[:components]
    model = Model(found.n, found.sums, np.maximum(values[first], 0.0), vectors[:, first], float(np.trace(covariance)))
    second = moments(listed, column, through=model.whitened)
    spread = model.spread
    gap = (second.scatter / second.n - np.eye(len(first)))[np.ix_(spread, spread)]
    return Model(model.n, model.sums, model.values, model.vectors, model.trace, float(np.abs(gap).max(initial=0.0)))


def usual_length(df: DataFrame, column: str) -> int:
    """The length that most lists have, of several the smallest; 0 for no rows."""
    first = df.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return first["size"] if first else 0


def whiten(df: DataFrame, vector: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, Model | None]:
    """df's usable rows with `deviation` (decimal, exact) and `whitened` (list of doubles), and the model.

    Rows whose vector is null or empty, holds null, non-finite or huge entries, or isn't as long
    as most are left out. Repeated rows each keep their result, but count once in the fit. Components
    without spread are 0 and not part of the identity's error; a single distinct vector has no
    other. An empty table gives no rows. Columns named deviation and whitened are replaced.
    """
    df = without(df, ["deviation", "whitened"])
    grid = "__grid"
    rows = df.withColumn(grid, on_grid(F.col(vector), scale, shift)).filter(F.col(grid).isNotNull())
    rows = rows.filter(F.size(grid) == usual_length(rows, grid))
    model = fit(rows, grid, components)
    kinds = added(df, deviation=T.DecimalType(38, 0), whitened=T.ArrayType(T.DoubleType()))
    if model is None:
        return df.sparkSession.createDataFrame([], kinds), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in _cut(batches):
            x = _matrix(batch.column(grid), np.int64)
            far = pa.array([Decimal(d) for d in model.deviations(x)], pa.decimal128(38, 0))
            made = model.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], far, lists], names=kinds.names)

    return rows.mapInArrow(lean(run), kinds), model
