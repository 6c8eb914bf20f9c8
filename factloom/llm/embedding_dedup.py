"""Embedding near-dedup by cross-polytope hashing (operator 3).

Vectors are turned by fast Hadamard transforms with random signs; a hash is the axis nearest to
the turned vector, with its sign. Each table joins some hashes to a bucket; a vector is entered
in its own bucket and in those with the next-best axes (multiprobe). Pairs that meet in a bucket,
one of them at home there, are confirmed by their cosine in double precision. Buckets are compared
many at a time where Spark has sorted them; those of many vectors are dealt out as pairs of
blocks, so no task holds more than two blocks of one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import added, hash128, lean, settled
from factloom.llm.graph import components

#: Rows of the left side of one matrix product.
TILE = 512


@dataclass(frozen=True)
class Shape:
    """hashes in a table, tables, probes beyond the own bucket, and vectors in a block.

    Where hashes or tables are None, fitted() sets them from the number of vectors: as many hashes
    as keep a bucket's mean size at most `mean`, and as many tables as let a pair of exactly the
    least cosine go unmet with a chance of at most `miss`. Whole buckets of about `together` rows
    are compared in one go, those of up to `small` rows by shifts of the sorted rows, larger ones by
    matrix products.
    """

    cosine: float = 0.98
    tables: int | None = None
    hashes: int | None = None
    probes: int = 1
    block: int = 4096
    seed: int = 11
    mean: float = 64.0
    miss: float = 2e-6
    together: int = 16_384
    small: int = 48


def fitted(shape: Shape, vectors: int, size: int) -> Shape:
    """The shape for `vectors` vectors of `size` components to a label.

    The chance to meet in a table is measured on random pairs at the least cosine; turns make it
    depend on nothing else.
    """
    import numpy as np

    width = 1 << max(1, (size - 1).bit_length())
    hashes = shape.hashes or max(2, math.ceil(math.log(max(2.0, vectors / shape.mean), 2 * width)))
    if shape.tables:
        return replace(shape, hashes=hashes)
    rng, n = np.random.default_rng(shape.seed), 2000
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, n, max(2, size))))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = shape.cosine * x + math.sqrt(1 - shape.cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    one = replace(shape, hashes=hashes, tables=1)
    a, b = (buckets(v, np.zeros(n, np.int64), one)[:, 0] for v in (x, y))
    met = (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)
    chance = max(0.01, met.mean() - 2 * math.sqrt(met.mean() * (1 - met.mean()) / n))
    return replace(shape, hashes=hashes, tables=1 if chance >= 1 else math.ceil(math.log(shape.miss) / math.log(1 - chance)))


def hadamard(x):
    """The fast Walsh-Hadamard transform of each row; rows have a power of two of columns."""
    import numpy as np

    rows, columns = x.shape
    step = 1
    while step < columns:
        x = x.reshape(rows, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, columns)
        step *= 2
    return x


def buckets(unit, labels, shape: Shape):
    """(rows, tables, 1 + probes) of int64: the own bucket and the probed ones of each unit vector."""
    import numpy as np

    rows, size = unit.shape
    width = 1 << max(1, (size - 1).bit_length())
    padded = np.zeros((rows, width))
    padded[:, :size] = unit
    rng = np.random.default_rng([shape.seed, size])
    out = np.empty((rows, shape.tables, 1 + shape.probes), dtype=np.int64)
    spare = min(width, shape.probes + 1)
    for t in range(shape.tables):
        axes, gaps = [], []
        for _ in range(shape.hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], size=width)) / np.sqrt(width)
            far, order = np.abs(x), np.empty((rows, spare), dtype=np.int64)
            for r in range(spare):
                order[:, r] = far.argmax(axis=1)
                far[np.arange(rows), order[:, r]] = -1
            top = np.take_along_axis(x, order, axis=1)
            axes.append(order * 2 + (top > 0))
            gaps.append(np.abs(top[:, :1]) - np.abs(top))
        own = np.stack([a[:, 0] for a in axes], axis=1)
        options = [(k, r) for k in range(shape.hashes) for r in range(1, spare)]
        cost = np.stack([gaps[k][:, r] for k, r in options], axis=1) if options else np.empty((rows, 0))
        best = np.argsort(cost, axis=1, kind="stable")
        for p in range(1 + shape.probes):
            chosen = own.copy()
            for q, (k, r) in enumerate(options if 0 < p <= len(options) else []):
                hit = best[:, p - 1] == q
                chosen[hit, k] = axes[k][hit, r]
            out[:, t, p] = _named(chosen, labels, size, t)
    return out


def _named(chosen, labels, size: int, table: int):
    """One int64 for the label, the dimension, the table and its hashes."""
    import numpy as np

    x = labels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size * 1000 + table)
    for k in range(chosen.shape[1]):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + chosen[:, k].astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _read(df: DataFrame, key: str, vector: str, label: str, single: bool) -> DataFrame:
    """(key, label, v): v holds the components as bytes; null for what links with nothing."""
    whole = isinstance(df.schema[label].dataType, T.IntegralType)
    code = F.col(label).cast("long") if whole else F.when(F.col(label).isNotNull(), F.xxhash64(F.col(label).cast("string")))
    rows = df.select(F.col(key).alias("key"), code.alias("label"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            column, labels = batch.column("v"), batch.column("label")
            column = pc.if_else(pc.and_(column.is_valid(), labels.is_valid()), column, pa.scalar([], column.type))
            offsets = column.offsets.to_numpy()
            flat = column.values.fill_null(math.nan).to_numpy()[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            # Adding 0 makes -0.0 of one sign with 0.0.
            flat = flat + flat.dtype.type(0)
            count = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
            valid = (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0)
            raw = pa.Array.from_buffers(pa.binary(), len(valid), [None, pa.py_buffer((offsets * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
            raw = pc.if_else(pa.array(valid), raw, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), labels, raw], names=["key", "label", "v"])

    return rows.mapInArrow(lean(run), added(rows.drop("v"), v=T.BinaryType()))


def _units(raw: pa.Array, single: bool):
    """Unit vectors in double precision of equally long byte strings."""
    import numpy as np

    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    x = data.view("<f4" if single else "<f8").astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(raw: pa.Array) -> Iterator:
    """The places of the rows of each length."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.binary_length(raw).to_numpy()
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def coded(classes: DataFrame, shape: Shape, single: bool) -> DataFrame:
    """classes (id, m, label, v) with `codes`: the bytes of the int64 of each bucket, by table, the own one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for own in _by_length(batch.column("v")):
                for at in range(0, len(own), 2000):
                    part = batch.take(pa.array(own[at : at + 2000]))
                    found = buckets(_units(part.column("v"), single), part.column("label").to_numpy(), shape)
                    width = found[0].nbytes
                    codes = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(np.arange(0, width * (len(found) + 1), width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(found))])
                    yield pa.RecordBatch.from_arrays([*part.columns, codes], names=[*part.schema.names, "codes"])

    rows = classes.select("id", "m", "label", "v")
    return rows.mapInArrow(lean(run), added(rows, codes=T.BinaryType()))


def entered(classes: DataFrame, shape: Shape) -> DataFrame:
    """(bucket, home, id) of each class for each bucket that it is in."""
    each = 1 + shape.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.int64).reshape(batch.num_rows, -1, each)
            home = np.broadcast_to(np.arange(each) == 0, found.shape)
            ids = np.broadcast_to(batch.column("id").to_numpy()[:, None, None], found.shape)
            # Where there are fewer axes than probes, a bucket comes again.
            first = np.stack([(found[:, :, :p] != found[:, :, p : p + 1]).all(axis=2) for p in range(each)], axis=2)
            yield pa.RecordBatch.from_arrays([pa.array(found[first]), pa.array(home[first]), pa.array(ids[first])], names=["bucket", "home", "id"])

    return classes.select("id", "codes").mapInArrow(lean(run), "bucket long, home boolean, id long")


def _compare(shape: Shape, single: bool):
    """Confirm the pairs of sorted buckets, or pairs of blocks: links of each class, and a forest of them.

    A pair that meets in several buckets counts where it meets first, by table, then by number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []

        def group_of(rows):
            names = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("bucket", "block", "other")])
            return np.concatenate([[0], np.cumsum((names[:, 1:] != names[:, :-1]).any(axis=0))])

        def joined():
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= shape.together:
                rows = joined()
                group = group_of(rows)
                # The last bucket may go on in the next batch.
                whole = int(np.searchsorted(group, group[-1]))
                if whole:
                    yield _links(rows.slice(0, whole), group[:whole], shape, single)
                held = [rows.slice(whole)]
        if held:
            rows = joined()
            yield _links(rows, group_of(rows), shape, single)

    return run


def _links(rows: pa.RecordBatch, group, shape: Shape, single: bool) -> pa.RecordBatch:
    import numpy as np

    n = rows.num_rows
    ids, own = np.unique(rows.column("id").to_numpy(), return_inverse=True)
    m, label = rows.column("m").to_numpy(), rows.column("label").to_numpy()
    home, side = rows.column("home").to_numpy(zero_copy_only=False), rows.column("side").to_numpy()
    within = (rows.column("block").to_numpy() == rows.column("other").to_numpy())
    bucket = rows.column("bucket").to_numpy()
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.int64).reshape(n, -1, 1 + shape.probes)
    unit, kind = {}, np.empty(n, dtype=np.int64)
    place = np.empty(n, dtype=np.int64)
    for k, at in enumerate(_by_length(rows.column("v"))):
        unit[k] = _units(rows.column("v").take(pa.array(at)), single)
        kind[at], place[at] = k, np.arange(len(at))
    count, edges = np.zeros(len(ids), dtype=np.int64), [np.empty((2, 0), dtype=np.int64)]

    def met(i, j):
        """Count the pairs of rows i, j that are near and meet here first."""
        fit = (home[i] | home[j]) & (label[i] == label[j]) & (kind[i] == kind[j]) & (own[i] != own[j]) & np.where(within[i], True, side[i] != side[j])
        i, j = i[fit], j[fit]
        for at in range(0, len(i), 50_000):
            a, b = i[at : at + 50_000], j[at : at + 50_000]
            near = np.zeros(len(a), dtype=bool)
            for k, u in unit.items():
                these = np.flatnonzero(kind[a] == k)
                near[these] = np.einsum("ij,ij->i", u[place[a[these]]], u[place[b[these]]]) >= shape.cosine
            counted(a[near], b[near])

    def counted(a, b):
        first = _first_meeting(codes[a], codes[b]) == bucket[a]
        a, b = a[first], b[first]
        np.add.at(count, own[a], m[b])
        np.add.at(count, own[b], m[a])
        edges.append(forest_of(own[a], own[b]))

    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(starts, append=n)
    small = np.repeat(sizes <= shape.small, sizes)
    for d in range(1, int(min(shape.small, sizes.max(initial=0)))):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        met(i, i + d)
    for start, size in zip(starts[sizes > shape.small], sizes[sizes > shape.small]):
        every = np.arange(start, start + size)
        for k in np.unique(kind[every]):
            mine = every[kind[every] == k]
            left, right = (mine, mine) if within[start] else (mine[side[mine] == 0], mine[side[mine] == 1])
            for at in range(0, len(left), TILE):
                x = left[at : at + TILE]
                for to in range(0, len(right), 8 * TILE):
                    y = right[to : to + 8 * TILE]
                    i, j = np.nonzero(unit[k][place[x]] @ unit[k][place[y]].T >= shape.cosine)
                    i, j = x[i], y[j]
                    fit = (home[i] | home[j]) & (label[i] == label[j]) & (own[i] != own[j]) & ((i < j) | ~within[i])
                    i, j = i[fit], j[fit]
                    for part in range(0, len(i), 100_000):
                        counted(i[part : part + 100_000], j[part : part + 100_000])
    a, b = forest_of(*np.concatenate(edges, axis=1))
    found = np.flatnonzero(count)
    columns = [np.concatenate([ids[found], ids[a]]), np.concatenate([np.full(len(found), -1), ids[b]]), np.concatenate([count[found], np.zeros(len(a), np.int64)])]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["a", "b", "n"])


def _first_meeting(a, b):
    """The bucket in which two rows of codes (rows, tables, 1 + probes) first meet with one at home."""
    import numpy as np

    none = np.iinfo(np.int64).max
    at_a = (a[:, :, :1] == b).any(axis=2)
    at_b = (b[:, :, :1] == a).any(axis=2)
    where = np.minimum(np.where(at_a, a[:, :, 0], none), np.where(at_b, b[:, :, 0], none))
    return where[np.arange(len(where)), (at_a | at_b).argmax(axis=1)]


def forest_of(a, b):
    """Edges (rows of 2) that join each vertex of the edges a - b to the least that it is connected with."""
    import numpy as np

    vertex, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(vertex))
    while len(i):
        low = np.minimum(least[i], least[j])
        now = least.copy()
        for end in (i, j):
            np.minimum.at(now, least[end], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == least).all():
            break
        least = now
    moved = np.flatnonzero(least != np.arange(len(vertex)))
    return np.stack([vertex[moved], vertex[least[moved]]])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", shape: Shape = Shape()) -> DataFrame:
    """One row for each row of df: key, n_links (other vectors linked directly), component_id (the
    smallest key reachable by links, its own included) and kept (key = component_id).

    Vectors are compared only where labels and dimensions are equal. Rows with a null label, and
    vectors that are null, empty, zero or hold null or non-finite components, link with nothing.
    Equal vectors become one class first, so copies are counted without being paired. Rows that
    repeat a key count as vectors of their own; a null key is never a component's smallest. Keys
    may be of any ordered type; labels that aren't whole numbers are told apart by 64 bits.
    """
    single = df.schema[vector].dataType.elementType == T.FloatType()
    rows = settled(_read(df, key, vector, label, single), "vectors")
    h1, h2 = hash128(F.col("label"), F.col("v"))
    rows = rows.withColumns({"h1": h1, "h2": h2})
    valid = rows.filter("v IS NOT NULL")
    classes = valid.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("key"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = settled(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("v")).alias("size")).agg(F.max("n"), F.max("size")).first()
    shape = fitted(shape, most[0] or 0, (most[1] or 8) // (4 if single else 8))
    numbered = settled(coded(classes, shape, single), "codes")
    placed = settled(entered(numbered, shape), "buckets")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bool_or("home").alias("used")).filter("size > 1 AND used").select("bucket", "size")
    placed = placed.join(sizes, "bucket")
    blocks = F.ceil(F.col("size") / shape.block).cast("int")
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    # Each class goes to the pairs of its block with every block.
    dealt = placed.withColumn("third", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", "home", "id", F.least("mine", "third").alias("block"), F.greatest("mine", "third").alias("other"), (F.col("mine") > F.col("third")).cast("int").alias("side"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "block", "other"]
    met = settled(dealt, "met").join(numbered, "id").repartition(n, *order).sortWithinPartitions(*order)
    found = settled(met.select(*order, "side", "home", "id", "m", "label", "v", "codes").mapInArrow(lean(_compare(shape, single)), "a long, b long, n long"), "found")
    links = found.filter("b = -1").groupBy("a").agg(F.sum("n").alias("n"))
    reached = components(found.filter("b >= 0").select("a", "b"))
    least = classes.select("id", F.col("key").alias("least")).join(reached, "id").groupBy("component").agg(F.min("least").alias("smallest"))
    owner = reached.join(least, "component").select("id", "smallest")
    named = classes.join(links.withColumnRenamed("a", "id"), "id", "left").join(owner, "id", "left")
    named = settled(named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("smallest", "key").alias("component_id")), "named")
    out = valid.select("key", "h1", "h2").join(named, ["h1", "h2"]).select("key", "n_links", "component_id")
    out = out.union(rows.filter("v IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
