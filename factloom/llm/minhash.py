"""MinHash near-dedup with SuperMinHash signatures (operator 5).

A document's set of word shingles gets a signature in which each element draws one value for
every position, in ranks that form a permutation: in step j it puts j + u at the j-th place of
its own random order. Positions fill evenly, which gives less variance than independent
minima, and once every position of a document holds a value below j + 1 no later step can
change it, so long documents stop after a few steps.

Documents of equal sets become one class. Classes that share a band of their signatures are
candidates; links are confirmed on the full sets, and union-find with distributed contraction
makes groups of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import lean, settled, slices
from factloom.llm.graph import components

#: Words whose hashes a worker keeps.
CACHE_WORDS = 100_000
#: Bytes of text that are cut into words together.
TEXT_BYTES = 2_000_000
#: Shingles that are put through the steps of the signature together.
TOGETHER = 30_000


@dataclass(frozen=True)
class Shape:
    """Shingles of `words` words; links of at least `percent` similarity; bands of `rows` values.

    At a similarity of exactly 0.8, 26 bands of 5 miss a pair with a chance of 3 in 100,000.
    Buckets of more than `few` classes are compared in blocks of about `block` classes, or fewer
    if these hold more than `held` shingles.
    """

    words: int = 5
    percent: int = 80
    bands: int = 26
    rows: int = 5
    seed: int = 1
    few: int = 6
    block: int = 512
    held: int = 1_000_000


def _mixed(x):
    """The splitmix64 finalizer on an array of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingle_sets(texts: list[str | None], words: int) -> list:
    """The sorted distinct 64-bit shingle hashes of each text; none without words.

    ASCII letters are lowered and white space is `[\\x20\\x09-\\x0D]+`, as bytes.split() has it.
    A text of fewer words has one shingle, the whole sequence.
    """
    import numpy as np

    cut = [t.encode().lower().split() if t else [] for t in texts]
    counts = [len(c) for c in cut]
    flat = np.fromiter((_WORDS[w] for c in cut for w in c), dtype=np.uint64, count=sum(counts))
    base = np.uint64(0x9E3779B97F4A7C15)
    joined = flat.copy()
    for k in range(1, min(words, len(flat))):
        joined[: len(flat) - k] = joined[: len(flat) - k] * base + flat[k:]
    joined = _mixed(joined)
    out, at = [], 0
    for n in counts:
        if n >= words:
            out.append(np.unique(joined[at : at + n - words + 1]))
        elif n:
            x = np.array([n], dtype=np.uint64)
            for v in flat[at : at + n]:
                x = x * base + v
            out.append(_mixed(x ^ base))
        else:
            out.append(flat[:0])
        at += n
    return out


def signatures(sets: list, size: int, seed: int):
    """SuperMinHash signatures (rows of uint64, rank above 32 random bits) of non-empty sets."""
    import numpy as np

    out = np.empty((len(sets), size), dtype=np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= TOGETHER):
            total += len(sets[last])
            last += 1
        out[first:last] = _steps(sets[first:last], size, seed)
        first = last
    return out


def _steps(sets: list, size: int, seed: int):
    import numpy as np

    held = np.full((len(sets), size), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, 1 if len(sets) > 1 or not sets else len(sets[0]), TOGETHER):
        part = sets if len(sets) > 1 else [sets[0][lo : lo + TOGETHER]]
        elements = np.concatenate(part)
        owner = np.repeat(np.arange(len(part)), [len(p) for p in part])
        order = np.tile(np.arange(size, dtype=np.uint16), (len(elements), 1))
        rows = np.arange(len(elements))
        for j in range(size):
            drawn = _mixed(elements + np.uint64((seed * 0x632BE59BD9B4E019 + (j + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            swap = j + ((drawn >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
            place = order[rows, swap]
            order[rows, swap] = order[:, j]
            value = (drawn & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)
            np.minimum.at(held.reshape(-1), owner * size + place, value)
            if j < 8 or j % 8 == 0:
                going = held.max(axis=1) >= np.uint64((j + 1) << 32)
                stay = going[owner]
                left = int(stay.sum())
                if not left:
                    break
                if left < 0.7 * len(elements):
                    elements, owner, order = elements[stay], owner[stay], order[stay]
                    rows = np.arange(left)
    return held


_SIGNED = T.StructType([T.StructField("key", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _digests(sets: list):
    import numpy as np
    import xxhash

    raw = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
    both = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def signed(df: DataFrame, key: str, text: str, shape: Shape) -> DataFrame:
    """(key, n, h1, h2, bands) of every row: set size, 128 bits of the set, a hash of each band.

    Rows without words have n 0 and null bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in slices(batches, "text", TEXT_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), shape.words)
            full = [s for s in sets if len(s)]
            signs = signatures(full, shape.bands * shape.rows, shape.seed).reshape(len(full), shape.bands, shape.rows)
            # A band is known by its number and its values.
            mixed = np.zeros((len(full), shape.bands), dtype=np.uint64)
            for r in range(shape.rows):
                mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + signs[:, :, r])
            mixed = _mixed(mixed + np.arange(1, shape.bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)
            h1, h2 = _digests(sets)
            bands = iter(mixed.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("row"), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(h1), pa.array(h2), pa.array([next(bands) if len(s) else None for s in sets], type=pa.list_(pa.int64()))],
                names=_SIGNED.names,
            )
        _WORDS.clear()

    return _keyed(df, key, text).mapInArrow(lean(run), _SIGNED)


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, text): row is a hash of the text, so that rows are told apart where keys repeat or are null."""
    return df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


def _sets_of(df: DataFrame, key: str, text: str, wanted: DataFrame, shape: Shape) -> DataFrame:
    """(id, members) of the classes in `wanted` (id, first (key, row), h1, h2): full sets as sorted 64-bit hashes.

    Each class's set is made of one row's text: a row meets the classes that it is the first of.
    """
    rows = _keyed(df, key, text)
    named = wanted.select("id", "h1", "h2", F.col("first.key").alias("wanted_key"), F.col("first.row").alias("wanted_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, "text", TEXT_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), shape.words)
            h1, h2 = _digests(sets)
            # Texts of equal hash are told apart by their sets.
            own = np.flatnonzero((h1 == batch.column("h1").to_numpy()) & (h2 == batch.column("h2").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array([sets[i].tobytes() for i in own], type=pa.binary())], names=["id", "members"])
        _WORDS.clear()

    same = (F.col("row") == F.col("wanted_row")) & F.col("key").eqNullSafe(F.col("wanted_key"))
    return rows.join(named, same).select("id", "h1", "h2", "text").mapInArrow(lean(run), "id long, members binary").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def _blocks(rows: DataFrame, sets: DataFrame, shape: Shape) -> DataFrame:
    """Links (a, b) that join components within buckets of many classes (k, id, c, size, total).

    A bucket's classes are dealt to blocks, and each pair of blocks is one group, so a task holds
    two blocks of sets at a time and emits no pairs: it compares all that differ in component,
    and returns a link for each two that are near.
    """
    blocks = F.ceil(F.greatest(F.col("size") / shape.block, F.col("total") / shape.held)).cast("int")
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("id", "k"), blocks).cast("int")).withColumn("third", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("k", "id", "c", F.least("mine", "third").alias("block"), F.greatest("mine", "third").alias("other"), (F.col("mine") > F.col("third")).alias("right"))
    return dealt.join(sets, "id").groupBy("k", "block", "other").applyInArrow(_linked(shape.percent), "a long, b long")


def _linked(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        import numpy as np

        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        group = rows["c"].to_numpy()
        if (group == group[0]).all():
            return none
        ids, right = rows["id"].to_numpy(), rows["right"].to_numpy()
        within = rows["block"][0] == rows["other"][0]
        sets = [np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in rows["members"]]
        sizes = np.array([len(s) for s in sets])
        # Shingles of a single class are in no intersection.
        _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(often > 1) - 1
        owner = np.repeat(np.arange(len(sets)), sizes)
        keep = often[code] > 1
        owner, code = owner[keep], shared[code[keep]]
        left, other = np.flatnonzero(~right), np.arange(len(sets)) if within else np.flatnonzero(right)
        if not len(left) or not len(other):
            return none
        common = np.zeros((len(left), len(other)), dtype=np.float32)
        width = min(4_096, int(shared[-1]) + 1)
        for at in range(0, int(shared[-1]) + 1, max(1, width)):
            part = (code >= at) & (code < at + width)
            held = np.zeros((len(sets), width), dtype=np.float32)
            held[owner[part], code[part] - at] = 1
            common += held[left] @ held[other].T
        both = sizes[left][:, None] + sizes[other][None, :]
        i, j = np.nonzero((100 * common >= percent * (both - common)) & (group[left][:, None] != group[other][None, :]))
        # One link of each two components will do.
        names, code = np.unique(group, return_inverse=True)
        _, first = np.unique(code[left[i]] * len(names) + code[other[j]], return_index=True)
        return pa.table({"a": pa.array(ids[left[i[first]]], pa.int64()), "b": pa.array(ids[other[j[first]]], pa.int64())})

    return run


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """One row for each row of df: key, n_shingles, component_id (the smallest key reachable by
    links, its own included) and kept (key = component_id).

    Rows without words (null and empty texts) have n_shingles 0 and link with nothing. A row
    with a null key takes part in links; alone, its component_id is null and it is kept. Keys
    are taken to be those of documents: rows that repeat a key get a result each.

    First, every class is compared with one hub only, the smallest class of its buckets, so a
    bucket of any size costs its size. Then, in buckets whose classes aren't all one component
    yet, the classes of different components are compared, in small buckets pair by pair, in
    large ones in blocks: no pair of a bucket is left out that could still connect something.
    """
    rows = settled(signed(df, key, text, shape), "signed")
    worded = rows.filter("n > 0")
    classes = worded.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.min(F.struct("key", "row")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = settled(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    banded = classes.select("id", "n", F.explode("bands").alias("k"))
    hubs = banded.groupBy("k").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub < top").select("k", "hub")
    shared = settled(banded.join(settled(hubs, "hubs"), "k"), "shared")
    size = classes.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"))
    first = shared.filter("id <> hub").groupBy("id").agg(F.min("hub").alias("hub"), F.first("n").alias("n")).join(size, "hub")
    first = settled(first.filter(_close("n", "hub_n", shape)).select(F.col("id").alias("a"), F.col("hub").alias("b")), "pairs")
    involved = shared.select("id").distinct()
    wanted = classes.join(involved, "id").select("id", "h1", "h2", "first")
    sets = settled(_sets_of(df, key, text, wanted, shape), "sets")
    links = settled(confirmed(first, sets, shape.percent), "links")
    reached = settled(components(links), "components").distinct()
    named = shared.join(reached, "id", "left").select("k", "id", "n", F.coalesce("component", "id").alias("c"))
    named = settled(named, "named")
    mixed = named.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("k")
    open_ = settled(named.join(mixed, "k"), "open")
    size = open_.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    open_ = settled(open_.join(settled(size, "sizes"), "k"), "sized")
    few = open_.filter(F.col("size") <= shape.few)
    x, y = few.alias("x"), few.alias("y")
    second = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & _close("x.n", "y.n", shape))
    second = second.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    more = confirmed(settled(second, "pairs"), sets, shape.percent)
    more = settled(more.union(_blocks(open_.filter(F.col("size") > shape.few), sets, shape)), "links")
    reached = components(links.union(more))
    least = classes.select("id", F.col("key").alias("least")).join(reached, "id").groupBy("component").agg(F.min("least").alias("smallest"))
    owner = reached.join(least, "component").select("id", "smallest")
    owner = classes.join(owner, "id", "left").select("h1", "h2", F.coalesce("smallest", "key").alias("component_id"))
    owner = settled(owner, "owners")
    out = worded.join(owner, ["h1", "h2"]).select("key", "n", "component_id").union(rows.filter("n = 0").select("key", "n", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _close(a: str, b: str, shape: Shape):
    """Sets can only be similar enough if their sizes are."""
    return 100 * F.least(F.col(a), F.col(b)) >= shape.percent * F.greatest(F.col(a), F.col(b))
