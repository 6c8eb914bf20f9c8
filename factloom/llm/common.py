"""What the training-data operators share: scratch tables, Arrow batches, table access."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes that separate words wherever a contract says `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Text that one Arrow batch handed to or from a library may hold, in bytes.
SLICE_BYTES = 2_000_000
#: Spark's setting that removes a query's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where the session names none and is local, as in tests, one temporary folder is set for it; a
    cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files of a query go when the query has ended, not at some later collection of garbage."""
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it is computed once, and executors may go.

    Its shuffle files go as soon as it is written, so that disks hold those of one step at a time.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with tidied(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns that an operator is about to write itself."""
    taken = {n.lower() for n in names}
    return df.select(*[c for c in df.columns if c.lower() not in taken])


def added(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(k, v) for k, v in kinds.items()]])


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes; together wide enough to stand for a text in any corpus."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x9E3779B9), *cols)]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about `size` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * size / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Known:
    """The ids of each text met lately, as one Arrow array of texts and one array of ids.

    `learn` gives (counts, ids) of a list of new texts. When more than `size` texts are held,
    those that the present batch doesn't need go first.
    """

    def __init__(self, size: int, learn):
        import numpy as np

        self.size, self.learn = size, learn
        self.texts, self.counts, self.ids = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, "<i4")

    @property
    def starts(self):
        import numpy as np

        return np.cumsum(self.counts) - self.counts

    def places(self, texts: pa.Array):
        """The place of each of the distinct texts in `counts` and `starts`."""
        import numpy as np
        import pyarrow.compute as pc

        at = pc.index_in(texts, value_set=self.texts)
        if not at.null_count:
            return at.to_numpy()
        new = texts.filter(at.is_null())
        if len(self.texts) + len(new) > self.size:
            self._keep(np.unique(at.drop_null().to_numpy()))
        counts, ids = self.learn(new.to_pylist())
        self.texts = pa.concat_arrays([self.texts, new])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        return pc.index_in(texts, value_set=self.texts).to_numpy()

    def encoded(self, first: pa.Array, second: pa.Array, codes, heads):
        """(ends, ids) of rows of words: `codes` are the words' numbers, heads the rows' offsets in
        them, and each word consists of a first and maybe (if not null) a second part."""
        import numpy as np

        parts = pa.concat_arrays([first, second.drop_null()]).dictionary_encode()
        at = self.places(parts.dictionary)[parts.indices.to_numpy()]
        has = second.is_valid().to_numpy(zero_copy_only=False)
        after = np.zeros(len(first), dtype=np.int64)
        after[has] = at[len(first) :]
        # The parts of all words, one after the other.
        both = has[codes]
        upto = np.concatenate([[0], np.cumsum(1 + both)])
        stream = np.repeat(at[: len(first)][codes], 1 + both)
        stream[upto[1:][both] - 1] = after[codes[both]]
        places, sizes = ragged(self.starts, self.counts, stream)
        return np.concatenate([[0], np.cumsum(sizes)])[upto[heads[1:]]], self.ids[places]

    def _keep(self, own) -> None:
        places, _ = ragged(self.starts, self.counts, own)
        self.texts, self.counts, self.ids = self.texts.take(pa.array(own)), self.counts[own], self.ids[places]


def freed() -> None:
    """Give memory that a finished task of a Python worker used back to the system: workers are kept for later tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """The function of a mapInArrow, freeing memory when its partition is done."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        freed()

    return to_the_end


def ragged(starts, lengths, codes):
    """Places in a blob of the pieces `codes`, one after the other, and each piece's length there."""
    import numpy as np

    each = lengths[codes]
    ends = np.cumsum(each, dtype=np.int64)
    shift = (starts[codes] - (ends - each)).astype(np.int32)
    return np.repeat(shift, each) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32), each


def list_of(ends, values) -> pa.ListArray:
    """An Arrow list column from the end of each row's values and the values."""
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def list_parts(column: pa.Array):
    """Offsets and int32 values of a list column; null rows are empty, null items 0."""
    import numpy as np
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.if_else(column.is_valid(), column, pa.scalar([], type=column.type))
    ends = column.offsets.to_numpy()
    data = column.values
    data = (data.fill_null(0) if data.null_count else data).to_numpy(zero_copy_only=False) if len(data) else np.empty(0, "<i4")
    return ends - ends[0], data[ends[0] : ends[-1]].astype("<i4", copy=False)
