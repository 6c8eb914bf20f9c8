"""Token ids as Parquet list columns (operator 2).

Documents are range-partitioned by id and sorted, encoded in that order, and written with an
`ids` list column (dictionary encoded: a vocabulary of 49,408 ids takes 16 bits) beside plain
metadata columns (delta encoded). Row groups and pages are small enough, and page indexes are
there, for a reader to take the ids of a few documents, or the metadata of all, alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Known, added, lean, list_of, list_parts, ragged, slices, without

#: Parts of words that a worker keeps encoded.
CACHE_WORDS = 400_000
#: Bytes of text that are cut into words together.
TEXT_BYTES = 4_000_000
#: Letters whose lower case is one letter in any library, and signs that are no letter, digit or space.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}]+")
_STEM_AND_SIGNS = f"^(?P<stem>[{_LETTERS}]+)(?P<signs>[{_SIGNS}]*)$"


@dataclass(frozen=True)
class Layout:
    """How the files are laid out. Sizes are in bytes."""

    row_group: int = 32 * 1024 * 1024
    page: int = 256 * 1024
    page_rows: int = 2000
    dictionary: int = 1024 * 1024
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.codec,
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": str(self.row_group),
            "parquet.page.size": str(self.page),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(self.dictionary),
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#n_tokens": "false",
        }


class WordBpe:
    """The tokenizer of one file, with the ids of words that it has met."""

    _made: dict[str, WordBpe] = {}

    @classmethod
    def of(cls, path: str) -> WordBpe:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import os

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(CACHE_WORDS, self._learn)
        vocabulary = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        #: Whether words of plain letters are the same in either case, and stay apart from signs after them.
        sample = "Abc Ünd ab?! ab ?!"
        self.simple = bool(suffix) and self._ids(sample) == self._ids(sample.lower()) and self._ids("ab?!") == self._ids("ab ?!")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]):
        """Ids of words. Plain ones are encoded many in one text, as each ends with the only id that ends a word."""
        import numpy as np

        plain = [w.isalpha() and bool(_PLAIN.fullmatch(w)) and self.simple for w in words]
        joined = [w for w, p in zip(words, plain) if p]
        alone = [w for w, p in zip(words, plain) if not p]
        parts = [" ".join(joined[at : at + 256]) for at in range(0, len(joined), 256)]
        flat = [np.array(c.ids, dtype="<i4") for c in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        one = np.concatenate([*flat, np.empty(0, "<i4")])
        upto = np.flatnonzero(self.ends[one]) + 1
        if len(upto) != len(joined):
            raise ValueError("the tokenizer doesn't keep words apart")
        rest = [np.array(c.ids, dtype="<i4") for c in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        counts = np.empty(len(words), dtype=np.int64)
        is_plain = np.array(plain, dtype=bool)
        counts[is_plain], counts[~is_plain] = np.diff(upto, prepend=0), [len(r) for r in rest]
        both = np.concatenate([one, *rest])
        starts = np.empty(len(words), dtype=np.int64)
        starts[is_plain] = upto - counts[is_plain]
        starts[~is_plain] = len(one) + np.cumsum(counts[~is_plain]) - counts[~is_plain]
        places, _ = ragged(starts, counts, np.arange(len(words)))
        return counts, both[places]

    def encode(self, texts: pa.Array, end: int | None):
        """(ends, ids): the end of each text's ids, and all ids.

        White space always ends a token, so that the ids of a text are those of its words, and
        signs after plain letters are a token of their own: each distinct part is encoded once.
        """
        import numpy as np

        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        heads = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        first, second = coded.dictionary, pa.nulls(len(coded.dictionary), pa.string())
        if self.simple:
            cut = pc.extract_regex(coded.dictionary, _STEM_AND_SIGNS)
            first = pc.if_else(cut.is_valid(), pc.utf8_lower(pc.struct_field(cut, "stem")), coded.dictionary)
            signs = pc.struct_field(cut, "signs")
            second = pc.if_else(pc.equal(signs, ""), pa.scalar(None, pa.string()), signs)
        ends, ids = self.known.encoded(first, second, coded.indices.to_numpy(), heads)
        if end is None:
            return ends, ids
        own = np.arange(len(ends))
        out = np.full(len(ids) + len(ends), end, dtype="<i4")
        kept = np.ones(len(out), dtype=bool)
        kept[ends + own] = False
        out[kept] = ids
        return ends + own + 1, out


def encode(df: DataFrame, tokenizer: str, text: str = "text", end: int | None = None) -> DataFrame:
    """df with `ids` (array<int>) and `n_tokens` (int, all ids): the whole text's ids without special tokens.

    `end` is appended to every document; a null or empty text has that id alone. Columns named
    like the new ones are replaced.
    """
    df = without(df, ["ids", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = WordBpe.of(tokenizer)
        for batch in slices(batches, text, TEXT_BYTES):
            ends, ids = coder.encode(batch.column(text), end)
            counts = pa.array(np.diff(ends, prepend=0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, list_of(ends, ids), counts], names=[*batch.schema.names, "ids", "n_tokens"])

    return df.mapInArrow(lean(run), added(df, ids=T.ArrayType(T.IntegerType()), n_tokens=T.IntegerType()))


def write(df: DataFrame, path: str, tokenizer: str, end: int | None = None, key: str = "doc_id", text: str = "text", partitions: int | None = None, layout: Layout = Layout()) -> None:
    """Write the documents' ids in ascending order of `key` over all files, by their names.

    Nulls come first; rows of equal key are ordered by their text (null first), equal rows are
    all kept. Only key, ids and n_tokens are written. An empty table makes an empty folder.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    # Keys alone set the ranges: a key of many rows stays in one file, as its order needs.
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    encode(ranged, tokenizer, end=end).drop("text").write.options(**layout.options()).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids and n_tokens of the files, with each row's place: its file's name and its row there.

    Columns that are not selected, and row groups or pages that a filter on doc_id rules out, are not read.
    """
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())])
    return spark.read.schema(kinds).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """rows of read(), with or without their ids, with `start` (long): the ids of all documents before.

    Files are in key order by name and rows in order in each file, so a running sum in each file
    is added to one over the files' totals, for which only the metadata column is read.
    """
    sizes = read(rows.sparkSession, path).groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # One row for each file, so the single partition of this window is as small as a file list.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    inner = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = without(rows, ["start"]).withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return inside.join(before, "file").withColumn("start", (F.col("before") + F.col("inside")).cast("long")).drop("before", "inside")


def with_crc32(df: DataFrame, ids: str = "ids") -> DataFrame:
    """df with `ids_crc32` (long): the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    df = without(df, ["ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = list_parts(batch.column(ids))
            raw = memoryview(values).cast("B")
            sums = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist())], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sums], names=[*batch.schema.names, "ids_crc32"])

    return df.mapInArrow(lean(run), added(df, ids_crc32=T.LongType()))
