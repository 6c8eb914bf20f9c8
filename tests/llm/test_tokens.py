import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, token_files
from factloom.llm.common import scratch_dir

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "hello world", "two  spaces", "tab\t x\n\n y \n", "Éçà où naïve ß", "日本語のテキスト 😀 ok",
    "it's they're I'LL", "x \n def", "  abc", "abc\x1c d", "é ́x ~ a~b", "<|endoftext|> hi", "0123 456", "a\x00b c", " x y", "ΣΑΣ İ ǅ",
    "word " * 3000, "x" * 20000, " " * 500 + "end",
]


def odd_texts(n):
    rng = random.Random(7)
    marks = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "é", "😀", "1", " ", ".", "~", "\r\n", "日", " ", "é", "-"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def tiktoken_coder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_encode_as_tiktoken_and_round_trip(spark, tiktoken_coder):
    texts = TEXTS + odd_texts(400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN, offsets=True), RANKS, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert list(row.ids) == tiktoken_coder.encode_ordinary(text), repr(text)
        assert bytes(row.decoded) == text.encode()
        assert len(row.starts) == len(row.ends) == len(row.ids)
        data, at = text.encode(), 0
        for i, a, b in zip(row.ids, row.starts, row.ends):
            part = tiktoken_coder.decode_single_token_bytes(i)
            assert data[at : at + len(part)] == part and part in text[a:b].encode()
            at += len(part)


def test_split_characters_come_whole():
    data = "aé😀".encode()
    parts = pa.array([data[:2], data[2:5], data[5:], b"\xff"], type=pa.binary())
    assert "".join(byte_bpe.decoded_text(parts)) == "aé😀�"


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(none, RANKS, P.PATTERN).collect() == []
    path = scratch_dir(spark, "none")
    token_files.write(none, path, WORDS, end=2)
    assert token_files.with_start(token_files.with_crc32(token_files.read(spark, path)), path).collect() == []


def test_token_files_hold_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    texts = TEXTS + odd_texts(400)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)][::-1], "doc_id long, text string").withColumn("start", F.lit("clash"))
    path = scratch_dir(spark, "tokens")
    token_files.write(docs, path, WORDS, end=2, partitions=3)
    rows = token_files.with_start(token_files.with_crc32(token_files.read(spark, path)), path).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(rows, texts, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert list(row.ids) == ids, repr(text)
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    few = token_files.read(spark, path).filter("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in few._jdf.queryExecution().toString()


def test_files_have_the_layout_asked_for(spark):
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id % 7, ' of the text') AS text")
    path = scratch_dir(spark, "layout")
    token_files.write(docs, path, WORDS, end=2, partitions=1)
    (file,) = glob.glob(path.removeprefix("file:") + "/*.parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and not columns["doc_id"].has_dictionary_page
    assert columns["ids"].has_dictionary_page and columns["ids"].compression == "ZSTD"
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "b"), (None, "x"), (1, "a"), (1, "a"), (0, None)], "doc_id long, text string")
    path = scratch_dir(spark, "ties")
    token_files.write(docs, path, WORDS, partitions=2)
    rows = token_files.with_start(token_files.read(spark, path), path).orderBy("start", "n_tokens").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.start) for r in rows) == [(False, 0, 0), (True, 0, 1), (True, 1, 1), (True, 1, 2), (True, 1, 3)]


def test_digest_columns(spark):
    import __spark_entry__

    row = __spark_entry__.queries()["op1_byte_bpe"](spark, "/root/testdata/sf0.001").filter("n_tokens > 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("doc_id") == row.doc_id).first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
