import hashlib

import pytest
import tiktoken

import corpus_pipeline

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def documents(spark):
    rows = [(1, "A line that stays.\nA line that comes again.", "src0"), (2, "A line that comes again!\nAnother one 12,5 é", None), (None, None, "src1"), (3, "", "src9"), (3, "ab " * 20_000, None)]
    return spark.createDataFrame([(i, t, None, s, len(t or ""), "clash") for i, t, s in rows], KINDS)


def test_lines_go_and_lengths_follow(spark):
    rows = {(r.doc_id, r.text): r.n_chars for r in corpus_pipeline.drop_repeated_lines(spark, documents(spark), "").collect()}
    assert len(rows) == 5 and rows[2, "Another one 12,5 é"] == 18 and rows[None, None] == 0


def test_encoding_as_the_reference_tokenizer(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark)
    want = sorted(hashlib.md5(repr(coder.encode_ordinary(r.text or "")).encode()).hexdigest() for r in docs.collect())
    rows = corpus_pipeline.encode(spark, docs, "").collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert sorted(hashlib.md5(repr(list(r.ids)).encode()).hexdigest() for r in rows) == want


def test_stages_keep_the_columns_of_documents_and_take_empty_tables(spark):
    empty = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        rows = stage(spark, empty, "")
        assert rows.columns == corpus_pipeline.COLUMNS and rows.collect() == []
    assert corpus_pipeline.encode(spark, empty, "").collect() == []
