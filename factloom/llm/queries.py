"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, conversation_repair, embedding_dedup, language_id, license_scan, line_dedup, minhash, mixing, quality_rules, token_files, toxicity, warc_zip, whitening
from factloom.llm.common import scratch_dir, table


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = _public("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.encode(docs, ranks, pattern, back=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_dir(spark, "tokens")
    token_files.write(docs, path, _public("word_bpe_49k.json"), end=2)
    rows = token_files.with_crc32(token_files.read(spark, path)).drop("ids")
    return token_files.with_start(rows, path).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc_zip.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc_zip.read(warc_zip.index(spark, path), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, shape=minhash.Shape(words=2))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (~toxicity.learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    # The digest is of the text as it comes out of the shuffle.
    return rows.select("doc_id", "source", "copy", "shuffle_key", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.licensed(docs, license_scan.fit())
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_license_lines")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    n, explained, error = (model.n, model.explained, model.identity_error) if model else (0, [], 0.0)
    shares = F.array(*map(F.lit, explained)).cast("array<double>")
    # A deviation beyond a long is null here; the operator's own is a decimal.
    each = rows.select("vec_id", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "place").alias("explained"), F.lit(error).alias("identity_error"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~language_id.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "accepted")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    pieces = conversation_repair.repair(rows, conv="conv", present=F.col("present"))
    return conversation_repair.outcomes(pieces, conv="conv").withColumnRenamed("conv", "conv_id")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
places AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
measures AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(places.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS BIGINT) AS n_digits,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: list_contains([STOPS], lower(x)))) AS BIGINT) AS n_stop_words
  FROM words LEFT JOIN places USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures)
SELECT *, NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words
       AND 100 * n_symbols <= 10 * n_words AND 100 * n_digits <= 30 * word_chars
       AND 100 * n_dup_lines <= 40 * n_lines AND 100 * n_stop_words >= 2 * n_words AS kept
FROM base
""".replace("STOPS", ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS))))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_token_files": op2_token_files,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_warc_zip": op4_warc_zip,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_language_id": op12_language_id,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {"op4_warc_zip": OP4_SQL, "op7_mixing": mixing.oracle_sql(), "op10_quality_rules": OP10_SQL}
