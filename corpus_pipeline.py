"""The corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, sources are
mixed to their target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, line_dedup, minhash, mixing, toxicity
from factloom.llm.common import settled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. Labels of held-out rows aren't read."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line of the corpus repeats, and n_chars of what is left.

    A document that loses all its lines keeps its row with an empty text.
    """
    rows = line_dedup.line_dedup(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words, a similarity of 0.8 or more.

    Rows are decided on one by one, whatever their doc_id: ids may repeat or be null. The first
    by doc_id stays (null ids come last), then by a hash of the row. Texts without words are in
    no group and stay.
    """
    rows = settled(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows, "__row", shape=minhash.Shape(words=5, percent=80)).select("__row", "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.xxhash64(*COLUMNS).alias("content"), "__row")
    placed = settled(found.join(rows.select("__row", place.alias("place")), "__row"), "placed")
    first = placed.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).filter("n > 1")
    gone = placed.join(first, "component_id").filter("place <> first").select("__row")
    return rows.join(settled(gone, "gone"), "__row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out by their source's rate, in globally shuffled order."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(docs.select("doc_id", "source", "text"), ranks, pattern, back=True)
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("toxicity", keep_civil),
    ("line_dedup", drop_repeated_lines),
    ("minhash", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: A trained classifier and edit distances are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
