"""Pages of documents: where their files lie, and the cells in two formats of nested JSON.

All readers take tables of texts or paths, so that Spark reads and spreads them; a page is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.reconcile import best_by

#: The fields of format A that are read.
A_SCHEMA = """content string, tableHeadTail array<struct<head: array<string>, tail: array<string>>>,
prism_wordsInfo array<struct<tableCellId: bigint, prob: double>>,
prism_tablesInfo array<struct<tableId: string, cellInfos: array<struct<tableCellId: bigint, word: string, ysc: int, yec: int, xsc: int, xec: int>>>>"""
#: The fields of format B that are read.
B_SCHEMA = """TableDetections array<struct<Type: string, Cells: array<struct<RowTl: int, RowBr: int, ColTl: int, ColBr: int, Text: string, Type: string, Confidence: double>>>>"""


def page_number(name: Column) -> Column:
    """The number after `page_` (four digits, any case), or null."""
    return F.regexp_extract(name, r"(?i)page_([0-9]{4})", 1).try_cast("int")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_id, page_no) of every file below folder/<document>/; only the listing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    base = F.regexp_extract("path", r"[^/]+$", 0)
    inside = F.element_at(F.split("path", F.concat(F.lit("/"), F.element_at(F.split(F.lit(folder.rstrip("/")), "/"), -1), F.lit("/"))), -1)
    return found.select("path", F.substring_index(inside, "/", 1).alias("doc_id"), page_number(base).alias("page_no"))


def result_index(results: DataFrame) -> DataFrame:
    """(doc_id, page_no, raw_file, text) of result files (doc_id, json); of pages listed twice the last counts."""
    kind = "pages array<struct<page_number: int, raw_file: string, text: string>>"
    rows = results.select("doc_id", F.posexplode(F.from_json("json", kind)["pages"]).alias("at", "p")).filter("p.page_number IS NOT NULL")
    return rows.groupBy("doc_id", F.col("p.page_number").alias("page_no")).agg(F.max_by("p", "at").alias("p")).select("doc_id", "page_no", "p.raw_file", "p.text")


def candidate_pages(index: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc_id, page_no) named in the index or by a file."""
    return index.select("doc_id", "page_no").union(catalog.select("doc_id", "page_no")).filter("page_no IS NOT NULL").distinct()


def raw_files(index: DataFrame, catalog: DataFrame, family: str) -> DataFrame:
    """(doc_id, page_no, path, rank) of each page's raw file: the one that the index names (0), else
    page_NNNN.json (1), else page_NNNN_*.json with the provider's family in its name (2), else any (3)."""
    known = catalog.filter(F.col("path").endswith(".json")).join(index.select("doc_id", "page_no", "raw_file"), ["doc_id", "page_no"], "left")
    name = F.regexp_extract("path", r"[^/]+$", 0)
    hinted = F.coalesce(F.col("path").endswith(F.concat(F.lit("/"), F.col("doc_id"), F.lit("/"), F.col("raw_file"))), F.lit(False))
    rank = F.when(hinted, 0).when(name.rlike(r"^page_[0-9]{4}\.json$"), 1).when(F.contains(name, F.lit(family)), 2).otherwise(3)
    return best_by(known.withColumn("rank", rank), ["doc_id", "page_no"], F.col("rank"), F.col("path")).select("doc_id", "page_no", "path", "rank")


def format_a(pages: DataFrame) -> DataFrame:
    """pages (.., json) with `data`: its Data or data field, an object or JSON in a string; a broken string becomes its content."""
    text = F.coalesce(F.get_json_object("json", "$.Data"), F.get_json_object("json", "$.data"))
    read = F.from_json(text, A_SCHEMA)
    whole = F.when(F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull(), read)
    broken = F.from_json(F.to_json(F.struct(text.alias("content"))), A_SCHEMA)
    return pages.withColumn("data", F.when(text.isNull(), F.from_json(F.lit("{}"), A_SCHEMA)).otherwise(F.coalesce(whole, broken)))


def cells_a(pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, table_id, ordinal, row_start, row_end, col_start, col_end, text, confidence) of pages with format_a()'s data.

    Missing ends are the starts, missing starts 0, missing table ids the table's number from 1.
    Confidence is the mean probability of the words in the cell.
    """
    rows = pages.select(*key, F.col("data.prism_wordsInfo").alias("words"), F.posexplode("data.prism_tablesInfo").alias("t", "table"))
    rows = rows.select(*key, "words", F.coalesce("table.tableId", (F.col("t") + 1).cast("string")).alias("table_id"), F.posexplode("table.cellInfos").alias("ordinal", "c"))
    own = F.filter("words", lambda w: (w["tableCellId"] == F.col("c.tableCellId")) & w["prob"].isNotNull())
    total = F.aggregate(own, F.lit(0.0), lambda s, w: s + w["prob"])
    top, left = F.coalesce("c.ysc", F.lit(0)), F.coalesce("c.xsc", F.lit(0))
    return rows.select(*key, "table_id", "ordinal", top.alias("row_start"), F.coalesce("c.yec", top).alias("row_end"), left.alias("col_start"), F.coalesce("c.xec", left).alias("col_end"), F.coalesce("c.word", F.lit("")).alias("text"), F.when(F.size(own) > 0, total / F.size(own)).alias("confidence"))


def context_a(pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, line) of the heads and tails of tables."""
    lines = F.flatten(F.transform("data.tableHeadTail", lambda x: F.concat(F.coalesce(x["head"], F.array().cast("array<string>")), F.coalesce(x["tail"], F.array().cast("array<string>")))))
    return pages.select(*key, F.explode(lines).alias("line")).filter("line <> ''")


def span_b(start: Column, end: Column) -> tuple[Column, Column]:
    """First and last place from 0 of format B, which counts from 1 in some places: a positive start
    goes down by one, an end that is missing or negative is the start, and none lies before it."""
    start = F.coalesce(start, F.lit(0))
    first = F.when(start > 0, start - 1).otherwise(start)
    last = F.coalesce(end, start - 1)
    return first, F.greatest(first, F.when(last >= 0, last).otherwise(first))


def cells_b(pages: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells as of cells_a(), and (key, line) of the texts with negative coordinates. Cells without coordinates are left out."""
    rows = pages.select(*key, F.posexplode(F.from_json("json", B_SCHEMA)["TableDetections"]).alias("t", "table"))
    rows = rows.select(*key, (F.col("t") + 1).cast("string").alias("table_id"), F.posexplode("table.Cells").alias("ordinal", "c"))
    outside = (F.col("c.RowTl") < 0) | (F.col("c.ColTl") < 0)
    (top, bottom), (left, right) = span_b(F.col("c.RowTl"), F.col("c.RowBr")), span_b(F.col("c.ColTl"), F.col("c.ColBr"))
    cells = rows.filter(~outside).select(*key, "table_id", "ordinal", top.alias("row_start"), bottom.alias("row_end"), left.alias("col_start"), right.alias("col_end"), F.coalesce("c.Text", F.lit("")).alias("text"), F.col("c.Confidence").alias("confidence"))
    return cells, rows.filter(outside & (F.trim("c.Text") != "")).select(*key, F.trim("c.Text").alias("line"))
