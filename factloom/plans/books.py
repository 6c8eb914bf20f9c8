"""Queries on workbooks that Spark makes of the tables, one for each supplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.scratch import written
from factloom.plans.facts import table
from factloom.sources import workbooks

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _cell(row, col: int, text: Column | None = None, number: Column | None = None, col_end: Column | int | None = None) -> Column:
    whole = lambda x: x.cast("int") if isinstance(x, Column) else F.lit(x).cast("int")
    end = col if col_end is None else col_end
    return F.struct(whole(row).alias("row"), whole(col).alias("col"), whole(row).alias("row_end"), whole(end).alias("col_end"), (F.lit(None) if number is None else number).cast("double").alias("number"), (F.lit(None) if text is None else text).cast("string").alias("text"))


def _books(rows: DataFrame, cells: list[Column], head: list[Column]) -> DataFrame:
    """Workbooks of one sheet: the cells of every row of a book, and its head, once."""
    body = rows.select("book", F.explode(F.array(*cells)).alias("c")).select("book", "c.*")
    heads = rows.select("book").distinct().select("book", F.explode(F.array(*head)).alias("c")).select("book", "c.*")
    return workbooks.books(body.unionByName(heads).select("*", F.lit(0).alias("sheet_no"), F.lit("表").alias("sheet")))


def _read(files: DataFrame, sheets: str) -> DataFrame:
    """The cells of workbooks, each made and parsed once."""
    return written(workbooks.cells(files, sheets), "cells")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("book"), F.col("l_linenumber").alias("line")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""WITH lines AS (SELECT l_suppkey AS book, l_linenumber AS line, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS BIGINT) AS total FROM lineitem GROUP BY ALL),
slots AS (SELECT book, unnest(range(0, max(line) + 1)) AS row FROM lines GROUP BY book),
cells AS (SELECT book, row, col FROM slots, (SELECT unnest([0, 1, 2]) AS col) WHERE NOT (row = 2 AND col = 1 AND EXISTS (SELECT 1 FROM lines l WHERE l.book = slots.book AND l.line = 2)))
SELECT CAST(c.book AS VARCHAR) AS path, '表' AS table_id, CAST(c.row AS INTEGER) AS row_start, CAST(c.row AS INTEGER) AS row_end, CAST(c.col AS INTEGER) AS col_start,
       CAST(c.col + CASE WHEN c.row = 2 AND c.col = 0 AND line IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS col_end,
       CASE WHEN c.row = 0 THEN (['项目', '行次', '期末数'])[c.col + 1] WHEN line IS NULL THEN '' WHEN c.col = 0 THEN '行 ' || line WHEN c.col = 1 THEN CAST(line AS VARCHAR) WHEN total = 0 THEN '' ELSE CAST(total AS VARCHAR) END AS text
FROM cells c LEFT JOIN lines l ON l.book = c.book AND l.line = c.row""")
def workbook_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in sheets that begin at the third row and second column, under a merged title and above a note."""
    row, line = F.col("line") + 3, F.col("line").cast("string")
    wide = F.when(F.col("line") == 2, 3).otherwise(2)
    # The merged label of the second line covers its number.
    number = F.when(F.col("line") == 2, None).otherwise(F.col("line"))
    cells = [_cell(row, 2, F.concat(F.lit("行 "), line), col_end=wide), _cell(row, 3, number=number), _cell(row, 4, number=F.col("total"))]
    head = [_cell(1, 2, F.concat(F.lit("供应商 "), F.col("book").cast("string")), col_end=4), *[_cell(3, k, F.lit(t)) for k, t in ((2, "项目"), (3, "行次"), (4, "期末数"))], _cell(14, 2, F.lit("注"))]
    return workbooks.tables(_read(_books(_lines(spark, sf_dir), cells, head), "active")).drop("sheet_no")


@query("""WITH lines AS (SELECT l_suppkey AS book, l_linenumber AS line, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS BIGINT) AS total FROM lineitem GROUP BY ALL)
SELECT CAST(book AS VARCHAR) AS path, 'ZT_00' || line AS code, '科目 ' || line AS name, CAST(line + 2 AS INTEGER) AS row, h.header,
       CASE WHEN h.header = '期初数' THEN NULL WHEN total = 0 THEN '' ELSE CAST(total AS VARCHAR) END AS value FROM lines, (SELECT unnest(['期末数', '期初数']) AS header) h""")
def workbook_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, line = F.col("line") + 2, F.col("line").cast("string")
    cells = [_cell(row, 1, F.concat(F.lit("ZT_00"), line, F.lit(" 科目 "), line)), _cell(row, 2, number=F.col("total"))]
    head = [_cell(2, 1, F.lit("科目名称")), _cell(2, 2, F.lit("期末数")), _cell(2, 3, F.lit("期初数")), _cell(11, 1, F.lit("合计"))]
    return workbooks.benchmark_rows(_read(_books(_lines(spark, sf_dir), cells, head), "first"))
