"""Tables of cells: spans made dense, header paths, value columns, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import looks_integer, looks_numeric
from factloom.functions.text import clean_text

#: Words of header rows, of the column of line numbers, and of the column of notes.
HEADER_WORDS = ("行次", "期初数", "期末数", "本期", "上期", "金额", "比例", "项目")
LINE_NUMBER, NOTE = "行次", "附注"


def densify(cells: DataFrame, table: list[str]) -> DataFrame:
    """One row (table, row, col, text, anchor_row, anchor_col) for each slot of each table's grid.

    cells: table columns, row_start, row_end, col_start, col_end, text, ordinal. A cell covers its
    whole span; of cells that cover a slot the last by ordinal counts; slots that none covers are
    blank. Spans are generated within rows and the grid from its size, so nothing is crossed.
    """
    spans = cells.withColumn("row", F.explode(F.sequence("row_start", "row_end"))).withColumn("col", F.explode(F.sequence("col_start", "col_end")))
    covered = spans.groupBy(*table, "row", "col").agg(F.max_by(F.struct("text", F.col("row_start").alias("anchor_row"), F.col("col_start").alias("anchor_col")), "ordinal").alias("c")).select(*table, "row", "col", "c.*")
    sizes = cells.groupBy(*table).agg(F.max("row_end").alias("rows"), F.max("col_end").alias("cols"))
    slots = sizes.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int")))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols").cast("int")))).drop("rows", "cols")
    return slots.join(covered, [*table, "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def header_paths(grid: DataFrame, table: list[str], header_rows: Column) -> DataFrame:
    """Each column's distinct header texts from top to bottom, joined by ` / `."""
    heads = grid.filter((F.col("row") < header_rows) & (F.col("text") != "")).groupBy(*table, "col").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("h"))
    return heads.select(*table, "col", F.array_join(F.array_distinct(F.transform("h", lambda x: x["text"])), " / ").alias("header_path"))


def value_columns(grid: DataFrame, table: list[str], header_rows: Column, is_header: Column, is_number: Column, share: float = 0.5) -> DataFrame:
    """Columns, but for the first, whose header says so or whose filled cells are numbers by half or more."""
    body = (F.col("row") >= header_rows) & (F.col("text") != "")
    rows = grid.filter("col > 0").groupBy(*table, "col").agg(F.count_if(body).alias("filled"), F.count_if(body & is_number).alias("numbers"), F.bool_or((F.col("row") < header_rows) & is_header).alias("named"))
    return rows.filter(F.col("named") | ((F.col("numbers") > 0) & (F.col("numbers") >= share * F.col("filled"))))


def facts(grid: DataFrame, columns: DataFrame, paths: DataFrame, table: list[str], header_rows: Column) -> DataFrame:
    """One fact for each body row and value column: its label from the first column, header path and text."""
    body = grid.filter(F.col("row") >= header_rows)
    labels = body.filter("col = 0").select(*table, "row", F.col("text").alias("label"))
    rows = body.join(columns.select(*table, "col"), [*table, "col"]).join(labels, [*table, "row"], "left").join(paths, [*table, "col"], "left")
    return rows.filter("label <> '' OR text <> ''").select(*table, "row", "col", "label", F.coalesce("header_path", F.lit("")).alias("header_path"), "text")


def carried_header(rows: DataFrame, table: list[str], order: str, is_header: Column, text: str) -> DataFrame:
    """rows with the text of the last header row at or above each."""
    above = Window.partitionBy(*table).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("header", F.last(F.when(is_header, F.col(text)), ignorenulls=True).over(above))


def rows_of(grid: DataFrame, table: list[str]) -> DataFrame:
    """(table, row, texts): the cleaned texts of each row in the order of columns."""
    cells = grid.select(*table, "row", F.struct("col", clean_text(F.col("text")).alias("text")).alias("c"))
    return cells.groupBy(*table, "row").agg(F.array_sort(F.collect_list("c")).alias("c")).select(*table, "row", F.transform("c", lambda x: x["text"]).alias("texts"))


def first_meaningful_row(rows: DataFrame, table: list[str]) -> DataFrame:
    """(table, first): the first row with three filled cells or the word for line numbers, else 0."""
    filled = F.size(F.filter("texts", lambda x: x != ""))
    hit = (filled >= 3) | F.contains(F.array_join("texts", " "), F.lit(LINE_NUMBER))
    return rows.groupBy(*table).agg(F.coalesce(F.min(F.when(hit, F.col("row"))), F.lit(0)).alias("first"))


def subtables(rows: DataFrame, table: list[str]) -> DataFrame:
    """(table, start, end): the ranges of columns of a table's parts.

    Parts begin one column before the second and every later cell for line numbers in the first
    meaningful row; a table with fewer such cells is one part.
    """
    heads = rows.join(first_meaningful_row(rows, table), table).filter("row = first")
    marks = F.filter(F.transform("texts", lambda x, i: F.when(F.contains(x, F.lit(LINE_NUMBER)), i)), lambda i: i.isNotNull())
    later = F.array_distinct(F.filter(F.transform(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), lambda i: F.greatest(i - 1, F.lit(0))), lambda i: i > 0))
    starts = heads.select(*table, (F.size("texts") - 1).alias("last"), F.concat(F.array(F.lit(0)), later).alias("starts"))
    cut = F.transform("starts", lambda x, i: F.struct(x.alias("start"), F.coalesce(F.get("starts", i + 1) - 1, F.col("last")).alias("end")))
    return starts.select(*table, F.explode(cut).alias("x")).select(*table, "x.start", "x.end")


def is_data(texts: Column) -> Column:
    """Whether a row's texts look like data: a label, an integer in the first three cells and a number
    after the first; header words without any number speak against it."""
    value = F.exists(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), looks_numeric)
    return (F.size(texts) > 0) & (F.get(texts, F.lit(0)) != "") & F.exists(F.slice(texts, 1, 3), looks_integer) & value


def header_rows(rows: DataFrame, table: list[str]) -> DataFrame:
    """(table, header_rows): the place of the first data row of the first three, at least 1; without one all three or fewer."""
    found = rows.filter("row < 3").groupBy(*table).agg(F.min(F.when(is_data(F.col("texts")), F.col("row"))).alias("data"), F.count(F.lit(1)).alias("n"))
    return found.select(*table, F.when(F.col("data").isNotNull(), F.greatest("data", F.lit(1))).otherwise(F.col("n").cast("int")).alias("header_rows"))


def line_number_column(grid: DataFrame, table: list[str], header_rows: Column, share: float = 0.6) -> DataFrame:
    """(table, col): the first column whose header names line numbers or notes, else that with the
    largest share of integers, if it is at least `share`; of equal ones the first. Tables without one have no row."""
    text, head = clean_text(F.col("text")), F.col("row") < header_rows
    named = F.contains(text, F.lit(LINE_NUMBER)) | F.contains(text, F.lit(NOTE))
    body = ~head & (text != "")
    columns = grid.groupBy(*table, "col").agg(F.bool_or(head & named).alias("named"), F.try_divide(F.count_if(body & looks_integer(F.col("text"))), F.count_if(body)).alias("share"))
    order = F.struct((~F.col("named")).alias("a"), F.when(F.col("named"), 0.0).otherwise(-F.col("share")).alias("b"), F.col("col").alias("c"))
    return columns.filter(F.col("named") | (F.col("share") >= share)).groupBy(*table).agg(F.min_by("col", order).alias("col"))
