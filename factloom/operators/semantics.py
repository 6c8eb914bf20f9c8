"""Keys that say what a table, a row's block and a column are about, whatever their provider calls them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import clean_text, semantic_token

#: Words of header rows, and how many tokens and rows make a key.
KEYWORDS = ("项目", "行次", "期初数", "期末数", "期末余额", "本期", "上期", "金额", "比例", "账龄", "单位名称", "资产类别", "固定资产类别", "预计")
HEADERS, LABELS, TABLE_ROWS, BLOCK_ROWS = 6, 3, 6, 5


def is_header(texts: Column) -> Column:
    """Whether a row of cleaned texts has two filled cells and one of the words of headers."""
    filled = F.filter(texts, lambda x: x != "")
    joined = F.array_join(filled, " ")
    told = F.lit(False)
    for word in KEYWORDS:
        told = told | F.contains(joined, F.lit(word))
    return (F.size(filled) >= 2) & told


def row_label(texts: Column, label_col: Column, value_cols: Column, line_col: Column) -> Column:
    """The text of the label column, else the first filled one that holds neither values nor line numbers."""
    own = F.coalesce(F.get(texts, label_col), F.lit(""))
    places = F.transform(texts, lambda x, i: F.struct(x.alias("x"), (~F.array_contains(value_cols, i) & ~i.eqNullSafe(line_col)).alias("free")))
    other = F.get(F.filter(places, lambda p: p["free"] & (p["x"] != "")), F.lit(0))["x"]
    return F.when(own != "", own).otherwise(F.coalesce(other, F.lit("")))


def column_key(path: Column, role: Column, value_type: Column) -> Column:
    """The tokens of a header path, else the period's role, else the type of the values."""
    tokens = F.filter(F.transform(path, semantic_token), lambda t: t != "")
    known = F.coalesce(role, F.lit("unknown"))
    return F.when(F.size(tokens) > 0, F.array_join(tokens, "|")).when(~known.isin("", "unknown"), known).otherwise(value_type)


def fact_status(suspicious: Column, repair: Column, value_type: Column, value: Column) -> Column:
    """review for suspicious cells, unresolved repairs and texts; repaired; blank; else observed."""
    asked = suspicious | (repair == "unresolved")
    return F.when(asked, "review").when(repair == "repaired", "repaired").when(value_type == "blank", "blank").when(value.isNull() & (value_type == "text"), "review").otherwise("observed")


def _signature(headers: Column, labels: Column) -> tuple[Column, Column]:
    first, rows = F.slice(headers, 1, HEADERS), F.slice(labels, 1, LABELS)
    return F.when(F.size(first) > 0, F.array_join(first, ",")).otherwise("no_header"), F.when(F.size(rows) > 0, F.array_join(rows, ",")).otherwise("no_rows")


def keyed(rows: DataFrame, table: list[str]) -> DataFrame:
    """rows with `label`, `header_row` (the place of their block's header), `row_key` and `table_key`.

    rows: every row of each table from 0, with texts (array of cell texts), label_col, line_col (null:
    none), value_cols (array) and statement_type. A block begins at a header row, the first one at
    row 0. Its key has its title, the label of one of the two rows above the header unless a header
    comes before it, the header's first tokens, and the labels of the rows below it. The rows of a
    table are shuffled and ordered once, for windows of one order. Rows whose table is null are left out.
    """
    texts = F.transform("texts", clean_text)
    df = rows.dropna(subset=table).withColumn("__texts", texts).withColumn("__head", is_header(F.col("__texts")))
    df = df.withColumn("label", row_label(F.col("__texts"), F.col("label_col"), F.col("value_cols"), F.col("line_col"))).withColumn("__token", semantic_token(F.col("label")))
    order = Window.partitionBy(*table).orderBy("row")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.struct("row", "__head", "__token")
    ahead = range(1, max(BLOCK_ROWS, TABLE_ROWS) + 1)
    near = {"__one": F.lag(seen, 1).over(order), "__two": F.lag(seen, 2).over(order)} | {f"__next{k}": F.lead(seen, k).over(order) for k in ahead}
    df = df.withColumns({"header_row": F.coalesce(F.last(F.when(F.col("__head"), F.col("row")), ignorenulls=True).over(upto), F.lit(0)), **near})
    above, further = F.col("__one"), F.col("__two")
    second = F.when(further.isNotNull() & ~further["__head"], further["__token"]).otherwise("")
    title = F.when(above.isNull() | above["__head"], "").when(above["__token"] != "", above["__token"]).otherwise(second)
    tokens = F.filter(F.transform("__texts", semantic_token), lambda t: t != "")
    # Rows ahead are enough for a key; a block's and a table's first row make it, and the rows below take it over.
    whole, block, same = [], [], F.lit(True)
    for c in (seen, *[F.col(f"__next{k}") for k in ahead]):
        if whole:
            same = same & ~F.coalesce(c["__head"], F.lit(True))
        filled, since = c["__token"] != "", c["row"] - F.col("header_row")
        whole.append(F.when(filled & c["row"].between(1, TABLE_ROWS), c["__token"]))
        block.append(F.when(same & filled & since.between(1, BLOCK_ROWS), c["__token"]))
    at = F.col("row") == F.col("header_row")
    heads, labels = _signature(F.when(at, tokens), F.array_compact(F.array(*block)))
    named = F.when(at & (F.col("row") > 0) & (title != ""), F.concat(F.lit("|t:"), title)).otherwise("")
    block_key = F.when(above.isNull() | F.col("__head"), F.concat(named, F.lit("|h:"), heads, F.lit("|r:"), labels))
    heads, labels = _signature(F.when(F.col("row") == 0, tokens), F.array_compact(F.array(*whole)))
    whole_key = F.when(above.isNull(), F.concat(F.lit("|h:"), heads, F.lit("|r:"), labels))
    made = df.withColumns({"__block": block_key, "__whole": whole_key}).drop("__texts", "__head", "__token", *near)
    key = lambda c: F.concat("statement_type", F.last(c, ignorenulls=True).over(upto))
    return made.withColumns({"row_key": key("__block"), "table_key": key("__whole")}).drop("__block", "__whole")
