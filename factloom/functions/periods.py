"""Dates of statements: candidates in text, their scores, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import clean_text

#: How much a candidate's place is worth, and the words near it.
SOURCE_WEIGHT = {"header": 120, "page_context": 95, "page_text": 70, "result_json": 65, "doc_id": 18}
OTHER_WEIGHT = 20
STATEMENT_WORDS = ("资产负债表", "利润表", "现金流量表", "所有者权益变动表")
DAYS = (r"(20[0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", r"(20[0-9]{2})年\s*([0-9]{1,2})月\s*([0-9]{1,2})日")
MONTHS = (r"(20[0-9]{2})年\s*([0-9]{1,2})月?\s*[-~至]\s*([0-9]{1,2})月", r"(20[0-9]{2})年\s*([0-9]{1,2})月\s*[-~至]\s*([0-9]{1,2})月")
YEAR = r"(20[0-9]{2})年度"


def _all(text: Column, pattern: str, groups: int) -> Column:
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(groups + 1)]
    return F.arrays_zip(*[f.alias("raw" if k == 0 else f"g{k - 1}") for k, f in enumerate(found)])


def candidates(text: Column) -> Column:
    """array<struct<norm, kind, raw>> of a cleaned text: days, ranges of months, and years, each year once.

    Every match counts, so dates that occur again are there again; a range with the word for month
    after its first month counts twice.
    """
    return cleaned_candidates(clean_text(text))


def cleaned_candidates(clean: Column) -> Column:
    """candidates() of a text that is clean already, such as a column that was cleaned once."""
    days = F.transform(F.concat(*[_all(clean, d, 3) for d in DAYS]), lambda x: F.struct(F.format_string("%s-%02d-%02d", x["g0"], x["g1"].cast("int"), x["g2"].cast("int")).alias("norm"), F.lit("exact").alias("kind"), x["raw"].alias("raw")))
    spans = F.transform(F.concat(*[_all(clean, m, 3) for m in MONTHS]), lambda x: F.struct(F.format_string("%s年%d月-%d月", x["g0"], x["g1"].cast("int"), x["g2"].cast("int")).alias("norm"), F.lit("range").alias("kind"), x["raw"].alias("raw")))
    years = F.transform(F.regexp_extract_all(clean, F.lit(YEAR), F.lit(1)), lambda y: F.struct(F.concat(y, F.lit("年度")).alias("norm"), F.lit("annual").alias("kind"), F.concat(y, F.lit("年度")).alias("raw")))
    return F.concat(days, spans, F.array_distinct(years))


def score(source: Column, text: Column, words: tuple[str, ...] = STATEMENT_WORDS) -> Column:
    """A candidate's worth by its place and the words around it; `words` are titles of statements."""
    weight = F.lit(OTHER_WEIGHT)
    for name, w in SOURCE_WEIGHT.items():
        weight = F.when(source == name, w).otherwise(weight)
    statement = F.lit(False)
    for w in words:
        statement = statement | F.contains(text, F.lit(w))
    has = lambda w: F.contains(text, F.lit(w))
    return (
        weight
        + F.when(statement, 18).otherwise(0)
        + F.when(has("截至"), 10).otherwise(0)
        + F.when(has("财务报表") | has("附注"), 18).otherwise(0)
        - F.when(has("报告日期"), 40).otherwise(0)
        - F.when(has("审计报告") & ~statement, 20).otherwise(0)
    )


def best_candidates(df: DataFrame, group: list[str], date: str = "norm", worth: str = "score", order: list[str] = [], margin: float = 5) -> DataFrame:
    """One row for each group: its best candidate, or a null date where the two best disagree too closely.

    worth gains 2 for each time the date occurs in the group; ties go by `order`, then by date.
    A date that repeats counts each time, so copies of the best date don't contest it.
    """
    times = Window.partitionBy(*group, date)
    rows = df.withColumn("__w", F.col(worth) + 2 * F.count(F.lit(1)).over(times))
    ranked = Window.partitionBy(*group).orderBy(F.desc("__w"), *order, F.asc(date))
    rows = rows.withColumns({"__n": F.row_number().over(ranked), "__next": F.lead(date).over(ranked), "__gap": F.col("__w") - F.lead("__w").over(ranked)})
    contested = (F.col("__next") != F.col(date)) & (F.col("__gap") < margin)
    return rows.filter("__n = 1").select(*group, F.when(F.coalesce(contested, F.lit(False)), None).otherwise(F.col(date)).alias(date), F.col("__w").alias("worth"))


def period_key(date: Column, role: Column) -> Column:
    return F.concat(F.coalesce(date, F.lit("unknown_date")), F.lit("__"), F.coalesce(role, F.lit("unknown")))


def split_period(key: Column) -> tuple[Column, Column]:
    """Date and role of a period key; a key without a role has an empty one."""
    both = F.split(key, "__", 2)
    return F.get(both, F.lit(0)), F.coalesce(F.get(both, F.lit(1)), F.lit(""))
