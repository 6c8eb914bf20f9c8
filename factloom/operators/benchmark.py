"""Comparing an export with a benchmark, and explaining what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import safe_ratio


def compare(benchmark: DataFrame, auto: DataFrame, key: list[str], tolerance: float = 0.01) -> DataFrame:
    """A row for each cell of either side: match, value_diff, missing_in_auto or extra_in_auto.

    Both sides are (key, value); cells empty on both sides match.
    """
    both = benchmark.withColumnRenamed("value", "benchmark_value").join(auto.withColumnRenamed("value", "auto_value"), key, "full_outer")
    b, a = F.col("benchmark_value"), F.col("auto_value")
    status = F.when(b.isNull() & a.isNull(), "match").when(a.isNull(), "missing_in_auto").when(b.isNull(), "extra_in_auto").when(F.abs(b - a) <= tolerance, "match").otherwise("value_diff")
    return both.withColumn("status", status)


def metrics(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts and precision, recall, exact match and missing ratio, of all cells or by columns."""
    rows = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("status") == "match").alias("matches"),
        F.count("benchmark_value").alias("benchmark_filled"),
        F.count("auto_value").alias("auto_filled"),
        F.count_if(F.col("status") == "missing_in_auto").alias("missing"),
        F.count_if(F.col("status") == "extra_in_auto").alias("extra"),
    )
    r = lambda a, b: F.round(safe_ratio(F.col(a), F.col(b)), 6)
    return rows.withColumns({"precision": r("matches", "auto_filled"), "recall": r("matches", "benchmark_filled"), "exact_match": r("matches", "cells"), "missing_ratio": r("missing", "benchmark_filled")})


def align_headers(headers: DataFrame, periods: DataFrame) -> DataFrame:
    """Each legacy header with the only period whose role it is; days before other dates; else ambiguous or none.

    headers: (header, role); periods: (period_key). Both are the columns of one sheet. The role
    is an equality, so no pairs of other roles are made.
    """
    named = periods.select("period_key", F.substring_index("period_key", "__", -1).alias("role"), F.col("period_key").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}__").alias("day"))
    found = headers.join(named, "role", "left").groupBy("header", "role").agg(F.count("period_key").alias("n"), F.count_if("day").alias("days"), F.min("period_key").alias("only"), F.min(F.when(F.col("day"), F.col("period_key"))).alias("only_day"))
    state = F.when(F.col("n") == 0, "unaligned").when((F.col("n") == 1) | (F.col("days") == 1), "aligned").otherwise("ambiguous")
    return found.select("header", "role", F.when(F.col("n") == 1, F.col("only")).when(F.col("days") == 1, F.col("only_day")).alias("period_key"), state.alias("state"))


def near_amounts(gaps: DataFrame, facts: DataFrame, equal: list[str], tolerance: float = 0.01) -> DataFrame:
    """Gaps with the facts of the same `equal` columns whose value lies within the tolerance.

    Amounts fall into buckets as wide as the tolerance; each gap looks into its own and both
    neighbours, so the join is one of equal keys.
    """
    # Slots are cut in decimals, like the comparison: 0.29 and 0.30 are neighbours.
    slot = lambda c: F.floor(F.col(c).cast("decimal(18,4)") / F.lit(tolerance).cast("decimal(18,4)")).cast("long")
    left = gaps.withColumn("__slot", F.explode(F.array(slot("amount") - 1, slot("amount"), slot("amount") + 1)))
    right = facts.withColumn("__slot", slot("value"))
    # Cents are compared as decimals, so 0.1 + 0.2 lies where it should.
    close = F.abs(F.col("amount").cast("decimal(18,4)") - F.col("value").cast("decimal(18,4)")) <= F.lit(tolerance).cast("decimal(18,4)")
    return left.join(right, [*equal, "__slot"]).filter(close).drop("__slot")


def gap_causes(missing: DataFrame, mapped: DataFrame, derived: DataFrame, key: list[str], equal: list[str], facts: DataFrame) -> DataFrame:
    """Why each missing cell is missing, by the first cause that holds: a mapped fact exists, a fact
    of that amount exists, a derived one does, or none."""
    has = lambda df, cols, name: df.select(*cols).distinct().withColumn(name, F.lit(True))
    amounts = near_amounts(missing.withColumnRenamed("value", "amount").select(*key, "amount"), facts, equal).select(*key).distinct().withColumn("__amount", F.lit(True))
    rows = missing.join(has(mapped, key, "__mapped"), key, "left").join(amounts, key, "left").join(has(derived, key, "__derived"), key, "left")
    cause = F.when(F.col("__mapped"), "mapped_fact_exists").when(F.col("__amount"), "alias_candidate_by_amount").when(F.col("__derived"), "formula_candidate").otherwise("no_source")
    return rows.withColumn("cause", cause).drop("__mapped", "__amount", "__derived")


def delta(before: DataFrame, after: DataFrame, key: str, metric: str) -> DataFrame:
    """before and after of every key of either, and the difference (missing counts as 0)."""
    rows = before.select(key, F.col(metric).alias("before")).join(after.select(key, F.col(metric).alias("after")), key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "resolved").otherwise("unchanged")
    return rows.withColumns({"delta": F.round(zero("after") - zero("before"), 6), "change": change})
