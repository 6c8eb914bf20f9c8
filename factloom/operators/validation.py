"""Checks of accounting identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import tolerance
from factloom.operators.reconcile import best_by

#: Statuses whose facts aren't checked.
UNCHECKED = ("review", "conflict", "suppressed")


def checked(facts: DataFrame, status: str = "status") -> DataFrame:
    """The facts that enter checks."""
    return facts.filter(F.col(status).isNull() | ~F.col(status).isin(*UNCHECKED))


def balance(facts: DataFrame, group: list[str], parts: dict[str, Column], order: list[Column], value: str = "value", absolute: float = 1.0, relative: float = 0.0001) -> DataFrame:
    """whole = first + second for each group, where parts names conditions for whole, first, second.

    Each part is the best row that meets its condition. A missing part makes the check skipped. The
    difference is whole - (first + second); it passes within the larger of the absolute tolerance
    and the relative one of the larger side. Facts should come through checked().
    """
    rows = facts
    named = F.lit(None)
    for name, condition in parts.items():
        named = F.when(condition, F.lit(name)).otherwise(named)
    best = best_by(rows.withColumn("__part", named).filter(F.col("__part").isNotNull() & F.col(value).isNotNull()), [*group, "__part"], *order)
    wide = best.groupBy(*group).agg(*[F.max(F.when(F.col("__part") == name, F.col(value))).alias(name) for name in parts])
    every = facts.select(*group).distinct().join(wide, group, "left")
    whole, first, second = parts
    right = F.col(first) + F.col(second)
    allowed = tolerance(absolute, relative, F.col(whole), right)
    gap = F.col(whole) - right
    status = F.when(gap.isNull(), "skipped").when(F.abs(gap) <= allowed, "pass").otherwise("fail")
    return every.select(*group, *parts, F.round(gap, 6).alias("difference"), status.alias("status"))


def subtotals(facts: DataFrame, group: list[str], row: str, is_total: Column, value: str = "value", absolute: float = 1.0, relative: float = 0.0001) -> DataFrame:
    """Each total row against the sum of the detail rows strictly between it and the total row before.

    Rows at the same place as a total aren't its details. Fewer than two details: skipped. Sums
    are taken in decimals, so they don't depend on order.
    """
    ordered = Window.partitionBy(*group).orderBy(row)
    before = ordered.rangeBetween(Window.unboundedPreceding, -1)
    rows = facts.withColumn("__total", is_total)
    # A row's island is the last total before it.
    rows = rows.withColumn("__from", F.max(F.when(F.col("__total"), F.col(row))).over(before))
    island = Window.partitionBy(*group, "__from").orderBy(row).rangeBetween(Window.unboundedPreceding, -1)
    detail = F.when(~F.col("__total"), F.col(value).cast("decimal(18,2)"))
    rows = rows.withColumns({"details": F.count(detail).over(island), "expected": F.sum(detail).over(island).cast("double")}).filter("__total")
    gap = F.abs(F.col(value) - F.col("expected"))
    status = F.when(F.col("details") < 2, "skipped").when(gap <= tolerance(absolute, relative, F.col(value), F.col("expected")), "pass").otherwise("fail")
    return rows.select(*group, row, F.col(value).alias("total"), "details", F.when(F.col("details") >= 2, F.col("expected")).alias("expected"), status.alias("status"))


def ratios(facts: DataFrame, is_total: Column, value: str = "value", slack: float = 0.02) -> DataFrame:
    """Total ratios must be 1."""
    return facts.filter(is_total & F.col(value).isNotNull()).withColumn("status", F.when(F.abs(F.col(value) - 1) <= slack, "pass").otherwise("fail"))


def summary(results: DataFrame, rule: str = "rule", status: str = "status") -> DataFrame:
    """Counts of each rule by status."""
    return results.groupBy(rule).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in ("pass", "fail", "review", "skipped")])
