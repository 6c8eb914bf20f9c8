"""What may be exported, which fact wins a cell, and the wide sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(cases: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds, in order; empty if none does."""
    out = F.lit("")
    for name, condition in reversed(cases):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def export_winners(facts: DataFrame, cell: list[str], order: list[Column], value: str = "value", accepted: Column | None = None, preferred: Column | None = None) -> DataFrame:
    """facts with `export`: exported, or why not.

    A single fact of a cell wins; else the only preferred one, and the others are
    shadow_preferred_other_candidate; of equal values the best by the order, the others are
    duplicate_same_value_not_exported; of different values the only accepted one, the others are
    replaced_by_resolved_candidate; else all are multiple_export_candidates. A missing value
    counts as 0.
    """
    same = Window.partitionBy(*cell)
    flag = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    rows = facts.withColumns({"__ok": flag(accepted), "__first": flag(preferred)})
    amount = F.round(F.coalesce(F.col(value), F.lit(0.0)), 8)
    rows = rows.withColumns({"__n": F.count(F.lit(1)).over(same), "__low": F.min(amount).over(same), "__high": F.max(amount).over(same), "__oks": F.count_if("__ok").over(same), "__firsts": F.count_if("__first").over(same), "__rank": F.row_number().over(same.orderBy(*order))})
    by_preference, equal, by_decision = F.col("__firsts") == 1, F.col("__low") == F.col("__high"), F.col("__oks") == 1
    chosen = F.when(F.col("__n") == 1, True).when(by_preference, F.col("__first")).when(equal, F.col("__rank") == 1).when(by_decision, F.col("__ok")).otherwise(False)
    why = F.when(by_preference, "shadow_preferred_other_candidate").when(equal, "duplicate_same_value_not_exported").when(by_decision, "replaced_by_resolved_candidate").otherwise("multiple_export_candidates")
    return rows.withColumn("export", F.when(chosen, "exported").otherwise(why)).drop("__ok", "__first", "__n", "__low", "__high", "__oks", "__firsts", "__rank")


def pivot_sheet(facts: DataFrame, row: list[str], period: str, periods: list[str], value: Column) -> DataFrame:
    """One row for each `row`, one column for each of the periods, named in advance so one pass suffices."""
    return facts.groupBy(*row).agg(*[F.max(F.when(F.col(period) == p, value)).alias(p) for p in periods])
