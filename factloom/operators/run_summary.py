"""The metrics of a run: every measure of the facts at every grain from one scan, and counts of what they are in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import safe_ratio

COUNTS = ("facts_total", "active_total", "suppressed_total", "mapped_total", "unmapped_total", "unknown_date_total", "unknown_statement_type_total", "unknown_period_role_total", "repaired_total", "review_total", "numeric_total")
RATIOS = {"mapped_ratio": "mapped_total", "unmapped_ratio": "unmapped_total", "unknown_date_ratio": "unknown_date_total"}


def _measures() -> dict[str, Column]:
    text = lambda c: F.coalesce(c, F.lit(""))
    status = text(F.col("status"))
    active, mapped = status != "suppressed", text(F.col("code")) != ""
    repaired = (status == "repaired") | F.coalesce(F.array_contains("issue_flags", "repaired_numeric"), F.lit(False))
    amount = lambda when: F.coalesce(F.sum(F.when(when, F.abs("value").cast("decimal(28,6)"))), F.lit(0)).cast("double")
    conditions = {
        "facts_total": F.lit(True),
        "active_total": active,
        "suppressed_total": ~active,
        "mapped_total": active & mapped,
        "unmapped_total": active & ~mapped,
        "unknown_date_total": active & F.coalesce(F.col("report_date") == "unknown_date", F.lit(False)),
        "unknown_statement_type_total": active & F.coalesce(F.col("statement_type") == "unknown", F.lit(False)),
        "unknown_period_role_total": active & (text(F.col("period_role")) == "unknown"),
        "repaired_total": active & repaired,
        "review_total": active & (status == "review"),
        "numeric_total": active & F.col("value").isNotNull(),
    }
    return {n: F.count_if(c) for n, c in conditions.items()} | {"amount_total": amount(active), "mapped_amount": amount(active & mapped & ~status.isin("review", "conflict"))}


def fact_metrics(facts: DataFrame, grains: list[str]) -> DataFrame:
    """(grain, key, measures, ratios): one row for the whole run (grain run, null key) and one for each value of each grain.

    Grouping sets: the facts are read once, whatever the number of grains. Shares are of active facts,
    0 where there are none; amounts are sums of decimals. No facts give no rows, not even the run's.
    """
    keys = [F.col(g).cast("string").alias(f"__{g}") for g in grains]
    rows = facts.select("status", "code", "issue_flags", "value", "report_date", "statement_type", "period_role", *keys)
    names = [f"__{g}" for g in grains]
    made = rows.groupingSets([[], *[[n] for n in names]], *names).agg(F.grouping_id().alias("__g"), *[c.alias(n) for n, c in _measures().items()])
    # The bit of a column is 0 in its own set, and all are 1 in that of the run.
    every = (1 << len(names)) - 1
    grain, key = F.lit("run"), F.lit(None).cast("string")
    for k, (g, n) in enumerate(zip(grains, names)):
        own = F.col("__g") == every - (1 << (len(names) - 1 - k))
        grain, key = F.when(own, g).otherwise(grain), F.when(own, F.col(n)).otherwise(key)
    ratios = [safe_ratio(F.col(total), F.col("active_total")).alias(name) for name, total in RATIOS.items()]
    return made.select(grain.alias("grain"), key.alias("key"), *COUNTS, "amount_total", "mapped_amount", *ratios, safe_ratio(F.col("mapped_amount"), F.col("amount_total")).alias("amount_coverage_ratio"))


def extents(cells: DataFrame, levels: list[list[str]], names: list[str]) -> DataFrame:
    """One row of how many distinct groups there are at each level, outer levels first, and `rows_total`.

    Each level is grouped from the one below it, so the rows are read and shuffled once.
    """
    rows = cells.groupBy(*levels[-1]).agg(F.count(F.lit(1)).alias("rows_total")).withColumn(names[-1], F.lit(1).cast("long"))
    done = [names[-1]]
    for level, name in zip(reversed(levels[:-1]), reversed(names[:-1])):
        rows = rows.groupBy(*level).agg(F.sum("rows_total").alias("rows_total"), *[F.sum(d).alias(d) for d in done]).withColumn(name, F.lit(1).cast("long"))
        done.append(name)
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in [*names, "rows_total"]])


def review_reasons(facts: DataFrame) -> DataFrame:
    """(reason, n) over facts for review: each of a fact's flags counts, and a fact without any counts as `review`."""
    flags = F.when(F.size("issue_flags") > 0, F.col("issue_flags")).otherwise(F.array(F.lit("review")))
    return facts.filter("status = 'review'").select(F.explode(flags).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
