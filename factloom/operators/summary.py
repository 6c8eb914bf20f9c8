"""Summaries of a run: counts, shares, averages, orders and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import safe_ratio


def count_by(rows: DataFrame, key: str) -> DataFrame:
    """How often each value of a column occurs; null counts as empty."""
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def most_common(rows: DataFrame, group: list[str], value: str, ordinal: str) -> DataFrame:
    """Each group's most frequent value; of equally frequent ones that which comes first by `ordinal`."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("__first"))
    return counts.groupBy(*group).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("__first")).alias("o"))).alias("b")).select(*group, "b.*")


def average(text: Column) -> Column:
    """The mean of what is a number; blanks and other text are passed over."""
    return F.avg(F.trim(text.cast("string")).try_cast("double"))


def percentiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation between the two nearest ranks."""
    return rows.groupBy(*group).agg(*[F.percentile(value, F.lit(q)).alias(name) for name, q in shares.items()])


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def coverage(facts: DataFrame, by: list[str], is_mapped: Column, is_exportable: Column) -> DataFrame:
    """Facts of each kind, how many are mapped and exportable, and both shares to six places."""
    rows = facts.groupBy(*by).agg(F.count(F.lit(1)).alias("facts"), F.count_if(is_mapped).alias("mapped"), F.count_if(is_exportable).alias("exportable"))
    share = lambda c: F.round(safe_ratio(F.col(c), F.col("facts")), 6)
    return rows.withColumns({"mapped_ratio": share("mapped"), "exportable_ratio": share("exportable")})


def recall(cells: DataFrame, dimensions: list[str]) -> DataFrame:
    """Recall of each value of each dimension, in one pass: a benchmark cell is found if it matches."""
    long = cells.filter("benchmark_value IS NOT NULL").select("status", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x"))
    rows = long.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("status") == "match").alias("matches"))
    return rows.withColumn("recall", F.round(safe_ratio(F.col("matches"), F.col("cells")), 6))


def reasons(rows: DataFrame, codes: str, by: str = "|") -> DataFrame:
    """How often each reason stands in joined lists of them."""
    one = rows.select(F.explode(F.split(F.col(codes), f"[{by}]")).alias("reason"))
    return one.filter("trim(reason) <> ''").groupBy(F.trim("reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def triggered(cases: list[tuple[str, Column]]) -> Column:
    """The names of the conditions that hold, in order, joined by `;`."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in cases])), ";")


def thresholds(rows: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """rows with `failed` (names of the measures out of bounds) and `recommended` (none is); null fails."""
    checks = [(k, ~F.coalesce(F.col(k) >= v, F.lit(False))) for k, v in least.items()] + [(k, ~F.coalesce(F.col(k) <= v, F.lit(False))) for k, v in most.items()]
    return rows.withColumn("failed", triggered(checks)).withColumn("recommended", F.col("failed") == "")


def largest(rows: DataFrame, amount: str, limit: int, *ties: str) -> DataFrame:
    """The `limit` rows of the largest absolute amounts; text that is no number counts as 0."""
    size = F.coalesce(F.abs(F.col(amount).try_cast("double")), F.lit(0.0))
    return rows.withColumn("size", size).orderBy(F.desc("size"), *ties).limit(limit)


def missing(required: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are required and not present, once each; null is a key too."""
    return required.select(*key).distinct().exceptAll(present.select(*key).distinct())


def payload(facts: DataFrame, key: list[str], provider: str, fields: list[str]) -> DataFrame:
    """Each key's providers with their rows as JSON, in the order of providers, then of the fields."""
    own = facts.groupBy(*key, provider).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    whole = own.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(provider).cast("string").alias("k"), F.col("rows").alias("v")))).alias("all"))
    return whole.select(*key, F.to_json(F.map_from_entries("all")).alias("payload"))


def retained(rows: DataFrame, ended: Column, now: Column, days: int) -> DataFrame:
    """Rows without those that ended more than `days` days before `now`; what hasn't ended stays."""
    return rows.filter(ended.isNull() | (ended >= now - F.expr(f"INTERVAL {int(days)} DAYS")))


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of every metric of either side; (metric, value) each, one row a
    metric. A missing metric or value counts as 0, and deltas are rounded to six places."""
    amount = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = before.select("metric", F.col("value").alias("__b")).join(after.select("metric", F.col("value").alias("__a")), "metric", "full_outer")
    return rows.select("metric", amount("__b").alias("before"), amount("__a").alias("after"), F.round(amount("__a") - amount("__b"), 6).alias("delta"))


def share(rows: DataFrame, group: list[str], holds: Column) -> DataFrame:
    """(group, share): the part of each group's rows for which a condition holds, to six places; unknown counts as no."""
    return rows.groupBy(*group).agg(F.round(F.avg(F.coalesce(holds, F.lit(False)).cast("double")), 6).alias("share"))
