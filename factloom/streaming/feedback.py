"""Late recognition results merged into facts that are still open, as batches and as streams.

A result names a task, a task a review, and a review its facts. Results of a fact count in the order
of their names up to the first that has a number; the fact is closed by that one, and later ones are
ignored. So what is merged depends on which results have come, not on when: a stream keeps them in a
log, once each, and the facts of any moment are those of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Statuses of facts that a late result may overwrite.
OPEN = ("review", "conflict", "blank", "inferred")
NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def _filled(text: str) -> Column:
    return F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.trim(text))


def _met(facts: DataFrame, tasks: DataFrame, reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Results with their review and facts; `open` and `counts` tell whether a result is merged into the fact."""
    number = F.when(F.col("value_num").rlike(NUMBER), F.col("value_num").cast("double"))
    rows = results.dropDuplicates(["task_id", "name"]).withColumn("number", number)
    rows = rows.join(tasks.select("task_id", "review_id").withColumn("tasked", F.lit(True)), "task_id", "left")
    rows = rows.join(reviews.select("review_id", F.explode_outer("fact_ids").alias("fact_id")).withColumn("reviewed", F.lit(True)), "review_id", "left")
    state = facts.select("fact_id", (F.coalesce("status", F.lit("")).isin(*OPEN) | F.col("value").isNull()).alias("open"))
    rows = rows.join(state, "fact_id", "left")
    first = F.min(F.when(F.col("number").isNotNull(), F.struct("name", "task_id"))).over(Window.partitionBy("fact_id"))
    return rows.withColumn("counts", F.col("open") & (first.isNull() | (F.struct("name", "task_id") <= first)))


def _said(facts: DataFrame, tasks: DataFrame, reviews: DataFrame, results: DataFrame) -> DataFrame:
    """(fact_id, __period, __raw, __number) of the open facts for which a result counts.

    Results aren't paired with the facts of their review. A fact is closed by the first result with a
    number in any of its reviews; each review tells once for each such place what its results say up to there.
    """
    number = F.when(F.col("value_num").rlike(NUMBER), F.col("value_num").cast("double"))
    rows = results.dropDuplicates(["task_id", "name"]).withColumns({"number": number, "place": F.struct("name", "task_id")})
    rows = rows.join(tasks.select("task_id", "review_id").distinct(), "task_id")
    numbered = F.when(F.col("number").isNotNull(), F.col("place"))
    closings = rows.groupBy("review_id").agg(F.min(numbered).alias("closing"), F.min_by("number", numbered).alias("number"))
    is_open = F.coalesce("status", F.lit("")).isin(*OPEN) | F.col("value").isNull()
    members = reviews.select("review_id", F.explode("fact_ids").alias("fact_id")).join(closings, "review_id").join(facts.filter(is_open).select("fact_id"), "fact_id")
    of_fact = Window.partitionBy("fact_id")
    members = members.select("review_id", "fact_id", F.min("closing").over(of_fact).alias("close"), F.min_by("number", "closing").over(of_fact).alias("number"))
    # A place where facts are closed comes after the result at it; facts that stay open (null) after all.
    asked = members.select("review_id", F.col("close").alias("place")).distinct().withColumn("asks", F.lit(True))
    line = Window.partitionBy("review_id").orderBy(F.asc_nulls_last("place"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.select("review_id", "place", *[F.when(_filled(c).isNotNull(), F.struct("place", _filled(c).alias("text"))).alias(c) for c in ("period_key", "value_raw")]).withColumn("asks", F.lit(False))
    told = told.unionByName(asked, allowMissingColumns=True)
    last = lambda c: F.last(c, ignorenulls=True).over(line).alias(c)
    told = told.select("review_id", "place", "asks", last("period_key"), last("value_raw"), F.count_if(~F.col("asks")).over(line).alias("n")).filter("asks AND n > 0")
    told = told.select(F.col("review_id").alias("__review"), F.col("place").alias("__close"), "period_key", "value_raw")
    # Places are compared null-safely, as names may be null.
    met = members.join(told, (F.col("review_id") == F.col("__review")) & F.col("close").eqNullSafe(F.col("__close")))
    latest = lambda c: F.max_by(F.col(f"{c}.text"), F.col(f"{c}.place"))
    return met.groupBy("fact_id").agg(latest("period_key").alias("__period"), latest("value_raw").alias("__raw"), F.first("number").alias("__number"))


def merged(facts: DataFrame, tasks: DataFrame, reviews: DataFrame, results: DataFrame) -> DataFrame:
    """facts with what their results say: value, raw, period_key, status, `reocr` (whether any was merged).

    results: (task_id, name, period_key, value_raw, value_num as text), once for each task and name.
    tasks: (task_id, review_id); reviews: (review_id, fact_ids). A fact with a number and a settled
    status stays as it is. Of the merged results the last that names a period or a raw text
    counts; the number is that of the closing one, which makes an open status observed.
    """
    said = _said(facts.select("fact_id", "status", "value"), tasks, reviews, results)
    rows = facts.join(said.withColumn("__any", F.lit(True)), "fact_id", "left")
    closes = F.col("__number").isNotNull() & F.col("status").isin(*OPEN)
    made = {"value": F.coalesce("__number", "value"), "raw": F.coalesce("__raw", "raw"), "period_key": F.coalesce("__period", "period_key"), "status": F.when(closes, "observed").otherwise(F.col("status")), "reocr": F.coalesce("__any", F.lit(False))}
    return rows.withColumns(made).drop("__period", "__raw", "__number", "__any")


def audit(facts: DataFrame, tasks: DataFrame, reviews: DataFrame, results: DataFrame) -> DataFrame:
    """(task_id, name, fact_id, status, reason): what became of each result for each of its facts."""
    met = _met(facts.select("fact_id", "status", "value"), tasks, reviews, results)
    reason = (
        F.when(F.col("tasked").isNull(), "task_not_found")
        .when(F.col("reviewed").isNull(), "review_not_found")
        .when(F.col("counts"), "merged_into_unresolved_fact")
        .when(F.col("open").isNotNull(), "strong_resolved_fact_exists")
    )
    rows = met.withColumn("reason", reason).filter("reason IS NOT NULL")
    return rows.select("task_id", "name", "fact_id", F.when(F.col("counts"), "merged").otherwise("ignored").alias("status"), "reason")


def log_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of results to the log: a folder for each micro-batch, overwritten if it is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["task_id", "name"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged(spark: SparkSession, path: str) -> DataFrame:
    """The results of a log, each task and name once: what came first counts."""
    rows = spark.read.parquet(path)
    rest = F.struct(*[c for c in rows.columns if c not in ("task_id", "name")])
    first = rows.groupBy("task_id", "name").agg(F.min_by(rest, "batch").alias("r"))
    return first.select("task_id", "name", "r.*").drop("batch")
