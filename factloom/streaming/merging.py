"""Structured Streaming forms of the feedback loop.

State is bound by watermarks or by the size of a dimension, never by the length of the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unresolved_results(results: DataFrame, open_facts: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Results of a stream that may overwrite facts: those with a value, for facts that are still open.

    A stream-static join: open facts are read anew for each micro-batch. Works on tables as well.
    """
    return results.filter(F.col(value).isNotNull()).join(open_facts.select(*key).distinct(), key, "left_semi")


def first_results(results: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first result of each key that a stream delivers; state of a key goes once the watermark has passed it."""
    return results.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windows(events: DataFrame, by: list[str], time: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each window, emitted when the watermark has passed it."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return rows.select(F.col("window.start").alias("start"), *by, "n", "total")


def expired(jobs: DataFrame, ended: str, now: Column, days: int) -> DataFrame:
    """Jobs of a stream that ended more than `days` days before now, to be removed by the sink."""
    return jobs.filter(F.col(ended) < now - F.expr(f"INTERVAL {int(days)} DAYS"))
