"""Mapping labels to the codes of a chart of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import alias_join


def cascade(facts: DataFrame, subjects: DataFrame, aliases: DataFrame, label: str = "label", position: str = "position") -> DataFrame:
    """facts with code, method and confidence: an exact subject name, else an alias, else none.

    subjects: (name, code, position), the last code of a name counts; aliases: (alias, code, exact), exact
    ones before others, then the smallest code. Both are reduced to one row for each name first,
    so no fact is multiplied.
    """
    names = subjects.groupBy(F.col("name").alias(label)).agg(F.max_by("code", position).alias("__exact"))
    order = F.struct((~F.col("exact")).alias("o"), F.col("code").alias("c"))
    other = aliases.groupBy(F.col("alias").alias(label)).agg(F.min_by(F.struct("code", "exact"), order).alias("__alias"))
    rows = facts.join(names, label, "left").join(other, label, "left")
    found = F.col("__exact").isNotNull()
    by_alias = F.col("__alias").isNotNull()
    return rows.withColumns(
        {
            "code": F.coalesce("__exact", "__alias.code"),
            "method": F.when(found, "exact").when(by_alias & F.col("__alias.exact"), "exact_alias").when(by_alias, "legacy_alias").otherwise("unmapped"),
            "confidence": F.when(found, 1.0).when(by_alias & F.col("__alias.exact"), 0.95).when(by_alias, 0.9).otherwise(0.0),
        }
    ).drop("__exact", "__alias")


def fuzzy_candidates(labels: DataFrame, subjects: DataFrame, least: float = alias_join.LEAST, top: int = 3) -> DataFrame:
    """(label, code, name, score, rank): up to `top` codes for each distinct label, by the near-name join."""
    names = subjects.select("name", "code").filter("name <> ''").distinct()
    found = alias_join.similar(labels.select(F.col("label").alias("s")), names.select(F.col("name").alias("s")), least).drop("method").join(names, "name")
    best = found.groupBy("label", "code").agg(F.max_by(F.struct("name", "score"), F.struct("score", "name")).alias("b")).select("label", "code", "b.*")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "code"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top)


def unmapped_summary(facts: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """Each unmapped label: how often, how often with a number, and the sum of absolute amounts."""
    rows = facts.filter("code IS NULL")
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("occurrences"), F.count(value).alias("numeric"), F.coalesce(F.sum(F.abs(value).cast("decimal(18,2)")), F.lit(0)).cast("double").alias("amount"))
