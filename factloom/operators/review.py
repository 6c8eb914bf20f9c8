"""The review queue: reasons, priorities, backlogs, re-recognition tasks and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grains of a task from fine to coarse.
GRAIN = ("cell", "row", "table", "page")


def reason_set(events: DataFrame, fact: list[str], reason: str, weights: dict[str, float]) -> DataFrame:
    """Distinct reasons of each fact, sorted and joined, and its priority: the sum of their weights.

    A reason weighs what its full name says, else what its part before the colon says, else 1.
    """
    full, lead = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, w in weights.items():
        full = F.when(F.col(reason) == name, float(w)).otherwise(full)
        lead = F.when(F.substring_index(reason, ":", 1) == name, float(w)).otherwise(lead)
    rows = events.select(*fact, reason).distinct().withColumn("__w", F.coalesce(full, lead, F.lit(1.0)).cast("decimal(18,4)"))
    return rows.groupBy(*fact).agg(F.array_join(F.array_sort(F.collect_set(reason)), "|").alias("reasons"), F.sum("__w").cast("double").alias("priority"), F.count(F.lit(1)).alias("n_reasons"))


def bucket(priority: Column, high: float = 5.0, medium: float = 3.0) -> Column:
    return F.when(priority >= high, "high").when(priority >= medium, "medium").otherwise("low")


def finest_tasks(tasks: DataFrame, cluster: list[str], grain: str, priority: str, task: str) -> DataFrame:
    """One task for each cluster, of the finest grain and then the highest priority, with how many it stands for."""
    place = F.lit(len(GRAIN))
    for k, name in enumerate(GRAIN):
        place = F.when(F.col(grain) == name, k).otherwise(place)
    order = F.struct(place.alias("g"), (-F.col(priority)).alias("p"), F.col(task).alias("t"))
    return tasks.groupBy(*cluster).agg(F.min_by(F.struct(task, grain, priority), order).alias("b"), F.count(F.lit(1)).alias("merged_task_count")).select(*cluster, "b.*", "merged_task_count")


def without_redundant_pages(tasks: DataFrame, page: list[str], grain: str) -> DataFrame:
    """Page tasks go where the page has a finer one."""
    finer = tasks.filter(F.col(grain) != "page").select(*page).distinct().withColumn("__finer", F.lit(True))
    return tasks.join(finer, page, "left").filter((F.col(grain) != "page") | F.col("__finer").isNull()).drop("__finer")


def secondary_score(pages: DataFrame) -> DataFrame:
    """How much a page would gain from a second recognition, and whether it should have one.

    pages hold shares and flags of each page: suspicious, failed, review_share, unknown_date_share,
    unknown_type, no_pairs, no_mapped, fallback, n_providers.
    """
    points = [(F.col("suspicious"), 0.25), (F.col("failed"), 0.3), (F.col("review_share") >= 0.15, 0.2), (F.col("unknown_date_share") >= 0.2, 0.2), (F.col("unknown_type"), 0.15), (F.col("no_pairs"), 0.25), (F.col("no_mapped"), 0.2), (F.col("fallback"), 0.2)]
    score = sum((F.when(c, F.lit(w).cast("decimal(6,2)")).otherwise(F.lit(0).cast("decimal(6,2)")) for c, w in points), F.lit(0).cast("decimal(6,2)"))
    rows = pages.withColumn("score", score.cast("double"))
    return rows.withColumn("recommended", (F.col("score") >= 0.35) & (F.col("n_providers") < 2))


def top_labels(facts: DataFrame, label: str, limit: int = 20) -> DataFrame:
    """The most frequent labels; blank ones count among the first `limit` and are then left out."""
    return facts.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(limit).filter(F.col(label) != "")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Every key of either side: new, resolved or unchanged."""
    rows = before.select(key, F.lit(True).alias("__b")).join(after.select(key, F.lit(True).alias("__a")), key, "full_outer")
    return rows.select(key, F.when(F.col("__b").isNull(), "new").when(F.col("__a").isNull(), "resolved").otherwise("unchanged").alias("change"))


def facets(rows: DataFrame, names: list[str]) -> DataFrame:
    """Distinct values of each column with their counts, in one pass over the rows."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names])).alias("x")).select("x.*")
    return long.filter("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, key: list[str], *newest: Column) -> DataFrame:
    """Upsert semantics: of each key the row that is newest by the columns, all descending numbers."""
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(newest)])
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*key, "b.*")


def with_overrides(facts: DataFrame, overrides: DataFrame, keys: list[str], code: str) -> DataFrame:
    """facts with the code of the first key, in their order, for which an override stands.

    overrides: (kind, key, to), unique by kind and key; joins by each kind in turn, so a fact
    costs one equality each.
    """
    out = facts
    for k, name in enumerate(keys):
        own = overrides.filter(F.col("kind") == name).select(F.col("key").alias(f"__k{k}"), F.col("to").alias(f"__t{k}"))
        out = out.join(own, out[name].cast("string") == own[f"__k{k}"], "left").drop(f"__k{k}")
    chosen = F.coalesce(*[F.col(f"__t{k}") for k in range(len(keys))], F.col(code))
    method = F.lit("none")
    for k in reversed(range(len(keys))):
        method = F.when(F.col(f"__t{k}").isNotNull(), f"override_{keys[k]}").otherwise(method)
    return out.withColumns({code: chosen, "override": method}).drop(*[f"__t{k}" for k in range(len(keys))])
