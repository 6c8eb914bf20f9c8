"""Facts derived by formulas from others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.scratch import written

#: What each kind of rule needs of its children.
KINDS = ("sum", "sum_if_present", "signed", "copy_single")


def formulas(facts: DataFrame, rules: DataFrame, scope: list[str], code: str = "code", value: str = "value") -> DataFrame:
    """One row (rule, target, scope, derived, n_children) for each rule that applies in a scope.

    facts hold one best value for each scope and code. rules: (rule, kind, target, child, sign,
    n_children), a row for each child; they are a dimension table, small by nature. sum and
    signed need every child, sum_if_present one at least, copy_single exactly one. Only signed
    uses the signs.
    """
    met = facts.filter(F.col(value).isNotNull()).join(rules, facts[code] == rules["child"])
    signed = F.when(F.col("kind") == "signed", F.col("sign")).otherwise(1) * F.col(value).cast("decimal(18,2)")
    found = met.groupBy("rule", "kind", "target", "n_children", *scope).agg(F.sum(signed).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    applies = F.when(F.col("kind").isin("sum", "signed"), F.col("__n") == F.col("n_children")).when(F.col("kind") == "copy_single", F.col("__n") == 1).otherwise(F.col("__n") >= 1)
    return found.filter(applies).select("rule", "target", *scope, F.round(F.col("__sum").cast("double"), 6).alias("derived"), F.col("__n").alias("children_met"))


def formula_conflicts(derived: DataFrame, facts: DataFrame, scope: list[str], code: str = "code", value: str = "value") -> DataFrame:
    """Derived against observed values: new, same, or prefer_observed."""
    seen = facts.select(*scope, F.col(code).alias("target"), F.col(value).alias("observed"))
    state = F.when(F.col("observed").isNull(), "new").when(F.round("observed", 6) == F.round("derived", 6), "same").otherwise("prefer_observed")
    return derived.join(seen, [*scope, "target"], "left").withColumn("state", state)


def rule_impact(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "new").alias("exportable"), F.count_if(F.col("state") == "prefer_observed").alias("conflicts"), F.sum(F.abs("derived").cast("decimal(18,2)")).cast("double").alias("amount"))


def rule_levels(rules: DataFrame) -> DataFrame:
    """(rule, level) of each rule: 0 if none of its children is another rule's target, else one more than the highest of those; null for rules of a cycle and those that wait for one.

    Rules are a small dimension table; each round settles a level, so there are as many as levels.
    """
    needs = rules.select("rule", "child").join(rules.select(F.col("target").alias("child"), F.col("rule").alias("on")).distinct(), "child").select("rule", "on").distinct()
    open_, done, level = rules.select("rule").distinct(), None, 0
    while True:
        waiting = needs.join(open_.withColumnRenamed("rule", "on"), "on").select("rule").distinct()
        ready = written(open_.join(waiting, "rule", "left_anti"), "ready-rules")
        if ready.isEmpty():
            break
        now = ready.withColumn("level", F.lit(level))
        done = now if done is None else done.unionByName(now)
        open_, level = written(open_.join(ready, "rule", "left_anti"), "open-rules"), level + 1
    left = open_.withColumn("level", F.lit(None).cast("int"))
    return left if done is None else done.unionByName(left)


def levelled_formulas(facts: DataFrame, rules: DataFrame, scope: list[str], code: str = "code", value: str = "value") -> DataFrame:
    """formulas() over several levels: (rule, target, scope, derived, children_met, level).

    What a level derives are children of the next, one value for each scope and code: an observed
    one before a derived one, and of several derived the first rule's. Rules in a cycle derive
    nothing. facts hold one best value for each scope and code.
    """
    levels = written(rule_levels(rules), "rule-levels")
    depth = levels.agg(F.max("level").alias("d")).first()["d"]
    known, out = facts.select(*scope, code, value), None
    for level in range(-1 if depth is None else depth + 1):
        own = rules.join(levels.filter(F.col("level") == level).select("rule"), "rule", "left_semi")
        now = written(formulas(known, own, scope, code, value).withColumn("level", F.lit(level)), "derived")
        out = now if out is None else out.unionByName(now)
        new = now.groupBy(*scope, F.col("target").alias(code)).agg(F.min_by("derived", "rule").alias(value))
        known = known.unionByName(new.join(facts.filter(F.col(value).isNotNull()).select(*scope, code), [*scope, code], "left_anti").select(*scope, code, value))
    return out if out is not None else formulas(known, rules.limit(0), scope, code, value).withColumn("level", F.lit(0))
