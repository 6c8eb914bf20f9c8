"""Reconciling what several providers say of one fact, and removing duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How statuses rank.
STATUS_RANK = {"observed": 5, "repaired": 4, "inferred": 3, "blank": 2, "review": 1, "conflict": 0}
MAGNITUDE_GATE, MAGNITUDE_REVIEW = 100.0, 10.0


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def best_by(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order: a partial minimum, not a sort of whole groups.

    Orders are given as columns that sort ascending; pass a negated number for a descending one.
    """
    rest = [c for c in df.columns if c not in group]
    ranked = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    return df.groupBy(*group).agg(F.min_by(F.struct(*rest), ranked).alias("__best")).select(*group, "__best.*")


def provider_pairs(facts: DataFrame, key: list[str], provider: str = "provider", value: str = "value", quality: str = "quality", tie: str = "fact_id") -> DataFrame:
    """Every pair of providers that state a value for the same key, one row each, by provider name.

    Rows with a null value or a null or empty part of the key are left out. Each provider is
    represented by its row of best quality, then of smallest id.
    """
    whole = facts.filter(F.col(value).isNotNull())
    for k in key:
        whole = whole.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    best = best_by(whole.select(*key, provider, value, quality, tie), [*key, provider], -F.col(quality), F.col(tie))
    left = best.select(*key, F.col(provider).alias("provider_a"), F.col(value).alias("value_a"))
    right = best.select(*key, F.col(provider).alias("provider_b"), F.col(value).alias("value_b"))
    pairs = left.join(right, key).filter("provider_a < provider_b")
    low, high = F.least(F.abs("value_a"), F.abs("value_b")), F.greatest(F.abs("value_a"), F.abs("value_b"))
    return pairs.withColumns({"is_equal": F.round("value_a", 8) == F.round("value_b", 8), "difference": F.round(F.abs(F.col("value_a") - F.col("value_b")), 6), "ratio": F.when(low > 0, F.round(high / low, 6))})


def conflict_groups(facts: DataFrame, key: list[str], provider: str = "provider", value: str = "value") -> DataFrame:
    """One row for each key that at least two providers state: how many, how many different values, their span."""
    stated = facts.filter(F.col(value).isNotNull())
    rows = stated.groupBy(*key).agg(
        # Providers are few, so their set is small; a second distinct count would send every row three times.
        F.size(F.collect_set(provider)).cast("long").alias("n_providers"),
        F.countDistinct(F.round(value, 8)).alias("n_values"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.min(F.when(F.col(value) != 0, F.abs(value))).alias("__small"),
        F.max(F.abs(value)).alias("__large"),
        F.count_if(F.col(value) != 0).alias("__n"),
    )
    ratio = F.when(F.col("__n") >= 2, F.round(F.col("__large") / F.col("__small"), 6))
    return rows.filter("n_providers >= 2").withColumns({"magnitude_ratio": ratio, "comparison": F.when(F.col("n_values") == 1, "equal").otherwise("conflict")}).drop("__small", "__large", "__n")


def conflict_winners(facts: DataFrame, key: list[str], rank: Column, score: Column, noisy: Column, order: list[Column], value: str = "value", provider: str = "provider") -> DataFrame:
    """For each key of several providers how they are decided between, why, and the provider and value accepted, if any.

    Each provider is represented by its first row in `order`, rows with a value before others. No
    value: unresolved. A single value: accepted by rule, as the others' are unreadable. Equal
    values: accepted. A ratio of 100 or more, then of 10 or more: review. Else candidates come by
    ascending score, then rank of their provider; if the first is clean and another one noisy it
    is accepted by rule, and all else is for review.
    """
    rows = facts.withColumns({"__score": score, "__noisy": noisy, "__rank": rank})
    best = best_by(rows, [*key, provider], F.col(value).isNull(), *order)
    number = F.col(value).isNotNull()
    one = F.struct(F.col(provider).alias("provider"), F.col(value).alias("value"), F.col("__noisy").alias("noisy"))
    groups = best.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_providers"),
        F.count(value).alias("n_numeric"),
        F.min(F.round(value, 8)).alias("__low"),
        F.max(F.round(value, 8)).alias("__high"),
        F.min(F.when(F.col(value) != 0, F.abs(value))).alias("__small"),
        F.max(F.abs(value)).alias("__large"),
        F.count_if(F.col(value) != 0).alias("__n"),
        F.count_if("__noisy").alias("__noise"),
        F.min_by(F.when(number, one), F.when(number, F.struct("__score", "__rank", provider))).alias("__first"),
    )
    ratio = F.when(F.col("__n") >= 2, F.round(F.col("__large") / F.col("__small"), 6))
    clean = ~F.col("__first.noisy") & (F.col("__noise") > 0)
    cases = [
        (F.col("n_numeric") == 0, "unresolved", "no_numeric_candidate_available"),
        (F.col("n_numeric") == 1, "accepted_with_rule_support", "single_clean_numeric_candidate"),
        (F.col("__low") == F.col("__high"), "accepted", "equal"),
        (F.col("magnitude_ratio") >= MAGNITUDE_GATE, "review_required", "magnitude_ratio_exceeds_force_threshold"),
        (F.col("magnitude_ratio") >= MAGNITUDE_REVIEW, "review_required", "magnitude_ratio_requires_review"),
        (clean, "accepted_with_rule_support", "clean_numeric_beats_noisy_candidate"),
    ]
    decision, reason = F.lit("review_required"), F.lit("multiple_numeric_candidates_need_review")
    for condition, what, why in reversed(cases):
        decision, reason = F.when(condition, what).otherwise(decision), F.when(condition, why).otherwise(reason)
    rows = groups.filter("n_providers >= 2").withColumn("magnitude_ratio", ratio).withColumns({"decision": decision, "reason": reason})
    accepted = F.col("decision").startswith("accepted")
    return rows.select(*key, "n_providers", "n_numeric", "magnitude_ratio", "decision", "reason", F.when(accepted, F.col("__first.provider")).alias("winner"), F.when(accepted, F.col("__first.value")).alias("winning_value"))


def page_comparison(pairs: DataFrame, page: list[str]) -> DataFrame:
    """Equal and conflicting pairs of each page."""
    return pairs.groupBy(*page).agg(F.count(F.lit(1)).alias("compared_pairs"), F.count_if("is_equal").alias("equal_pairs"), F.count_if(~F.col("is_equal")).alias("conflict_pairs"))


def single_provider_pages(facts: DataFrame, page: list[str], provider: str = "provider") -> DataFrame:
    return facts.groupBy(*page).agg(F.min(provider).alias("provider"), F.max(provider).alias("__last")).filter("provider = __last").drop("__last")


def dedupe_strict(facts: DataFrame, key: list[str], order: list[Column], value: str = "value") -> DataFrame:
    """facts with `dedupe`: kept, dropped (an equal value stays) or review_kept_both (values differ).

    Where all values of a group are equal, the best row by the order stays and the others go.
    """
    same = Window.partitionBy(*key)
    rounded = F.round(F.col(value), 8)
    rows = facts.withColumns({"__n": F.count(F.lit(1)).over(same), "__low": F.min(rounded).over(same), "__high": F.max(rounded).over(same), "__rank": F.row_number().over(same.orderBy(*order))})
    all_same = F.col("__low").eqNullSafe(F.col("__high"))
    state = F.when(F.col("__n") == 1, "kept").when(~all_same, "review_kept_both").when(F.col("__rank") == 1, "kept").otherwise("dropped")
    return rows.withColumn("dedupe", state).drop("__n", "__low", "__high", "__rank")


def dedupe_explicit_date(facts: DataFrame, key: list[str], date: str, order: list[Column]) -> DataFrame:
    """facts with `kept` and `reason`: among rows of one key and value, a stated date beats an unknown one.

    Groups without both kinds stay whole; in the others the unknown ones go.
    """
    same = Window.partitionBy(*key)
    known = F.col(date) != "unknown_date"
    rows = facts.withColumns({"__known": F.count_if(known).over(same), "__all": F.count(F.lit(1)).over(same)})
    mixed = (F.col("__known") > 0) & (F.col("__known") < F.col("__all"))
    gone = mixed & ~known
    return rows.withColumns({"kept": ~gone, "reason": F.when(gone, "explicit_date_preferred_over_unknown_date").otherwise("")}).drop("__known", "__all")


def duplicate_audit(deduped: DataFrame, key: list[str]) -> DataFrame:
    """Groups of more than one row, by what became of their rows."""
    return deduped.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dedupe") == "dropped").alias("dropped"), F.count_if(F.col("dedupe") == "review_kept_both").alias("in_review")).filter("n > 1")


def scenario_values(groups: DataFrame, facts: DataFrame, key: list[str], scope: list[str], value: str = "value") -> DataFrame:
    """What-if sums: for each conflict and each provider's value, the scope's total with it in place of the others'.

    A join and an aggregation over the scopes, not a rerun for each candidate.
    """
    totals = facts.groupBy(*scope).agg(F.sum(F.col(value).cast("decimal(18,2)")).alias("__total"))
    own = facts.join(groups.filter("comparison = 'conflict'").select(*key), key).groupBy(*key, "provider").agg(F.sum(F.col(value).cast("decimal(18,2)")).alias("__own"))
    every = own.groupBy(*key).agg(F.sum("__own").alias("__group"))
    rows = own.join(every, key).join(totals, scope)
    return rows.select(*key, "provider", (F.col("__total") - F.col("__group") + F.col("__own")).cast("double").alias("scope_total"))
