"""Which facts an export is about, and to which backlog a review item belongs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import SPACE

#: Main statements, and patterns of labels by what they tell.
MAIN = ("balance_sheet", "income_statement", "cash_flow", "changes_in_equity")
COMPANIES = ("公司", "银行", "分行", "有限公司")
AGES = ("1年以内", "1-2年", "2-3年", "3年以上")
DETAIL_HEADERS = ("单位名称", "比例", "账龄", "项目")
TOTALS = ("合计", "总计", "小计")


@dataclass(frozen=True)
class Rules:
    """Statement types by name, and patterns that are looked for anywhere in a label, in any case."""

    main: tuple[str, ...] = MAIN
    notes: tuple[str, ...] = ("note",)
    companies: tuple[str, ...] = COMPANIES
    ages: tuple[str, ...] = AGES
    details: tuple[str, ...] = DETAIL_HEADERS
    totals: tuple[str, ...] = TOTALS
    noise: tuple[str, ...] = ()


def any_match(label: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found; blank patterns aren't any."""
    told = [p.strip() for p in patterns if p.strip()]
    return label.rlike("(?iu)" + "|".join(f"(?:{p})" for p in told)) if told else F.lit(False)


def scoped(facts: DataFrame, benchmark: DataFrame, promoted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """facts with target_scope and target_scope_reason, replaced if there already.

    facts: code, statement_type, source_kind and labels, of which the first that isn't empty
    counts, in this order: row_label_canonical, row_label_norm, row_label_std, row_label_raw.
    benchmark: (code) of any number of rows. promoted: (position, code, target_scope); the first
    rule of a code decides, before all else. Null texts are empty; an empty code is none.
    """
    rows = facts.drop("target_scope", "target_scope_reason")
    wanted = benchmark.select(F.col("code").alias("__b")).filter("__b <> ''").distinct()
    first = promoted.filter("code <> ''").groupBy(F.col("code").alias("__p")).agg(F.min_by(F.coalesce("target_scope", F.lit("main_export_target")), "position").alias("__scope"))
    # Few codes hold most facts, so facts stay where they are and the distinct codes, those of a chart of accounts, go to them.
    rows = rows.join(F.broadcast(wanted), F.col("code") == F.col("__b"), "left").join(F.broadcast(first), F.col("code") == F.col("__p"), "left")
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    raw = F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in ("row_label_canonical", "row_label_norm", "row_label_std", "row_label_raw")], F.lit(""))
    rows = rows.withColumn("__label", F.regexp_replace(raw, f"^{SPACE}+|{SPACE}+$", ""))
    label, kind, code = F.col("__label"), text("statement_type"), text("code")
    main, note = kind.isin(*rules.main), kind.isin(*rules.notes)
    bucket = any_match(label, rules.companies + rules.ages)
    cases = [
        (F.col("__scope").isNotNull(), F.col("__scope"), F.lit("promoted_target_rule")),
        (text("source_kind") == "derived_formula", "derived_target", "source_kind:derived_formula"),
        (F.col("__b").isNotNull(), "main_export_target", "benchmark_row_membership"),
        (main & (code != ""), "main_export_target", F.concat(F.lit("main_statement:"), kind)),
        (any_match(label, rules.totals), "note_aggregation", "note_aggregation_pattern"),
        (note & (bucket | any_match(label, rules.details)), "note_detail", "note_detail_pattern"),
        (note, "note_detail", "statement_type:note"),
        (bucket, "note_detail", "detail_bucket_pattern"),
        ((label == "") | any_match(label, rules.noise), "non_target_noise", "non_target_noise_pattern"),
        (main, "main_export_target", F.concat(F.lit("main_statement_unmapped:"), kind)),
    ]
    scope, reason = F.lit("non_target_noise"), F.lit("fallback_non_target")
    for when, s, r in reversed(cases):
        scope, reason = F.when(when, s).otherwise(scope), F.when(when, r).otherwise(reason)
    return rows.withColumns({"target_scope": scope, "target_scope_reason": reason}).drop("__b", "__p", "__scope", "__label")


def review_scopes(reviews: DataFrame, facts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """reviews with target_scope and backlog (main, note, or note_suppressed: a note that only concerns mapping or noise).

    The scope is that of the first related fact that has one, else it follows the statement.
    reviews: (review_id unique, related_fact_ids, statement_type, review_category); facts:
    (fact_id unique, target_scope).
    """
    own = facts.filter("target_scope <> ''").select("fact_id", F.col("target_scope").alias("__s"))
    related = reviews.select("review_id", F.posexplode("related_fact_ids").alias("__at", "fact_id")).join(own, "fact_id")
    first = related.groupBy("review_id").agg(F.min_by("__s", "__at").alias("__s"))
    kind = F.coalesce("statement_type", F.lit(""))
    rows = reviews.drop("target_scope", "backlog").join(first, "review_id", "left")
    rows = rows.withColumn("target_scope", F.coalesce("__s", F.when(kind.isin(*rules.notes), "note_detail").when(kind.isin(*rules.main), "main_export_target").otherwise("non_target_noise"))).drop("__s")
    scope = F.col("target_scope")
    quiet = scope.isin("note_detail", "note_aggregation") & F.coalesce("review_category", F.lit("")).isin("mapping_only", "header_or_structure_noise")
    return rows.withColumn("backlog", F.when(scope.isin("main_export_target", "derived_target"), "main").when(quiet, "note_suppressed").otherwise("note"))
