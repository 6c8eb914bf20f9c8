"""Candidates for lasting rules: which are safe to promote, and what reviewers' promotions add to the packs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import label_for_matching


@dataclass(frozen=True)
class Rules:
    methods: tuple[str, ...] = ("exact_normalized_match", "alias_table")
    support: int = 1
    evidence: int = 2
    score: float = 0.75


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def scored(candidates: DataFrame, bindings: DataFrame, formulas: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """candidates with safe, selection_status and selection_reason.

    candidates: promotion_kind (alias, formula, placement, period), mapping_code, alias, rule_id,
    safety_level (null: deterministic), candidate_method, benchmark_support, evidence_count,
    average_score, conflicting_targets, conflicts_introduced (null: 0) and the flags
    aggregate_ambiguous, split_ambiguous, review_only, children_resolved, ambiguous,
    safe_to_auto_close (null: false). bindings: (position, alias, code), the last of a matching
    label counts; formulas: (rule_id). The first reason against a candidate is given.
    """
    number = lambda n: F.coalesce(F.col(n), F.lit(0))
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    label = label_for_matching(F.coalesce("alias", F.lit("")))
    bound = bindings.groupBy(label_for_matching("alias").alias("__l")).agg(F.max_by("code", "position").alias("__bound")).filter("__bound <> ''")
    known = formulas.select(F.trim("rule_id").alias("__r")).distinct()
    rows = candidates.drop("safe", "selection_status", "selection_reason").join(bound, label == F.col("__l"), "left").join(known, _text("rule_id") == F.col("__r"), "left")
    code, kind = _text("mapping_code"), _text("promotion_kind")
    strong = _text("candidate_method").isin(*rules.methods) | (number("average_score") >= rules.score)
    backed = (number("benchmark_support") >= rules.support) | (number("evidence_count") >= rules.evidence)
    alias = (
        F.when(F.col("__bound") != code, "alias_conflicts_with_existing_pack").when(F.col("__bound") == code, "alias_already_present")
        .when(flag("aggregate_ambiguous") | flag("split_ambiguous"), "aggregate_or_split_ambiguous").when(number("conflicting_targets") > 1, "multiple_competing_targets").when(flag("review_only"), "review_only_alias")
        .when(strong & backed & (_text("alias") != "") & (code != ""), "safe_alias_candidate").otherwise("alias_strength_below_threshold")
    )
    formula = (
        F.when(_text("rule_id") == "", "missing_formula_rule_id").when(F.col("__r").isNotNull(), "formula_rule_already_present").when(F.trim(F.coalesce("safety_level", F.lit("deterministic"))) != "deterministic", "formula_not_deterministic")
        .when(number("conflicts_introduced") > 0, "formula_conflicts_present").when(~flag("children_resolved"), "formula_children_not_resolved").otherwise("safe_formula_candidate")
    )
    closing = F.when(flag("ambiguous"), "ambiguous_closure_candidate").when(~flag("safe_to_auto_close"), "not_safe_to_auto_close").otherwise(F.concat(F.lit("safe_"), kind, F.lit("_candidate")))
    reason = F.when(kind == "alias", alias).when(kind == "formula", formula).when(kind.isin("placement", "period"), closing).otherwise("unsupported_promotion_kind")
    safe = reason.isin("safe_alias_candidate", "safe_formula_candidate", "safe_placement_candidate", "safe_period_candidate")
    return rows.withColumns({"selection_reason": reason, "safe": safe, "selection_status": F.when(safe, "selected").otherwise("rejected")}).drop("__l", "__bound", "__r")


def shadow_order() -> list[Column]:
    """How scored candidates are listed: safe ones first, then by what they close, support, amount and evidence."""
    most = [F.desc_nulls_last(c) for c in ("safe", "target_gap_closing_potential", "benchmark_support", "amount_gain", "evidence_count")]
    return most + [F.asc_nulls_first(c) for c in ("promotion_kind", "mapping_code", "period_key", "promotion_id")]


def _object(*names: str) -> Column:
    """The first of the columns that holds a JSON object with entries, as a map."""
    parsed = [F.from_json(F.trim(F.col(n)), "map<string,string>") for n in names]
    return F.coalesce(*[F.when(F.size(p) > 0, p) for p in parsed])


def promoted(actions: DataFrame) -> DataFrame:
    """Actions with action_id, reject_reason (null if applied), pack, target_id, message and their entry.

    actions: position (from 1), promotion_id, action_type, action_value, candidate_alias,
    canonical_code, canonical_name, formula_payload_json, target_scope_rule_json. Blank actions
    go. entry is a map: an alias's fields, or the given JSON.
    """
    rows = actions.withColumn("action_type", _text("action_type")).filter("action_type <> ''")
    kind = F.col("action_type")
    alias = F.trim(F.coalesce(F.when(F.col("action_value") != "", F.col("action_value")), F.col("candidate_alias"), F.lit("")))
    is_alias, is_formula, is_target = kind.isin("promote_alias", "promote_legacy_alias"), kind == "promote_formula_rule", kind == "promote_target_rule"
    fields = {"canonical_code": _text("canonical_code"), "canonical_name": _text("canonical_name"), "alias": alias, "alias_type": F.when(kind == "promote_legacy_alias", "legacy_alias").otherwise("exact_alias"), "note": F.concat(F.lit("promoted:"), F.coalesce("promotion_id", F.lit("")))}
    own = F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v)])
    entry = F.when(is_alias, own).when(is_formula, _object("action_value", "formula_payload_json")).when(is_target, _object("action_value", "target_scope_rule_json"))
    rows = rows.withColumn("entry", entry)
    at = lambda k: F.coalesce(F.try_element_at("entry", F.lit(k)), F.lit(""))
    why = (
        F.when(kind.isin("reject", "defer"), kind).when(~(is_alias | is_formula | is_target), "unsupported_action")
        .when(is_alias & ((at("alias") == "") | (at("canonical_code") == "") | (at("canonical_name") == "")), "missing_alias_fields")
        .when(is_formula & (at("target_code") == ""), "missing_formula_payload").when(is_target & F.col("entry").isNull(), "missing_target_scope_payload")
    )
    rows = rows.withColumns({"action_id": F.format_string("PROMACT_%04d", F.col("position")), "reject_reason": why})
    ok = F.col("reject_reason").isNull()
    by = lambda a, f, t: F.when(ok, F.when(is_alias, a).when(is_formula, f).otherwise(t))
    return rows.withColumns({"pack": by("curated_alias_pack", "curated_formula_pack", "target_scope_rules"), "message": by("alias_promoted", "formula_promoted", "target_rule_promoted"), "target_id": by(at("canonical_code"), at("rule_id"), at("mapping_code")), "entry": F.when(ok, F.col("entry"))})


def packed(audit: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack, key, entry, position): the packs with what actions add; an entry whose key is there already adds nothing.

    packs: (pack, position, entry as a map). Keys are code and alias, the formula's rule, or the
    whole target rule; entries stand in the order of their positions, new ones after old ones.
    """
    rows = packs.select("pack", F.lit(0).alias("new"), "position", "entry").unionByName(audit.filter("pack IS NOT NULL").select("pack", F.lit(1).alias("new"), "position", "entry"))
    at = lambda k: F.coalesce(F.try_element_at("entry", F.lit(k)), F.lit(""))
    whole = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("entry"))))
    key = F.when(F.col("pack") == "curated_alias_pack", F.concat_ws("|", at("canonical_code"), at("alias"))).when(F.col("pack") == "curated_formula_pack", at("rule_id")).otherwise(whole)
    # Maps have no order, so what is kept is told apart by its JSON.
    rows = rows.withColumns({"key": key, "__w": whole})
    first = rows.groupBy("pack", "key").agg(F.min_by(F.struct("entry", "new", "position"), F.struct("new", "position", "__w")).alias("b"))
    return first.select("pack", "key", "b.entry", "b.new", "b.position")
