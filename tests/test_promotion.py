"""Scores of candidates, promotions and packs."""

import json

from pyspark.sql import functions as F

from factloom.operators import promotion

KIND = "n int, promotion_kind string, mapping_code string, alias string, rule_id string, safety_level string, candidate_method string, benchmark_support int, evidence_count int, average_score double, conflicting_targets int, conflicts_introduced int, aggregate_ambiguous boolean, split_ambiguous boolean, review_only boolean, children_resolved boolean, ambiguous boolean, safe_to_auto_close boolean"
NAMES = [c.split()[0] for c in KIND.split(", ")]


def test_reasons_of_scores(spark):
    alias = dict(promotion_kind="alias", mapping_code="A", alias="cash", candidate_method="alias_table", evidence_count=2)
    formula = dict(promotion_kind="formula", rule_id="r1", children_resolved=True)
    cases = [
        (alias, "safe_alias_candidate"), ({**alias, "alias": "Goods"}, "alias_conflicts_with_existing_pack"), ({**alias, "alias": "Goods", "mapping_code": "B"}, "alias_already_present"),
        ({**alias, "split_ambiguous": True, "conflicting_targets": 2}, "aggregate_or_split_ambiguous"), ({**alias, "conflicting_targets": 2, "review_only": True}, "multiple_competing_targets"), ({**alias, "review_only": True}, "review_only_alias"),
        ({**alias, "evidence_count": 1}, "alias_strength_below_threshold"), ({**alias, "evidence_count": None, "benchmark_support": 1, "candidate_method": None, "average_score": 0.75}, "safe_alias_candidate"),
        ({**alias, "mapping_code": None}, "alias_strength_below_threshold"), ({**alias, "alias": None}, "alias_strength_below_threshold"), (formula, "safe_formula_candidate"), ({**formula, "rule_id": " "}, "missing_formula_rule_id"),
        ({**formula, "rule_id": "old"}, "formula_rule_already_present"), ({**formula, "safety_level": "guess"}, "formula_not_deterministic"), ({**formula, "conflicts_introduced": 1}, "formula_conflicts_present"), ({**formula, "children_resolved": None}, "formula_children_not_resolved"),
        (dict(promotion_kind="period", safe_to_auto_close=True), "safe_period_candidate"), (dict(promotion_kind="placement", safe_to_auto_close=True, ambiguous=True), "ambiguous_closure_candidate"), (dict(promotion_kind="placement"), "not_safe_to_auto_close"), (dict(promotion_kind=None), "unsupported_promotion_kind"),
    ]
    rows = spark.createDataFrame([tuple({"n": i, **c}.get(k) for k in NAMES) for i, (c, _) in enumerate(cases)], KIND)
    bindings = spark.createDataFrame([(1, "Goods", "C"), (2, "Goods", "B")], "position int, alias string, code string")
    formulas = spark.createDataFrame([("old",), ("old",), (None,)], "rule_id string")
    got = {r.n: r for r in promotion.scored(rows, bindings, formulas).collect()}
    assert [got[i].selection_reason for i in range(len(cases))] == [why for _, why in cases]
    assert all(r.safe == r.selection_reason.startswith("safe_") == (r.selection_status == "selected") for r in got.values())
    assert promotion.scored(rows.limit(0), bindings, formulas).collect() == []


def test_order_of_candidates(spark):
    rows = [(True, 0, 1, 1.0, 1, "alias", "A", "p", "4"), (True, 2, 0, 0.0, 0, "alias", "A", "p", "3"), (False, 9, 9, 9.0, 9, "alias", "A", "p", "2"), (True, 0, 1, 1.0, 1, "alias", "A", None, "5"), (True, 0, 1, None, 1, "alias", "A", "p", "1")]
    df = spark.createDataFrame(rows, "safe boolean, target_gap_closing_potential int, benchmark_support int, amount_gain double, evidence_count int, promotion_kind string, mapping_code string, period_key string, promotion_id string")
    assert [r.promotion_id for r in df.orderBy(*promotion.shadow_order()).collect()] == ["3", "5", "4", "1", "2"]


def test_promotions_and_packs(spark):
    rule, scope = json.dumps({"rule_id": "r1", "target_code": "T", "children": ["a", {"b": 1}]}), {"mapping_code": "M", "target_scope": "x"}
    rows = [
        (1, "p1", "promote_alias", "", " cash ", "A", "Cash", None, None), (2, "p2", "promote_legacy_alias", "cash", None, "A", "Cash", None, None), (3, "p3", "promote_alias", None, None, "A", "Cash", None, None),
        (4, "p4", "promote_formula_rule", "[1]", None, None, None, rule, None), (5, "p5", "promote_formula_rule", rule, None, None, None, None, None), (6, "p6", "promote_formula_rule", '{"rule_id": "r2"}', None, None, None, rule, None),
        (7, "p7", "promote_target_rule", json.dumps(scope), None, None, None, None, None), (8, "p8", "promote_target_rule", None, None, None, None, None, json.dumps(dict(reversed(scope.items())))), (9, "p9", "promote_target_rule", "{}", None, None, None, None, "{broken"),
        (10, "p10", "reject", None, None, None, None, None, None), (11, "p11", "other", None, None, None, None, None, None), (12, "p12", None, None, None, None, None, None, None), (13, None, "promote_alias", "bank", None, "B", "Bank", None, None),
    ]
    actions = spark.createDataFrame(rows, "position int, promotion_id string, action_type string, action_value string, candidate_alias string, canonical_code string, canonical_name string, formula_payload_json string, target_scope_rule_json string")
    audit = promotion.promoted(actions)
    got = {r.position: r for r in audit.collect()}
    assert {k: r.reject_reason for k, r in got.items()} == {1: None, 2: None, 3: "missing_alias_fields", 4: None, 5: None, 6: "missing_formula_payload", 7: None, 8: None, 9: "missing_target_scope_payload", 10: "reject", 11: "unsupported_action", 13: None}
    assert got[1].action_id == "PROMACT_0001" and (got[4].pack, got[4].target_id, got[8].target_id) == ("curated_formula_pack", "r1", "M")
    assert got[13].entry == {"canonical_code": "B", "canonical_name": "Bank", "alias": "bank", "alias_type": "exact_alias", "note": "promoted:"}
    old = spark.createDataFrame([("curated_alias_pack", 1, {"canonical_code": "B", "alias": "bank"}), ("target_scope_rules", 2, {"mapping_code": "N"})], "pack string, position int, entry map<string,string>")
    packs = {(r.pack, r.key): (r.new, r.position) for r in promotion.packed(audit, old).collect()}
    assert packs == {
        ("curated_alias_pack", "A|cash"): (1, 1), ("curated_alias_pack", "B|bank"): (0, 1), ("curated_formula_pack", "r1"): (1, 4),
        ("target_scope_rules", '{"mapping_code":"M","target_scope":"x"}'): (1, 7), ("target_scope_rules", '{"mapping_code":"N"}'): (0, 2),
    }
    assert promotion.packed(audit.limit(0), old.limit(0)).collect() == [] and audit.filter(F.col("pack").isNull()).count() == 5
