"""Queries on candidates for lasting rules and on reviewers' promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import promotion
from factloom.plans.facts import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Line items as candidates, in words of both engines.
CANDIDATES = {
    "promotion_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
    "promotion_kind": "CASE l_linenumber WHEN 1 THEN 'alias' WHEN 2 THEN 'formula' WHEN 3 THEN 'placement' WHEN 4 THEN 'period' WHEN 5 THEN 'alias' WHEN 6 THEN 'formula' ELSE 'other' END",
    "mapping_code": "CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'C' || CAST(l_suppkey % 3 AS STRING) END",
    "alias": "CASE l_suppkey % 5 WHEN 0 THEN 'cash' WHEN 1 THEN 'goods' WHEN 2 THEN NULL ELSE 'name' || CAST(l_partkey AS STRING) END",
    "rule_id": "CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'r' || CAST(l_partkey % 500 AS STRING) END",
    "safety_level": "CASE l_returnflag WHEN 'A' THEN 'deterministic' WHEN 'N' THEN NULL ELSE 'guess' END",
    "candidate_method": "CASE l_linestatus WHEN 'F' THEN 'alias_table' ELSE 'fuzzy' END",
    "benchmark_support": "CASE WHEN l_quantity > 40 THEN 1 END",
    "evidence_count": "CAST(l_quantity AS INTEGER) % 4",
    "average_score": "l_discount * 10",
    "conflicting_targets": "l_partkey % 3",
    "conflicts_introduced": "l_partkey % 2",
    "aggregate_ambiguous": "l_tax < 0.015",
    "split_ambiguous": "CASE WHEN l_tax < 0.025 THEN l_returnflag = 'A' END",
    "review_only": "l_tax > 0.075",
    "children_resolved": "l_discount > 0.035",
    "ambiguous": "l_discount < 0.025",
    "safe_to_auto_close": "CASE WHEN l_tax > 0.035 THEN true END",
}
BINDINGS = "(VALUES (1, 'cash', 'C0'), (2, 'goods', 'C2'), (3, 'goods', 'C1')) AS b(position, alias, code)"


@query(f"""WITH c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in CANDIDATES.items())} FROM lineitem),
j AS (SELECT c.*, CASE alias WHEN 'cash' THEN 'C0' WHEN 'goods' THEN 'C1' END AS bound, rule_id IN (SELECT 'r' || CAST(p_partkey AS STRING) FROM part WHERE p_size < 10) AS known FROM c),
r AS (SELECT promotion_id, promotion_kind, mapping_code, CASE promotion_kind
  WHEN 'alias' THEN CASE WHEN bound <> mapping_code THEN 'alias_conflicts_with_existing_pack' WHEN bound = mapping_code THEN 'alias_already_present' WHEN aggregate_ambiguous OR coalesce(split_ambiguous, false) THEN 'aggregate_or_split_ambiguous'
    WHEN conflicting_targets > 1 THEN 'multiple_competing_targets' WHEN review_only THEN 'review_only_alias'
    WHEN (candidate_method = 'alias_table' OR average_score >= 0.75) AND (coalesce(benchmark_support, 0) >= 1 OR evidence_count >= 2) AND coalesce(alias, '') <> '' AND mapping_code <> '' THEN 'safe_alias_candidate' ELSE 'alias_strength_below_threshold' END
  WHEN 'formula' THEN CASE WHEN rule_id = '' THEN 'missing_formula_rule_id' WHEN known THEN 'formula_rule_already_present' WHEN safety_level = 'guess' THEN 'formula_not_deterministic' WHEN conflicts_introduced > 0 THEN 'formula_conflicts_present'
    WHEN NOT children_resolved THEN 'formula_children_not_resolved' ELSE 'safe_formula_candidate' END
  WHEN 'other' THEN 'unsupported_promotion_kind' ELSE CASE WHEN ambiguous THEN 'ambiguous_closure_candidate' WHEN safe_to_auto_close IS NULL THEN 'not_safe_to_auto_close' ELSE 'safe_' || promotion_kind || '_candidate' END END AS selection_reason FROM j)
SELECT *, selection_reason LIKE 'safe%' AS safe, CASE WHEN selection_reason LIKE 'safe%' THEN 'selected' ELSE 'rejected' END AS selection_status FROM r""")
def promotion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidates may be promoted without a reviewer, and what speaks against the others."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in CANDIDATES.items()])
    formulas = table(spark, sf_dir, "part").filter("p_size < 10").selectExpr("'r' || CAST(p_partkey AS STRING) AS rule_id")
    return promotion.scored(rows, spark.sql(f"SELECT * FROM {BINDINGS}"), formulas).select("promotion_id", "promotion_kind", "mapping_code", "selection_reason", "safe", "selection_status")


_RULE = """'{"rule_id": "r' || CAST(event_id % 300 AS STRING) || '", "target_code": "' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'T' END || '"}'"""
_SCOPE = """'{"target_scope": "note_detail", "mapping_code": "M' || CAST(event_id % 40 AS STRING) || '"}'"""
#: Events as actions.
ACTIONS = {
    "position": "event_id", "promotion_id": "'p' || CAST(event_id AS STRING)",
    "action_type": "CASE event_id % 8 WHEN 0 THEN 'promote_alias' WHEN 1 THEN 'promote_legacy_alias' WHEN 2 THEN 'promote_formula_rule' WHEN 3 THEN 'promote_target_rule' WHEN 4 THEN 'reject' WHEN 5 THEN 'defer' WHEN 6 THEN 'fly' ELSE ' ' END",
    "action_value": f"CASE WHEN event_type = 'click' THEN '' WHEN event_id % 8 < 2 THEN 'name ' || CAST(user_id AS STRING) WHEN event_id % 8 = 2 THEN {_RULE} WHEN event_id % 8 = 3 THEN CASE WHEN event_type = 'error' THEN 'no json' ELSE {_SCOPE} END END",
    "candidate_alias": "CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END", "canonical_code": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'C' || CAST(event_id % 25 AS STRING) END", "canonical_name": "'cash'",
    "formula_payload_json": f"CASE WHEN event_id % 3 = 0 THEN {_RULE} ELSE '{{}}' END", "target_scope_rule_json": f"CASE WHEN event_id % 3 = 0 THEN {_SCOPE} ELSE NULL END",
}
AUDIT = f"""a AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ACTIONS.items())} FROM events WHERE event_id % 8 <> 7),
e AS (SELECT *, CASE WHEN action_type LIKE 'promote%alias' THEN coalesce(nullif(action_value, ''), candidate_alias) END AS alias,
  CASE WHEN action_type LIKE '%rule' THEN CASE WHEN left(coalesce(action_value, ''), 1) = '{{' THEN action_value WHEN action_type = 'promote_formula_rule' THEN nullif(formula_payload_json, '{{}}') ELSE target_scope_rule_json END END AS j FROM a),
r AS (SELECT *, CASE WHEN action_type IN ('reject', 'defer') THEN action_type WHEN action_type = 'fly' THEN 'unsupported_action' WHEN action_type LIKE '%alias' AND (alias = '' OR canonical_code IS NULL) THEN 'missing_alias_fields'
  WHEN action_type = 'promote_formula_rule' AND coalesce(json_extract_string(j, '$.target_code'), '') = '' THEN 'missing_formula_payload' WHEN action_type = 'promote_target_rule' AND j IS NULL THEN 'missing_target_scope_payload' END AS reject_reason FROM e),
audit AS (SELECT *, CASE WHEN reject_reason IS NULL THEN CASE WHEN alias IS NOT NULL THEN 'curated_alias_pack' WHEN action_type = 'promote_formula_rule' THEN 'curated_formula_pack' ELSE 'target_scope_rules' END END AS pack,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN alias IS NOT NULL THEN 'alias_promoted' WHEN action_type = 'promote_formula_rule' THEN 'formula_promoted' ELSE 'target_rule_promoted' END END AS message,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN alias IS NOT NULL THEN canonical_code WHEN action_type = 'promote_formula_rule' THEN json_extract_string(j, '$.rule_id') ELSE json_extract_string(j, '$.mapping_code') END END AS target_id FROM r)"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotion.promoted(table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in ACTIONS.items()]))


@query(f"WITH {AUDIT} SELECT position, promotion_id, action_type, reject_reason, pack, message, target_id FROM audit")
def promotion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every promotion with what it adds, or why it adds nothing."""
    return _audit(spark, sf_dir).select("position", "promotion_id", "action_type", "reject_reason", "pack", "message", "target_id")


@query(f"""WITH {AUDIT}, k AS (SELECT pack, position, CASE pack WHEN 'curated_alias_pack' THEN canonical_code || '|' || alias WHEN 'curated_formula_pack' THEN target_id ELSE '{{"mapping_code":"' || target_id || '","target_scope":"note_detail"}}' END AS key FROM audit WHERE pack IS NOT NULL
  UNION ALL SELECT 'curated_formula_pack', -1 - p_partkey, 'r' || CAST(p_partkey AS STRING) FROM part WHERE p_size < 10)
SELECT pack, key, min(position) AS position, min(position) >= 0 AS added FROM k GROUP BY pack, key""")
def promotion_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs after all promotions: each entry once, with the position that brought it."""
    old = table(spark, sf_dir, "part").filter("p_size < 10").select(F.lit("curated_formula_pack").alias("pack"), (-1 - F.col("p_partkey")).alias("position"), F.create_map(F.lit("rule_id"), F.concat(F.lit("r"), F.col("p_partkey").cast("string"))).alias("entry"))
    return promotion.packed(_audit(spark, sf_dir), old).select("pack", "key", "position", (F.col("new") == 1).alias("added"))
