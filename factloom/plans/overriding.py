"""Queries on reviewers' actions and what they override."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import overrides
from factloom.plans.facts import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The inputs in words of both engines: events are actions, orders facts and review items, customers of orders conflicts.
_N = "CAST(event_id AS STRING)"
_CASES = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate([*overrides.ACTIONS, "no_such_action"]))
_VALUE = f"""CASE WHEN event_type = 'view' THEN '' WHEN event_id % 12 < 2 THEN 'C' || CAST(event_id % 4 AS STRING)
  WHEN event_id % 12 = 2 THEN CASE WHEN event_id % 5 < 2 THEN 'F' || {_N} ELSE 'provider:' || CAST(event_id % 4 AS STRING) END
  WHEN event_id % 12 = 3 THEN CASE WHEN event_id % 5 < 4 THEN '2022-12-31__' || event_type ELSE '2022' END ELSE '' END"""
INPUTS = {
    "actions": ("events", {
        "position": "event_id", "review_id": f"'R' || {_N}", "action_type": f"CASE event_id % 12 {_CASES} ELSE '' END", "action_value": _VALUE,
        "fact_id": f"CASE WHEN event_id % 5 < 2 THEN 'F' || {_N} ELSE '' END", "source_cell_ref": "CASE WHEN event_id % 7 < 4 THEN 'S' || CAST(event_id % 300 AS STRING) ELSE '' END",
        "row_label_std": "CASE event_type WHEN 'click' THEN 'URGENT' WHEN 'error' THEN 'HIGH' ELSE '' END", "row_label_raw": "event_type",
        "candidate_mapping_code": "CASE WHEN event_id % 13 < 9 THEN 'C' || CAST(event_id % 3 AS STRING) ELSE '' END", "candidate_mapping_name": "event_type",
        "candidate_conflict_fact_id": f"CASE WHEN event_id % 3 = 0 AND event_id % 13 < 6 THEN 'F' || {_N} ELSE '' END",
        "candidate_period_override": "CASE WHEN event_id % 13 < 9 THEN '2021-12-31__x' ELSE '' END", "suggested_reocr_task_id": "CASE WHEN event_id % 13 < 9 THEN 'T' ELSE '' END",
        "related_conflict_ids": "'X' || CAST(event_id % 200 AS STRING) || ',X1'", "reviewer_note": "CASE WHEN event_type = 'click' THEN 'seen' ELSE '' END",
    }),
    "facts": ("orders", {
        "fact_id": "'F' || CAST(o_orderkey AS STRING)", "position": "o_orderkey", "source_cell_ref": "'S' || CAST(o_custkey AS STRING)", "row_label_std": "substr(o_orderpriority, 3)", "row_label_raw": "o_orderpriority",
        "code": "''", "name": "''", "period_key": "CAST(year(o_orderdate) AS STRING) || '__' || o_orderstatus", "report_date": "CAST(year(o_orderdate) AS STRING)", "period_role": "o_orderstatus",
        "status": "'observed'", "unplaced": "CASE WHEN o_orderstatus = 'P' THEN 'unknown_date' ELSE '' END", "conflict_id": "CASE WHEN o_orderkey % 2 = 0 THEN 'X' || CAST(o_custkey % 200 AS STRING) ELSE '' END",
        "provider": "CAST(o_orderkey % 3 AS STRING)", "comparison_status": "'equal'", "comparison_reason": "''", "conflict_decision": "''", "override_source": "''", "mapping_method": "''", "period_source": "''", "period_reason": "''", "suppression_reason": "''",
    }),
}
SUBJECTS = "(VALUES ('C0', 'cash'), ('C1', 'goods'), ('C2', 'debt')) AS subjects(code, name)"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Facts, entries of valid actions, actions with their reasons, subjects."""
    views = {name: table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]) for name, (source, columns) in INPUTS.items()}
    reviews = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").selectExpr("'R' || CAST(o_orderkey AS STRING) AS review_id")
    checked = overrides.validated(views["actions"], reviews)
    return views["facts"], overrides.entries(checked), checked, spark.sql(f"SELECT * FROM {SUBJECTS}")


_VIEWS = ", ".join(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})" for name, (source, columns) in INPUTS.items())
_KIND = " ".join(f"WHEN '{a}' THEN '{k}'" for a, (k, _, _) in overrides.ACTIONS.items())
_SCOPE = " ".join(f"WHEN '{a}' THEN '{s}'" for a, (_, s, _) in overrides.ACTIONS.items())
_MESSAGE = " ".join(f"WHEN '{a}' THEN '{m}'" for a, (_, _, m) in overrides.ACTIONS.items())
_V = "coalesce(nullif(action_value, ''), %s)"
ENTRIES = f"""{_VIEWS},
checked AS (SELECT *, CASE WHEN action_type = 'no_such_action' THEN 'unsupported_action_type'
    WHEN review_id NOT IN (SELECT 'R' || CAST(o_orderkey AS STRING) FROM orders WHERE o_orderstatus <> 'P') THEN 'review_id_not_found'
    WHEN action_type IN ('accept_mapping_alias', 'set_mapping_override') AND action_value || candidate_mapping_code = '' THEN 'mapping_code_missing'
    WHEN action_type = 'set_conflict_winner' AND action_value || candidate_conflict_fact_id = '' THEN 'conflict_winner_missing'
    WHEN action_type = 'set_period_override' AND action_value || candidate_period_override = '' THEN 'period_override_missing'
    WHEN action_type = 'request_reocr' AND action_value || suggested_reocr_task_id = '' THEN 'reocr_task_missing' END AS reject_reason FROM actions WHERE action_type <> ''),
entries AS (SELECT position, review_id, action_type, CASE action_type {_KIND} END AS kind, CASE action_type {_SCOPE} END AS target_scope, CASE action_type {_MESSAGE} END AS message, source_cell_ref AS ref, reviewer_note AS note,
  CASE WHEN event_map THEN {_V % 'candidate_mapping_code'} ELSE '' END AS code, candidate_mapping_name AS name, split_part(related_conflict_ids, ',', 1) AS conflict,
  CASE action_type WHEN 'set_conflict_winner' THEN {_V % 'candidate_conflict_fact_id'} ELSE '' END AS winner, CASE action_type WHEN 'set_period_override' THEN {_V % 'candidate_period_override'} ELSE '' END AS period,
  CASE WHEN action_type = 'set_mapping_override' THEN coalesce(nullif(candidate_conflict_fact_id, ''), fact_id) WHEN action_type = 'set_conflict_winner' THEN candidate_conflict_fact_id
    WHEN action_type IN ('suppress_false_positive', 'mark_not_financial_fact') THEN fact_id ELSE '' END AS fact, fact_id AS own, row_label_std AS label
  FROM (SELECT *, action_type IN ('accept_mapping_alias', 'set_mapping_override') AS event_map FROM checked WHERE reject_reason IS NULL))"""


@query(f"""WITH {ENTRIES} SELECT c.position, c.review_id, c.action_type, reject_reason, kind, target_scope, message,
  CASE c.action_type WHEN 'set_conflict_winner' THEN conflict WHEN 'accept_mapping_alias' THEN code WHEN 'set_mapping_override' THEN coalesce(nullif(own, ''), c.review_id) WHEN 'set_period_override' THEN coalesce(nullif(own, ''), c.review_id)
    WHEN 'suppress_false_positive' THEN coalesce(nullif(own, ''), c.review_id) WHEN 'mark_not_financial_fact' THEN coalesce(nullif(own, ''), c.review_id) ELSE CASE WHEN reject_reason IS NULL THEN c.review_id END END AS target_id,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN code <> '' THEN code || ':' || name WHEN winner <> '' THEN winner WHEN period <> '' THEN period WHEN c.action_type = 'defer' THEN 'deferred' ELSE c.action_type END END AS new_state
  FROM checked c LEFT JOIN entries e ON e.position = c.position""".replace("coalesce(nullif(own, ''), c.review_id)", "CASE WHEN reject_reason IS NULL THEN coalesce(nullif(own, ''), c.review_id) END"))
def override_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action with why it is refused, or what it writes."""
    _, found, checked, _ = _inputs(spark, sf_dir)
    return checked.select("position", "review_id", "action_type", "reject_reason").join(found.select("position", "kind", "target_scope", "message", "target_id", "new_state"), "position", "left")


_LAST = "(SELECT {key} AS k, arg_max({value}, position) AS v FROM entries WHERE kind = '{kind}' AND {key} <> ''{more} GROUP BY {key})"
_PERIODS = [_LAST.format(key=key, value="{'p': period, 'n': note}", kind="period", more="") for key in ("fact", "ref")]
_SUPPRESSED = [_LAST.format(key=key, value="{'a': action_type, 'n': note}", kind="suppression", more="") for key in ("fact", "ref")]
_KNOWN = " AND code IN ('C0', 'C1', 'C2')"
_MAPPED = [_LAST.format(key=key, value="{'c': code, 'a': action_type}", kind="mapping", more=_KNOWN + more) for key, more in (("fact", ""), ("ref", " AND fact = ''"), ("label", " AND fact = '' AND ref = '' AND action_type = 'accept_mapping_alias'"))]


@query(f"""WITH {ENTRIES}, joined AS (SELECT f.*, coalesce(m1.v, m2.v, m3.v) AS m, coalesce(p1.v, p2.v) AS p, coalesce(s1.v, s2.v) AS s FROM facts f
  LEFT JOIN {_MAPPED[0]} m1 ON m1.k = f.fact_id LEFT JOIN {_MAPPED[1]} m2 ON m2.k = f.source_cell_ref LEFT JOIN {_MAPPED[2]} m3 ON m3.k = f.row_label_std
  LEFT JOIN {_PERIODS[0]} p1 ON p1.k = f.fact_id LEFT JOIN {_PERIODS[1]} p2 ON p2.k = f.source_cell_ref
  LEFT JOIN {_SUPPRESSED[0]} s1 ON s1.k = f.fact_id LEFT JOIN {_SUPPRESSED[1]} s2 ON s2.k = f.source_cell_ref)
SELECT fact_id, coalesce(m.c, code) AS code, coalesce((SELECT s.name FROM {SUBJECTS.replace('AS subjects', 'AS s')} WHERE s.code = m.c), name) AS name,
  CASE m.a WHEN 'accept_mapping_alias' THEN 'manual_alias' WHEN 'set_mapping_override' THEN 'manual_override' ELSE '' END AS mapping_method,
  coalesce(p.p, period_key) AS period_key, CASE WHEN contains(p.p, '__') THEN split_part(p.p, '__', 1) ELSE report_date END AS report_date, CASE WHEN contains(p.p, '__') THEN split_part(p.p, '__', 2) ELSE period_role END AS period_role,
  CASE WHEN p IS NULL THEN '' ELSE coalesce(nullif(p.n, ''), 'manual_period_override') END AS period_reason, CASE WHEN s IS NULL THEN status ELSE 'suppressed' END AS status,
  CASE WHEN s IS NULL THEN '' ELSE coalesce(nullif(s.n, ''), s.a) END AS suppression_reason, CASE WHEN s IS NULL THEN unplaced ELSE coalesce(nullif(unplaced, ''), s.a) END AS unplaced,
  CASE WHEN m IS NULL AND p IS NULL AND s IS NULL THEN '' ELSE 'manual_override' END AS override_source FROM joined""")
def override_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with the codes, periods and suppressions that stand."""
    facts, found, _, subjects = _inputs(spark, sf_dir)
    held = overrides.standing(overrides.versions(found, subjects))
    out = overrides.suppressed(overrides.dated(overrides.mapped(facts, held, subjects), held), held)
    return out.select("fact_id", "code", "name", "mapping_method", "period_key", "report_date", "period_role", "period_reason", "status", "suppression_reason", "unplaced", "override_source")


@query(f"""WITH {ENTRIES}, asked AS (SELECT e.*, w.fact_id AS wf, w.provider AS wp, (SELECT arg_min(f.fact_id, f.position) FROM facts f WHERE f.conflict_id = e.conflict AND 'provider:' || f.provider = e.winner) AS pf
  FROM entries e LEFT JOIN facts w ON w.fact_id = e.winner WHERE kind = 'conflict' AND conflict IN (SELECT conflict_id FROM facts)),
last AS (SELECT conflict, arg_max({{'f': coalesce(wf, pf), 'p': coalesce(wp, replace(winner, 'provider:', '')), 'n': coalesce(nullif(note, ''), 'manual_conflict_override')}}, position) AS e FROM asked WHERE coalesce(wf, pf) IS NOT NULL GROUP BY conflict)
SELECT fact_id, f.conflict_id, CASE WHEN e IS NULL THEN status WHEN e.f = fact_id THEN 'observed' ELSE 'conflict' END AS status, CASE WHEN e IS NULL THEN comparison_status WHEN e.f = fact_id THEN 'accepted' ELSE 'conflict' END AS comparison_status,
  CASE WHEN e IS NULL THEN '' ELSE e.n END AS comparison_reason, CASE WHEN e IS NULL THEN '' ELSE 'accepted_with_rule_support' END AS conflict_decision, e.p AS accepted_provider, e.f AS accepted_fact_id, e IS NULL AS needs_review
FROM facts f LEFT JOIN last ON conflict = f.conflict_id WHERE f.conflict_id <> ''""")
def override_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of conflicts after the winners that reviewers chose, with their conflicts."""
    facts, found, _, _ = _inputs(spark, sf_dir)
    conflicts = facts.filter("conflict_id <> ''").selectExpr("conflict_id", "CAST(NULL AS STRING) AS accepted_provider", "CAST(NULL AS STRING) AS accepted_fact_id", "true AS needs_review").distinct()
    out, done = overrides.decided(facts, conflicts, found)
    return out.join(done.select("conflict_id", "accepted_provider", "accepted_fact_id", "needs_review"), "conflict_id").select("fact_id", "conflict_id", "status", "comparison_status", "comparison_reason", "conflict_decision", "accepted_provider", "accepted_fact_id", "needs_review")
