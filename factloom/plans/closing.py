"""Queries on gaps of a benchmark: investigation, candidates for closure, rounds of closing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import closure
from factloom.operators.scratch import written
from factloom.plans.facts import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The inputs in words of both engines: line items are facts, orders benchmark cells and review items, events issues.
_PERIOD = "CAST(year(l_shipdate) AS STRING) || '__' || l_linestatus"
_ID = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
_ROW = {"fact_id": _ID, "position": "l_orderkey", "code": "CASE WHEN l_discount < 0.025 THEN '' ELSE 'P' || CAST(2 * l_partkey AS STRING) END", "period": _PERIOD, "value": "CAST(floor(l_extendedprice / 10000) AS DOUBLE)", "label": "l_returnflag", "statement_type": "l_linestatus"}
_ORDER = {"period": "CAST(year(o_orderdate) AS STRING) || '__' || o_orderstatus", "value": "CAST(floor(o_totalprice / 10000) AS DOUBLE)"}
INPUTS = {
    "gaps": ("orders", "o_orderpriority <> '5-LOW'", {"gap": "o_orderkey", "code": "'P' || CAST(o_custkey AS STRING)", "name": "o_orderpriority", "period": _ORDER["period"], "amount": _ORDER["value"], "header": "o_orderstatus"}),
    "facts": ("lineitem", "l_tax >= 0.015", _ROW | {"scope": "CASE WHEN l_quantity < 5 THEN 'out_of_scope' ELSE 'main_export_target' END", "unplaced": "CASE WHEN l_discount > 0.075 THEN 'no_column' ELSE '' END"}),
    "raw": ("lineitem", "true", _ROW),
    "unplaced": ("lineitem", "l_tax < 0.025 AND l_discount > 0.055", _ROW),
    "derived": ("lineitem", "l_tax > 0.065", _ROW | {"code": "'P' || CAST(l_suppkey AS STRING)"}),
    "review": ("orders", "o_orderpriority = '5-LOW'", {"review_id": "'R' || CAST(o_orderkey AS STRING)", "position": "o_orderkey", **_ORDER, "label": "o_orderstatus", "statement_type": "o_orderstatus"}),
    "issues": ("events", "event_type = 'error'", {"issue_id": "'I' || CAST(event_id AS STRING)", "position": "event_id", "message": "'no source for P' || CAST(event_id AS STRING) || ' of ' || CAST(user_id AS STRING)"}),
    "accepted": ("lineitem", "l_linenumber <= 2", {"alias": "l_returnflag", "code": "'P' || CAST(2 * l_partkey + 1 AS STRING)"}),
}


def _inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, source).filter(rows).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]) for name, (source, rows, columns) in INPUTS.items()}


_VIEWS = ",\n".join(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {rows})" for name, (source, rows, columns) in INPUTS.items())
_E = "position, fact_id AS ref, s.value, s.period, label, statement_type"
_NAMED = "CASE coalesce(p, 8) " + " ".join(f"WHEN {k} THEN '%s'" for k in range(len(closure.PROBES))) + " END"
INVESTIGATED = f"""{_VIEWS},
hits AS (
  SELECT gap, CASE WHEN scope = 'out_of_scope' THEN 0 ELSE 1 END AS p, amount, {_E} FROM gaps g JOIN facts s ON s.code = g.code AND s.period = g.period WHERE scope = 'out_of_scope' OR unplaced <> ''
  UNION ALL SELECT gap, 2, amount, {_E} FROM gaps g JOIN unplaced s ON s.code = g.code AND s.period = g.period
  UNION ALL SELECT gap, 3, amount, {_E} FROM gaps g JOIN facts s ON s.code = g.code AND s.period <> g.period
  UNION ALL SELECT gap, 4, amount, {_E} FROM gaps g JOIN derived s ON s.code = g.code AND s.period = g.period
  UNION ALL SELECT gap, 5, amount, {_E} FROM gaps g JOIN raw s ON s.period = g.period AND s.value = g.amount WHERE s.code = ''
  UNION ALL SELECT gap, 6, amount, position, review_id, s.value, s.period, label, statement_type FROM gaps g JOIN review s ON s.period = g.period AND s.value = g.amount
  UNION ALL SELECT gap, 7, amount, position, issue_id, NULL, '', '', '' FROM gaps g JOIN issues s ON contains(message, g.code)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gap, p ORDER BY position, ref, value) AS k FROM hits),
evidence AS (SELECT * FROM ranked WHERE k <= 3 QUALIFY p = min(p) OVER (PARTITION BY gap)),
best AS (SELECT gap, p, string_agg(ref, ';' ORDER BY k) AS refs FROM evidence GROUP BY ALL),
investigated AS (SELECT g.gap, code, name, period, amount, header, {_NAMED % tuple(c for c, _ in closure.PROBES)} AS cause, {_NAMED % tuple(s for _, s in closure.PROBES)} AS source, coalesce(refs, '') AS refs
  FROM gaps g LEFT JOIN best b ON b.gap = g.gap)"""


def _investigated(t: dict[str, DataFrame]) -> DataFrame:
    return closure.investigate(*[t[n] for n in ("gaps", "facts", "raw", "unplaced", "derived", "review", "issues")])


@query(f"WITH {INVESTIGATED} SELECT * FROM investigated")
def gap_investigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each benchmark cell without a value has none, with up to three rows of evidence."""
    return _investigated(_inputs(spark, sf_dir)).drop("evidence")


@query(f"WITH {INVESTIGATED} SELECT gap, code, period, amount, cause, coalesce(abs(amount), 0) AS priority, cause = 'truly_no_source' AS backfill, refs FROM investigated")
def gap_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.backlog(_investigated(_inputs(spark, sf_dir)))


@query(f"""WITH {INVESTIGATED},
sums AS (SELECT gap, count(DISTINCT label) AS labels, min(label) AS label, count(*) FILTER (WHERE value = amount) AS near, min(ref) FILTER (WHERE value = amount) AS ref,
  count(DISTINCT period) FILTER (WHERE value = amount) AS periods, min(period) FILTER (WHERE value = amount) AS other FROM evidence GROUP BY gap),
c AS (SELECT i.*, s.* EXCLUDE (gap), CASE cause WHEN 'source_exists_but_unmapped' THEN 0 WHEN 'source_exists_but_unplaced' THEN 1 WHEN 'source_exists_but_period_misaligned' THEN 2 END AS w FROM investigated i JOIN sums s USING (gap)),
d AS (SELECT *, CASE w WHEN 0 THEN labels = 1 WHEN 1 THEN near = 1 ELSE periods = 1 END AS safe FROM c WHERE w IS NOT NULL),
a AS (SELECT d.*, safe AND (w <> 0 OR EXISTS (SELECT 1 FROM accepted x WHERE x.alias = d.label AND x.code = d.code)) AS safe_to_apply FROM d),
asked AS (SELECT DISTINCT a.gap, a.code, a.period, a.amount, e.ref FROM a JOIN evidence e ON e.gap = a.gap WHERE w = 0 AND safe_to_apply AND e.p = 5),
held AS (SELECT 0 AS held, * FROM (SELECT fact_id, code, period, value FROM facts) UNION ALL SELECT 1, * FROM (SELECT fact_id, code, period, value FROM raw)),
claims AS (SELECT held, h.fact_id, min(gap) AS gap FROM held h JOIN asked q ON q.ref = h.fact_id AND h.code = '' AND h.period = q.period AND h.value = q.amount GROUP BY ALL),
n AS (SELECT gap, count(*) AS n FROM claims GROUP BY gap),
z AS (SELECT a.*, n, ['alias_promotion', 'placement_rule', 'period_role_fix'][w + 1] AS fix,
  safe_to_apply AND CASE w WHEN 0 THEN n IS NOT NULL WHEN 1 THEN a.ref IN (SELECT fact_id FROM facts) ELSE true END AS applied FROM a LEFT JOIN n ON n.gap = a.gap)
SELECT gap, cause, fix, safe, safe_to_apply, applied,
  CASE WHEN safe THEN ['shadow_alias_promotion', 'shadow_placement_preference', 'shadow_period_override'][w + 1] ELSE ['review_alias_promotion', 'review_shadow_placement', 'review_shadow_period_override'][w + 1] END AS action,
  CASE WHEN safe AND NOT safe_to_apply THEN 'alias_candidate_not_safe_under_repo_rules'
    WHEN safe THEN ['single_source_backed_alias_label', 'single_unplaced_fact_matches_benchmark_amount', 'single_source_period_matches_benchmark_amount'][w + 1]
    ELSE ['multiple_alias_labels', 'multiple_matching_unplaced_facts', 'multiple_candidate_periods'][w + 1] END AS reason,
  CASE WHEN safe AND w = 0 THEN label END AS alias, CASE WHEN safe AND w = 1 THEN ref END AS target_fact, CASE WHEN safe AND w = 2 THEN other END AS target_period,
  CASE WHEN NOT safe_to_apply THEN 'suggestion_only' WHEN NOT applied THEN 'apply_failed' WHEN w = 0 THEN 'applied_to_' || n || '_facts' WHEN w = 1 THEN 'applied_export_preference' ELSE 'applied_runtime_alignment_override' END AS result
FROM z""")
def gap_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would close each gap with a source, and what came of it where that is safe."""
    t = _inputs(spark, sf_dir)
    # Claims and their sieves read what was found as well.
    found = closure.accepted(written(closure.candidates(_investigated(t)), "candidates"), t["accepted"])
    done = closure.applied(found, closure.claims(found, t["facts"], t["raw"]), t["facts"])
    return done.select("gap", "cause", "fix", "safe", "safe_to_apply", "applied", "action", "reason", "alias", "target_fact", "target_period", "result")


@query(None)
def gap_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap after the last round of closing: its state, and why it is still open.

    The rounds aren't a statement of SQL; a test follows them in plain Python.
    """
    t = _inputs(spark, sf_dir)
    return closure.close_rounds(*[t[n] for n in ("gaps", "facts", "raw", "unplaced", "derived", "review", "issues", "accepted")])
