"""Queries on the repair of benchmark cells under headers that weren't understood."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import alignment
from factloom.plans.facts import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


RULES = alignment.Rules(roles={"期末": "期末数", "期初": "期初数", "上期": "上期"})
_PERIOD = "CAST(year(l_shipdate) AS STRING) || CASE WHEN l_returnflag = 'A' AND l_quantity < 25 THEN '年度__本期' ELSE '年度__上期' END"
_CODE = "'P' || CAST(o_custkey AS STRING)"
_FACT = "'P' || CAST(l_partkey * 20 + l_linenumber * 2 AS STRING)"
#: The inputs in words of both engines: orders are benchmark cells, line items facts.
INPUTS = {
    "cells": f"""SELECT o_orderkey AS cell, {_CODE} AS code, CASE o_custkey % 5 WHEN 0 THEN '营业收入' WHEN 1 THEN '现金流量' WHEN 2 THEN NULL ELSE '存货' END AS name,
      CASE o_orderpriority WHEN '1-URGENT' THEN '期末' WHEN '2-HIGH' THEN ' 金额' WHEN '3-MEDIUM' THEN '期初' WHEN '5-LOW' THEN '上期' ELSE '' END AS header,
      CASE WHEN o_orderkey % 5 = 3 THEN CAST(year(o_orderdate) AS STRING) || '年度__上期' ELSE '' END AS period, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 100000) AS DOUBLE) END AS benchmark_value,
      CAST(NULL AS DOUBLE) AS auto_value, CASE WHEN o_orderstatus = 'P' THEN 'match' ELSE 'missing_in_auto' END AS status,
      CASE o_orderkey % 7 WHEN 0 THEN 'ambiguous_period_alignment' WHEN 1 THEN 'other' WHEN 2 THEN 'period_key_not_found' ELSE 'legacy_header_unsupported' END AS reason FROM orders""",
    "facts": f"SELECT l_orderkey AS position, {_FACT} AS code, {_PERIOD} AS period, '' AS report_date, CASE l_suppkey % 4 WHEN 0 THEN 'income_statement' WHEN 1 THEN 'balance_sheet' WHEN 2 THEN 'cash_flow' ELSE '' END AS statement_type, CAST(floor(l_extendedprice / 20000) AS DOUBLE) AS value FROM lineitem",
    "headers": "SELECT DISTINCT CAST(year(o_orderdate) AS STRING) || '年度__上期' AS period FROM orders UNION ALL SELECT CAST(min(year(o_orderdate)) AS STRING) || '年度__本期' FROM orders UNION ALL SELECT CAST(max(year(o_orderdate)) AS STRING) || '-12-31__期末数' FROM orders",
    "export": "SELECT code, period, max(value) AS value FROM facts GROUP BY code, period",
    "overrides": f"SELECT o_orderkey AS position, {_CODE} AS code, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '期末' END AS header, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 100000) AS DOUBLE) END AS value, CAST(year(o_orderdate) AS STRING) || '年度__上期' AS period FROM orders WHERE o_orderdate < TIMESTAMP '1996-02-01 00:00:00'",
}
_IN_ROLE = "header IN ('期末', '期初', '上期')"
REPAIRED = f"""{', '.join(f'{n} AS ({q})' for n, q in INPUTS.items())},
hints AS (SELECT code, arg_max(statement_type, (n, -p, statement_type)) AS hint FROM (SELECT code, statement_type, count(*) AS n, min(position) AS p FROM facts WHERE statement_type <> '' GROUP BY ALL) GROUP BY code),
own AS (SELECT code, min(period) AS own FROM facts WHERE period LIKE '%年度%__本期' GROUP BY code HAVING count(DISTINCT period) = 1),
roles AS (SELECT h, count(DISTINCT period) AS n, min(period) AS sole FROM (VALUES ('期末', '期末数'), ('期初', '期初数'), ('上期', '上期'), ('金额', '本期')) AS v(h, r) JOIN headers ON split_part(period, '__', 2) = r GROUP BY h),
forced AS (SELECT cell, arg_min(o.period, position) AS forced FROM cells c JOIN overrides o ON o.code = c.code AND (o.header = '' OR o.header = trim(c.header)) AND coalesce(o.value = c.benchmark_value, true) GROUP BY cell),
j AS (SELECT c.* REPLACE (trim(header) AS header), header AS written, coalesce(nullif(hint, ''), CASE WHEN name = '营业收入' THEN 'income_statement' WHEN name = '现金流量' THEN 'cash_flow' END) IN ('income_statement', 'cash_flow') AS annual, own, coalesce(n, 0) AS n, sole, forced,
  status = 'missing_in_auto' AND reason <> 'other' AS could FROM cells c LEFT JOIN hints USING (code) LEFT JOIN own USING (code) LEFT JOIN roles ON h = trim(header) LEFT JOIN forced USING (cell)),
w AS (SELECT *, CASE WHEN forced IS NOT NULL THEN forced WHEN reason <> 'legacy_header_unsupported' THEN period WHEN {_IN_ROLE} THEN CASE WHEN n = 1 THEN sole ELSE '' END
    WHEN header = '金额' AND annual THEN coalesce(own, CASE WHEN n = 1 THEN sole END, '') ELSE '' END AS np,
  CASE WHEN forced IS NOT NULL THEN 'runtime_alignment_override' WHEN reason = 'legacy_header_unsupported' AND {_IN_ROLE} THEN 'legacy_role_repaired:' || header WHEN reason = 'legacy_header_unsupported' THEN 'legacy_amount_current_period_match' ELSE reason END AS nr,
  forced IS NULL AND (reason = 'ambiguous_period_alignment' OR (reason = 'legacy_header_unsupported' AND n > 1 AND ({_IN_ROLE} OR (header = '金额' AND annual AND own IS NULL)))) AS vague FROM j),
v AS (SELECT w.*, coalesce(could AND np <> '', false) AS moved, e.value AS a FROM w LEFT JOIN export e ON e.code = w.code AND e.period = np),
s AS (SELECT *, CASE WHEN NOT moved THEN status WHEN nr = 'ambiguous_period_alignment' THEN 'missing_in_auto' WHEN a IS NULL AND benchmark_value IS NULL THEN 'match' WHEN a IS NULL THEN 'missing_in_auto' WHEN benchmark_value IS NULL THEN 'extra_in_auto' WHEN abs(a - benchmark_value) <= 0.01 THEN 'match' ELSE 'value_diff' END AS ns FROM v),
repaired AS (SELECT cell, code, written AS header, CASE WHEN moved THEN np ELSE period END AS period, CASE WHEN moved THEN a ELSE auto_value END AS auto_value, ns AS status,
  CASE WHEN NOT moved THEN reason WHEN nr = 'ambiguous_period_alignment' THEN nr WHEN a IS NULL AND benchmark_value IS NULL THEN 'both_empty' WHEN a IS NULL OR benchmark_value IS NULL THEN nr WHEN ns = 'match' THEN 'numeric_close' ELSE 'numeric_mismatch' END AS reason,
  CASE WHEN NOT could THEN 'unchanged' WHEN moved THEN CASE WHEN ns = 'missing_in_auto' THEN 'true_missing' ELSE 'alignment_only_gap' END WHEN vague THEN 'ambiguous_alignment' ELSE 'true_missing' END AS alignment, period AS raw_period, status AS raw_status, reason AS raw_reason FROM s)"""


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem")}
    t = {}
    for name, text in INPUTS.items():
        t[name] = spark.sql(_bound(text), **{n: df for n, df in {**known, **t}.items() if f"FROM {n}" in text})
    return alignment.repair(*[t[n] for n in ("cells", "facts", "headers", "export", "overrides")], RULES)


def _bound(text: str) -> str:
    """A text with its tables as parameters of spark.sql."""
    for name in ("orders", "lineitem", "facts"):
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return text


@query(f"WITH {REPAIRED} SELECT * FROM repaired")
def alignment_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark cell, aligned again where its header allows, with the raw outcome beside it."""
    return _repaired(spark, sf_dir).select("cell", "code", "header", "period", "auto_value", "status", "reason", "alignment", "raw_period", "raw_status", "raw_reason")


@query(f"""WITH {REPAIRED}, t AS (SELECT * FROM repaired WHERE status = 'missing_in_auto' AND alignment <> 'ambiguous_alignment')
SELECT 'subject' AS dimension, code AS value, count(*) AS missing_cells FROM t GROUP BY code UNION ALL SELECT 'period', CASE WHEN period <> '' THEN period ELSE header END, count(*) FROM t GROUP BY ALL""")
def alignment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.gap_counts(_repaired(spark, sf_dir))


@query(f"""WITH {REPAIRED} SELECT count(*) FILTER (WHERE raw_status = 'missing_in_auto') AS missing_raw, count(*) FILTER (WHERE status = 'missing_in_auto' AND alignment <> 'ambiguous_alignment') AS missing_true,
  count(*) FILTER (WHERE alignment = 'alignment_only_gap') AS alignment_only, count(*) FILTER (WHERE alignment = 'ambiguous_alignment') AS ambiguous FROM repaired""")
def alignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(_repaired(spark, sf_dir))
