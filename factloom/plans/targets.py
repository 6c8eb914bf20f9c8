"""Queries on scopes of facts and review items, and on boxes of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evidence, target
from factloom.plans.facts import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ID = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
FACTS = {
    "fact_id": _ID,
    "code": "CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_partkey % 7 = 0 THEN NULL ELSE 'C' || CAST(l_partkey % 50 AS STRING) END",
    "statement_type": "CASE l_linenumber WHEN 1 THEN 'balance_sheet' WHEN 2 THEN 'income_statement' WHEN 3 THEN 'note' WHEN 4 THEN 'cash_flow' WHEN 5 THEN 'note' WHEN 6 THEN NULL ELSE 'unknown' END",
    "source_kind": "CASE WHEN l_tax < 0.005 THEN 'derived_formula' ELSE 'json' END",
    "row_label_canonical": "CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_suppkey % 9 = 1 THEN ' ' ELSE '' END",
    "row_label_norm": "CASE l_suppkey % 9 WHEN 2 THEN '中国银行' WHEN 3 THEN '1-2年' WHEN 4 THEN 'Misc NOISE' ELSE '' END",
    "row_label_std": "CASE l_suppkey % 9 WHEN 5 THEN '资产总计' WHEN 6 THEN '比例' ELSE NULL END",
    "row_label_raw": "CASE l_suppkey % 9 WHEN 7 THEN 'cash' WHEN 0 THEN '货币资金' ELSE '' END",
}
PROMOTED = "(VALUES (1, 'C1', 'note_detail'), (2, 'C1', 'main_export_target'), (3, 'C2', NULL), (4, '', 'derived_target')) AS promoted(position, code, target_scope)"
RULES = target.Rules(noise=("noise",))
_BUCKET = f"regexp_matches(label, '{'|'.join(target.COMPANIES + target.AGES)}')"
_MAIN = "coalesce(statement_type, '') IN ('balance_sheet', 'income_statement', 'cash_flow', 'changes_in_equity')"
_CASES = [
    ("promoted IS NOT NULL", "promoted", "'promoted_target_rule'"), ("source_kind = 'derived_formula'", "'derived_target'", "'source_kind:derived_formula'"),
    ("code IN (SELECT 'C' || CAST(o_custkey % 200 AS STRING) FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 2 = 0)", "'main_export_target'", "'benchmark_row_membership'"),
    (f"{_MAIN} AND code <> ''", "'main_export_target'", "'main_statement:' || statement_type"), (f"regexp_matches(label, '{'|'.join(target.TOTALS)}')", "'note_aggregation'", "'note_aggregation_pattern'"),
    (f"statement_type = 'note' AND ({_BUCKET} OR regexp_matches(label, '{'|'.join(target.DETAIL_HEADERS)}'))", "'note_detail'", "'note_detail_pattern'"), ("statement_type = 'note'", "'note_detail'", "'statement_type:note'"),
    (_BUCKET, "'note_detail'", "'detail_bucket_pattern'"), ("label = '' OR contains(lower(label), 'noise')", "'non_target_noise'", "'non_target_noise_pattern'"), (_MAIN, "'main_export_target'", "'main_statement_unmapped:' || statement_type"),
]
SCOPED = f"""facts AS (SELECT {', '.join(f'{e} AS {c}' for c, e in FACTS.items())} FROM lineitem),
labels AS (SELECT f.*, trim(coalesce(nullif(row_label_canonical, ''), nullif(row_label_norm, ''), nullif(row_label_std, ''), nullif(row_label_raw, ''), '')) AS label, CASE code WHEN 'C1' THEN 'note_detail' WHEN 'C2' THEN 'main_export_target' END AS promoted FROM facts f),
scoped AS (SELECT fact_id, code, statement_type, CASE {' '.join(f'WHEN {w} THEN {s}' for w, s, _ in _CASES)} ELSE 'non_target_noise' END AS target_scope, CASE {' '.join(f'WHEN {w} THEN {r}' for w, _, r in _CASES)} ELSE 'fallback_non_target' END AS target_scope_reason FROM labels)"""


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in FACTS.items()])
    codes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_custkey % 2 = 0").selectExpr("'C' || CAST(o_custkey % 200 AS STRING) AS code")
    return target.scoped(facts, codes, spark.sql(f"SELECT * FROM {PROMOTED}"), RULES).select("fact_id", "code", "statement_type", "target_scope", "target_scope_reason")


@query(f"WITH {SCOPED} SELECT * FROM scoped")
def target_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fact is to the export, and why."""
    return _scoped(spark, sf_dir)


#: Facts of an order are related to its review item; a fact's scope is the least of the rows of its id.
_CATEGORY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'mapping_only' WHEN '2-HIGH' THEN 'header_or_structure_noise' ELSE 'conflict' END"
_STATEMENT = "CASE o_orderstatus WHEN 'F' THEN 'note' WHEN 'O' THEN 'cash_flow' ELSE NULL END"


@query(f"""WITH {SCOPED}, own AS (SELECT split_part(fact_id, '-', 1) AS o, fact_id, min(CASE WHEN target_scope = 'non_target_noise' THEN '' ELSE target_scope END) AS s FROM scoped GROUP BY ALL),
first AS (SELECT o, arg_min(s, fact_id) AS s FROM own WHERE s <> '' GROUP BY o),
r AS (SELECT 'R' || CAST(o_orderkey AS STRING) AS review_id, {_CATEGORY} AS review_category, coalesce(s, CASE {_STATEMENT} WHEN 'note' THEN 'note_detail' WHEN 'cash_flow' THEN 'main_export_target' ELSE 'non_target_noise' END) AS target_scope FROM orders LEFT JOIN first ON o = CAST(o_orderkey AS STRING))
SELECT review_id, target_scope, CASE WHEN target_scope IN ('main_export_target', 'derived_target') THEN 'main' WHEN target_scope LIKE 'note%' AND review_category <> 'conflict' THEN 'note_suppressed' ELSE 'note' END AS backlog FROM r""")
def review_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backlog of each review item, by the scope of its first fact that has one."""
    own = _scoped(spark, sf_dir).groupBy("fact_id").agg(F.min(F.when(F.col("target_scope") == "non_target_noise", "").otherwise(F.col("target_scope"))).alias("target_scope"))
    related = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{_ID} AS fact_id").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("fact_id")).alias("related_fact_ids"))
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'R' || CAST(o_orderkey AS STRING) AS review_id", f"{_STATEMENT} AS statement_type", f"{_CATEGORY} AS review_category")
    items = orders.join(related, orders.o_orderkey == related.l_orderkey, "left").drop("l_orderkey")
    return target.review_scopes(items, own, RULES).select("review_id", "target_scope", "backlog")


_POINT = """'{"x": ' || CAST(%s AS STRING) || ', "y": ' || CAST(%s AS STRING) || '}'"""
_P = "'[' || " + _POINT % ("l_quantity * 1.5", "l_extendedprice / 8") + " || ', {\"x\": 3}, ' || " + _POINT % ("-l_quantity", "l_extendedprice / 16") + " || ']'"
CELLS = {
    "doc_id": "l_partkey", "page_no": "l_linenumber", "provider": "l_returnflag", "table_id": "l_linestatus", "row_start": "l_suppkey % 3", "row_end": "l_suppkey % 3", "col_start": "l_orderkey", "col_end": "l_orderkey + 1", "position": "CAST(l_extendedprice * 100 AS BIGINT)",
    "bbox_json": f"CASE CAST(l_quantity AS INTEGER) % 5 WHEN 0 THEN '' WHEN 1 THEN '{{\"points\": ' || ({_P}) || '}}' WHEN 2 THEN 'no box' ELSE {_P} END",
}
_CELLS = f"cells AS (SELECT *, CASE WHEN contains(bbox_json, '{{\"x\"') THEN [l_quantity * 1.5, -l_quantity] END AS xs, CASE WHEN contains(bbox_json, '{{\"x\"') THEN [l_extendedprice / 8, l_extendedprice / 16] END AS ys FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in CELLS.items())} FROM lineitem))"


@query(f"""WITH {_CELLS}, r AS (SELECT DISTINCT CASE WHEN l_tax < 0.015 THEN '' ELSE doc_id || ':' || page_no || ':' || provider || ':' || table_id || ':' || row_start || '-' || row_end || ':' || col_start || '-' || col_end END AS ref, position, doc_id, page_no, provider, table_id, row_start, bbox_json, xs, ys FROM cells),
own AS (SELECT ref, max_by({{'d': doc_id, 'p': page_no, 'v': provider, 't': table_id, 'r': row_start, 'b': bbox_json, 'x': xs, 'y': ys}}, position) AS cell FROM (SELECT * FROM r WHERE ref <> '') GROUP BY ref),
u AS (SELECT doc_id, page_no, provider, table_id, row_start, min(list_min(xs)) AS a, min(list_min(ys)) AS b, max(list_max(xs)) AS c, max(list_max(ys)) AS d FROM cells GROUP BY GROUPING SETS ((doc_id, page_no, provider, table_id, row_start), (doc_id, page_no, provider, table_id))),
j AS (SELECT own.ref, cell.b <> '' AS has, [list_min(cell.x), list_min(cell.y), list_max(cell.x), list_max(cell.y)] AS cb, [u1.a, u1.b, u1.c, u1.d] AS rb, [u2.a, u2.b, u2.c, u2.d] AS tb FROM own
  JOIN u u1 ON u1.doc_id = own.cell.d AND u1.page_no = own.cell.p AND u1.provider = own.cell.v AND u1.table_id = own.cell.t AND u1.row_start = own.cell.r
  JOIN u u2 ON u2.doc_id = own.cell.d AND u2.page_no = own.cell.p AND u2.provider = own.cell.v AND u2.table_id = own.cell.t AND u2.row_start IS NULL)
SELECT ref, CASE WHEN has THEN 'bbox_only' ELSE 'no_bbox' END AS status, """ + ", ".join(f"CASE WHEN has THEN coalesce(array_to_string(list_transform({s}, lambda v: CAST(CAST(trunc(v) AS BIGINT) AS VARCHAR)), ','), '') ELSE '' END AS {n}" for s, n in (("cb", "cell_bbox"), ("rb", "row_bbox"), ("tb", "table_bbox"))) + " FROM j")
def evidence_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of the cells that review items name, of their rows and tables."""
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_tax", *[f"{e} AS {c}" for c, e in CELLS.items()])
    ref = evidence.cell_ref(*[F.col(c) for c in (*evidence.TABLE, "row_start", "row_end", "col_start", "col_end")])
    items = cells.filter("l_tax >= 0.015").select(ref.alias("ref")).distinct().withColumn("meta_json", F.to_json(F.struct(F.col("ref").alias("source_cell_ref"))))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return evidence.boxes(items, cells).select("ref", "status", text("cell_bbox"), text("row_bbox"), text("table_bbox"))


@query(f"""WITH {_CELLS}, t AS (SELECT doc_id, page_no, provider, table_id, max(CASE WHEN xs IS NULL THEN 0 ELSE 1 END) AS has FROM cells GROUP BY ALL)
SELECT page_no, provider, count(*) AS tables, CAST(sum(has) AS BIGINT) AS with_boxes, round(sum(has) / count(*)::DOUBLE, 4) AS coverage FROM t GROUP BY ALL""")
def box_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.box_coverage(table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in CELLS.items()]), ["page_no", "provider"])
