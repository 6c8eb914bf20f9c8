"""Queries on the dates of facts and on the kinds of their statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import period_context, semantics, statements
from factloom.plans.facts import table
from factloom.plans.labels import clean

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _doc(key: str) -> str:
    return f"concat('D', CAST({key} AS STRING), CASE WHEN {key} % 3 = 0 THEN '-2006年度' ELSE '' END)"


YEAR = "CAST(2005 + year(o_orderdate) % 3 AS STRING)"
MONTH = "CAST(11 + month(o_orderdate) % 2 AS STRING)"
#: Expressions that both engines read: orders as lines of pages, line items as facts.
LINE = {
    "doc_id": _doc("o_custkey"),
    "page_no": "CAST(o_orderkey % 7 + 1 AS INTEGER)",
    "source": "CASE o_orderstatus WHEN 'F' THEN 'page_context' WHEN 'O' THEN 'page_text' ELSE 'result_json:a' END",
    "text": f"CASE o_orderpriority WHEN '1-URGENT' THEN concat('截至', {YEAR}, '年', {MONTH}, '月28日') WHEN '2-HIGH' THEN concat({YEAR}, '年度财务报表附注') "
    f"WHEN '3-MEDIUM' THEN concat('报告日期: ', {YEAR}, '-', {MONTH}, '-28') WHEN '4-NOT SPECIFIED' THEN concat('利润表 ', {YEAR}, '年1月-', {MONTH}, '月') ELSE '资产负债表' END",
}
HEADER = "CASE WHEN l_quantity >= 45 THEN '2007年12月28日' WHEN l_quantity < 5 THEN '2006年度' WHEN l_quantity < 20 THEN '金额' ELSE '' END"
FACT = {
    "fact_id": "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey",
    "doc_id": _doc("l_partkey"),
    "page_no": "CAST(l_linenumber AS INTEGER)",
    "statement_type": "CASE l_returnflag WHEN 'A' THEN 'balance_sheet' WHEN 'N' THEN 'income_statement' ELSE 'note' END",
    "statement_name": "CASE l_returnflag WHEN 'R' THEN '财务报表附注' ELSE '' END",
    "table_key": "concat('k|h:', l_linestatus, '|r:x')",
    "header_raw": HEADER,
    "role_raw": "CASE WHEN l_tax > 0.05 THEN '上期' ELSE '' END",
    "value": "CASE WHEN l_discount >= 0.09 THEN NULL ELSE l_extendedprice END",
}
ROLE = "CASE WHEN l_linestatus = 'F' THEN '期末余额' WHEN l_discount > 0.05 THEN '本年累计' ELSE 'x' END"


def _columns(named: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in named.items())


def _found(text: str) -> str:
    """All dates of a text in the dialect of the SQL check."""
    number = lambda pattern: f"CAST(regexp_extract(r, '{pattern}', 1) AS INTEGER)"
    day = r"printf('%s-%02d-%02d', r[1:4], " + number("^....[^0-9]+([0-9]+)") + ", " + number("([0-9]+)日?$") + ")"
    span = "printf('%s年%d月-%d月', r[1:4], " + number(r"^....年\s*([0-9]+)") + ", " + number(r"([0-9]+)月$") + ")"
    patterns = [
        ("exact", r"20[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}", day), ("exact", r"20[0-9]{2}年\s*[0-9]{1,2}月\s*[0-9]{1,2}日", day),
        ("range", r"20[0-9]{2}年\s*[0-9]{1,2}月?\s*[-~至]\s*[0-9]{1,2}月", span), ("range", r"20[0-9]{2}年\s*[0-9]{1,2}月\s*[-~至]\s*[0-9]{1,2}月", span),
    ]
    lists = [f"list_transform(regexp_extract_all({text}, '{p}'), lambda r: {{'kind': '{kind}', 'norm': {norm}, 'raw': r}})" for kind, p, norm in patterns]
    lists.append(f"list_transform(list_distinct(regexp_extract_all({text}, '20[0-9]{{2}}年度')), lambda r: {{'kind': 'annual', 'norm': r, 'raw': r}})")
    made = lists[0]
    for more in lists[1:]:
        made = f"list_concat({made}, {more})"
    return made


def _score(source: str, text: str) -> str:
    titles = "|".join(w for words in period_context.TITLES.values() for w in words)
    return f"""CASE split_part({source}, ':', 1) WHEN 'header' THEN 120 WHEN 'page_context' THEN 95 WHEN 'page_text' THEN 70 WHEN 'result_json' THEN 65 WHEN 'doc_id' THEN 18 ELSE 20 END
  + CASE WHEN regexp_matches({text}, '{titles}') THEN 18 ELSE 0 END + CASE WHEN contains({text}, '截至') THEN 10 ELSE 0 END + CASE WHEN regexp_matches({text}, '财务报表|附注') THEN 18 ELSE 0 END
  - CASE WHEN contains({text}, '报告日期') THEN 40 ELSE 0 END - CASE WHEN contains({text}, '审计报告') AND NOT regexp_matches({text}, '{titles}') THEN 20 ELSE 0 END"""


def _best(name: str, rows: str, group: str, order: str) -> str:
    """(group, kind?, best): the first of each group, null if the second vetoes it; rows are one for each occurrence."""
    return f"""{name} AS (
  SELECT {group}, CASE WHEN next_norm <> norm AND weight - next_weight < 5 THEN NULL ELSE {{'norm': norm, 'raw': raw, 'kind': k, 'weight': weight, 'page': page}} END AS best FROM (
    SELECT *, row_number() OVER o AS n, lead(norm) OVER o AS next_norm, lead(weight) OVER o AS next_weight FROM ({rows}) WINDOW o AS (PARTITION BY {group} ORDER BY weight DESC, {order}, raw)) WHERE n = 1)"""


def _cascade(kinds: tuple[str, ...]) -> str:
    each = [f"CASE WHEN {level}_{kind} IS NOT NULL THEN {{'norm': {level}_{kind}.norm, 'raw': {level}_{kind}.raw, 'level': '{level}', 'reason': '{level}_{kind}_candidate'}} END" for kind in kinds for level in ("page", "statement", "doc")]
    return f"coalesce({', '.join(each)})"


def _by_kind(prefix: str) -> str:
    return ", ".join(f"any_value(best) FILTER (WHERE k = '{k}') AS {prefix}_{k}" for k in period_context.KINDS)


DATED = rf"""lines AS (SELECT {_columns(LINE)} FROM orders),
facts AS (SELECT {_columns(FACT)}, [{HEADER}, {ROLE}] AS header_path FROM lineitem),
every AS (SELECT * FROM lines UNION ALL SELECT DISTINCT doc_id, 0, 'doc_id', doc_id FROM lines),
seen AS (SELECT doc_id, page_no AS page, source = 'doc_id' AS own, {_score('source', 'text')} AS score, unnest({_found('text')}) AS c FROM every),
cands AS (SELECT doc_id, page, own, c.kind AS k, c.norm AS norm, c.raw AS raw, score + 2 * count(*) OVER (PARTITION BY doc_id, c.norm) AS weight FROM seen),
counts AS (SELECT doc_id, norm, count(*) AS times FROM cands GROUP BY doc_id, norm),
{_best('page_bests', 'SELECT * FROM cands WHERE NOT own', 'doc_id, page, k', 'page, norm')}, {_best('doc_bests', 'SELECT * FROM cands', 'doc_id, k', 'page, norm')},
pages AS (SELECT doc_id, page AS page_no, {_by_kind('page')} FROM page_bests GROUP BY doc_id, page), docs AS (SELECT doc_id, {_by_kind('doc')} FROM doc_bests GROUP BY doc_id),
grouped AS (
  SELECT *, CASE statement_type WHEN 'note' THEN 'note|附注' ELSE concat(statement_type, '|k|h:', table_key[5:5]) END AS grp,
         CASE WHEN header_path[2] = '期末余额' THEN '期末数' WHEN header_path[2] = '本年累计' THEN '本期' WHEN role_raw <> '' THEN role_raw ELSE 'unknown' END AS period_role,
         concat_ws(' ', statement_name, header_raw, header_path[1], header_path[2]) AS header FROM facts),
{_best('own_bests', "SELECT doc_id, grp, best.kind AS k, best.norm AS norm, best.raw AS raw, best.weight AS weight, best.page AS page FROM grouped JOIN page_bests b USING (doc_id) WHERE b.page = page_no AND best IS NOT NULL", 'doc_id, grp, k', 'page, norm')},
owns AS (SELECT doc_id, grp, {_by_kind('own')} FROM own_bests GROUP BY doc_id, grp),
stated AS (SELECT doc_id, grp, {', '.join(f'coalesce(own_{k}, doc_{k}) AS statement_{k}' for k in period_context.KINDS)} FROM owns LEFT JOIN docs USING (doc_id)),
heads AS (SELECT doc_id, header, {_score("'header'", 'header')} AS score, unnest({_found('header')}) AS c FROM (SELECT DISTINCT doc_id, header FROM grouped)),
headed AS (SELECT h.doc_id, header, c.kind AS k, c.norm AS norm, c.raw AS raw, score + 2 * coalesce(times, 0) AS weight, 0 AS page FROM heads h LEFT JOIN counts n ON n.doc_id = h.doc_id AND n.norm = c.norm),
{_best('head_bests', 'SELECT * FROM headed', 'doc_id, header', "CASE k WHEN 'exact' THEN 0 WHEN 'range' THEN 1 ELSE 2 END, norm")},
joined AS (SELECT g.*, pages.* EXCLUDE (doc_id, page_no), pages.doc_id IS NOT NULL AS on_page, stated.* EXCLUDE (doc_id, grp), docs.* EXCLUDE (doc_id), head_bests.best AS head, known.doc_id IS NOT NULL AS known
  FROM grouped g LEFT JOIN pages USING (doc_id, page_no) LEFT JOIN stated USING (doc_id, grp) LEFT JOIN docs USING (doc_id) LEFT JOIN head_bests USING (doc_id, header) LEFT JOIN (SELECT DISTINCT doc_id FROM lines) known USING (doc_id)),
found AS (SELECT *, coalesce(CASE WHEN head IS NOT NULL THEN {{'norm': head.norm, 'raw': head.raw, 'level': 'header', 'reason': 'header_date_candidate'}} END,
    CASE WHEN period_role IN ('期初数', '期末数') THEN {_cascade(('exact', 'range', 'annual'))}
         WHEN period_role IN ('本期', '上期', '本年累计', '上年累计') OR statement_type = 'income_statement' THEN {_cascade(('range', 'annual', 'exact'))} ELSE {_cascade(('exact', 'annual', 'range'))} END) AS f FROM joined),
dated AS (SELECT * EXCLUDE (f), coalesce(f.norm, 'unknown_date') AS report_date, coalesce(f.raw, '') AS report_date_raw, coalesce(f.level, 'inferred') AS period_level,
  coalesce(f.reason, CASE WHEN NOT known THEN 'no_statement_date_found' WHEN on_page AND coalesce(page_exact, page_range, page_annual) IS NULL THEN 'ambiguous_multiple_dates' ELSE 'no_page_date_found' END) AS period_reason FROM found)"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(*[F.expr(e).alias(n) for n, e in LINE.items()])
    facts = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in FACT.items()], F.array(F.expr(HEADER), F.expr(ROLE)).alias("header_path"))
    return period_context.dated(facts, lines)


@query(f"""WITH {DATED} SELECT fact_id, grp AS "group", report_date, report_date_raw, period_role, concat(report_date, '__', period_role) AS period_key, period_level, period_reason FROM dated""")
def fact_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("fact_id", "group", "report_date", "report_date_raw", "period_role", "period_key", "period_level", "period_reason")


@query(f"""WITH {DATED}, tables AS (
  SELECT doc_id, page_no, statement_type, count(DISTINCT coalesce(nullif(header_raw, ''), '')) FILTER (WHERE value IS NOT NULL) AS n, string_agg(DISTINCT nullif(header_raw, ''), ' ' ORDER BY nullif(header_raw, '')) AS heads FROM dated GROUP BY ALL),
marked AS (SELECT d.*, t.n = 1 AND value IS NOT NULL AND statement_type = 'income_statement' AND (report_date LIKE '%年度' OR contains(report_date, '月-')) AND period_role = 'unknown'
    AND (heads IS NULL OR regexp_matches(heads, '金额|本年累计')) AS inferred FROM dated d JOIN tables t USING (doc_id, page_no, statement_type)),
roles AS (SELECT *, CASE WHEN inferred THEN '本期' ELSE period_role END AS role FROM marked)
SELECT statement_type, role AS period_role, inferred, count(*) AS n, count(*) FILTER (WHERE value IS NOT NULL AND report_date <> 'unknown_date' AND role = 'unknown') AS blocked FROM roles GROUP BY ALL""")
def annual_period_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = period_context.annual_roles(_dated(spark, sf_dir).withColumn("column_key", F.col("header_raw")), ["doc_id", "page_no", "statement_type"])
    blocked = period_context.blocks_export(F.lit("c"), F.col("value"), F.col("report_date"), F.col("period_role"))
    return rows.groupBy("statement_type", "period_role", "inferred").agg(F.count(F.lit(1)).alias("n"), F.count_if(blocked).alias("blocked"))


RULES = statements.StatementRules(
    titles={"balance_sheet": ["tion the", "the on"], "income_statement": ["ción de", "is is"], "cash_flow": ["ung der", "und "], "changes_in_equity": ["es les"]},
    note_titles=["que la", "de les"],
    note_markers=["the the"],
    signatures={"balance_sheet": [["项目", "期初数", "期末数"]], "income_statement": [["项目", "金额"]]},
    labels={"balance_sheet": ["资产总计"], "income_statement": ["营业收入", "营业成本", "利润总额"], "cash_flow": ["经营活动产生的现金流量净额"], "changes_in_equity": ["未分配利润"]},
    numbering={"income_statement": ["一", "二"], "cash_flow": ["一", "二"]},
)
LABELS = ["营业收入", "营业成本", "利润总额", "资产总计", "一、其他", "其他", "经营活动产生的现金流量净额", "未分配利润"]
GROUP = ["doc_id", "page_no", "subtable"]
TYPED = {
    "doc_id": "l_partkey",
    "page_no": "CAST(l_linenumber AS INTEGER)",
    "subtable": "l_linestatus",
    "label": "CASE l_orderkey % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(LABELS)) + " END",
    "heading": "CASE l_returnflag WHEN 'A' THEN '期末数' WHEN 'N' THEN '期初数' ELSE '金额' END",
    "statement_type": "CASE WHEN l_tax > 0.06 THEN 'note' WHEN l_tax < 0.01 THEN 'cash_flow' ELSE 'unknown' END",
    "ordinal": FACT["fact_id"],
}


def _evidence() -> str:
    parts = [f"SELECT {', '.join(GROUP)}, '{kind}' AS type, 25.0 AS weight, {k} AS place, 'title:{kind}:{w}' AS reason FROM groups JOIN pages USING (doc_id, page_no) WHERE contains(text, '{w}')" for k, (kind, w) in enumerate((kind, w) for kind, words in RULES.titles.items() for w in words)]
    for words, weight, place, reason in ((RULES.note_titles, 35.0, 1000, "note_title"), (RULES.note_markers, 12.0, 5000, "note_detail_marker")):
        any_of = " OR ".join(f"contains(text, '{w}')" for w in words)
        parts.append(f"SELECT {', '.join(GROUP)}, 'note', {weight}, {place}, '{reason}' FROM groups JOIN pages USING (doc_id, page_no) WHERE {any_of}")
    for k, (kind, words) in enumerate((kind, words) for kind, lists in RULES.signatures.items() for words in lists):
        all_of = " AND ".join(f"contains(heads, '{w}')" for w in words)
        parts.append(f"SELECT {', '.join(GROUP)}, '{kind}', 18.0, {2000 + k}, 'header_signature:{kind}' FROM groups WHERE {all_of}")
    for k, (kind, words) in enumerate(RULES.labels.items()):
        listed = ", ".join(f"'{w}'" for w in words)
        parts.append(f"SELECT {', '.join(GROUP)}, '{kind}', least(30.0, 9.0 * count(*)), {3000 + k}, 'row_pattern:{kind}:' || count(*) FROM facts WHERE label IN ({listed}) GROUP BY ALL")
    for k, kind in enumerate(RULES.numbering):
        parts.append(f"SELECT {', '.join(GROUP)}, '{kind}', 6.0, {4000 + k}, '{kind}_numbering' FROM groups WHERE numbered")
    return " UNION ALL ".join(parts)


TYPES = f"""facts AS (SELECT {_columns(TYPED)} FROM lineitem), pages AS (SELECT doc_id, CAST(doc_id % 7 + 1 AS INTEGER) AS page_no, {clean('text')} AS text FROM documents),
groups AS (SELECT {', '.join(GROUP)}, concat('项目 ', string_agg(DISTINCT heading, ' ')) AS heads, bool_or(label LIKE '一%' OR label LIKE '二%') AS numbered FROM facts GROUP BY ALL),
evidence AS ({_evidence()}),
hints AS (SELECT {', '.join(GROUP)}, arg_min(type, (-n, first)) AS type, arg_min(n, (-n, first)) AS n FROM (SELECT {', '.join(GROUP)}, statement_type AS type, count(*) AS n, min(ordinal) AS first FROM facts WHERE statement_type <> 'unknown' GROUP BY ALL) GROUP BY ALL),
early AS (SELECT g.*, p.doc_id IS NOT NULL AND g.page_no <= 8 AS early FROM groups g LEFT JOIN pages p USING (doc_id, page_no)),
types AS (SELECT unnest([{', '.join(f"'{t}'" for t in statements.TYPES)}]) AS type, unnest(range({len(statements.TYPES)})) AS k),
sums AS (SELECT {', '.join(GROUP)}, type, sum(weight) AS weight FROM evidence GROUP BY ALL),
worths AS (
  SELECT e.doc_id, e.page_no, e.subtable, t.type, t.k, coalesce(s.weight, 0) + CASE WHEN e.early AND s.weight > 0 AND t.k < 4 THEN 2 ELSE 0 END + CASE WHEN h.type = t.type THEN least(8.0, 2.0 * h.n) ELSE 0 END AS worth
  FROM early e CROSS JOIN types t LEFT JOIN sums s ON s.doc_id = e.doc_id AND s.page_no = e.page_no AND s.subtable = e.subtable AND s.type = t.type
  LEFT JOIN hints h ON h.doc_id = e.doc_id AND h.page_no = e.page_no AND h.subtable = e.subtable),
ranked AS (SELECT *, row_number() OVER o AS n, lead(worth) OVER o AS second FROM worths WINDOW o AS (PARTITION BY doc_id, page_no, subtable ORDER BY worth DESC, k)),
told AS (SELECT doc_id, page_no, subtable, list(reason ORDER BY place) AS why FROM evidence GROUP BY ALL),
typed AS (
  SELECT r.doc_id, r.page_no, r.subtable, r.type, h.type AS hinted, CAST(worth AS DOUBLE) AS score, CAST(second AS DOUBLE) AS second, worth >= 12 AND worth - second >= 4 AS clear,
         list_concat(list_concat(coalesce(why, []), CASE WHEN e.early THEN ['early_page_bonus'] ELSE [] END), CASE WHEN h.type IS NOT NULL THEN ['existing_type_hint:' || h.type] ELSE [] END) AS said
  FROM ranked r JOIN early e USING (doc_id, page_no, subtable) LEFT JOIN told USING (doc_id, page_no, subtable) LEFT JOIN hints h USING (doc_id, page_no, subtable) WHERE r.n = 1),
answers AS (SELECT doc_id, page_no, subtable, CASE WHEN clear THEN type ELSE coalesce(hinted, 'unknown') END AS statement_type, score, second,
       CASE WHEN clear THEN 'scored_specialization' WHEN hinted IS NOT NULL THEN 'fallback_existing' ELSE 'ambiguous' END AS source,
       CASE WHEN clear THEN coalesce(nullif(array_to_string(said[1:6], ';'), ''), 'scored_specialization') WHEN hinted IS NOT NULL THEN 'kept_existing_type' ELSE 'ambiguous_scores' END AS reason FROM typed)"""


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in TYPED.items()]).withColumn("header_path", F.array(F.lit("项目"), "heading"))
    pages = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7 + 1).cast("int").alias("page_no"), "text")
    return facts, statements.classified(facts, pages, GROUP, RULES)


@query(f"WITH {TYPES} SELECT * FROM answers")
def statement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir)[1]


@query(f"""WITH {TYPES} SELECT f.statement_type AS type_before, a.statement_type, a.source AS type_source, count(*) AS n FROM facts f JOIN answers a USING (doc_id, page_no, subtable) GROUP BY ALL""")
def statement_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements.specialized(*_typed(spark, sf_dir), GROUP)
    return rows.groupBy("type_before", "statement_type", "type_source").agg(F.count(F.lit(1)).alias("n"))


TEXTS = [
    "CASE l_partkey % 7 WHEN 0 THEN '项目' WHEN 1 THEN '货币资金' WHEN 2 THEN '' WHEN 3 THEN '存货' WHEN 4 THEN '12' ELSE concat('科目', CAST(l_partkey % 5 AS STRING)) END",
    "CASE l_partkey % 5 WHEN 0 THEN '行次' ELSE CAST(l_partkey % 9 AS STRING) END",
    "CASE l_partkey % 3 WHEN 0 THEN '期末数' WHEN 1 THEN '备注' ELSE '3.5' END",
]


@query(f"""WITH cells AS (SELECT l_suppkey AS book, l_linenumber AS part, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY {FACT['fact_id']}) - 1 AS row, {TEXTS[0]} AS a, {TEXTS[1]} AS b, {TEXTS[2]} AS c FROM lineitem),
tokens AS (SELECT *, CASE WHEN a = '12' THEN '' ELSE a END AS t, a = '项目' OR b = '行次' OR c = '期末数' AS head,
  list_filter([CASE WHEN a = '12' THEN '' ELSE a END, CASE WHEN b = '行次' THEN b ELSE '' END, CASE WHEN c = '3.5' THEN '' ELSE c END], lambda x: x <> '') AS heads FROM cells),
placed AS (SELECT *, coalesce(max(CASE WHEN head THEN row END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS header_row, lag(head, 1) OVER o AS h1, lag(t, 1) OVER o AS t1, lag(head, 2) OVER o AS h2, lag(t, 2) OVER o AS t2
  FROM tokens WINDOW o AS (PARTITION BY book, part ORDER BY row)),
blocks AS (SELECT book, part, header_row, any_value(heads) FILTER (WHERE row = header_row) AS h, any_value(CASE WHEN row = 0 OR h1 THEN '' WHEN t1 <> '' THEN t1 WHEN h2 IS NOT NULL AND NOT h2 THEN t2 ELSE '' END) FILTER (WHERE row = header_row) AS title,
  coalesce(list(t ORDER BY row) FILTER (WHERE row - header_row BETWEEN 1 AND 5 AND t <> ''), []) AS r FROM placed GROUP BY ALL),
wholes AS (SELECT book, part, any_value(heads) FILTER (WHERE row = 0) AS h, coalesce(list(t ORDER BY row) FILTER (WHERE row BETWEEN 1 AND 6 AND t <> ''), []) AS r FROM placed GROUP BY ALL)
SELECT p.book, p.part, CAST(p.row AS INTEGER) AS row, a AS label, CAST(p.header_row AS INTEGER) AS header_row,
  concat('note', CASE WHEN title <> '' THEN '|t:' || title ELSE '' END, '|h:', CASE WHEN len(b.h) > 0 THEN array_to_string(b.h[1:6], ',') ELSE 'no_header' END, '|r:', CASE WHEN len(b.r) > 0 THEN array_to_string(b.r[1:3], ',') ELSE 'no_rows' END) AS row_key,
  concat('note|h:', CASE WHEN len(w.h) > 0 THEN array_to_string(w.h[1:6], ',') ELSE 'no_header' END, '|r:', CASE WHEN len(w.r) > 0 THEN array_to_string(w.r[1:3], ',') ELSE 'no_rows' END) AS table_key
FROM placed p JOIN blocks b ON b.book = p.book AND b.part = p.part AND b.header_row = p.header_row JOIN wholes w ON w.book = p.book AND w.part = p.part""")
def semantic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier and line number as the rows of a table of three columns."""
    # Rows are numbered by the table's own columns, whose shuffle the keys share, before they have texts.
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_linenumber").alias("part"), F.expr(FACT["fact_id"]).alias("fact_id"), "l_partkey")
    order = Window.partitionBy("book", "part").orderBy("fact_id")
    rows = items.withColumn("row", F.row_number().over(order) - 1).select(
        "book", "part", "row", F.array(*map(F.expr, TEXTS)).alias("texts"),
        F.lit(0).alias("label_col"), F.lit(1).alias("line_col"), F.array(F.lit(2)).alias("value_cols"), F.lit("note").alias("statement_type"),
    )
    return semantics.keyed(rows, ["book", "part"]).select("book", "part", "row", "label", "header_row", "row_key", "table_key")
