"""Dates from contexts and kinds of statements, on pages made by hand and against plain versions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from factloom.operators import period_context as pc
from factloom.operators import statements as st

FACTS = "doc_id string, page_no int, statement_type string, statement_name string, table_key string, header_raw string, header_path array<string>, role_raw string, fact_id int"
LINES = "doc_id string, page_no int, source string, text string"


def dated(spark, facts, lines):
    return {r.fact_id: r for r in pc.dated(spark.createDataFrame(facts, FACTS), spark.createDataFrame(lines, LINES)).collect()}


def test_dates_come_from_headers_pages_statements_and_documents(spark):
    doc = "demo-2022年"
    facts = [
        (doc, 1, "balance_sheet", "资产负债表", "", "截至2022年12月31日 / 期末数", ["截至2022年12月31日", "期末数"], "期末数", 1),
        (doc, 2, "note", "2022年度财务报表附注", "", "本期发生额", ["本期发生额"], "本期", 2),
        (doc, 3, "note", "财务报表附注", "", "期末数", ["期末数"], "期末数", 3),
        (doc, 4, "note", "财务报表附注", "", "x", ["x"], None, 4),
        ("empty", 1, "note", "", "k|h:a|r:b", "", [], "", 5),
        ("two", 1, "note", "", "", "", ["期末数"], "", 6),
        ("two", 2, "cash_flow", "", "", "", [], "", 7),
    ]
    lines = [(doc, 1, "page_context", t) for t in ("资产负债表", "2022年12月31日")] + [(doc, 1, "page_text", "资产负债表 2022年12月31日")]
    lines += [(doc, 2, "page_context", "2022年度财务报表附注"), (doc, 2, "page_text", "2022年度财务报表附注"), (doc, 3, "page_text", "财务报表附注")]
    lines += [("two", 1, "page_text", "2021-01-05"), ("two", 1, "page_text", "2020-01-05"), ("two", 2, "result_json:p", "2020年1-3月"), ("two", 2, "page_text", "x")]
    got = dated(spark, facts, lines)
    assert (got[1].period_key, got[1].period_level) == ("2022-12-31__期末数", "header")
    assert (got[2].period_key, got[2].period_level) == ("2022年度__本期", "header")
    # The page has no date; the statement's other page has one of another kind, so the document's day counts.
    assert (got[3].report_date, got[3].period_level, got[3].period_reason) == ("2022-12-31", "statement", "statement_exact_candidate")
    assert got[4].period_role == "unknown" and got[4].report_date == "2022-12-31"
    assert (got[5].report_date, got[5].period_reason, got[5].group) == ("unknown_date", "no_statement_date_found", "note|k|h:a")
    # Two days contest each other on the page and in the document; no page of the statement has a best one.
    assert (got[6].report_date, got[6].period_reason) == ("2020年1月-3月", "doc_range_candidate")
    assert (got[7].report_date, got[7].period_reason) == ("2020年1月-3月", "page_range_candidate")


def plain_best(rows, margin=5):
    """rows: (weight, page, norm), one for each occurrence."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    if len(rows) > 1 and rows[0][2] != rows[1][2] and rows[0][0] - rows[1][0] < margin:
        return None
    return rows[0] if rows else None


def test_cascade_is_that_of_a_plain_version(spark):
    draw = random.Random(4)
    lines, facts = [], []
    for doc in range(30):
        for page in range(4):
            for _ in range(draw.randrange(5)):
                day = f"20{draw.choice([10, 11])}年{draw.choice([1, 2])}月5日"
                lines.append((f"d{doc}", page, draw.choice(["page_text", "page_context"]), draw.choice(["截至", "", "报告日期 ", "附注"]) + draw.choice([day, day, "2011年度", "x"])))
            for k in range(draw.randrange(1, 3)):
                facts.append((f"d{doc}", page, draw.choice(["note", "balance_sheet"]), "", "", "", [], draw.choice(["期末数", "本期"]), len(facts)))
    weights = {"page_text": 70, "page_context": 95}
    rows = []
    for doc, page, source, text in lines:
        kind = "exact" if "日" in text[-1:] else "annual" if text.endswith("年度") else None
        if kind:
            y, norm = text[text.index("20") :], None
            norm = y if kind == "annual" else f"{y[:4]}-{int(y[5 : y.index('月')]):02d}-05"
            score = weights[source] + 10 * ("截至" in text) - 40 * ("报告日期" in text) + 36 * ("附注" in text)
            rows.append((doc, page, kind, norm, score))
    times = Counter((r[0], r[3]) for r in rows)
    rows = [(doc, page, kind, (score + 2 * times[doc, norm], page, norm)) for doc, page, kind, norm, score in rows]
    pages = {(d, p, k): plain_best([c for dd, pp, kk, c in rows if (dd, pp, kk) == (d, p, k)]) for d, p, k, _ in rows}
    docs = {(d, k): plain_best([c for dd, _, kk, c in rows if (dd, kk) == (d, k)]) for d, _, k, _ in rows}
    want = {}
    for f in facts:
        doc, page, kind_of, *_, role, own = f
        group = [g for g in facts if (g[0], g[2]) == (doc, kind_of)]
        found = None
        bests = {k: [pages.get((doc, g[1], k)) for g in group if pages.get((doc, g[1], k))] for k in ("exact", "annual")}
        for k in ("exact", "annual") if role == "期末数" else ("annual", "exact"):
            statement = plain_best(bests[k]) if bests[k] else None
            if not statement and any(bests.values()):
                statement = docs.get((doc, k))
            for level, c in (("page", pages.get((doc, page, k))), ("statement", statement), ("doc", docs.get((doc, k)))):
                if c and not found:
                    found = (c[2], level)
        want[own] = found or ("unknown_date", "inferred")
    got = {k: (r.report_date, r.period_level) for k, r in dated(spark, facts, lines).items()}
    assert len({w[1] for w in want.values()}) >= 3
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_roles_of_a_single_annual_column(spark):
    rows = [("a", 1, "income_statement", "金额", "金额", 100.0, "2022年度", "unknown"), ("a", 2, "income_statement", "金额", "金额", None, "2022年度", "unknown"), ("b", 3, "cash_flow", "c1", "金额", 1.0, "2022年1月-3月", "unknown"), ("b", 4, "cash_flow", "c2", "金额", 1.0, "2022年度", "unknown"), ("c", 5, "cash_flow", "c1", "比例", 1.0, "2022年度", "unknown"), ("d", 6, "note", "金额", "金额", 1.0, "2022年度", "unknown"), ("e", 7, "cash_flow", "x", "", 1.0, "2022年度", "unknown"), ("f", 8, "cash_flow", "x", "", 1.0, "2022-01-01", "unknown"), (None, 9, "cash_flow", "x", "", 1.0, "2022年度", "期末数")]
    df = spark.createDataFrame(rows, "t string, fact_id int, statement_type string, column_key string, header_raw string, value double, report_date string, period_role string")
    got = {r.fact_id: (r.inferred, r.period_key) for r in pc.annual_roles(df, ["t"]).collect()}
    assert {k for k, (yes, _) in got.items() if yes} == {1, 7} and got[1][1] == "2022年度__本期" and len(got) == 9
    blocked = df.filter(pc.blocks_export(F.lit("c"), F.col("value"), F.col("report_date"), F.col("period_role"))).collect()
    assert {r.fact_id for r in blocked} == {1, 3, 4, 5, 6, 7, 8}


RULES = st.StatementRules(
    {"income_statement": ["利润及利润分配表", "利润表"], "note": ["财务报表附注"]}, ["财务报表附注", "注"], ["有关项目注释"],
    {"balance_sheet": [["项目", "期初数", "期末数"]]}, {"income_statement": ["营业收入", "营业成本", "利润总额"], "balance_sheet": ["资产总计"]},
    {"income_statement": ["一", "二"], "cash_flow": ["一", "二"]},
)
ST_FACTS = "doc_id string, page_no int, subtable string, label string, header_path array<string>, statement_type string, ordinal int"


def test_facts_without_a_type_or_document_stay(spark):
    facts = [("d", 1, None, "", "", "", ["期末数"], "", 1), (None, 1, "note", "", "", "2021年度", [], "", 2)]
    got = dated(spark, facts, [("d", 1, "page_text", "2022-12-31")])
    assert (got[1].statement_type, got[1].report_date, got[1].period_level) == (None, "2022-12-31", "page")
    assert (got[2].doc_id, got[2].report_date, got[2].period_level) == (None, "2021年度", "header")


def test_contested_headers_ask_their_document(spark):
    header = "2021-01-05 2022-01-05"
    facts = [("a", 1, "note", "", "", header, [], "", 1), ("b", 1, "note", "", "", header, [], "", 2)]
    got = dated(spark, facts, [("a", 1, "page_text", "2022-01-05")] * 3 + [("b", 2, "page_text", "x")])
    assert (got[1].report_date, got[1].period_level) == ("2022-01-05", "header")
    # Neither day is ahead in the other document, which has no dates of its own.
    assert (got[2].report_date, got[2].period_reason) == ("unknown_date", "no_page_date_found")


def test_roles_of_tables_read_and_shuffle_facts_once(spark):
    rows = spark.range(10).selectExpr("id AS t", "'h' AS column_key", "'h' AS header_raw", "1.0D AS value", "'note' AS statement_type", "'2022年度' AS report_date", "'unknown' AS period_role")
    plan = pc.annual_roles(rows, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and plan.count("Range (") == 1


def plain_type(facts, text, page, rules):
    scores, reasons = dict.fromkeys(st.TYPES, 0.0), []
    context = text or ""
    heads, labels = " ".join(h for f in facts for h in f[4]), [f[3] for f in facts]
    for kind, words in rules.titles.items():
        for w in words:
            if w in context:
                scores[kind] += 25
                reasons.append(f"title:{kind}:{w}")
    if any(w in context for w in rules.note_titles):
        scores["note"] += 35
        reasons.append("note_title")
    for kind, lists in rules.signatures.items():
        for words in lists:
            if all(w in heads for w in words):
                scores[kind] += 18
                reasons.append(f"header_signature:{kind}")
    for kind, known in rules.labels.items():
        n = sum(label in known for label in labels)
        if n:
            scores[kind] += min(30, 9 * n)
            reasons.append(f"row_pattern:{kind}:{n}")
    for kind, words in rules.numbering.items():
        if any(label.startswith(tuple(words)) for label in labels):
            scores[kind] += 6
            reasons.append(f"{kind}_numbering")
    if any(w in context for w in rules.note_markers):
        scores["note"] += 12
        reasons.append("note_detail_marker")
    if text is not None and 0 < page <= rules.early:
        for kind in st.MAIN:
            scores[kind] += 2 * (scores[kind] > 0)
        reasons.append("early_page_bonus")
    hints = Counter(f[5] for f in sorted(facts, key=lambda f: f[6]) if f[5] not in (None, "", "unknown"))
    if hints:
        kind, n = hints.most_common(1)[0]
        scores[kind] = scores.get(kind, 0) + min(8, 2 * n)
        reasons.append(f"existing_type_hint:{kind}")
    order = sorted(scores, key=lambda t: -scores[t])
    top, second = scores[order[0]], scores[order[1]]
    if top < rules.least or top - second < rules.margin:
        return (hints.most_common(1)[0][0], top, "fallback_existing", "kept_existing_type") if hints else ("unknown", top, "ambiguous", "ambiguous_scores")
    return order[0], top, "scored_specialization", ";".join(reasons[:6]) or "scored_specialization"


def test_types_are_those_of_a_plain_version(spark):
    draw = random.Random(6)
    words = ["利润及利润分配表", "财务报表附注", "有关项目注释", "2022年度", "注", "利", "利润表"]
    labels = ["营业收入", "营业成本", "利润总额", "资产总计", "一、x", "y", ""]
    texts, facts = {}, []
    for page in range(1, 120):
        doc = f"d{page % 7}"
        if draw.random() < 0.9:
            texts[doc, page] = " ".join(draw.choices(words, k=draw.randrange(4)))
        for table in range(draw.randrange(1, 3)):
            for _ in range(draw.randrange(1, 6)):
                facts.append((doc, page, f"t{table}", draw.choice(labels), draw.choice([["项目", "期初数"], ["期末数"], []]), draw.choice(["unknown", "unknown", "note", "cash_flow", "equity_statement", None]), len(facts)))
    pages = spark.createDataFrame([(d, p, t) for (d, p), t in texts.items()], "doc_id string, page_no int, text string")
    df = spark.createDataFrame(facts, ST_FACTS)
    table = ["doc_id", "page_no", "subtable"]
    for rules in (RULES, st.StatementRules(labels={"note": ["y"]}, least=1, margin=0)):
        groups = st.classified(df, pages, table, rules)
        got = {(r.doc_id, r.page_no, r.subtable): (r.statement_type, r.score, r.source, r.reason) for r in groups.collect()}
        want = {k: plain_type([f for f in facts if f[:3] == k], texts.get(k[:2]), k[1], rules) for k in {f[:3] for f in facts}}
        assert {k: (got.get(k), w) for k, w in want.items() if got.get(k) != w} == {} and len(got) == len(want)
    whole = st.specialized(df, st.classified(df, pages, table, RULES), table)
    assert whole.count() == len(facts) and whole.filter("type_before IS NULL OR statement_type IS NULL").count() == 0


def test_types_of_statements_read_the_facts_once(spark, tmp_path):
    kind = "doc_id int, page_no int, label string, header_path array<string>, statement_type string, ordinal long"
    spark.createDataFrame([(1, 1, "cash", ["item", "end"], "note", 2), (1, 1, "goods", ["item"], "cash_flow", 1), (None, 1, "cash", ["end"], "note", 3)], kind).write.parquet(str(tmp_path / "facts"))
    rules = st.StatementRules(signatures={"balance_sheet": [["item", "end"]]}, labels={"income_statement": ["cash"]}, numbering={"cash_flow": ["g"]}, least=10, margin=4)
    pages = spark.createDataFrame([(1, 1, "x")], "doc_id int, page_no int, text string")
    found = st.classified(spark.read.parquet(str(tmp_path / "facts")), pages, ["doc_id", "page_no"], rules)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    got = {r.doc_id: (r.statement_type, r.score, r.second, r.reason) for r in found.collect()}
    assert got == {
        1: ("balance_sheet", 20.0, 11.0, "header_signature:balance_sheet;row_pattern:income_statement:1;cash_flow_numbering;early_page_bonus;existing_type_hint:cash_flow"),
        None: ("unknown", 0.0, 0.0, "ambiguous_scores"),
    }
