"""Queries on conflicts and what their candidates would do to the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import ranks, run_summary, whatif
from factloom.plans.facts import table
from factloom.streaming import feedback

QUERIES, ORACLES = {}, {}

#: Labels by the last digit of the order's key.
LABELS = ["原材料", "资产总计", "负债合计", "所有者权益合计", "库存商品", "小计"]
STATEMENTS = {"A": "balance_sheet", "N": "note", "R": "cash_flow"}
KEY = ["doc_id", "page_no", "statement_type", "label", "column", "period"]
PARTS = {"assets": LABELS[1], "liabilities": LABELS[2], "equity": LABELS[3]}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells of statements: suppliers are documents, line numbers pages, parts providers."""
    items = table(spark, sf_dir, "lineitem")
    row = F.col("l_orderkey") % 6
    share = F.col("l_linestatus") == "F"
    return items.select(
        F.col("l_suppkey").alias("doc_id"),
        F.col("l_linenumber").alias("page_no"),
        F.when(F.col("l_returnflag") == "A", STATEMENTS["A"]).when(F.col("l_returnflag") == "N", STATEMENTS["N"]).otherwise(STATEMENTS["R"]).alias("statement_type"),
        F.when(share, "本期比例").otherwise("期末").alias("column"),
        F.col("l_linestatus").alias("period"),
        F.lit("t1").alias("subtable"),
        F.element_at(F.array(*map(F.lit, LABELS)), (row + 1).cast("int")).alias("label"),
        row.alias("row"),
        (F.col("l_partkey") % 3).alias("col"),
        (F.col("l_partkey") % 3).alias("provider"),
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("fact_id"),
        F.when(F.col("l_discount") >= 0.09, None).when(share, F.round(F.col("l_quantity") / 25, 2)).otherwise(F.round(F.col("l_quantity") / 10)).alias("value"),
        F.when(F.col("l_discount") >= 0.095, F.lit("")).otherwise(F.lit("x")).alias("raw"),
        F.when(F.col("l_tax") < 0.005, "review").when(F.col("l_tax") < 0.015, "repaired").when(F.col("l_tax") > 0.075, "suppressed").otherwise("observed").alias("status"),
        F.when(F.col("l_discount").between(0.035, 0.045), F.array(F.lit("seal_or_stamp_noise"))).otherwise(F.array().cast("array<string>")).alias("issue_flags"),
        F.when(F.col("l_tax") > 0.06, "").otherwise("c").alias("code"),
    )


STATED = f"""stated AS (
  SELECT l_suppkey AS doc_id, l_linenumber AS page_no, CASE l_returnflag WHEN 'A' THEN '{STATEMENTS['A']}' WHEN 'N' THEN '{STATEMENTS['N']}' ELSE '{STATEMENTS['R']}' END AS statement_type,
         CASE WHEN l_linestatus = 'F' THEN '本期比例' ELSE '期末' END AS "column", l_linestatus AS period, 't1' AS subtable,
         ([{', '.join(f"'{x}'" for x in LABELS)}])[l_orderkey % 6 + 1] AS label, l_orderkey % 6 AS "row", l_partkey % 3 AS col, l_partkey % 3 AS provider,
         ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS fact_id,
         CASE WHEN l_discount >= 0.09 THEN NULL WHEN l_linestatus = 'F' THEN round(l_quantity / 25, 2) ELSE round(l_quantity / 10) END AS value,
         CASE WHEN l_discount >= 0.095 THEN '' ELSE 'x' END AS raw,
         CASE WHEN l_tax < 0.005 THEN 'review' WHEN l_tax < 0.015 THEN 'repaired' WHEN l_tax > 0.075 THEN 'suppressed' ELSE 'observed' END AS status,
         l_discount BETWEEN 0.035 AND 0.045 AS noisy, CASE WHEN l_tax > 0.06 THEN '' ELSE 'c' END AS code
  FROM lineitem)"""
KEYS = ", ".join(f'"{k}"' for k in KEY)
ALIGNED = f"""{STATED}, said AS (
  SELECT *, CASE WHEN value IS NOT NULL THEN 'n' || CAST(round(value, 8) AS VARCHAR) WHEN trim(raw) <> '' THEN 't' || trim(raw) END AS said FROM stated),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS}, provider ORDER BY said IS NULL, value IS NULL, fact_id) AS n FROM said) WHERE n = 1),
keyed AS (SELECT {KEYS}, CASE WHEN count(*) < 2 THEN 'single_provider' WHEN count(said) < 2 THEN 'uncomparable' WHEN min(said) = max(said) THEN 'equal' ELSE 'conflict' END AS comparison
  FROM best GROUP BY {KEYS}),
facts AS (SELECT s.*, k.comparison, CASE WHEN k.comparison = 'conflict' THEN sha256(concat_ws('|', {', '.join(f'CAST(s."{k}" AS VARCHAR)' for k in KEY)})) END AS conflict_id
  FROM stated s JOIN keyed k USING ({KEYS}))"""


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif.alignments(stated(spark, sf_dir), KEY)


def rules() -> whatif.Rules:
    balance = F.col("statement_type") == STATEMENTS["A"]
    parts = {name: balance & (F.col("label") == label) for name, label in PARTS.items()}
    return whatif.Rules(parts, whatif.is_total(F.col("label")), whatif.is_ratio(F.lit(""), F.col("column")), F.col("noisy"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their conflicts and what each would do to the checks. Their cells are parts of a scope, by which they are dealt once, narrow."""
    facts = stated(spark, sf_dir).withColumn("noisy", whatif.is_noisy(F.col("issue_flags"))).drop("issue_flags")
    return whatif.judged(whatif.numbered(whatif.dealt(facts), KEY), rules())


@query(f"WITH {ALIGNED} SELECT page_no, comparison, count(*) AS n, count(DISTINCT conflict_id) AS conflicts FROM facts GROUP BY page_no, comparison")
def provider_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Conflicts are counted after a grouping of their own, so that rows aren't doubled.
    each = aligned(spark, sf_dir).groupBy("page_no", "comparison", "conflict_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("page_no", "comparison").agg(F.sum("n").alias("n"), F.count("conflict_id").alias("conflicts"))


#: Every check run again for every candidate, over a copy of its scope.
IMPACTS = f"""{ALIGNED}, chosen AS (SELECT conflict_id AS g, fact_id AS c, doc_id, period, statement_type FROM facts WHERE conflict_id IS NOT NULL),
view AS (
  SELECT c.g, c.c, f.*, CASE WHEN f.conflict_id IS DISTINCT FROM c.g THEN f.status WHEN f.fact_id <> c.c THEN 'conflict' WHEN f.status IN ('conflict', 'review') THEN 'observed' ELSE f.status END AS st,
         regexp_matches(f.label, '合计|小计|总计') AS is_total, contains(f."column", '比例') AS is_ratio
  FROM chosen c JOIN facts f USING (doc_id, period, statement_type)),
ok AS (SELECT * FROM view WHERE value IS NOT NULL AND st NOT IN ('review', 'conflict', 'suppressed')),
wide AS (
  SELECT c, {', '.join(f"arg_min(value, (CASE WHEN st = 'observed' THEN 0 ELSE 1 END, row, fact_id)) FILTER (WHERE statement_type = '{STATEMENTS['A']}' AND label = '{label}') AS {name}" for name, label in PARTS.items())}
  FROM ok GROUP BY c),
balances AS (SELECT c, coalesce(CAST(abs(assets - (liabilities + equity)) > greatest(1.0, abs(assets) * 0.0001, abs(liabilities + equity) * 0.0001) AS INTEGER), 0) AS n FROM wide),
grouped AS (SELECT *, CAST(value AS DECIMAL(28, 6)) AS worth, max(CASE WHEN is_total THEN row END) OVER (PARTITION BY c, page_no, subtable, "column" ORDER BY row, col, fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM ok),
sums AS (
  SELECT t.c, t.fact_id, t.value, count(d.c) AS n, CAST(sum(d.worth) AS DOUBLE) AS total
  FROM grouped t LEFT JOIN grouped d ON d.c = t.c AND d.page_no = t.page_no AND d.subtable = t.subtable AND d."column" = t."column" AND NOT d.is_total AND d.row < t.row AND (t.since IS NULL OR d.row > t.since)
  WHERE t.is_total GROUP BY t.c, t.fact_id, t.value),
subtotals AS (SELECT c, count(*) AS n FROM sums WHERE n >= 2 AND abs(value - total) > greatest(1.0, abs(value) * 0.0001, abs(total) * 0.0001) GROUP BY c),
ratios AS (SELECT c, count(*) AS n FROM ok WHERE is_total AND is_ratio AND abs(value - 1) > 0.02 GROUP BY c),
reviews AS (SELECT c, count(*) AS n FROM view WHERE noisy AND st <> 'suppressed' GROUP BY c),
impacts AS (
  SELECT g AS conflict_id, f.fact_id, f.provider, CAST(coalesce(b.n, 0) + coalesce(s.n, 0) + coalesce(r.n, 0) AS BIGINT) AS fail_count, CAST(coalesce(v.n, 0) AS BIGINT) AS review_count
  FROM chosen JOIN facts f ON f.fact_id = chosen.c LEFT JOIN balances b USING (c) LEFT JOIN subtotals s USING (c) LEFT JOIN ratios r USING (c) LEFT JOIN reviews v USING (c))"""


@query(f"WITH {IMPACTS} SELECT *, CAST(greatest(0, 20 - 4 * fail_count - review_count) AS DOUBLE) AS delta_score FROM impacts")
def conflict_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif.impacts_of(whatif.named(_judged(spark, sf_dir), KEY))


DECISIONS = f"""{IMPACTS}, ranked AS (
  SELECT i.*, f.value, f.noisy, CASE WHEN f.value IS NULL THEN 0 ELSE 3 END + CASE WHEN f.noisy THEN 0 ELSE 2 END + CAST(f.status = 'observed' AS INTEGER) + CAST(f.code <> '' AS INTEGER) + 1 AS score
  FROM impacts i JOIN facts f USING (fact_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conflict_id ORDER BY fail_count, review_count, provider, fact_id) AS k,
                  row_number() OVER (PARTITION BY conflict_id ORDER BY value IS NULL, score, provider, fact_id DESC) AS m FROM ranked),
wide2 AS (
  SELECT conflict_id, count(*) AS n_candidates, count(value) AS n_numeric,
         CASE WHEN count(*) FILTER (WHERE value <> 0) >= 2 THEN round(max(abs(value)) / min(abs(value)) FILTER (WHERE value <> 0), 6) END AS magnitude_ratio,
         count(*) FILTER (WHERE noisy) AS noise, max(fact_id) FILTER (WHERE k = 1) AS best_id, max(provider) FILTER (WHERE k = 1) AS best_provider,
         max(fail_count) FILTER (WHERE k = 1) AS f1, max(review_count) FILTER (WHERE k = 1) AS r1, max(fail_count) FILTER (WHERE k = 2) AS f2, max(review_count) FILTER (WHERE k = 2) AS r2,
         max(fact_id) FILTER (WHERE m = 1 AND value IS NOT NULL) AS first_id, max(provider) FILTER (WHERE m = 1 AND value IS NOT NULL) AS first_provider, bool_or(noisy) FILTER (WHERE m = 1 AND value IS NOT NULL) AS first_noisy
  FROM placed GROUP BY conflict_id),
reasoned AS (
  SELECT *, CASE WHEN n_candidates < 2 THEN 'insufficient_candidates_after_dedupe' WHEN n_numeric = 0 THEN 'no_numeric_candidate_available' WHEN n_numeric = 1 THEN 'single_clean_numeric_candidate'
    WHEN magnitude_ratio >= 100 THEN 'magnitude_ratio_exceeds_force_threshold'
    WHEN (f1 < f2 OR (f1 = f2 AND r1 + 2 <= r2)) AND coalesce(magnitude_ratio < 10, true) THEN 'validation_delta_supports_candidate'
    WHEN magnitude_ratio >= 10 THEN 'magnitude_ratio_requires_review' WHEN NOT first_noisy AND noise > 0 THEN 'clean_numeric_beats_noisy_candidate' ELSE 'multiple_numeric_candidates_need_review' END AS reason FROM wide2),
decisions AS (
  SELECT conflict_id, n_candidates, n_numeric, magnitude_ratio,
         CASE reason WHEN 'insufficient_candidates_after_dedupe' THEN 'unresolved' WHEN 'no_numeric_candidate_available' THEN 'unresolved' WHEN 'validation_delta_supports_candidate' THEN 'accepted_with_validation_support'
              WHEN 'single_clean_numeric_candidate' THEN 'accepted_with_rule_support' WHEN 'clean_numeric_beats_noisy_candidate' THEN 'accepted_with_rule_support' ELSE 'review_required' END AS decision, reason,
         CASE WHEN reason = 'validation_delta_supports_candidate' THEN best_id WHEN reason IN ('single_clean_numeric_candidate', 'clean_numeric_beats_noisy_candidate') THEN first_id END AS accepted_fact_id,
         CASE WHEN reason = 'validation_delta_supports_candidate' THEN best_provider WHEN reason IN ('single_clean_numeric_candidate', 'clean_numeric_beats_noisy_candidate') THEN first_provider END AS accepted_provider,
         f1 AS best_fails, r1 AS best_reviews FROM reasoned)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = whatif.rule_quality(F.col("value"), F.col("noisy"), F.col("status"), F.col("code"), F.lit("2022年度"))
    return whatif.decided(_judged(spark, sf_dir), ["conflict", *whatif.SCOPE], score, F.col("noisy"), F.col("provider"))


@query(f"WITH {DECISIONS} SELECT * FROM decisions")
def conflict_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif.outcomes(whatif.named(_decided(spark, sf_dir), KEY))


@query(f"""WITH {DECISIONS}, applied AS (
  SELECT f.status AS before, d.reason, CASE WHEN d.decision IS NULL THEN f.status WHEN d.decision IN ('review_required', 'unresolved') THEN 'review'
         WHEN f.fact_id = d.accepted_fact_id THEN CASE WHEN f.status IN ('conflict', 'review') THEN 'observed' ELSE f.status END ELSE 'conflict' END AS status,
         CASE WHEN d.decision IS NULL THEN NULL WHEN d.decision NOT IN ('review_required', 'unresolved') AND f.fact_id = d.accepted_fact_id THEN 'accepted' ELSE 'conflict' END AS comparison
  FROM facts f LEFT JOIN decisions d USING (conflict_id))
SELECT before, status, comparison, reason, count(*) AS n FROM applied GROUP BY ALL""")
def decisions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whatif.settled(_decided(spark, sf_dir).withColumn("before", F.col("status")))
    return rows.groupBy("before", "status", "comparison", "reason").agg(F.count(F.lit(1)).alias("n"))


#: What ranks facts, in expressions that both engines read.
RANKED = {
    "date": "CASE fact_id % 4 WHEN 0 THEN '2022-12-31' WHEN 1 THEN '2022年1月-3月' WHEN 2 THEN '2022年度' ELSE 'unknown_date' END",
    "source_kind": "CASE fact_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN '' WHEN 2 THEN 'xlsx_fallback' WHEN 3 THEN 'derived_formula' ELSE NULL END",
    "decision": "CASE fact_id % 7 WHEN 0 THEN 'accepted_with_validation_support' WHEN 1 THEN 'accepted_with_rule_support' WHEN 2 THEN 'accepted' ELSE '' END",
    "stance": "CASE fact_id % 11 WHEN 0 THEN 'accepted' WHEN 1 THEN 'equal' WHEN 2 THEN 'conflict' ELSE NULL END",
    "role": "CASE fact_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN '本期' ELSE '' END",
    "n_path": "CAST(fact_id % 13 % 4 AS INTEGER)",
    "table_key": "CASE fact_id % 17 % 2 WHEN 0 THEN 'k' ELSE '' END",
    "kind": "CASE WHEN fact_id % 19 < 4 THEN 'unknown' ELSE 'note' END",
}
DATE = "CASE WHEN date = 'unknown_date' THEN 0 WHEN length(date) = 10 THEN -3 WHEN date LIKE '%月' THEN -2 ELSE -1 END"
STATUS = "CASE status WHEN 'observed' THEN -5 WHEN 'repaired' THEN -4 WHEN 'inferred' THEN -3 WHEN 'blank' THEN -2 WHEN 'review' THEN -1 ELSE 0 END"
MAPPED_FIRST, BOOK_LAST = "CASE WHEN code <> '' THEN 0 ELSE 1 END", "CASE WHEN source_kind = 'xlsx_fallback' THEN 1 ELSE 0 END"
FIRST_RANKS = {
    "provider_choice": f"""CASE WHEN value IS NOT NULL AND NOT noisy THEN -5 WHEN value IS NOT NULL THEN -4 WHEN raw <> '' AND status NOT IN ('review', 'conflict') THEN -2 WHEN raw <> '' THEN -1 ELSE 0 END,
      {DATE}, {STATUS}, CASE source_kind WHEN 'json' THEN -2 WHEN '' THEN -1 ELSE 0 END, {MAPPED_FIRST}, -n_path, provider, fact_id""",
    "duplicate_choice": f"""{DATE}, CASE WHEN kind <> 'unknown' THEN 0 ELSE 1 END, {MAPPED_FIRST}, {STATUS}, {BOOK_LAST}, CASE WHEN value IS NOT NULL THEN 0 ELSE 1 END, -n_path, CASE WHEN table_key <> '' THEN 0 ELSE 1 END, provider,
      CASE WHEN stance IN ('accepted', 'equal', 'single_provider') THEN 0 ELSE 1 END, fact_id""",
    "export_choice": f"""CASE WHEN source_kind = 'derived_formula' THEN 1 ELSE 0 END, CASE WHEN decision = 'accepted_with_validation_support' THEN 0 ELSE 1 END, CASE WHEN decision = 'accepted_with_rule_support' THEN 0 ELSE 1 END,
      CASE WHEN stance = 'accepted' THEN 0 ELSE 1 END, CASE WHEN status = 'observed' THEN 0 ELSE 1 END, {MAPPED_FIRST}, CASE WHEN role NOT IN ('', 'unknown') THEN 0 ELSE 1 END, -n_path, {BOOK_LAST}, fact_id""",
    "child_choice": f"""CASE WHEN source_kind = 'derived_formula' THEN 1 ELSE 0 END, CASE WHEN decision LIKE 'accepted%' THEN 0 ELSE 1 END, CASE WHEN status = 'observed' THEN 0 ELSE 1 END, {MAPPED_FIRST}, fact_id""",
}


@query(f"""WITH {STATED}, marked AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in RANKED.items())} FROM stated)
SELECT DISTINCT {KEYS}, {', '.join(f'first_value(fact_id) OVER (PARTITION BY {KEYS} ORDER BY {o}) AS {n}' for n, o in FIRST_RANKS.items())} FROM marked""")
def ranked_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact that stands for each cell by each of the four orders, in one grouping."""
    rows = stated(spark, sf_dir).select("*", *[F.expr(e).alias(n) for n, e in RANKED.items()])
    c = {name: F.col(name) for name in ("value", "raw", "status", "date", "source_kind", "code", "decision", "role", "table_key", "fact_id")}
    path = F.when(F.col("n_path") > 0, F.array_repeat(F.lit("h"), F.col("n_path"))).otherwise(F.array().cast("array<string>"))
    c |= {"noisy": whatif.is_noisy(F.col("issue_flags")), "path": path, "provider_place": F.col("provider"), "comparison": F.col("stance"), "statement_type": F.col("kind")}
    orders = {"provider_choice": ranks.among_providers, "duplicate_choice": ranks.among_duplicates, "export_choice": ranks.among_exports, "child_choice": ranks.among_children}
    # Rows are dealt and sorted narrow: an aggregate of wide orders would sort, and spill, on both sides of the shuffle.
    dealt = rows.select(*KEY, "fact_id", *[ranks.packed(order, c).alias(f"by_{name}") for name, order in orders.items()]).repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.groupBy(*KEY).agg(*[F.min_by("fact_id", F.struct(f"by_{name}", "fact_id")).alias(name) for name in orders])


LATE_SQL = f"""{STATED}, facts AS (SELECT *, 'p' AS period_key FROM stated),
reviews AS (SELECT 'R' || (l_orderkey % 1000) AS review_id, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS fact_id FROM lineitem WHERE l_tax < 0.03),
results AS (SELECT 'T' || (o_orderkey % 1100) AS task_id, o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS name, CASE o_orderstatus WHEN 'F' THEN o_orderkey || '__x' ELSE '' END AS period_key,
  CASE o_orderstatus WHEN 'O' THEN 'raw' || o_orderkey ELSE '' END AS value_raw, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 4 = 1 THEN 'x' ELSE '' END AS value_num FROM orders WHERE o_totalprice < 60000),
met AS (SELECT r.*, v.fact_id, TRY_CAST(nullif(nullif(value_num, 'x'), '') AS DOUBLE) AS number FROM results r JOIN reviews v ON v.review_id = 'R' || substr(task_id, 2)),
placed AS (SELECT m.*, f.status IN ('review', 'conflict', 'blank', 'inferred') OR f.value IS NULL AS open, min(CASE WHEN number IS NOT NULL THEN name END) OVER (PARTITION BY m.fact_id) AS closing FROM met m JOIN facts f USING (fact_id)),
counted AS (SELECT * FROM placed WHERE open AND (closing IS NULL OR name <= closing)),
said AS (SELECT fact_id, arg_max(nullif(period_key, ''), name) FILTER (WHERE period_key <> '') AS period, arg_max(value_raw, name) FILTER (WHERE value_raw <> '') AS raw, max(number) AS number FROM counted GROUP BY fact_id)"""


@query(f"""WITH {LATE_SQL} SELECT fact_id, coalesce(s.number, value) AS value, coalesce(s.raw, f.raw) AS raw, coalesce(s.period, period_key) AS period_key,
CASE WHEN s.number IS NOT NULL AND status IN ('review', 'conflict', 'blank', 'inferred') THEN 'observed' ELSE status END AS status, s.fact_id IS NOT NULL AS reocr FROM facts f LEFT JOIN said s USING (fact_id)""")
def late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap orders as results of tasks, whose reviews name the doubtful line items of some orders."""
    facts = stated(spark, sf_dir).withColumn("period_key", F.lit("p"))
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_totalprice < 60000")
    fact_id = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    name = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    reviews = items.filter("l_tax < 0.03").groupBy(name("R", F.col("l_orderkey") % 1000).alias("review_id")).agg(F.collect_list(fact_id).alias("fact_ids"))
    tasks = orders.select(name("T", F.col("o_orderkey") % 1100).alias("task_id"), name("R", F.col("o_orderkey") % 1100).alias("review_id")).distinct()
    key = F.col("o_orderkey").cast("string")
    results = orders.select(
        name("T", F.col("o_orderkey") % 1100).alias("task_id"),
        F.concat("o_orderpriority", F.lit("/"), F.lpad(key, 12, "0")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", F.concat(key, F.lit("__x"))).otherwise("").alias("period_key"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("raw"), key)).otherwise("").alias("value_raw"),
        F.when(F.col("o_orderkey") % 4 == 0, key).when(F.col("o_orderkey") % 4 == 1, "x").otherwise("").alias("value_num"),
    )
    return feedback.merged(facts, tasks, reviews, results).select("fact_id", "value", "raw", "period_key", "status", "reocr")


METRICS_FROM = f"{STATED}, facts AS (SELECT *, {RANKED['date']} AS report_date, {RANKED['role']} AS period_role FROM stated)"
METRIC_SQL = {
    "facts_total": "true", "active_total": "status <> 'suppressed'", "suppressed_total": "status = 'suppressed'", "mapped_total": "status <> 'suppressed' AND code <> ''", "unmapped_total": "status <> 'suppressed' AND code = ''",
    "unknown_date_total": "status <> 'suppressed' AND report_date = 'unknown_date'", "unknown_statement_type_total": "status <> 'suppressed' AND statement_type = 'unknown'", "unknown_period_role_total": "status <> 'suppressed' AND period_role = 'unknown'",
    "repaired_total": "status = 'repaired'", "review_total": "status = 'review'", "numeric_total": "status <> 'suppressed' AND value IS NOT NULL",
}


@query(f"""WITH {METRICS_FROM}, sets AS (SELECT statement_type AS s, period AS p, page_no AS g, grouping(statement_type, period, page_no) AS id, {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in METRIC_SQL.items())},
  CAST(coalesce(sum(abs(CAST(value AS DECIMAL(28, 6)))) FILTER (WHERE status <> 'suppressed'), 0) AS DOUBLE) AS amount_total,
  CAST(coalesce(sum(abs(CAST(value AS DECIMAL(28, 6)))) FILTER (WHERE code <> '' AND status NOT IN ('suppressed', 'review', 'conflict')), 0) AS DOUBLE) AS mapped_amount
  FROM facts GROUP BY GROUPING SETS ((), (statement_type), (period), (page_no)))
SELECT CASE id WHEN 7 THEN 'run' WHEN 3 THEN 'statement_type' WHEN 5 THEN 'period' ELSE 'page_no' END AS grain, CASE id WHEN 3 THEN s WHEN 5 THEN p WHEN 6 THEN CAST(g AS VARCHAR) END AS key, {', '.join(METRIC_SQL)}, amount_total, mapped_amount,
  {', '.join(f'CASE WHEN active_total > 0 THEN {t} / active_total::DOUBLE ELSE 0.0 END AS {n}' for n, t in run_summary.RATIOS.items())}, CASE WHEN amount_total > 0 THEN mapped_amount / amount_total ELSE 0.0 END AS amount_coverage_ratio FROM sets""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stated(spark, sf_dir).withColumns({"report_date": F.expr(RANKED["date"]), "period_role": F.expr(RANKED["role"])})
    return run_summary.fact_metrics(facts, ["statement_type", "period", "page_no"])


@query(f"WITH {STATED} SELECT count(DISTINCT doc_id) AS docs_total, count(DISTINCT (doc_id, page_no)) AS pages_total, count(DISTINCT (doc_id, page_no, statement_type)) AS tables_total, count(*) AS rows_total FROM stated")
def run_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_summary.extents(stated(spark, sf_dir), [["doc_id"], ["doc_id", "page_no"], ["doc_id", "page_no", "statement_type"]], ["docs_total", "pages_total", "tables_total"])
    return rows.select("docs_total", "pages_total", "tables_total", "rows_total")


@query(f"WITH {STATED} SELECT CASE WHEN noisy THEN 'seal_or_stamp_noise' ELSE 'review' END AS reason, count(*) AS n FROM stated WHERE status = 'review' GROUP BY 1")
def run_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summary.review_reasons(stated(spark, sf_dir))
