"""Queries on providers, duplicates, validation, derivation and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import derive, export, reconcile, validation
from factloom.plans.facts import FACTS, KEY, MAPPED, ORDER, facts, mapped, order, table

QUERIES, ORACLES = {}, {}
KEYS = ", ".join(KEY)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


BEST = f"""best AS (
  SELECT * FROM (SELECT {KEYS}, provider, value, row_number() OVER (PARTITION BY {KEYS}, provider ORDER BY -quality, fact_id, value) AS n
                 FROM facts WHERE value IS NOT NULL) WHERE n = 1)"""
PAIRS = f"""pairs AS (
  SELECT {', '.join(f'a.{k}' for k in KEY)}, a.provider AS provider_a, a.value AS value_a, b.provider AS provider_b, b.value AS value_b,
         round(a.value, 8) = round(b.value, 8) AS is_equal, round(abs(a.value - b.value), 6) AS difference,
         CASE WHEN least(abs(a.value), abs(b.value)) > 0 THEN round(greatest(abs(a.value), abs(b.value)) / least(abs(a.value), abs(b.value)), 6) END AS ratio
  FROM best a JOIN best b USING ({KEYS}) WHERE a.provider < b.provider)"""
GROUPS = f"""groups AS (
  SELECT {KEYS}, count(DISTINCT provider) AS n_providers, count(DISTINCT round(value, 8)) AS n_values, min(value) AS low, max(value) AS high,
         CASE WHEN count(*) FILTER (WHERE value <> 0) >= 2 THEN round(max(abs(value)) / min(abs(value)) FILTER (WHERE value <> 0), 6) END AS magnitude_ratio,
         CASE WHEN count(DISTINCT round(value, 8)) = 1 THEN 'equal' ELSE 'conflict' END AS comparison
  FROM facts WHERE value IS NOT NULL GROUP BY {KEYS} HAVING count(DISTINCT provider) >= 2)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ties of quality and id are settled by the value, which only equal rows share.
    rows = facts(spark, sf_dir).withColumn("tie", F.struct("fact_id", "value"))
    return reconcile.provider_pairs(rows, KEY, tie="tie")


@query(f"WITH {FACTS}, {BEST}, {PAIRS} SELECT * FROM pairs")
def provider_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"WITH {FACTS}, {GROUPS} SELECT * FROM groups")
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.conflict_groups(facts(spark, sf_dir), KEY)


SCORE = "3 + CASE WHEN discount BETWEEN 0.035 AND 0.065 THEN 0 ELSE 2 END + CAST(status = 'observed' AS INTEGER) + CAST(report_date <> 'unknown_date' AS INTEGER)"


@query(f"""WITH {FACTS}, best AS (
  SELECT *, {SCORE} AS score, discount BETWEEN 0.035 AND 0.065 AS noisy FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEYS}, provider ORDER BY value IS NULL, {ORDER}) AS n FROM facts) WHERE n = 1),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY score, provider) AS k FROM best WHERE value IS NOT NULL) WHERE k = 1),
grouped AS (
  SELECT {KEYS}, count(*) AS n_providers, count(value) AS n_numeric, min(round(value, 8)) AS low, max(round(value, 8)) AS high, count(*) FILTER (WHERE noisy) AS noise,
         CASE WHEN count(*) FILTER (WHERE value <> 0) >= 2 THEN round(max(abs(value)) / min(abs(value)) FILTER (WHERE value <> 0), 6) END AS magnitude_ratio
  FROM best GROUP BY {KEYS} HAVING count(*) >= 2),
decided AS (
  SELECT g.*, f.provider AS first_provider, f.value AS first_value,
         CASE WHEN n_numeric = 0 THEN 'no_numeric_candidate_available' WHEN n_numeric = 1 THEN 'single_clean_numeric_candidate' WHEN low = high THEN 'equal'
              WHEN magnitude_ratio >= 100 THEN 'magnitude_ratio_exceeds_force_threshold' WHEN magnitude_ratio >= 10 THEN 'magnitude_ratio_requires_review'
              WHEN NOT f.noisy AND noise > 0 THEN 'clean_numeric_beats_noisy_candidate' ELSE 'multiple_numeric_candidates_need_review' END AS reason
  FROM grouped g LEFT JOIN firsts f USING ({KEYS}))
SELECT {KEYS}, n_providers, n_numeric, magnitude_ratio,
       CASE reason WHEN 'no_numeric_candidate_available' THEN 'unresolved' WHEN 'equal' THEN 'accepted' WHEN 'single_clean_numeric_candidate' THEN 'accepted_with_rule_support'
            WHEN 'clean_numeric_beats_noisy_candidate' THEN 'accepted_with_rule_support' ELSE 'review_required' END AS decision, reason,
       CASE WHEN reason IN ('equal', 'single_clean_numeric_candidate', 'clean_numeric_beats_noisy_candidate') THEN first_provider END AS winner,
       CASE WHEN reason IN ('equal', 'single_clean_numeric_candidate', 'clean_numeric_beats_noisy_candidate') THEN first_value END AS winning_value
FROM decided""")
def provider_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.col("discount").between(0.035, 0.065)
    score = F.lit(3) + F.when(noisy, 0).otherwise(2) + (F.col("status") == "observed").cast("int") + (F.col("report_date") != "unknown_date").cast("int")
    return reconcile.conflict_winners(facts(spark, sf_dir), KEY, F.col("provider"), score, noisy, order())


@query(f"""WITH {FACTS}, {BEST}, {PAIRS}
SELECT doc_id, page_no, count(*) AS compared_pairs, count(*) FILTER (WHERE is_equal) AS equal_pairs, count(*) FILTER (WHERE NOT is_equal) AS conflict_pairs
FROM pairs GROUP BY doc_id, page_no""")
def page_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.page_comparison(_pairs(spark, sf_dir), ["doc_id", "page_no"])


@query(f"WITH {FACTS} SELECT doc_id, page_no, min(provider) AS provider FROM facts GROUP BY doc_id, page_no HAVING min(provider) = max(provider)")
def single_provider_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.single_provider_pages(facts(spark, sf_dir), ["doc_id", "page_no"])


@query(f"""WITH {FACTS}, {GROUPS}, own AS (
  SELECT {KEYS}, provider, sum(CAST(value AS DECIMAL(18, 2))) AS own FROM facts JOIN (SELECT {KEYS} FROM groups WHERE comparison = 'conflict') USING ({KEYS}) GROUP BY {KEYS}, provider),
every AS (SELECT {KEYS}, sum(own) AS whole FROM own GROUP BY {KEYS}),
totals AS (SELECT doc_id, statement_type, sum(CAST(value AS DECIMAL(18, 2))) AS total FROM facts GROUP BY doc_id, statement_type)
SELECT {KEYS}, provider, CAST(total - whole + own AS DOUBLE) AS scope_total FROM own JOIN every USING ({KEYS}) JOIN totals USING (doc_id, statement_type)""")
def conflict_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    return reconcile.scenario_values(reconcile.conflict_groups(rows, KEY), rows, KEY, ["doc_id", "statement_type"])


STRICT = ["doc_id", "statement_type", "role", "report_date"]
DEDUPED = f"""deduped AS (
  SELECT *, CASE WHEN n = 1 THEN 'kept' WHEN low IS DISTINCT FROM high THEN 'review_kept_both' WHEN rank = 1 THEN 'kept' ELSE 'dropped' END AS dedupe
  FROM (SELECT *, count(*) OVER w AS n, min(round(value, 8)) OVER w AS low, max(round(value, 8)) OVER w AS high,
               row_number() OVER (PARTITION BY {', '.join(STRICT)} ORDER BY {ORDER}) AS rank
        FROM facts WHERE value IS NOT NULL WINDOW w AS (PARTITION BY {', '.join(STRICT)})))"""


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.dedupe_strict(facts(spark, sf_dir).filter("value IS NOT NULL"), STRICT, order())


@query(f"WITH {FACTS}, {DEDUPED} SELECT doc_id, statement_type, role, report_date, value, fact_id, dedupe FROM deduped")
def dedupe_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir).select(*STRICT, "value", "fact_id", "dedupe")


@query(f"""WITH {FACTS}, {DEDUPED} SELECT {', '.join(STRICT)}, count(*) AS n, count(*) FILTER (WHERE dedupe = 'dropped') AS dropped,
count(*) FILTER (WHERE dedupe = 'review_kept_both') AS in_review FROM deduped GROUP BY ALL HAVING count(*) > 1""")
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.duplicate_audit(_deduped(spark, sf_dir), STRICT)


@query(f"""WITH {FACTS}, {DEDUPED}, counted AS (
  SELECT *, count(*) FILTER (WHERE report_date <> 'unknown_date') OVER w AS known, count(*) OVER w AS n FROM (SELECT * EXCLUDE (n) FROM deduped WHERE dedupe <> 'dropped')
  WINDOW w AS (PARTITION BY doc_id, statement_type, role, round(value, 8)))
SELECT doc_id, statement_type, role, value, report_date, fact_id, NOT (known > 0 AND known < n AND report_date = 'unknown_date') AS kept,
       CASE WHEN known > 0 AND known < n AND report_date = 'unknown_date' THEN 'explicit_date_preferred_over_unknown_date' ELSE '' END AS reason FROM counted""")
def dedupe_explicit_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["doc_id", "statement_type", "role"]
    left = _deduped(spark, sf_dir).filter("dedupe <> 'dropped'").withColumn("amount", F.round("value", 8))
    return reconcile.dedupe_explicit_date(left, [*key, "amount"], "report_date", order()).select(*key, "value", "report_date", "fact_id", "kept", "reason")


PARTS = {"assets": "A", "liabilities": "N", "equity": "R"}


@query(f"""WITH {FACTS}, best AS (
  SELECT * FROM (SELECT doc_id, year, statement_type, value, row_number() OVER (PARTITION BY doc_id, year, statement_type ORDER BY {ORDER}) AS n FROM facts WHERE value IS NOT NULL AND status <> 'review') WHERE n = 1),
wide AS (SELECT doc_id, year, max(value) FILTER (WHERE statement_type = 'A') AS assets, max(value) FILTER (WHERE statement_type = 'N') AS liabilities,
                max(value) FILTER (WHERE statement_type = 'R') AS equity FROM best GROUP BY doc_id, year)
SELECT d.doc_id, d.year, assets, liabilities, equity, round(assets - (liabilities + equity), 6) AS difference,
       CASE WHEN assets IS NULL OR liabilities IS NULL OR equity IS NULL THEN 'skipped'
            WHEN abs(assets - (liabilities + equity)) <= greatest(1.0, abs(assets) * 0.0001, abs(liabilities + equity) * 0.0001) THEN 'pass' ELSE 'fail' END AS status
FROM (SELECT DISTINCT doc_id, year FROM facts WHERE status <> 'review') d LEFT JOIN wide w USING (doc_id, year)""")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {name: F.col("statement_type") == flag for name, flag in PARTS.items()}
    return validation.balance(validation.checked(facts(spark, sf_dir)), ["doc_id", "year"], parts, order())


TABLE = ["doc_id", "page_no", "role"]
SUBTOTALS = f"""WITH {FACTS}, grouped AS (SELECT {', '.join(TABLE)}, fact_id AS row, bool_or(tax > 0.06) AS is_total, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value
  FROM facts WHERE value IS NOT NULL AND status <> 'review' GROUP BY ALL),
islands AS (SELECT *, max(row) FILTER (WHERE is_total) OVER (PARTITION BY {', '.join(TABLE)} ORDER BY row RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM grouped),
sums AS (SELECT {', '.join(f't.{k}' for k in TABLE)}, t.row, t.value AS total, count(d.row) AS details, CAST(sum(CAST(d.value AS DECIMAL(18, 2))) AS DOUBLE) AS expected
  FROM islands t LEFT JOIN grouped d ON {' AND '.join(f'd.{k} = t.{k}' for k in TABLE)} AND NOT d.is_total AND d.row < t.row AND (t.since IS NULL OR d.row > t.since)
  WHERE t.is_total GROUP BY ALL)
SELECT {', '.join(TABLE)}, row, total, details, CASE WHEN details >= 2 THEN expected END AS expected,
       CASE WHEN details < 2 THEN 'skipped' WHEN abs(total - expected) <= greatest(1.0, abs(total) * 0.0001, abs(expected) * 0.0001) THEN 'pass' ELSE 'fail' END AS status FROM sums"""


@query(SUBTOTALS)
def subtotal_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validation.checked(facts(spark, sf_dir)).filter("value IS NOT NULL").groupBy(*TABLE, F.col("fact_id").alias("row"))
    rows = rows.agg(F.bool_or(F.col("tax") > 0.06).alias("is_total"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return validation.subtotals(rows, TABLE, "row", F.col("is_total"))


@query("SELECT l_orderkey AS fact_id, l_linenumber AS page_no, round(l_quantity / 25, 6) AS value, CASE WHEN abs(round(l_quantity / 25, 6) - 1) <= 0.02 THEN 'pass' ELSE 'fail' END AS status FROM lineitem WHERE l_tax >= 0.08")
def ratio_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("page_no"), F.round(F.col("l_quantity") / 25, 6).alias("value"), "l_tax")
    return validation.ratios(rows, F.col("l_tax") >= 0.08).drop("l_tax")


@query(f"""WITH b AS ({ORACLES['balance_check']}), s AS ({SUBTOTALS}), r AS ({ORACLES['ratio_check']}),
u AS (SELECT 'balance' AS rule, status FROM b UNION ALL SELECT 'subtotal', status FROM s UNION ALL SELECT 'ratio', status FROM r)
SELECT rule, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'review') AS n_review, count(*) FILTER (WHERE status = 'skipped') AS n_skipped FROM u GROUP BY rule""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"balance": balance_check, "subtotal": subtotal_islands, "ratio": ratio_check}
    parts = [f(spark, sf_dir).select(F.lit(rule).alias("rule"), "status") for rule, f in made.items()]
    return validation.summary(parts[0].unionByName(parts[1]).unionByName(parts[2]))


CODED = """coded AS (SELECT r_name AS region, n_name AS code, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS value, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
RULES = """rules AS (SELECT r_name || '/' || kind AS rule, kind, r_name AS target, n_name AS child,
         CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END AS sign, count(*) OVER (PARTITION BY r_name, kind) AS n_children
  FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest(['sum', 'sum_if_present', 'signed', 'copy_single']) AS kind))"""
DERIVED = f"""{CODED}, {RULES}, met AS (
  SELECT rule, kind, target, n_children, segment, sum(CASE WHEN kind = 'signed' THEN sign ELSE 1 END * CAST(value AS DECIMAL(18, 2))) AS s, count(*) AS n
  FROM coded JOIN rules ON code = child GROUP BY ALL),
derived AS (SELECT rule, target, segment, round(CAST(s AS DOUBLE), 6) AS derived, n AS children_met FROM met
  WHERE CASE WHEN kind IN ('sum', 'signed') THEN n = n_children WHEN kind = 'copy_single' THEN n = 1 ELSE n >= 1 END)"""


def _coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    coded = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("code"), F.col("c_mktsegment").alias("segment")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("value"))
    rules = nations.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in derive.KINDS])))
    sizes = rules.groupBy("r_name", "kind").agg(F.count(F.lit(1)).alias("n_children"))
    rules = rules.join(sizes, ["r_name", "kind"]).select(F.concat("r_name", F.lit("/"), "kind").alias("rule"), "kind", F.col("r_name").alias("target"), F.col("n_name").alias("child"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(-1).alias("sign"), "n_children")
    return coded, rules


@query(f"WITH {DERIVED} SELECT * FROM derived")
def formula_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.formulas(*_coded(spark, sf_dir), ["segment"])


OBSERVED = "observed AS (SELECT segment, region AS target, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS observed FROM coded WHERE region <> 'ASIA' GROUP BY segment, region)"
CONFLICTS = f"""{DERIVED}, {OBSERVED}, conflicts AS (SELECT rule, d.target, d.segment, derived, children_met, observed,
  CASE WHEN observed IS NULL THEN 'new' WHEN round(observed, 6) = round(derived, 6) THEN 'same' ELSE 'prefer_observed' END AS state
  FROM derived d LEFT JOIN observed o ON d.segment = o.segment AND d.target = o.target)"""


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, rules = _coded(spark, sf_dir)
    seen = coded.filter("region <> 'ASIA'").groupBy("segment", F.col("region").alias("code")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return derive.formula_conflicts(derive.formulas(coded, rules, ["segment"]), seen, ["segment"])


@query(f"WITH {CONFLICTS} SELECT * FROM conflicts")
def formula_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir)


@query(f"""WITH {CONFLICTS} SELECT rule, count(*) AS n, count(*) FILTER (WHERE state = 'new') AS exportable, count(*) FILTER (WHERE state = 'prefer_observed') AS conflicts,
CAST(sum(CAST(abs(derived) AS DECIMAL(18, 2))) AS DOUBLE) AS amount FROM conflicts GROUP BY rule""")
def formula_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.rule_impact(_conflicts(spark, sf_dir))


def _blockers() -> list[tuple[str, Column]]:
    return [
        ("unmapped", F.col("code").isNull()),
        ("mapping_review_required", F.col("confidence") < 0.95),
        ("non_numeric_or_blank", F.col("value").isNull()),
        ("statement_type_blocked", F.col("statement_type") == "R"),
        ("unknown_date", F.col("report_date") == "unknown_date"),
        ("unknown_period_role", F.col("role") == "F"),
        ("status_blocked", F.col("status") == "review"),
    ]


BLOCKER = """CASE WHEN code IS NULL THEN 'unmapped' WHEN confidence < 0.95 THEN 'mapping_review_required' WHEN value IS NULL THEN 'non_numeric_or_blank'
  WHEN statement_type = 'R' THEN 'statement_type_blocked' WHEN report_date = 'unknown_date' THEN 'unknown_date' WHEN role = 'F' THEN 'unknown_period_role'
  WHEN status = 'review' THEN 'status_blocked' ELSE '' END"""


@query(f"WITH {MAPPED} SELECT statement_type, {BLOCKER} AS blocker, count(*) AS n FROM mapped GROUP BY ALL")
def export_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir).groupBy("statement_type", export.first_reason(_blockers()).alias("blocker")).agg(F.count(F.lit(1)).alias("n"))


CELL = ["doc_id", "report_date"]
WINNERS = f"""open AS (SELECT * FROM mapped WHERE {BLOCKER} = ''), marked AS (
  SELECT *, min(round(value, 8)) OVER w AS low, max(round(value, 8)) OVER w AS high, count(*) FILTER (WHERE status = 'observed') OVER w AS ok,
         row_number() OVER (PARTITION BY doc_id, report_date ORDER BY {ORDER}) AS rank FROM open WINDOW w AS (PARTITION BY doc_id, report_date)),
winners AS (SELECT doc_id, report_date, value, fact_id, CASE WHEN low = high AND rank = 1 THEN 'exported' WHEN low = high THEN 'duplicate_same_value_not_exported'
  WHEN ok = 1 AND status = 'observed' THEN 'exported' WHEN ok = 1 THEN 'replaced_by_resolved_candidate' ELSE 'multiple_export_candidates' END AS export FROM marked)"""


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = mapped(spark, sf_dir).filter(export.first_reason(_blockers()) == "")
    return export.export_winners(open_, CELL, order(), accepted=F.col("status") == "observed").select(*CELL, "value", "fact_id", "export")


@query(f"WITH {MAPPED}, {WINNERS} SELECT * FROM winners")
def export_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _winners(spark, sf_dir)


YEARS = [f"{y}年度" for y in range(1992, 1999)]


@query(f"WITH {MAPPED}, {WINNERS} SELECT doc_id, {', '.join(f'''max(value * 1000) FILTER (WHERE report_date = '{y}') AS "{y}"''' for y in YEARS)} FROM winners WHERE export = 'exported' GROUP BY doc_id")
def export_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.pivot_sheet(_winners(spark, sf_dir).filter("export = 'exported'"), ["doc_id"], "report_date", YEARS, F.col("value") * 1000)


LEVELLED = f"""{CODED}, seen AS (SELECT segment, code, value FROM coded UNION ALL
  SELECT segment, 'ASIA', CAST(2 * sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) FROM coded WHERE region = 'ASIA' AND segment < 'F' GROUP BY segment),
zero AS (SELECT r_name || '/sum' AS rule, r_name AS target, s.segment, round(CAST(sum(CAST(s.value AS DECIMAL(18, 2))) AS DOUBLE), 6) AS derived, count(*) AS children_met, 0 AS level
  FROM seen s JOIN nation ON s.code = n_name JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
known AS (SELECT * FROM seen UNION ALL SELECT segment, target, derived FROM zero WHERE (segment, target) NOT IN (SELECT (segment, code) FROM seen)),
one AS (SELECT 'WORLD/signed' AS rule, 'WORLD' AS target, segment, round(CAST(sum(CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE -1 END * CAST(value AS DECIMAL(18, 2))) AS DOUBLE), 6) AS derived, count(*) AS children_met, 1 AS level
  FROM known JOIN region ON code = r_name GROUP BY segment HAVING count(*) = (SELECT count(*) FROM region)),
two AS (SELECT 'TOP/copy' AS rule, 'TOP' AS target, segment, derived, 1 AS children_met, 2 AS level FROM one)"""


@query(f"WITH {LEVELLED} SELECT * FROM zero UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two")
def formula_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations make regions, regions the world, and the world the top; two rules need each other and derive nothing."""
    coded, _ = _coded(spark, sf_dir)
    doubled = coded.filter("region = 'ASIA' AND segment < 'F'").groupBy("segment").agg((2 * F.sum(F.col("value").cast("decimal(18,2)"))).cast("double").alias("value"))
    facts = coded.select("segment", "code", "value").unionByName(doubled.select("segment", F.lit("ASIA").alias("code"), "value"))
    regions = table(spark, sf_dir, "region")
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    rule = lambda name, kind, target, child, sign: [name.alias("rule"), F.lit(kind).alias("kind"), target.alias("target"), child.alias("child"), sign.alias("sign")]
    one = F.lit(1)
    rules = nations.select(*rule(F.concat("r_name", F.lit("/sum")), "sum_if_present", F.col("r_name"), F.col("n_name"), one))
    rules = rules.unionByName(regions.select(*rule(F.lit("WORLD/signed"), "signed", F.lit("WORLD"), F.col("r_name"), F.when(F.col("r_regionkey") % 2 == 0, 1).otherwise(-1))))
    extra = [("TOP/copy", "copy_single", "TOP", "WORLD", 1), ("X/sum", "sum", "X", "Y", 1), ("Y/sum", "sum_if_present", "Y", "X", 1), ("Y/sum", "sum_if_present", "Y", "ASIA", 1), ("Z/sum", "sum", "Z", "X", 1)]
    rules = rules.unionByName(spark.createDataFrame(extra, "rule string, kind string, target string, child string, sign int"))
    sizes = rules.groupBy("rule").agg(F.count(F.lit(1)).alias("n_children"))
    return derive.levelled_formulas(facts, rules.join(sizes, "rule"), ["segment"])
