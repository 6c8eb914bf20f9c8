"""Queries on summaries of runs, over all rows of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import summary
from factloom.plans.facts import FACTS, MAPPED, facts, mapped, table
from factloom.plans.tables import SIDES, _compared

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {MAPPED} SELECT coalesce(code, '') AS value, count(*) AS n FROM mapped GROUP BY ALL")
def facts_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.count_by(mapped(spark, sf_dir), "code")


@query("""SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM (
  SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)) WHERE k = 1""")
def most_common_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.most_common(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL")
def runtime_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return rows.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "p95", "p99")])


ROLES = """texts AS (SELECT o_orderstatus AS role, o_custkey AS doc_id, CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'n/a' ELSE ' ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS runtime FROM orders),
roles AS (SELECT role, count(*) AS pages, count(DISTINCT doc_id) AS docs, round(avg(TRY_CAST(trim(runtime) AS DOUBLE)), 4) AS mean_runtime, max(TRY_CAST(trim(runtime) AS DOUBLE)) AS max_runtime FROM texts GROUP BY role)"""


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderpriority") == "5-LOW", "").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "n/a").otherwise(F.concat(F.lit(" "), F.floor("o_totalprice").cast("long").cast("string")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("role"), F.col("o_custkey").alias("doc_id"), text.alias("runtime"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("doc_id").alias("docs"), F.round(summary.average(F.col("runtime")), 4).alias("mean_runtime"), F.max(F.trim("runtime").try_cast("double")).alias("max_runtime"))


@query(f"WITH {ROLES} SELECT * FROM roles")
def role_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir)


@query(f"""WITH {ROLES}, c AS (SELECT *, concat_ws(';', CASE WHEN NOT pages >= 4950 THEN 'pages' END, CASE WHEN NOT docs >= 3 THEN 'docs' END, CASE WHEN NOT mean_runtime <= 150000 THEN 'mean_runtime' END,
  CASE WHEN NOT max_runtime <= 300000 THEN 'max_runtime' END) AS failed FROM roles) SELECT *, failed = '' AS recommended FROM c""")
def role_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.thresholds(_roles(spark, sf_dir), {"pages": 4950, "docs": 3}, {"mean_runtime": 150_000, "max_runtime": 300_000})


@query(f"WITH {FACTS} SELECT doc_id, statement_type, role, report_date, count(*) AS n FROM facts WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def repeated_export_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.repeated_keys(facts(spark, sf_dir).filter("value IS NOT NULL"), ["doc_id", "statement_type", "role", "report_date"])


@query(f"""WITH {MAPPED}, c AS (SELECT statement_type, count(*) AS facts, count(code) AS mapped, count(*) FILTER (WHERE code IS NOT NULL AND value IS NOT NULL AND status <> 'review') AS exportable FROM mapped GROUP BY ALL)
SELECT *, round(mapped / facts::DOUBLE, 6) AS mapped_ratio, round(exportable / facts::DOUBLE, 6) AS exportable_ratio FROM c""")
def statement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.col("code").isNotNull()
    return summary.coverage(mapped(spark, sf_dir), ["statement_type"], has, has & F.col("value").isNotNull() & (F.col("status") != "review"))


@query(f"""WITH {SIDES}, l AS (SELECT 'year' AS dimension, CAST(year AS VARCHAR) AS value, status FROM cells WHERE benchmark_value IS NOT NULL UNION ALL SELECT 'row', CAST(row AS VARCHAR), status FROM cells WHERE benchmark_value IS NOT NULL)
SELECT dimension, value, count(*) AS cells, count(*) FILTER (WHERE status = 'match') AS matches, round(count(*) FILTER (WHERE status = 'match') / count(*)::DOUBLE, 6) AS recall FROM l GROUP BY ALL""")
def recall_by_period_and_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.recall(_compared(spark, sf_dir), ["year", "row"])


CASES = "concat_ws(';', CASE WHEN status = 'review' THEN 'status_blocked' END, CASE WHEN value IS NULL THEN 'no_value' END, CASE WHEN report_date = 'unknown_date' THEN 'unknown_date' END, CASE WHEN quality < 5 THEN 'low_quality' END)"


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("status_blocked", F.col("status") == "review"), ("no_value", F.col("value").isNull()), ("unknown_date", F.col("report_date") == "unknown_date"), ("low_quality", F.col("quality") < 5)]
    return facts(spark, sf_dir).select("fact_id", "page_no", summary.triggered(cases).alias("reasons"))


@query(f"WITH {FACTS} SELECT reasons, count(*) AS n FROM (SELECT {CASES} AS reasons FROM facts) GROUP BY ALL")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACTS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({CASES}, ';')) AS reason FROM facts) WHERE reason <> '' GROUP BY ALL")
def reason_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.reasons(_failures(spark, sf_dir), "reasons", by=";")


@query(f"WITH {SIDES} SELECT row, year, benchmark_value, abs(benchmark_value) AS size FROM cells WHERE status = 'missing_in_auto' ORDER BY size DESC, row, year LIMIT 100")
def gap_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest gaps: a top-k report."""
    rows = _compared(spark, sf_dir).filter("status = 'missing_in_auto'").select("row", "year", "benchmark_value")
    return summary.largest(rows, "benchmark_value", 100, "row", "year")


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 30) EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200")
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return summary.missing(rows.filter("event_type = 'error' AND value > 30"), rows.filter("event_type = 'purchase' AND value > 200"), ["user_id"])


@query("""WITH own AS (SELECT o_custkey, o_orderstatus, list({'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority} ORDER BY o_orderkey) AS r FROM orders GROUP BY ALL)
SELECT o_custkey, CAST(to_json(map_from_entries(list({'k': o_orderstatus, 'v': r} ORDER BY o_orderstatus))) AS VARCHAR) AS payload FROM own GROUP BY o_custkey""")
def conflict_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.payload(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderkey", "o_orderpriority"])


@query("SELECT event_id, ts FROM events WHERE event_type <> 'error' OR ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = F.when(F.col("event_type") == "error", F.col("ts"))
    return summary.retained(table(spark, sf_dir, "events"), ended, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 7).select("event_id", "ts")


@query("""WITH b AS (SELECT o_orderpriority AS metric, count(*) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
a AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'partly filled' ELSE o_orderpriority END AS metric, count(*) AS value FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
SELECT coalesce(b.metric, a.metric) AS metric, coalesce(b.value, 0)::DOUBLE AS before, coalesce(a.value, 0)::DOUBLE AS after,
round(coalesce(a.value, 0)::DOUBLE - coalesce(b.value, 0)::DOUBLE, 6) AS delta FROM b FULL JOIN a ON b.metric = a.metric""")
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counted = lambda rows, metric: rows.groupBy(metric.alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    name = F.when(F.col("o_orderstatus") == "P", "partly filled").otherwise(F.col("o_orderpriority"))
    return summary.metric_deltas(counted(orders.filter("o_orderstatus = 'F'"), F.col("o_orderpriority")), counted(orders.filter("o_orderstatus <> 'F'"), name))


@query("SELECT o_custkey AS page, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM orders GROUP BY ALL")
def placed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.share(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "page"), ["page"], F.col("o_orderstatus") == "O")
