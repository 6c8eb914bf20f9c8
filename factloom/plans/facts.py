"""Facts and other inputs of the operators, as views of the driver's tables.

Each adapter has its SQL twin, which the oracles use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts: parts are documents, line numbers pages, suppliers providers."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("doc_id"),
        F.col("l_linenumber").alias("page_no"),
        (F.col("l_suppkey") % 3).alias("provider"),
        F.col("l_returnflag").alias("statement_type"),
        F.col("l_linestatus").alias("role"),
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_tax") > 0.07, "unknown_date").otherwise(F.concat(F.year("l_shipdate").cast("string"), F.lit("年度"))).alias("report_date"),
        F.when(F.col("l_discount") >= 0.09, None).otherwise(F.col("l_extendedprice")).alias("value"),
        F.col("l_quantity").alias("quality"),
        F.when(F.col("l_tax") < 0.01, "review").when(F.col("l_tax") < 0.02, "repaired").otherwise("observed").alias("status"),
        F.col("l_orderkey").alias("fact_id"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


FACTS = """facts AS (
  SELECT l_partkey AS doc_id, l_linenumber AS page_no, l_suppkey % 3 AS provider, l_returnflag AS statement_type,
         l_linestatus AS role, CAST(year(l_shipdate) AS INTEGER) AS year,
         CASE WHEN l_tax > 0.07 THEN 'unknown_date' ELSE CAST(year(l_shipdate) AS VARCHAR) || '年度' END AS report_date,
         CASE WHEN l_discount >= 0.09 THEN NULL ELSE l_extendedprice END AS value, l_quantity AS quality,
         CASE WHEN l_tax < 0.01 THEN 'review' WHEN l_tax < 0.02 THEN 'repaired' ELSE 'observed' END AS status,
         l_orderkey AS fact_id, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""

#: The key under which providers are compared.
KEY = ["doc_id", "page_no", "statement_type", "role"]


def order() -> list:
    """A total order on facts up to equal rows: status, quality, then the rest."""
    from factloom.operators.reconcile import status_rank

    return [-status_rank(F.col("status")), -F.col("quality"), F.col("fact_id"), F.col("value"), F.col("tax"), F.col("discount"), F.col("year"), F.col("provider")]


ORDER = "CASE status WHEN 'observed' THEN -5 WHEN 'repaired' THEN -4 ELSE -1 END, -quality, fact_id, value, tax, discount, year, provider"


#: A chart of accounts for the kinds of parts: (name, code, position), and what else names are called: (alias, code, exact).
SUBJECTS = "(VALUES ('STANDARD', '1001', 1), ('STANDARD', '1000', 2), ('MEDIUM', '1003', 3)) AS subjects(name, code, position)"
ALIASES = "(VALUES ('LARGE', '1004', true), ('LARGE', '1009', false), ('ECONOMY', '1006', false), ('ECONOMY', '1005', false)) AS aliases(alias, code, exact)"


def subjects(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {SUBJECTS}")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {ALIASES}")


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with the label of their document, its code, and how it was found."""
    from factloom.operators import mapping

    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("label"))
    return mapping.cascade(facts(spark, sf_dir).join(labels, "doc_id"), subjects(spark), aliases(spark))


MAPPED = f"""{FACTS}, mapped AS (
  SELECT f.*, p_type AS label, coalesce(s.code, a.code) AS code,
         CASE WHEN s.code IS NOT NULL THEN 'exact' WHEN a.exact THEN 'exact_alias' WHEN a.code IS NOT NULL THEN 'legacy_alias' ELSE 'unmapped' END AS method,
         CASE WHEN s.code IS NOT NULL THEN 1.0::DOUBLE WHEN a.exact THEN 0.95::DOUBLE WHEN a.code IS NOT NULL THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence
  FROM facts f JOIN part ON f.doc_id = p_partkey
  LEFT JOIN (SELECT name, arg_max(code, position) AS code FROM {SUBJECTS} GROUP BY name) s ON p_type = s.name
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY NOT exact, code) AS n FROM {ALIASES}) WHERE n = 1) a ON p_type = a.alias)"""
