import math

import duckdb
import pytest

from factloom.llm import mixing

KINDS = "doc_id long, text string, source string, n_chars string, copy string"


def documents():
    rows = [(i, "x" * 100, f"src{i % 5}" if i % 5 < 3 else None, "9", "clash") for i in range(400)]
    return [*rows, (400, "y", "tiny", "1", ""), (401, None, "src0", None, None), (None, "", "src1", "0", "c"), (7, "x" * 100, "src2", "9", "clash")]


@pytest.mark.parametrize("targets", [{"src0": 0.5, "src1": 0.1}, {"tiny": 0.05, "src2": 0.2}])
def test_counts_are_those_of_the_sql(spark, targets):
    """tiny has one character, so its mean is in the thousands: many parts, and no long tables of steps."""
    mix = mixing.Mix(targets=targets, rest=0.4)
    docs = spark.createDataFrame(documents(), KINDS)
    got = mixing.mixed(docs, mix)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    got = sorted(((r.doc_id, r.source, r.copy, r.shuffle_key) for r in got.collect()), key=repr)
    base = duckdb.connect()
    base.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = base.execute(mixing.oracle_sql(mix)).fetchall()
    assert got == sorted((r[:4] for r in want), key=repr)


def test_means_of_many_parts_are_met(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'ab' AS text", "'s' AS source")
    n = mixing.mixed(docs, mixing.Mix(targets={"s": 1.0}, rest=0.0, budget=50.0)).count()
    assert abs(n - 300 * 50) < 5 * math.sqrt(300 * 50)


def test_empty_tables_and_sources_without_characters(spark):
    docs = spark.createDataFrame([(1, None, "src0"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mixed(docs).collect() == []
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_rows_of_one_key_share_out_over_partitions(spark):
    """A third of the rows have one key, another third none, some of them equal."""
    rows = [(5 if k % 3 == 0 else None if k % 3 == 1 else k, f"text {k % 900}", "s") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.Mix(targets={"s": 1.0}, rest=0.0, budget=4.0)
    sizes = mixing.mixed(docs, mix).rdd.glom().map(len).collect()
    assert len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / 4
