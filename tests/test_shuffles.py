"""What grows with the input: shuffles, sorts before them, and how often a step is computed."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from factloom import plans
from factloom.operators import alias_join, evidence, ranks, semantics

SMALL = "/root/testdata/sf0.001"
CELL = "position long, doc_id string, page_no int, provider string, table_id string, row_start int, row_end int, col_start int, col_end int, bbox_json string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


def test_boxes_shuffle_cells_once_by_table_and_once_by_reference(spark):
    # The review items' own distinct references are a shuffle, and their join with the cells.
    assert shuffles(plans.QUERIES["evidence_boxes"](spark, SMALL)) <= 4


def test_one_reference_of_two_places_takes_the_last_cell(spark):
    box = lambda x: json.dumps([{"x": x, "y": x}])
    cells = [(1, "a:1", 1, "p", "t:", 0, 0, 0, 0, box(1)), (2, "a:1", 1, "p:t", "", 0, 0, 0, 0, box(2)), (1, "b", 1, None, "t", 0, 0, 0, 0, box(3)), (2, "b", 1, "", "t", 0, 0, 0, 0, "")]
    asked = [("x", json.dumps({"source_cell_ref": "a:1:1:p:t::0-0:0-0"})), ("y", json.dumps({"source_cell_ref": "b:1::t:0-0:0-0"}))]
    out = evidence.boxes(spark.createDataFrame(asked, "id string, meta_json string"), spark.createDataFrame(cells, CELL))
    got = {r.id: (r.status, r.cell_bbox, r.table_bbox) for r in out.collect()}
    assert got == {"x": ("bbox_only", [2, 2, 2, 2], [2, 2, 2, 2]), "y": ("no_bbox", None, None)}


@pytest.mark.parametrize("name", ["conflict_impacts", "conflict_decisions", "decisions_applied"])
def test_conflicts_are_judged_in_one_dealing_of_facts(spark, name):
    # Nothing is written between; only the counts of decisions_applied are a second shuffle.
    text = plan(plans.QUERIES[name](spark, SMALL))
    assert text.count("Exchange hashpartitioning") == 1 + (name == "decisions_applied")
    assert text.count("FileScan") == 1 and "FileScan parquet [l_" in text and "Join" not in text


RANKED = "value double, noisy boolean, raw string, status string, date string, source_kind string, code string, n int, provider_place int, comparison string, decision string, role string, table_key string, statement_type string, fact_id long"


@pytest.mark.parametrize("order", list(ranks.SPANS), ids=lambda o: o.__name__)
def test_packed_ranks_sort_as_the_order_does(spark, order):
    some = itertools.product([None, 1.0], [True, None], ["", "x"], ["observed", "review", None, "repaired"], ["2022-12-31", "unknown_date", "1月"], ["json", "", None, "xlsx_fallback", "derived_formula"])
    rest = itertools.cycle(itertools.product(["c", "", None], [0, 2, 1_000_000], [0, 16_000_000, None], ["accepted", None], ["accepted", "", "accepted_with_rule_support"], ["unknown", "x"], ["", "k"], ["unknown", "note"]))
    rows = [(*a, *b, i) for i, (a, b) in enumerate(zip(some, itertools.islice(rest, 0, None, 7)))]
    df = spark.createDataFrame(rows, RANKED)
    c = {n: F.col(n) for n in df.columns} | {"path": F.when(F.col("n") < 9, F.sequence(F.lit(0), F.col("n")))}
    own = df.select("fact_id", ranks.packed(order, c).alias("p"), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order(c))]).alias("o")).collect()
    assert [r.fact_id for r in sorted(own, key=lambda r: (r.p, r.fact_id))] == [r.fact_id for r in sorted(own, key=lambda r: tuple((x is not None, x or 0) for x in r.o))]


def test_choices_sort_nothing_before_their_one_shuffle(spark):
    df = plans.QUERIES["ranked_choices"](spark, SMALL)
    assert shuffles(df) == 1 and "Sort" not in plan(df).split("Exchange hashpartitioning")[1]


def test_workbooks_are_made_and_parsed_once(spark):
    text = plan(plans.QUERIES["workbook_tables"](spark, SMALL))
    assert "Arrow" not in text and "Pandas" not in text


def test_keys_of_rows_take_one_shuffle(spark):
    assert shuffles(plans.QUERIES["semantic_keys"](spark, SMALL)) == 1


def test_keys_with_gaps_and_heads_close_together(spark):
    rows = [(0, ["x", "1"]), (1, ["项目", "金额"]), (2, ["a", "2"]), (4, ["b", "3"]), (5, ["项目", "比例"]), (6, ["c", "4"]), (7, ["", "5"]), (11, ["d", "6"])]
    df = spark.createDataFrame([("t", r, t) for r, t in rows] + [(None, 0, ["y", "1"])], "t string, row int, texts array<string>")
    df = df.select("*", F.lit(0).alias("label_col"), F.lit(None).cast("int").alias("line_col"), F.array(F.lit(1)).alias("value_cols"), F.lit("s").alias("statement_type"))
    got = {r.row: (r.header_row, r.row_key, r.table_key) for r in semantics.keyed(df, ["t"]).collect()}
    one, two, whole = "s|t:x|h:项目,金额|r:a,b", "s|t:b|h:项目,比例|r:c", "s|h:x|r:项目,a,b"
    assert got == {0: (0, "s|h:x|r:no_rows", whole)} | {r: (1, one, whole) for r in (1, 2, 4)} | {r: (5, two, whole) for r in (5, 6, 7, 11)}


@pytest.fixture
def without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scopes_leave_facts_where_they_are(spark, without_broadcasts):
    assert "SortMergeJoin" not in plan(plans.QUERIES["target_scopes"](spark, SMALL))


def test_alignment_reads_facts_twice_and_shuffles_no_cell_by_its_header(spark, without_broadcasts):
    # Once for the hints of codes, once for the export.
    text = plan(plans.QUERIES["alignment_counts"](spark, SMALL))
    assert text.count("l_orderkey") and text.count("FileScan parquet [l_") == 2 and text.count("SortMergeJoin") == 4


def test_mapped_facts_are_not_cleaned_one_by_one(spark):
    facts = spark.createDataFrame([("1.cash", "A", None, None, 1.0), ("cash ", "A", "", None, 2.0), ("other", "A", "C9", "m", 3.0), (None, "A", None, None, 4.0), ("zzz", None, None, None, 5.0)], "label string, statement_type string, code string, method string, value double")
    subjects = spark.createDataFrame([("cash", "C1", 1)], "name string, code string, position int")
    aliases = spark.createDataFrame([], "alias string, code string, kind string, statements array<string>")
    relations = spark.createDataFrame([], "code string, name string, kind string, related array<string>, review boolean")
    done, candidates = alias_join.mapped(facts, subjects, aliases, relations)
    assert "regexp" not in plan(done).lower()
    assert sorted((r.value, r.code, r.method) for r in done.collect()) == [(1.0, "C1", "exact"), (2.0, "C1", "exact"), (3.0, "C9", "m"), (4.0, None, None), (5.0, None, None)]
    assert alias_join.statistics(done).collect()[0].mapped_by_exact == 2
