"""Operators on rows made by hand."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from factloom.operators import benchmark, export, mapping, reconcile, summary, validation


def test_conflicts_are_decided_as_stated(spark):
    rows = [
        ("equal", "p", 5.0, False), ("equal", "q", 5.0, True),
        ("clean", "p", 5.0, False), ("clean", "q", 6.0, True),
        ("open", "p", 5.0, False), ("open", "q", 6.0, False),
        ("tenfold", "p", 5.0, False), ("tenfold", "q", 50.0, True),
        ("hundredfold", "p", 1.0, False), ("hundredfold", "q", -100.0, False),
        ("single", "p", 5.0, True), ("single", "q", None, False),
        ("none", "p", None, True), ("none", "q", None, False),
        ("alone", "p", 5.0, True), ("alone", "p", 6.0, True),
        ("zero", "p", 0.0, False), ("zero", "q", 500.0, False),
    ]
    facts = spark.createDataFrame(rows, "k string, provider string, value double, noisy boolean")
    got = reconcile.conflict_winners(facts, ["k"], F.lit(1), F.lit(3), F.col("noisy"), [F.col("value")])
    assert {r.k: (r.decision, r.reason, r.winner, r.winning_value) for r in got.collect()} == {
        "equal": ("accepted", "equal", "p", 5.0),
        "clean": ("accepted_with_rule_support", "clean_numeric_beats_noisy_candidate", "p", 5.0),
        "open": ("review_required", "multiple_numeric_candidates_need_review", None, None),
        "tenfold": ("review_required", "magnitude_ratio_requires_review", None, None),
        "hundredfold": ("review_required", "magnitude_ratio_exceeds_force_threshold", None, None),
        "single": ("accepted_with_rule_support", "single_clean_numeric_candidate", "p", 5.0),
        "none": ("unresolved", "no_numeric_candidate_available", None, None),
        "zero": ("review_required", "multiple_numeric_candidates_need_review", None, None),
    }


def test_balance_keeps_the_sign_and_leaves_out_facts_in_review(spark):
    rows = [(1, "A", 100.0, "observed"), (1, "L", 60.0, "observed"), (1, "E", 45.0, "observed"), (2, "A", 9.0, "observed"), (2, "L", 9.0, "review"), (2, "E", 0.5, "observed"), (3, "A", 2e4, "observed"), (3, "L", 3e4, "observed"), (3, "E", -10001.5, "observed")]
    facts = validation.checked(spark.createDataFrame(rows, "d int, t string, value double, status string"))
    got = validation.balance(facts, ["d"], {"assets": F.col("t") == "A", "liabilities": F.col("t") == "L", "equity": F.col("t") == "E"}, [F.col("value")])
    assert {r.d: (r.difference, r.status) for r in got.collect()} == {1: (-5.0, "fail"), 2: (None, "skipped"), 3: (1.5, "pass")}


def test_subtotals_stop_at_the_total_before(spark):
    rows = [(1, 1.0, False), (2, 2.0, False), (3, 3.0, True), (4, 9.0, False), (5, 9.0, True), (6, 1.0, False), (7, 4.0, False), (8, 7.5, True)]
    got = validation.subtotals(spark.createDataFrame(rows, "row int, value double, total boolean").withColumn("g", F.lit(1)), ["g"], "row", F.col("total"))
    assert {r.row: (r.details, r.status) for r in got.collect()} == {3: (2, "pass"), 5: (1, "skipped"), 8: (2, "fail")}


def test_duplicates_in_two_passes(spark):
    rows = [(1, "2020", 5.0, 1), (1, "2020", 5.0, 2), (2, "2020", 5.0, 3), (2, "2020", 6.0, 4), (3, "2020", 7.0, 5), (3, "unknown_date", 7.0, 6), (4, "unknown_date", 7.0, 7)]
    facts = spark.createDataFrame(rows, "k int, date string, value double, id int")
    first = reconcile.dedupe_strict(facts, ["k", "date"], [F.col("id")])
    assert {r.id: r.dedupe for r in first.collect()} == {1: "kept", 2: "dropped", 3: "review_kept_both", 4: "review_kept_both", 5: "kept", 6: "kept", 7: "kept"}
    second = reconcile.dedupe_explicit_date(first.filter("dedupe <> 'dropped'"), ["k", "value"], "date", [F.col("id")])
    assert {r.id for r in second.collect() if not r.kept} == {6}


def test_the_exported_fact_of_a_cell(spark):
    rows = [("one", 1, 1.0, False, False), ("same", 2, 1.0, False, False), ("same", 3, 1.0, True, False), ("accepted", 4, 1.0, False, False), ("accepted", 5, 2.0, True, False), ("open", 6, 1.0, True, False), ("open", 7, 2.0, True, False), ("preferred", 8, 1.0, True, False), ("preferred", 9, 2.0, False, True), ("blank", 10, None, False, False), ("blank", 11, 0.0, False, False)]
    facts = spark.createDataFrame(rows, "cell string, id int, value double, ok boolean, first boolean")
    got = export.export_winners(facts, ["cell"], [F.col("id")], accepted=F.col("ok"), preferred=F.col("first"))
    assert {r.id: r.export for r in got.collect()} == {
        1: "exported", 2: "exported", 3: "duplicate_same_value_not_exported", 4: "replaced_by_resolved_candidate", 5: "exported", 6: "multiple_export_candidates", 7: "multiple_export_candidates",
        8: "shadow_preferred_other_candidate", 9: "exported", 10: "exported", 11: "duplicate_same_value_not_exported",
    }


def test_mapping_takes_the_last_code_of_a_name_and_exact_aliases_first(spark):
    subjects = spark.createDataFrame([("x", "9", 1), ("x", "1", 2)], "name string, code string, position int")
    aliases = spark.createDataFrame([("y", "3", False), ("y", "4", True), ("x", "5", True), ("z", "7", False), ("z", "6", False)], "alias string, code string, exact boolean")
    facts = spark.createDataFrame([("x",), ("y",), ("z",), ("w",), (None,)], "label string")
    got = {r.label: (r.code, r.method, r.confidence) for r in mapping.cascade(facts, subjects, aliases).collect()}
    assert got == {"x": ("1", "exact", 1.0), "y": ("4", "exact_alias", 0.95), "z": ("6", "legacy_alias", 0.9), "w": (None, "unmapped", 0.0), None: (None, "unmapped", 0.0)}


def similarity(x, y):
    ends = 0.08 * (x.startswith(y) or y.startswith(x)) + 0.05 * (x.endswith(y) or y.endswith(x))
    return min(1.0, 0.55 * SequenceMatcher(None, x, y).ratio() + 0.35 * len(set(x) & set(y)) / len(set(x) | set(y)) + ends)


def test_fuzzy_candidates_are_those_of_a_full_comparison(spark):
    labels = ["abcd", "利润总额", "营业收入", "ab", "x", "应收账款净额", "abab", ""]
    names = ["axbxcxd", "利润", "利润总额", "营业总收入", "dcba", "x", "ba", "应收账款", "应收票据"]
    got = mapping.fuzzy_candidates(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(n, str(k)) for k, n in enumerate(names)], "name string, code string"), top=10)
    want = {(x, str(k)): round(similarity(x, n), 9) for x in labels if x for k, n in enumerate(names) if similarity(x, n) >= 0.62}
    assert {(r.label, r.code): round(r.score, 9) for r in got.collect()} == want


def test_amounts_exactly_at_the_tolerance_meet(spark):
    gaps = spark.createDataFrame([(1, 0.29), (2, 5.0)], "gap int, amount double").withColumn("p", F.lit("a"))
    facts = spark.createDataFrame([(7, 0.30), (8, 0.28), (9, 5.02), (10, 4.99)], "fact int, value double").withColumn("p", F.lit("a"))
    assert {(r.gap, r.fact) for r in benchmark.near_amounts(gaps, facts, ["p"]).collect()} == {(1, 7), (1, 8), (2, 10)}


def test_summaries(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "x", 2), ("a", "", 3), ("a", "4", 4), ("b", None, 5), ("b", "2", 6)], "g string, t string, i int")
    got = rows.groupBy("g").agg(summary.average(F.col("t")).alias("m"))
    assert {r.g: r.m for r in got.collect()} == {"a": 2.5, "b": 2.0}
    assert {r.value: r.n for r in summary.count_by(rows, "t").collect()} == {"": 2, "1": 1, "x": 1, "4": 1, "2": 1}
    assert {r.g: r.t for r in summary.most_common(rows.filter("t IS NOT NULL"), ["g"], "t", "i").collect()} == {"a": "1", "b": "2"}
    gates = summary.thresholds(spark.createDataFrame([(1.0, 9.0), (3.0, 1.0), (None, 1.0)], "x double, y double"), {"x": 2}, {"y": 5})
    assert [(r.failed, r.recommended) for r in gates.collect()] == [("x;y", False), ("", True), ("x", False)]
    assert [tuple(r) for r in summary.missing(rows.select("g"), rows.filter("g = 'a'"), ["g"]).collect()] == [("b",)]


def test_deltas_and_shares(spark):
    before = spark.createDataFrame([("x", 1.5), ("gone", 2.0), ("none", None)], "metric string, value double")
    after = spark.createDataFrame([("x", 4.0), ("new", 3.0)], "metric string, value double")
    got = {tuple(r) for r in summary.metric_deltas(before, after).collect()}
    assert got == {("x", 1.5, 4.0, 2.5), ("gone", 2.0, 0.0, -2.0), ("none", 0.0, 0.0, 0.0), ("new", 0.0, 3.0, 3.0)}
    rows = spark.createDataFrame([(1, True), (1, None), (1, False), (None, True)], "page int, box boolean")
    assert {tuple(r) for r in summary.share(rows, ["page"], rows["box"]).collect()} == {(1, 0.333333), (None, 1.0)}


def test_conflict_groups_send_each_row_once(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 2, None), ("b", 1, 1.0), ("c", None, 4.0), ("c", 1, 4.0), ("d", 1, 5.0), ("d", 2, 5.0)], "k string, provider int, value double")
    found = reconcile.conflict_groups(rows, ["k"])
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: (r.n_providers, r.n_values, r.comparison) for r in found.collect()} == {"a": (2, 2, "conflict"), "d": (2, 1, "equal")}
