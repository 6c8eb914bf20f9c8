"""Formulas over several levels, and the orders of facts."""

from pyspark.sql import functions as F

from factloom.operators import derive, ranks


def rules_of(spark, rows):
    rules = spark.createDataFrame(rows, "rule string, kind string, target string, child string, sign int")
    return rules.join(rules.groupBy("rule").agg(F.count(F.lit(1)).alias("n_children")), "rule")


def test_levels_follow_the_rules_and_cycles_have_none(spark):
    rows = [("a", "sum", "A", "x", 1), ("a", "sum", "A", "y", 1), ("b", "sum", "B", "A", 1), ("b", "sum", "B", "x", 1), ("c", "sum", "C", "B", 1), ("c", "sum", "C", "A", 1), ("p", "sum", "P", "Q", 1), ("q", "sum", "Q", "P", 1), ("s", "sum", "S", "S", 1), ("w", "sum", "W", "Q", 1)]
    got = {r.rule: r.level for r in derive.rule_levels(rules_of(spark, rows)).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "p": None, "q": None, "s": None, "w": None}
    facts = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 5.0), (2, "A", 7.0), (2, "P", 1.0)], "s int, code string, value double")
    out = derive.levelled_formulas(facts, rules_of(spark, rows), ["s"])
    # Observed values stand before derived ones; rules of a cycle derive nothing, even where a child is observed.
    assert {(r.s, r.target, r.derived, r.level) for r in out.collect()} == {(1, "A", 3.0, 0), (1, "B", 4.0, 1), (1, "C", 7.0, 2), (2, "B", 12.0, 1), (2, "C", 19.0, 2)}
    only = derive.levelled_formulas(facts, rules_of(spark, rows[6:]), ["s"])
    assert only.collect() == [] and set(only.columns) == set(out.columns)


def test_orders_of_facts(spark):
    rows = [
        (1, 1.0, True, "", "observed", "2022年度", "json", "c", ["h"], 2, "accepted", "equal", "本期", "note", "k"),
        (2, 1.0, False, "", "review", "unknown_date", "xlsx_fallback", None, None, 1, None, None, None, "unknown", None),
        (3, None, False, "x", "observed", "2022-12-31", "", "c", ["h", "i"], 1, "accepted_with_validation_support", "conflict", "unknown", "note", ""),
        (4, 2.0, False, "", "observed", "2022年1月-3月", "derived_formula", "c", ["h"], 1, "", "accepted", "本期", "note", "k"),
    ]
    names = "fact_id int, value double, noisy boolean, raw string, status string, date string, source_kind string, code string, path array<string>, provider_place int, decision string, comparison string, role string, statement_type string, table_key string"
    df = spark.createDataFrame(rows, names)
    c = {n.split()[0]: F.col(n.split()[0]) for n in names.split(", ")}
    order = lambda rank: [r.fact_id for r in df.orderBy(*rank(c)).collect()]
    assert order(ranks.among_providers) == [4, 2, 1, 3]
    assert order(ranks.among_duplicates) == [3, 4, 1, 2]
    assert order(ranks.among_exports) == [3, 1, 2, 4]
    assert order(ranks.among_children) == [1, 3, 2, 4]
