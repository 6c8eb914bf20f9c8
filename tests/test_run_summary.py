"""Metrics of a run on facts made by hand."""

from factloom.operators import run_summary

FACTS = "status string, code string, issue_flags array<string>, value double, report_date string, statement_type string, period_role string, doc string, page int"


def test_metrics_at_every_grain_from_one_scan(spark):
    rows = [
        ("observed", "c", [], 1.5, "2022", "note", "x", "a", 1),
        ("review", "c", ["repaired_numeric", "n"], -2.0, "unknown_date", "unknown", "unknown", "a", 1),
        ("suppressed", "c", None, 9.0, "unknown_date", "note", "unknown", "a", 2),
        ("repaired", None, None, None, None, None, None, "b", 1),
        (None, "", ["n"], 0.5, "2022", "note", "", "b", 1),
    ]
    facts = spark.createDataFrame(rows, FACTS)
    made = run_summary.fact_metrics(facts, ["doc", "statement_type"])
    got = {(r.grain, r.key): r for r in made.collect()}
    assert set(got) == {("run", None), ("doc", "a"), ("doc", "b"), ("statement_type", "note"), ("statement_type", "unknown"), ("statement_type", None)}
    run = got["run", None]
    counts = dict(zip(run_summary.COUNTS, (5, 4, 1, 2, 2, 1, 1, 1, 2, 1, 3)))
    assert {n: run[n] for n in counts} == counts
    assert (run.amount_total, run.mapped_amount, run.mapped_ratio, run.amount_coverage_ratio) == (4.0, 1.5, 0.5, 0.375)
    assert (got["doc", "b"].active_total, got["doc", "b"].amount_coverage_ratio, got["statement_type", None].mapped_ratio) == (2, 0.0, 0.0)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert run_summary.fact_metrics(facts.limit(0), ["doc"]).collect() == []
    sizes = run_summary.extents(facts, [["doc"], ["doc", "page"]], ["docs", "pages"])
    assert sizes.collect()[0].asDict() == {"docs": 2, "pages": 3, "rows_total": 5}
    assert {r.reason: r.n for r in run_summary.review_reasons(facts).collect()} == {"repaired_numeric": 1, "n": 1}
