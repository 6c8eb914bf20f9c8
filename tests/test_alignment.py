"""Repair of alignment, against the cases of its rules."""

from factloom.operators import alignment

CELL = "cell int, code string, name string, header string, period string, benchmark_value double, auto_value double, status string, reason string"
UNKNOWN, VAGUE = "legacy_header_unsupported", "ambiguous_period_alignment"
RULES = alignment.Rules(roles={"期末": "期末数", "期初": "期初数", "上期": "上期"})


def tables(spark, cells):
    facts = [
        (1, "A", "2022年度__本期", "", "income_statement"), (2, "A", "2022年度__本期", None, "balance_sheet"), (3, "A", "2021__本期", "", "income_statement"),
        (4, "B", "2022年度__本期", "", "cash_flow"), (5, "B", "x__本期", "2021年度", "balance_sheet"), (6, "B", "x__本期", "2021年度", "cash_flow"), (7, "", "2019年度__本期", "", "note"), (8, "C", "2022年度__本期", "", "balance_sheet"),
    ]
    headers = ["2022年度__本期", "2022-12-31__期末数", "2021__上期", "2022__上期", "2022__上期"]
    export = [("A", "2022年度__本期", 5.0), ("A", "2022-12-31__期末数", 7.0), ("B", "2021", 1.0), ("A", "old", None)]
    overrides = [(2, "A", "特", None, "2022-12-31__期末数"), (1, "A", "特", 9.0, "2022年度__本期"), (0, "A", "", 3.25, " "), (3, "D", None, None, "gone")]
    return (
        spark.createDataFrame(cells, CELL),
        spark.createDataFrame(facts, "position int, code string, period string, report_date string, statement_type string"),
        spark.createDataFrame([(h,) for h in headers], "period string"),
        spark.createDataFrame(export, "code string, period string, value double"),
        spark.createDataFrame(overrides, "position int, code string, header string, value double, period string"),
    )


def test_ways_in_their_order(spark):
    missing = "missing_in_auto"
    cases = [
        (("A", "", "特", "", 7.0, missing, UNKNOWN), ("2022-12-31__期末数", 7.0, "match", "numeric_close", "alignment_only_gap")),
        (("A", "", "特", "", 9.0, missing, VAGUE), ("2022年度__本期", 5.0, "value_diff", "numeric_mismatch", "alignment_only_gap")),
        (("A", "", "期末", "", 7.005, missing, UNKNOWN), ("2022-12-31__期末数", 7.0, "match", "numeric_close", "alignment_only_gap")),
        (("B", "", "期末", "", 7.0, missing, UNKNOWN), ("2022-12-31__期末数", None, missing, "legacy_role_repaired:期末", "true_missing")),
        (("A", "", "上期", "", 7.0, missing, UNKNOWN), ("", None, missing, UNKNOWN, "ambiguous_alignment")),
        (("A", "", "期初", "q", 7.0, missing, UNKNOWN), ("q", None, missing, UNKNOWN, "true_missing")),
        (("A", "", " 金额", None, 5.0, missing, UNKNOWN), ("2022年度__本期", 5.0, "match", "numeric_close", "alignment_only_gap")),
        (("B", "", "金额", "", 5.0, missing, UNKNOWN), ("2022年度__本期", None, missing, "legacy_amount_current_period_match", "true_missing")),
        (("C", "营业收入", "金额", "", 5.0, missing, UNKNOWN), ("", None, missing, UNKNOWN, "true_missing")),
        (("E", "营业收入", "金额", "", None, missing, UNKNOWN), ("2022年度__本期", None, "match", "both_empty", "alignment_only_gap")),
        (("A", None, None, "", 5.0, missing, UNKNOWN), ("", None, missing, UNKNOWN, "true_missing")),
        (("A", "", "h", "2022年度__本期", 5.0, missing, "period_key_not_found"), ("2022年度__本期", 5.0, "match", "numeric_close", "alignment_only_gap")),
        (("A", "", "h", "2022年度__本期", 5.0, missing, VAGUE), ("2022年度__本期", 5.0, missing, VAGUE, "true_missing")),
        (("A", "", "h", "", 5.0, missing, VAGUE), ("", None, missing, VAGUE, "ambiguous_alignment")),
        (("A", "", "h", "", 5.0, missing, "period_key_not_found"), ("", None, missing, "period_key_not_found", "true_missing")),
        (("A", "", "h", "2022年度__本期", None, missing, "period_key_not_found"), ("2022年度__本期", 5.0, "extra_in_auto", "period_key_not_found", "alignment_only_gap")),
        (("D", "", "金额", "", 5.0, "value_diff", UNKNOWN), ("", None, "value_diff", UNKNOWN, "unchanged")),
        (("D", "", "金额", "", 5.0, missing, "numeric_close"), ("", None, missing, "numeric_close", "unchanged")),
        (("D", "", "金额", "", 5.0, missing, UNKNOWN), ("gone", None, missing, "runtime_alignment_override", "true_missing")),
        ((None, "", "期末", "", 5.0, missing, UNKNOWN), ("2022-12-31__期末数", None, missing, "legacy_role_repaired:期末", "true_missing")),
    ]
    cells = [(i, c, n, h, p, b, None, s, r) for i, ((c, n, h, p, b, s, r), _) in enumerate(cases)]
    out = alignment.repair(*tables(spark, cells), RULES).cache()
    rows = {r.cell: r for r in out.collect()}
    assert len(rows) == len(cases)
    for i, (given, want) in enumerate(cases):
        r = rows[i]
        assert (r.period or "", r.auto_value, r.status, r.reason, r.alignment) == want, (i, given)
        assert (r.raw_status, r.raw_reason) == given[5:]
    truly = [i for i, (_, w) in enumerate(cases) if w[2] == missing and w[4] != "ambiguous_alignment"]
    counts = alignment.alignment_counts(out).collect()[0]
    assert (counts.missing_raw, counts.missing_true, counts.alignment_only, counts.ambiguous) == (19, len(truly), 7, 2)
    by = {(r.dimension, r.value): r.missing_cells for r in alignment.gap_counts(out).collect()}
    assert by["subject", "A"] == sum(cases[i][0][0] == "A" for i in truly) and by["period", "gone"] == 1 and by["period", "金额"] == 2


def test_empty_tables_and_no_roles(spark):
    assert alignment.repair(*tables(spark, []), RULES).collect() == []
    t = [df.limit(0) for df in tables(spark, [])]
    t[0] = spark.createDataFrame([(1, "A", "", "期末", "", 1.0, None, "missing_in_auto", UNKNOWN)], CELL)
    none = alignment.Rules(amounts=())
    assert [r.alignment for r in alignment.repair(*t, none).collect()] == ["true_missing"]
    assert [r.alignment for r in alignment.repair(*t, RULES).collect()] == ["true_missing"]
