"""Column functions on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers, periods, refs, text


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", column(F.col("x")).alias("y")).orderBy("i")
    return [r.y for r in rows.collect()]


def test_printed_numbers(spark):
    cases = {"1,234.5": 1234.5, "(5)": -5.0, "(-5)": -5.0, "12%": 0.12, "(12%)": -12.0, "-3": -3.0, "": None, None: None, "5元": None, "（1，000）": -1000.0, "1 000": 1000.0, "--5": None}
    assert values(spark, list(cases), numbers.try_parse) == pytest.approx(list(cases.values()))
    assert values(spark, ["12%", "(12%)", "x", "", "1.5"], numbers.looks_numeric) == [True, True, False, False, True]


def test_misread_numbers_are_mended_after_cleaning(spark):
    got = values(spark, ["1，2O", "l5", "章", "a", "3", "1元", "", "5。5"], lambda x: numbers.analyze(x, F.lit(True)))
    assert [(r.value, r.status) for r in got] == [(120.0, "repaired"), (15.0, "repaired"), (None, "unresolved"), (None, "unresolved"), (3.0, "parsed"), (None, "unresolved"), (None, "blank"), (5.5, "repaired")]
    assert got[2].reason == "seal_or_stamp_noise|expected_numeric_but_unparseable"
    plain = values(spark, ["l5"], lambda x: numbers.analyze(x, F.lit(False)))[0]
    assert (plain.value, plain.status) == (None, "text")


def test_labels(spark):
    cases = {"1利润": "利润", "注利润": "利润", "其中：利润": ":利润", "一、利润（合计）": "利润", "(2) 减 税": "税", "": "", None: "", "利润：": "利润"}
    assert values(spark, list(cases), text.subject_label) == list(cases.values())
    assert values(spark, ["　a ", "a"], lambda x: text.stable_id("F", x)) == ["F" + "86f7e437faa5"] * 2


def test_dates_in_text(spark):
    got = values(spark, ["2023年1月~6月", "2023年1-6月", "截至2023年 3月5日 2023年度 2023年度", "2023-1/2", "2023年3-5", "1999年度", None], periods.candidates)
    assert [[(c.norm, c.kind) for c in g] for g in got] == [
        [("2023年1月-6月", "range")] * 2, [("2023年1月-6月", "range")], [("2023-03-05", "exact"), ("2023年度", "annual")], [("2023-01-02", "exact")], [], [], [],
    ]


def test_the_best_date_is_vetoed_by_a_close_other_one(spark):
    rows = [("a", "x", 10.0), ("a", "y", 7.0), ("b", "x", 10.0), ("b", "y", 4.0), ("c", "x", 10.0), ("c", "x", 9.0), ("d", "y", 8.0), ("d", "x", 8.0)]
    got = periods.best_candidates(spark.createDataFrame(rows, "g string, norm string, score double"), ["g"])
    assert {r.g: (r.norm, r.worth) for r in got.collect()} == {"a": (None, 12.0), "b": ("x", 12.0), "c": ("x", 14.0), "d": (None, 10.0)}


def test_lists_of_codes_and_boxes(spark):
    assert values(spark, ['["b","a","b"]', "b, a|c", "[b, a", "", None, "[]"], refs.codes) == ["a|b", "a|b|c", "a|b", "", "", ""]
    assert values(spark, ["[0.5, 1.5, 2, 3, 9]", "1,2,3", None], refs.box) == ["0,2,2,3", "", ""]
    assert values(spark, ["a\r\n\n ：b \n　", None], refs.text_lines) == [["a", ":b"], []]
