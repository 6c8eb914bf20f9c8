"""Scopes of facts, backlogs of review items, boxes of evidence."""

import json
import math
import random

import pytest

from factloom.operators import evidence, target

FACT = "fact_id string, code string, statement_type string, source_kind string, row_label_canonical string, row_label_norm string, row_label_std string, row_label_raw string"


def test_scopes_in_their_order(spark):
    rows = [
        ("a", "P1", "note", "derived_formula", "", "", "", ""),
        ("b", "X", "note", "derived_formula", "", "", "", "公司"),
        ("c", "B", None, "json", None, None, None, None),
        ("d", "X", "cash_flow", "json", "合计", "", "", ""),
        ("e", None, "cash_flow", "json", "", None, "现金合计", "other"),
        ("f", "X", "note", "json", "", "", "", "账龄"),
        ("g", "X", "note", "", "", "", "", "rent"),
        ("h", "", None, None, "", "某某公司", "", ""),
        ("i", "", "cash_flow", "json", " 　", "公司", "", ""),
        ("j", "", "cash_flow", "json", "", "", "Page 3", ""),
        ("k", "", "cash_flow", "json", "", "", "cash", ""),
        ("l", "X", "other", "json", "", "", "cash", ""),
        ("m", "P2", "other", "json", "", "", "cash", ""),
    ]
    facts = spark.createDataFrame(rows, FACT).selectExpr("*", "'old' AS target_scope", "1 AS position")
    benchmark = spark.createDataFrame([("B", 1), ("B", 2), ("", 3), (None, 4), ("P1", 5)], "code string, n int")
    promoted = spark.createDataFrame([(2, "P1", "main_export_target"), (1, "P1", "note_detail"), (3, "P2", None), (4, "", "x"), (5, None, "x")], "position int, code string, target_scope string")
    got = {r.fact_id: (r.target_scope, r.target_scope_reason) for r in target.scoped(facts, benchmark, promoted, target.Rules(noise=(r"^PAGE \d", " "))).collect()}
    main, note, noise = "main_export_target", "note_detail", "non_target_noise"
    assert got == {
        "a": (note, "promoted_target_rule"), "b": ("derived_target", "source_kind:derived_formula"), "c": (main, "benchmark_row_membership"), "d": (main, "main_statement:cash_flow"),
        "e": ("note_aggregation", "note_aggregation_pattern"), "f": (note, "note_detail_pattern"), "g": (note, "statement_type:note"), "h": (note, "detail_bucket_pattern"), "i": (noise, "non_target_noise_pattern"),
        "j": (noise, "non_target_noise_pattern"), "k": (main, "main_statement_unmapped:cash_flow"), "l": (noise, "fallback_non_target"), "m": (main, "promoted_target_rule"),
    }
    assert target.scoped(facts.limit(0), benchmark, promoted).collect() == []


def test_backlogs_of_review_items(spark):
    facts = spark.createDataFrame([("a", ""), ("b", "note_detail"), ("c", "main_export_target"), ("d", None)], "fact_id string, target_scope string")
    rows = [("1", ["a", "b", "c"], "cash_flow", "mapping_only"), ("2", ["c", "b"], "note", "mapping_only"), ("3", ["x", "d"], "note", "conflict"), ("4", [], "income_statement", None), ("5", None, None, "mapping_only"), ("6", ["a", None], "note", "header_or_structure_noise")]
    reviews = spark.createDataFrame(rows, "review_id string, related_fact_ids array<string>, statement_type string, review_category string")
    got = {r.review_id: (r.target_scope, r.backlog) for r in target.review_scopes(reviews, facts).collect()}
    assert got == {"1": ("note_detail", "note_suppressed"), "2": ("main_export_target", "main"), "3": ("note_detail", "note"), "4": ("main_export_target", "main"), "5": ("non_target_noise", "note"), "6": ("note_detail", "note_suppressed")}


CELL = "position int, doc_id string, page_no int, provider string, table_id string, row_start int, row_end int, col_start int, col_end int, bbox_json string"


def plain_union(texts):
    found = []
    for text in texts:
        try:
            parsed = json.loads(text or "")
        except json.JSONDecodeError:
            continue
        found += [(p["x"], p["y"]) for p in (parsed.get("points", []) if isinstance(parsed, dict) else parsed) if "x" in p and "y" in p]
    if not found:
        return []
    xs, ys = zip(*found)
    return [math.trunc(min(xs)), math.trunc(min(ys)), math.trunc(max(xs)), math.trunc(max(ys))]


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_are_unions_of_all_cells_of_the_row_and_table(spark, seed):
    rnd = random.Random(seed)

    def box():
        points = [{"x": rnd.uniform(-9, 99), "y": rnd.uniform(-9, 99)} for _ in range(rnd.randrange(4))] + [{"x": 1.0}] * rnd.randrange(2)
        return rnd.choice([json.dumps(points), json.dumps({"points": points}), "", None, "[broken", "{}", json.dumps({"other": 1})])

    cells = [(i, rnd.choice("ab"), rnd.randrange(2), rnd.choice(["p", None]), "t", rnd.randrange(3), 1, rnd.randrange(3), 2, box()) for i in range(60)]
    ref = lambda c: f"{c[1]}:{c[2]}:{c[3] or ''}:{c[4]}:{c[5]}-{c[6]}:{c[7]}-{c[8]}"
    asked = [(str(i), json.dumps({"source_cell_ref": ref(c)})) for i, c in enumerate(cells)] + [("x", "{broken"), ("y", None), ("z", '{"source_cell_ref": "nowhere"}'), ("v", "{}")]
    got = {r.review_id: r for r in evidence.boxes(spark.createDataFrame(asked, "review_id string, meta_json string"), spark.createDataFrame(cells, CELL)).collect()}
    assert len(got) == len(asked) and all(got[k].status == "no_bbox" and got[k].cell_bbox is None for k in "xyzv")
    last = {ref(c): c for c in cells}
    for i, c in enumerate(cells):
        own, r = last[ref(c)], got[str(i)]
        if not own[9]:
            assert r.status == "no_bbox"
            continue
        table = [x for x in cells if x[1:5] == own[1:5]]
        assert (r.status, r.cell_bbox) == ("bbox_only", plain_union([own[9]]))
        assert r.row_bbox == plain_union([x[9] for x in table if x[5] == own[5]]) and r.table_bbox == plain_union([x[9] for x in table])


def test_shares_of_tables_with_boxes(spark):
    rows = [(1, "a", 1, "p", "t", 0, 0, 0, 0, '[{"x": 1, "y": 2}]'), (2, "a", 1, "p", "t", 0, 0, 0, 0, ""), (3, "a", 1, "p", "u", 0, 0, 0, 0, "[]"), (4, "b", 1, "p", "t", 0, 0, 0, 0, None)]
    got = {r.doc_id: (r.tables, r.with_boxes, r.coverage) for r in evidence.box_coverage(spark.createDataFrame(rows, CELL), ["doc_id"]).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}
