"""Actions of reviewers: reasons, entries, versions and effects."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import overrides

ACTION = ["position", "review_id", "action_type", "action_value", "fact_id", "source_cell_ref", "row_label_std", "candidate_mapping_code", "candidate_mapping_name", "candidate_conflict_fact_id", "related_conflict_ids", "reviewer_note"]
FACT = "fact_id string, position int, source_cell_ref string, row_label_std string, row_label_raw string, code string, name string, period_key string, report_date string, period_role string, status string, unplaced string, conflict_id string, provider string"


def actions_of(spark, *rows):
    kind = ", ".join(f"{c} {'int' if c == 'position' else 'string'}" for c in ACTION)
    return spark.createDataFrame([tuple(r.get(c) for c in ACTION) for r in rows], kind)


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame([("r1",), ("r2",), ("r3",), (None,)], "review_id string")


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame([("A", "cash"), ("B", "goods")], "code string, name string")


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("f1", 1, "s1", "Cash at bank", None, "", "", "2020__x", "2020", "x", "observed", "", "c1", "p"),
        ("f2", 2, "s2", None, "Cash at bank", "", "", "2020__x", "2020", "x", "review", None, "c1", "q"),
        ("f3", 3, "s2", "other", None, "Z", "z", "2020__x", "2020", "x", "observed", "late", "c1", "q"),
        ("f4", 4, None, None, None, "", "", None, None, None, "observed", "", None, None),
    ]
    return spark.createDataFrame(rows, FACT)


def test_reasons_against_actions(spark, reviews):
    kinds = [("", None), (None, None), ("fly", "unsupported_action_type"), ("set_mapping_override", "mapping_code_missing"), ("accept_mapping_alias", "mapping_code_missing"), ("set_conflict_winner", "conflict_winner_missing"), ("set_period_override", "period_override_missing"), ("request_reocr", "reocr_task_missing"), ("ignore", None), ("defer", None), ("suppress_false_positive", None), ("mark_not_financial_fact", None), ("accept_relation_review_only", None)]
    rows = [{"position": i, "review_id": " r1 ", "action_type": k} for i, (k, _) in enumerate(kinds)] + [{"position": 99, "review_id": "r9", "action_type": "defer"}, {"position": 98, "action_type": "defer"}]
    got = {r.position: r.reject_reason for r in overrides.validated(actions_of(spark, *rows), reviews).collect()}
    assert got == {i: why for i, (k, why) in enumerate(kinds) if k} | {99: "review_id_not_found", 98: "review_id_not_found"}


def test_entries_versions_and_their_effects(spark, reviews, subjects, facts):
    rows = [
        dict(position=1, review_id="r1", action_type="accept_mapping_alias", action_value="A", row_label_std="Cash at bank"),
        dict(position=2, review_id="r2", action_type="set_mapping_override", candidate_mapping_code="B", source_cell_ref="s2"),
        dict(position=3, review_id="r2", action_type="set_mapping_override", action_value="nobody's", source_cell_ref="s2"),
        dict(position=4, review_id="r1", action_type="set_period_override", action_value="2021-12-31__end__of", source_cell_ref="s1", reviewer_note="seen"),
        dict(position=5, review_id="r1", action_type="set_period_override", action_value="2019", source_cell_ref="s2"),
        dict(position=6, review_id="r2", action_type="suppress_false_positive", fact_id="f3"),
        dict(position=7, review_id="r3", action_type="ignore"),
        dict(position=8, review_id="r3", action_type="defer"),
        dict(position=9, review_id="r3", action_type="set_mapping_override", action_value="A", fact_id="f3"),
        dict(position=10, review_id="r3", action_type="set_mapping_override", action_value="A", fact_id="f3", reviewer_note="again"),
    ]
    found = overrides.entries(overrides.validated(actions_of(spark, *rows), reviews))
    by = {r.position: r for r in found.collect()}
    assert 9 not in by and by[10].note == "again" and len(by) == 9
    assert (by[8].kind, by[8].new_state, by[8].message) == ("", "deferred", "deferred_no_override_written")
    assert by[1].target_id == "A" and by[1].alias == "Cash at bank" and by[6].target_id == "f3" and by[4].target_id == "r1"
    dimension = overrides.versions(found, subjects)
    held = overrides.standing(dimension)
    out = {r.fact_id: r for r in overrides.suppressed(overrides.dated(overrides.mapped(facts, held, subjects), held), held).collect()}
    assert [(out[f].code, out[f].name, out[f].mapping_method) for f in ("f1", "f2", "f3", "f4")] == [("A", "cash", "manual_alias"), ("B", "goods", "manual_override"), ("A", "cash", "manual_override"), ("", "", "")]
    assert [(out[f].period_key, out[f].report_date, out[f].period_role, out[f].period_reason) for f in ("f1", "f2", "f4")] == [("2021-12-31__end__of", "2021-12-31", "end__of", "seen"), ("2019", "2020", "x", "manual_period_override"), (None, None, None, "")]
    assert (out["f3"].status, out["f3"].suppression_reason, out["f3"].unplaced) == ("suppressed", "suppress_false_positive", "late")
    assert (out["f2"].status, out["f2"].unplaced, out["f4"].override_source) == ("review", None, "")
    # Before position 10 the cell's entry holds for f3.
    early = overrides.standing(dimension, F.lit(9))
    assert {r.fact_id: r.code for r in overrides.mapped(facts, early, subjects).collect()} == {"f1": "A", "f2": "B", "f3": "B", "f4": ""}
    assert {r.review_id for r in overrides.open_reviews(reviews, found).collect()} == {"r1", "r2", None}
    new = dimension.filter("position >= 5")
    assert {r.fact_id for r in overrides.touched(facts, new).collect()} == {"f2", "f3"}
    assert {r.fact_id for r in overrides.touched(facts, dimension).collect()} == {"f1", "f2", "f3"}


def test_versions_end_where_the_next_begins(spark, reviews, subjects):
    rows = [dict(position=p, review_id="r1", action_type="set_mapping_override", action_value=v, fact_id="f1") for p, v in ((1, "A"), (2, "X"), (5, "B"))]
    dimension = overrides.versions(overrides.entries(overrides.validated(actions_of(spark, *rows), reviews)), subjects)
    assert {(r.code, r.valid_from, r.valid_to) for r in dimension.collect()} == {("A", 1, 5), ("B", 5, None)}
    assert [r.code for r in overrides.standing(dimension, F.lit(4)).collect()] == ["A"] and overrides.standing(dimension, F.lit(0)).collect() == []


def test_winners_of_conflicts(spark, reviews, facts):
    conflicts = spark.createDataFrame([("c1", "open", "", None, None, True), ("c2", "open", "", None, None, True)], "conflict_id string, decision string, reason string, accepted_provider string, accepted_fact_id string, needs_review boolean")
    ask = lambda p, value, **more: dict(position=p, review_id="r1", action_type="set_conflict_winner", action_value=value, related_conflict_ids="c1, c2", **more)

    def after(*rows, merge=True):
        out, done = overrides.decided(facts, conflicts, overrides.entries(overrides.validated(actions_of(spark, *rows), reviews)), merge)
        return {r.fact_id: (r.status, r.conflict_decision) for r in out.collect()}, {r.conflict_id: (r.decision, r.accepted_provider, r.accepted_fact_id, r.needs_review, r.reason) for r in done.collect()}

    support = "accepted_with_rule_support"
    seen, done = after(ask(1, "f1"), ask(2, "provider:q"), ask(3, "provider:nobody"), ask(4, "f99"))
    assert seen == {"f1": ("conflict", support), "f2": ("observed", support), "f3": ("conflict", support), "f4": ("observed", "")}
    assert done == {"c1": (support, "q", "f2", False, "manual_conflict_override"), "c2": ("open", None, None, True, "")}
    seen, done = after(ask(1, "f1", reviewer_note="why"), merge=False)
    assert seen["f2"] == ("review", support) and done["c1"] == (support, "p", "f1", False, "why")
    assert after()[1]["c1"][0] == "open"
