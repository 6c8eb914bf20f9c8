"""The near-name join and the mapping cascade against full comparisons."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from factloom.operators import alias_join as aj


def plain_score(a, b):
    if a == b:
        return 1.0, "exact_normalized_match"
    s = SequenceMatcher(None, a, b).ratio()
    o = len(set(a) & set(b)) / len(set(a) | set(b))
    begin, end = 0.08 * (b.startswith(a) or a.startswith(b)), 0.05 * (b.endswith(a) or a.endswith(b))
    method = "fuzzy_sequence" if s >= 0.9 else "prefix_suffix_heuristic" if begin or end else "token_overlap"
    return min(1.0, s * 0.55 + o * 0.35 + begin + end), method


def words(seed, n, letters="资产负债合计流动现金存货其他应收款", most=9):
    draw = random.Random(seed)
    made = {"".join(draw.choices(letters, k=draw.randrange(1, most))) for _ in range(n)}
    for w in list(made)[: n // 3]:
        at = draw.randrange(len(w) + 1)
        made.add(w[:at] + draw.choice(letters) + w[at + draw.randrange(2) :])
    return sorted(made)


def strings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def test_join_finds_all_pairs_of_the_score_and_looks_at_few(spark):
    # Repeated letters, one long string, and a rich alphabet, in which little is shared.
    some = [chr(0x4E00 + k) for k in range(300)]
    for labels, names, few in [(words(1, 250), words(2, 150), 0.5), (words(3, 150, "ab", 12) + ["ab" * 40], words(4, 80, "ab", 12), 1.0), (words(5, 250, some, 12), words(6, 250, some, 12), 0.02)]:
        names = names + labels[:10] + [labels[0] + "x", "y" + labels[1]]
        got = {(r.label, r.name): (round(r.score, 6), r.method) for r in aj.similar(strings(spark, labels + [""]), strings(spark, names + [""])).collect()}
        want = {(a, b): (round(s, 6), m) for a in labels for b in names for s, m in [plain_score(a, b)] if s >= 0.62}
        assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
        pairs = aj.candidate_pairs(strings(spark, sorted(set(labels))), strings(spark, sorted(set(names)))).count()
        assert len(want) <= pairs <= few * len(labels) * len(names)


SUBJECTS = [("货币资金", "1001", 1), ("现金", "1002", 2), ("现金", "1003", 3), ("应收账款", "1004", 4), ("固定资产净额", "1005", 5)]
ALIASES = [("库存现金", "1003", "exact_alias", []), ("库存现金", "1001", "legacy_alias", []), ("银行存款", "1001", "legacy_alias", ["note"]), ("应收款", "1004", "manual", ["note"])]
RELATIONS = [("1005", "固定资产净额", "aggregate_relation", ["固定资产合计"], True)]


def dimensions(spark):
    subjects = spark.createDataFrame(SUBJECTS, "name string, code string, position int")
    aliases = spark.createDataFrame(ALIASES, "alias string, code string, kind string, statements array<string>")
    return subjects, aliases, spark.createDataFrame(RELATIONS, "code string, name string, kind string, related array<string>, review boolean")


def test_cascade_goes_from_exact_to_alias_to_candidates(spark):
    rows = [(1, "一、现金", "note", None, None, 1.0), (2, "库存现金", "note", None, None, 2.0), (3, "银行存款", "note", "", None, -3.0), (4, "银行存款", "cash", None, None, 4.0), (5, "固定资产合计", "note", None, None, None), (6, "应收账款净", "note", None, None, 6.0), (7, "完全不同", "note", None, None, 7.5), (8, "现金", "note", "9", "manual_alias", 8.0), (9, "", "note", None, None, 9.0), (10, None, "note", None, None, 1.0)]
    facts = spark.createDataFrame(rows, "id int, label string, statement_type string, code string, method string, value double")
    done, candidates = aj.mapped(facts, *dimensions(spark))
    got = {r.id: (r.code, r.method, r.confidence, r.review, r.reason) for r in done.collect()}
    assert got[1] == ("1003", "exact", 1.0, False, "") and got[2] == ("1003", "exact_alias", 0.95, False, "")
    assert got[3] == ("1001", "legacy_alias", 0.9, False, "")
    # An alias for another statement is a candidate only.
    assert got[4] == (None, "candidate_only", 0.98, True, "mapping_candidate_only")
    assert got[5] == (None, "candidate_only", 0.92, True, "mapping_candidate_only")
    assert got[6][:2] == (None, "candidate_only") and got[6][3:] == (False, "mapping_candidate_only")
    assert got[7] == (None, None, 0.0, False, "no_match") and got[8] == ("9", "manual_alias", None, None, None)
    assert got[9] == got[10] == (None, None, None, None, None) and len(got) == 10
    assert {(r.label, r.rank, r.code, r.score) for r in candidates.collect() if r.label == "固定资产合计"} == {("固定资产合计", 1, "1005", 0.92)}
    assert aj.statistics(done).collect()[0].asDict() == {"mapped_by_exact": 1, "mapped_by_alias": 3, "mapped_by_relation": 0, "unmapped_total": 4}
    labels = {r.label: (r.occurrences, r.numeric, r.amount, r.top_code, r.top_method) for r in aj.open_labels(done, candidates).collect()}
    assert labels["银行存款"] == (1, 1, 4.0, "1001", "alias_table") and labels["完全不同"] == (1, 1, 7.5, "", "") and labels["固定资产合计"] == (1, 0, 0.0, "1005", "relation")


def test_top_candidates_are_those_of_a_full_comparison(spark):
    labels, names = words(7, 120), words(8, 60)
    subjects = [(n, f"{k:03}") for k, n in enumerate(names)]
    got = {}
    none = spark.createDataFrame([], "alias string, code string, kind string"), spark.createDataFrame([], "code string, name string, kind string, related array<string>, review boolean")
    for r in aj.mined(strings(spark, labels), spark.createDataFrame(subjects, "name string, code string"), *none).orderBy("label", "rank").collect():
        got.setdefault(r.label, []).append((r.code, r.score))
    norm = dict(strings(spark, names).withColumnRenamed("s", "name").select("name", aj.subject_label(F.col("name"))).collect())
    for label in labels:
        every = sorted((-round(plain_score(label, norm[n])[0], 6), c) for n, c in subjects if norm[n] and plain_score(label, norm[n])[0] >= 0.62)
        assert got.get(label, []) == [(c, -s) for s, c in every[:3]]
