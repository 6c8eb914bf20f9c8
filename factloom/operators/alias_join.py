"""Labels that nearly are names of a chart of accounts, and the cascade that maps facts to codes.

The join is exact: a pair that reaches the least score shares, of each side's characters ordered
from the rarest, one among the first few. How many that are follows from the score: for a string of
n characters, d of them distinct, m shared ones give at most 1.1 m / (n + m) + 0.35 min(1, m / d).
Pairs that only a common beginning or end lifts to the least score contain each other, and are
found by equality of beginnings and ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import label_for_matching, subject_label
from factloom.operators.scratch import written

#: What the score weighs, the least score, and the scores of other matches.
SEQUENCE, OVERLAP, BEGINNING, END, LEAST = 0.55, 0.35, 0.08, 0.05, 0.62
ALIAS_SCORE, RELATION_SCORE, CLOSE = 0.98, 0.92, 0.9
PLAIN_ALIASES = ("exact_alias", "legacy_alias")
#: Sums of doubles may miss the least score by this much.
EPS = 1e-9
BATCH = 5_000


def _bound(m: Column, sizes: Column, distinct: Column) -> Column:
    """The most that a pair without a common beginning or end can score with m shared characters."""
    return SEQUENCE * 2 * m / sizes + OVERLAP * F.least(F.lit(1.0), m / distinct)


def _tokens(strings: DataFrame) -> DataFrame:
    """(s, n, d, char, k): the k-th occurrence of each character of distinct strings."""
    chars = strings.select("s", F.length("s").alias("n"), F.explode(F.split("s", "")).alias("char")).filter("char <> ''")
    counts = chars.groupBy("s", "n", "char").agg(F.count(F.lit(1)).alias("times"))
    size = F.size(F.array_distinct(F.filter(F.split("s", ""), lambda c: c != "")))
    return counts.select("s", "n", size.alias("d"), "char", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("k"))


def _prefixes(tokens: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """The rarest tokens of each string, of which a pair that scores `least` shares one."""
    needed = F.filter(F.sequence(F.lit(1), F.col("n")), lambda m: _bound(m, F.col("n") + m, F.col("d")) >= least - EPS)
    ordered = tokens.join(often, ["char", "k"]).withColumn("at", F.row_number().over(Window.partitionBy("s").orderBy("often", "char", "k")))
    return ordered.withColumn("needed", F.get(needed, F.lit(0))).filter("at <= n - needed + 1").drop("often", "needed")


def candidate_pairs(labels: DataFrame, names: DataFrame, least: float = LEAST) -> DataFrame:
    """(label, name): all pairs of distinct strings `s` that can score `least`, and few others."""
    left, right = _tokens(labels), _tokens(names)
    often = left.select("char", "k").unionByName(right.select("char", "k")).groupBy("char", "k").agg(F.count(F.lit(1)).alias("often"))
    side = lambda df, name, mark: _prefixes(df, often, least).select("char", "k", F.col("s").alias(name), *[F.col(c).alias(f"{c}{mark}") for c in ("n", "d", "at")])
    one, two = side(left, "label", 1), side(right, "name", 2)
    sizes, wider = F.col("n1") + F.col("n2"), F.greatest("d1", "d2")
    met = one.join(two, ["char", "k"]).filter(_bound(F.least("n1", "n2"), sizes, wider) >= least - EPS)
    first = met.groupBy("label", "name", "n1", "n2", "d1", "d2").agg(F.min("at1").alias("at1"), F.min("at2").alias("at2"))
    # Nothing rarer is shared, so no more than what comes after the first shared one.
    rest = 1 + F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    near = first.filter(_bound(rest, sizes, wider) >= least - EPS).select("label", "name")
    return near.unionByName(_contained(labels, names, "label", "name", least)).unionByName(_contained(names, labels, "name", "label", least).select("label", "name")).distinct()


def _contained(outer: DataFrame, inner: DataFrame, big: str, small: str, least: float) -> DataFrame:
    """Pairs of which the second begins or ends the first, if lengths allow the score."""
    share = (least - OVERLAP - BEGINNING - END) / (2 * SEQUENCE)
    n = F.length("s")
    # small / (small + big) must reach the share.
    low = F.greatest(F.lit(1), F.ceil(n * (share / (1 - share)) - EPS)).cast("int")
    sizes = outer.filter("s <> ''").select("s", F.explode(F.sequence(low, n)).alias("k"))
    ends = sizes.select(F.col("s").alias(big), F.explode(F.array(F.substring("s", F.lit(1), F.col("k")), F.substring("s", F.length("s") - F.col("k") + 1, F.col("k")))).alias(small)).distinct()
    return ends.join(inner.select(F.col("s").alias(small)), small, "left_semi")


def scored(pairs: DataFrame) -> DataFrame:
    """(label, name, score, sequence, ends) of pairs; similarity of sequences is that of difflib, in Arrow batches."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    one, two = F.array_distinct(chars("label")), F.array_distinct(chars("name"))
    overlap = F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two))
    ends = F.when(F.col("name").startswith(F.col("label")) | F.col("label").startswith(F.col("name")), BEGINNING).otherwise(0.0) + F.when(F.col("name").endswith(F.col("label")) | F.col("label").endswith(F.col("name")), END).otherwise(0.0)
    rows = pairs.select("label", "name", overlap.alias("overlap"), ends.alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ratios = [SequenceMatcher(None, a, b).ratio() for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ratios, pa.float64())], names=["label", "name", "overlap", "ends", "sequence"])

    found = rows.mapInArrow(run, "label string, name string, overlap double, ends double, sequence double")
    score = F.least(F.lit(1.0), F.col("sequence") * SEQUENCE + F.col("overlap") * OVERLAP + F.col("ends"))
    return found.select("label", "name", F.when(F.col("label") == F.col("name"), 1.0).otherwise(score).alias("score"), "sequence", "ends")


def similar(labels: DataFrame, names: DataFrame, least: float = LEAST) -> DataFrame:
    """(label, name, score, method) of all pairs of strings `s` whose score is at least `least`; empty ones match nothing."""
    one, two = (d.select("s").filter("s <> ''").distinct() for d in (labels, names))
    found = scored(candidate_pairs(one, two, least)).filter(F.col("score") >= least)
    method = F.when(F.col("label") == F.col("name"), "exact_normalized_match").when(F.col("sequence") >= CLOSE, "fuzzy_sequence").when(F.col("ends") > 0, "prefix_suffix_heuristic").otherwise("token_overlap")
    return found.select("label", "name", "score", method.alias("method"))


def mined(labels: DataFrame, subjects: DataFrame, aliases: DataFrame, relations: DataFrame, top: int = 3, least: float = LEAST) -> DataFrame:
    """(label, rank, code, name, score, method, relation, review) of up to `top` codes for each normalised label `s`.

    An alias scores 0.98 and a relation (by its own or a related name) 0.92, whatever they are for;
    others score as in similar(). Of one code the best score counts, of equal ones alias, relation,
    then name. Ties go to those that need no review, then to the smaller code.

    subjects: (name, code). aliases: (alias, code, kind). relations: (code, name, kind, related
    (array), review). Disabled ones are left out by the caller.
    """
    wanted = labels.select("s").filter("s <> ''").distinct()
    names = subjects.select(subject_label(F.col("name")).alias("s"), "code", "name")
    charted = subjects.select("code", F.col("name").alias("chart_name"))
    near = similar(wanted, names, least).withColumnRenamed("name", "s").join(names, "s").select("label", "code", "name", F.round("score", 6).alias("score"), "method", F.lit("").alias("relation"), F.lit(False).alias("review"), F.lit(3).alias("from"))
    known = aliases.select(subject_label(F.col("alias")).alias("s"), "code", "kind").join(charted, "code")
    by_alias = wanted.join(known, "s").select(F.col("s").alias("label"), "code", F.col("chart_name").alias("name"), F.lit(ALIAS_SCORE).alias("score"), F.lit("alias_table").alias("method"), F.col("kind").alias("relation"), (~F.col("kind").isin(*PLAIN_ALIASES)).alias("review"), F.lit(1).alias("from"))
    said = relations.select("code", "name", "kind", "review", F.explode(F.array_append("related", F.col("name"))).alias("said")).select("code", "name", "kind", "review", subject_label(F.col("said")).alias("s")).distinct()
    by_relation = wanted.join(said, "s").select(F.col("s").alias("label"), "code", "name", F.lit(RELATION_SCORE).alias("score"), F.lit("relation").alias("method"), F.col("kind").alias("relation"), "review", F.lit(2).alias("from"))
    every = by_alias.unionByName(by_relation).unionByName(near)
    rest = F.struct("name", "score", "method", "relation", "review")
    best = every.groupBy("label", "code").agg(F.min_by(rest, F.struct(-F.col("score"), "from", "review", "name", "relation")).alias("b")).select("label", "code", "b.*")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "review", "code"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select("label", "rank", "code", "name", "score", "method", "relation", "review")


def mapped(facts: DataFrame, subjects: DataFrame, aliases: DataFrame, relations: DataFrame, label: str = "label", top: int = 3) -> tuple[DataFrame, DataFrame]:
    """(facts with code, name, method, confidence, relation, review, reason; candidates of the labels left open).

    A fact that has a code keeps it. A label equal to a subject's is exact (of equal subjects the last
    by position); then an alias allowed for its statement counts, exact ones first, then the smaller
    code; then the best candidate is noted without a code, for review. facts: `label`,
    statement_type, code, method. subjects: (name, code, position). aliases as in mined(), with
    statements (array, empty for all).

    The distinct (label, statement) pairs are normalised, mapped and joined back, so that facts are read
    twice and no text is cleaned for each of them. Pairs, candidates and answers are written.
    """
    asked = facts.filter("coalesce(code, '') = ''").select(F.col(label).alias("__raw"), "statement_type").distinct()
    said = written(asked.withColumn("__label", subject_label(F.col("__raw"))).filter("__label <> ''"), "labels")
    open_ = said.select("__label", "statement_type").distinct()
    exact = subjects.groupBy(label_for_matching(F.col("name")).alias("__label")).agg(F.max_by(F.struct("code", "name"), "position").alias("exact"))
    named = aliases.join(subjects.groupBy("code").agg(F.max_by("name", "position").alias("name")), "code").select(subject_label(F.col("alias")).alias("__label"), "code", "name", "kind", "statements")
    order = F.struct(F.when(F.col("kind") == "exact_alias", 0).otherwise(1), F.col("code"))
    allowed = (F.size("statements") == 0) | F.array_contains("statements", F.col("statement_type"))
    alias = open_.join(named, "__label").filter(allowed).groupBy("__label", "statement_type").agg(F.min_by(F.struct("code", "name", "kind"), order).alias("alias"))
    keys = open_.join(exact, "__label", "left").join(alias, ["__label", "statement_type"], "left")
    left = keys.filter("exact IS NULL AND alias IS NULL").select(F.col("__label").alias("s")).distinct()
    candidates = written(mined(left, subjects.select("name", "code").distinct(), aliases, relations, top), "candidates")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.format_string("%s %s (%.3f)", "code", "name", "score").alias("said")))), lambda c: c["said"])
    first = F.min_by(F.struct("code", "name", "score", "relation", "review"), "rank")
    best = candidates.groupBy(F.col("label").alias("__label")).agg(first.alias("best"), F.array_join(listed, ";").alias("candidates"))
    keys = keys.join(best, "__label", "left")
    given = F.coalesce("exact.code", "alias.code")
    found = keys.select(
        "__label",
        "statement_type",
        given.alias("__code"),
        F.coalesce("exact.name", "alias.name").alias("name"),
        F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), F.col("alias.kind")).when(F.col("best").isNotNull(), "candidate_only").alias("__method"),
        F.when(F.col("exact").isNotNull(), 1.0).when(F.col("alias.kind") == "exact_alias", 0.95).when(F.col("alias").isNotNull(), 0.9).otherwise(F.coalesce("best.score", F.lit(0.0))).alias("confidence"),
        F.when(given.isNull(), F.coalesce("best.relation", F.lit(""))).otherwise("").alias("relation"),
        F.when(given.isNull() & F.col("best").isNotNull(), F.col("best.review") | (F.col("best.relation") != "")).otherwise(False).alias("review"),
        F.when(given.isNotNull(), "").when(F.col("best").isNotNull(), "mapping_candidate_only").otherwise("no_match").alias("reason"),
        F.when(given.isNull(), F.col("best.code")).alias("best_code"),
        F.when(given.isNull(), F.coalesce("candidates", F.lit(""))).alias("candidates"),
    )
    # Facts that have a code, or no label, meet nothing.
    answers = written(said.join(found, ["__label", "statement_type"]).drop("__label"), "answers")
    rows = facts.withColumn("__raw", F.when(F.coalesce("code", F.lit("")) == "", F.col(label))).join(answers, ["__raw", "statement_type"], "left")
    rows = rows.withColumns({"code": F.coalesce(F.when(F.col("code") != "", F.col("code")), "__code"), "method": F.coalesce("__method", "method")})
    return rows.drop("__raw", "__code", "__method"), candidates


def statistics(facts: DataFrame) -> DataFrame:
    """One row of counts of mapped facts by how they were mapped, and of distinct open labels."""
    has = F.coalesce("code", F.lit("")) != ""
    exact = has & (F.col("method") == "exact")
    alias = has & ~exact & (F.contains("method", F.lit("alias")) | (F.coalesce("relation", F.lit("")) == ""))
    # Equal labels are counted before they are cleaned.
    open_ = F.coalesce(~has & (F.col("reason") != ""), F.lit(False))
    parts = {"mapped_by_exact": exact, "mapped_by_alias": alias, "mapped_by_relation": has & ~exact & ~alias}
    equal = facts.groupBy(open_.alias("__open"), F.when(open_, F.col("label")).alias("__raw")).agg(*[F.count_if(p).alias(n) for n, p in parts.items()])
    by_label = equal.groupBy(F.when(F.col("__open"), subject_label(F.col("__raw"))).alias("open")).agg(*[F.sum(n).alias(n) for n in parts])
    return by_label.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in parts], F.count("open").alias("unmapped_total"))


def open_labels(facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each label left open: facts, numbers, the sum of absolute amounts, and its best candidate."""
    equal = facts.filter("reason IN ('mapping_candidate_only', 'no_match')").groupBy("label")
    equal = equal.agg(F.count(F.lit(1)).alias("occurrences"), F.count("value").alias("numeric"), F.sum(F.abs("value").cast("decimal(28,6)")).alias("amount"))
    made = equal.groupBy(subject_label(F.col("label")).alias("label")).agg(F.sum("occurrences").alias("occurrences"), F.sum("numeric").alias("numeric"), F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("amount"))
    best = candidates.filter("rank = 1").select("label", F.col("code").alias("top_code"), F.col("score").alias("top_score"), F.col("method").alias("top_method"))
    return made.join(best, "label", "left").withColumns({"top_code": F.coalesce("top_code", F.lit("")), "top_score": F.coalesce("top_score", F.lit(0.0)), "top_method": F.coalesce("top_method", F.lit(""))})
