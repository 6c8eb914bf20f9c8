"""What kind of statement a table is, from weighted evidence.

Rules are one table of keywords. A text is asked once for the anchors (first two characters) that
it has of all rules; only keywords of these anchors are then looked for, so a text costs one pass
however many rules there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import clean_text

#: Kinds of statements, in the order that settles ties.
TYPES = ("balance_sheet", "income_statement", "cash_flow", "changes_in_equity", "note", "unknown")
MAIN = TYPES[:4]
#: What evidence weighs.
TITLE, NOTE_TITLE, SIGNATURE, LABEL, LABELS_MOST, NUMBERING, DETAIL, EARLY, HINT, HINT_MOST = 25, 35, 18, 9, 30, 6, 12, 2, 2, 8
ANCHOR = 2


@dataclass(frozen=True)
class StatementRules:
    """titles, signatures (lists of header words that must all be there) and labels by type; titles and markers of notes; prefixes of numbered rows by type."""

    titles: dict[str, list[str]] = field(default_factory=dict)
    note_titles: list[str] = field(default_factory=list)
    note_markers: list[str] = field(default_factory=list)
    signatures: dict[str, list[list[str]]] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    numbering: dict[str, list[str]] = field(default_factory=dict)
    early: int = 8
    least: float = 12
    margin: float = 4


def keyword_hits(df: DataFrame, group: list[str], text: str, rules: list[tuple]) -> DataFrame:
    """(group, rule, type, weight, reason, place) of rules that a text meets.

    rules: (rule, keywords, how many of them are needed, type, weight, reason, place). The texts'
    anchors are intersected with those of the rules before anything is exploded.
    """
    spark = df.sparkSession
    rows = [(r, k, len(set(words)) if need is None else need, kind, float(weight), reason, place) for r, words, need, kind, weight, reason, place in rules for k in sorted(set(words)) if k]
    kinds = "rule string, keyword string, need int, type string, weight double, reason string, place int"
    table = spark.createDataFrame(rows, kinds).withColumn("anchor", F.substring("keyword", 1, ANCHOR))
    anchors = sorted({k[:ANCHOR] for _, k, *_ in rows})
    if not anchors:
        return df.join(table.limit(0), F.lit(True)).select(*group, "rule", "type", "weight", "reason", "place")
    value = F.col(text)
    # All runs of ANCHOR characters, overlapping.
    grams = F.regexp_extract_all(value, F.lit(f"(?s)(?=({'.' * ANCHOR}))"), F.lit(1))
    # A keyword of one character is an anchor of its own.
    singles = [a for a in anchors if len(a) < ANCHOR]
    grams = F.concat(grams, *[F.when(F.contains(value, F.lit(a)), F.array(F.lit(a))).otherwise(F.array().cast("array<string>")) for a in singles])
    met = df.select(*group, text, F.explode(F.array_intersect(grams, F.array(*map(F.lit, anchors)))).alias("anchor"))
    found = met.join(F.broadcast(table), "anchor").filter(F.contains(text, F.col("keyword")))
    fired = found.groupBy(*group, "rule", "type", "weight", "reason", "place", "need").agg(F.count_distinct("keyword").alias("n"))
    return fired.filter("n >= need").drop("n", "need")


def _context_rules(rules: StatementRules) -> list[tuple]:
    titles = [(kind, w) for kind, words in rules.titles.items() for w in words if w]
    made = [(f"title:{kind}:{w}", [w], 1, kind, TITLE, f"title:{kind}:{w}", k) for k, (kind, w) in enumerate(titles)]
    return [*made, ("note_title", rules.note_titles, 1, "note", NOTE_TITLE, "note_title", 1000), ("note_detail_marker", rules.note_markers, 1, "note", DETAIL, "note_detail_marker", 5000)]


def _evidence(kind: str, weight: Column | float, reason: Column | str, place: int) -> Column:
    """One piece of evidence, as keyword_hits() gives it."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(place).alias("place"), lit(reason).alias("reason"), F.lit(kind).alias("type"), lit(weight).cast("double").alias("weight"))


def classified(facts: DataFrame, pages: DataFrame, table: list[str], rules: StatementRules) -> DataFrame:
    """(table, statement_type, score, second, source, reason) of each table of facts.

    facts: doc_id and page_no (among `table`), label, header_path, statement_type and `ordinal`.
    pages: (doc_id, page_no, text), one row for each page. The type of the highest score is taken if
    it has the least score and margin; else the type that most facts already have, if any
    (of several the first by ordinal); else unknown. reason joins the first six pieces of evidence.
    """
    page = ["doc_id", "page_no"]
    label = clean_text(F.col("label"))
    texts = pages.select(*page, clean_text(F.col("text")).alias("text"))
    hits = keyword_hits(texts, page, "text", _context_rules(rules)).groupBy(*page).agg(F.collect_list(F.struct("place", "reason", "type", "weight")).alias("__of_page"))
    seen = texts.select(*page).join(hits, page, "left").withColumn("early", (F.col("page_no") > 0) & (F.col("page_no") <= rules.early))
    # One pass over the facts: headers, labels and numbering, first by the type that facts have, then by table.
    numbered = [(k, kind, F.exists(F.array(*map(F.lit, words)), lambda w: label.startswith(w))) for k, (kind, words) in enumerate((kind, words) for kind, words in rules.numbering.items() if words)]
    labelled = [(k, kind, label.isin(*sorted(set(words)))) for k, (kind, words) in enumerate(rules.labels.items()) if words]
    heads = F.array_join(F.transform("header_path", clean_text), " ")
    typed = F.when(~F.coalesce("statement_type", F.lit("unknown")).isin("", "unknown"), F.col("statement_type"))
    by_type = facts.groupBy(*table, typed.alias("__type")).agg(
        F.collect_set(heads).alias("__heads"), F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"),
        *[F.bool_or(hit).alias(f"__numbered_{k}") for k, _, hit in numbered], *[F.count_if(hit).alias(f"__labels_{k}") for k, _, hit in labelled],
    )
    told = F.when(F.col("__type").isNotNull(), F.struct(F.col("__type").alias("type"), "n"))
    groups = by_type.groupBy(*table).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__heads")))), " ").alias("headers"),
        F.min_by(told, F.when(F.col("__type").isNotNull(), F.struct(-F.col("n"), "first"))).alias("hint"),
        *[F.bool_or(f"__numbered_{k}").alias(f"__numbered_{k}") for k, *_ in numbered], *[F.sum(f"__labels_{k}").alias(f"__labels_{k}") for k, *_ in labelled],
    )
    found = []
    for k, (kind, words) in enumerate((kind, words) for kind, lists in rules.signatures.items() for words in lists if words):
        if all(words):
            found.append(F.when(reduce(Column.__and__, [F.contains(F.col("headers"), F.lit(w)) for w in sorted(set(words))]), _evidence(kind, float(SIGNATURE), f"header_signature:{kind}", 2000 + k)))
    for k, kind, _ in labelled:
        n = F.col(f"__labels_{k}")
        found.append(F.when(n > 0, _evidence(kind, F.least(F.lit(float(LABELS_MOST)), n * float(LABEL)), F.concat(F.lit(f"row_pattern:{kind}:"), n.cast("string")), 3000 + k)))
    for k, kind, _ in numbered:
        found.append(F.when(F.col(f"__numbered_{k}"), _evidence(kind, float(NUMBERING), f"{kind}_numbering", 4000 + k)))
    none = F.array().cast("array<struct<place: int, reason: string, type: string, weight: double>>")
    own = F.filter(F.array(*found), lambda e: e.isNotNull()) if found else none
    # A table without a whole key has neither evidence nor a hint.
    keyed = reduce(Column.__and__, [F.col(k).isNotNull() for k in table])
    rows = groups.join(seen, page, "left").withColumn("early", F.coalesce("early", F.lit(False)))
    rows = rows.withColumn("__ev", F.when(keyed, F.array_sort(F.concat(own, F.coalesce("__of_page", none)))).otherwise(none)).withColumn("hint", F.when(keyed, F.col("hint")))
    rows = rows.select(*table, "early", "hint", "__ev").withColumn("reasons", F.transform("__ev", lambda e: e["reason"]))
    # Every table has a score for every type, 0 without evidence.
    order = F.array(*map(F.lit, TYPES))
    known = F.create_map(*[x for k, t in enumerate(TYPES) for x in (F.lit(t), F.lit(k))])
    given = F.col("hint.type")
    types = F.when(given.isNotNull() & ~F.array_contains(order, given), F.array_append(order, given)).otherwise(order)

    def worth(t: Column) -> Column:
        own = F.aggregate(F.filter("__ev", lambda e: e["type"] == t), F.lit(0.0), lambda total, e: total + e["weight"])
        bonus = F.when(F.col("early") & (own > 0) & t.isin(*MAIN), float(EARLY)).otherwise(0.0)
        hinted = F.when(t == given, F.least(F.lit(float(HINT_MOST)), F.col("hint.n") * float(HINT))).otherwise(0.0)
        return own + bonus + hinted

    ranked = F.array_sort(F.transform(types, lambda t: F.struct((-worth(t)).alias("score"), F.coalesce(F.element_at(known, t), F.lit(len(TYPES))).alias("k"), t.alias("type"))))
    rows = rows.withColumn("ranked", ranked)
    top, second = -F.col("ranked")[0]["score"], -F.col("ranked")[1]["score"]
    clear = (top >= rules.least) & (top - second >= rules.margin)
    later = [F.when(F.col("early"), "early_page_bonus"), F.when(given.isNotNull(), F.concat(F.lit("existing_type_hint:"), given))]
    said = F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.filter(F.array(*later), lambda r: r.isNotNull()))
    reason = F.array_join(F.slice(said, 1, 6), ";")
    rows = rows.withColumns({"clear": clear, "score": top, "second": second, "said": F.when(reason != "", reason).otherwise("scored_specialization")})
    return rows.select(
        *table,
        F.when(F.col("clear"), F.col("ranked")[0]["type"]).otherwise(F.coalesce(given, F.lit("unknown"))).alias("statement_type"),
        F.round("score", 6).alias("score"),
        F.round("second", 6).alias("second"),
        F.when(F.col("clear"), "scored_specialization").when(given.isNotNull(), "fallback_existing").otherwise("ambiguous").alias("source"),
        F.when(F.col("clear"), F.col("said")).when(given.isNotNull(), "kept_existing_type").otherwise("ambiguous_scores").alias("reason"),
    )


def specialized(facts: DataFrame, groups: DataFrame, table: list[str]) -> DataFrame:
    """facts with the type of their table, what it was before, and why."""
    found = groups.select(*table, F.col("statement_type").alias("__type"), F.col("score").alias("type_score"), F.col("source").alias("type_source"), F.col("reason").alias("type_reason"))
    rows = facts.join(found, table, "left")
    return rows.withColumn("type_before", F.coalesce("statement_type", F.lit("unknown"))).withColumn("statement_type", F.coalesce("__type", "statement_type")).drop("__type")
