"""Gaps of a benchmark: why each is open, what would close it, and rounds of closing.

Tables, with a total order `position` where the first rows count (null texts are empty):

* gaps: gap (unique, ordered), code, name, period, amount, header
* facts: fact_id (unique), position, code, period, value, label, statement_type, scope, unplaced
* raw: like facts, without scope and unplaced; the facts before duplicates went
* unplaced: fact_id, position, code, period, value, statement_type; rows of facts that found no place
* derived: fact_id, position, code, period
* review: review_id, position, period, value, label, statement_type, facts (ids)
* issues: issue_id, position, message

Every probe is cut to the first rows of its key before it meets a gap, so a code or an amount
that a third of all facts share brings a gap three rows and not all of them. Amounts are compared
as decimals of four places; those outside of decimal(18, 4) are near nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import listed, stable_id
from factloom.operators.scratch import written

#: Scopes that are exported; causes by order of the probes, with where they looked.
EXPORTED = ("main_export_target", "derived_target")
PROBES = (
    ("source_exists_but_target_scope_filtered", "target_scope_filtered"),
    ("source_exists_but_unplaced", "deduped_unplaced"),
    ("source_exists_but_unplaced", "unplaced_facts"),
    ("source_exists_but_period_misaligned", "mapped_other_period"),
    ("candidate_formula_possible", "derived_fact"),
    ("source_exists_but_unmapped", "facts_raw_amount_match"),
    ("source_exists_but_unmapped", "review_queue_amount_match"),
    ("truly_no_source", "issues_only"),
    ("truly_no_source", "no_candidate_found"),
)
UNMAPPED, UNPLACED, MISALIGNED = "source_exists_but_unmapped", "source_exists_but_unplaced", "source_exists_but_period_misaligned"
TOLERANCE = 0.01
#: Columns of facts that are read.
READ = ("fact_id", "position", "code", "period", "value", "label", "statement_type", "scope", "unplaced")
#: Bits that rows are sieved by before a shuffle (2 MB on each executor).
SIEVE = 1 << 24


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _decimal(c: Column) -> Column:
    return c.try_cast("decimal(18,4)")


def _near(a: Column, b: Column) -> Column:
    """Null where either side is."""
    return F.abs(_decimal(a) - _decimal(b)) <= F.lit(TOLERANCE).cast("decimal(18,4)")


def _seen(rows: DataFrame, ref: str, probe: int | Column) -> DataFrame:
    """rows as (probe, code, period, value, e): e is what a gap keeps of a row, in the rows' order.

    e.facts is null where it is the row itself, so that rows don't carry their id twice.
    """
    has = lambda n, kind: F.col(n).cast(kind) if n in rows.columns else F.lit(None).cast(kind)
    texts = {n: F.coalesce(has(n, "string"), F.lit("")) for n in ("code", "period", "label", "statement_type")}
    facts = F.coalesce(has("facts", "array<string>"), F.array().cast("array<string>")) if "facts" in rows.columns else F.lit(None).cast("array<string>")
    value = has("value", "double")
    e = F.struct(has("position", "long").alias("position"), _text(ref).alias("ref"), value.alias("value"), texts["period"].alias("period"), F.trim(texts["label"]).alias("label"), texts["statement_type"].alias("statement_type"), facts.alias("facts"))
    return rows.select((F.lit(probe) if isinstance(probe, int) else probe).alias("probe"), texts["code"].alias("code"), texts["period"].alias("period"), value.alias("value"), e.alias("e"))


def _first(rows: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The first n rows of each key; Spark cuts them before the shuffle as well."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("e"))).filter(F.col("__n") <= n).drop("__n")


def _together(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("evidence"))


def _sieve(wanted: DataFrame, name: str) -> DataFrame:
    """Hashed bits of the texts in a column: at most SIEVE bits, however many texts there are."""
    bit = F.pmod(F.xxhash64(_text(name)), F.lit(SIEVE))
    return wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("__bits"))


def _sieved(rows: DataFrame, name: str, sieve: DataFrame, wanted: bool = True) -> DataFrame:
    """rows whose text may be wanted, before they are shuffled (not wanted: the other rows); what follows decides exactly."""
    kept = rows.withColumn("__b", F.pmod(F.xxhash64(_text(name)), F.lit(SIEVE))).join(F.broadcast(sieve), F.shiftright("__b", 6) == F.col("__word"), "inner" if wanted else "left")
    bit = "shiftrightunsigned(__bits, CAST(__b % 64 AS INT)) & 1"
    return kept.filter(f"{bit} = 1" if wanted else f"coalesce({bit}, 0) = 0").drop("__b", "__word", "__bits")


def _without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """rows but for those whose text is in gone; only rows that may be are shuffled."""
    sieve = _sieve(gone, name)
    # Not an anti join, which Spark would move ahead of the sieve.
    met = _sieved(rows, name, sieve).join(gone.select(name).distinct().withColumn("__gone", F.lit(True)), name, "left").filter("__gone IS NULL").drop("__gone")
    return _sieved(rows, name, sieve, False).unionByName(met)


def _same_place(facts: DataFrame, unplaced: DataFrame, derived: DataFrame) -> DataFrame:
    """(code, period, near: evidence and probe of the least of 0 to 2, made: evidence of 4)."""
    outside = ~_text("scope").isin(*EXPORTED)
    own = facts.filter(outside | (_text("unplaced") != ""))
    # A fact outside of the scope decides before its missing place does, so it counts once.
    rows = _seen(own, "fact_id", F.when(outside, 0).otherwise(1)).unionByName(_seen(unplaced, "fact_id", 2)).unionByName(_seen(derived, "fact_id", 4))
    each = _together(_first(rows, ["probe", "code", "period"]), ["code", "period", "probe"])
    found = F.struct("probe", "evidence")
    return each.groupBy("code", "period").agg(F.min_by(F.when(F.col("probe") < 4, found), F.when(F.col("probe") < 4, F.col("probe"))).alias("near"), F.any_value(F.when(F.col("probe") == 4, found), True).alias("made"))


def _elsewhere(facts: DataFrame) -> DataFrame:
    """(code, six): six facts are enough for the first three in other periods than any gap's.

    Cut to three a period, a gap's period takes at most three of the first six, and what is left
    are the first of the others.
    """
    return _together(_first(_first(_seen(facts, "fact_id", 3), ["code", "period"]), ["code"], 6), ["code"]).withColumnRenamed("evidence", "six")


def _slot(c: Column) -> Column:
    return F.floor(c / F.lit(TOLERANCE).cast("decimal(18,4)")).cast("long")


def _first_amounts(rows: DataFrame, ref: str, probe: int) -> DataFrame:
    """(probe, period, cents, e): the first three rows of each period and amount."""
    cents = _seen(rows, ref, probe).withColumn("cents", _decimal(F.col("value"))).filter("cents IS NOT NULL")
    return _first(cents, ["probe", "period", "cents"]).select("probe", "period", "cents", "e")


def _same_amount(raw: DataFrame, review: DataFrame) -> DataFrame:
    """(period, slot, amounts): unmapped facts and review items, as _first_amounts gives them, by period and amount.

    Rows of one amount are cut to three first; a slot is as wide as the tolerance and so holds at
    most a hundred amounts, whatever the number of rows. Each amount stands in its own slot and
    both beside it, so that a gap asks one slot.
    """
    each = _together(raw.unionByName(review), ["probe", "period", "cents"]).withColumn("s", _slot(F.col("cents")))
    spread = each.withColumn("slot", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)))
    return spread.groupBy("period", "slot").agg(F.collect_list(F.struct("probe", "cents", "evidence")).alias("amounts"))


def _named(gaps: DataFrame, issues: DataFrame) -> DataFrame:
    """(code, told): issues whose message holds a gap's code: messages are cut into pieces that are as long as codes and
    begin as they do, and pieces meet codes by equality. The driver sees only the lengths and first characters of codes."""
    codes = gaps.select(_text("code").alias("code")).filter("code <> ''").distinct()
    heads = codes.groupBy(F.length("code").alias("n")).agg(F.collect_set(F.substring("code", 1, 1)).alias("heads")).collect()
    told = issues.withColumn("__m", _text("message"))

    def pieces_of(k: int, first: list[str]) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.length("__m") - (k - 1)), lambda i: F.substring(F.col("__m"), i, F.lit(1)).isin(first))
        return F.when(F.length("__m") >= k, F.transform(starts, lambda i: F.substring(F.col("__m"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    pieces = [pieces_of(r.n, sorted(r.heads)) for r in sorted(heads)]
    spread = told.withColumn("code", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *pieces)))).drop("__m")
    # Not a semi join, which Spark would move ahead of the sieve and so shuffle every piece.
    rows = _seen(_sieved(spread, "code", _sieve(codes, "code")).join(codes, "code"), "issue_id", 7)
    return _together(_first(rows, ["code"]), ["code"]).withColumnRenamed("evidence", "told")


def investigate(gaps: DataFrame, facts: DataFrame, raw: DataFrame, unplaced: DataFrame, derived: DataFrame, review: DataFrame, issues: DataFrame) -> DataFrame:
    """gaps with cause, source, evidence (up to three rows) and refs, of the first probe that finds something.

    Null codes and periods are empty; a gap without an amount finds nothing by amount. Facts whose
    code no gap has are left out before they are shuffled.
    """
    sieve = _sieve(gaps, "code")
    only = lambda df: _sieved(df, "code", sieve)
    amounts = _same_amount(_first_amounts(raw.filter(_text("code") == ""), "fact_id", 5), _first_amounts(review, "review_id", 6))
    return _probed(gaps, only(facts), amounts, only(unplaced), only(derived), _named(gaps, issues))


def _probed(gaps: DataFrame, facts: DataFrame, amounts: DataFrame, unplaced: DataFrame, derived: DataFrame, named: DataFrame) -> DataFrame:
    """What investigate() returns: gaps stay one row each and meet the probes' rows, cut to few a key, by place, code and amount."""
    # Written first, so that a few amounts are known to be few and go to the gaps, not the gaps to them.
    amounts = written(amounts, "amounts")
    by_code = _elsewhere(facts).join(named, "code", "full")
    rows = gaps.drop("cause", "source", "evidence", "refs").withColumns({"__code": _text("code"), "__period": _text("period"), "__slot": _slot(_decimal(F.col("amount").cast("double")))})
    place = _same_place(facts, unplaced, derived).withColumnsRenamed({"code": "__code", "period": "__period"})
    rows = rows.join(place, ["__code", "__period"], "left")
    rows = rows.join(by_code.withColumnRenamed("code", "__code"), "__code", "left")
    away = F.slice(F.filter("six", lambda e: e["period"] != F.col("__period")), 1, 3)
    one = lambda k, evidence: F.when(F.size(evidence) > 0, F.struct(F.lit(k).alias("probe"), evidence.alias("evidence")))
    rows = rows.withColumn("__found", F.coalesce("near", one(3, away), "made")).withColumn("told", F.when(F.col("__found").isNull(), F.col("told"))).drop("near", "six", "made")
    rows = rows.join(amounts.withColumnsRenamed({"period": "__period", "slot": "__slot"}), ["__period", "__slot"], "left")
    close = F.filter("amounts", lambda a: _near(F.col("amount").cast("double"), a["cents"]))
    of = lambda k: one(k, F.slice(F.sort_array(F.flatten(F.transform(F.filter(close, lambda a: a["probe"] == k), lambda a: a["evidence"]))), 1, 3))
    rows = rows.withColumn("__found", F.coalesce("__found", of(5), of(6), one(7, F.col("told")))).drop("amounts", "told", "__code", "__period", "__slot")
    whole = F.transform("__found.evidence", lambda e: e.withField("facts", F.coalesce(e["facts"], F.array(e["ref"]))))
    names = lambda k: F.get(F.array(*[F.lit(p[k]) for p in PROBES]), F.coalesce(F.col("__found.probe"), F.lit(len(PROBES) - 1)))
    rows = rows.withColumns({"evidence": whole, "cause": names(0), "source": names(1)})
    refs = F.array_join(F.filter(F.transform("evidence", lambda e: e["ref"]), lambda r: r != ""), ";")
    kept = [c for c in gaps.columns if c not in ("cause", "source", "evidence", "refs")]
    return rows.withColumn("refs", F.coalesce(refs, F.lit(""))).select(*kept, "evidence", "cause", "source", "refs")


def _by_cause(alias: Column, place: Column, period: Column) -> Column:
    return F.when(F.col("cause") == UNMAPPED, alias).when(F.col("cause") == UNPLACED, place).when(F.col("cause") == MISALIGNED, period)


def _texts(rows: str, name: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(rows, lambda e: e[name]), lambda x: x != "")))


def _weighed(investigated: DataFrame) -> tuple[DataFrame, Column]:
    """(rows with their evidence by what closes a gap, whether it leaves one way only)."""
    ev = F.filter(F.coalesce("evidence", F.expr("array()").cast(investigated.schema["evidence"].dataType)), lambda e: e["ref"] != "")
    near = F.filter("__e", lambda e: F.coalesce(_near(e["value"], F.col("amount")), F.lit(False)))
    rows = investigated.withColumn("__e", ev).withColumns({"__labels": _texts("__e", "label"), "__near": near}).withColumn("__periods", _texts("__near", "period"))
    return rows, _by_cause(F.size("__labels") == 1, F.size("__near") == 1, F.size("__periods") == 1)


def candidates(investigated: DataFrame) -> DataFrame:
    """What would close each gap that has a source, and whether its evidence leaves one way only.

    Unmapped: an alias, safe if all evidence has one label. Unplaced: a preferred fact, safe if
    one has the gap's amount. Misaligned: another period, safe if those of the amount have one.
    """
    by = _by_cause
    rows, safe = _weighed(investigated.filter(F.col("cause").isin(UNMAPPED, UNPLACED, MISALIGNED)))
    rows = rows.withColumn("statement_types", _texts("__e", "statement_type"))
    told = lambda yes, no: F.when(F.col("safe"), by(*map(F.lit, yes))).otherwise(by(*map(F.lit, no)))
    rows = rows.withColumn("safe", safe).withColumns({
        "gap_id": stable_id("GAP_", _text("code"), _text("period"), F.col("amount"), F.col("cause"), listed(F.transform("__e", lambda e: e["ref"]))),
        "fix": by(F.lit("alias_promotion"), F.lit("placement_rule"), F.lit("period_role_fix")),
        "action": told(("shadow_alias_promotion", "shadow_placement_preference", "shadow_period_override"), ("review_alias_promotion", "review_shadow_placement", "review_shadow_period_override")),
        "reason": told(("single_source_backed_alias_label", "single_unplaced_fact_matches_benchmark_amount", "single_source_period_matches_benchmark_amount"), ("multiple_alias_labels", "multiple_matching_unplaced_facts", "multiple_candidate_periods")),
        "alias": F.when(F.col("safe") & (F.col("cause") == UNMAPPED), F.get("__labels", F.lit(0))),
        "target_fact": F.when(F.col("safe") & (F.col("cause") == UNPLACED), F.get("__near", F.lit(0))["ref"]),
        "target_period": F.when(F.col("safe") & (F.col("cause") == MISALIGNED), F.get("__periods", F.lit(0))),
    })
    named = by(stable_id("SHADOW_ALIAS_", F.col("gap_id"), _text("code"), F.col("alias")), stable_id("SHADOW_PLACE_", F.col("gap_id"), F.col("target_fact")), stable_id("SHADOW_PERIOD_", F.col("gap_id"), _text("code"), F.col("target_period")))
    return rows.withColumn("promotion_id", F.when(F.col("safe"), named)).drop("__e", "__labels", "__near", "__periods")


def backlog(investigated: DataFrame) -> DataFrame:
    """gap, cause, priority (the amount without sign, 0 without one), whether it is a backfill task, and refs."""
    return investigated.select("gap", "code", "period", "amount", "cause", F.coalesce(F.abs("amount"), F.lit(0.0)).alias("priority"), (F.col("cause") == PROBES[-1][0]).alias("backfill"), "refs")


def accepted(closures: DataFrame, aliases: DataFrame) -> DataFrame:
    """closures with safe_to_apply: aliases must also be among (alias, code) of what may be accepted."""
    asked = closures.filter("fix = 'alias_promotion' AND safe")
    known = _sieved(aliases, "code", _sieve(asked, "code")).select(F.trim("alias").alias("__alias"), _text("code").alias("__code")).distinct().withColumn("__ok", F.lit(True))
    rows = closures.join(known, (F.col("alias") == F.col("__alias")) & (_text("code") == F.col("__code")), "left").drop("__alias", "__code")
    refused = (F.col("fix") == "alias_promotion") & F.col("__ok").isNull()
    out = rows.withColumns({"safe_to_apply": F.col("safe") & ~refused, "reason": F.when(F.col("safe") & refused, "alias_candidate_not_safe_under_repo_rules").otherwise(F.col("reason"))})
    return out.withColumn("result", F.when(F.col("safe_to_apply"), "pending_apply").otherwise("suggestion_only")).drop("__ok")


def claims(closures: DataFrame, facts: DataFrame, raw: DataFrame) -> DataFrame:
    """(held, fact_id, gap, code, name): the unmapped facts that safe aliases map, in facts (held 0) and raw (1).

    A fact must have the gap's period, or none, and its amount, or none; of several gaps the
    first takes it. Review items stand for their facts.
    """
    asked = closures.filter((F.col("fix") == "alias_promotion") & F.col("safe_to_apply") & (_text("code") != ""))
    asked = asked.select("gap", "code", "name", _text("period").alias("__p"), F.col("amount").alias("__a"), F.explode("evidence").alias("e")).select("*", F.explode("e.facts").alias("fact_id")).drop("e").distinct()
    parts = [(facts, 0), (raw, 1)]
    held = reduce(DataFrame.unionByName, [df.filter(_text("code") == "").select(F.lit(k).alias("held"), F.col("fact_id").cast("string"), _text("period").alias("period"), F.col("value").cast("double").alias("value")) for df, k in parts])
    fits = ((F.col("period") == "") | (F.col("__p") == "") | (F.col("period") == F.col("__p"))) & (F.col("value").isNull() | F.col("__a").isNull() | F.coalesce(_near(F.col("value"), F.col("__a")), F.lit(False)))
    return _sieved(held, "fact_id", _sieve(asked, "fact_id")).join(asked, "fact_id").filter(fits).groupBy("held", "fact_id").agg(F.min_by(F.struct("gap", "code", "name"), "gap").alias("b")).select("held", "fact_id", "b.*")


def applied(closures: DataFrame, claimed: DataFrame, facts: DataFrame) -> DataFrame:
    """closures with applied and result, once their claims, preferences and periods are in force."""
    changed = claimed.groupBy("gap").agg(F.count(F.lit(1)).alias("__n"))
    asked = _sieve(closures.filter("target_fact IS NOT NULL"), "target_fact")
    there = _sieved(facts, "fact_id", asked).select(F.col("fact_id").cast("string").alias("target_fact"), F.lit(True).alias("__there")).distinct()
    rows = closures.join(changed, "gap", "left").join(there, "target_fact", "left")
    told = _text("code") != ""
    done = F.when(F.col("fix") == "alias_promotion", F.col("__n") > 0).when(F.col("fix") == "placement_rule", F.col("__there") & told & (_text("period") != "")).otherwise(told & (_text("target_period") != ""))
    rows = rows.withColumn("applied", F.col("safe_to_apply") & F.coalesce(done, F.lit(False)))
    how = F.when(F.col("fix") == "alias_promotion", F.concat(F.lit("applied_to_"), F.col("__n").cast("string"), F.lit("_facts"))).when(F.col("fix") == "placement_rule", "applied_export_preference").otherwise("applied_runtime_alignment_override")
    return rows.withColumn("result", F.when(F.col("applied"), how).when(F.col("safe_to_apply"), "apply_failed").otherwise(F.col("result"))).drop("__n", "__there")


def preferred(closures: DataFrame) -> DataFrame:
    """(code, period, fact_id, gap): the fact that an applied closure puts first; of several the last."""
    rows = closures.filter("applied AND fix = 'placement_rule'")
    return rows.groupBy("code", "period").agg(F.max_by("target_fact", "gap").alias("fact_id"), F.max("gap").alias("gap"))


def results(closures: DataFrame, after: DataFrame) -> DataFrame:
    """closures with what became of them: closed, applied_gap_still_open, suggestion_only or resolved_without_apply.

    after: the investigation afterwards; a gap is still open there if its code, period, amount and cause recur.
    """
    key = ["code", "period", "amount", "cause"]
    left = after.filter(F.col("cause").isin(UNMAPPED, UNPLACED, MISALIGNED)).select(*[F.col(k).alias(f"__{k}") for k in key]).distinct().withColumn("__open", F.lit(True))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    rows = closures.join(left, same, "left").drop(*[f"__{k}" for k in key])
    told = F.when(F.col("__open") & F.col("applied"), "applied_gap_still_open").when(F.col("__open"), "suggestion_only").when(F.col("applied"), "closed").otherwise("resolved_without_apply")
    return rows.withColumn("result", told).drop("__open")


def close_rounds(gaps: DataFrame, facts: DataFrame, raw: DataFrame, unplaced: DataFrame, derived: DataFrame, review: DataFrame, issues: DataFrame, aliases: DataFrame) -> DataFrame:
    """Closes gaps until a round applies nothing: gaps with cause, source and refs as last seen, state and round.

    state is closed (an exported, placed fact with a value stands at the gap's code and period) or
    open. The facts aren't rewritten: a round adds to three small tables (mapped, placed, moved),
    and facts are read with these. A fact is mapped once, placed once, and a gap moved once, so
    the rounds come to an end. A mapped fact's scope is that of the export, as gaps are.

    Only what a round can have changed is asked again: gaps of a code that got or lost a fact, gaps
    that moved, and gaps whose evidence was mapped. Closures of the others have no facts left to
    claim. The tables are read once, before the first round: rows of the gaps' codes and rows without a
    code are written, narrow, and rounds read these and what rounds wrote.
    """
    spark = gaps.sparkSession
    ids = lambda df: df.withColumn("fact_id", F.col("fact_id").cast("string"))
    facts, raw, unplaced = ids(facts), ids(raw), ids(unplaced)
    named = written(_named(gaps, issues), "named")
    own = [c for c in gaps.columns if c not in ("period", "cause", "source", "refs", "evidence")]
    asked = gaps.drop("cause", "source", "refs", "evidence").withColumns({"code": _text("code"), "period": _text("period"), "__moved": F.lit(False), "__round": F.lit(None).cast("int")})
    sieve = written(_sieve(asked, "code"), "sieve")
    narrow = lambda df: df.select(*[c for c in READ if c in df.columns])
    of_gaps = lambda df, name, empty: written(_sieved(narrow(df if empty else df.filter(_text("code") != "")), "code", sieve), name)
    blank = not asked.filter("code = ''").isEmpty()
    coded, all_rest, all_made = of_gaps(facts, "coded", False), of_gaps(unplaced, "unplaced", blank), of_gaps(derived, "derived", blank)
    free, free_raw = (written(narrow(df.filter(_text("code") == "")), "free") for df in (facts, raw))
    # A fact that is to be placed has a gap's code, or stands among those without a place and among facts.
    named_rest = all_rest.select("fact_id").distinct()
    there = _sieved(facts.select("fact_id"), "fact_id", _sieve(named_rest, "fact_id")).join(named_rest, "fact_id")
    for df in (coded, free) if blank else (coded,):
        there = there.unionByName(df.filter(_text("unplaced") != "").select("fact_id"))
    there = written(there, "there")
    items = written(_first_amounts(review, "review_id", 6), "items")
    known = written(_sieved(aliases, "code", sieve).select(F.trim("alias").alias("alias"), _text("code").alias("code")).distinct(), "aliases")
    gained, placed, mapped = coded.limit(0), spark.createDataFrame([], "fact_id string"), spark.createDataFrame([], "held int, fact_id string")
    standing, turn, near, rest, made, unfree = None, 0, coded.unionByName(free) if blank else coded, all_rest, all_made, free_raw
    while True:
        amounts = _same_amount(_first_amounts(unfree, "fact_id", 5), items)
        shown = near.filter(_text("scope").isin(*EXPORTED) & (_text("unplaced") == "") & F.col("value").isNotNull()).select(_text("code").alias("code"), _text("period").alias("period")).distinct().withColumn("__shown", F.lit(True))
        at = asked.join(shown, ["code", "period"], "left")
        # Evidence is kept where it may be acted on, as that is what is large.
        rows, safe = _weighed(_probed(at, near, amounts, rest, made, named))
        opened = F.col("__shown").isNull()
        refs = F.when(opened & (F.col("source") == PROBES[5][1]), F.transform("evidence", lambda e: e["ref"]))
        rows = rows.withColumns({"__refs": refs, "evidence": F.when(opened & safe & ~(F.col("__moved") & (F.col("cause") == MISALIGNED)), F.col("evidence"))})
        seen = written(rows.drop("__e", "__labels", "__near", "__periods"), "investigated")
        # Others than safe closures are never applied; several steps read these.
        safe = candidates(seen.filter("evidence IS NOT NULL")).filter("safe")
        safe = written(safe.select("gap", "code", "name", "period", "amount", "evidence", "fix", "safe", "reason", "alias", "target_fact", "target_period"), "safe")
        closures = written(accepted(safe, known).filter("safe_to_apply"), "closures")
        takes = claims(closures, free, free_raw)
        takes = written(takes.join(mapped, ["held", "fact_id"], "left_anti") if turn else takes, "claims")
        done = written(applied(closures, takes, there).filter("applied").select("gap", "code", "fix", "target_fact", "target_period"), "applied")
        state = F.when(F.col("__shown"), "closed").otherwise("open")
        told = {c: F.when(F.col("__shown"), "").otherwise(F.col(c)) for c in ("cause", "source", "refs")}
        outcome = seen.select(*own, "period", *[c.alias(n) for n, c in told.items()], state.alias("state"), F.when(F.col("__shown"), F.coalesce("__round", F.lit(turn))).alias("__round"), "__moved", "__refs")
        outcome = written(outcome, "outcome")
        standing = outcome if standing is None else outcome.unionByName(standing.filter("NOT __again").drop("__again", "target_period"))
        if done.isEmpty():
            return standing.withColumn("round", F.col("__round")).drop("__round", "__moved", "__refs")
        turn += 1
        last = done.filter("fix = 'placement_rule'").select(F.col("target_fact").alias("fact_id")).distinct()
        placed = written(placed.unionByName(last).distinct(), "placed")
        mapped = written(mapped.unionByName(takes.select("held", "fact_id")), "mapped")
        # A mapped fact's row, as it now stands among the facts.
        of_facts = takes.filter("held = 0").select("fact_id", F.col("code").alias("__c"))
        new = _sieved(free, "fact_id", _sieve(of_facts, "fact_id")).join(of_facts, "fact_id").withColumns({"code": F.col("__c"), "scope": F.lit(EXPORTED[0]), "unplaced": F.lit("")}).drop("__c")
        gained = written(gained.unionByName(new), "gained")
        unfree = _without(free_raw, mapped.filter("held = 1"), "fact_id")
        # Codes that got or lost a fact: of claims, of placed facts, and the empty one where facts were mapped.
        got = takes.select("code").unionByName(takes.select(F.lit("").alias("code")).limit(1)).unionByName(done.select("code"))
        where = _sieve(last, "fact_id")
        for df in (coded, gained, all_rest, *([free] if blank else [])):
            got = got.unionByName(_sieved(df, "fact_id", where).join(last, "fact_id").select(_text("code").alias("code")))
        moved = done.filter("fix = 'period_role_fix'").select("gap", "target_period")
        touched = written(got.unionByName(standing.join(moved, "gap", "left_semi").select("code")).distinct(), "touched")
        # Evidence of claims by refs: where a raw fact was mapped, the next one takes its place.
        lost = takes.filter("held = 1").select(F.col("fact_id").alias("__ref")).distinct()
        hit = standing.filter("__refs IS NOT NULL").select("gap", F.explode("__refs").alias("__ref")).join(lost, "__ref", "left_semi").select("gap").distinct().withColumn("__hit", F.lit(True))
        flags = standing.join(touched.withColumn("__touched", F.lit(True)), "code", "left").join(moved, "gap", "left").join(hit, "gap", "left")
        again = F.coalesce("__touched", F.lit(False)) | F.col("target_period").isNotNull() | F.coalesce("__hit", F.lit(False))
        standing = written(flags.withColumn("__again", again).drop("__touched", "__hit"), "standing")
        asked = standing.filter("__again").select(*own, F.coalesce("target_period", "period").alias("period"), (F.col("__moved") | F.col("target_period").isNotNull()).alias("__moved"), "__round")
        # Gaps whose code is touched may have any facts; of the others no fact of their code counts.
        codes = written(_sieve(asked, "code"), "sieve")
        near = _sieved(coded.unionByName(gained), "code", codes)
        if blank:
            near = near.unionByName(_without(free, mapped.filter("held = 0"), "fact_id"))
        near = written(near.join(placed.withColumn("__ok", F.lit(True)), "fact_id", "left").withColumn("unplaced", F.when(F.col("__ok"), "").otherwise(F.col("unplaced"))).drop("__ok"), "near")
        rest, made = _sieved(all_rest, "code", codes).join(placed, "fact_id", "left_anti"), _sieved(all_made, "code", codes)
