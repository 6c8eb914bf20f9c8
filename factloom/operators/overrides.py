"""Reviewers' actions as versions of override entries, and what the entries do to facts.

An action is valid or has a reason why not; a valid one becomes an entry of one of five kinds.
Entries are versions: each holds from its position until the next of its kind and key. Nulls in
text columns are empty, and an empty key matches nothing.

Actions have (position, review_id, action_type, action_value, fact_id, source_cell_ref,
row_label_std, row_label_raw, candidate_mapping_code, candidate_mapping_name,
candidate_conflict_fact_id, candidate_period_override, suggested_reocr_task_id,
related_conflict_ids, candidate_conflict_id, reviewer_note); columns that are missing are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import label_for_matching, stable_id

#: Kinds of entries, their scopes and messages by action; files of entries by kind.
ACTIONS = {
    "accept_mapping_alias": ("mapping", "global_label_alias", "mapping_alias_override_applied"),
    "set_mapping_override": ("mapping", "local_fact_mapping", "local_mapping_override_applied"),
    "set_conflict_winner": ("conflict", "conflict", "conflict_winner_override_applied"),
    "set_period_override": ("period", "fact_period", "period_override_applied"),
    "suppress_false_positive": ("suppression", "fact_suppression", "suppression_override_applied"),
    "mark_not_financial_fact": ("suppression", "fact_suppression", "suppression_override_applied"),
    "request_reocr": ("placement", "review_item", "placement_review_override_applied"),
    "accept_relation_review_only": ("placement", "review_item", "placement_review_override_applied"),
    "ignore": ("placement", "review_item", "placement_review_override_applied"),
    "defer": ("", "review_item", "deferred_no_override_written"),
}
MAPPINGS = ("accept_mapping_alias", "set_mapping_override")
#: What an action needs beside its value, and the reason without either.
NEEDS = (
    (MAPPINGS, "candidate_mapping_code", "mapping_code_missing"),
    (("set_conflict_winner",), "candidate_conflict_fact_id", "conflict_winner_missing"),
    (("set_period_override",), "candidate_period_override", "period_override_missing"),
    (("request_reocr",), "suggested_reocr_task_id", "reocr_task_missing"),
)
COLUMNS = ("review_id", "action_type", "action_value", "fact_id", "source_cell_ref", "row_label_std", "row_label_raw", "candidate_mapping_code", "candidate_mapping_name", "candidate_conflict_fact_id", "candidate_period_override", "suggested_reocr_task_id", "related_conflict_ids", "candidate_conflict_id", "reviewer_note")


def _or(*columns: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def validated(actions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Actions with action_id and reject_reason, which is null for valid ones; rows without an action go."""
    texts = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in actions.columns else F.lit("").alias(c) for c in COLUMNS]
    rows = actions.select("position", *texts).filter("action_type <> ''")
    known = reviews.select(F.trim(F.col("review_id").cast("string")).alias("review_id")).distinct().withColumn("__known", F.lit(True))
    rows = rows.join(known, "review_id", "left")
    why = F.when(~F.col("action_type").isin(*ACTIONS), "unsupported_action_type").when(F.col("__known").isNull(), "review_id_not_found")
    for names, field, reason in NEEDS:
        why = why.when(F.col("action_type").isin(*names) & (_or(F.col("action_value"), F.col(field)) == ""), reason)
    return rows.withColumns({"action_id": stable_id("ACT_", F.col("review_id"), F.col("action_type"), F.col("action_value")), "reject_reason": why}).drop("__known")


def entries(actions: DataFrame) -> DataFrame:
    """Valid actions as entries: kind (empty if none is written), target, scope, message, new_state and what the kind needs.

    Of repeated actions (one review item, action and value) the last stands.
    """
    c = F.col
    at = lambda k: reduce(lambda out, x: F.when(c("action_type") == x[0], x[1][k]).otherwise(out), ACTIONS.items(), F.lit(""))
    valid = actions.filter("reject_reason IS NULL")
    rest = [x for x in valid.columns if x != "action_id"]
    valid = valid.groupBy("action_id").agg(F.max_by(F.struct(*rest), F.struct("position", *[x for x in rest if x != "position"])).alias("b")).select("action_id", "b.*")
    is_map, is_conflict, is_period = c("action_type").isin(*MAPPINGS), c("action_type") == "set_conflict_winner", c("action_type") == "set_period_override"
    value = lambda field: _or(c("action_value"), c(field))
    suppresses = at(0) == "suppression"
    conflict = _or(F.trim(F.split_part(_or(c("related_conflict_ids"), c("candidate_conflict_id")), F.lit(","), F.lit(1))), c("review_id"))
    winner = value("candidate_conflict_fact_id")
    by_provider = winner.startswith("provider:")
    code = F.when(is_map, value("candidate_mapping_code")).otherwise("")
    period = F.when(is_period, value("candidate_period_override")).otherwise("")
    fact = F.when(c("action_type") == "set_mapping_override", _or(c("candidate_conflict_fact_id"), c("fact_id"))).when(is_conflict, c("candidate_conflict_fact_id")).when(suppresses, c("fact_id")).otherwise("")
    local = is_period | suppresses | (c("action_type") == "set_mapping_override")
    state = F.when(is_map, F.concat(code, F.lit(":"), c("candidate_mapping_name"))).when(is_conflict, winner).when(is_period, period).when(c("action_type") == "defer", "deferred").otherwise(c("action_type"))
    return valid.select(
        c("action_id").alias("override_id"), "position", "review_id", "action_type", at(0).alias("kind"), at(1).alias("target_scope"), at(2).alias("message"),
        F.when(is_conflict, conflict).when(c("action_type") == "accept_mapping_alias", code).when(local, _or(c("fact_id"), c("review_id"))).otherwise(c("review_id")).alias("target_id"),
        state.alias("new_state"), fact.alias("fact_id"), "source_cell_ref", code.alias("code"), F.when(is_map, c("candidate_mapping_name")).otherwise("").alias("name"),
        F.when(c("action_type") == "accept_mapping_alias", _or(c("row_label_std"), c("row_label_raw"))).otherwise("").alias("alias"),
        F.when(c("action_type") == "accept_mapping_alias", label_for_matching(c("row_label_std"))).otherwise("").alias("label_key"),
        F.when(is_conflict, conflict).otherwise("").alias("conflict_id"), F.when(is_conflict & ~by_provider, winner).otherwise("").alias("winner_fact_id"),
        F.when(is_conflict & by_provider, F.substring_index(winner, "provider:", -1)).otherwise("").alias("winner_provider"),
        period.alias("period_key"), c("reviewer_note").alias("note"),
    )


def versions(found: DataFrame, subjects: DataFrame) -> DataFrame:
    """Entries with what they key on (by_fact, by_ref, by_label, by_conflict, by_review) and the span of positions
    [valid_from, valid_to) in which they are the last of their kind and key; an entry has a row for each of its keys.

    Mapping entries key on the first of fact, cell and label that they have; period and
    suppression entries on both fact and cell. A mapping to a code that no subject has is none, so
    it doesn't end the version before it.
    """
    c = F.col
    key = lambda name, of, when: F.when(when & (c(of) != ""), F.struct(F.lit(name).alias("by"), c(of).alias("key")))
    is_map = c("kind") == "mapping"
    both = c("kind").isin("period", "suppression")
    keys = F.array(
        key("fact", "fact_id", is_map | both | (c("kind") == "placement")),
        key("ref", "source_cell_ref", both | (is_map & (c("fact_id") == ""))),
        key("label", "label_key", is_map & (c("fact_id") == "") & (c("source_cell_ref") == "")),
        key("conflict", "conflict_id", c("kind") == "conflict"),
        key("review", "review_id", c("kind") == "placement"),
    )
    known = subjects.select(F.col("code").alias("__code"), F.lit(True).alias("__known")).distinct()
    found = found.join(known, (c("kind") == "mapping") & (c("code") == c("__code")), "left").filter("kind <> 'mapping' OR __known").drop("__code", "__known")
    rows = found.filter("kind <> ''").withColumn("__k", F.explode(F.filter(keys, lambda k: k.isNotNull()))).select("*", "__k.*").drop("__k")
    later = Window.partitionBy("kind", "by", "key").orderBy("position", "override_id")
    return rows.withColumns({"valid_from": c("position"), "valid_to": F.lead("position").over(later)})


def standing(dimension: DataFrame, position: Column | None = None) -> DataFrame:
    """The versions that hold at a position, or now."""
    if position is None:
        return dimension.filter("valid_to IS NULL")
    return dimension.filter((F.col("valid_from") <= position) & (F.col("valid_to").isNull() | (F.col("valid_to") > position)))


def _joined(facts: DataFrame, held: DataFrame, kind: str, keys: dict[str, Column], fields: list[str]) -> DataFrame:
    """facts with __e, the entry of the first of the keys that has one."""
    out = facts
    for by, key in keys.items():
        own = held.filter((F.col("kind") == kind) & (F.col("by") == by)).select(F.col("key").alias(f"__k{by}"), F.struct(*fields).alias(f"__e{by}"))
        out = out.join(own, key == F.col(f"__k{by}"), "left").drop(f"__k{by}")
    return out.withColumn("__e", F.coalesce(*[F.col(f"__e{by}") for by in keys])).drop(*[f"__e{by}" for by in keys])


def _set(facts: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    old = lambda n: F.col(n) if n in facts.columns else F.lit("")
    return facts.withColumns({n: F.when(when, v).otherwise(old(n)) for n, v in values.items()}).drop("__e")


def mapped(facts: DataFrame, held: DataFrame, subjects: DataFrame) -> DataFrame:
    """facts (fact_id, source_cell_ref, row_label_std, row_label_raw, code, name) with overridden codes.

    subjects: (code, name), unique by code.
    """
    own = held.filter("kind = 'mapping'").drop("name").join(subjects.select("code", F.col("name").alias("__name")), "code")
    label = label_for_matching(_or(F.coalesce("row_label_std", F.lit("")), F.coalesce("row_label_raw", F.lit(""))))
    rows = _joined(facts, own, "mapping", {"fact": F.col("fact_id"), "ref": F.col("source_cell_ref"), "label": label}, ["code", "__name", "action_type"])
    method = F.when(F.col("__e.action_type") == "accept_mapping_alias", "manual_alias").otherwise("manual_override")
    return _set(rows, F.col("__e.__name").isNotNull(), {"code": F.col("__e.code"), "name": F.col("__e.__name"), "mapping_method": method, "override_source": F.lit("manual_override")})


def dated(facts: DataFrame, held: DataFrame) -> DataFrame:
    """facts with overridden period_key, report_date and period_role, by fact and then by cell."""
    rows = _joined(facts, held, "period", {"fact": F.col("fact_id"), "ref": F.col("source_cell_ref")}, ["period_key", "note"])
    k = F.col("__e.period_key")
    split = k.contains("__")
    date, role = F.substring_index(k, "__", 1), F.expr("substring(__e.period_key, locate('__', __e.period_key) + 2)")
    keep = lambda part, old: F.when(split & (part != ""), part).otherwise(F.col(old))
    values = {"period_key": k, "report_date": keep(date, "report_date"), "period_role": keep(role, "period_role"), "period_source": F.lit("manual_override"), "period_reason": _or(F.col("__e.note"), F.lit("manual_period_override")), "override_source": F.lit("manual_override")}
    return _set(rows, F.col("__e").isNotNull() & (k != ""), values)


def suppressed(facts: DataFrame, held: DataFrame) -> DataFrame:
    """facts with status suppressed, its reason and, where it had none, a reason not to be placed."""
    rows = _joined(facts, held, "suppression", {"fact": F.col("fact_id"), "ref": F.col("source_cell_ref")}, ["action_type", "note"])
    why = F.col("__e.action_type")
    return _set(rows, F.col("__e").isNotNull(), {"status": F.lit("suppressed"), "suppression_reason": _or(F.col("__e.note"), why), "unplaced": _or(F.coalesce("unplaced", F.lit("")), why), "override_source": F.lit("manual_override")})


def decided(facts: DataFrame, conflicts: DataFrame, found: DataFrame, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(facts, conflicts) after the last entry of each conflict whose winner exists.

    A winner is a fact by id, or else the first fact (by position) of the conflict and provider.
    facts: (fact_id unique, position, conflict_id, provider, status); conflicts: (conflict_id
    unique). With merge the winner becomes observed and the conflict's other facts conflict.
    """
    asked = found.filter("kind = 'conflict'").join(conflicts.select("conflict_id").distinct(), "conflict_id", "left_semi")
    asked = asked.select("conflict_id", F.struct("position", "override_id").alias("__at"), "winner_fact_id", "winner_provider", "note")
    one = facts.select(F.col("fact_id").alias("winner_fact_id"), F.col("provider").alias("__p"))
    first = facts.filter("conflict_id <> ''").groupBy("conflict_id", F.col("provider").alias("winner_provider")).agg(F.min_by("fact_id", F.struct("position", "fact_id")).alias("__f"))
    rows = asked.join(one, "winner_fact_id", "left").join(first, ["conflict_id", "winner_provider"], "left")
    fact = F.when(F.col("__p").isNotNull(), F.col("winner_fact_id")).otherwise(F.col("__f"))
    rows = rows.select("conflict_id", "__at", fact.alias("__fact"), F.coalesce("__p", "winner_provider").alias("__provider"), _or(F.col("note"), F.lit("manual_conflict_override")).alias("__why")).filter("__fact IS NOT NULL")
    last = rows.groupBy("conflict_id").agg(F.max_by(F.struct("__fact", "__provider", "__why"), "__at").alias("__e"))
    support = F.lit("accepted_with_rule_support")
    hit = F.col("__e").isNotNull()
    values = {"conflict_decision": support, "override_source": F.lit("manual_override")}
    if merge:
        won = F.col("fact_id") == F.col("__e.__fact")
        values |= {"status": F.when(won, "observed").otherwise("conflict"), "comparison_status": F.when(won, "accepted").otherwise("conflict"), "comparison_reason": F.col("__e.__why")}
    out = _set(facts.join(last, "conflict_id", "left"), hit, values)
    done = conflicts.join(last, "conflict_id", "left")
    kept = done.withColumn("needs_review", ~hit & (F.col("needs_review") if "needs_review" in conflicts.columns else F.lit(True)))
    return out, _set(kept, hit, {"decision": support, "reason": F.col("__e.__why"), "accepted_provider": F.col("__e.__provider").cast("string"), "accepted_fact_id": F.col("__e.__fact")})


def open_reviews(reviews: DataFrame, found: DataFrame) -> DataFrame:
    """Review items that no entry closes."""
    closed = found.filter(F.col("action_type").isin("ignore", "accept_relation_review_only")).select("review_id").distinct()
    return reviews.join(closed, "review_id", "left_anti")


def touched(facts: DataFrame, new: DataFrame) -> DataFrame:
    """The facts that versions can change: a rerun after new actions needs these only."""
    label = label_for_matching(_or(F.coalesce("row_label_std", F.lit("")), F.coalesce("row_label_raw", F.lit(""))))
    keys = {"fact": F.col("fact_id"), "ref": F.col("source_cell_ref"), "label": label, "conflict": F.col("conflict_id")}
    own = new.filter(F.col("by").isin(*keys)).select("by", "key").distinct()
    spread = facts.select("fact_id", F.explode(F.array(*[F.struct(F.lit(b).alias("by"), k.alias("key")) for b, k in keys.items()])).alias("__k")).select("fact_id", "__k.*")
    return facts.join(spread.join(own, ["by", "key"], "left_semi").select("fact_id").distinct(), "fact_id", "left_semi")
