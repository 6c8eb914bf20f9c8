"""Missing benchmark cells whose header wasn't understood: other periods for them, or why there is none."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons that alignment can mend, roles of old headers, words of statements.
REASONS = ("legacy_header_unsupported", "legacy_role_exact_date_match", "legacy_role_unique_match", "ambiguous_period_alignment", "no_matching_period_for_legacy_role", "period_key_not_found")
CURRENT, YEAR = "__本期", "年度"
INCOME_WORDS = ("收入", "成本", "利润", "费用", "税金", "所得税", "营业外")
CASH_WORDS = ("现金流", "经营活动", "投资活动", "筹资活动")


@dataclass(frozen=True)
class Rules:
    roles: dict[str, str] = field(default_factory=dict)
    amounts: tuple[str, ...] = ("金额",)
    annual: tuple[str, ...] = ("income_statement", "cash_flow")
    tolerance: float = 0.01


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _words(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def code_hints(facts: DataFrame) -> DataFrame:
    """(code, hint, own): the most frequent statement type of each code's facts, of equals the one seen first; and its only yearly current period, null where there are several."""
    date = F.coalesce(F.when(F.col("report_date") != "", F.col("report_date")), F.substring_index("period", "__", 1))
    yearly = F.when(F.col("period").endswith(CURRENT) & date.contains(YEAR), F.col("period"))
    kind = F.coalesce("statement_type", F.lit(""))
    told = facts.filter("code <> ''").groupBy("code", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("p"), F.min(yearly).alias("low"), F.max(yearly).alias("high"))
    typed = F.when(F.col("kind") != "", F.struct("n", -F.col("p"), "kind"))
    each = told.groupBy("code").agg(F.max(typed)["kind"].alias("hint"), F.min("low").alias("low"), F.max("high").alias("high"))
    return each.select("code", "hint", F.when(F.col("low") == F.col("high"), F.col("low")).alias("own"))


def header_periods(headers: DataFrame, rules: Rules) -> DataFrame:
    """(header, n, only): how many of the export's periods each old header may mean, and the only one.

    A header of a role means the periods that end in it, a header of amounts the yearly current ones.
    """
    p = F.col("period")
    yearly = p.endswith(CURRENT) & F.substring_index(p, "__", 1).contains(YEAR)
    # A header of both kinds counts as one of a role.
    asked = [F.when(p.endswith(f"__{role}"), F.lit(h)) for h, role in rules.roles.items()] + [F.when(yearly, F.lit(h)) for h in rules.amounts if h not in rules.roles]
    if not asked:
        return headers.sparkSession.createDataFrame([], "header string, n long, only string")
    rows = headers.select("period", F.explode(F.array(*asked)).alias("header")).filter("header IS NOT NULL").distinct()
    return rows.groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.min("period").alias("only"))


def overridden(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """(cell, override): the period of the first override of a cell's code that doesn't name another header or value."""
    mine = overrides.select("position", _text("code").alias("__c"), _text("header").alias("__h"), F.round("value", 6).alias("__v"), _text("period").alias("__p")).filter("__p <> ''")
    fits = ((F.col("__h") == "") | (F.col("__h") == _text("header"))) & F.coalesce(F.col("__v") == F.round("benchmark_value", 6), F.lit(True))
    met = cells.select("cell", "code", "header", "benchmark_value").join(mine, (_text("code") == F.col("__c")) & fits)
    return met.groupBy("cell").agg(F.min_by("__p", F.struct("position", "__p")).alias("override"))


def repair(cells: DataFrame, facts: DataFrame, headers: DataFrame, export: DataFrame, overrides: DataFrame, rules: Rules) -> DataFrame:
    """cells with period, auto_value, status and reason as repaired, the raw ones beside them, and alignment.

    cells: (cell unique, code, name, header, period, benchmark_value, auto_value, status, reason);
    facts: (position, code, period, report_date, statement_type); headers: (period) of the export;
    export: (code, period, value) unique by both; overrides: (position, code, header, value, period).
    Ways in their order: override, role of the header, amount header (the code's only yearly
    period, else the export's), the period that the cell has. Where several fit the alignment is
    ambiguous_alignment, where none does true_missing; a period that has a value makes it
    alignment_only_gap. Other cells are unchanged. Null texts are empty.
    """
    old = {"period": "raw_period", "auto_value": "raw_auto_value", "status": "raw_status", "reason": "raw_reason"}
    could = (F.col("status") == "missing_in_auto") & F.col("reason").isin(*REASONS)
    hurt = cells.filter(could)
    rows = cells.join(overridden(hurt, overrides), "cell", "left").join(code_hints(facts).withColumnRenamed("own", "__own"), "code", "left")
    # At most a row for each header of the rules, which all cells share.
    rows = rows.join(F.broadcast(header_periods(headers, rules).select(F.col("header").alias("__h"), "n", "only")), _text("header") == F.col("__h"), "left")
    header, n, raw = _text("header"), F.coalesce("n", F.lit(0)), _text("period")
    guess = F.when(F.col("hint") != "", F.col("hint")).when(_words(_text("name"), INCOME_WORDS), "income_statement").when(_words(_text("name"), CASH_WORDS), "cash_flow")
    annual = F.coalesce(guess.isin(*rules.annual), F.lit(False))
    in_role = header.isin(*rules.roles) if rules.roles else F.lit(False)
    in_amounts = header.isin(*rules.amounts) & ~in_role & annual
    way = lambda period, reason, state: F.struct(period.alias("period"), reason.alias("reason"), F.lit(state).alias("state"))
    none, same = F.lit(""), F.col("reason")
    found = (
        F.when(F.col("override").isNotNull(), way(F.col("override"), F.lit("runtime_alignment_override"), ""))
        .when((same == "legacy_header_unsupported") & in_role & (n == 1), way(F.col("only"), F.concat(F.lit("legacy_role_repaired:"), header), ""))
        .when((same == "legacy_header_unsupported") & in_amounts & F.col("__own").isNotNull(), way(F.col("__own"), F.lit("legacy_amount_current_period_match"), ""))
        .when((same == "legacy_header_unsupported") & in_amounts & (n == 1), way(F.col("only"), F.lit("legacy_amount_current_period_match"), ""))
        .when((same == "legacy_header_unsupported") & (in_role | in_amounts) & (n > 1), way(none, same, "ambiguous_alignment"))
        .when(same == "legacy_header_unsupported", way(none, same, "true_missing"))
        .when(same == "ambiguous_period_alignment", way(raw, same, "ambiguous_alignment"))
        .otherwise(way(raw, same, "true_missing"))
    )
    rows = rows.withColumn("__w", F.when(could, found)).drop("override", "__own", "__h", "n", "only")
    values = export.select(F.col("code").alias("__ec"), F.col("period").alias("__ep"), F.col("value").alias("__ev"))
    rows = rows.join(values, (F.col("code") == F.col("__ec")) & (F.col("__w.period") == F.col("__ep")), "left")
    b, a = F.col("benchmark_value"), F.col("__ev")
    vague = F.col("__w.reason") == "ambiguous_period_alignment"
    close = F.abs(b - a) <= rules.tolerance
    status = F.when(vague, "missing_in_auto").when(b.isNull() & a.isNull(), "match").when(a.isNull(), "missing_in_auto").when(b.isNull(), "extra_in_auto").when(close, "match").otherwise("value_diff")
    told = F.when(vague | (b.isNull() != a.isNull()), F.col("__w.reason")).when(b.isNull(), "both_empty").when(close, "numeric_close").otherwise("numeric_mismatch")
    moved = F.coalesce(F.col("__w.period") != "", F.lit(False))
    state = F.when(F.col("__w").isNull(), "unchanged").when(~moved, F.col("__w.state")).when(status == "missing_in_auto", "true_missing").otherwise("alignment_only_gap")
    new = {"period": F.col("__w.period"), "auto_value": a, "status": status, "reason": told}
    before = {kept: F.col(c) for c, kept in old.items()}
    return rows.withColumns({"alignment": state, **before, **{c: F.when(moved, v).otherwise(F.col(c)) for c, v in new.items()}}).drop("__w", "__ec", "__ep", "__ev")


def true_gaps(repaired: DataFrame) -> DataFrame:
    """The cells that are still missing, without ambiguous ones."""
    return repaired.filter("status = 'missing_in_auto' AND alignment <> 'ambiguous_alignment'")


def gap_counts(repaired: DataFrame) -> DataFrame:
    """Cells still missing by code and by period (else header), in one pass: (dimension, value, missing_cells)."""
    at = F.coalesce(F.when(_text("period") != "", F.col("period")), F.col("header"))
    ways = F.array(F.struct(F.lit("subject").alias("dimension"), F.col("code").alias("value")), F.struct(F.lit("period").alias("dimension"), at.alias("value")))
    return true_gaps(repaired).select(F.explode(ways).alias("w")).groupBy("w.dimension", "w.value").agg(F.count(F.lit(1)).alias("missing_cells"))


def alignment_counts(repaired: DataFrame) -> DataFrame:
    """One row: cells missing before and now, alignment gaps and ambiguous cells."""
    c = F.count_if
    return repaired.agg(c(F.col("raw_status") == "missing_in_auto").alias("missing_raw"), c((F.col("status") == "missing_in_auto") & (F.col("alignment") != "ambiguous_alignment")).alias("missing_true"), c(F.col("alignment") == "alignment_only_gap").alias("alignment_only"), c(F.col("alignment") == "ambiguous_alignment").alias("ambiguous"))
