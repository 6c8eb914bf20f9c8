"""Orders in which facts stand for others: among duplicates, providers, export candidates, formula children.

Each is a list of columns that sort ascending, for best_by() and windows; the last is the fact's id,
so that no order depends on where rows lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.operators.reconcile import status_rank

#: Decisions and comparisons that speak for a fact, and the source that workbooks stand in for.
ACCEPTED = ("accepted_with_validation_support", "accepted_with_rule_support", "accepted")
SETTLED = ("accepted", "equal", "single_provider")
WORKBOOK, DERIVED = "xlsx_fallback", "derived_formula"


def _yes(condition: Column) -> Column:
    """0 where a condition holds, else 1; null doesn't hold."""
    return F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(1)


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def date_score(date: Column) -> Column:
    """3 for a day, 2 for months, 1 for any other known date."""
    text = F.coalesce(date, F.lit(""))
    day = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    return F.when(text.isin("", "unknown_date"), 0).when(day, 3).when(text.endswith("月"), 2).otherwise(1)


def value_quality(value: Column, noisy: Column, raw: Column, status: Column) -> Column:
    """5 for a clean number, 4 for another, 2 for a text that isn't in question, 1 for one that is, else 0."""
    asked = F.coalesce(status, F.lit("")).isin("review", "conflict")
    number, text = value.isNotNull(), _filled(raw)
    return F.when(number & ~F.coalesce(noisy, F.lit(False)), 5).when(number, 4).when(text & ~asked, 2).when(text, 1).otherwise(0)


def source_rank(kind: Column) -> Column:
    return F.when(kind == "json", 2).when(kind == "", 1).otherwise(0)


def _length(path: Column) -> Column:
    return F.coalesce(F.size(path), F.lit(0))


def among_providers(c: dict[str, Column]) -> list[Column]:
    """value quality, date, status, source, a code, the header path's length, the provider's place, the id."""
    quality = value_quality(c["value"], c["noisy"], c["raw"], c["status"])
    return [-quality, -date_score(c["date"]), -status_rank(c["status"]), -source_rank(c["source_kind"]), _yes(_filled(c["code"])), -_length(c["path"]), c["provider_place"], c["fact_id"]]


def among_duplicates(c: dict[str, Column]) -> list[Column]:
    """date, a known statement, a code, status, no workbook, a number, the path's length, a table key, the provider's place, a settled comparison, the id."""
    return [
        -date_score(c["date"]),
        _yes(c["statement_type"] != "unknown"),
        _yes(_filled(c["code"])),
        -status_rank(c["status"]),
        _yes(~c["source_kind"].eqNullSafe(F.lit(WORKBOOK))),
        _yes(c["value"].isNotNull()),
        -_length(c["path"]),
        _yes(_filled(c["table_key"])),
        c["provider_place"],
        _yes(c["comparison"].isin(*SETTLED)),
        c["fact_id"],
    ]


def among_exports(c: dict[str, Column]) -> list[Column]:
    """Not derived, accepted with validation, with rules, chosen in comparison, observed, a code, a known role, the path's length, no workbook, the id."""
    return [
        _yes(~c["source_kind"].eqNullSafe(F.lit(DERIVED))),
        _yes(c["decision"] == ACCEPTED[0]),
        _yes(c["decision"] == ACCEPTED[1]),
        _yes(c["comparison"] == "accepted"),
        _yes(c["status"] == "observed"),
        _yes(_filled(c["code"])),
        _yes(_filled(c["role"]) & (c["role"] != "unknown")),
        -_length(c["path"]),
        _yes(~c["source_kind"].eqNullSafe(F.lit(WORKBOOK))),
        c["fact_id"],
    ]


def among_children(c: dict[str, Column]) -> list[Column]:
    """For formulas: not derived, accepted, observed, a code, the id. Suppressed facts and those without a number are left out by the caller."""
    return [_yes(~c["source_kind"].eqNullSafe(F.lit(DERIVED))), _yes(c["decision"].isin(*ACCEPTED)), _yes(c["status"] == "observed"), _yes(_filled(c["code"])), c["fact_id"]]


#: Bits of the ranks before the id in each order, and the least value of each.
_QUALITY, _DATE, _STATUS, _SOURCE, _YES, _PATH, _PLACE = (3, -5), (2, -3), (3, -5), (2, -2), (1, 0), (20, 1 - 2**20), (24, 0)
SPANS = {
    among_providers: [_QUALITY, _DATE, _STATUS, _SOURCE, _YES, _PATH, _PLACE],
    among_duplicates: [_DATE, _YES, _YES, _STATUS, _YES, _YES, _PATH, _YES, _PLACE, _YES],
    among_exports: [_YES] * 7 + [_PATH, _YES],
    among_children: [_YES] * 4,
}


def packed(order: Callable[[dict[str, Column]], list[Column]], c: dict[str, Column]) -> Column:
    """The ranks of an order but the id as one whole number that sorts as they do, so that rows stay narrow where they are shuffled.

    Paths are shorter than 2^20 and providers' places from 0 to 2^24 - 1; others are an error. A
    place that is null comes first, as in the order itself.
    """
    out = F.lit(0).cast("long")
    for rank, (bits, low) in zip(order(c)[:-1], SPANS[order], strict=True):
        at = F.coalesce(rank.cast("long") - low + 1, F.lit(0))
        fits = at.between(0, 2**bits)
        out = out * (2**bits + 1) + F.when(fits, at).otherwise(F.raise_error(F.lit("a rank is out of its span")).cast("long"))
    return out
