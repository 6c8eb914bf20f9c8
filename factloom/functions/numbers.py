"""Column expressions on amounts as they are printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import clean_text

#: What character recognition mistakes for parts of a number, and what was meant.
MISREAD, MEANT = "，．。！IlO", ",..1110"
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def number_token(text: Column) -> Column:
    """The digits of a printed number: parentheses become a minus (if there is none), one percent sign, commas and spaces go."""
    clean = clean_text(text)
    bare = F.regexp_replace(F.regexp_replace(clean, r"^\((.*)\)$", "$1"), "%$", "")
    digits = F.regexp_replace(bare, "[, ]", "")
    return F.when(clean.rlike(r"^\(.*\)$") & (digits != "") & ~digits.startswith("-"), F.concat(F.lit("-"), digits)).otherwise(digits)


def try_parse(text: Column) -> Column:
    """The number a text prints, null if it prints none; its hundredth if a percent sign is last."""
    token = number_token(text)
    value = F.when(token.rlike(NUMBER), token.try_cast("double"))
    return F.when(clean_text(text).endswith("%"), value / 100).otherwise(value)


def analyze(text: Column, expected: Column) -> Column:
    """struct(value, status, flag, reason): what a cell prints, repaired if a number was expected.

    status: blank, parsed, repaired, unresolved or text; reason says why a cell is suspicious, joined by `|`.
    """
    clean = clean_text(text)
    plain = try_parse(text)
    # Full-width marks are narrowed before misread ones are mended: a wide comma parts thousands.
    mended = try_parse(F.translate(clean, MISREAD, MEANT))
    repaired = expected & plain.isNull() & mended.isNotNull()
    value = F.when(repaired, mended).otherwise(plain)
    status = (
        F.when(clean == "", "blank").when(plain.isNotNull(), "parsed").when(repaired, "repaired").when(expected, "unresolved").otherwise("text")
    )
    flag = F.when(status == "repaired", "repaired_numeric").when(status == "unresolved", "numeric_parse_failed").otherwise("")
    said = [
        (clean.isin("章", "米"), "seal_or_stamp_noise"),
        (clean.rlike("^[A-Za-z]$"), "single_letter_noise"),
        (clean.rlike(r"[\x{4e00}-\x{9fff}]") & clean.rlike("[0-9]"), "contains_chinese_noise"),
        (clean.rlike("[A-Za-z]") & clean.rlike("[0-9]"), "contains_alpha_noise"),
        (value.isNull(), "expected_numeric_but_unparseable"),
    ]
    reasons = F.concat_ws("|", *[F.when(c, F.lit(name)) for c, name in said])
    reason = F.when(expected & (clean != ""), reasons).otherwise("")
    return F.struct(value.alias("value"), status.alias("status"), flag.alias("flag"), reason.alias("reason"))


def value_type(text: Column, value: Column) -> Column:
    clean = clean_text(text)
    return F.when(clean == "", "blank").when(value.isNull(), "text").when(F.contains(clean, F.lit("%")), "ratio").otherwise("amount")


def looks_integer(text: Column) -> Column:
    return F.replace(clean_text(text), F.lit(","), F.lit("")).rlike("^-?[0-9]+$")


def looks_numeric(text: Column) -> Column:
    return number_token(text).rlike(NUMBER)


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole isn't positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def tolerance(least: float, relative: float, *values: Column) -> Column:
    """The larger of an absolute tolerance and a share of the largest value; nulls are passed over."""
    return F.greatest(F.lit(least), *[F.abs(v) * relative for v in values])


def specificity(date: Column) -> Column:
    """3 for a day, 2 for a range of months, 1 for a year, else 0."""
    return F.when(date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), 3).when(F.contains(date, F.lit("月-")), 2).when(date.endswith("年度"), 1).otherwise(0)
