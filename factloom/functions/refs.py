"""Column expressions on references to cells, boxes, and lists of codes in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import clean_text


def cell_ref(doc: Column, page: Column, provider: Column, table: Column, top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """document:page:provider:table:top-bottom:left-right."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(*[p for c in (doc, page, provider, table) for p in (text(c), F.lit(":"))], text(top), F.lit("-"), text(bottom), F.lit(":"), text(left), F.lit("-"), text(right))


def text_lines(text: Column) -> Column:
    """The cleaned lines of a text that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n", -1), clean_text), lambda x: x != "")


def letters_and_digits(text: Column, most: int = 24) -> Column:
    """Up to `most` letters and digits of a text."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""), 1, most)


def codes(text: Column) -> Column:
    """Codes listed as JSON or parted by commas or bars: distinct, sorted, joined by `|`. Broken JSON is read as a plain list."""
    plain = F.split(F.regexp_replace(text, r'^\s*\[|\]\s*$|"', ""), r"[,|]")
    listed = F.when(F.trim(text).startswith("["), F.coalesce(F.from_json(text, "array<string>"), plain)).otherwise(plain)
    clean = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_sort(F.array_distinct(clean)), "|")


def box(text: Column) -> Column:
    """The first four numbers of a box in text, rounded half to even and joined by commas; empty if there are fewer."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.bround(x.cast("double"), 0).cast("long").cast("string"))
    return F.when(F.size(numbers) >= 4, F.array_join(F.slice(numbers, 1, 4), ",")).otherwise("")


def seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end with their fraction, at least 0; 0 where either is missing."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(F.lit(0.0), F.coalesce(micros / 1e6, F.lit(0.0)))
