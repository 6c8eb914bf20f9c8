"""Column expressions on labels and other text of facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width characters and what they are read as.
WIDE, NARROW = "，：；（）【】％－—　．、", ",:;()[]%-- .,"
#: Unicode's white space, spelled out since engines differ on \s.
SPACE = r"[ \t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What may stand before a label.
ENUMERATION = r"^(([一二三四五六七八九十]+[、,，.])|([(（]?[0-9]+[)）.]))"
SUBJECT_ENUMERATION = r"^(([一二三四五六七八九十]+[、,，.])|([(（]?[0-9]+[)）.]?))"
SUBJECT_PREFIXES = ("其中", "减", "加", "注")
PREFIXES = ("其中:", "减:", "加:", "注:", "其中", "减", "加")


def clean_text(text: Column) -> Column:
    """Full-width punctuation narrowed, zero-width spaces dropped, white space runs made one space."""
    narrow = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), WIDE, NARROW), "​", "")
    return F.trim(F.regexp_replace(narrow, f"{SPACE}+", " "))


def label_for_matching(text: Column) -> Column:
    """A cleaned label without trailing colons and without spaces."""
    return F.replace(F.regexp_replace(clean_text(text), ":+$", ""), F.lit(" "), F.lit(""))


def subject_label(text: Column) -> Column:
    """A matching label without enumeration, without one leading word of the prefixes (a colon after
    it stays), and without a trailing parenthesis of at most 20."""
    bare = F.regexp_replace(label_for_matching(text), SUBJECT_ENUMERATION, "")
    bare = F.regexp_replace(bare, f"^({'|'.join(SUBJECT_PREFIXES)})", "")
    return F.trim(F.regexp_replace(bare, r"[（(][^()（）]{1,20}[)）]$", ""))


def canonical_label(text: Column, synonyms: dict[str, str] | None = None, prefixes: tuple[str, ...] = PREFIXES) -> dict[str, Column]:
    """norm, candidate and the number of enumerations taken off.

    All leading enumerations go, then one prefix, then trailing punctuation, then inner white
    space, colons and commas; a synonym map gives the candidate.
    """
    clean = clean_text(text)
    repeated = ENUMERATION.replace("^(", "^(?:(?:", 1) + ")+"
    lead = F.regexp_extract(clean, repeated, 0)
    norm = F.regexp_replace(clean, repeated, "")
    norm = F.regexp_replace(norm, f"^({'|'.join(prefixes)})", "")
    norm = F.regexp_replace(F.regexp_replace(norm, r"[:：;,，]+$", ""), r"[ \t:：,，]", "")
    candidate = norm
    for said, meant in (synonyms or {}).items():
        candidate = F.when(norm == said, F.lit(meant)).otherwise(candidate)
    marks = F.size(F.regexp_extract_all(lead, F.lit(r"[、,，.)）]"), F.lit(0)))
    return {"norm": norm, "candidate": candidate, "enumerations": marks}


def first_contained(text: Column, kinds: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first kind, in order, of which the text contains a keyword."""
    out = F.lit(default)
    for kind, words in reversed(kinds.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def stable_hash(*parts: Column, length: int = 12) -> Column:
    """The first hex digits of the SHA-1 of the stripped parts joined by `||`; null parts are empty."""
    bare = lambda p: F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    joined = F.concat_ws("||", *[bare(p) for p in parts])
    return F.substring(F.sha1(joined.cast("binary")), 1, length)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), stable_hash(*parts))


def listed(values: Column) -> Column:
    """An array of strings as it enters ids: sorted, in brackets."""
    return F.concat(F.lit("["), F.array_join(F.array_sort(values), ","), F.lit("]"))


def semantic_token(text: Column) -> Column:
    """Up to 24 characters of a matching label; numbers are empty."""
    label = label_for_matching(text)
    return F.when(F.replace(label, F.lit(","), F.lit("")).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.lit("")).otherwise(F.substring(label, 1, 24))


def part(text: Column, at: int, by: str = ":") -> Column:
    """The at-th part of a reference (from 1), empty where there is none."""
    return F.coalesce(F.get(F.split(text, by, -1), F.lit(at - 1)), F.lit(""))


def redacted(text: Column, secrets: list[str], mask: str = "***") -> Column:
    out = text
    for secret in secrets:
        out = F.replace(out, F.lit(secret), F.lit(mask)) if secret else out
    return out


def compact_json(*fields: Column) -> Column:
    """Named fields as JSON in alphabetical order; nulls stay."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def truthy(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("1", "true", "yes", "y", "on")
