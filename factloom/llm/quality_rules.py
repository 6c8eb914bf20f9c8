"""Quality rules (operator 10): a table of thresholds compiled into one projection.

Everything is a Spark expression over the row's own text; there is no user function and no
shuffle. Each rule is a named ratio of the measures with the least and most that it may be.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import GAP, without

#: Frequent function words of the languages that the rules know.
STOP_WORDS = """
the of and to in is that it for was on are with as be this have from or by not but at an which
le la les de des du un une et est que qui dans pour sur avec par au aux en ou ne pas ce se
der die das und ist von den dem ein eine zu mit auf für im nicht sich als auch es
el los las del que y en un una por con para se su al lo como es
""".split()
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_digits", "n_lines", "n_stop_words"]


@dataclass(frozen=True)
class Rule:
    """A document passes if least <= 100 * part <= most * whole, on measures by name; a whole of "one" is 1; None: no bound."""

    name: str
    part: str
    whole: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Percentages of the whole; ratios over zero pass.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("digits", "n_digits", "word_chars", None, 30),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures as long columns; columns of the same names are replaced.

    n_words, word_chars (code points in words), n_symbols, n_digits, n_lines (lines with a
    word), n_dup_lines (those equal to an earlier one), n_repeat_words, n_stop_words (words that
    are one in lower case, each time). Null and empty texts count as having no words.

    n_repeat_words counts the places that lie in a 3-word window whose words occur, in their
    order, in another window of the text too. A window is known by 64 bits, and the windows are
    sorted with their places, so that n words cost n log n; only texts in which some window
    repeats get that far.
    """
    df = without(df, MEASURES)
    whole = F.coalesce(F.col(text), F.lit(""))
    steps = df.withColumn("__text", whole).withColumn("__trim", F.btrim("__text", F.lit(_SPACES)))
    steps = steps.withColumn("__words", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", GAP)))
    steps = steps.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACES)) != ""))
    words, n = F.col("__words"), F.size("__words")
    windows = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    steps = steps.withColumn("__windows", windows)
    m = F.size("__windows")
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = steps.withColumn("__placed", F.when(F.size(F.array_distinct("__windows")) < m, placed))
    # Of neighbours in sorted order with equal windows, the places of both are marked.
    marked = F.zip_with(F.slice("__placed", 1, m - 1), F.slice("__placed", 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    repeated = F.size(F.array_distinct(F.flatten(F.filter(marked, lambda x: x.isNotNull()))))
    out = {
        "n_words": n,
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.size(F.split("__text", f"[{SYMBOLS}]", -1)) - 1,
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.when(F.col("__placed").isNull(), 0).otherwise(repeated),
        "n_digits": F.size(F.split("__text", "[0-9]", -1)) - 1,
        "n_lines": F.size("__lines"),
        "n_stop_words": F.size(F.filter(F.split(F.lower("__trim"), GAP), lambda w: w.isin(sorted(set(STOP_WORDS))))),
    }
    return steps.withColumns({k: v.cast("long") for k, v in out.items()}).drop("__text", "__trim", "__words", "__lines", "__windows", "__placed")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where the measures pass every rule of the table."""
    checks = []
    for rule in rules:
        part, whole = F.col(rule.part), F.lit(1) if rule.whole == "one" else F.col(rule.whole)
        checks += [100 * part >= rule.least * whole] if rule.least is not None else []
        checks += [100 * part <= rule.most * whole] if rule.most is not None else []
    return reduce(Column.__and__, checks, F.lit(True))


def quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """df with its measures, base_failed and kept; replaced if there already.

    base_failed: fewer than least_words words, or more than most_repeated percent of them in
    repeated windows. kept: not base_failed, and within every rule.
    """
    rows = measured(without(df, ["base_failed", "kept"]), text)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
