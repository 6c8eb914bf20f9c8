"""Line dedup (operator 9): lines within an edit distance of an earlier line of the corpus go.

Every line that isn't blank is compared: exact repeats are found by 128 bits of the line at any
length, near ones from threshold + 1 code points, the shortest that have as many segments. A line
of length n is cut into threshold + 1 segments; of two lines within the threshold, one has a segment of the other unchanged, not far
from its place (pigeonhole). Every distinct line is entered under its segments, and probes the
segments of lines as long as itself or up to the threshold shorter, at the few places where
they can lie. A line goes by one earlier neighbour, so each is compared with its segments' first
lines at first, which costs as much as there are lines; those that are left after that are compared
with the rest of their segments in blocks. Confirmed is what within() says, a bit-parallel edit
distance on the band of the matrix that can matter; pairs whose sketches of character pairs differ
in more bits than so many edits can change never get there. DataFrame functions only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hash128, settled, without

THRESHOLD = 2
LEAST = 1
#: A segment's lines are compared in blocks of at most about so many lines and characters.
BLOCK = 512
BLOCK_CHARS = 2_000_000


def _cuts(lines: DataFrame, threshold: int) -> DataFrame:
    """lines (n, line) with the start (from 1) and length of each segment of a line of n - d code
    points as columns `at_d_k` and `size_d_k`; the last segments are longer."""
    parts, cuts = threshold + 1, {}
    for d in range(threshold + 1):
        short, longer = F.expr(f"int((n - {d}) div {parts})"), F.expr(f"(n - {d}) % {parts}")
        for k in range(parts):
            cuts[f"at_{d}_{k}"] = (F.lit(k) * short + F.greatest(F.lit(0), longer - (parts - k)) + 1).cast("int")
            cuts[f"size_{d}_{k}"] = (short + (longer + k >= parts).cast("int")).cast("int")
    return lines.withColumns(cuts)


def _entries(threshold: int) -> list[Column]:
    """The hashes under which a line is entered: its segments, with their number and its length."""
    return [F.xxhash64(F.lit(k), "n", F.col("line").substr(F.col(f"at_0_{k}"), F.col(f"size_0_{k}"))) for k in range(threshold + 1)]


def _probes(threshold: int) -> list[Column]:
    """The hashes under which lines no longer than this one may be entered.

    With d = the difference of lengths, segment k can have moved by i places only if the edits
    left of it (at least |i|) and right of it (at least |d - i|) leave enough: both bounds of
    the multi-match-aware selection hold. Places beyond the ends of very short lines only give
    candidates that are refused later.
    """
    parts, out = threshold + 1, []
    for d in range(threshold + 1):
        for k in range(parts):
            low, high = max(-k, d - (parts - 1 - k)), min(k, d + (parts - 1 - k))
            for i in range(low, high + 1):
                out.append(F.xxhash64(F.lit(k), F.col("n") - d, F.col("line").substr(F.col(f"at_{d}_{k}") + i, F.col(f"size_{d}_{k}"))))
    return out


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _compared(line: Column, least: int) -> Column:
    return (F.length(line) >= least) & line.rlike(r"(?U)\S")


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two strings are within an edit distance (at most 30) of each other.

    Bit-parallel, over the band of 2 * threshold + 1 diagonals: two bit vectors hold where, in the
    current column, the distance grows or falls from one row of the band to the next, and all rows
    advance by a few operations on whole numbers. The distance on the middle diagonal is counted
    along, and ends early once it can't come back; the last column's vectors lead from there to the
    last row. Columns are those of the shorter string.
    """
    band, middle = (1 << (2 * threshold + 1)) - 1, 1 << threshold
    bits = lambda n: F.lit(n).cast("long")
    let = lambda value, then: F.transform(F.array(value), then)[0]

    def column(p: Column, state: Column) -> Column:
        char = F.get(p["short"], state["j"])
        same = [F.when(F.get(p["long"], state["j"] + (x - threshold)) == char, bits(1 << x)).otherwise(bits(0)) for x in range(2 * threshold + 1)]
        matches = functools.reduce(lambda u, v: u.bitwiseOR(v), same)
        up, down = state["up"], state["down"]
        sums = lambda m: (m.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(m).bitwiseOR(down).bitwiseAND(bits(band))

        def shifted(zero: Column) -> Column:
            right = F.bitwise_not(zero.bitwiseOR(up)).bitwiseOR(down).bitwiseAND(bits(band))
            lower = F.shiftright(zero, 1)
            grows = F.bitwise_not(lower.bitwiseOR(right)).bitwiseOR(zero.bitwiseAND(up)).bitwiseAND(bits(band))
            more = F.when(zero.bitwiseAND(bits(middle)) == 0, 1).otherwise(0)
            return F.struct((state["j"] + 1).alias("j"), grows.alias("up"), lower.bitwiseAND(right).alias("down"), (state["far"] + more).alias("far"))

        return let(let(matches, sums), shifted)

    def distance(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("j"), bits(band - middle + 1).alias("up"), bits(0).alias("down"), F.lit(0).alias("far"))
        apart = F.size(p["long"]) - F.size(p["short"])
        rows = (F.call_function("shiftleft", bits(1), apart) - 1) * middle
        end = lambda s: s["far"] + F.bit_count(s["up"].bitwiseAND(rows)) - F.bit_count(s["down"].bitwiseAND(rows))
        return F.aggregate(p["short"], start, lambda s, _: F.when(s["far"] > threshold + apart, s).otherwise(column(p, s)), end)

    first = F.length(a) >= F.length(b)
    chars = F.struct(F.split(F.when(first, a).otherwise(b), "").alias("long"), F.split(F.when(first, b).otherwise(a), "").alias("short"))
    apart, empty = F.abs(F.length(a) - F.length(b)), F.least(F.length(a), F.length(b)) == 0
    return F.when(apart > threshold, False).when(empty, True).otherwise(let(chars, lambda p: distance(p) <= threshold))


def sketch(line: Column) -> Column:
    """64 bits: each is the parity of how many pairs of neighbouring characters hash to it.

    An edit takes at most two pairs away and brings at most two, so it turns at most four bits.
    """
    start = F.struct(F.lit("").alias("before"), F.lit(0).cast("long").alias("bits"))

    def step(state: Column, char: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(state["before"], char), F.lit(64)).cast("int"))
        return F.struct(char.alias("before"), state["bits"].bitwiseXOR(bit).alias("bits"))

    return F.aggregate(F.split(line, ""), start, step, lambda state: state["bits"])


def alike(a: Column, b: Column, threshold: int) -> Column:
    """Whether two sketches can be those of strings within the edit distance."""
    return F.bit_count(a.bitwiseXOR(b)) <= 4 * threshold


def _place(key: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(key.cast("long"), F.lit(-(2**63))), F.xxhash64(text)


def distinct_lines(df: DataFrame, key: str, text: str, threshold: int, least: int) -> DataFrame:
    """(id, k, r, at, e, p): every distinct line that is compared, known by 128 bits of its text,
    with its first place in the corpus and the hashes of its segments and probes.

    Lines of no more than threshold code points have segments without text, which say nothing; they
    have no hashes, and only equal lines repeat them. Hashes are computed where the line is read; what is shuffled is numbers, not text.
    """
    k, r = _place(F.col(key), F.col(text))
    lines = df.filter(F.length(text) >= least).select(k.alias("k"), r.alias("r"), F.posexplode(_lines(F.col(text))).alias("at", "line"))
    lines = lines.withColumn("n", F.length("line")).filter(_compared(F.col("line"), least))
    h1, h2 = hash128(F.col("line"))
    entries, probes = (F.when(F.col("n") > threshold, F.array(*own)).otherwise(F.array().cast("array<bigint>")) for own in (_entries(threshold), _probes(threshold)))
    hashed = _cuts(lines, threshold).select(h1.alias("h1"), h2.alias("h2"), F.struct("k", "r", "at").alias("first"), entries.alias("e"), probes.alias("p"))
    one = hashed.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.first("e").alias("e"), F.first("p").alias("p"))
    return one.select(F.monotonically_increasing_id().alias("id"), "first.*", "e", "p")


def members(lines: DataFrame) -> DataFrame:
    """(s, id, first, entered, hub, several): the lines that meet another one under a segment s.

    entered: the line has the segment itself, others only look for it. hub: the first line (first,
    id) that has it; several: whether it isn't the only one. Every line looks for its own segments
    too, so all lines that have a segment are here, but for a hub that is the only one.
    """
    first = F.struct("k", "r", "at").alias("first")
    own = lines.select("id", first, F.explode("e").alias("s")).groupBy("s").agg(F.min(F.struct("first", "id")).alias("hub"), (F.count(F.lit(1)) > 1).alias("several"))
    probing = lines.select("id", first, "e", F.explode(F.array_distinct("p")).alias("s"))
    probing = probing.select("s", "id", "first", F.array_contains("e", F.col("s")).alias("entered"))
    return probing.join(own, "s").filter("several OR id <> hub.id")


def first_pairs(met: DataFrame) -> DataFrame:
    """(a, b): each line with the first line that has its segment, and those that have it with the
    first that looks for it. Linear in the lines."""
    ahead = met.groupBy("s").agg(F.min(F.struct("first", "id")).alias("lead"))
    two = met.filter("entered").join(ahead, "s").filter("lead.first < first").select("id", F.col("lead.id").alias("other"))
    pairs = met.select("id", F.col("hub.id").alias("other")).union(two).filter("id <> other")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def open_members(met: DataFrame, late: DataFrame) -> DataFrame:
    """(s, id, first, entered, open): the lines of the segments in which a line that isn't late yet
    (open) has earlier ones that first_pairs() doesn't cover."""
    hubs = met.select("s", "hub.id", "hub.first", F.lit(True).alias("entered")).distinct()
    every = met.select("s", "id", "first", "entered").union(hubs).distinct()
    sizes = every.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_if("entered").alias("m"), F.min("first").alias("low"), F.min(F.when(F.col("entered"), F.col("first"))).alias("least"))
    every = every.join(sizes.filter("n > 2"), "s")
    left = F.when(F.col("entered"), F.col("low") < F.col("first")).otherwise((F.col("m") > 1) & (F.col("least") < F.col("first")))
    every = every.join(late.withColumn("gone", F.lit(True)), "id", "left").withColumn("open", left & F.col("gone").isNull())
    wanted = every.filter("open").select("s").distinct()
    return every.join(wanted, "s", "left_semi").select("s", "id", "first", "entered", "open")


def line_texts(df: DataFrame, key: str, text: str, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, first, line, bits) of the wanted lines (id), with their sketches; a document that holds some of them first is read once."""
    places = lines.select("id", "k", "r", "at").join(wanted, "id", "left_semi").groupBy("k", "r").agg(F.collect_list(F.struct("id", "at")).alias("own"))
    k, r = _place(F.col(key), F.col(text))
    texts = df.filter(F.length(text) > 0).select(k.alias("k"), r.alias("r"), F.col(text).alias("text")).join(places, ["k", "r"])
    texts = texts.select("k", "r", "own", _lines(F.col("text")).alias("split"))
    cut = F.transform("own", lambda x: F.struct(x["id"].alias("id"), x["at"].alias("at"), F.get("split", x["at"]).alias("line")))
    one = texts.select("k", "r", F.explode(cut).alias("x")).select("x.id", F.struct("k", "r", "x.at").alias("first"), "x.line").dropDuplicates(["id"])
    return one.withColumn("bits", sketch(F.col("line")))


def later_of_pairs(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(id) of each pair's later line, if within() on the whole lines confirms the pair."""
    place = lambda own, f, m: texts.select(F.col("id").alias(own), F.col("first").alias(f), F.col("bits").alias(m))
    one = pairs.join(place("a", "af", "am"), "a").join(place("b", "bf", "bm"), "b").filter(alike(F.col("am"), F.col("bm"), threshold)).select("a", "b", "af", "bf")
    # Only pairs of like sketches fetch their lines.
    line = lambda own, name: texts.select(F.col("id").alias(own), F.col("line").alias(name))
    two = settled(one, "line-alike").join(line("a", "al"), "a").join(line("b", "bl"), "b")
    near = two.filter(within(F.col("al"), F.col("bl"), threshold))
    return near.select(F.when(F.col("af") < F.col("bf"), F.col("b")).otherwise(F.col("a")).alias("id"))


def later_in_blocks(rows: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(id) of the open lines in rows (open_members()) within the threshold of an earlier one.

    A segment's open lines and all its lines are dealt to blocks of bounded size; two blocks meet in
    one row, where lines are compared until the first that fits, so that no pairs are made.
    """
    long = texts.select("id", F.length("line").alias("long"))
    rows = settled(rows.join(long, "id"), "line-members")
    sizes = rows.groupBy("s").agg(*[_blocks(F.when(F.col("open") | F.lit(every), F.col("long"))).alias(name) for name, every in (("mine", False), ("others", True))])
    rows = rows.join(sizes, "s")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.filter("open").select("s", at("mine").alias("x"), to("others").alias("y"), F.lit(True).alias("mine"), "id", "entered")
    y = rows.select("s", to("mine").alias("x"), at("others").alias("y"), F.lit(False).alias("mine"), "id", "entered")
    dealt = settled(x.union(y), "line-blocks").join(texts, "id")
    one = F.struct("first", "line", "entered", "id", "bits")
    met = dealt.groupBy("s", "x", "y").agg(F.collect_list(F.when(F.col("mine"), one)).alias("own"), F.collect_list(F.when(~F.col("mine"), one)).alias("other"))
    near = lambda u, v: (v["first"] < u["first"]) & (u["entered"] | v["entered"]) & alike(u["bits"], v["bits"], threshold) & within(u["line"], v["line"], threshold)
    late = F.filter("own", lambda u: F.exists("other", lambda v: near(u, v)))
    return met.select(F.explode(F.transform(late, lambda u: u["id"])).alias("id"))


def _blocks(long: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.count(long) / BLOCK), F.ceil(F.sum(long) / BLOCK_CHARS)).cast("int")


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """df with its text without the lines that repeat, and `n_lines`, `n_dropped` (long).

    A line goes if an earlier line of the corpus (by key, then by row hash, then by place) is
    equal, or if both have more than `threshold` code points and are within that edit distance,
    whether or not the earlier one goes too. The others stay, in order. Blank lines (white space
    only) stay, and so do lines of fewer than `least` code points. A null text stays null and counts
    no lines. Rows of equal key and text count as one: their copies lose the same lines. Null
    keys come first. Columns named n_lines or n_dropped are replaced; all others stay.
    """
    df = without(df, ["n_lines", "n_dropped"])
    lines = settled(distinct_lines(df, key, text, threshold, least), "lines")
    met = settled(members(lines), "line-met")
    wanted = met.select("id").union(met.select("hub.id")).distinct()
    texts = settled(line_texts(df, key, text, lines, wanted), "line-texts")
    late = settled(later_of_pairs(settled(first_pairs(met), "line-pairs"), texts, threshold).distinct(), "late-lines")
    more = later_in_blocks(settled(open_members(met, late), "line-open"), texts, threshold)
    late = settled(late.union(more).distinct(), "late-lines")
    # A line's only occurrence that may stay is its first.
    kept = lines.select("id", "k", "r", "at").join(late, "id", "left_anti")
    stay = kept.groupBy(F.col("k").alias("__k"), F.col("r").alias("__r")).agg(F.collect_set("at").alias("__stay"))
    lead = _place(F.col(key), F.col(text))
    rows = df.withColumns({"__k": lead[0], "__r": lead[1]}).join(stay, ["__k", "__r"], "left")
    split = _lines(F.col(text))
    short = F.filter(F.transform(split, lambda x, i: F.when(~_compared(x, least), i)), lambda i: i.isNotNull())
    places = F.array_sort(F.array_union(short, F.coalesce("__stay", F.array().cast("array<int>"))))
    rows = rows.withColumn("__split", split).withColumn("__places", places)
    rows = rows.withColumn("__cut", F.transform("__places", lambda i: F.get("__split", i)))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size("__split")).cast("long")
    gone = F.when(F.col(text).isNull(), 0).otherwise(F.size("__split") - F.size("__cut")).cast("long")
    rows = rows.withColumns({"n_lines": n, "n_dropped": gone})
    names = [F.when(F.col(text).isNull(), None).otherwise(F.array_join("__cut", "\n")).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns]
    return rows.select(*names, "n_lines", "n_dropped")
