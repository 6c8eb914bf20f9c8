"""The dates of facts: from their headers, else their page, their statement, their document.

Candidates of all lines are weighed once; the best of each kind is found for pages and documents
together, and for statements over their facts' pages. A level whose two best candidates disagree
too closely has none of that kind (a veto), and the next level is asked. What is read from the
texts of a fact (its form) is read once for each combination of texts; facts carry a number for it.
They are shuffled once by page and once by statement, and statements by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import periods
from factloom.functions.text import clean_text, first_contained, label_for_matching
from factloom.operators.scratch import written

#: Titles of statements, roles of periods and the words that tell them.
TITLES = {
    "balance_sheet": ("资产负债表",),
    "income_statement": ("利润表", "损益表", "利润及利润分配表"),
    "cash_flow": ("现金流量表",),
    "equity_statement": ("所有者权益变动表", "股东权益变动表"),
    "note": ("附注", "财务报表附注"),
}
ROLES = {
    "期初数": ("期初数", "年初数", "上年末余额", "上年末"),
    "期末数": ("期末数", "年末数", "本期期末", "期末余额"),
    "本期": ("本期", "本期金额", "本年累计", "本年数"),
    "上期": ("上期", "上期金额", "上年同期", "上年数"),
    "本年累计": ("本年累计", "本年累计数"),
    "上年累计": ("上年累计",),
}
#: Which kinds of dates a role or a statement asks for first.
AT_A_DAY, OVER_TIME = ("期初数", "期末数"), ("本期", "上期", "本年累计", "上年累计")
FLOWS = ("income_statement", "cash_flow", "equity_statement", "changes_in_equity")
KINDS = ("exact", "range", "annual")
REPEAT, MARGIN = 2, 5
#: The texts of a fact that say what it is about.
FORM = ["statement_type", "statement_name", "table_key", "header_raw", "header_path", "role_raw"]
#: Statements of one period, and the headers under which their amounts are of this period.
ANNUAL_TYPES, GENERIC_HEADERS, THIS_PERIOD = ("income_statement", "cash_flow"), ("金额", "本期金额", "本年累计数", "本年累计"), "本期"


def period_role(path: Column, raw: Column, roles: dict[str, tuple[str, ...]] = ROLES) -> Column:
    """The role that the first telling header names, else the raw one, else unknown."""
    # Headers are cleaned once, before words are looked for.
    named = F.transform(F.transform(path, clean_text), lambda h: first_contained(h, {r: (r, *w) for r, w in roles.items()}, "unknown"))
    told = F.get(F.filter(named, lambda r: r != "unknown"), F.lit(0))
    return F.coalesce(told, F.when(raw != "", raw), F.lit("unknown"))


def statement_name(kind: Column, name: Column) -> Column:
    """One name for the statements of a kind; of others the matching label itself."""
    # Bound once, as it is used in several places.
    return F.transform(F.array(label_for_matching(name)), lambda label: _statement_name(kind, label))[0]


def _statement_name(kind: Column, label: Column) -> Column:
    equity = kind.isin("equity_statement", "changes_in_equity")
    fixed = F.when((kind == "note") & F.contains(label, F.lit("附注")), "附注").when(kind == "balance_sheet", "资产负债表").when(kind == "income_statement", "利润表")
    return F.when(label == "", "").otherwise(fixed.when(kind == "cash_flow", "现金流量表").when(equity, "所有者权益变动表").otherwise(label))


def statement_group(kind: Column, name: Column, table_key: Column) -> Column:
    """The key under which tables belong to one statement: its type, and its name or else its headers."""
    kind = F.coalesce(F.when(kind != "", kind), F.lit("unknown"))
    named = F.substring(statement_name(kind, name), 1, 40)
    heads = F.substring(label_for_matching(F.element_at(F.split(F.coalesce(table_key, F.lit("")), r"\|r:", 2), 1)), 1, 80)
    second = F.when(named != "", named).otherwise(heads)
    return F.concat(label_for_matching(kind), F.when(second != "", F.concat(F.lit("|"), second)).otherwise(""))


def weighed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, counts) of lines (doc_id, page_no, source, text).

    A candidate row is (doc_id, page_no, own, kind, norm, score, m, raw, weight): m times found in
    the page with that score; `own` marks those of the document's id, which is a line of no page.
    The weight adds 2 for each time that the document has the date.
    """
    titles = tuple(w for words in TITLES.values() for w in words)
    ids = lines.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page_no"), F.lit("doc_id").alias("source"), F.col("doc_id").cast("string").alias("text"))
    every = lines.select("doc_id", F.col("page_no").cast("int").alias("page_no"), "source", "text").unionByName(ids)
    # A family of sources has one weight: what is before a colon.
    source = F.element_at(F.split("source", ":", 2), 1)
    text = F.col("clean")
    every = every.withColumn("clean", clean_text(F.col("text"))).filter(text.contains("20"))
    found = every.select("doc_id", "page_no", (F.col("source") == "doc_id").alias("own"), periods.score(source, text, titles).alias("score"), F.explode(periods.cleaned_candidates(text)).alias("c"))
    each = found.groupBy("doc_id", "page_no", "own", "c.kind", "c.norm", "score").agg(F.count(F.lit(1)).alias("m"), F.min("c.raw").alias("raw"))
    # Combined before they are dealt by document, by which the later steps group.
    each = written(each, "candidates").repartition("doc_id")
    times = F.sum("m").over(Window.partitionBy("doc_id", "norm"))
    return each.withColumn("weight", F.col("score") + REPEAT * times), each.groupBy("doc_id", "norm").agg(F.sum("m").alias("times"))


def chosen(rows: DataFrame, group: list[str], *order: str | Column) -> DataFrame:
    """(group, best): the first row of each group by weight and `order` as a struct, null where the second vetoes it.

    The second vetoes another date that is less than MARGIN ahead; a row found twice is its own
    second. No group is collected: only its two first rows leave a task.
    """
    rank = Window.partitionBy(*group).orderBy(F.desc("weight"), *order)
    two = rows.withColumn("n", F.row_number().over(rank)).filter("n <= 2")
    best = F.struct("norm", "raw", "kind", "weight", "page_no", "m")
    wide = two.groupBy(*group).agg(F.max(F.when(F.col("n") == 1, best)).alias("best"), F.max(F.when(F.col("n") == 2, best)).alias("next"))
    first, second = F.col("best"), F.col("next")
    veto = (first["m"] == 1) & (second["norm"] != first["norm"]) & (first["weight"] - second["weight"] < MARGIN)
    return wide.select(*group, F.when(~F.coalesce(veto, F.lit(False)), first).alias("best"))


def _wide(rows: DataFrame, group: list[str], prefix: str) -> DataFrame:
    """One row for each group with a column for each kind."""
    return rows.groupBy(*group).agg(*[F.max(F.when(F.col("kind") == k, F.col("best"))).alias(f"{prefix}_{k}") for k in KINDS])


def contexts(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, documents): the best candidate of each kind in each page, and in each document.

    Both come from one pass, each candidate being one of its page and one of its document.
    """
    levels = F.when(F.col("own"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    rows = candidates.withColumn("by_page", F.explode(levels)).withColumn("page", F.when(F.col("by_page"), F.col("page_no")))
    # The document's id has page 0, as may a page have: equal candidates of both are one.
    rows = rows.groupBy("doc_id", "by_page", "page", "kind", "norm", "weight", "page_no").agg(F.sum("m").alias("m"), F.min("raw").alias("raw"))
    best = chosen(rows, ["doc_id", "by_page", "page", "kind"], "page_no", "norm")
    wide = written(_wide(best, ["doc_id", "by_page", "page"], "page"), "contexts")
    return wide.filter("by_page").drop("by_page").withColumnRenamed("page", "page_no"), wide.filter("NOT by_page").select("doc_id", *[F.col(f"page_{k}").alias(f"doc_{k}") for k in KINDS])


def forms(facts: DataFrame) -> DataFrame:
    """The combinations of FORM among facts, with a number and what is read from them.

    group, period_role, header; group_no and header_no for the texts of these. header_best is the
    header's date if its document can't matter: it has one candidate. `contested` marks those with more.
    """
    text = F.concat_ws(" ", "statement_name", "header_raw", F.array_join("header_path", " "))
    made = {"group": statement_group(F.col("statement_type"), F.col("statement_name"), F.col("table_key")), "period_role": period_role(F.col("header_path"), F.col("role_raw")), "header": text}
    each = written(facts.select(*FORM).distinct().withColumn("form", F.monotonically_increasing_id()), "forms").withColumns(made)
    number = lambda name: F.min("form").over(Window.partitionBy(name))
    each = written(each.withColumns({"group_no": number("group"), "header_no": number("header")}), "forms_read")
    found = _header_dates(each.filter("form = header_no"))
    one = F.struct("norm", "raw", F.lit("header").alias("level"), F.lit("header_date_candidate").alias("reason"))
    heads = found.groupBy("header_no").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one"))
    heads = heads.select("header_no", F.when(F.col("n") == 1, F.col("one")).alias("header_best"), (F.col("n") > 1).alias("contested"))
    return written(each.join(heads, "header_no", "left").withColumn("contested", F.coalesce("contested", F.lit(False))), "forms_dated")


def _header_dates(texts: DataFrame) -> DataFrame:
    """(header_no, header, kind, norm, score, m, raw) of distinct headers."""
    titles = tuple(w for words in TITLES.values() for w in words)
    texts = texts.select("header_no", "header").filter(F.col("header").contains("20")).withColumn("clean", clean_text(F.col("header")))
    found = texts.select("header_no", periods.score(F.lit("header"), F.col("clean"), titles).alias("score"), F.explode(periods.cleaned_candidates(F.col("clean"))).alias("c"))
    return found.groupBy("header_no", "c.kind", "c.norm", "score").agg(F.count(F.lit(1)).alias("m"), F.min("c.raw").alias("raw"))


def headers(rows: DataFrame, known: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, header_no, head) of the contested headers of each document: the best of all kinds, weighed with the document's counts."""
    dates = _header_dates(known.filter("contested AND form = header_no"))
    found = rows.filter("contested").select("doc_id", "header_no").distinct().join(dates, "header_no")
    found = found.join(counts, ["doc_id", "norm"], "left").withColumn("weight", F.col("score") + REPEAT * F.coalesce("times", F.lit(0))).withColumn("page_no", F.lit(0))
    specific = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "range", 1).otherwise(2)
    best = chosen(found, ["doc_id", "header_no"], specific, F.col("norm"))
    one = F.struct(F.col("best.norm").alias("norm"), F.col("best.raw").alias("raw"), F.lit("header").alias("level"), F.lit("header_date_candidate").alias("reason"))
    return best.select("doc_id", "header_no", F.when(F.col("best").isNotNull(), one).alias("head"))


def statements(paged: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, group_no, known, stated, statement_<kind>, doc_<kind>) of facts with their pages' best.

    A statement's best is the best among those of its facts' pages, each counted by its facts; kinds without one
    are the document's. `stated`: whether a page has any. documents: doc_<kind> and `known` of those that have lines.
    """
    each = F.array_compact(F.array(*[f"page_{k}" for k in KINDS]))
    sizes = paged.groupBy("doc_id", "page_no", "group_no").agg(F.count(F.lit(1)).alias("m"), F.first(each).alias("each"))
    # Dealt once, for the windows and groups below.
    rows = sizes.repartition("doc_id", "group_no").select("doc_id", "group_no", "m", F.explode_outer("each").alias("c")).select("doc_id", "group_no", "m", "c.kind", "c.norm", "c.raw", "c.weight", "c.page_no")
    best = chosen(rows, ["doc_id", "group_no", "kind"], "page_no", "norm")
    wide = best.groupBy("doc_id", "group_no").agg(F.max(F.col("kind").isNotNull()).alias("stated"), *[F.max(F.when(F.col("kind") == k, F.col("best"))).alias(f"own_{k}") for k in KINDS])
    made = wide.join(documents, "doc_id", "left")
    return made.select("doc_id", "group_no", "known", "stated", *[F.when(F.col("stated"), F.coalesce(f"own_{k}", f"doc_{k}")).alias(f"statement_{k}") for k in KINDS], *[f"doc_{k}" for k in KINDS])


def _first(order: tuple[str, ...]) -> Column:
    """The first candidate by kind, then by level, with where it is from."""
    each = []
    for kind in order:
        for level in ("page", "statement", "doc"):
            c = F.col(f"{level}_{kind}")
            each.append(F.when(c.isNotNull(), F.struct(c["norm"].alias("norm"), c["raw"].alias("raw"), F.lit(level).alias("level"), F.lit(f"{level}_{kind}_candidate").alias("reason"))))
    return F.coalesce(*each)


def dated(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """facts with report_date, report_date_raw, period_role, period_key, and the level and reason of the date.

    facts: fact columns with doc_id, page_no, statement_type, statement_name, table_key, header_path
    (array), header_raw, role_raw. lines: (doc_id, page_no, source, text). Without a date it is unknown_date,
    for the reason that there are no lines, no dates on the page, or ambiguous ones.
    """
    known = forms(facts)
    read = known.select(*[F.col(c).alias(f"__{c}") for c in FORM], "form", "group_no", "header_no", "contested")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in FORM]
    rows = facts.join(read, same).drop(*FORM, *[f"__{c}" for c in FORM])
    candidates, counts = weighed(lines)
    pages, documents = contexts(candidates)
    documents = documents.join(lines.select("doc_id").distinct(), "doc_id", "right").withColumn("known", F.lit(True))
    pages = pages.withColumn("on_page", F.lit(True))
    paged = written(rows.join(pages, ["doc_id", "page_no"], "left"), "paged")
    stated = written(statements(paged, documents), "statements")
    settled = paged.join(stated.withColumnsRenamed({"doc_id": "__doc", "group_no": "__group"}), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("group_no") == F.col("__group")), "left").drop("__doc", "__group")
    late = settled.filter("contested").join(headers(paged, known, counts), ["doc_id", "header_no"], "left")
    settled = settled.filter("NOT contested").withColumn("head", F.lit(None).cast(late.schema["head"].dataType)).unionByName(late)
    settled = settled.join(known.drop("group_no", "header_no", "contested"), "form")
    role, kind = F.col("period_role"), F.col("statement_type")
    head = F.coalesce("header_best", "head")
    flows = role.isin(*OVER_TIME) | (kind.isin(*FLOWS) & ~role.isin(*AT_A_DAY))
    found = F.coalesce(head, F.when(role.isin(*AT_A_DAY), _first(("exact", "range", "annual"))).when(flows, _first(("range", "annual", "exact"))).otherwise(_first(("exact", "annual", "range"))))
    nothing = F.coalesce(*[F.col(f"page_{k}") for k in KINDS]).isNull()
    why = F.when(F.col("known").isNull(), "no_statement_date_found").when(F.col("on_page").isNotNull() & nothing, "ambiguous_multiple_dates").otherwise("no_page_date_found")
    rows = settled.withColumn("__found", found).withColumns(
        {
            "report_date": F.coalesce("__found.norm", F.lit("unknown_date")),
            "report_date_raw": F.coalesce("__found.raw", F.lit("")),
            "period_level": F.coalesce("__found.level", F.lit("inferred")),
            "period_reason": F.coalesce("__found.reason", why),
        }
    )
    rows = rows.withColumn("period_key", periods.period_key(F.col("report_date"), F.col("period_role")))
    return rows.select(*facts.columns, "group", "period_role", "report_date", "report_date_raw", "period_level", "period_reason", "period_key")


def blocks_export(code: Column, value: Column, date: Column, role: Column) -> Column:
    """A mapped and dated number that only lacks its period role."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return (text(code) != "") & value.isNotNull() & ~text(date).isin("", "unknown_date") & (text(role) == "unknown")


def annual_roles(facts: DataFrame, table: list[str], kinds: tuple[str, ...] = ANNUAL_TYPES, generic: tuple[str, ...] = GENERIC_HEADERS, role: str = THIS_PERIOD) -> DataFrame:
    """facts whose unknown period_role is `role` where their table states one column of numbers over one period.

    facts: column_key, header_raw, value, statement_type, report_date, period_role; `inferred` marks
    those changed, with their new period_key. Headers, if any, must contain a generic one.
    """
    key = F.coalesce(F.when(F.col("column_key") != "", F.col("column_key")), F.col("header_raw"), F.lit(""))
    number = F.col("value").isNotNull()
    head = F.trim(F.coalesce("header_raw", F.lit("")))
    own = Window.partitionBy(*table)
    low, high = F.min(F.when(number, key)).over(own), F.max(F.when(number, key)).over(own)
    heads = F.collect_set(F.when(head != "", head)).over(own)
    rows = facts.withColumns({"__single": low == high, "header_text": F.array_join(F.array_sort(heads), " ")})
    fits = F.col("header_text") == ""
    for word in generic:
        fits = fits | F.contains("header_text", F.lit(word))
    spans = F.col("report_date").endswith("年度") | F.contains("report_date", F.lit("月-"))
    yes = F.coalesce(F.col("__single") & number & F.col("statement_type").isin(*kinds) & spans & (F.col("period_role") == "unknown") & fits, F.lit(False))
    rows = rows.withColumn("inferred", yes).withColumn("period_role", F.when(F.col("inferred"), role).otherwise(F.col("period_role")))
    return rows.withColumn("period_key", periods.period_key(F.col("report_date"), F.col("period_role"))).drop("__single")
