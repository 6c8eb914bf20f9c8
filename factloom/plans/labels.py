"""Queries on labels, numbers, dates and references as documents print them, over all rows of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import numbers, periods, refs, text
from factloom.plans.facts import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SPACES = r"[ \t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace(translate(coalesce({x}, ''), '{text.WIDE}', '{text.NARROW}'), chr(8203), ''), '{SPACES}', ' ', 'g'))"


def matching(x: str) -> str:
    return f"replace(regexp_replace({clean(x)}, ':+$', ''), ' ', '')"


# Labels of parts as they are printed, by the part's size.
PRINTED = """CASE WHEN p_size < 8 THEN concat('1. ', p_name, '：') WHEN p_size < 16 THEN concat('（2）', p_name) WHEN p_size < 24 THEN concat('其中： ', p_name, ' (', p_brand, ')')
  WHEN p_size < 32 THEN concat('注', p_name, '　') WHEN p_size < 40 THEN concat('三、减: ', p_name, '（合计）') WHEN p_size < 45 THEN concat('3', p_name) ELSE concat('1,2', substr(p_brand, 7)) END"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(PRINTED).alias("label"))


@query(rf"""WITH l AS (SELECT p_partkey, {PRINTED} AS label FROM part), m AS (SELECT *, {clean('label')} AS clean, {matching('label')} AS matching FROM l)
SELECT p_partkey, clean, matching, regexp_replace(regexp_replace(regexp_replace(matching, '^(([一二三四五六七八九十]+[、,，.])|([(（]?[0-9]+[)）.]?))', ''), '^(其中|减|加|注)', ''), '[（(][^()（）]{{1,20}}[)）]$', '') AS subject,
       CASE WHEN regexp_full_match(replace(matching, ',', ''), '-?[0-9]+([.][0-9]+)?') THEN '' ELSE substr(matching, 1, 24) END AS token,
       regexp_replace(label, '[^\pL\pN]', '', 'g')[1:24] AS alnum FROM m""")
def label_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("label")
    return _labels(spark, sf_dir).select("p_partkey", text.clean_text(x).alias("clean"), text.label_for_matching(x).alias("matching"), text.subject_label(x).alias("subject"), text.semantic_token(x).alias("token"), refs.letters_and_digits(x).alias("alnum"))


@query(rf"""WITH l AS (SELECT p_partkey, {PRINTED} AS label, p_brand FROM part)
SELECT p_partkey, 'F' || substr(sha1(concat_ws('||', p_partkey::VARCHAR, regexp_replace(label, '^{SPACES}|{SPACES}$', '', 'g'), p_brand)), 1, 12) AS fact_id,
       concat(p_partkey, ':3:p1::', p_partkey, '-', p_partkey + 1, ':0-2') AS ref, 'p1' AS provider, CASE WHEN contains(label, '合计') THEN 'total' WHEN contains(label, '其中') THEN 'detail' ELSE 'other' END AS kind,
       trim(p_brand) IN ('1', 'true') AS flag FROM l""")
def fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(PRINTED).alias("label"), "p_brand")
    key = F.col("p_partkey")
    ref = refs.cell_ref(key, F.lit(3), F.lit("p1"), F.lit(None), key, key + 1, F.lit(0), F.lit(2))
    kinds = {"total": ("合计",), "detail": ("其中",)}
    return rows.select("p_partkey", text.stable_id("F", key, F.col("label"), F.col("p_brand")).alias("fact_id"), ref.alias("ref"), text.part(ref, 3).alias("provider"), text.first_contained(F.col("label"), kinds, "other").alias("kind"), text.truthy(F.col("p_brand")).alias("flag"))


# Amounts of line items as they are printed, by the number of the line.
AMOUNT = "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)"
CELL = f"""CASE l_linenumber WHEN 1 THEN concat('(', {AMOUNT}, ')') WHEN 2 THEN concat({AMOUNT}, '%') WHEN 3 THEN concat('I', substr({AMOUNT}, 2), ' O') WHEN 4 THEN concat(substr({AMOUNT}, 1, 2), '，', substr({AMOUNT}, 3))
  WHEN 5 THEN concat(' -', {AMOUNT}, '。5 ') WHEN 6 THEN CASE WHEN l_returnflag = 'A' THEN '章' WHEN l_returnflag = 'N' THEN concat('（-', {AMOUNT}, '）') ELSE '' END ELSE concat({AMOUNT}, CASE WHEN l_returnflag = 'A' THEN '元' ELSE 'x' END) END"""
NUMBER = "-?[0-9]+([.][0-9]+)?"


def token(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace({x}, '^[(](.*)[)]$', '\1'), '%$', ''), '[, ]', '', 'g')"
    return f"CASE WHEN regexp_full_match({x}, '[(].*[)]') AND {bare} <> '' AND {bare} NOT LIKE '-%' THEN '-' || {bare} ELSE {bare} END"


def parsed(x: str) -> str:
    return f"CASE WHEN regexp_full_match({token(x)}, '{NUMBER}') THEN CAST({token(x)} AS DOUBLE) / CASE WHEN {x} LIKE '%\\%' ESCAPE '\\' THEN 100 ELSE 1 END END"


@query(rf"""WITH t AS (SELECT l_orderkey, l_linenumber, {CELL} AS cell FROM lineitem), c AS (SELECT *, {clean('cell')} AS clean FROM t),
m AS (SELECT *, {clean("translate(clean, '，．。！IlO', ',..1110')")} AS mended FROM c), p AS (SELECT *, {parsed('clean')} AS plain, {parsed('mended')} AS other, {token('clean')} AS token FROM m),
s AS (SELECT *, coalesce(plain, other) AS value, CASE WHEN clean = '' AND other IS NULL THEN 'blank' WHEN plain IS NOT NULL THEN 'parsed' WHEN other IS NOT NULL THEN 'repaired' ELSE 'unresolved' END AS status FROM p)
SELECT l_orderkey, l_linenumber, cell, value, status, CASE status WHEN 'repaired' THEN 'repaired_numeric' WHEN 'unresolved' THEN 'numeric_parse_failed' ELSE '' END AS flag,
       CASE WHEN clean = '' THEN '' ELSE concat_ws('|', CASE WHEN clean IN ('章', '米') THEN 'seal_or_stamp_noise' END, CASE WHEN regexp_full_match(clean, '[A-Za-z]') THEN 'single_letter_noise' END,
         CASE WHEN regexp_matches(clean, '[\x{{4e00}}-\x{{9fff}}]') AND regexp_matches(clean, '[0-9]') THEN 'contains_chinese_noise' END,
         CASE WHEN regexp_matches(clean, '[A-Za-z]') AND regexp_matches(clean, '[0-9]') THEN 'contains_alpha_noise' END, CASE WHEN value IS NULL THEN 'expected_numeric_but_unparseable' END) END AS reason,
       CASE WHEN clean = '' THEN 'blank' WHEN value IS NULL THEN 'text' WHEN contains(clean, '%') THEN 'ratio' ELSE 'amount' END AS value_type,
       regexp_full_match(token, '{NUMBER}') AS looks_numeric, regexp_full_match(replace(clean, ',', ''), '-?[0-9]+') AS looks_integer FROM s""".replace("STRING)", "VARCHAR)"))
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CELL).alias("cell"))
    rows = rows.withColumn("a", numbers.analyze(F.col("cell"), F.lit(True)))
    return rows.select("l_orderkey", "l_linenumber", "cell", "a.value", "a.status", "a.flag", "a.reason", numbers.value_type(F.col("cell"), F.col("a.value")).alias("value_type"), numbers.looks_numeric(F.col("cell")).alias("looks_numeric"), numbers.looks_integer(F.col("cell")).alias("looks_integer"))


# Dates of orders as pages print them, by the order's priority, ten years on.
Y, M, D = "CAST(year(o_orderdate) + 10 AS STRING)", "CAST(month(o_orderdate) AS STRING)", "CAST(day(o_orderdate) AS STRING)"
PAGE = f"""CASE o_orderpriority WHEN '1-URGENT' THEN concat('截至', {Y}, '年', {M}, '月 ', {D}, '日 资产负债表') WHEN '2-HIGH' THEN concat({Y}, '年', {M}, '月~12月 ', {Y}, '年度')
  WHEN '3-MEDIUM' THEN concat({Y}, '年度 利润表') WHEN '4-NOT SPECIFIED' THEN concat('报告日期 ', {Y}, '-', {M}, '/', {D}, ' 2001年度') ELSE concat('审计报告 19', {M}) END"""
SEEN = rf"""pages AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'header' WHEN 'P' THEN 'page_text' ELSE 'other' END AS source, {PAGE} AS page FROM orders),
found AS (SELECT *, list_filter([
    CASE WHEN regexp_matches(page, '20[0-9]{{2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}') THEN printf('%s-%02d-%02d', regexp_extract(page, '(20[0-9]{{2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})', 1), CAST(regexp_extract(page, '(20[0-9]{{2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})', 2) AS INTEGER), CAST(regexp_extract(page, '(20[0-9]{{2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})', 3) AS INTEGER)) END,
    CASE WHEN regexp_matches(page, '20[0-9]{{2}}年\s*[0-9]{{1,2}}月\s*[0-9]{{1,2}}日') THEN printf('%s-%02d-%02d', regexp_extract(page, '(20[0-9]{{2}})年\s*([0-9]{{1,2}})月\s*([0-9]{{1,2}})日', 1), CAST(regexp_extract(page, '(20[0-9]{{2}})年\s*([0-9]{{1,2}})月\s*([0-9]{{1,2}})日', 2) AS INTEGER), CAST(regexp_extract(page, '(20[0-9]{{2}})年\s*([0-9]{{1,2}})月\s*([0-9]{{1,2}})日', 3) AS INTEGER)) END,
    CASE WHEN regexp_matches(page, '20[0-9]{{2}}年\s*[0-9]{{1,2}}月~12月') THEN printf('%s年%d月-12月', regexp_extract(page, '(20[0-9]{{2}})年', 1), CAST(regexp_extract(page, '年([0-9]{{1,2}})月~', 1) AS INTEGER)) END], lambda x: x IS NOT NULL) AS days,
    nullif(regexp_extract(page, '(20[0-9]{{2}})年度', 1), '') AS annual FROM pages),
dates AS (SELECT o_orderkey, o_custkey, source, page, unnest(list_concat(days, list_filter(days, lambda x: contains(x, '月-')), CASE WHEN annual IS NOT NULL THEN [annual || '年度'] ELSE [] END)) AS norm FROM found),
scored AS (SELECT *, CASE source WHEN 'header' THEN 120 WHEN 'page_text' THEN 70 ELSE 20 END + CASE WHEN contains(page, '资产负债表') OR contains(page, '利润表') THEN 18 ELSE 0 END
  + CASE WHEN contains(page, '截至') THEN 10 ELSE 0 END - CASE WHEN contains(page, '报告日期') THEN 40 ELSE 0 END AS score FROM dates)"""


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("o_orderstatus") == "F", "header").when(F.col("o_orderstatus") == "P", "page_text").otherwise("other")
    pages = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", source.alias("source"), F.expr(PAGE).alias("page"))
    found = pages.withColumn("c", F.explode(periods.candidates(F.col("page")))).select("*", "c.norm")
    return found.withColumn("score", periods.score(F.col("source"), F.col("page"))).select("o_orderkey", "o_custkey", "norm", "score")


@query(f"WITH {SEEN} SELECT o_orderkey, o_custkey, norm, score::INTEGER AS score FROM scored".replace("STRING)", "VARCHAR)"))
def period_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir)


@query(f"""WITH {SEEN}, w AS (SELECT *, score + 2 * count(*) OVER (PARTITION BY o_custkey, norm) AS worth FROM scored),
r AS (SELECT *, row_number() OVER o AS n, lead(norm) OVER o AS next, worth - lead(worth) OVER o AS gap FROM w WINDOW o AS (PARTITION BY o_custkey ORDER BY worth DESC, norm))
SELECT o_custkey, CASE WHEN next <> norm AND gap < 5 THEN NULL ELSE norm END AS norm, worth FROM r WHERE n = 1""".replace("STRING)", "VARCHAR)"))
def period_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.best_candidates(_dates(spark, sf_dir), ["o_custkey"])


@query("""WITH k AS (SELECT o_orderkey, concat(CASE WHEN o_orderstatus = 'O' THEN 'unknown_date' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '__', CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END) AS period_key FROM orders)
SELECT o_orderkey, period_key, split_part(period_key, '__', 1) AS date, split_part(period_key, '__', 2) AS role, CASE WHEN regexp_matches(period_key, '^[0-9]{4}-') THEN 3 ELSE 0 END AS specificity FROM k""")
def period_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", periods.period_key(date, F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("period_key"))
    day, role = periods.split_period(F.col("period_key"))
    return rows.select("o_orderkey", "period_key", day.alias("date"), role.alias("role"), numbers.specificity(day).alias("specificity"))


BOX = "concat('[', CAST(value AS STRING), ', ', CAST(user_id AS STRING), '.5, ', CAST(event_id AS STRING), CASE WHEN event_type = 'view' THEN ']' ELSE ', 7]' END)"
LIST = "CASE event_type WHEN 'view' THEN concat('[\"b\", \"a\", \"', event_type, '\"]') WHEN 'click' THEN concat('b, a|', event_type, ',a') WHEN 'error' THEN '[b, a' ELSE '' END"


@query(rf"""WITH t AS (SELECT event_id, {LIST} AS listed, event_type, value, user_id FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN 'a|b|view' WHEN 'click' THEN 'a|b|click' WHEN 'error' THEN 'a|b' ELSE '' END AS codes,
       CASE WHEN event_type = 'view' THEN '' ELSE concat_ws(',', CAST(round_even(value, 0) AS BIGINT), CAST(round_even(user_id + 0.5, 0) AS BIGINT), event_id, 7) END AS box FROM t""")
def code_lists_and_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", refs.codes(F.expr(LIST)).alias("codes"), refs.box(F.expr(BOX)).alias("box"))


@query("SELECT event_id, greatest(0.0, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6, 0.0) AS seconds FROM events")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("event_id", refs.seconds(before, F.col("ts")).alias("seconds"))


@query(r"SELECT page_id, len(list_filter(regexp_split_to_array(coalesce(html, ''), '\r\n|\r|\n'), lambda x: " + clean("x") + r" <> '')) AS n_lines, sha256(array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '\r\n|\r|\n'), lambda x: " + clean("x") + r"), lambda x: x <> ''), chr(10))) AS lines_sha256 FROM pages")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("lines", refs.text_lines(F.col("html")))
    return rows.select("page_id", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"))
