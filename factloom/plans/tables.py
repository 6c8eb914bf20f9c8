"""Queries on grids of cells, mapping, benchmarks and review, over all rows of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import alias_join, benchmark, grid, mapping, review
from factloom.plans.facts import MAPPED, mapped, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Every customer's orders are a table: its rows are the orders by number, two rows of heads above them.
TABLE = ["table_id"]
HEADS = 2
CELLS = """lined AS (SELECT o_custkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS row, * FROM orders),
cells AS (
  SELECT DISTINCT table_id, 0 AS row_start, 0 AS row_end, 1 AS col_start, 2 AS col_end, 'orders' AS text, 0 AS ordinal FROM lined
  UNION ALL SELECT DISTINCT table_id, 1, 1, k, k, ['name', 'total', 'state'][k + 1], 1 FROM lined, (SELECT unnest([0, 1, 2]) AS k)
  UNION ALL SELECT table_id, row, row + CAST(o_orderstatus = 'P' AS INTEGER), 0, 0, o_orderpriority, 10 + o_orderkey FROM lined
  UNION ALL SELECT table_id, row, row, 1, 1, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR), 10 + o_orderkey FROM lined
  UNION ALL SELECT table_id, row, row, 2, 2, o_orderstatus, 10 + o_orderkey FROM lined WHERE o_orderstatus <> 'O')"""
GRID = f"""{CELLS},
slots AS (SELECT table_id, row, unnest(range(0, cols + 1)) AS col FROM (
  SELECT table_id, unnest(range(0, max(row_end) + 1)) AS row, max(col_end) AS cols FROM cells GROUP BY table_id)),
spans AS (SELECT *, unnest(range(row_start, row_end + 1)) AS row FROM cells),
covers AS (SELECT *, unnest(range(col_start, col_end + 1)) AS col FROM spans),
covered AS (SELECT table_id, row, col, arg_max(text, ordinal) AS text, arg_max(row_start, ordinal) AS anchor_row, arg_max(col_start, ordinal) AS anchor_col FROM covers GROUP BY ALL),
grid AS (SELECT s.table_id, s.row, s.col, coalesce(text, '') AS text, anchor_row, anchor_col FROM slots s LEFT JOIN covered c ON s.table_id = c.table_id AND s.row = c.row AND s.col = c.col),
paths AS (SELECT table_id, col, array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), ' / ') AS header_path FROM (
  SELECT table_id, col, list(text ORDER BY row) AS h FROM grid WHERE row < {HEADS} AND text <> '' GROUP BY ALL)),
columns AS (SELECT table_id, col, filled, numbers, named FROM (
  SELECT table_id, col, count(*) FILTER (WHERE row >= {HEADS} AND text <> '') AS filled, count(*) FILTER (WHERE row >= {HEADS} AND regexp_full_match(text, '-?[0-9]+')) AS numbers,
         bool_or(row < {HEADS} AND text = 'total') AS named FROM grid WHERE col > 0 GROUP BY ALL) WHERE named OR (numbers > 0 AND numbers >= 0.5 * filled))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1
    lined = table(spark, sf_dir, "orders").withColumns({"table_id": F.col("o_custkey"), "row": row})
    lit = lambda x: F.lit(x)
    cell = lambda top, bottom, left, right, text: F.struct(top.alias("row_start"), bottom.alias("row_end"), lit(left).alias("col_start"), lit(right).alias("col_end"), text.alias("text"))
    below = F.col("row") + (F.col("o_orderstatus") == "P").cast("int")
    own = F.array(
        cell(F.col("row"), below, 0, 0, F.col("o_orderpriority")),
        cell(F.col("row"), F.col("row"), 1, 1, F.round("o_totalprice").cast("long").cast("string")),
        cell(F.col("row"), F.col("row"), 2, 2, F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))),
    )
    body = lined.select("table_id", F.explode(own).alias("c"), (F.col("o_orderkey") + 10).alias("ordinal")).filter("c.text IS NOT NULL")
    heads = F.array(cell(lit(0), lit(0), 1, 2, lit("orders")), *[cell(lit(1), lit(1), k, k, lit(name)) for k, name in enumerate(("name", "total", "state"))])
    top = lined.select("table_id").distinct().select("table_id", F.explode(heads).alias("c"), F.col("c.row_start").cast("long").alias("ordinal"))
    return body.unionByName(top).select("table_id", "c.*", "ordinal")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.densify(_cells(spark, sf_dir), TABLE)


def _value_columns(slots: DataFrame) -> DataFrame:
    return grid.value_columns(slots, TABLE, F.lit(HEADS), F.col("text") == "total", F.col("text").rlike("^-?[0-9]+$"))


@query(f"WITH {GRID} SELECT table_id, row::INTEGER AS row, col::INTEGER AS col, text, anchor_row::INTEGER AS anchor_row, anchor_col FROM grid")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query(f"WITH {GRID} SELECT table_id, col::INTEGER AS col, header_path FROM paths")
def grid_header_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.header_paths(_grid(spark, sf_dir), TABLE, F.lit(HEADS))


@query(f"WITH {GRID} SELECT table_id, col::INTEGER AS col, filled, numbers, named FROM columns")
def grid_value_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value_columns(_grid(spark, sf_dir))


@query(f"""WITH {GRID}, body AS (SELECT * FROM grid WHERE row >= {HEADS})
SELECT b.table_id, b.row::INTEGER AS row, b.col::INTEGER AS col, l.text AS label, coalesce(header_path, '') AS header_path, b.text
FROM body b JOIN columns c ON b.table_id = c.table_id AND b.col = c.col JOIN body l ON l.table_id = b.table_id AND l.row = b.row AND l.col = 0
LEFT JOIN paths p ON p.table_id = b.table_id AND p.col = b.col WHERE l.text <> '' OR b.text <> ''""")
def grid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _grid(spark, sf_dir)
    return grid.facts(slots, _value_columns(slots), grid.header_paths(slots, TABLE, F.lit(HEADS)), TABLE, F.lit(HEADS))


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN left(text, 40) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations""")
def carried_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("head", F.substring("text", 1, 40))
    return grid.carried_header(rows, ["conv_id"], "turn", F.col("role") == "user", "head").select("conv_id", "turn", "role", "header")


@query(f"WITH {MAPPED} SELECT label, code, method, confidence, count(*) AS n FROM mapped GROUP BY ALL")
def mapping_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir).groupBy("label", "code", "method", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MAPPED} SELECT label, count(*) AS occurrences, count(value) AS numeric, CAST(coalesce(sum(CAST(abs(value) AS DECIMAL(18, 2))), 0) AS DOUBLE) AS amount FROM mapped WHERE code IS NULL GROUP BY label")
def unmapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.unmapped_summary(mapped(spark, sf_dir))


@query(None)
def fuzzy_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the chart of their first words; the similarity of sequences is beyond SQL, so tests compare it."""
    parts = table(spark, sf_dir, "part")
    subjects = parts.select(F.col("p_brand").alias("name"), F.regexp_replace("p_brand", "[^0-9]", "").alias("code")).distinct()
    return mapping.fuzzy_candidates(parts.select(F.lower(F.col("p_brand")).alias("label")).union(parts.select("p_name")), subjects)


# Two providers' sums by part and year as a benchmark and what was made of it.
SIDES = """sums AS (SELECT l_partkey AS row, CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey % 2 AS side, round(CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE), 2) AS value FROM lineitem GROUP BY ALL),
cells AS (SELECT coalesce(b.row, a.row) AS row, coalesce(b.year, a.year) AS year, b.value AS benchmark_value, a.value AS auto_value,
  CASE WHEN b.value IS NULL AND a.value IS NULL THEN 'match' WHEN a.value IS NULL THEN 'missing_in_auto' WHEN b.value IS NULL THEN 'extra_in_auto'
       WHEN abs(b.value - a.value) <= 0.01 THEN 'match' ELSE 'value_diff' END AS status
  FROM (SELECT * FROM sums WHERE side = 0) b FULL JOIN (SELECT * FROM sums WHERE side = 1) a ON a.row = b.row AND a.year = b.year)"""
RATIO = "CASE WHEN {1} > 0 THEN round({0} / {1}::DOUBLE, 6) ELSE 0.0 END"
METRICS = f"""metrics AS (SELECT *, {RATIO.format('matches', 'auto_filled')} AS precision, {RATIO.format('matches', 'benchmark_filled')} AS recall,
  {RATIO.format('matches', 'cells')} AS exact_match, {RATIO.format('missing', 'benchmark_filled')} AS missing_ratio FROM (
  SELECT year, count(*) AS cells, count(*) FILTER (WHERE status = 'match') AS matches, count(benchmark_value) AS benchmark_filled, count(auto_value) AS auto_filled,
         count(*) FILTER (WHERE status = 'missing_in_auto') AS missing, count(*) FILTER (WHERE status = 'extra_in_auto') AS extra FROM cells GROUP BY year))"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.year("l_shipdate").alias("year"), (F.col("l_suppkey") % 2).alias("side")).agg(F.round(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"), 2).alias("value"))
    return benchmark.compare(sums.filter("side = 0").drop("side"), sums.filter("side = 1").drop("side"), ["row", "year"])


@query(f"WITH {SIDES} SELECT * FROM cells")
def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


@query(f"WITH {SIDES}, {METRICS} SELECT * FROM metrics")
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.metrics(_compared(spark, sf_dir), ["year"])


@query(f"""WITH {SIDES}, {METRICS}
SELECT year, b.missing_ratio AS before, a.missing_ratio AS after, round(coalesce(a.missing_ratio, 0) - coalesce(b.missing_ratio, 0), 6) AS delta,
       CASE WHEN b.year IS NULL THEN 'new' WHEN a.year IS NULL THEN 'resolved' ELSE 'unchanged' END AS change
FROM (SELECT * FROM metrics WHERE year < 1998) b FULL JOIN (SELECT year + 1 AS year, missing_ratio FROM metrics) a USING (year)""")
def benchmark_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmark.metrics(_compared(spark, sf_dir), ["year"])
    return benchmark.delta(rows.filter("year < 1998"), rows.withColumn("year", F.col("year") + 1), "year", "missing_ratio")


@query("""WITH headers AS (SELECT DISTINCT o_orderpriority AS header, CASE o_orderpriority WHEN '1-URGENT' THEN 'O' WHEN '2-HIGH' THEN 'F' WHEN '3-MEDIUM' THEN 'P' ELSE 'none' END AS role FROM orders),
periods AS (SELECT CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) || '__' || o_orderstatus AS period_key, o_orderstatus AS role, true AS day FROM orders GROUP BY o_orderstatus
  UNION ALL SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) || '年度__F', 'F', false FROM orders UNION ALL SELECT '1990年度__P', 'P', false UNION ALL SELECT '1990-01-01__P', 'P', true),
found AS (SELECT header, h.role, count(period_key) AS n, count(*) FILTER (WHERE day) AS days, min(period_key) AS single, min(period_key) FILTER (WHERE day) AS single_day FROM headers h LEFT JOIN periods p ON h.role = p.role GROUP BY ALL)
SELECT header, role, CASE WHEN n = 1 THEN single WHEN days = 1 THEN single_day END AS period_key, CASE WHEN n = 0 THEN 'unaligned' WHEN n = 1 OR days = 1 THEN 'aligned' ELSE 'ambiguous' END AS state FROM found""")
def header_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    role = F.when(F.col("header") == "1-URGENT", "O").when(F.col("header") == "2-HIGH", "F").when(F.col("header") == "3-MEDIUM", "P").otherwise("none")
    headers = orders.select(F.col("o_orderpriority").alias("header")).distinct().withColumn("role", role)
    days = orders.groupBy("o_orderstatus").agg(F.max("o_orderdate").cast("date").cast("string").alias("d")).select(F.concat("d", F.lit("__"), "o_orderstatus").alias("period_key"))
    years = orders.select(F.concat(F.year("o_orderdate").cast("string"), F.lit("年度__F")).alias("period_key")).distinct()
    fixed = spark.sql("SELECT explode(array('1990年度__P', '1990-01-01__P')) AS period_key")
    return benchmark.align_headers(headers, days.union(years).union(fixed))


GAPS = """gaps AS (SELECT o_orderkey AS gap, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F'),
sources AS (SELECT l_orderkey AS fact_id, l_linenumber AS line, CAST(year(l_shipdate) AS INTEGER) AS year, l_extendedprice AS value FROM lineitem),
close AS (SELECT gap, g.year, amount, fact_id, line, value FROM gaps g JOIN sources s ON s.year = g.year AND s.value BETWEEN g.amount - 2 AND g.amount + 2
  WHERE abs(CAST(amount AS DECIMAL(18, 4)) - CAST(value AS DECIMAL(18, 4))) <= 1)"""


def _gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gaps = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("gap"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("amount"))
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("line"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("value"))
    return gaps, sources


@query(f"WITH {GAPS} SELECT * FROM close")
def near_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.near_amounts(*_gaps(spark, sf_dir), ["year"], tolerance=1.0).select("gap", "year", "amount", "fact_id", "line", "value")


@query(f"""WITH {GAPS.replace('<= 1)', '<= 0.01)').replace('- 2 AND g.amount + 2', '- 1 AND g.amount + 1')}
SELECT gap, year, amount AS value, CASE WHEN gap IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) THEN 'mapped_fact_exists'
  WHEN gap IN (SELECT gap FROM close) THEN 'alias_candidate_by_amount' WHEN gap IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN 'formula_candidate' ELSE 'no_source' END AS cause FROM gaps""")
def gap_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps, sources = _gaps(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").withColumn("gap", F.col("l_orderkey"))
    missing = gaps.withColumnRenamed("amount", "value")
    key = ["gap", "year"]
    with_year = lambda df: df.join(gaps.select(*key), "gap")
    return benchmark.gap_causes(missing, with_year(lines.filter("l_returnflag = 'R' AND l_linenumber = 1")), with_year(lines.filter("l_returnflag = 'A'")), key, ["year"], sources)


WEIGHTS = {"error": 3.0, "click": 0.5, "error:high": 4.0}
REASON = "CASE WHEN event_type = 'error' AND value > 150 THEN 'error:high' WHEN event_type = 'error' THEN 'error:low' ELSE event_type END"
TASKS = f"""tasks AS (SELECT event_id AS task, user_id AS page, CAST(value AS INTEGER) % 3 AS cluster, value AS priority,
  CASE event_type WHEN 'click' THEN 'cell' WHEN 'view' THEN 'row' WHEN 'error' THEN 'table' ELSE 'page' END AS grain FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("reason", F.expr(REASON))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    grain = "CASE event_type WHEN 'click' THEN 'cell' WHEN 'view' THEN 'row' WHEN 'error' THEN 'table' ELSE 'page' END"
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("task"), F.col("user_id").alias("page"), (F.round("value").cast("int") % 3).alias("cluster"), F.col("value").alias("priority"), F.expr(grain).alias("grain"))


TASKS = TASKS.replace("CAST(value AS INTEGER) % 3", "CAST(round(value) AS INTEGER) % 3")


@query(f"""WITH r AS (SELECT DISTINCT user_id, {REASON} AS reason FROM events),
w AS (SELECT *, CASE reason WHEN 'error:high' THEN 4.0 WHEN 'click' THEN 0.5 ELSE CASE WHEN split_part(reason, ':', 1) = 'error' THEN 3.0 ELSE 1.0 END END AS weight FROM r),
g AS (SELECT user_id, string_agg(reason, '|' ORDER BY reason) AS reasons, CAST(sum(weight) AS DOUBLE) AS priority, count(*) AS n_reasons FROM w GROUP BY user_id)
SELECT *, CASE WHEN priority >= 5 THEN 'high' WHEN priority >= 3 THEN 'medium' ELSE 'low' END AS bucket FROM g""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.reason_set(_events(spark, sf_dir), ["user_id"], "reason", WEIGHTS)
    return rows.withColumn("bucket", review.bucket(F.col("priority")))


@query(f"""WITH {TASKS} SELECT page, cluster, task, grain, priority, n AS merged_task_count FROM (
  SELECT *, count(*) OVER (PARTITION BY page, cluster) AS n,
         row_number() OVER (PARTITION BY page, cluster ORDER BY list_position(['cell', 'row', 'table', 'page'], grain), priority DESC, task) AS k FROM tasks) WHERE k = 1""")
def review_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.finest_tasks(_tasks(spark, sf_dir), ["page", "cluster"], "grain", "priority", "task")


@query(f"WITH {TASKS} SELECT task, page, cluster, grain FROM tasks t WHERE grain <> 'page' OR NOT EXISTS (SELECT 1 FROM tasks f WHERE f.page = t.page AND f.cluster = t.cluster AND f.grain <> 'page')")
def review_without_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.without_redundant_pages(_tasks(spark, sf_dir), ["page", "cluster"], "grain").select("task", "page", "cluster", "grain")


@query("""WITH p AS (SELECT user_id AS page, bool_or(event_type = 'error' AND value > 200) AS suspicious, bool_or(event_type = 'error' AND value > 150) AS failed,
  count(*) FILTER (WHERE event_type = 'view')::DOUBLE / count(*) AS review_share, count(*) FILTER (WHERE event_type = 'signup')::DOUBLE / count(*) AS unknown_date_share,
  count(*) FILTER (WHERE event_type = 'click') = 0 AS unknown_type, count(*) < 5 AS no_pairs, count(*) FILTER (WHERE event_type = 'purchase') = 0 AS no_mapped,
  bool_and(value < 100) AS fallback, count(DISTINCT event_type) - 3 AS n_providers FROM events GROUP BY user_id),
s AS (SELECT page, n_providers, CAST(CAST(0.25 * CAST(suspicious AS INTEGER) + 0.3 * CAST(failed AS INTEGER) + 0.2 * CAST(review_share >= 0.15 AS INTEGER) + 0.2 * CAST(unknown_date_share >= 0.2 AS INTEGER)
  + 0.15 * CAST(unknown_type AS INTEGER) + 0.25 * CAST(no_pairs AS INTEGER) + 0.2 * CAST(no_mapped AS INTEGER) + 0.2 * CAST(fallback AS INTEGER) AS DECIMAL(6, 2)) AS DOUBLE) AS score FROM p)
SELECT page, score, score >= 0.35 AND n_providers < 2 AS recommended FROM s""")
def second_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.col("event_type") == k
    n = F.count(F.lit(1))
    pages = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page")).agg(
        F.bool_or(kind("error") & (F.col("value") > 200)).alias("suspicious"), F.bool_or(kind("error") & (F.col("value") > 150)).alias("failed"),
        (F.count_if(kind("view")) / n).alias("review_share"), (F.count_if(kind("signup")) / n).alias("unknown_date_share"), (F.count_if(kind("click")) == 0).alias("unknown_type"),
        (n < 5).alias("no_pairs"), (F.count_if(kind("purchase")) == 0).alias("no_mapped"), F.bool_and(F.col("value") < 100).alias("fallback"), (F.size(F.collect_set("event_type")) - 3).alias("n_providers"),
    )
    return review.secondary_score(pages).select("page", "score", "recommended")


@query("SELECT * FROM (SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, day LIMIT 20) WHERE day <> ''")
def top_unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.top_labels(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("day")), "day")


@query("""SELECT user_id, CASE WHEN b.user_id IS NULL THEN 'new' WHEN a.user_id IS NULL THEN 'resolved' ELSE 'unchanged' END AS change
FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') b FULL JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') a USING (user_id)""")
def review_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    of = lambda k: rows.filter(F.col("event_type") == k).select("user_id").distinct()
    return review.changes(of("error"), of("purchase"), "user_id")


@query("""SELECT facet, value, count(*) AS n FROM (SELECT 'event_type' AS facet, event_type AS value FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events) WHERE value <> '' GROUP BY ALL""")
def review_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.facets(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("SELECT user_id, event_type, arg_max(value, struct_pack(ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY ALL")
def latest_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return review.latest(rows, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "value", "ts")


OVERRIDES = "(VALUES ('doc_id', '5', '2005'), ('doc_id', '7', '2007'), ('label', 'PROMO', '2100'), ('label', 'SMALL', '2101'), ('doc_id', '9', '2009')) AS overrides(kind, key, target)"


@query(f"""WITH {MAPPED} SELECT doc_id, label, coalesce(d.target, l.target, code) AS code, CASE WHEN d.target IS NOT NULL THEN 'override_doc_id' WHEN l.target IS NOT NULL THEN 'override_label' ELSE 'none' END AS override, count(*) AS n
FROM mapped LEFT JOIN (SELECT * FROM {OVERRIDES} WHERE kind = 'doc_id') d ON CAST(doc_id AS VARCHAR) = d.key LEFT JOIN (SELECT * FROM {OVERRIDES} WHERE kind = 'label') l ON label = l.key GROUP BY ALL""")
def mapping_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = spark.sql(f"SELECT kind, key, target AS to FROM {OVERRIDES}")
    rows = review.with_overrides(mapped(spark, sf_dir), overrides, ["doc_id", "label"], "code")
    return rows.groupBy("doc_id", "label", "code", "override").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GRID}, rows AS (SELECT table_id, row, list(text ORDER BY col) AS texts FROM grid GROUP BY ALL),
data AS (SELECT table_id, row, texts[1] <> '' AND len(list_filter(texts[1:3], lambda x: regexp_full_match(x, '-?[0-9]+'))) > 0 AND len(list_filter(texts[2:], lambda x: regexp_full_match(x, '-?[0-9]+'))) > 0 AS is_data FROM rows WHERE row < 3)
SELECT table_id, CAST(coalesce(greatest(min(row) FILTER (WHERE is_data), CASE WHEN bool_or(is_data) THEN 1 END), count(*)) AS INTEGER) AS header_rows FROM data GROUP BY table_id""")
def grid_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.header_rows(grid.rows_of(_grid(spark, sf_dir), TABLE), TABLE)


@query(f"""WITH {GRID}, c AS (SELECT table_id, col, count(*) FILTER (WHERE row >= {HEADS} AND regexp_full_match(text, '-?[0-9]+')) / nullif(count(*) FILTER (WHERE row >= {HEADS} AND text <> ''), 0)::DOUBLE AS share FROM grid GROUP BY ALL)
SELECT table_id, CAST(arg_min(col, struct_pack(a := -share, b := col)) AS INTEGER) AS col FROM c WHERE share >= 0.6 GROUP BY table_id""")
def grid_line_number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.line_number_column(_grid(spark, sf_dir), TABLE, F.lit(HEADS))


# Orders of a customer as a page of nested JSON, in the two formats.
@query("""WITH c AS (SELECT o_custkey AS page, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal, o_orderstatus, o_orderpriority, o_totalprice FROM orders)
SELECT page, CAST(ordinal AS INTEGER) AS ordinal, '1' AS table_id, CAST(o_orderkey % 9 AS INTEGER) AS row_start, CAST(o_orderkey % 9 + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS INTEGER) AS row_end, 0 AS col_start, 0 AS col_end, o_orderpriority AS text,
       CASE WHEN o_orderstatus <> 'O' THEN (0.5 + 0.25) / 2 END AS confidence FROM c""")
def provider_cells_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.sources import pages

    end = F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 9 + 1)
    cell = F.struct("o_orderkey", F.struct(F.col("o_orderkey").alias("tableCellId"), F.col("o_orderpriority").alias("word"), (F.col("o_orderkey") % 9).alias("ysc"), end.alias("yec")).alias("c"))
    words = F.when(F.col("o_orderstatus") != "O", F.array(*[F.struct(F.col("o_orderkey").alias("tableCellId"), F.lit(p).alias("prob")) for p in (0.5, 0.25)])).otherwise(F.array().cast("array<struct<tableCellId: bigint, prob: double>>"))
    made = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.flatten(F.collect_list(words)).alias("prism_wordsInfo"))
    data = F.struct("prism_wordsInfo", F.array(F.struct(F.transform("cells", lambda x: x["c"]).alias("cellInfos"))).alias("prism_tablesInfo"))
    # Half of the pages hold their data as an object, the others as JSON in a string.
    text = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(data.alias("Data")))).otherwise(F.to_json(F.struct(F.to_json(data).alias("data"))))
    return pages.cells_a(pages.format_a(made.select("page", text.alias("json"))), ["page"])


@query("""WITH c AS (SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey % 7 - 1 AS r, o_orderkey % 3 AS k, o_orderpriority AS text FROM orders)
SELECT page, CAST(ordinal AS INTEGER) AS ordinal, '1' AS table_id, CAST(CASE WHEN r > 0 THEN r - 1 ELSE r END AS INTEGER) AS row_start, CAST(greatest(CASE WHEN r > 0 THEN r - 1 ELSE r END, r + 1) AS INTEGER) AS row_end,
       CAST(CASE WHEN k > 0 THEN k - 1 ELSE k END AS INTEGER) AS col_start, CAST(CASE WHEN k > 0 THEN k - 1 ELSE k END AS INTEGER) AS col_end, text, NULL::DOUBLE AS confidence FROM c WHERE r >= 0""")
def provider_cells_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.sources import pages

    row, col = F.col("o_orderkey") % 7 - 1, F.col("o_orderkey") % 3
    cell = F.struct("o_orderkey", F.struct(row.alias("RowTl"), (row + 1).alias("RowBr"), col.alias("ColTl"), F.lit(-1).alias("ColBr"), F.col("o_orderpriority").alias("Text")).alias("c"))
    made = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    text = F.to_json(F.struct(F.array(F.struct(F.transform("cells", lambda x: x["c"]).alias("Cells"))).alias("TableDetections")))
    return pages.cells_b(made.select("page", text.alias("json")), ["page"])[0]


LABEL = "concat(CASE WHEN l_tax > 0.04 THEN '其中：' ELSE '' END, CASE WHEN l_quantity < 10 THEN concat('old ', p_name) WHEN l_quantity < 20 THEN p_type WHEN l_quantity < 30 THEN concat(p_name, ' (', p_brand, ')') ELSE p_name END)"



@query(None)
def alias_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of line items mapped to a chart of part names; the similarity of sequences is beyond SQL, so tests compare it with full comparisons."""
    parts = table(spark, sf_dir, "part")
    facts = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    facts = facts.select(F.expr(LABEL).alias("label"), F.col("l_returnflag").alias("statement_type"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("method"), F.col("l_extendedprice").alias("value"))
    subjects = parts.filter("p_partkey % 3 <> 0").groupBy(F.col("p_name").alias("name")).agg(F.concat(F.lit("C"), F.min("p_partkey").cast("string")).alias("code"), F.min("p_partkey").cast("int").alias("position"))
    types = parts.groupBy("p_type").agg(F.min_by("p_name", "p_partkey").alias("name")).join(subjects, "name")
    allowed = F.when(F.col("p_type").isin("LARGE", "SMALL"), F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    aliases = types.select(F.col("p_type").alias("alias"), "code", F.when(F.col("p_type") == "ECONOMY", "legacy_alias").otherwise("exact_alias").alias("kind"), allowed.alias("statements"))
    relations = subjects.limit(0).select("code", "name", F.lit("").alias("kind"), F.array().cast("array<string>").alias("related"), F.lit(True).alias("review"))
    done, candidates = alias_join.mapped(facts, subjects, aliases, relations)
    return alias_join.open_labels(done, candidates)
