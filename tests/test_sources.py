"""Readers, the shape of grids, and streams, on inputs made by hand."""

import json

from pyspark.sql import functions as F

from factloom.operators import grid
from factloom.sources import pages
from factloom.streaming import merging


def test_files_and_their_fallbacks(spark, tmp_path):
    for name in ("D1/raw/page_0001.json", "D1/raw/page_0002_b.json", "D1/raw/page_0002_fam_x.json", "D1/raw/PAGE_0003_z.json", "D1/artifacts/page_0001.xlsx", "D2/raw/other.json", "D2/raw/hint_page_0004.json"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("{}")
    catalog = pages.files(spark, str(tmp_path / "in"))
    index = pages.result_index(spark.createDataFrame([("D1", json.dumps({"pages": [{"page_number": 9, "text": "a"}, {"page_number": 9, "text": "b"}, {"text": "c"}]})), ("D2", json.dumps({"pages": [{"page_number": 4, "raw_file": "raw/hint_page_0004.json"}]})), ("D3", "broken")], "doc_id string, json string"))
    assert {(r.doc_id, r.page_no): r.text for r in index.collect()} == {("D1", 9): "b", ("D2", 4): None}
    assert {tuple(r) for r in pages.candidate_pages(index, catalog).collect()} == {("D1", 1), ("D1", 2), ("D1", 3), ("D1", 9), ("D2", 4)}
    got = pages.raw_files(index, catalog.filter("page_no IS NOT NULL"), "fam").collect()
    assert {(r.doc_id, r.page_no): (r.path.rpartition("/")[2], r.rank) for r in got} == {("D1", 1): ("page_0001.json", 1), ("D1", 2): ("page_0002_fam_x.json", 2), ("D1", 3): ("PAGE_0003_z.json", 3), ("D2", 4): ("hint_page_0004.json", 0)}


def test_cells_of_both_formats(spark):
    data = {"content": "t", "tableHeadTail": [{"head": ["h", ""], "tail": ["u"]}], "prism_wordsInfo": [{"tableCellId": 1, "prob": 0.5}, {"tableCellId": 1, "prob": 1.0}, {"prob": 0.1}], "prism_tablesInfo": [{"tableId": 7, "cellInfos": [{"tableCellId": 1, "word": "x", "ysc": 1, "yec": 2, "xsc": 3, "xec": 4}]}, {"cellInfos": [{"tableCellId": 2, "ysc": 5}]}]}
    texts = [{"Data": data}, {"data": json.dumps(data)}, {"Data": "{broken"}, {"Other": 1}]
    rows = pages.format_a(spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(texts)], "id int, json string"))
    want = [("7", 0, 1, 2, 3, 4, "x", 0.75), ("2", 0, 5, 5, 0, 0, "", None)]
    assert sorted(map(tuple, pages.cells_a(rows, ["id"]).collect()), key=repr) == sorted(((k, *w) for k in (0, 1) for w in want), key=repr)
    assert sorted(map(tuple, pages.context_a(rows, ["id"]).collect())) == [(0, "h"), (0, "u"), (1, "h"), (1, "u")]
    assert rows.filter("id = 2").first().data.content == "{broken"
    b = {"TableDetections": [{"Cells": [{"RowTl": 1, "RowBr": 2, "ColTl": 0, "ColBr": 1, "Text": "a", "Confidence": 0.9}, {"RowTl": 3, "RowBr": -1, "ColTl": 2, "ColBr": 1}, {"RowTl": -1, "ColTl": 0, "Text": " head "}, {"RowTl": None, "ColTl": 1, "Text": "none"}]}]}
    cells, lines = pages.cells_b(spark.createDataFrame([(1, json.dumps(b)), (2, "x")], "id int, json string"), ["id"])
    assert sorted(map(tuple, cells.collect())) == [(1, "1", 0, 0, 2, 0, 1, "a", 0.9), (1, "1", 1, 2, 2, 1, 1, "", None)]
    assert list(map(tuple, lines.collect())) == [(1, "head")]


def test_parts_heads_and_line_numbers_of_tables(spark):
    tables = {
        1: [["title", "", "", "", "", ""], ["项目", "行次", "期末数", "项目", "行次", "期末数"], ["cash", "1", "10.5", "debt", "9", "3"]],
        2: [["cash", "1", "10"], ["debt", "2", "x"], ["all", "y", "3.5"]],
        3: [["a", "b"], ["c", "d"]],
    }
    cells = [(t, r, c, x) for t, rows in tables.items() for r, row in enumerate(rows) for c, x in enumerate(row)]
    df = spark.createDataFrame(cells, "t int, row int, col int, text string")
    rows = grid.rows_of(df, ["t"])
    assert {r.t: r.first for r in grid.first_meaningful_row(rows, ["t"]).collect()} == {1: 1, 2: 0, 3: 0}
    assert sorted(map(tuple, grid.subtables(rows, ["t"]).collect())) == [(1, 0, 2), (1, 3, 5), (2, 0, 2), (3, 0, 1)]
    assert {r.t: r.header_rows for r in grid.header_rows(rows, ["t"]).collect()} == {1: 2, 2: 1, 3: 2}
    heads = F.when(F.col("t") == 1, 2).when(F.col("t") == 2, 0).otherwise(2)
    assert {r.t: r.col for r in grid.line_number_column(df, ["t"], heads).collect()} == {1: 1, 2: 1}


def test_streams_give_what_tables_give(spark, tmp_path):
    rows = spark.sql("SELECT id % 5 AS k, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 7) AS ts, CAST(id AS double) AS value FROM range(60)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(1,), (3,), (3,)], "k long")

    def result(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    assert result(merging.unresolved_results(stream, known, ["k"]), "merged").count() == 24
    assert sorted(r.k for r in result(merging.first_results(stream, ["k"], "ts", "10 days"), "first").collect()) == [0, 1, 2, 3, 4]
    seen = {(r.start, r.k): (r.n, r.total) for r in result(merging.windows(stream, ["k"], "ts", "value"), "windows").collect()}
    whole = {(r.start, r.k): (r.n, r.total) for r in merging.windows(rows, ["k"], "ts", "value").collect()}
    assert seen and seen.items() <= whole.items()
    now = F.lit("2024-01-03").cast("timestamp")
    assert merging.expired(rows, "ts", now, 1).count() == rows.filter("ts < timestamp '2024-01-02'").count()
