"""Cells of spreadsheet workbooks (Office Open XML), and the tables and charts in them.

Files come as rows (path, content), as Spark's binaryFile source gives them, so any store that
Spark reads will do and no file is opened on the driver. A task streams the sheets of its files
cell by cell; windows, headers and charts are found with DataFrame operations on the cells.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words that mark a table's rows, the name column's header, and how a subject's cell reads.
TABLE_WORDS = ("行次", "期初数", "期末数")
NAME_HEADER, HEADER_ROWS, HEADER_DEFAULT = "科目名称", 20, 3
SUBJECT = r"^([A-Z]{2}_[0-9]{3})\s+(.+)$"
BENCHMARK_SUBJECT = r"^(ZT_[0-9]{3})\s*(.*)$"
#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
CELLS = "path string, sheet string, sheet_no int, active boolean, row int, col int, text string, row_end int, col_end int, covered boolean"
SHEET = ["path", "sheet_no"]
BATCH = 20_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the workbooks below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _place(ref: str) -> tuple[int, int]:
    """Row and column, from 1, of a reference like AB12."""
    letters = ref.rstrip("0123456789")
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(ref[len(letters) :]), col


def _name(row: int, col: int) -> str:
    out = ""
    while col:
        col, k = divmod(col - 1, 26)
        out = chr(65 + k) + out
    return f"{out}{row}"


class _Book:
    """What the sheets of one workbook share."""

    def __init__(self, content: bytes):
        self.files = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.files.namelist())
        targets = {r.get("Id"): r.get("Target", "") for r in self._parts("xl/_rels/workbook.xml.rels", "Relationship")}
        self.sheets, self.active = [], 0
        for item in self._parts("xl/workbook.xml", "sheet", "workbookView"):
            if _local(item.tag) == "workbookView":
                self.active = int(item.get("activeTab", 0))
                continue
            key = next((v for k, v in item.attrib.items() if _local(k) == "id"), "")
            target = targets.get(key, "")
            file = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if file in names and "worksheets" in file:
                self.sheets.append((item.get("name", ""), file))
        self.strings = ["".join(t.text or "" for t in self._texts(si)) for si in self._parts("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _parts(self, file: str, *tags: str) -> Iterator[ElementTree.Element]:
        with self.files.open(file) as stream:
            for _, item in ElementTree.iterparse(stream):
                if _local(item.tag) in tags:
                    yield item
                    # A shared string's own parts end before it does.
                    item.clear()

    @staticmethod
    def _texts(item) -> list:
        """Text runs, without phonetic hints."""
        hints = {id(t) for p in item if _local(p.tag) == "rPh" for t in p.iter()}
        return [t for t in item.iter() if _local(t.tag) == "t" and id(t) not in hints]

    def _date_styles(self) -> set[int]:
        own, used, inside = {}, [], False
        with self.files.open("xl/styles.xml") as stream:
            for event, item in ElementTree.iterparse(stream, ("start", "end")):
                tag = _local(item.tag)
                if tag == "cellXfs":
                    inside = event == "start"
                elif event == "start" and tag == "numFmt":
                    own[int(item.get("numFmtId"))] = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", item.get("formatCode", ""))
                elif event == "start" and tag == "xf" and inside:
                    used.append(int(item.get("numFmtId", 0)))
        return {k for k, f in enumerate(used) if f in DATE_FORMATS or re.search("[dmhysDMHYS]", own.get(f, ""))}

    def value(self, kind: str, style: int, raw: str | None, inline: str) -> str | None:
        """A cell's text; empty for zero and false, as a cell without value."""
        if kind == "inlineStr":
            return inline
        if raw is None:
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return "True" if raw.strip() == "1" else ""
        if kind in ("str", "e", "d"):
            return raw
        number = float(raw) if re.search("[.eE]", raw) else int(raw)
        if style in self.dates:
            return str(datetime(1899, 12, 30) + timedelta(milliseconds=round(number * 86_400_000)))
        return str(number) if number else ""

    def cells(self, file: str) -> tuple[list, list]:
        """((row, col, text) of each cell in the file's order, merged ranges as (row, col, last row, last col))."""
        found, merged, row, col = [], [], 0, 0
        with self.files.open(file) as stream:
            for event, item in ElementTree.iterparse(stream, ("start", "end")):
                tag = _local(item.tag)
                if event == "start":
                    if tag == "row":
                        row, col = int(item.get("r", row + 1)), 0
                    continue
                if tag == "c":
                    row, col = _place(item.get("r")) if item.get("r") else (row, col + 1)
                    raw = next((v.text or "" for v in item if _local(v.tag) == "v"), None)
                    inline = "".join(t.text or "" for t in self._texts(item))
                    found.append((row, col, self.value(item.get("t", "n"), int(item.get("s", 0)), raw, inline)))
                elif tag == "mergeCell":
                    first, _, last = item.get("ref").partition(":")
                    merged.append((*_place(first), *_place(last or first)))
                elif tag == "row":
                    item.clear()
        return found, merged


def cells(files: DataFrame, sheets: str = "all") -> DataFrame:
    """The cells of (path, content) rows: CELLS, one row for each cell that a sheet's file holds.

    sheets: all, first, or active; others aren't parsed. text is null for cells without value. The
    first cell of a merged range tells its last row and column, and `covered` marks the others. A file
    that is no workbook, and null content, give no rows. What finds tables and charts in the cells reads
    them several times, so a caller writes them once before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        batch_of = lambda part: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*part), kinds)], names=names)
        # Small books share a batch.
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(*[batch.column(k).to_pylist() for k in ("path", "content")]):
                if content is None or not zipfile.is_zipfile(io.BytesIO(content)):
                    continue
                try:
                    book = _Book(content)
                except (KeyError, ElementTree.ParseError):
                    continue
                for number, (sheet, file) in enumerate(book.sheets):
                    if (sheets == "first" and number) or (sheets == "active" and number != book.active):
                        continue
                    found, merged = book.cells(file)
                    ends = {(r, c): (r2, c2) for r, c, r2, c2 in merged}
                    # Ranges by their first row, so that each cell looks at those that may hold it.
                    merged.sort()
                    out, open_, at = [], [], 0
                    for row, col, text in sorted(found, key=lambda x: x[:2]):
                        while at < len(merged) and merged[at][0] <= row:
                            open_.append(merged[at])
                            at += 1
                        open_ = [m for m in open_ if m[2] >= row]
                        covered = any(m[1] <= col <= m[3] and (row, col) != m[:2] for m in open_)
                        last = (row, col) if covered else ends.pop((row, col), (row, col))
                        out.append((path, sheet, number, number == book.active, row, col, None if covered else text, *last, covered))
                    # Merged ranges whose first cell isn't in the file.
                    out += [(path, sheet, number, number == book.active, r, c, None, r2, c2, False) for (r, c), (r2, c2) in ends.items()]
                    held += out
                    while len(held) >= BATCH:
                        yield batch_of(held[:BATCH])
                        del held[:BATCH]
        if held:
            yield batch_of(held)

    return files.select("path", "content").mapInArrow(run, CELLS)


def windows(found: DataFrame) -> DataFrame:
    """(path, sheet_no, start_row, end_row, start_col, end_col, context) of each sheet's table.

    It starts at the first row of three values or of a table's words, and ends at the last row from
    there on of two values or such words; its columns are those used in it. Values of other rows
    are context lines, in order. A sheet without such a row starts at its first row.
    """
    filled = F.coalesce(F.col("text"), F.lit("")) != ""
    value = F.when(filled, F.struct("col", F.trim("text").alias("text")))
    rows = found.groupBy(*SHEET, "row").agg(F.count_if(filled).alias("n"), F.array_sort(F.collect_list(value)).alias("v"), F.min(F.when(filled, F.col("col"))).alias("low"), F.max(F.when(filled, F.col("col"))).alias("high"), F.max("col_end").alias("last"))
    joined = F.array_join(F.transform("v", lambda x: x["text"]), " ")
    told = F.lit(False)
    for word in TABLE_WORDS:
        told = told | F.contains(joined, F.lit(word))
    rows = rows.withColumns({"told": told, "values": F.transform("v", lambda x: x["text"])}).drop("v")
    starts = rows.groupBy(*SHEET).agg(F.coalesce(F.min(F.when((F.col("n") >= 3) | F.col("told"), F.col("row"))), F.lit(1)).alias("start_row"), F.max("last").alias("last"))
    placed = rows.drop("last").join(starts, SHEET)
    after = F.col("row") >= F.col("start_row")
    ends = placed.withColumn("end_row", F.coalesce(F.max(F.when(after & ((F.col("n") >= 2) | F.col("told")), F.col("row"))).over(Window.partitionBy(*SHEET)), F.col("start_row")))
    inside = after & (F.col("row") <= F.col("end_row"))
    outside = F.when(~inside & (F.col("n") > 0), F.struct("row", "values"))
    made = ends.groupBy(*SHEET, "start_row", "end_row").agg(F.min(F.when(inside, F.col("low"))).alias("low"), F.max(F.when(inside, F.col("high"))).alias("high"), F.max("last").alias("last"), F.array_sort(F.collect_list(outside)).alias("c"))
    context = F.flatten(F.transform("c", lambda x: x["values"]))
    return made.select(*SHEET, "start_row", "end_row", F.coalesce("low", F.lit(1)).alias("start_col"), F.coalesce("high", "last").alias("end_col"), context.alias("context"))


def tables(found: DataFrame) -> DataFrame:
    """(path, sheet_no, table_id, row_start, row_end, col_start, col_end, text) of the tables in sheets, places from 0.

    Every place of a window is a cell, blank ones too, but those that a merged range covers; a
    merged cell keeps its whole range.
    """
    places = windows(found).drop("context")
    names = found.groupBy(*SHEET).agg(F.first("sheet").alias("table_id"))
    rows = places.join(names, SHEET)
    slots = rows.withColumn("row", F.explode(F.sequence("start_row", "end_row"))).withColumn("col", F.explode(F.sequence("start_col", "end_col")))
    wide = found.filter("NOT covered AND (row_end > row OR col_end > col)")
    # Ranges that reach into the window, clipped to it.
    reach = wide.join(places, SHEET).filter("row <= end_row AND row_end >= start_row AND col <= end_col AND col_end >= start_col")
    hidden = reach.withColumn("r", F.explode(F.sequence(F.greatest("row", "start_row"), F.least("row_end", "end_row"))))
    hidden = hidden.withColumn("c", F.explode(F.sequence(F.greatest("col", "start_col"), F.least("col_end", "end_col")))).filter("NOT (r = row AND c = col)").select(*SHEET, F.col("r").alias("row"), F.col("c").alias("col"))
    own = found.filter("NOT covered").select(*SHEET, "row", "col", "text", "row_end", "col_end")
    cells_ = slots.join(hidden, [*SHEET, "row", "col"], "left_anti").join(own, [*SHEET, "row", "col"], "left")
    shift = lambda c, by: (F.col(c) - F.col(by)).cast("int")
    return cells_.select(*SHEET, "table_id", shift("row", "start_row").alias("row_start"), (F.coalesce("row_end", "row") - F.col("start_row")).alias("row_end"), shift("col", "start_col").alias("col_start"), (F.coalesce("col_end", "col") - F.col("start_col")).alias("col_end"), F.coalesce("text", F.lit("")).alias("text"))


def chart(found: DataFrame) -> DataFrame:
    """(path, sheet, sheet_no, header_row, code, name, position) of the chart of accounts in each workbook: the sheet with most subjects, of equal ones the first."""
    first = found.filter("col = 1 AND text IS NOT NULL").withColumn("text", F.trim("text"))
    code, name = F.regexp_extract("text", SUBJECT, 1), F.trim(F.regexp_extract("text", SUBJECT, 2))
    heads = first.groupBy(*SHEET).agg(F.max(F.when(F.col("text") == NAME_HEADER, F.col("row"))).alias("header_row"), F.count_if(F.col("text").rlike(SUBJECT)).alias("n"))
    best = heads.filter("n > 0").groupBy("path").agg(F.min_by(F.struct("sheet_no", "header_row"), F.struct(-F.col("n"), F.col("sheet_no"))).alias("b")).select("path", "b.*")
    subjects = first.filter(F.col("text").rlike(SUBJECT)).select(*SHEET, "sheet", code.alias("code"), name.alias("name"), F.col("row").alias("position"))
    return subjects.join(best, SHEET).select("path", "sheet", "sheet_no", F.coalesce("header_row", F.lit(1)).alias("header_row"), "code", "name", "position")


def header_row(found: DataFrame) -> DataFrame:
    """(path, sheet_no, header_row): the first of the first rows whose first cell is the names' header, else the third."""
    names = F.when((F.col("col") == 1) & (F.col("row") <= HEADER_ROWS) & (F.trim("text") == NAME_HEADER), F.col("row"))
    return found.groupBy(*SHEET).agg(F.coalesce(F.min(names), F.lit(HEADER_DEFAULT)).alias("header_row"))


def benchmark_rows(found: DataFrame) -> DataFrame:
    """(path, code, name, row, header, value) of the first sheet of each workbook: one row for each subject and headed column, null where the cell is empty. Of columns with one header the last counts."""
    sheet = found.filter("sheet_no = 0")
    heads = header_row(sheet)
    text = F.trim(F.coalesce("text", F.lit("")))
    headers = sheet.join(heads, SHEET).filter((F.col("row") == F.col("header_row")) & (F.col("col") > 1) & (text != "")).select(*SHEET, text.alias("header"), "col").groupBy(*SHEET, "header").agg(F.max("col").alias("col"))
    subjects = sheet.join(heads, SHEET).filter((F.col("col") == 1) & (F.col("row") > F.col("header_row")) & text.rlike(BENCHMARK_SUBJECT))
    subjects = subjects.select(*SHEET, F.regexp_extract(text, BENCHMARK_SUBJECT, 1).alias("code"), F.trim(F.regexp_extract(text, BENCHMARK_SUBJECT, 2)).alias("name"), "row")
    values = sheet.select(*SHEET, "row", "col", F.col("text").alias("value"))
    return subjects.join(headers, SHEET).join(values, [*SHEET, "row", "col"], "left").select("path", "code", "name", "row", "header", "value")


def workbook(sheets: list[tuple[str, list[tuple], list[tuple]]], active: int = 0) -> bytes:
    """A workbook of sheets (name, cells (row, col, value), merged ranges). Numbers stay numbers; other values are texts."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    numbers = range(1, len(sheets) + 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as files:

        def put(name: str, text: str) -> None:
            files.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), head + text, zipfile.ZIP_DEFLATED)

        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in numbers)
        put("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rels}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>")
        listed = "".join(f'<sheet name={quoteattr(s[0])} sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(numbers, sheets))
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rels}"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{listed}</sheets></workbook>')
        for k, (_, own, merged) in zip(numbers, sheets):
            rows: dict[int, list[str]] = {}
            for row, col, value in sorted(own, key=lambda x: x[:2]):
                ref = _name(row, col)
                if value is None:
                    cell = f'<c r="{ref}"/>'
                elif isinstance(value, (int, float)) and not isinstance(value, bool):
                    cell = f'<c r="{ref}"><v>{value!r}</v></c>'
                else:
                    cell = f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
                rows.setdefault(row, []).append(cell)
            body = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items())
            ranges = "".join(f'<mergeCell ref="{_name(r, c)}:{_name(r2, c2)}"/>' for r, c, r2, c2 in merged)
            put(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData>' + (f"<mergeCells>{ranges}</mergeCells>" if merged else "") + "</worksheet>")
    return out.getvalue()


def books(rows: DataFrame, book: str = "book") -> DataFrame:
    """(path, content) of one workbook for each `book` of rows (book, sheet_no, sheet, row, col, row_end, col_end, number, text).

    A row is a cell; number counts where it isn't null. A workbook is made in one task, as the
    format is one file; a range of more than one place is merged.
    """

    def made(own: pa.Table) -> pa.Table:
        sheets: dict[int, list] = {}
        for cell in own.to_pylist():
            sheets.setdefault(cell["sheet_no"], []).append(cell)
        parts = []
        for _, part in sorted(sheets.items()):
            part.sort(key=lambda c: (c["row"], c["col"]))
            values = [c["text"] if c["number"] is None or c["number"] != c["number"] else c["number"] for c in part]
            values = [int(v) if isinstance(v, float) and v.is_integer() else v for v in values]
            wide = [(c["row"], c["col"], c["row_end"], c["col_end"]) for c in part if (c["row"], c["col"]) != (c["row_end"], c["col_end"])]
            parts.append((part[0]["sheet"], [(c["row"], c["col"], v) for c, v in zip(part, values)], wide))
        return pa.table({"path": [str(own.column(book)[0].as_py())], "content": pa.array([workbook(parts)], pa.binary())})

    # Cells are few bytes and much work, so their partitions aren't put together by size.
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, book).groupBy(book).applyInArrow(made, "path string, content binary")


def codes(label: Column) -> Column:
    """The code of a subject's cell, empty for other text."""
    return F.regexp_extract(F.trim(label), SUBJECT, 1)
