"""Workbooks made by hand, read back, and their tables against a plain version."""

import io
import random
import zipfile

import pytest

from factloom.sources import workbooks as wb


def frame(spark, books):
    return spark.createDataFrame([(name, bytearray(content) if content is not None else None) for name, content in books], "path string, content binary")


def plain_table(cells, merged):
    """Cells of the detected window, row by row; places from 1."""
    value = {(r, c): "" if v in (None, 0) else str(v) for r, c, v in cells}
    for r, c, r2, c2 in merged:
        value |= {(i, j): "" for i in range(r, r2 + 1) for j in range(c, c2 + 1) if (i, j) != (r, c)}
    rows, cols = max(r for r, _ in value), max(c for _, c in value)
    details = [(r, [value[r, c].strip() for c in range(1, cols + 1) if value.get((r, c))]) for r in range(1, rows + 1)]
    told = lambda v: any(w in " ".join(v) for w in wb.TABLE_WORDS)
    start = next((r for r, v in details if len(v) >= 3 or told(v)), 1)
    end = max([r for r, v in details if r >= start and (len(v) >= 2 or told(v))], default=start)
    used = [c for (r, c), v in value.items() if start <= r <= end and v]
    low, high = (min(used), max(used)) if used else (1, cols)
    context = [x for r, v in details if not start <= r <= end for x in v]
    ranges = {(i, j): m for m in merged for i in range(m[0], m[2] + 1) for j in range(m[1], m[3] + 1)}
    out = []
    for r in range(start, end + 1):
        for c in range(low, high + 1):
            m = ranges.get((r, c), (r, c, r, c))
            if m[:2] == (r, c):
                out.append((r - start, m[2] - start, c - low, m[3] - low, value.get((r, c), "")))
    return out, context


def random_sheet(draw):
    top, left = draw.randrange(1, 4), draw.randrange(1, 4)
    cells = {(r, c): draw.choice([None, "a", " b ", 5, 2.5, 0, "期末数", "x<&>y", ""]) for r in range(top, top + draw.randrange(1, 7)) for c in range(left, left + 4) if draw.random() < 0.8}
    cells[left, top] = "t"
    merged, taken = [], set()
    for _ in range(draw.randrange(3)):
        r, c = draw.choice(list(cells))
        r2, c2 = r + draw.randrange(2), c + draw.randrange(3)
        own = {(i, j) for i in range(r, r2 + 1) for j in range(c, c2 + 1)}
        if len(own) > 1 and not own & taken:
            taken |= own
            merged.append((r, c, r2, c2))
            # Covered cells are in the file, without values.
            cells |= {p: None for p in own if p != (r, c)}
    return [(r, c, v) for (r, c), v in cells.items()], merged


def test_tables_are_those_of_a_plain_version(spark):
    draw = random.Random(3)
    sheets = {f"b{k}.xlsx": random_sheet(draw) for k in range(60)}
    files = frame(spark, [(name, wb.workbook([("s", *sheet)])) for name, sheet in sheets.items()])
    found = wb.cells(files)
    got, context = {}, {r.path: r.context for r in wb.windows(found).collect()}
    for r in wb.tables(found).collect():
        got.setdefault(r.path, []).append((r.row_start, r.row_end, r.col_start, r.col_end, r.text))
    for name, sheet in sheets.items():
        want, lines = plain_table(*sheet)
        assert (sorted(got.get(name, [])), context[name]) == (sorted(want), lines), sheet


def test_shared_strings_styles_and_odd_files(spark):
    base = wb.workbook([("one", [(1, 1, "x")], []), ("two", [(1, 1, "y"), (2, 30, 7)], [])], active=1)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(base)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            if not name.endswith("sheet1.xml"):
                new.writestr(name, old.read(name))
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
        new.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy/m/d"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        body = '<row r="2"><c r="A2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c s="1"><v>44926</v></c></row><row><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c t="str"><f>A1</f><v>made</v></c><c t="e"><v>#N/A</v></c><c><v>1e3</v></c><c/></row>'
        new.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    files = frame(spark, [("a", out.getvalue()), ("b", b"no zip"), ("c", None), ("d", b""), ("e", base[:-30])])
    got = {(r.sheet, r.row, r.col): r.text for r in wb.cells(files).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "one"} == {(2, 1): "plain", (2, 2): "rich", (2, 3): "2022-12-31 00:00:00", (3, 1): "True", (3, 2): "", (3, 3): "made", (3, 4): "#N/A", (3, 5): "1000.0", (3, 6): None}
    assert {r.sheet for r in wb.cells(files, "active").collect()} == {"two"} and {r.sheet for r in wb.cells(files, "first").collect()} == {"one"}
    assert got["two", 2, 30] == "7" and wb.cells(files.limit(0)).collect() == []


@pytest.mark.parametrize("header", [2, None])
def test_charts_and_benchmark_sheets(spark, header):
    small = [(1, 1, "ZT_001 一"), (2, 1, "note")]
    rows = [(header, 1, "科目名称"), (header, 2, "期末数"), (header, 3, "期末数"), (header, 4, "期初数")] if header else [(3, 2, "期末数")]
    large = [*rows, (4, 1, " ZT_001  现金 "), (4, 2, 1), (4, 3, 2.5), (5, 1, "ZT_002 存货"), (6, 1, "XX_003 其他"), (6, 2, 9), (7, 1, "ZT_12 no")]
    files = frame(spark, [("w", wb.workbook([("large", large, []), ("small", small, [])]))])
    found = wb.cells(files)
    assert {(r.sheet, r.header_row, r.code, r.name, r.position) for r in wb.chart(found).collect()} == {("large", header or 1, c, n, p) for c, n, p in (("ZT_001", "现金", 4), ("ZT_002", "存货", 5), ("XX_003", "其他", 6))}
    got = {(r.code, r.header, r.value) for r in wb.benchmark_rows(found).collect()}
    if header:
        assert got == {("ZT_001", "期末数", "2.5"), ("ZT_001", "期初数", None), ("ZT_002", "期末数", None), ("ZT_002", "期初数", None)}
    else:
        assert got == {("ZT_001", "期末数", "1"), ("ZT_002", "期末数", None)}
