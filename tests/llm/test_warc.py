import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from factloom.llm import warc_zip
from factloom.llm.common import scratch_dir

LONG = "<p>" + "words of a page " * 20 + "é</p>"
PAGES = [(5, "http://a/ü?x=1", LONG), (3, None, LONG), (9, "http://b", LONG), (3, "http://c", LONG), (None, "http://d", LONG), (7, "", None), (8, "http://e", ""), (1, "http://f", "tiny"), (2, "http://f", "tiny"), (4, "http://g", "\r\n\r\nWARC/1.1\r\n" + LONG * 2000)]


def test_records_come_back_from_the_packages(spark):
    path = scratch_dir(spark, "warc")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'clash' AS record_type").repartition(3)
    warc_zip.write(pages, path)
    got = warc_zip.read(warc_zip.index(spark, path), path).collect()
    assert len(got) == len(PAGES)
    by = {}
    for r in got:
        by.setdefault((r.page_id, r.url), []).append(r)
    for key, url, html in PAGES:
        (r,) = by[key, url]
        payload = (html or "").encode()
        revisit = html == LONG and key in (5, 9)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to, r.payload) == (("revisit", 3, None) if revisit else ("response", None, payload))
    few = warc_zip.read(warc_zip.index(spark, path).limit(2), path).collect()
    assert len(few) == 2
    none = scratch_dir(spark, "none")
    warc_zip.write(pages.limit(0), none)
    assert warc_zip.index(spark, none).collect() == []


def package(records, member, with_index=False, limit=None, monkeypatch=None):
    if limit is not None:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first.txt", "x" * 100)
        z.writestr(member, b"".join(records))
        z.comment = b"PK\x05\x06 a comment that looks like an end"
    return out.getvalue()


@pytest.mark.parametrize("limit", [None, 10])
@pytest.mark.parametrize("member", [warc_zip.PACKED, warc_zip.PLAIN])
def test_packages_without_an_index_and_with_zip64_directories(monkeypatch, member, limit):
    plain = [warc_zip.record(k, f"http://x/{k}", b"payload" * k * 3000, None if k < 3 else 1, "1970-01-01T00:00:00Z") for k in range(5)]
    data = package([warc_zip.packed(r) if member == warc_zip.PACKED else r for r in plain], member, limit=limit, monkeypatch=monkeypatch)
    assert (b"PK\x06\x06" in data) == (limit is not None)
    with pa.PythonFile(io.BytesIO(data), "r") as file:
        places = list(warc_zip._places(file, len(data)))
        got = []
        for at, length in places:
            file.seek(at)
            got.append(warc_zip.parse(warc_zip.unpacked(file.read(length))))
    assert [r["page_id"] for r in got] == list(range(5))
    assert [r["payload"] for r in got] == [b"payload" * k * 3000 if k < 3 else None for k in range(5)]


def test_what_is_broken_is_said_to_be():
    good = warc_zip.record(1, "http://x", b"payload", None, "1970-01-01T00:00:00Z")
    for bad in (good[:-4], good.replace(b"payload\r\n", b"payl0ad\r\n"), b"HTTP/1.1 200 OK\r\n\r\n", good + b"x"):
        with pytest.raises(ValueError):
            warc_zip.parse(bad)
    data = package([good], warc_zip.PLAIN)
    for bad in (b"", data[:-80], data.replace(b"PK\x01\x02", b"PK\x01\x03")):
        with pytest.raises(ValueError):
            list(warc_zip._places(io.BytesIO(bad), len(bad)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.PLAIN, good * 3)
    with pytest.raises(ValueError, match="compressed"):
        list(warc_zip._places(out, len(out.getvalue())))
