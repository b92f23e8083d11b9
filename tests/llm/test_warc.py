import gzip
import hashlib
import io
import zlib
from pathlib import Path

import pytest

from tests.llm import fixtures
from textloom.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a.example/x y?q=1#é", b"body\n\nwith\nlines http://b 1 2 3 4\n"), (None, b""), ("http://c/", b"WARC/1.1\r\n\r\n" * 5)]
    back = list(warc.parse_arc(warc.arc(records, version)))
    assert [b for _, b in back] == [b for _, b in records]
    assert [f["url"] for f, _ in back] == ["http://a.example/x%20y?q=1#%C3%A9", "-", "http://c/"]
    assert all(set(f) == set(warc.FIELDS[version]) for f, _ in back)


@pytest.mark.parametrize("data", [b"http://x 1 2 3 4\nabcd\n", b"filedesc://a 0 0 t 3\n1 0\nhttp://x 0 0 t 99\nshort", b"filedesc://a 0 0 t 2\n2 "])
def test_broken_arc(data):
    with pytest.raises((ValueError, IndexError)):
        list(warc.parse_arc(data))


def test_conversion():
    fields, body = next(warc.parse_arc(warc.arc([("http://a/", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\r\nWARC/1.1\r\n\r\n")], 1)))
    headers, block = next(warc.parse_warc(io.BytesIO(warc.convert(fields, body))))
    assert block == body and headers["warc-date"] == "2024-01-01T00:00:00Z" and headers["warc-type"] == "response"
    assert headers["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"\r\nWARC/1.1\r\n\r\n").hexdigest()
    assert warc.convert(fields, body) == warc.convert(fields, body)


def brute(rows):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None] if len(raw) >= 100 else []
        first = min(same, default=i)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


def test_pages(spark):
    long = "<p>é" * 40
    rows = [(5, "http://a/1", long), (3, "http://a/2", long), (3, "http://a/2", long), (9, None, long), (1, "u v", "short"), (2, "", "short"), (7, "x", None), (8, "x", ""), (10, "http://w/", "WARC/1.1\r\n\r\nWARC-Type: response\r\n" * 9), (None, "http://n/", long), (None, "http://n/", "alone " * 40), (-4, "http://z/", "z" * 100), (11, "http://z/", "z" * 100), (12, "q", "z" * 99), (13, "q", "z" * 99), (14, "http://long/", fixtures.prose(1, 60000))]
    out = warc.archived(spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", digest int")).drop("record_id", "target_uri")
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_files_are_archives(spark, tmp_path):
    rows = [(k, f"http://a/{k}", f"<p>{k}</p>" * 30) for k in range(20)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "out"))
    found = [h for f in Path(tmp_path / "out").glob("*.gz") for h, _ in warc.parse_warc(gzip.open(f))]
    assert len(found) == 20 and len({h["warc-record-id"] for h in found}) == 20


def test_archives_on_the_shared_folder(spark, tmp_path, monkeypatch):
    """ARC files of both versions are written and read, a gzip member a record, in files bounded by bytes; bodies of any
    bytes pass, and what is no HTTP response is a resource; revisits name the record, address and date they refer to."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(k, f"http://a/{k}", f"<p>{k % 7}</p>" * 300) for k in range(40)]
    warc.write_arcs(spark.createDataFrame(rows, PAGES), str(tmp_path / "arc"))
    odd = [("http://b/1", bytes(range(256)) * 3), ("http://b/2", b"HTTP/1.0 200 OK\r\n\r\n" + bytes(range(256)) * 3), ("dns:b", b"20240101 1.2.3.4\n")]
    (tmp_path / "arc" / "odd.arc.gz").write_bytes(gzip.compress(warc.arc(odd, 2)))
    arcs = list((tmp_path / "arc").glob("*.arc.gz"))
    assert len(arcs) > 8 and all(len(gzip.open(f).read()) < 30_000 for f in arcs) and {gzip.open(f).read().split(b"\n")[1][:1] for f in arcs} == {b"1", b"2"}
    warc.convert_archives(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    files = list((tmp_path / "warc").glob("*.warc.gz"))
    found = []
    for f in files:
        data = f.read_bytes()
        members = 0
        while data:
            unpack = zlib.decompressobj(31)
            (record,) = warc.parse_warc(io.BytesIO(unpack.decompress(data) + unpack.flush()))
            found.append(record)
            assert (record[0]["warc-type"] == "warcinfo") == (members == 0)
            members, data = members + 1, unpack.unused_data
    by_id = {h["warc-record-id"]: h for h, _ in found}
    revisits = [h for h, _ in found if h["warc-type"] == "revisit"]
    assert len(revisits) == 33  # records without a page are responses or resources
    for h in revisits:
        first = by_id[h["warc-refers-to"]]
        assert first["warc-target-uri"] == h["warc-refers-to-target-uri"] and first["warc-date"] == h["warc-refers-to-date"] and first["warc-payload-digest"] == h["warc-payload-digest"]
    kinds = {h["warc-target-uri"]: (h["warc-type"], b) for h, b in found if h["warc-type"] != "warcinfo"}
    assert kinds["dns:b"] == ("resource", odd[2][1]) and kinds["http://b/1"] == ("resource", odd[0][1]) and kinds["http://b/2"] == ("response", odd[1][1])


def test_query_renames_no_file(spark, tmp_path):
    """Archives are read back by the names that tasks gave them; a folder may hold files of both kinds of names."""
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * 120 if k < 3 else f"page {k}") for k in range(6)], "page_id long, url string, html string")
    warc.write_arcs(pages, str(tmp_path / "arc"), rename=False)
    assert not list((tmp_path / "arc").glob("*.arc.gz")) and list((tmp_path / "arc").glob("part-*.txt"))
    assert warc.read_arcs(spark, str(tmp_path / "arc")).count() == 6
    warc.convert_archives(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), rename=False)
    assert not list((tmp_path / "warc").glob("*.warc.gz"))
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "warc")).collect()}
    assert found == {0: ("response", None), 1: ("revisit", 0), 2: ("revisit", 0), 3: ("response", None), 4: ("response", None), 5: ("response", None)}
