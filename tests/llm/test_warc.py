import gzip
import io
from pathlib import Path

import pytest

from barloom.llm import warc
from barloom.session import scratch

PAGES = "page_id long, url string, html string, refers_to string, __x string"
ROWS = [
    (1, "http://a.org/x y", "<p>same</p>"), (5, "http://b.org/", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "u", None), (4, "v", ""),
    (6, "http://c.org/\n", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\n\nURL 1 2 3 4\n"), (7, "http://é.org", "é漢🎉"), (8, "w", "z" * 300_000),
    (None, "n", "<p>same</p>"), (9, "t", "twice"), (9, "t", "twice"), (10, "q", "\n"),
]


def brute(rows, least=0):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        best = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        again = len(raw) >= least and best is not None and page != best
        out.append((page, len(raw), warc.payload_digest(raw), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6, 12])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "x", "x") for r in ROWS], PAGES)
    got = sorted((tuple(r) for r in warc.round_trip(pages, least).collect()), key=str)
    assert got == brute(ROWS, least)


def test_files_are_plain_warc(spark):
    path = scratch(spark, "warc-test")
    warc.pages_to_warc(spark.createDataFrame([(*r, "x", "x") for r in ROWS[:6]], PAGES), path)
    records = []
    for file in Path(path).glob("*.gz"):
        records += warc.parse_warc(io.BytesIO(gzip.decompress(file.read_bytes())))
    assert len(records) == 6 and len({h["warc-record-id"] for h, _ in records}) == 6
    for headers, block in records:
        assert warc.payload_digest(block) == headers["warc-block-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "revisit":
            assert headers["warc-refers-to"] in {h["warc-record-id"] for h, _ in records}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    records = [warc.ArcRecord(f"http://x/{i}", "1.2.3.4", "20200101000000", "text/html", c) for i, c in enumerate([b"", b"\n\nhttp://y 1 2 3 4\n", "é".encode() * 5])]
    data = warc.arc_file(records, version, "f.arc")
    assert list(warc.parse_arc(data)) == records
    with pytest.raises(ValueError):
        list(warc.parse_arc(data + b"http://broken 1\n"))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


#: Written by hand, as other tools write them: a blank in a URL, no HTTP head, Latin-1, bytes of an image and of gzip.
PNG, ZIPPED = b"\x89PNG\r\n\x1a\n\x00\xff", gzip.compress(b"inside", mtime=0)


def foreign(version, bodies):
    fields = {1: b"URL IP-address Archive-date Content-type Archive-length",
              2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    about = b"%d 0 Some Crawler\n%s\n\n" % (version, fields)
    own = b" 200 - - 0 x.arc " if version == 2 else b" "
    out = b"filedesc://x.arc 0.0.0.0 19970923205517 text/plain%s%d\n%s\n" % (own, len(about), about)
    for k, (url, date, kind, body) in enumerate(bodies):
        out += b"%s 10.0.0.%d %s %s%s%d\n%s\n" % (url, k, date, kind, own, len(body), body)
    return out


BODIES = [
    (b"http://a.org/some page", b"19970923205517", b"text/html", b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\ncaf\xe9"),
    (b"http://b.org/", b"1998", b"text/html", b"HTTP/1.0 200 OK\nServer: y\n\ncaf\xe9"),
    (b"http://c.org/i.png", b"soon", b"image/png", b"HTTP/1.1 200 OK\r\n\r\n" + PNG),
    (b"http://d.org/z", b"19990101000000", b"text/plain", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + ZIPPED),
    (b"dns:e.org", b"19990101000000", b"text/dns", b"e.org 1.2.3.4\r\n\r\n"),
    (b"http://f.org/old\xe9", b"19990101000000", b"text/html", b"<p>no head</p>"),
    (b"http://g.org/", b"19990101000000", b"text/html", b"HTTP/1.1 204 No Content\r\nServer: z"),
]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(spark, tmp_path, version, packed):
    data = foreign(version, BODIES)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / ("x.arc.gz" if packed else "x.arc")).write_bytes(gzip.compress(data) if packed else data)
    rows = {r.url: r for r in warc.read_arc(spark, str(tmp_path / "arc")).collect()}
    assert {u: bytes(r.content) for u, r in rows.items()} == {warc.text_of(u): body for u, _, _, body in BODIES}
    assert all(data[r.offset:].startswith(u.encode("latin-1")) for u, r in rows.items())
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    found = {}
    for file in (tmp_path / "warc").glob("*.gz"):
        for headers, block in warc.parse_warc(io.BytesIO(gzip.decompress(file.read_bytes()))):
            found[headers["warc-target-uri"]] = headers, block
    assert len(found) == len(BODIES)
    # The later of two equal payloads stays; a record repeats its head, not its payload.
    headers, block = found["http://a.org/some page"]
    assert headers["warc-type"] == "revisit" and block == b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"
    assert headers["warc-refers-to"] == found["http://b.org/"][0]["warc-record-id"]
    assert headers["warc-date"] == "1997-09-23T20:55:17Z" and found["http://b.org/"][0]["warc-date"] == "1998-01-01T00:00:00Z"
    assert found["http://c.org/i.png"][1].endswith(PNG) and found["http://c.org/i.png"][0]["warc-date"] == "1970-01-01T00:00:00Z"
    assert found["http://d.org/z"][1].endswith(ZIPPED)
    assert found["dns:e.org"][0]["warc-type"] == "resource" and found["dns:e.org"][0]["content-type"] == "text/dns"
    assert found["http://f.org/oldé"][0]["warc-type"] == "resource"
    read = {r.url: r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert read["http://g.org/"].payload_bytes == 0 and read["http://a.org/some page"].payload_bytes == 4


def test_damaged_archives():
    whole = foreign(1, BODIES)
    for data in (whole[:-6], b"x" + whole, whole.replace(b"1 0 Some", b"7 0 Some")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(data))


def test_files_end_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    path = scratch(spark, "warc-test")
    pages = spark.createDataFrame([(k, "u", "y" * 700 + str(k)) for k in range(9)], "page_id long, url string, html string").coalesce(1)
    warc.pages_to_arc(pages, path)
    assert len(list(Path(path).glob("*.gz"))) == 9
    assert sorted(int(r.record_key) for r in warc.read_arc(spark, path, warc.PAGE_KEY).collect()) == list(range(9))
