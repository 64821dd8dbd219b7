import struct
import zlib

import pytest

from starlace.llm.warc import dictionary_of, pages_of, parse, page_record, read_archive, read_archives, record, round_trip, write_archive

PAGES = "page_id bigint, url string, html string"


def some(n):
    return [page_record(k, f"http://x/{k}", f"<p>page {k} é {'z' * k}</p>", f"s{k}") for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 3, 60])
@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("learnt", [True, False])
def test_archive(tmp_path, n, packed, learnt):
    path = f"file://{tmp_path}/a.warc.zst"
    records = some(n)
    d = dictionary_of(records) if learnt else b""
    assert bool(d) == (learnt and n > 0)
    assert write_archive(path, iter(records), d, packed=packed) == n
    raw = (tmp_path / "a.warc.zst").read_bytes()
    assert raw.startswith(b"\x5d\x2a\x4d\x18" if d else b"\x28\xb5\x2f\xfd" if n else b"")
    if d and n:  # the records need their dictionary
        (size,) = struct.unpack("<I", raw[4:8])
        (tmp_path / "without.warc.zst").write_bytes(raw[8 + size :])
        assert all(g["error"] for g in read_archive(f"file://{tmp_path}/without.warc.zst"))
    got = list(read_archive(path))
    assert [g["error"] for g in got] == [None] * n and [g["target_uri"] for g in got] == [f"http://x/{k}" for k in range(n)]
    assert [g["content_length"] for g in got] == [len(g["block"]) for g in got] and all(g["warc_type"] == "response" for g in got)


def foreign(url, header, body):
    """A record as another crawler would write it, by hand."""
    block = b"HTTP/1.1 200 OK\r\n" + header + b"\r\n\r\n" + body
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: " + url + b"\r\nWARC-Date: 2020-02-02T02:02:02Z\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_made_elsewhere(spark, tmp_path):
    import gzip

    import zstandard

    page = "<p>Grüße – où</p>"
    zipped = gzip.compress(page.encode())
    chunked = b"".join(b"%x;x=y\r\n%s\r\n" % (len(zipped[k : k + 9]), zipped[k : k + 9]) for k in range(0, len(zipped), 9)) + b"0\r\n\r\n"
    latin = b"<meta charset='iso-8859-1'><p>Gr\xfc\xdfe</p>"
    records = [
        foreign(b"http://chunked", b"Content-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked), foreign(b"http://cp", b"Content-Type: text/html; charset=windows-1252", page.encode("cp1252")),
        foreign(b"http://meta", b"Content-Type: text/html", latin), foreign(b"http://raw", b"Content-Encoding: deflate", zlib.compress(page.encode())[2:-4]), foreign(b"http://br", b"Content-Encoding: br", b"xx"), foreign(b"http://cut", b"Content-Encoding: gzip", zipped[:-12]),
        foreign(b"http://odd", b"Content-Type: text/html; charset=rot13", page.encode()), foreign(b"http://chunk", b"Transfer-Encoding: chunked", b"ffff\r\nabc"),
    ]
    plain = b"HTTP/1.1 200 OK Content-Type: text/html; charset=UTF-8 WARC/1.0 WARC-Type: response WARC-Target-URI: http://" * 3
    d = zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False)
    skipped = b"\x51\x2a\x4d\x18" + struct.pack("<I", 5) + b"12345"
    (tmp_path / "dict.warc.zst").write_bytes(b"\x5d\x2a\x4d\x18" + struct.pack("<I", len(plain)) + plain + b"".join(skipped + c.compress(r) for r in records))
    (tmp_path / "none.warc.zst").write_bytes(b"".join(zstandard.compress(r) for r in records))
    for name in ("dict", "none"):
        files = spark.createDataFrame([(f"file://{tmp_path}/{name}.warc.zst", 1)], "path string, PATH int")
        got = {r.url[7:]: r for r in pages_of(read_archives(files)).collect()}
        assert len(got) == 8 and all(r.page_id is None for r in got.values())
        assert [got[k].html for k in ("chunked", "cp", "raw", "odd")] == [page] * 4 and got["meta"].html.endswith("<p>Grüße</p>")
        assert [got[k].error for k in ("chunked", "cp", "meta", "raw", "odd")] == [None] * 5
        assert "br isn't read" in got["br"].error and "cut off" in got["cut"].error and "cut off" in got["chunk"].error


def test_bytes_read_do_not_grow_with_damage(tmp_path, monkeypatch):
    import starlace.llm.warc as warc

    path = tmp_path / "a.warc.zst"
    write_archive(f"file://{path}", iter(some(4000)))
    raw = bytearray(path.read_bytes())
    offsets = [g["offset"] for g in read_archive(f"file://{path}")]
    for at in offsets[::2]:
        raw[at + 6 : at + 30] = b"\xff" * 24
    path.write_bytes(raw)
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            read.append(len(got := self.f.read(n)))
            return got

        def __getattr__(self, name):
            return getattr(self.f, name)

    real = warc._Source.__init__
    monkeypatch.setattr(warc._Source, "__init__", lambda s, f: real(s, Counted(f)))
    got = list(read_archive(f"file://{path}"))
    assert sum(g["error"] is None for g in got) == 2000 and sum(read) == len(raw)
    read.clear()
    monkeypatch.setattr(warc, "_HELD", 64)  # frames longer than what is held are read again
    assert list(read_archive(f"file://{path}")) == got


def test_damage(tmp_path):
    path = tmp_path / "a.warc.zst"
    records = some(12)
    write_archive(f"file://{path}", iter(records))
    raw = bytearray(path.read_bytes())
    offsets = [g["offset"] for g in read_archive(f"file://{path}")]
    cut = tmp_path / "cut.warc.zst"
    cut.write_bytes(raw[: offsets[11] + 20])
    got = list(read_archive(f"file://{cut}"))
    assert [g["error"] for g in got[:11]] == [None] * 11 and "cut off" in got[11]["error"] and len(got) == 12
    raw[offsets[3] + 4 : offsets[3] + 40] = b"\xff" * 36
    path.write_bytes(raw)
    got = list(read_archive(f"file://{path}"))
    assert sum(g["error"] is None for g in got) == 11 and any(g["error"] for g in got)


@pytest.mark.parametrize("change,error", [
    (lambda r: r[1:], "version"), (lambda r: r.replace(b"WARC-Type: response\r\n", b""), "without warc-type"), (lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1) if False else r[:-6], "bytes"), (lambda r: r + b"x", "end after"),
    (lambda r: r.replace(b"page 1", b"page 2"), "digest"), (lambda r: r.replace(b"WARC-Date: 2", b"WARC-Date: x"), "date"), (lambda r: r.split(b"\r\n\r\n")[0], "no end"), (lambda r: r.replace(b"WARC-Type: response", b"nonsense"), "without a field"), (lambda r: b"", "version"),
])
def test_checks(change, error):
    good = page_record(1, "http://x", "<p>page 1</p>", "s")
    assert parse(good)["error"] is None
    assert error in parse(change(good))["error"]


def test_fields_go_on(tmp_path):
    r = record("metadata", b"", [("X-Long", "a\r\n b")], "1")
    assert parse(r)["fields"]["x-long"] == "a b"


def test_table(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, ""), (3, "http://b\r\nX: y", None), (None, None, None), (1, "http://a", "<p>é</p>"), (5, "", "x" * 3_000_000)] + [(k, "u", f"<p>{k}</p>") for k in range(10, 60)]
    got = round_trip(spark, spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    want = [(a, b.replace("\r", "%0D").replace("\n", "%0A") if b else b, c, None) for a, b, c in rows]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0
    more = spark.createDataFrame([(1, "u", "h", 2, "x")], PAGES + ", extra int, y string").toDF("page_id", "url", "html", "URL", "path")
    assert round_trip(spark, more).collect() == [(1, "u", "h", None)]
    nothing = read_archives(spark.createDataFrame([(None,)], "path string"))
    assert pages_of(nothing).count() == 0
