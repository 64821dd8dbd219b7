"""WARC archives in Zstandard: one frame for each record, the dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or
itself compressed; each record is a frame of its own. Archives are split over tasks by file, and
a file is decoded as a stream: one record is in memory at a time. Each record's version line,
named fields, length, closing blank lines and block digest are checked. Archives made elsewhere
are read as well: with any dictionary or none, chunked or compressed bodies, any character set
that the HTTP header or the page names.

The writer makes archives of a table of pages, one for each task, in the shared folder. Their
dictionary is trained on about ``TRAINED_ON`` pages, drawn from all that have no more than
``SAMPLE`` characters (so that the driver's memory is bounded); where they are
too few or too alike to train on, it is their text itself. What it is changes no record. A task
names its file anew each time it runs, and only the names that a finished task returns are read,
so a lost executor or a task run twice does no harm.

Defined results: a damaged record is a row with its error and as much as could be read, and
reading goes on at the next frame; so a cut-off file gives its whole records and one error. A
block longer than ``MAX_BLOCK``, the longest that a column's value can be, is an error too. A body
that can't be decoded is an error, with the page as far as it goes. Columns other than the three
named are dropped, whatever their names; of columns with one name the first is read. A
null URL has no target field, and null HTML is marked as absent; both come back as null. Line
breaks in a URL are written in percent form. An empty table gives no archive and no row;
repeated rows are records each; pages of any length are whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import picked, shared_dir, written

#: Production parameters: dictionary bytes, pages it is trained on, their length, and compression level.
DICTIONARY, TRAINED_ON, SAMPLE, LEVEL = 32_768, 400, 100_000, 3
_MAGIC, _FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
_CHUNK = 1 << 20
#: Of one column's value: Java's longest array, less what stands around it.
MAX_BLOCK = (1 << 31) - (1 << 16)
#: Bytes of a frame that are held so that reading can go on within them if it is damaged; of a longer one they are read again.
_HELD = 8 << 20
SCHEMA = "path string, offset bigint, warc_type string, record_id string, date string, target_uri string, content_length bigint, fields map<string,string>, block binary, error string"
_NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, block: bytes, fields: list[tuple[str, str]], id: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), *fields, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, salt: str) -> bytes:
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    if page_id is not None:
        http.append(f"X-Page-Id: {page_id}")
    if html is None:
        http.append("X-Absent: body")
    body = (html or "").encode("utf-8", "surrogatepass")
    http.append(f"Content-Length: {len(body)}")
    block = ("\r\n".join(http) + "\r\n\r\n").encode() + body
    fields = [("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.insert(0, ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    return record("response", block, fields, str(uuid.uuid5(uuid.NAMESPACE_URL, salt)))


def _open(path: str, write: bool = False):
    fs, name = pafs.FileSystem.from_uri(path)
    if write:
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(name, compression=None)  # else the name's ending decides
    return fs.open_input_file(name)


def dictionary_of(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or, of samples that none can be learnt from, the end of their text; b"" of none."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()
    except (z.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[-size:]


def write_archive(path: str, records: Iterator[bytes], dictionary: bytes = b"", level: int = LEVEL, packed: bool = True) -> int:
    """Writes one archive; the number of records. packed: the dictionary compressed."""
    import zstandard as z

    d = z.ZstdCompressionDict(dictionary) if dictionary else None
    c = z.ZstdCompressor(level=level, dict_data=d, write_content_size=True) if d else z.ZstdCompressor(level=level, write_content_size=True)
    n = 0
    with _open(path, True) as f:
        if d:
            raw = z.ZstdCompressor(level=19).compress(dictionary) if packed else dictionary
            f.write(struct.pack("<II", _MAGIC, len(raw)) + raw)
        for r in records:
            f.write(c.compress(r))
            n += 1
    return n


def write_pages(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives of all pages, one a task. (path, records) of those that were written."""
    pages = picked(pages, id, url, html)
    pages = pages.select(F.col(id).cast("bigint").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    share = min(1.0, TRAINED_ON / max(1, pages.count()))
    sample = pages.sample(share, seed=1).where(F.length("html") <= SAMPLE).select("html").toArrow()
    shared = pages.sparkSession.sparkContext.broadcast(dictionary_of([page_record(k, None, h, str(k)) for k, h in enumerate(sample["html"].to_pylist())]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        path = f"{folder}/{name}.warc.zst"
        rows = ((b, k) for b in batches for k in range(b.num_rows))
        first = next(rows, None)
        if first is None:
            return

        def made() -> Iterator[bytes]:
            yield record("warcinfo", b"software: starlace\r\nformat: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")], str(uuid.uuid5(uuid.NAMESPACE_URL, name)))
            yield page_record(*(first[0].column(c)[first[1]].as_py() for c in range(3)), f"{name}/0")
            for k, (b, at) in enumerate(rows):
                yield page_record(b.column(0)[at].as_py(), b.column(1)[at].as_py(), b.column(2)[at].as_py(), f"{name}/{k + 1}")

        n = write_archive(path, made(), shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return pages.mapInArrow(write, "path string, records bigint")


def parse(data: bytes) -> dict:
    """A record's parts, and its first error if there is one."""
    out: dict = {"warc_type": None, "record_id": None, "date": None, "target_uri": None, "content_length": None, "fields": None, "block": None, "error": None}
    end = data.find(b"\r\n\r\n")
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        return out | {"error": "no version line"}
    if end < 0:
        return out | {"error": "the header has no end"}
    fields: dict[str, str] = {}
    last = None
    for line in data[:end].split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            return out | {"error": f"a line without a field: {text[:80]}"}
        last = name.strip().lower()
        if last in fields and last != "warc-concurrent-to":
            return out | {"fields": fields, "error": f"field {last} twice"}
        fields[last] = value.strip()
    out |= {"fields": fields, "warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "date": fields.get("warc-date"), "target_uri": fields.get("warc-target-uri")}
    missing = [k for k in _NEEDED if not fields.get(k)]
    if missing:
        return out | {"error": f"without {', '.join(missing)}"}
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        return out | {"error": "the length is no number"}
    n = out["content_length"] = int(fields["content-length"])
    try:
        datetime.fromisoformat(fields["warc-date"].replace("Z", "+00:00")).astimezone(timezone.utc)
    except ValueError:
        return out | {"error": "the date can't be read"}
    block = data[end + 4 : end + 4 + n]
    out["block"] = block
    if len(block) < n:
        return out | {"error": f"length {n}, but {len(block)} bytes"}
    if data[end + 4 + n :] != b"\r\n\r\n":
        return out | {"error": "the record doesn't end after its length"}
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest.upper() != _digest(block).upper():
        return out | {"error": "the digest differs"}
    return out


class _Source:
    """A file with a look ahead: ``held`` are the bytes from ``at`` on that have been read."""

    def __init__(self, f):
        self.f, self.held, self.at, self.ended = f, bytearray(), 0, False

    def fill(self, n: int) -> bytearray:
        while len(self.held) < n and not self.ended:
            more = self.f.read(_CHUNK)
            self.ended = not more
            self.held += more
        return self.held

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n

    def back(self, at: int) -> None:
        self.f.seek(at)
        self.held, self.at, self.ended = bytearray(), at, False


def _frame(s: _Source, d) -> tuple[bytes, str | None]:
    """The frame at the source's place, which is left behind it, and what is wrong; if anything is,
    the source is left at the next place where a frame may begin, or at the end."""
    import zstandard as z

    offset, parts, size, p, wrong = s.at, [], 0, 0, None
    frame = (z.ZstdDecompressor(dict_data=d) if d else z.ZstdDecompressor()).decompressobj()
    try:
        while not frame.eof:
            if p > _HELD:
                s.drop(p)
                p = 0
            data = bytes(s.fill(p + 1)[p : p + _CHUNK])
            if not data:
                wrong = "the frame is cut off"
                break
            got = frame.decompress(data)
            p += len(data)
            size += len(got)
            if size > MAX_BLOCK:
                wrong = "the record is too large"
                break
            parts.append(got)
    except z.ZstdError as error:
        wrong = f"the frame can't be decoded: {error}"
    if not wrong:
        s.drop(p - len(frame.unused_data))
        return b"".join(parts), None
    if s.at > offset:
        s.back(offset)
    s.fill(1)
    s.drop(1)
    while True:
        k = s.fill(1 << 16).find(_FRAME)
        if k >= 0 or s.ended:
            s.drop(k if k >= 0 else len(s.held))
            return b"", wrong
        s.drop(max(0, len(s.held) - 3))


def read_archive(path: str) -> Iterator[dict]:
    """The records of one archive, in order."""
    import zstandard as z

    with _open(path) as f:
        s, d = _Source(f), None
        while len(s.fill(8)) >= 8 and 0x184D2A50 <= struct.unpack("<I", s.held[:4])[0] <= 0x184D2A5F:
            magic, n = struct.unpack("<II", s.held[:8])
            raw = bytes(s.fill(8 + n)[8 : 8 + n])
            if len(raw) < n:
                yield {"path": path, "offset": s.at, "error": "the dictionary is cut off"}
                return
            if magic == _MAGIC and d is None and raw:
                try:
                    d = z.ZstdCompressionDict(z.ZstdDecompressor().decompressobj().decompress(raw) if raw[:4] == _FRAME else raw)
                except z.ZstdError as error:
                    yield {"path": path, "offset": s.at, "error": f"the dictionary can't be read: {error}"}
                    return
            s.drop(8 + n)
        while s.fill(4):
            if len(s.held) >= 8 and 0x184D2A50 <= struct.unpack("<I", s.held[:4])[0] <= 0x184D2A5F:  # a skippable frame between records
                s.back(s.at + 8 + struct.unpack("<I", s.held[4:8])[0])
                continue
            offset = s.at
            data, wrong = _frame(s, d)
            yield {"path": path, "offset": offset, "error": wrong} if wrong else {"path": path, "offset": offset, **parse(data)}


def read_archives(files: DataFrame, path: str = "path") -> DataFrame:
    """All records of the archives that files names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("content_length", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("error", pa.string())])
        empty = dict.fromkeys(kind.names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for r in read_archive(name) if name else ():
                    r = empty | r
                    r["fields"] = list(r["fields"].items()) if r["fields"] is not None else None
                    rows.append(r)
                    size += len(r["block"] or b"") + 500
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    n = files.count()
    return picked(files, path).toDF("path").repartitionByRange(max(1, n), "path").mapInArrow(read, SCHEMA)


_NAMED = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def _unchunked(body: bytes) -> bytes:
    """ValueError where the chunks aren't whole."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at : max(end, at)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            raise ValueError("the chunks are broken")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if len(body) < end + 2 + n:
            raise ValueError("the chunks are cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _unpacked(body: bytes, coding: str) -> bytes:
    """ValueError where the body can't be decoded."""
    try:
        if coding in ("gzip", "x-gzip", "deflate"):
            try:
                d = zlib.decompressobj(47)
                got = d.decompress(body) + d.flush()
            except zlib.error:
                if coding != "deflate":
                    raise
                d = zlib.decompressobj(-15)  # without its header, as some servers send it
                got = d.decompress(body) + d.flush()
            if not d.eof:
                raise ValueError("the body is cut off")
            return got
        if coding == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    except ValueError:
        raise
    except Exception as error:  # zlib's and zstandard's own
        raise ValueError(f"the body can't be decoded: {error}") from None
    if coding in ("", "identity"):
        return body
    raise ValueError(f"coding {coding} isn't read")


def _text(body: bytes, kind: str) -> str:
    named = re.search(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", kind, re.I)
    sniffed = None if named else _NAMED.search(body[:4096])
    name = named[1] if named else sniffed[1].decode("ascii", "replace") if sniffed else "utf-8"
    if body.startswith(b"\xef\xbb\xbf"):
        name, body = "utf-8", body[3:]
    try:
        name = codecs.lookup(name).name
    except (LookupError, ValueError):
        name = "utf-8"
    if name in ("iso8859-1", "ascii"):
        name = "cp1252"  # as browsers read them
    try:
        return body.decode(name, "replace")
    except (LookupError, UnicodeError):  # no character set, such as rot13, or one that replaces nothing
        return body.decode("utf-8", "replace")


def page_of(block: bytes) -> tuple[int | None, str | None, str | None]:
    """Page id, HTML and what is wrong, of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    page, wrong = fields.get("x-page-id"), None
    length = fields.get("content-length")
    coded = [c for f in ("content-encoding", "transfer-encoding") for c in fields.get(f, "").lower().replace(" ", "").split(",") if c]
    if "chunked" not in coded and length is not None and length != str(len(body)) or length is None and not coded and not body and "x-absent" not in fields:
        wrong = "the HTTP length differs"
    for coding in reversed(coded):
        try:
            body = _unchunked(body) if coding == "chunked" else _unpacked(body, coding)
        except ValueError as error:
            wrong = str(error)
            break
    html = None if fields.get("x-absent") == "body" else _text(body, fields.get("content-type", ""))
    return int(page) if page and page.lstrip("-").isdigit() and len(page) < 19 else None, html, wrong


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, url, html, error) of response records; damaged records have their error. page_id is
    that which ``write_pages`` put down; archives made elsewhere have none."""

    def http(blocks: pa.Array) -> pa.Array:
        out = []
        for b in blocks:
            b = b.as_py()
            out.append(None if b is None else dict(zip(("page_id", "html", "wrong"), page_of(b))))
        return pa.array(out, pa.struct([("page_id", pa.int64()), ("html", pa.string()), ("wrong", pa.string())]))

    kind = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType()), T.StructField("wrong", T.StringType())])
    some = records.where("warc_type = 'response' OR error IS NOT NULL")
    return some.select("target_uri", "error", F.arrow_udf(http, kind).asNondeterministic()("block").alias("p")).select("p.page_id", F.col("target_uri").alias("url"), "p.html", F.coalesce("error", "p.wrong").alias("error"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back."""
    files = written(write_pages(pages, shared_dir(spark, "archive")), "archives")
    return pages_of(read_archives(files))


def query(spark, sf_dir: str) -> DataFrame:
    got = round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", "url", "html", F.octet_length("html").cast("bigint").alias("n_bytes"), "error")


ORACLE = "SELECT page_id, url, html, strlen(html)::BIGINT AS n_bytes, NULL::VARCHAR AS error FROM pages"
