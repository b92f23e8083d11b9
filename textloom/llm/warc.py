"""Legacy archive converter: ARC files of either version to WARC, and WARC files read back.

An ARC record is a header line of space-separated fields, whose number the version block at the head of the file
fixes, then as many bytes as its last field declares, then a line feed. Nothing inside a body is searched for: only
declared lengths move the reader. Each record becomes a WARC record with a name-based identifier, the timestamp
rewritten, a type, and the SHA-256 of the payload; the version block becomes a ``warcinfo`` record. Equal payloads of at
least ``least`` bytes become revisits of the one with the smallest id, with the identifier, address and date that they
refer to; since that takes all records, the few digests that occur twice or more are found first.

Files of both kinds go through Spark's writer and readers on the shared folder, under the names that Spark's tasks give
them; to hand files over, ``rename=True`` gives them the endings of their kind, a rename a file by the driver. A row is a whole file of about
``ARCHIVE_BYTES`` (or a single longer record), in which each record is a gzip member of its own, so files can be read from
any record, and what a task holds is bounded by that. Bodies are bytes of any kind.

Cases: a null html is an empty payload; a null or odd URL is percent-encoded, or ``-``; payloads may hold the words
of any header; rows that share the smallest id and the payload are all responses; a null id never is the one revisited
while another id has the payload, and a null id's record names no other where it is alone; an empty table gives an
empty table and no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import dropped, fresh_path, saved

FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
LEAST_BYTES = 100
#: Up to so many repeated digests (about 100 bytes each) are broadcast; beyond, records are shuffled by digest.
MOST_BROADCAST = 100_000
#: Bytes of records, before compression, in a file.
ARCHIVE_BYTES = 16 << 20
LEVEL = 4
DATE = "20240101000000"


def arc_records(records: Iterable[tuple[str, bytes]], version: int, date: str = DATE, name: str = "pages.arc") -> Iterator[bytes]:
    """The version block of an ARC file, then the record of each (URL, body) pair."""
    titles = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    block = b"%d 0 textloom\n" % version + titles[version] + b"\n\n"
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(block)}\n".encode() + block
    yield head
    at = len(head)
    for url, body in records:
        middle = f"200 - - {at} {name} " if version == 2 else ""
        line = f"{quote(url or '-', safe=':/?#[]@!$&()*+,;=%~')} 0.0.0.0 {date} text/html {middle}{len(body)}\n".encode()
        yield b"".join((line, body, b"\n"))
        at += len(line) + len(body) + 1


def arc(records: Iterable[tuple[str, bytes]], version: int, date: str = DATE, name: str = "pages.arc") -> bytes:
    """An ARC file of (URL, body) pairs."""
    return b"".join(arc_records(records, version, date, name))


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and body of each record after the version block."""
    view, at, version = memoryview(data), 0, 0
    while at < len(data):
        if not version and not data.startswith(b"filedesc://", at):
            raise ValueError("an ARC file begins with its version block")
        end = data.index(b"\n", at)
        line = data[at:end].decode().split(" ")
        length = int(line[-1])
        body = view[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError("a record is shorter than it declares")
        at = end + 1 + length
        if not version:
            version = int(bytes(body[:1]))
            if len(line) != len(FIELDS[version]):
                raise ValueError("the version block does not fit its version")
            continue
        if len(line) != len(FIELDS[version]):
            raise ValueError(f"a record of version {version} has {len(FIELDS[version])} fields")
        yield dict(zip(FIELDS[version], line, strict=True)), bytes(body)
        at += data[at : at + 1] == b"\n"


def payload_at(body: bytes) -> int:
    """Where the payload begins: after the header of an HTTP response, else at once."""
    return body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") else 0


def _when(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(fields: dict, body: bytes, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{fields["url"]} {fields["date"]} {hashlib.sha256(body[: payload_at(body)]).hexdigest()} {digest}')}"


def _record(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(fields: dict, body: bytes, refers_to: dict | None = None) -> bytes:
    """The WARC record of an ARC record; ``refers_to`` (record_id, url, date) makes it a revisit of that one, which has
    the HTTP header alone. What is no HTTP response is a resource."""
    cut = payload_at(body)
    digest = hashlib.sha256(memoryview(body)[cut:]).hexdigest()
    kind = "revisit" if refers_to else "response" if cut else "resource"
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(fields, body, digest)}>", f"WARC-Date: {_when(fields['date'])}", f"WARC-Target-URI: {fields['url']}",
        f"WARC-IP-Address: {fields['ip']}", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Type: {'application/http; msgtype=response' if cut else fields['type']}",
    ]
    if refers_to:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to['record_id']}>",
            f"WARC-Refers-To-Target-URI: {refers_to['url']}", f"WARC-Refers-To-Date: {_when(refers_to['date'])}",
        ]
    return _record(lines, body[:cut] if refers_to else body)


def info(origins: list[str], date: str) -> bytes:
    """The record that heads a file, from the version blocks of the ARC files that its records come from."""
    block = "".join(f"{k}: {v}\r\n" for k, v in [("software", "textloom"), ("format", "WARC File Format 1.1"), *(("description", f"converted from {x}") for x in origins)]).encode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(block).hexdigest() + date)
    return _record(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {_when(date)}", "Content-Type: application/warc-fields"], block)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of each record of an unpacked WARC file."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not re.fullmatch(rb"WARC/1\.[01]\r\n", line):
            raise ValueError("a record begins with its version")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends with two empty lines")
        yield headers, block


def _member(record: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _file(members: list[bytes]) -> bytes:
    """Members joined, without the last byte, a zero, which the writer adds as its line separator. It is the highest one of
    the last member's size; after a record of 16 MB or more, an empty member makes it so."""
    if members[-1][-1]:
        members.append(_member(b""))
    return b"".join(members)[:-1]


def _files(values: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for value in values:
        yield pa.record_batch([pa.array([value], pa.large_binary()).cast(pa.binary())], ["value"])


def _written(files: DataFrame, path: str, ending: str, rename: bool) -> None:
    """Write each row's bytes as one file under ``path``; with ``rename``, named by its kind."""
    spark = files.sparkSession
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    if not rename:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for found in system.listStatus(folder):
        name = found.getPath().getName()
        if name.endswith(".txt"):
            system.rename(found.getPath(), hadoop.Path(folder, name.removesuffix(".txt") + ending))


def _arcs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """page_id, url, html -> ARC files, the two versions in turn."""

    def rows() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for x in (x for low in range(0, len(batch), 200) for x in batch.slice(low, 200).to_pylist()):
                number = b"" if x["page_id"] is None else b"%d" % x["page_id"]
                yield x["url"], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: %s\r\n\r\n" % number + x["html"]

    def files() -> Iterator[bytes]:
        left, k = rows(), 0
        first = next(left, None)
        while first is not None:
            size, held, nxt = len(first[1]), [first], None
            for nxt in left:
                if size + len(nxt[1]) > most:
                    break
                held.append(nxt)
                size += len(nxt[1])
                nxt = None
            yield _file([_member(x) for x in arc_records(held, 1 + k % 2, name=f"pages-{hashlib.sha256(held[0][1]).hexdigest()[:16]}.arc")])
            first, k = nxt, k + 1

    yield from _files(files())


def _contents(spark, path: str, ending: str) -> DataFrame:
    """The bytes of each file under a path that was written here, by the name of its task or its kind."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "{part-*.txt,*" + ending + "}").load(path).where("length > 0").select("content")


def write_arcs(pages: DataFrame, path: str, rename: bool = True) -> None:
    """Write the rows of ``pages`` (page_id, url, html) as ARC files under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    _written(rows.mapInArrow(lambda batches, most=ARCHIVE_BYTES: _arcs(batches, most), "value binary"), path, ".arc.gz", rename)


_ARC = "page_id long, record_id string, url string, ip string, date string, type string, digest string, size long, origin string"


def _read_arcs(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
    names = [*(x.split()[0] for x in _ARC.split(", ")), *(["body"] if bodies else [])]
    types = [pa.int64() if n in ("page_id", "size") else pa.binary() if n == "body" else pa.string() for n in names]
    for batch in batches:
        for content in batch.column("content"):
            data = gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())).read()  # its time follows the bytes, whatever the members
            rows, size = [], 0
            origin = data[: data.find(b" ")].decode()
            for f, body in parse_arc(data):
                cut = payload_at(body)
                digest = hashlib.sha256(memoryview(body)[cut:]).hexdigest()
                page = re.search(rb"(?m)^X-Page-Id: (-?\d+)", body[:cut])
                rows.append((int(page[1]) if page else None, record_id(f, body, digest), f["url"], f["ip"], f["date"], f["type"], digest, len(body) - cut, origin, *([body] if bodies else [])))
                size += len(body)
                if size > ARCHIVE_BYTES // 4:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_arcs(spark, path: str, bodies: bool = False) -> DataFrame:
    """The records of all ARC files under a path, with their bodies if asked for."""
    return _contents(spark, path, ".arc.gz").mapInArrow(lambda batches: _read_arcs(batches, bodies), _ARC + (", body binary" if bodies else ""))


def _warcs(batches: Iterator[pa.RecordBatch], head: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Records of ARC files, with what they refer to -> WARC files."""

    def files() -> Iterator[bytes]:
        members, size, origins, date = [], 0, {}, ""
        for batch in batches:
            for x in (x for low in range(0, len(batch), 200) for x in batch.slice(low, 200).to_pylist()):
                members.append(_member(convert(x, x["body"], x["refers_to"])))
                origins[x["origin"]], date = None, max(date, x["date"])
                size += len(x["body"])
                if size > most:
                    yield _file(([_member(info(list(origins), date))] if head else []) + members)
                    members, size, origins = [], 0, {}
        if members:
            yield _file(([_member(info(list(origins), date))] if head else []) + members)

    yield from _files(files())


def convert_archives(spark, source: str, path: str, least: int = LEAST_BYTES, head: bool = True, rename: bool = True) -> None:
    """Convert the ARC files under ``source`` to WARC files under ``path``; with ``head``, each begins with a warcinfo record."""
    light = read_arcs(spark, source).where(F.col("size") >= least)
    last = F.lit((1 << 63) - 1)
    one = F.struct(F.coalesce("page_id", last).alias("order"), "page_id", "record_id", "url", "date").alias("one")
    twice = saved(light.select("digest", one).groupBy("digest").agg(F.min("one").alias("one"), F.count("*").alias("n")).where("n > 1"), "twice")
    known = twice.select("digest", "one")
    if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    rows = read_arcs(spark, source, True)
    joined = rows.withColumn("key", F.when(F.col("size") >= least, F.col("digest"))).join(known.withColumnRenamed("digest", "key"), "key", "left")
    refers = F.when(F.col("one.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("one.page_id")), F.struct("one.record_id", "one.url", "one.date"))
    joined = joined.select("url", "ip", "date", "type", "origin", "body", refers.alias("refers_to"))
    _written(joined.mapInArrow(lambda batches, most=ARCHIVE_BYTES: _warcs(batches, head, most), "value binary"), path, ".warc.gz", rename)
    dropped(twice)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, head: bool = False, rename: bool = True) -> None:
    """Write ``pages`` as ARC files to the shared folder and convert these to WARC files under ``path``."""
    spark = pages.sparkSession
    source = fresh_path(spark, "arc")
    write_arcs(pages, source, rename=False)
    convert_archives(spark, source, path, least, head, rename)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers", "record_id", "target_uri"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 5]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for h, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                if h["warc-type"] == "warcinfo":
                    continue
                cut = payload_at(block)
                page = re.search(rb"(?m)^X-Page-Id: (-?\d+)", block[:cut])
                digest = h["warc-payload-digest"].removeprefix("sha256:")
                revisit = h["warc-type"] == "revisit"
                if not revisit and hashlib.sha256(memoryview(block)[cut:]).hexdigest() != digest:
                    raise ValueError("a payload does not fit its digest")
                rows.append((int(page[1]) if page else None, None if revisit else len(block) - cut, digest, h["warc-type"], h.get("warc-refers-to", "").strip("<>") or None, h["warc-record-id"].strip("<>"), h["warc-target-uri"]))
                if len(rows) == 5000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri of all WARC records under a
    path; a revisit has the size and the page of the record that it refers to."""
    files = _contents(spark, path, ".warc.gz")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers string, record_id string, target_uri string"
    rows = saved(files.mapInArrow(_read, schema), "records")
    asked = rows.where("refers IS NOT NULL").select(F.col("refers").alias("record_id")).distinct()
    some = asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    firsts = rows.where("refers IS NULL").select("record_id", "page_id", "payload_bytes").join(F.broadcast(asked) if some else asked, "record_id", "left_semi")
    firsts = firsts.groupBy(F.col("record_id").alias("refers")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("size"))
    out = rows.join(F.broadcast(firsts) if some else firsts, "refers", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "record_id", "target_uri")


def archived(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write ARC files into the shared folder, convert them to WARC files there, and read these back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least, head=True, rename=False)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM q
"""
