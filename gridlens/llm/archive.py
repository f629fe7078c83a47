"""Legacy ARC archives converted to WARC archives, and WARC archives read back.

An ARC file begins with a ``filedesc:`` record whose text names the version and the fields of a header
line: five in version 1, ten in version 2. Every record is such a line, as many bytes as the line's last
field declares, and a line feed; the bytes are what the protocol answered, for web pages an HTTP header
and the payload. The converter reads the lines by their version's fields, follows the declared lengths,
and synthesises for each record the WARC named fields: an identifier from archive name and place, the date
from the 14-digit (or 12-digit) time stamp, the type from the URL scheme and the bytes, SHA-1 digests of
block and payload. Of records with equal payloads the one with the largest key becomes the response, the
others revisit it with their HTTP header only.

Files are compressed record by record. One task reads or writes a file at a time and holds no more than
``PIECE`` bytes of a record. Which records are equal is decided by joins over rows without payloads; a
payload that a third of all records share is spread over ``SALTS`` keys. A file appears under its name
when it is whole, so a repeated task writes the same files again.

Null payloads are empty ones. Null keys rank last, of equal keys the later in the archives is the
response. Null and odd URLs are written percent-encoded. Repeated rows are records of their own; a
payload of any length is copied through in pieces; an empty table has no archives; other columns don't
matter. A header line that fits no version, or a file that ends inside a record, raises ValueError: what
follows could not be told apart from payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.files import listing, open_store, publish
from gridlens.llm.registry import query, table
from gridlens.session import scratch, scratch_folder, ship_package, stage

# Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
# Archive bytes that one task reads, about.
TASK_BYTES = 32 << 20
PIECE = 1 << 20
# An HTTP header is looked for in so many bytes; a longer one counts as payload.
HEAD_BYTES = 1 << 16
LEVEL = 2
SALTS = 64
KEY_FIELD = "X-Record-Key"
FETCHED = "20000101000000"

# Fixed values of the format: the header fields by version, and the revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
# URLs and content types may hold blanks; the fields between them don't.
ARC_LINE = {
    1: re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{12,17}) (?P<mime>.*) (?P<length>\d+)"),
    2: re.compile(
        rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{12,17}) (?P<mime>.*) (?P<status>\d+|-) (?P<checksum>\S+) (?P<location>\S+)"
        rb" (?P<offset>\d+|-) (?P<filename>\S+) (?P<length>\d+)"
    ),
}

SCANNED = (
    "file string, seq long, version int, url string, ip string, date string, mime string, http boolean, key string,"
    " payload_bytes long, payload_digest string, block_bytes long, block_digest string"
)
READ = (
    "file string, record_type string, record_id string, target_uri string, date string, key string, payload_bytes long,"
    " payload_digest string, refers_to_id string, sound boolean"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(file: str, seq: int) -> str:
    """The same identifier for a record whenever and wherever its archive is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{file}#{seq}')}>"


def warc_date(stamp: str) -> str:
    """An ARC time stamp of 12 digits (no seconds) or more (digits behind the seconds are dropped) in ISO form."""
    s = (stamp + "00")[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def _readable(stream: BinaryIO, path: str) -> BinaryIO:
    return gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else io.BufferedReader(stream)


class Body:
    """The bytes of one record, read in pieces: first the HTTP header if there is one, then the payload."""

    def __init__(self, stream: BinaryIO, length: int, where: str):
        self.stream, self.left, self.where = stream, length, where
        self.front = self._read(min(length, HEAD_BYTES))
        self.header = b""
        if self.front.startswith(b"HTTP/"):
            end = re.search(rb"\r?\n\r?\n", self.front)
            if end:
                self.header, self.front = self.front[: end.end()], self.front[end.end() :]

    def _read(self, size: int) -> bytes:
        parts = []
        while size:
            part = self.stream.read(size)
            if not part:
                raise ValueError(f"{self.where}: the file ends inside a record")
            parts.append(part)
            size -= len(part)
            self.left -= len(part)
        return b"".join(parts)

    def payload(self) -> Iterator[bytes]:
        if self.front:
            yield self.front
            self.front = b""
        while self.left:
            yield self._read(min(PIECE, self.left))

    def named(self, field: str) -> str | None:
        found = re.search(rb"(?im)^" + re.escape(field.encode()) + rb":[ \t]*([^\r\n]*)", self.header)
        return found[1].decode("latin-1") if found else None


def arc_records(stream: BinaryIO, where: str) -> Iterator[tuple[int, dict, Body]]:
    """``(version, header fields, body)`` of every record; a body must be used before the next record."""
    version = 0
    while line := stream.readline(1 << 20):
        if not line.strip():
            continue
        first = version == 0
        # The filedesc line is in its own version's form; its text, which follows, says which that is.
        shapes = ARC_LINE.values() if first else [ARC_LINE[version]]
        found = [m for shape in shapes if (m := shape.fullmatch(line.rstrip(b"\r\n")))]
        if not found:
            raise ValueError(f"{where}: no header line: {line[:200]!r}")
        fields = {k: v.decode("utf-8", "replace") for k, v in found[-1].groupdict().items()}
        body = Body(stream, int(fields["length"]), where)
        if first:
            number = body.front.split(b" ", 1)[0]
            if not fields["url"].startswith("filedesc:") or number not in (b"1", b"2"):
                raise ValueError(f"{where}: no version block")
            version = int(number)
        yield version, fields, body
        for _ in body.payload():
            pass


def _digests(body: Body) -> tuple[int, bytes, int, bytes]:
    """Size and SHA-1 of the payload and of the block."""
    payload, block, size = hashlib.sha1(), hashlib.sha1(body.header), 0
    for piece in body.payload():
        payload.update(piece)
        block.update(piece)
        size += len(piece)
    return size, payload.digest(), size + len(body.header), block.digest()


class Writer:
    """A file of records, each a gzip member of its own."""

    def __init__(self, folder: str, name: str):
        self.system, place = open_store(folder)
        context = TaskContext.get()
        self.name, self.path = name, f"{place}/{name}"
        self.temporary = f"{place}/_{context.partitionId()}-{context.taskAttemptId()}-{name}"
        self.out, self.bytes = self.system.open_output_stream(self.temporary, compression=None), 0

    def write(self, pieces: Iterator[bytes]) -> None:
        packed = zlib.compressobj(LEVEL, wbits=31)
        for piece in pieces:
            self.out.write(packed.compress(piece))
            self.bytes += len(piece)
        self.out.write(packed.flush())

    def close(self) -> None:
        self.out.close()
        publish(self.system, self.temporary, self.path)


def _arc_line(version: int, url: str, mime: str, length: int, name: str, status: str = "200", checksum: str = "-") -> bytes:
    extra = f" {status} {checksum} - 0 {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {FETCHED} {mime}{extra} {length}\n".encode()


def write_arcs(df: DataFrame, folder: str, key: str, url: str, payload: str) -> DataFrame:
    """Write rows as ARC records, every other file in version 2; ``file, records`` of the files."""
    system, place = open_store(folder)
    system.create_dir(place, recursive=True)
    ship_package(df.sparkSession)
    rows = df.select(
        F.col(f"`{key}`").cast("string").alias("_key"), F.col(f"`{url}`").cast("string").alias("_url"),
        F.col(f"`{payload}`").cast("binary").alias("_payload"),
    )

    def begin(task: int, number: int) -> tuple[Writer, int]:
        version = 1 + (task + number) % 2
        out = Writer(folder, f"pages-{task:05d}-{number:05d}.arc.gz")
        text = f"{version} 0 gridlens\n{ARC_FIELDS[version]}\n".encode()
        out.write(iter([_arc_line(version, f"filedesc://{out.name}", "text/plain", len(text), out.name), text, b"\n"]))
        return out, version

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, out, names, counts = TaskContext.get().partitionId(), 0, None, [], []
        for batch in batches:
            for k, u, p in zip(*batch.columns):
                if out is None or out.bytes >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    out, version = begin(task, number)
                    number += 1
                    names.append(out.name)
                    counts.append(0)
                body = memoryview(p.as_buffer()) if p.is_valid else memoryview(b"")
                address = quote(u.as_py(), safe="%/:?#[]@!$&'()*+,;=~") if u.is_valid and u.as_py() else "about:blank"
                own = f"{KEY_FIELD}: {quote(k.as_py())}\r\n" if k.is_valid else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n".encode()
                line = _arc_line(version, address, "text/html", len(head) + len(body), out.name)
                out.write(piece for piece in (line, head, *(body[i : i + PIECE] for i in range(0, len(body), PIECE)), b"\n"))
                counts[-1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["file", "records"])

    return stage(rows.mapInArrow(run, "file string, records long"), "arc-files")


def _rows(found: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    named = [c.split() for c in schema.split(",")]
    columns = list(zip(*found)) or [[] for _ in named]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named)], names=[n for n, _ in named])


def _each_file(files: DataFrame, tasks: int, read, schema: str) -> DataFrame:
    """Rows that ``read(stream, path, file name)`` finds in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = open_store(path)
                found = []
                with system.open_input_stream(place, compression=None) as raw:
                    for row in read(_readable(raw, path), path, path.rsplit("/", 1)[-1]):
                        found.append(row)
                        if len(found) == 4096:
                            yield _rows(found, schema)
                            found = []
                yield _rows(found, schema)

    return files.select("path").repartition(max(1, tasks)).mapInArrow(run, schema)


def scan_arcs(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the folder's ARC files, without its bytes; a file's ``filedesc`` record has seq 0."""
    ship_package(spark)
    files, total = listing(spark, folder, "arc-listing")

    def read(stream: BinaryIO, path: str, file: str) -> Iterator[tuple]:
        for seq, (version, f, body) in enumerate(arc_records(stream, path)):
            http, key = bool(body.header), body.named(KEY_FIELD)
            size, payload, length, block = _digests(body)
            yield (
                file, seq, version, f["url"], f["ip"], f["date"], f["mime"], http, None if key is None else unquote(key),
                size, base32(payload), length, base32(block),
            )

    return stage(_each_file(files, -(-total // TASK_BYTES), read, SCANNED), "arc-records")


def spread_lookup(rows: DataFrame, on: list[str], wanted: DataFrame, spread: list[str]) -> DataFrame:
    """``rows`` left-joined with ``wanted`` (one row per ``on``); a key with very many rows is met in ``SALTS`` parts."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    parts = salted.select(*on, "_salt").distinct().join(wanted, on)
    return salted.join(parts, [*on, "_salt"], "left").drop("_salt")


def decide(records: DataFrame, key_type: str, min_bytes: int = 0) -> DataFrame:
    """``records`` with ``first``: the record that has the payload for a copy of it; null for all others.

    Payloads of fewer than ``min_bytes`` bytes are never copies.
    """
    same = ["payload_digest", "payload_bytes"]
    of = records.where((F.col("seq") > 0) & (F.col("payload_bytes") >= min_bytes))
    one = F.struct(F.col("key").cast(key_type).alias("rank"), "file", "seq", "key", "url", "date")
    # Copies meet in parts first, so that no task gets all rows of one payload.
    salted = of.groupBy(*same, F.pmod(F.xxhash64("file", "seq"), F.lit(SALTS)).alias("_part"))
    best = salted.agg(F.max(one).alias("first"), F.count("*").alias("n")).groupBy(*same).agg(F.max("first").alias("first"), F.sum("n").alias("n"))
    copied = spread_lookup(records, same, best.where("n > 1").drop("n"), ["file", "seq"])
    other = (F.col("seq") > 0) & F.col("first").isNotNull() & (F.struct("file", "seq") != F.struct("first.file", "first.seq"))
    return copied.withColumn("first", F.when(other, F.struct("first.file", "first.seq", "first.key", "first.url", "first.date")))


def _named(fields: list[tuple[str, str | None]]) -> bytes:
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _warc_fields(r: dict, info: str) -> list[tuple[str, str | None]]:
    """Named fields of a converted record, but for its block."""
    first = r["first"]
    kind = "revisit" if first else "response" if r["http"] else "resource"
    return [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(r["file"], r["seq"])), ("WARC-Date", warc_date(r["date"])),
        ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", None if r["ip"] in ("0.0.0.0", "-") else r["ip"]),
        ("WARC-Warcinfo-ID", info), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
        ("WARC-Payload-Length", str(r["payload_bytes"])),
        *(
            [
                ("WARC-Profile", PROFILE), ("WARC-Truncated", "length"), ("WARC-Refers-To", record_id(first["file"], first["seq"])),
                ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", warc_date(first["date"])),
            ]
            if first else []
        ),
        ("Content-Type", "application/http; msgtype=response" if r["http"] else r["mime"]),
    ]


def convert(spark: SparkSession, decided: DataFrame, arcs: str, warcs: str, tasks: int) -> DataFrame:
    """Write a WARC file per ARC file; ``file, records`` of the files."""
    system, place = open_store(warcs)
    system.create_dir(place, recursive=True)

    def warc_of(file: str, records: Iterator[dict]) -> tuple[str, int]:
        store, folder = open_store(arcs)
        out, n = Writer(warcs, re.sub(r"\.arc(\.gz)?$", "", file) + ".warc.gz"), 0
        with store.open_input_stream(f"{folder}/{file}", compression=None) as raw:
            for r, (_, _, body) in zip(records, arc_records(_readable(raw, file), file), strict=True):
                n += 1
                if r["seq"] == 0:
                    info = record_id(file, 0)
                    block = f"software: gridlens\r\nformat: WARC File Format 1.0\r\nsource: {file} (ARC version {r['version']})\r\n".encode()
                    out.write(iter([
                        _named([
                            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", info), ("WARC-Date", warc_date(r["date"])),
                            ("WARC-Filename", out.name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block))),
                        ]),
                        block, b"\r\n\r\n",
                    ]))
                    continue
                fields = _warc_fields(r, info)
                if r["first"]:
                    block = base32(hashlib.sha1(body.header).digest())
                    fields += [("WARC-Block-Digest", f"sha1:{block}"), ("Content-Length", str(len(body.header)))]
                    out.write(iter([_named(fields), body.header, b"\r\n\r\n"]))
                else:
                    fields += [("WARC-Block-Digest", f"sha1:{r['block_digest']}"), ("Content-Length", str(r["block_bytes"]))]
                    out.write(piece for part in ([_named(fields), body.header], body.payload(), [b"\r\n\r\n"]) for piece in part)
        out.close()
        return out.name, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        row, made = next(rows, None), []
        while row is not None:
            file, ahead = row["file"], [row]

            def own() -> Iterator[dict]:
                while ahead[0] is not None and ahead[0]["file"] == file:
                    yield ahead[0]
                    ahead[0] = next(rows, None)

            made.append(warc_of(file, own()))
            row = ahead[0]
        yield _rows(made, "file string, records long")

    ordered = decided.repartition(max(1, tasks), "file").sortWithinPartitions("file", "seq")
    return stage(ordered.mapInArrow(run, "file string, records long"), "warc-files")


def warc_records(stream: BinaryIO, where: str) -> Iterator[tuple[dict, Body]]:
    """``(named fields in lower case, body)`` of every record; a body must be used before the next record."""
    while line := stream.readline(1 << 20):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{where}: no WARC record: {line[:200]!r}")
        fields = {}
        while (line := stream.readline(1 << 20)).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        body = Body(stream, int(fields["content-length"]), where)
        yield fields, body
        for _ in body.payload():
            pass


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record but ``warcinfo`` of the folder's WARC files; ``sound``: the digests agree with the bytes.

    A revisit has the size and digest of the payload it refers to.
    """
    ship_package(spark)
    files, total = listing(spark, folder, "warc-listing")

    def read(stream: BinaryIO, path: str, file: str) -> Iterator[tuple]:
        for f, body in warc_records(stream, path):
            kind, key = f["warc-type"], body.named(KEY_FIELD)
            if kind == "warcinfo":
                continue
            size, payload, _, block = _digests(body)
            sound = f.get("warc-block-digest") == f"sha1:{base32(block)}"
            stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "revisit":
                size, digest = int(f.get("warc-payload-length", size)), stated
            else:
                digest = base32(payload)
                sound = sound and stated == digest
            yield (
                file, kind, f["warc-record-id"], f.get("warc-target-uri"), f.get("warc-date"), None if key is None else unquote(key),
                size, digest, f.get("warc-refers-to"), sound,
            )

    return stage(_each_file(files, -(-total // TASK_BYTES), read, READ), "warc-records")


def convert_arcs(spark: SparkSession, arcs: str, warcs: str, key_type: str = "long", min_bytes: int = 0) -> DataFrame:
    """Convert a folder of ARC files into a folder of WARC files."""
    decided = stage(decide(scan_arcs(spark, arcs), key_type, min_bytes), "arc-decisions")
    tasks = decided.agg(F.sum("block_bytes")).first()[0] or 0
    return convert(spark, decided, arcs, warcs, -(-tasks // (2 * TASK_BYTES)))


def resolve(records: DataFrame) -> DataFrame:
    """Read-back records with ``refers_to``: the key of the record that a revisit names."""
    named = records.where("refers_to_id is null").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    return spread_lookup(records, ["refers_to_id"], named, ["record_id"])


OP11_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        1 + ((('0x' || s[5 * (i // 4) + 1:5 * (i // 4) + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER]), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""


@query("op11_warc", OP11_SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC archives into WARC archives, read back."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    with scratch(spark):
        arcs, warcs = scratch_folder(spark, "arcs"), scratch_folder(spark, "warcs")
        write_arcs(pages, arcs, "page_id", "url", "html")
        convert_arcs(spark, arcs, warcs, kind)
        found = resolve(read_warcs(spark, warcs))
        return stage(
            found.select(
                F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                F.col("refers_to").cast(kind).alias("refers_to"),
            ),
            "warc-pages", outer=True,
        )
