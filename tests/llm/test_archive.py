"""ARC files written, converted and read back against a plain computation, and hand-written archives."""

import base64
import gzip
import hashlib
import io

import pytest

from gridlens.llm import archive

SCHEMA = "page_id long, url string, html string, file string, key string, first string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def through(spark, df, folder, min_bytes=0):
    arcs, warcs = f"file://{folder}/arcs", f"file://{folder}/warcs"
    archive.write_arcs(df, arcs, "page_id", "url", "html")
    archive.convert_arcs(spark, arcs, warcs, "long", min_bytes)
    return archive.resolve(archive.read_warcs(spark, warcs)).collect()


ROWS = [
    (1, "http://a/", "<p>x</p>"), (2, "http://a/b c\nd", "<p>x</p>"), (30, "http://é/", "<p>x</p>"), (4, None, None), (5, "", ""),
    (6, "u", "WARC/1.0\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 3), (7, "u", "é" * 90000), (7, "u", "é" * 90000), (None, "u", "<p>x</p>"), (8, "u", "y\x00\x1f\x8b"),
]


@pytest.mark.parametrize("least", [0, 8, 9])
def test_rows(spark, tmp_path, monkeypatch, least):
    """Copies, nulls, repeated rows, clashing names and texts that look like headers."""
    monkeypatch.setattr(archive, "ARCHIVE_BYTES", 40)
    df = spark.createDataFrame([(*r, "f", "k", "r") for r in ROWS], SCHEMA).repartition(3)
    got = through(spark, df, tmp_path, least)
    assert len(got) == len(ROWS) and all(r.sound for r in got) and len({r.record_id for r in got}) == len(ROWS)
    best = {}
    for k, _, t in ROWS:
        p = (t or "").encode()
        best[p] = max(best.get(p, -1), -1 if k is None else k)
    want = []
    for k, _, t in ROWS:
        p = (t or "").encode()
        other = len(p) >= least and k != best[p]
        want.append((str(k), len(p), digest(p), "revisit" if other else "response", str(best[p]) if other else None))
    # Of the two equal rows 7 one revisits the other.
    long = ("7", 180000, digest(("é" * 90000).encode()))
    want.remove((*long, "response", None))
    want.append((*long, "revisit", "7"))
    assert sorted(map(str, want)) == sorted(str((str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    files = sorted((tmp_path / "arcs").glob("*.arc.gz"))
    versions = {gzip.open(f).read().split(b"\n")[1][:1] for f in files}
    assert len(files) > 3 and versions == {b"1", b"2"} and not list((tmp_path / "warcs").glob("_*"))


def test_repeated_run_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(*r, "f", "k", "r") for r in ROWS[:4]], SCHEMA).coalesce(1)
    first = through(spark, df, tmp_path)
    assert through(spark, df, tmp_path) == first
    assert through(spark, df.limit(0), tmp_path / "none") == []


def hand_written(version):
    """An archive with an HTTP record, a dns record, a record of blanks, and a wrong-looking payload."""
    text = f"{version} 0 Crawler\n{archive.ARC_FIELDS[version]}\n".encode()
    out = archive._arc_line(version, "filedesc://x.arc", "text/plain", len(text), "x.arc") + text + b"\n"
    page = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\nhello\nhttp://b/ 1.2.3.4 19990101000000 text/html 5\n"
    for url, date, mime, doc in [
        ("http://a/x y", "199702031405", "text/html; charset=x", page), ("dns:a", "19970203140506", "text/dns", b"a 1 IN A 1.2.3.4"),
        ("http://b/", "19970203140507123", "text/html", page), ("http://c/", "19970203140508", "-", b""),
    ]:
        extra = " 200 abc - 12 x.arc" if version == 2 else ""
        out += f"{url} 1.2.3.4 {date} {mime}{extra} {len(doc)}\n".encode() + doc + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_hand_written(spark, tmp_path, version, packed):
    arcs, raw = tmp_path / "arcs", hand_written(version)
    arcs.mkdir()
    (arcs / ("x.arc.gz" if packed else "x.arc")).write_bytes(gzip.compress(raw) if packed else raw)
    archive.convert_arcs(spark, f"file://{arcs}", f"file://{tmp_path}/warcs")
    with gzip.open(tmp_path / "warcs/x.warc.gz") as file:
        found = [(f, b"".join([body.header, *body.payload()])) for f, body in archive.warc_records(io.BufferedReader(file), "x")]
    kinds = [f["warc-type"] for f, _ in found]
    assert kinds == ["warcinfo", "revisit", "resource", "response", "resource"]
    assert f"ARC version {version}".encode() in found[0][1]
    assert [f["warc-date"] for f, _ in found[1:]] == [f"1997-02-03T14:05:0{s}Z" for s in (0, 6, 7, 8)]
    assert [f["warc-target-uri"] for f, _ in found[1:]] == ["http://a/x y", "dns:a", "http://b/", "http://c/"]
    payload = b"hello\nhttp://b/ 1.2.3.4 19990101000000 text/html 5\n"
    assert found[1][0]["warc-payload-digest"] == found[3][0]["warc-payload-digest"] == f"sha1:{digest(payload)}"
    assert found[1][0]["warc-refers-to"] == found[3][0]["warc-record-id"] and found[1][1].endswith(b"\n\n") and found[3][1].endswith(payload)
    assert found[2][1] == b"a 1 IN A 1.2.3.4" and found[2][0]["content-type"] == "text/dns" and found[4][1] == b""
    assert all(f["warc-block-digest"] == f"sha1:{digest(block)}" for f, block in found[1:])


@pytest.mark.parametrize("cut", [lambda raw: raw[:-20], lambda raw: raw.replace(b"dns:a 1.2.3.4", b"dns:a"), lambda raw: raw[5:]])
def test_damaged(cut):
    with pytest.raises(ValueError):
        list(archive.arc_records(io.BytesIO(cut(hand_written(1))), "x"))
