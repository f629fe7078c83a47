"""Hits against a plain search of every window at every place."""

import hashlib
import re

import numpy as np
import pytest

from gridlens.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, bench):
    windows = {}
    for item, text in bench:
        w = words_of(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, items = words_of(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                found = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if found is not None:
                    hit |= set(range(i, i + n))
                    items |= found
        names = ",".join(sorted(x for x in items if x is not None))
        out.append((key, len(w), len(hit), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "é", "A1"]
    pick = lambda n: rng.choice(vocabulary, n).tolist()
    bench = [(f"i{k}", " ".join(pick(rng.integers(10, 40)))) for k in range(30)]
    bench += [("short", "w1 w2 w3 w1"), ("one", "unusual"), ("none", "?!"), ("null", None), (None, "zq zr zs"), ("i3", "again " + bench[4][1]), ("dup", bench[5][1])]
    docs = [(0, None), (1, ""), (2, "??"), (3, "w1, w2;W3 - w1"), (4, "Unusual"), (5, "zq-zr_zs zq")]
    for k in range(10, 80):
        words = pick(rng.integers(0, 120))
        for _ in range(rng.integers(0, 3)):
            item = words_of(bench[rng.integers(0, 30)][1])
            a = rng.integers(0, len(item))
            at = rng.integers(0, len(words) + 1)
            words[at:at] = item[a : a + rng.integers(1, 20)]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs + [(80, docs[20][1]), (80, docs[20][1]), (None, docs[21][1]), (81, " ".join(pick(3)) * 4000)], bench


@pytest.mark.parametrize("shard,block", [(4 << 20, 8 << 20), (700, 8 << 20), (4 << 20, 1500)])
def test_hits(spark, monkeypatch, shard, block):
    monkeypatch.setattr(dc, "SHARD_BYTES", shard)
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    docs, bench = corpus(shard + block)
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, _items string")
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id string, text string, _hit int")
    got = []
    for r in dc.search(d, b, ["doc_id"]).collect():
        spans = [(r._hit[i], r._hit[i + 1]) for i in range(0, len(r._hit), 2)]
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        n = sum(y - x for x, y in spans)
        got.append((r.doc_id, r._words, n, hashlib.sha256(",".join(r._items).encode()).hexdigest(), n > 0))
    assert sorted(got, key=str) == plain(docs, bench)


def test_removal(spark):
    bench = spark.createDataFrame([("a", " ".join(f"q{i}" for i in range(12)))], "item_id string, text string")
    body = "Start, Q0 " + " ".join(f"q{i}" for i in range(1, 12)) + "! Ünd tail q3 q4."
    rows = [(1, body, "de", 9), (2, None, None, None), (3, "clean TEXT", "en", 1)]
    out = dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string, lang string, _text int"), bench)
    assert out.columns == ["doc_id", "text", "lang", "_text"]
    assert sorted(map(tuple, out.collect())) == [(1, "Start, ! Ünd tail q3 q4.", "de", 9), (2, None, None, None), (3, "clean TEXT", "en", 1)]
    assert dc.search(out.limit(0), bench, ["doc_id"]).count() == 0
    assert [r._hit for r in dc.search(out, bench.limit(0), ["doc_id"]).collect()] == [[], [], []]


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        s = np.append(rng.integers(0, 4, n), 0)
        unique = [(int(x) + 1000) if x else i for i, x in enumerate(s)]
        want = sorted(range(len(s)), key=lambda i: unique[i:])
        assert dc.suffix_array(s).tolist() == want


@pytest.mark.parametrize("where", ["neither", "documents", "benchmark", "both"])
def test_long_word_nearby(spark, where):
    """A word over 64 bytes changes no other word of its chunk."""
    long = "x" * 150
    bench = [("a", " ".join(f"q{i}" for i in range(12)))] + [("b", f"u1 {long} u2")] * (where in ("benchmark", "both"))
    docs = [(1, "pre " + bench[0][1] + " post"), (2, "plain words only")] + [(3, f"u1 {long} u2 tail")] * (where in ("documents", "both"))
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = dc.search(d, spark.createDataFrame(bench, "item_id string, text string"), ["doc_id"]).collect()
    want = {1: ([1, 13], ["a"]), 2: ([], []), 3: ([0, 3], ["b"]) if where == "both" else ([], [])}
    assert {r.doc_id: (r._hit, r._items) for r in got} == {k: want[k] for k, _ in docs}
    # Shards with and without the long word.
    windows = dc.Windows(bench)
    for texts in ([docs[0][1]], [docs[0][1], long]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        found = dc.find(windows, data, np.cumsum([0, *map(len, texts)]))
        assert sorted(found[3].tolist()) == [1, 2, 3]
