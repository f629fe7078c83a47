"""The audit against plain counting, and the tree walk against all cells."""

import re
from collections import Counter

import numpy as np
import pytest

from gridlens.llm import divergence
from gridlens.llm.queries import ORACLE  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def plain(rows, least, top):
    docs = [((lang or ""), (source or ""), [
        "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    ]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: Counter() for own, s, _ in docs if own == lang}
        for own, s, words in docs:
            if own == lang:
                counts[s].update(w for w in words if w in kept)

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = sorted(((o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, "pair", o, v, k) for k, (o, v) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t, v, k) for k, (t, v) in enumerate(terms[:top], 1)]
    return sorted(out)


def made(seed, n, sources, words):
    rng = np.random.default_rng(seed)
    vocabulary = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)), "É", "é", "ABC", "日本", "ß"]
    rows = []
    for k in range(n):
        size = int(rng.integers(0, 40))
        text = "".join(str(rng.choice(vocabulary)) + str(rng.choice([" ", "-", "\n", "7", "_", "\x7f"])) for _ in range(size))
        source = f"s{int(rng.zipf(1.5)) % sources}"
        rows.append((k, text if k % 17 else None, ["en", None, "", "de"][int(rng.integers(0, 4))], source if k % 13 else None, "x", 1))
    # A long text, repeated rows, and a language without kept terms.
    return [*rows, (0, "lang " * 60000 + "é", "en", "s0", "x", 1), rows[1], rows[1], (1, "only once", "xx", "a", "x", 1), (2, "", "xx", "b", "x", 1)]


@pytest.mark.parametrize("rows,columns,front", [(32, 4096, 1 << 17), (4, 16, 50), (1, 1, 1 << 17)])
def test_audit(spark, monkeypatch, rows, columns, front):
    """Tiles of any size; nulls, empty and long texts, ties, repeated rows and clashing names."""
    monkeypatch.setattr(divergence, "ROWS", rows)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    monkeypatch.setattr(divergence, "FRONT", front)
    docs = made(rows, 260, 11, 60) if rows > 1 else made(1, 80, 4, 12)
    got = divergence.audit(spark.createDataFrame(docs, SCHEMA).repartition(3), min_docs=3, top=5).collect()
    assert sorted(map(tuple, got)) == plain(docs, 3, 5)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)
    assert divergence.audit(one).collect() == []


def test_share_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 7 * 10**13 + 1, 9 * 10**13 + 7
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // total


@pytest.mark.parametrize("split", [None, 3, 5])
def test_walk(split, monkeypatch):
    monkeypatch.setattr(divergence, "FRONT", 20)
    rng = np.random.default_rng(split or 0)
    matrix = rng.integers(1, 10**9, (7, 21)) * (rng.random((7, 21)) < 0.2)
    matrix[4] = 0
    unseen = rng.integers(1, 1000, 7)
    row, column = np.nonzero(matrix)
    a, b, total, cells = divergence.tile_sums(row, column, matrix[row, column], unseen, split)
    want = {}
    for i in range(7):
        for j in range(7):
            if (i < j) if split is None else (i < split <= j):
                both = [(int(x or unseen[i]), int(y or unseen[j])) for x, y in zip(matrix[i], matrix[j]) if x or y]
                if both:
                    want[i, j] = (sum((x - y) ** 2 // (x + y) for x, y in both), len(both))
    assert {(i, j): (s, n) for i, j, s, n in zip(a.tolist(), b.tolist(), total.tolist(), cells.tolist())} == want
