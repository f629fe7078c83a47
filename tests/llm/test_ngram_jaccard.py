"""Components against all pairs, compared one by one."""

import re

import numpy as np
import pytest

from gridlens.llm import ngram_jaccard
from gridlens.llm.ngram_jaccard import jaccard_components


def plain(rows, size, percent):
    sets = []
    for _, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set()))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: (len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)}


def corpus(seed, n=160):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(400)] + ["the", "The", "é"])
    shared = rng.choice(vocabulary, 40).tolist()
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One"), (1005, "one two"), (1006, "one two"), (1007, "two one")]
    bases = [rng.choice(vocabulary, rng.integers(5, 300)).tolist() for _ in range(n // 8)]
    for i in range(n):
        words = list(bases[i % len(bases)])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = str(rng.choice(vocabulary))
        if i % 5 == 0:
            words += shared
        if i % 7 == 0:
            words = words[: rng.integers(1, len(words) + 1)]
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    return [(int(k), t) for k, t in rows]


@pytest.mark.parametrize("size,percent,block,tenths", [(3, 90, 400_000, 20), (3, 90, 900, 20), (5, 80, 400_000, 15), (3, 80, 900, 10)])
def test_components(spark, size, percent, block, tenths, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SHINGLES", block)
    rows = corpus(size + percent)
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, n int, class string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, size=size, percent=percent, tenths=tenths).collect()}
    want = plain(rows, size, percent)
    assert len({v for _, v in want.values()}) < len(rows) - 20
    assert got == want


def test_odd_rows(spark):
    text = " ".join(f"v{i}" for i in range(50))
    rows = [(5, text), (5, text), (None, text), (3, text), (None, "all alone here"), (9, None), (9, "")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted(
        [(5, 48, 3), (5, 48, 3), (-1, 48, 3), (3, 48, 3), (-1, 1, -1), (9, 0, 9), (9, 0, 9)]
    )
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_word_nearby(spark):
    """A word over 64 bytes changes no other word of its chunk, so copies in other chunks still meet."""
    import pyarrow as pa

    text = " ".join(f"v{i}" for i in range(200))
    near = text + " " + "x" * 150
    alone, = ngram_jaccard.shingle_sets(pa.array([text]), 3)
    beside, other = ngram_jaccard.shingle_sets(pa.array([text, near]), 3)
    assert alone.tolist() == beside.tolist() and len(np.intersect1d(beside, other)) == 198
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = spark.createDataFrame([(1, text), (2, near), (3, "all alone here")], "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(rows, size=3, percent=90).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {1: (198, 1), 2: (199, 1), 3: (1, 3)}
