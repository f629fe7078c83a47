"""Manifest, proofs and folding against a plain tree."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import merkle, ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, pos int, g string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, extra=0):
    k, text, lang, source, n = row[:5]
    values = [k, source, lang, n if n is None else n + extra, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        levels.append(nodes)
    return levels


def climb(levels, at, value, fanout):
    siblings = []
    for nodes in levels[:-1]:
        low = at - at % fanout
        run = nodes[low : low + fanout]
        siblings += run[: at - low] + run[at - low + 1 :]
        value = h(*run[: at - low], value, *run[at - low + 1 :])
        at //= fanout
    return value, siblings


def plain(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], fanout)
    top = tree([trees[g][-1][0] for g in names], fanout)
    out = []
    for at_top, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            sub, own = climb(trees[g], at, leaf(r, int(hit)), fanout)
            folded, above = climb(top, at_top, sub, fanout)
            out.append((str(r[0]), leaf(r), trees[g][-1][0], top[-1][0], h(*own, *above), folded, folded == top[-1][0]))
    return sorted(out)


def manifest(df, fanout):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    changed = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    out = merkle.manifest(df, "doc_id", "lang", merkle.FIELDS, changed, fanout)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r.doc_id), *r[1:]) for r in out.collect())


def made(n, langs):
    rng = np.random.default_rng(n)
    rows = [
        (int(k), [None, "", "é" * int(rng.integers(1, 50)), "x:1" * 20000][int(rng.integers(0, 40)) // 13],
         langs[min(len(langs) - 1, int(rng.zipf(1.6)) - 1)], [None, "", "s"][k % 3], None if k % 5 == 0 else int(rng.integers(0, 99)), "h", 1, "g")
        for k in rng.permutation(n)
    ]
    # Null keys, repeated keys and repeated rows.
    return [*rows, *rows[:2], (None, "a", langs[0], None, None, "h", 1, "g"), (None, None, langs[0], None, 1, "h", 1, "g"), (1, "other", langs[0], "s", 1, "h", 1, "g")]


@pytest.mark.parametrize("n,fanout,block,part", [(300, 2, 4096, 200_000), (150, 2, 4, 40), (70, 3, 9, 25), (1, 2, 4096, 200_000), (40, 5, 4, 10)])
def test_manifest(spark, monkeypatch, n, fanout, block, part):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(ranks, "PART_ROWS", part)
    rows = made(n, [None, "", "en", "é", "z", "日", "a b"])
    assert manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout) == plain(rows, fanout)


def test_one_row_and_empty(spark):
    one = [(3, "t", "en", None, 1, "h", 1, "g")]
    assert manifest(spark.createDataFrame(one, SCHEMA), 2) == plain(one, 2)
    assert manifest(spark.createDataFrame([], SCHEMA), 2) == []


def test_states_are_resumed():
    """Folding reads no sibling to the left of the slot."""
    nodes = [h(str(k)).encode() for k in range(11)]
    built = merkle.Subtree(list(nodes), 4, None)
    want = [climb(tree([n.decode() for n in nodes], 4), at, "x" * 64, 4)[0] for at in range(11)]
    for level in built.levels:
        level[::4] = [b"gone"] * len(level[::4])
    assert built.fold(7, b"x" * 64).decode() == want[7] and built.fold(3, b"x" * 64).decode() == want[3]
