"""Divergence between the sources of a language, over the terms that the language keeps.

The counts form a matrix of groups (language and source) by terms, mostly zeros. It is cut into tiles of
``ROWS`` groups by about ``COLUMNS`` terms; in a task a tile is a K²-tree with K = 2: level by level the four
quadrants of every quadrant that holds a count. Two groups are compared by walking their halves of the tree
jointly: a quadrant that is all zero for both is left at once, where either has a count both are halved
further, down to single cells. Terms that the walk never reaches are zero for both groups and all cost
the same, so they are priced by one multiplication, whatever their number.

Texts are split and counted inside tasks, first by chunk, and Spark adds up the rows of each group and term,
so frequent terms and large sources are pre-aggregated before any shuffle. Tiles have bounded sides; the walk
holds ``FRONT`` pairs of quadrants at once. A language with more than ``ROWS`` sources is compared by pairs
of row blocks, each of which a tile holds; the result itself has a row per pair of sources.

Shares and divergences are whole numbers in exact arithmetic. Null texts, languages and sources are empty
strings, with their groups and terms; a group without kept terms has only the smoothing; a language that
keeps no term has divergence 0 everywhere. Texts of any length are counted whole, one chunk at a time;
repeated rows count each. Equal values rank by the item's bytes. An empty table has no rows; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.registry import query, table
from gridlens.llm.text import LOWER, string_chunks, word_hashes, word_spans
from gridlens.session import scratch, ship_package, stage

MIN_DOCS = 10
SCALE = 1_000_000_000
SMOOTHING = 2
TOP = 10
# Sides of a tile.
ROWS = 32
COLUMNS = 4096
# Pairs of quadrants that a walk holds at once.
FRONT = 1 << 17

# Bytes of a term once A-Z are lower-cased.
TERM = np.zeros(256, dtype=bool)
TERM[0x61:0x7B] = TERM[0x80:] = True


def _chunk_counts(names: list, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """``lang, source, term, n, docs`` of one chunk; a row without term counts a group's documents."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, TERM)
    groups = {g: k for k, g in enumerate(dict.fromkeys(names))}
    group = np.array([groups[g] for g in names], np.int64)
    _, one, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(names)), np.diff(first))
    width = max(1, len(one))
    # A document's words once each: their number per group is the document frequency.
    pairs, n = np.unique(doc * width + word, return_counts=True)
    cell, back = np.unique(group[pairs // width] * width + pairs % width, return_inverse=True)
    counts, docs = np.zeros(len(cell), np.int64), np.bincount(back, minlength=len(cell))
    np.add.at(counts, back, n)
    which = one[cell % width]
    size = ends[which] - starts[which]
    letters = data[np.repeat(starts[which] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())]
    terms = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cell), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(letters)]
    ).cast(pa.large_string()).cast(pa.string())
    keys, owner = list(groups), np.append(cell // width, np.arange(len(groups)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()).take(pa.array(owner)), pa.array([k[1] for k in keys], pa.string()).take(pa.array(owner)),
            pa.concat_arrays([terms, pa.nulls(len(groups), pa.string())]), pa.array(np.append(counts, np.bincount(group))),
            pa.array(np.append(docs, np.bincount(group))),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs`` of every group and term, and a row without term for every group."""
    ship_package(df.sparkSession)
    names = {"lang": lang, "source": source}
    rows = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in names.items()), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for low, high, data, offsets in string_chunks(batch.column(2)):
                yield _chunk_counts(names[low:high], data, offsets)

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """The smoothed share of ``count`` as a whole number of billionths, plus one."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    return F.call_function("div", top, total.cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Quadrants:
    """A K²-tree over the cells of a tile: ``children[l][4 * node + quadrant]`` is a node of level l + 1 or -1.

    A quadrant is its row half times two plus its column half; nodes of the last level are the cells.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, depth: int):
        code = np.zeros(len(rows), np.int64)
        for bit in range(depth):
            code |= ((rows >> bit & 1) << 2 * bit + 1) | ((columns >> bit & 1) << 2 * bit)
        self.order = np.argsort(code)
        code, self.depth, self.children = code[self.order], depth, []
        parents = np.zeros(1, np.int64)
        for level in range(1, depth + 1):
            nodes = np.unique(code >> 2 * (depth - level))
            child = np.full(4 * len(parents), -1, np.int64)
            child[4 * np.searchsorted(parents, nodes >> 2) + (nodes & 3)] = np.arange(len(nodes))
            self.children.append(child)
            parents = nodes

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        return np.where(node < 0, -1, self.children[level][4 * np.maximum(node, 0) + quadrant])


def walk(tree: Quadrants, rows: int, split: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row a, row b, cell of a, cell of b)`` of every column that isn't zero for both rows of a pair; -1 is a zero cell.

    Pairs are a < b, or with ``split`` a below it and b from it on.
    """
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, zero, zero)]
    while stack:
        level, a, b, m, n = stack.pop()
        if len(a) > FRONT:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half], m[:half], n[:half]), (level, a[half:], b[half:], m[half:], n[half:])]
            continue
        if level == tree.depth:
            yield a, b, m, n
            continue
        left = tree.depth - level - 1
        parts = []
        for x, y, w in np.ndindex(2, 2, 2):
            p, q = 2 * a + x, 2 * b + y
            i, j = tree.child(level, m, 2 * x + w), tree.child(level, n, 2 * y + w)
            # Quadrants that are zero for both are left here.
            keep = ((i >= 0) | (j >= 0)) & (q << left < rows) & (p << left < rows)
            if split is None:
                keep &= (p <= q) if left else (p < q)
            else:
                keep &= (p << left < split) & (((q + 1) << left) > split)
            parts.append((p[keep], q[keep], i[keep], j[keep]))
        front = tuple(np.concatenate(c) for c in zip(*parts))
        if len(front[0]):
            stack.append((level + 1, *front))


def tile_sums(row: np.ndarray, column: np.ndarray, share: np.ndarray, unseen: np.ndarray, split: int | None):
    """``(a, b, sum, cells)``: divergence of two rows of a tile over the columns where either has a count, and their number.

    ``row, column, share`` are the cells with a count, ``unseen`` each row's share of a term without one.
    """
    rows, depth = len(unseen), 1
    while 1 << depth < max(rows, int(column.max(initial=0)) + 1):
        depth += 1
    tree = Quadrants(row, column, depth)
    share = np.append(share[tree.order], 0)
    total, cells = np.zeros(rows * rows, np.int64), np.zeros(rows * rows, np.int64)
    for a, b, m, n in walk(tree, rows, split):
        p, q = np.where(m < 0, unseen[a], share[m]), np.where(n < 0, unseen[b], share[n])
        pair = a * rows + b
        np.add.at(total, pair, (p - q) * (p - q) // (p + q))
        cells += np.bincount(pair, minlength=rows * rows)
    some = np.flatnonzero(cells)
    return some // rows, some % rows, total[some], cells[some]


def _tile(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of the pairs of the tile ``lang, low, high, block``; ``groups`` are its rows, of one row block or of two."""
    groups = groups.sort_by([("band", "ascending"), ("source", "ascending")])
    names, band = groups.column("source").to_pylist(), groups.column("band").to_numpy()
    index = {s: k for k, s in enumerate(names)}
    row = np.array([index[s] for s in cells.column("source").to_pylist()], np.int64)
    _, term = np.unique(np.array(cells.column("term").to_pylist(), object), return_inverse=True)
    # Terms of many groups first, so that zeros lie together.
    order = np.argsort(-np.bincount(term), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    low, high = key[1].as_py(), key[2].as_py()
    split = None if low == high else int((band == low).sum())
    a, b, total, n = tile_sums(row, place[term], cells.column("p").to_numpy(), groups.column("unseen").to_numpy(), split)
    return pa.table({
        "lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array([names[k] for k in a], pa.string()),
        "b": pa.array([names[k] for k in b], pa.string()), "value": total, "cells": n,
    })


def _pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of all ordered pairs of a language's sources."""
    other = F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("other")
    sides = [F.least("band", "other").alias("low"), F.greatest("band", "other").alias("high")]
    tiles = groups.select("lang", "source", "unseen", "band", "blocks", other).where("blocks > 0").select(
        "lang", "source", "unseen", "band", *sides, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    placed = cells.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).select("lang", "source", "term", "p", "band", "block", other)
    placed = placed.select("lang", "source", "term", "p", "block", *sides)
    keys = ["lang", "low", "high", "block"]
    sums = placed.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(
        _tile, "lang string, a string, b string, value long, cells long"
    ).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("cells").alias("cells"))
    sums = stage(sums, "divergence-sums")
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value", "cells").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value", "cells")
    )
    right = groups.select("lang", F.col("source").alias("item"), F.col("unseen").alias("unseen_q"))
    pairs = groups.select("lang", "source", "unseen", "terms").join(right, "lang").where("source <> item")
    rest = F.col("terms") - F.coalesce("cells", F.lit(0))
    return pairs.join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest * divergence(F.col("unseen"), F.col("unseen_q"))).alias("value")
    )


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: all other sources by divergence, and the ``top`` terms of each source."""
    with scratch(df.sparkSession):
        counts = stage(term_counts(df, lang, source, text), "divergence-counts")
        terms = counts.where("term is not null")
        kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        kept = stage(kept.drop("docs"), "divergence-terms")
        cells = stage(terms.drop("docs").join(kept, ["lang", "term"]), "divergence-cells")
        sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
        own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        named = counts.where("term is null").select("lang", "source")
        sources = named.groupBy("lang").agg(F.count("*").alias("sources"))
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("terms", "lang_total", "total")}
        groups = named.join(sources, "lang").join(sizes, "lang", "left").join(own, ["lang", "source"], "left").withColumns(zero)
        bottom = F.col("total") + SMOOTHING * F.col("terms")
        groups = groups.select(
            "lang", "source", "terms", bottom.alias("bottom"), (F.col("lang_total") + SMOOTHING * F.col("terms")).alias("lang_bottom"),
            F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), bottom)).otherwise(1).alias("unseen"),
            F.ceil(F.col("terms") / COLUMNS).cast("int").alias("blocks"), F.ceil(F.col("sources") / ROWS).cast("int").alias("bands"),
        ).withColumn("band", F.pmod(F.xxhash64("source"), F.col("bands")).cast("int"))
        groups = stage(groups, "divergence-groups")
        priced = cells.join(groups, ["lang", "source"]).withColumns({
            "p": share(F.col("n"), F.col("bottom")), "q": share(F.col("all"), F.col("lang_bottom")),
        })
        pairs = _pair_values(priced, groups).withColumn("part", F.lit("pair"))
        marks = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = [pairs.withColumn("rank", F.row_number().over(order)), marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)]
        return stage(ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank"), "divergence", outer=True)


OP13_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
t AS (SELECT lang, source, id, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, coalesce(max(v), 0) AS v, coalesce(max(n), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN
    (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang) USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
    SELECT lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * l.v)::HUGEINT) AS p,
        1 + (1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v)::HUGEINT) AS q
    FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


@query("op13_divergence", OP13_SQL)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all documents' sources, by language."""
    return audit(table(spark, sf_dir, "documents"))
