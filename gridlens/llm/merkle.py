"""Merkle manifest of a table: per group a hash tree over its rows, and a tree over the groups.

A node is the SHA-256 of its children's digests in hexadecimal, one after the other. Building a node, the
hash state is copied before each child's slot and kept; to fold a changed child up, the matching copy is
resumed with the replacement and the siblings to its right only, never with those to its left.

Trees are cut into blocks of ``BLOCK`` children or fewer, the power of the fan-out next to it. A block is
built by one task with all its states in memory; the blocks' roots are the leaves of the next, much
smaller table, up to a single node per group. Downwards each block hands its roots' paths (what is left and
right of them, level by level) to the blocks below, so no task sees a whole group or a whole tree. A group
with all rows is as good as many small ones. Places in a group come from range partitions and their counts.

Null fields are ``-``, other values their byte count, ``:`` and themselves, so texts of any length and empty
ones differ from null. Null keys come first in their group, repeated keys by their leaf, equal rows have a
leaf each. A null group is a group of its own, the first. An empty table has no tree. Other columns don't
matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.ranks import numbered
from gridlens.llm.registry import query, table
from gridlens.session import scratch, ship_package, stage

FANOUT = 2
# Children of a block's lowest level.
BLOCK = 4096
PATH = "array<struct<left:string,right:string>>"
NODE = "g string, pos long, hash string"


def leaf_hash(values: list[Column]) -> Column:
    """The hash of a row's values in the given order."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    )), 256)


class Subtree:
    """The nodes above a run of digests, each parent with a copy of its hash state before every child's slot."""

    def __init__(self, nodes: list[bytes], fanout: int, height: int | None):
        self.fanout, self.levels, self.before = fanout, [nodes], []
        while len(self.before) < height if height is not None else len(nodes) > 1:
            states, parents = [], []
            for low in range(0, len(nodes), fanout):
                state = hashlib.sha256()
                for child in nodes[low : low + fanout]:
                    states.append(state.copy())
                    state.update(child)
                parents.append(state.hexdigest().encode())
            self.before.append(states)
            self.levels.append(nodes := parents)

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[bytes, bytes]]:
        """Siblings to the left and to the right of a child and of the nodes above it."""
        steps = []
        for nodes in self.levels[:-1]:
            low = at - at % self.fanout
            steps.append((b"".join(nodes[low:at]), b"".join(nodes[at + 1 : low + self.fanout])))
            at //= self.fanout
        return steps

    def fold(self, at: int, replacement: bytes) -> bytes:
        """The root with another digest in a child's place."""
        for nodes, states in zip(self.levels, self.before):
            state = states[at].copy()
            state.update(replacement)
            for sibling in nodes[at + 1 : at - at % self.fanout + self.fanout]:
                state.update(sibling)
            replacement, at = state.hexdigest().encode(), at // self.fanout
        return replacement


class Above:
    """The path above a block: each parent's state before the block's slot, and what follows the slot."""

    def __init__(self, path: list[dict]):
        self.siblings = b"".join((s["left"] + s["right"]).encode() for s in path)
        self.slots = [(hashlib.sha256(s["left"].encode()), s["right"].encode()) for s in path]

    def fold(self, replacement: bytes) -> bytes:
        for before, right in self.slots:
            state = before.copy()
            state.update(replacement)
            state.update(right)
            replacement = state.hexdigest().encode()
        return replacement


def _height(fanout: int) -> int:
    height = 1
    while fanout ** (height + 1) <= BLOCK:
        height += 1
    return height


def _blocked(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with their ``block`` and whether it is the group's only one."""
    size = fanout ** _height(fanout)
    return nodes.withColumn("block", F.expr(f"pos div {size}")).withColumn("only", F.col("size") <= size)


def _subtree(rows: pa.Table, fanout: int, height: int) -> Subtree:
    """The tree of one block, whose rows are sorted by place."""
    nodes = [h.encode() for h in rows.column("hash").to_pylist()]
    return Subtree(nodes, fanout, None if rows.column("only")[0].as_py() else height)


def _roots(blocks: DataFrame, fanout: int) -> DataFrame:
    """The next level: ``g, pos, hash, size`` of the blocks' roots."""

    height = _height(fanout)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        root = _subtree(rows.sort_by("pos"), fanout, height).root.decode()
        return pa.table({"g": [key[0].as_py()], "pos": [key[1].as_py()], "hash": [root], "size": rows.column("size")[:1]})

    size = fanout**height
    made = blocks.select("g", "block", "pos", "hash", "only", "size").groupBy("g", "block").applyInArrow(run, f"{NODE}, size long")
    return made.withColumn("size", F.expr(f"(size + {size - 1}) div {size}"))


def _levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocked nodes of each level from the leaves on, and a root per group."""
    levels = []
    while True:
        levels.append(_blocked(nodes, fanout))
        nodes = stage(_roots(levels[-1], fanout), "merkle-nodes")
        if not nodes.where("size > 1").limit(1).count():
            return levels, nodes.select("g", F.col("hash").alias("root"))


def _paths(blocks: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """``g, pos, path`` of every node of a level from ``g, block, path`` of its blocks."""

    height = _height(fanout)

    def run(rows: pa.Table, paths: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        tree, upper = _subtree(rows, fanout, height), paths.column("path")[0].as_py()
        steps = [[{"left": a.decode(), "right": b.decode()} for a, b in tree.path(i)] + upper for i in range(len(rows))]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"g": rows.column("g"), "pos": rows.column("pos"), "path": pa.array(steps, kind)})

    thin = blocks.select("g", "block", "pos", "hash", "only")
    return stage(
        thin.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(run, f"g string, pos long, path {PATH}"), "merkle-paths"
    )


def _down(levels: list[DataFrame], paths: DataFrame, fanout: int) -> DataFrame:
    """``g, block, path`` of the lowest blocks; ``paths``: ``g, path`` of the groups' roots."""
    above = paths.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(levels[1:]):
        # A group that is done on a lower level is a single node here, whose path stays as it is.
        above = _paths(blocks, above, fanout).withColumnRenamed("pos", "block")
    return above


def manifest(
    df: DataFrame, key: str, group: str, fields: list[str], changed: dict[str, Column] | None = None, fanout: int = FANOUT
) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A leaf hashes ``fields``. ``changed`` has other values for some of them; where the leaf is another with
    those, it is folded up in place of the stored one.
    """
    ship_package(df.sparkSession)
    names, height = {f: F.col(f"`{f}`") for f in fields}, _height(fanout)
    with scratch(df.sparkSession):
        other = leaf_hash([(changed or {}).get(f, c) for f, c in names.items()])
        leaf = leaf_hash(list(names.values()))
        rows = df.select(
            F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g"), F.col(f"`{key}`").alias("key"),
            leaf.alias("hash"), F.when(other != leaf, other).alias("other") if changed else F.lit(None).cast("string").alias("other"),
        ).withColumn("_row", F.monotonically_increasing_id())
        leaves = stage(numbered(stage(rows, "merkle-leaves"), "g", ["key", "hash", "_row"], "merkle").drop("_row"), "merkle-numbered")
        levels, subroots = _levels(leaves, fanout)
        ordered = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("hash"))
        tops = stage(numbered(ordered, "g", ["name"], "merkle-tops"), "merkle-groups")
        upper, root = _levels(tops, fanout)
        none = root.select("g", F.array().cast(PATH).alias("path"))
        top_paths = _paths(_blocked(tops, fanout), _down(upper, none, fanout), fanout)
        by_name = tops.join(top_paths, ["g", "pos"]).select(F.col("name").alias("g"), "path")
        above = _down(levels, by_name, fanout)
        ends = tops.join(root, "g").select(F.col("name").alias("g"), F.col("hash").alias("subroot"), "root")
        above = above.join(ends, "g")

        def run(rows: pa.Table, paths: pa.Table) -> pa.Table:
            rows = rows.sort_by("pos")
            tree, upper = _subtree(rows, fanout, height), Above(paths.column("path")[0].as_py())
            root, proofs, folded = paths.column("root")[0].as_py(), [], []
            for i, replacement in enumerate(rows.column("other").to_pylist()):
                proofs.append(hashlib.sha256(b"".join([a + b for a, b in tree.path(i)]) + upper.siblings).hexdigest())
                folded.append(upper.fold(tree.fold(i, replacement.encode() if replacement else tree.levels[0][i])).decode())
            n = len(rows)
            return pa.table({
                "key": rows.column("key"), "leaf": rows.column("hash"), "subroot": [paths.column("subroot")[0].as_py()] * n, "root": [root] * n,
                "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
            })

        kind = df.schema[key].dataType.simpleString()
        result = levels[0].select("g", "block", "pos", "hash", "only", "key", "other").groupBy("g", "block").cogroup(
            above.groupBy("g", "block")
        ).applyInArrow(run, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        return stage(result.withColumnRenamed("key", key), "merkle", outer=True)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

OP12_SQL = """
WITH RECURSIVE step AS (
    SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
v AS (
    SELECT doc_id, lang, n_chars, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda p: ascii(substring(doc_id::VARCHAR, p, 1))::BIGINT) AS digits,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM documents),
w AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, digits), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 7 = 0 AS hit
    FROM v, crc),
d AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || tail) AS other,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM w),
low AS (
    SELECT lang, 0 AS level, pos, leaf AS h, n FROM d
    UNION ALL
    SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM low WHERE n > 1 GROUP BY lang, level, pos // 2, n),
top AS (
    SELECT lang, 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n FROM low WHERE n = 1
    UNION ALL
    SELECT NULL, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
    SELECT d.doc_id, a.level, d.pos >> a.level AS place, b.h
    FROM d JOIN low a ON a.lang IS NOT DISTINCT FROM d.lang AND a.pos = d.pos >> a.level AND a.n > 1
    LEFT JOIN low b ON b.lang IS NOT DISTINCT FROM d.lang AND b.level = a.level AND b.pos = xor(a.pos, 1)
    UNION ALL
    SELECT d.doc_id, 1000 + a.level, g.pos >> a.level, b.h
    FROM d JOIN top g ON g.level = 0 AND g.lang IS NOT DISTINCT FROM d.lang
    JOIN top a ON a.pos = g.pos >> a.level AND a.n > 1 LEFT JOIN top b ON b.level = a.level AND b.pos = xor(a.pos, 1)),
paths AS (
    SELECT doc_id, string_agg(h, '' ORDER BY level) AS siblings, list(CASE WHEN place % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(h, '') ORDER BY level) AS way
    FROM steps GROUP BY doc_id),
f AS (
    SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
        list_reduce(list_prepend(other, coalesce(way, []::VARCHAR[])), lambda a, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
    FROM d JOIN low s ON s.lang IS NOT DISTINCT FROM d.lang AND s.n = 1 JOIN top r ON r.n = 1 LEFT JOIN paths USING (doc_id))
SELECT *, folded_root = root AS verified FROM f
"""


@query("op12_merkle", OP12_SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; a seventh of them folded up with another ``n_chars``."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    changed = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", FIELDS, changed)
