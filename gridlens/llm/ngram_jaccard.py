"""N-gram Jaccard join by grouped prefixes.

Documents with equal shingle sets are one class. Of each class the smallest shingle hashes (by default
twice as many as a prefix needs) are indexed. A partner must share those beyond one prefix, so shingles are put in
order of their frequency and each class keeps the rarest part: its prefix. Classes with equal prefix and
size form a group. Groups meet in a prefix shingle and only with groups whose size fits theirs (equal or
neighbouring size bands, of which a fitting pair is never further apart); connected candidates are
expanded to their members and verified on whole shingle sets, in pairs of bounded blocks, where only
pairs of fitting sizes and prefixes are compared and a found component is not compared again. Links
that join different components are all found; pairs inside one are not written out.

A null or empty text has an empty set and no links. Repeated rows are copies of each other, and so are rows of one
key with different texts only where their sets are equal or linked: what is linked are sets, not keys. Rows with a
null key are classed and linked like others, and get the component of the smallest key in it (null
if none has one). Keys are whole numbers; a text of any length is one row of one task. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.components import connected_components
from gridlens.llm.registry import query, table
from gridlens.llm.scratch import forget_shuffles
from gridlens.llm.text import LOWER, SPACED, mix, string_chunks, window_hashes, word_hashes, word_spans
from gridlens.session import scratch, ship_package, stage

# Shingles of one block in verification; a task holds two blocks.
BLOCK_SHINGLES = 400_000
# Indexed shingles per class, in tenths of a prefix.
INDEXED = 20


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order."""
    for _, _, data, offsets in string_chunks(column):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, SPACED)
        words = word_hashes(data, starts, ends)
        windows = window_hashes(words, size)
        for low, high in zip(first[:-1], first[1:]):
            if high - low >= size:
                yield np.unique(windows[low : high - size + 1])
            elif high > low:
                whole = words[low:high]
                yield mix(window_hashes(whole, len(whole)) + np.uint64(len(whole)))
            else:
                yield np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of a shingle set."""
    total = mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))], np.uint64))
    return int(total.view(np.int64)[0])


def _fits(shared, a, b, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def _need(n: Column, percent: int) -> Column:
    """The least number of common shingles of a set of ``n`` with any partner."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _prefix(n: Column, percent: int) -> Column:
    return n - _need(n, percent) + 1


def _indexed(n: Column, percent: int, tenths: int) -> Column:
    return F.least(n, F.floor(tenths * _prefix(n, percent) / 10).cast("int"))


def _kept(n: Column, percent: int, tenths: int) -> Column:
    """Rarest of the indexed shingles, among which partners must meet."""
    least = _need(n, percent)
    common = _indexed(least, percent, tenths) - _prefix(least, percent) + 1
    return _indexed(n, percent, tenths) - common + 1


def identity(df: DataFrame, key: str, text: str) -> list[Column]:
    """Key and hash of key and text: what tells rows apart, but for repeated ones."""
    k, t = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")
    return [k.alias("id"), F.xxhash64(k, t).alias("h")]


def _describe(df: DataFrame, key: str, text: str, size: int, percent: int, tenths: int) -> DataFrame:
    source = df.select(*identity(df, key, text), F.col(f"`{text}`").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, least = [], [], []
            for shingles in shingle_sets(batch.column(2), size):
                n = len(shingles)
                need = -(-n * percent // 100)
                sizes.append(n)
                classes.append(class_of(shingles))
                least.append(shingles[: min(n, tenths * (n - need + 1) // 10)].view(np.int64))
            ends = np.cumsum([0, *map(len, least)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *least])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "h", "n", "class", "least"],
            )

    return source.mapInArrow(run, _schema("id long, h long, n int, class long, least array<long>"))


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


def _groups(reps: DataFrame, classes: DataFrame, percent: int, tenths: int) -> DataFrame:
    """``id, h, n, class, group, tokens``: prefixes of the classes that may have partners."""
    n = F.col("n")
    entries = reps.select("class", F.explode("least").alias("token"))
    often = entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = entries.join(often, "token").groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s")
    ).join(classes, "class")
    # Shingles of one class only come first in the order and meet nobody.
    left = _kept(n, percent, tenths) - (_indexed(n, percent, tenths) - F.size("s"))
    prefixes = shared.where(left > 0).select(
        "id", "h", "n", "class", F.transform(F.slice("s", 1, left), lambda x: x["token"]).alias("tokens")
    )
    prefixes = stage(prefixes, "jaccard-prefixes").withColumn("same", F.xxhash64("tokens"))
    heads = prefixes.groupBy("n", "same").agg(F.min("class").alias("group"))
    return stage(prefixes.join(heads, ["n", "same"]).drop("same"), "jaccard-groups")


def _candidates(groups: DataFrame, percent: int) -> DataFrame:
    """``id, h, class, n, part``: classes with possible partners; partners lie in one part.

    Sizes in a ratio that fits lie in one size band or in neighbouring ones. A group meets others in its band's
    slot and in the next, so pairs whose sizes don't fit meet only where sizes between them do.
    """
    # A little wider than the ratio, so that rounding separates no pair.
    band = F.floor(F.log("n") / F.lit(1.0001 * np.log(100 / percent))) if percent < 100 else F.col("n")
    tokens = groups.where("class = group").select("group", band.cast("int").alias("band"), F.explode("tokens").alias("token"))
    slots = tokens.select("group", "token", F.explode(F.array("band", F.col("band") + 1)).alias("slot"))
    first = slots.groupBy("token", "slot").agg(F.min("group").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    meets = slots.join(first, ["token", "slot"]).where("group <> first").select("group", "first").distinct()
    parts = connected_components(meets, "group", "first", "jaccard-parts")
    return groups.join(parts, groups["group"] == parts["node"], "left").select(
        "id", "h", "class", "n", F.coalesce("component", "group").alias("part")
    )


def _verifier(size: int, percent: int):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of classes in one pair of blocks: each component's members, by its first member."""
        sets, reps, column = [], [], pa.array(rows["body"], pa.string())
        seen = set()
        for want, shingles in zip(rows["class"], shingle_sets(column, size)):
            if want not in seen and class_of(shingles) == want:
                seen.add(want)
                reps.append(want)
                sets.append(shingles)
        if len(sets) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        order = np.argsort([len(s) for s in sets], kind="stable")
        reps, sets = np.array(reps)[order], [sets[i] for i in order]
        sizes = np.array([len(s) for s in sets])
        _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        flat, ends = rank[which], np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat = flat[np.lexsort((flat, owner))]
        prefix = sizes - (-(-sizes * percent // 100)) + 1
        inside = np.arange(len(flat)) - np.repeat(begins, sizes) < np.repeat(prefix, sizes)
        tokens, holders = flat[inside], owner[inside]
        by_token = np.argsort(tokens, kind="stable")
        tokens, holders = tokens[by_token], holders[by_token]
        open_ = np.ones(len(sets), bool)
        mark = np.zeros(len(counts), bool)
        links = []
        for root in range(len(sets)):
            if not open_[root]:
                continue
            open_[root] = False
            todo = [root]
            while todo:
                one = todo.pop()
                mine = flat[begins[one] : ends[one]]
                low = np.searchsorted(tokens, mine[: prefix[one]], "left")
                high = np.searchsorted(tokens, mine[: prefix[one]], "right")
                near = np.zeros(len(sets), bool)
                for x, y in zip(low, high):
                    near[holders[x:y]] = True
                near &= open_ & (100 * np.minimum(sizes, sizes[one]) >= percent * np.maximum(sizes, sizes[one]))
                near = np.flatnonzero(near)
                if not len(near):
                    continue
                mark[mine] = True
                lengths = sizes[near]
                starts = np.cumsum(lengths) - lengths
                every = flat[np.repeat(begins[near] - starts, lengths) + np.arange(lengths.sum())]
                shared = np.add.reduceat(mark[every].astype(np.int64), starts)
                mark[mine] = False
                found = near[_fits(shared, lengths, sizes[one], percent)]
                open_[found] = False
                todo.extend(found.tolist())
                links += [(reps[root], reps[f]) for f in found]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return verify


def _tasks(described: DataFrame, classes: DataFrame, percent: int, tenths: int) -> DataFrame:
    """``id, h, class, part, i, j``: which classes are compared in which pair of blocks of a part, and where their text is."""
    reps = described.join(
        classes.select(F.col("first.h").alias("h"), F.col("class").alias("c"), F.col("n").alias("m")), "h"
    ).where("class = c and n = m").select("id", "h", "class", "least").dropDuplicates(["class"])
    sizes = classes.select("class", "n", F.col("first.id").alias("id"), F.col("first.h").alias("h"))
    placed = stage(_candidates(_groups(reps, sizes, percent, tenths), percent), "jaccard-placed")
    blocks = placed.groupBy("part").agg(
        F.count("*").alias("k"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")
    ).where("k > 1")
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    spread = placed.join(blocks, "part").withColumn("mine", mine).select(
        "id", "h", "class", "part", "mine",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "blocks",
    )
    return spread.where("blocks = 1 or other <> mine").select(
        "id", "h", "class", "part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    )


def _labelled(df: DataFrame, key: str, text: str, size: int, percent: int, tenths: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``id, h, n, class``, and per class its first row, its group of linked classes and that group's first key and row."""
    described = stage(_describe(df, key, text, size, percent, tenths), "jaccard-sets")
    rows = stage(described.select("id", "h", "n", "class"), "jaccard-rows")
    # Rows with a key come first; equal rows are the same first row.
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    classes = stage(rows.where("n > 0").groupBy("class", "n").agg(F.min(order).alias("first")), "jaccard-classes")
    wanted = stage(_tasks(described, classes, percent, tenths), "jaccard-tasks")
    forget_shuffles(df.sparkSession)
    bodies = df.select(identity(df, key, text)[1], F.col(f"`{text}`").alias("body"))
    repeated = stage(rows.where("n > 0").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "jaccard-repeated")
    if not repeated.isEmpty():
        # Repeated rows are fetched once.
        once = bodies.join(repeated, "h", "left_semi").dropDuplicates(["h"])
        bodies = bodies.join(repeated, "h", "left_anti").unionByName(once)
    # A hash of key and text finds the row, null keys included; one plan at every size: texts and tasks meet by a shuffle.
    links = bodies.join(wanted.drop("id").hint("merge"), "h").groupBy("part", "i", "j").applyInPandas(
        _verifier(size, percent), _schema("a long, b long")
    )
    found = stage(connected_components(links, "a", "b", "jaccard-links"), "jaccard-components")
    grouped = classes.join(found, classes["class"] == found["node"], "left").select(
        "class", "n", "first", F.coalesce("component", "class").alias("group")
    )
    firsts = grouped.groupBy("group").agg(F.min("first").alias("least"))
    return rows, stage(grouped.join(firsts, "group"), "jaccard-labels")


def jaccard_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90,
    tenths: int = INDEXED,
) -> DataFrame:
    """``key, n_shingles, component_id, class_id`` of every row.

    ``component_id`` is the smallest key reachable by links of at least ``percent`` Jaccard similarity
    over ``size``-word shingles; ``class_id`` is the smallest key with the same shingle set. ``tenths``
    (of a prefix, 10 or more) are indexed: more tell shared passages apart better, fewer take less disk.
    """
    ship_package(df.sparkSession)
    with scratch(df.sparkSession):
        rows, labels = _labelled(df, key, text, size, percent, tenths)
        joined = rows.join(labels.select("class", "n", "first", "least"), ["class", "n"], "left").select(
            F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("least.id", "id").alias("component_id"), F.coalesce("first.id", "id").alias("class_id"),
        )
        result = stage(joined, "jaccard", outer=True)
    forget_shuffles(df.sparkSession)
    return result


def first_of_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, tenths: int = INDEXED
) -> DataFrame:
    """All columns of one row of each component: of the smallest key, of equal keys by a hash of the text.

    Rows with an empty set are in no component; of repeated rows one stays. Rows without a key go like
    others, and a row of theirs stays only where no key is in the component.
    """
    ship_package(df.sparkSession)
    with scratch(df.sparkSession):
        rows, labels = _labelled(df, key, text, size, percent, tenths)
        kept = labels.select("class", "n", F.col("least.h").alias("kept"))
        name = "_h"
        while name in df.columns:
            name += "_"
        gone = rows.join(kept, ["class", "n"]).where("h <> kept").select(F.col("h").alias(name)).distinct()
        gone = stage(gone, "jaccard-gone", outer=True)
    forget_shuffles(df.sparkSession)
    marked = df.withColumn(name, identity(df, key, text)[1])
    return marked.join(gone, name, "left_anti").dropDuplicates([name]).drop(name)


@query("op1_ngram_jaccard")
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with nearly equal sets of three-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))
