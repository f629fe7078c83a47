"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents inside a task. Its words become symbols (words that no benchmark
item has, and document ends, become separators), its suffixes are sorted by prefix doubling, and the
Burrows-Wheeler transform is kept in a wavelet matrix. Benchmark windows are searched backwards through
wavelet ranks, their occurrences located from sampled suffix positions, and overlapping occurrences
merged into spans. The benchmark is searched in blocks of bounded size, so only a block is broadcast.

Words are runs of digits, letters (A-Z lower-cased) and characters above 127. A window is ten
consecutive words of an item, or a shorter item as a whole; items without words have none. Null and
empty texts have no words and no hits; a longer text than a shard is a shard of its own. Every row gives one row; repeated item texts or identifiers
all count; null item identifiers are not reported but their windows are. Columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.registry import query, table
from gridlens.llm.text import ALNUM, LOWER, string_chunks, word_hashes, word_spans
from gridlens.session import ship_package, stage

WINDOW = 10
# Text bytes of one shard, and of the benchmark items searched at once.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
# Every so many positions a suffix position is kept.
SAMPLE = 8


class Windows:
    """Search windows of some benchmark items as symbol rows."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        found: dict[bytes, set[int]] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        position = 0
        for _, _, data, offsets in string_chunks(pa.array([t for _, t in items], pa.string())):
            data = LOWER[data]
            starts, ends, first = word_spans(data, offsets, ALNUM)
            words = word_hashes(data, starts, ends)
            for low, high in zip(first[:-1], first[1:]):
                name = number.get(items[position][0], -1)
                position += 1
                for at in range(low, max(low, high - WINDOW) + 1) if high > low else ():
                    found.setdefault(words[at : min(at + WINDOW, high)].tobytes(), set()).add(name)
        rows = [np.frombuffer(key, np.uint64) for key in found]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *rows]))
        self.lengths = np.array([len(r) for r in rows], np.int64)
        # Symbols start at 1; 0 is the separator. Rows are aligned to the right.
        self.symbols = np.zeros((len(rows), WINDOW), np.int64)
        for k, row in enumerate(rows):
            self.symbols[k, WINDOW - len(row) :] = np.searchsorted(self.vocabulary, row) + 1
        self.items = [np.array(sorted(x for x in found[key] if x >= 0), np.int64) for key in found]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes; every separator (0) is a symbol of its own, ordered by position.

    The last symbol must be a separator.
    """
    n = len(symbols)
    separator = symbols == 0
    first = np.where(separator, np.cumsum(separator) - 1, symbols + separator.sum())
    order = np.argsort(first, kind="stable")
    key = first[order]
    fresh = np.append(True, key[1:] != key[:-1])
    head = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = head[np.cumsum(fresh) - 1]
    open_ = order[np.repeat(np.diff(np.append(head, n)) > 1, np.diff(np.append(head, n)))]
    step = 1
    while len(open_):
        key = rank[open_] << 32 | rank[open_ + step]
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        group = key >> 32
        new_group = np.append(True, group[1:] != group[:-1])
        fresh = np.append(True, key[1:] != key[:-1])
        place = np.arange(len(open_))
        begin = place[new_group][np.cumsum(new_group) - 1]
        head = np.flatnonzero(fresh)
        which = np.cumsum(fresh) - 1
        rank[open_] = group + head[which] - begin
        alone = np.diff(np.append(head, len(open_))) == 1
        open_ = open_[~alone[which]]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


class WaveletMatrix:
    """Ranks and symbols of a sequence, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        n = len(symbols)
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.cumsum(np.bitwise_count(words).astype(np.int64)) - np.bitwise_count(words)
            self.levels.append((bit, words, counts, n - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words, counts, at):
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[at >> 6] + np.bitwise_count(words[at >> 6] & low)

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` leads on the path of a symbol; differences are counts of it."""
        for bit, words, counts, zeros in self.levels:
            ones = self._ones(words, counts, at)
            at = np.where(symbols >> bit & 1, zeros + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions and where their own paths lead."""
        symbols = np.zeros(len(at), np.int64)
        for bit, words, counts, zeros in self.levels:
            set_ = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(words, counts, at)
            symbols |= set_.astype(np.int64) << bit
            at = np.where(set_, zeros + ones, at - ones)
        return symbols, at


class FMIndex:
    """Counts and places of symbol rows in a sequence that ends with a separator."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        suffixes = suffix_array(symbols)
        before = np.where(suffixes > 0, symbols[suffixes - 1], 0)
        self.size = len(symbols)
        self.first = np.append(0, np.cumsum(np.bincount(symbols, minlength=alphabet)))
        self.matrix = WaveletMatrix(before, max(1, int(alphabet - 1).bit_length()))
        every = np.arange(alphabet)
        self.base = self.matrix.down(every, np.zeros(alphabet, np.int64))
        # A walk stops at a sampled position, at the latest behind a separator.
        self.rows = np.flatnonzero((suffixes % SAMPLE == 0) | (before == 0))
        self.places = suffixes[self.rows]

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of right-aligned rows: the interval of each in the suffix order."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.size)
        live = np.arange(len(rows))
        for k in range(1, rows.shape[1] + 1):
            live = live[(lengths[live] >= k) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = rows[live, -k]
            shift = self.first[symbol] - self.base[symbol]
            low[live] = self.matrix.down(symbol, low[live]) + shift
            high[live] = self.matrix.down(symbol, high[live]) + shift
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes given by their rows."""
        steps = np.zeros(len(rows), np.int64)
        places = np.full(len(rows), -1, np.int64)
        live, at = np.arange(len(rows)), rows
        while len(live):
            near = np.minimum(np.searchsorted(self.rows, at), len(self.rows) - 1)
            hit = self.rows[near] == at
            places[live[hit]] = self.places[near[hit]] + steps[live[hit]]
            live, at = live[~hit], at[~hit]
            symbol, path = self.matrix.read(at)
            at = self.first[symbol] + path - self.base[symbol]
            steps[live] += 1
        return places


def find(windows: Windows, data: np.ndarray, offsets: np.ndarray):
    """Occurrences in one shard: word spans, first words of documents, window starts, windows."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM)
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(windows.lengths):
        return starts, ends, first, none, none
    words = word_hashes(data, starts, ends)
    place = np.minimum(np.searchsorted(windows.vocabulary, words), len(windows.vocabulary) - 1)
    symbols = np.where(windows.vocabulary[place] == words, place + 1, 0)
    # One separator stands for a run of other words; documents are cut by one too.
    cut = np.zeros(len(symbols), bool)
    cut[first[:-1][first[:-1] < len(symbols)]] = True
    keep = (symbols > 0) | np.append(True, symbols[:-1] > 0) | cut
    kept = np.flatnonzero(keep)
    breaks = np.flatnonzero(cut[kept] & (symbols[kept] > 0))
    sequence = np.insert(symbols[kept], breaks, 0)
    origin = np.insert(kept, breaks, -1)
    sequence, origin = np.append(sequence, 0), np.append(origin, -1)
    index = FMIndex(sequence, len(windows.vocabulary) + 1)
    low, high = index.search(windows.symbols, windows.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return starts, ends, first, origin[index.locate(rows)], which


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (start, end) with overlapping and touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.column_stack([spans[fresh, 0], reach[np.append(fresh[1:], len(spans)) - 1]])


def _pass(df: DataFrame, shared: Broadcast, names: list[str], give: str | None) -> DataFrame:
    """Search one block; earlier blocks' word spans and items come in and are merged."""
    text_type = pa.string()
    fields = {"_text": T.StringType(), "_hit": T.ArrayType(T.IntegerType()), "_items": T.ArrayType(T.StringType()), "_words": T.LongType()}
    out = [*names, *(("_text",) if give else ()), "_hit", "_items", "_words"]
    schema = T.StructType([T.StructField(n, fields.get(n) or df.schema[n].dataType) for n in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            texts = batch.column("_text")
            old_hits, old_items = batch.column("_hit").to_pylist(), batch.column("_items").to_pylist()
            hits, items, counts, clean = [], [], [], []
            for row, _, data, offsets in string_chunks(texts, SHARD_BYTES):
                starts, ends, first, at, which = find(windows, data, offsets)
                spans = np.column_stack([at, at + windows.lengths[which]]) if len(at) else np.zeros((0, 2), np.int64)
                owner = np.searchsorted(first, at, "right") - 1
                order = np.argsort(owner, kind="stable")
                spans, which = spans[order], which[order]
                edges = np.searchsorted(owner[order], np.arange(len(first)))
                counts += np.diff(first).tolist()
                for k in range(len(first) - 1):
                    mine = spans[edges[k] : edges[k + 1]] - first[k]
                    old = np.array(old_hits[row + k], np.int64).reshape(-1, 2)
                    mine = merged(np.concatenate([old, mine]))
                    seen = np.unique(np.concatenate([np.zeros(0, np.int64), *(windows.items[w] for w in np.unique(which[edges[k] : edges[k + 1]]))]))
                    hits.append(mine.ravel().tolist())
                    items.append(sorted({*old_items[row + k], *(windows.names[i] for i in seen)}))
                    if give == "clean" and len(mine):
                        low, high = starts[first[k] + mine[:, 0]], ends[first[k] + mine[:, 1] - 1]
                        edge = np.concatenate([[offsets[k]], np.column_stack([low, high]).ravel(), [offsets[k + 1]]])
                        clean.append(b"".join(data[a:b].tobytes() for a, b in edge.reshape(-1, 2)).decode())
                    elif give == "clean":
                        clean.append(None)
            columns = [batch.column(n) for n in names]
            if give == "clean":
                whole = texts.to_pylist()
                columns.append(pa.array([w if c is None else c for c, w in zip(clean, whole)], text_type))
            elif give:
                columns.append(texts)
            columns += [pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=out)

    return df.mapInArrow(run, schema)


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[tuple[Windows, bool]]:
    """The distinct benchmark items in blocks of bounded size, by hash, and whether it is the last; at least one block."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield Windows([(r.i, r.t) for r in part.collect()]), k == blocks - 1


def _search(df: DataFrame, benchmark: DataFrame, columns: list[str], text: str, give: str | None) -> DataFrame:
    """Hits next to ``columns``, which are named ``_c0, _c1, ...``.

    One block of the benchmark is on the driver and on the executors at a time: the hits of each but the last are
    stored before the next is fetched.
    """
    names = [f"_c{k}" for k in range(len(columns))]
    rows = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)], F.col(f"`{text}`").alias("_text"),
        F.array().cast("array<int>").alias("_hit"), F.array().cast("array<string>").alias("_items"),
    )
    ship_package(df.sparkSession)
    for block, last in benchmark_blocks(benchmark):
        shared = df.sparkSession.sparkContext.broadcast(block)
        rows = _pass(rows, shared, names, give if last else "text")
        if not last:
            rows = stage(rows, "benchmark-hits")
            shared.destroy()
    return rows


def search(df: DataFrame, benchmark: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with its benchmark hits; columns of these names are replaced.

    ``_words``: words of the text; ``_hit``: merged hit spans as word numbers (start, end, ...);
    ``_items``: sorted item identifiers.
    """
    columns = [c for c in columns if c not in ("_words", "_hit", "_items")]
    return _search(df, benchmark, columns, text, None).withColumnsRenamed({f"_c{k}": c for k, c in enumerate(columns)})


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", keep_emptied: bool = True) -> DataFrame:
    """All columns of ``df``, hit spans cut out of the texts; other text stays as it is.

    Without ``keep_emptied`` rows go that were cut and have no letter or digit left.
    """
    cleaned = _search(df, benchmark, df.columns, text, "clean")
    if not keep_emptied:
        cleaned = cleaned.where((F.size("_hit") == 0) | F.col("_text").rlike(r"[\p{L}\p{N}]"))
    return cleaned.select(*[F.col("_text" if c == text else f"_c{k}").alias(c) for k, c in enumerate(df.columns)])


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every whole document."""
    hits = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    spans = F.sequence(F.lit(0), F.size("_hit") - 2, F.lit(2))
    n_hit = F.when(F.size("_hit") == 0, 0).otherwise(
        F.aggregate(spans, F.lit(0), lambda total, i: total + F.get("_hit", i + 1) - F.get("_hit", i))
    )
    return hits.select(
        "doc_id", F.col("_words").alias("n_words"), n_hit.cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_hit") > 0).alias("contaminated"),
    )
