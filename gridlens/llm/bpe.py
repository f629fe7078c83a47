"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A chunk of texts is split into words at once (character classes looked up per code point),
equal words are encoded once, and the symbols of all distinct words lie in one flat array. In a
round, the rank of every adjacent pair is found by binary search over the sorted pair keys and
each word merges its lowest-ranked pair everywhere; words without a known pair leave the array.

Null and empty texts give no ids. Special tokens in a text become their id, or ordinary text with
``special=False``. Every row gives one row; other columns pass through, and a column that has the
output's name is replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.registry import query, table
from gridlens.llm.text import string_chunks, word_hashes
from gridlens.session import ship_package

SPACE, LETTER, NUMBER, OTHER = range(4)
NO_RANK = np.iinfo(np.int32).max
# Contractions that form a word of their own after an apostrophe (fixed by the vocabulary's pattern).
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    classes = np.full(0x110000, OTHER, np.uint8)
    # Decoded at once: a join holds a string object for every code point, in each worker.
    points = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            for char in found[0]:
                classes[ord(char)] = kind
    return classes


class Codec:
    """Tables of a byte-level vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Printable bytes stand for themselves, the others for code points from 256 on, in order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, number in vocab.items():
            raw[number] = bytes(to_byte[c] for c in token)
        for token, number in self.special.items():
            raw[number] = token
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_ends = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in to_byte.items():
            self.byte_ids[byte] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = order.astype(np.int32)
        self.pair_ids = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def _segments(self, data: np.ndarray, offsets: np.ndarray, special: bool):
        """Cut documents at special tokens: edges, and ``(start, end, id)`` of each special token."""
        found = []
        raw = data.tobytes() if special else b""
        for token, number in self.special.items():
            at = raw.find(token)
            while at >= 0:
                inside = offsets[np.searchsorted(offsets, at, "right")] >= at + len(token)
                if inside:
                    found.append((at, at + len(token), number))
                at = raw.find(token, at + (len(token) if inside else 1))
        edges = np.unique(np.concatenate([offsets, *(f[:2] for f in found)])) if found else np.unique(offsets)
        return edges, sorted(found)

    def split(self, data: np.ndarray, offsets: np.ndarray, special: bool = True):
        """``(starts, ends, ids)`` of the words in bytes; ids holds a special token's id, else -1."""
        edges, found = self._segments(data, offsets, special)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(at)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = character_classes()[chars]
        edge = np.zeros(n + 3, bool)
        edge[np.searchsorted(at, edges)] = True
        edge[n:] = True
        start = edge[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last white space before a word starts a token; a blank there belongs to the word.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
        start[last] = True
        start[last[chars[last] == 0x20] + 1] = False
        chars, kind = np.append(chars, [0, 0, 0]), np.append(kind, [SPACE] * 3)
        quote = np.flatnonzero((chars[:n] == 0x27) & start)
        quote = quote[~edge[quote + 1] & (kind[quote + 1] == LETTER)]
        one = quote[np.isin(chars[quote + 1], [ord(c) for c in ONE_LETTER])]
        two = np.concatenate(
            [quote[(chars[quote + 1] == ord(a)) & (chars[quote + 2] == ord(b))] for a, b in TWO_LETTERS]
        )
        two = two[~edge[two + 2]]
        for heads, length in ((one, 1), (two, 2)):
            start[heads + 1] = False
            rest = heads + 1 + length
            rest = rest[~edge[rest] & (kind[rest] == LETTER)]
            start[rest] = True
        for low, high, _ in found:
            low, high = np.searchsorted(at, (low, high))
            start[low + 1 : high] = False
        starts = at[np.flatnonzero(start)]
        ids = np.full(len(starts), -1, np.int64)
        for low, _, number in found:
            ids[np.searchsorted(starts, low)] = number
        return starts, np.append(starts[1:], len(data)), ids

    def merge(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words given as one byte array and their lengths: ``(flat ids, counts)``."""
        symbols = self.byte_ids[letters]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            keys = symbols[:-1] << 32 | symbols[1:]
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = (self.pair_keys[place] == keys) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.pair_ranks[place], NO_RANK), NO_RANK)
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(head, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, head), sizes)
            active = least != NO_RANK
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank, least = symbols[active], word[active], rank[active], least[active]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            # Of overlapping pairs (a run of one symbol) every other one merges, from the left.
            fresh = np.append(True, (at[1:] != at[:-1] + 1))
            turn = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[turn % 2 == 0]
            symbols[at] = self.pair_ids[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(lengths))

    def encode(self, data: np.ndarray, offsets: np.ndarray, special: bool = True):
        """Ids of all texts of a chunk and the offsets of each text's ids."""
        starts, ends, fixed = self.split(data, offsets, special)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        begin = np.cumsum(lengths) - lengths
        letters = data[np.repeat(starts[first] - begin, lengths) + np.arange(lengths.sum())]
        ids, counts = self.merge(letters, lengths)
        marked = fixed >= 0
        if marked.any():
            which = np.where(marked, len(counts) + np.cumsum(marked) - 1, which)
            ids, counts = np.append(ids, fixed[marked]), np.append(counts, np.ones(marked.sum(), np.int64))
        head = np.cumsum(counts) - counts
        sizes = counts[which]
        ends_of = np.cumsum(sizes)
        flat = ids[np.repeat(head[which] - (ends_of - sizes), sizes) + np.arange(ends_of[-1])]
        return flat, np.append(0, ends_of)[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a flat id array."""
        low = self.token_ends[ids]
        lengths = self.token_ends[ids + 1] - low
        ends = np.cumsum(lengths)
        return self.token_bytes[np.repeat(low - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.token_ends[ids + 1] - self.token_ends[ids]


def text_of(raw: bytes) -> str:
    """Decoded bytes as text; bytes that are no UTF-8 become replacement characters."""
    return raw.decode("utf-8", "replace")


def _codec(spark: SparkSession, path: str):
    """A vocabulary has a fixed size, so it is sent to the tasks whole."""
    ship_package(spark)
    return spark.sparkContext.broadcast(Codec(path))


def _map_text(df: DataFrame, column: str, output: str, kind: T.DataType, task) -> DataFrame:
    """Replace or add ``output`` by ``task`` over Arrow batches; other columns pass through."""
    names = [c for c in df.columns if c.lower() != output.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{column}`").alias("_bpe_in"))
    schema = T.StructType([*source.schema.fields[: len(names)], T.StructField(output, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, task(batch.column(len(names)))], names=[*names, output])

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", output: str = "ids", special: bool = True) -> DataFrame:
    """Add the token ids of ``text`` as an integer array (empty for null texts)."""
    codec = _codec(df.sparkSession, path)

    def task(column: pa.Array) -> pa.Array:
        flats, counts = [np.zeros(0, np.int64)], []
        for _, _, data, offsets in string_chunks(column):
            flat, ends = codec.value.encode(data, offsets, special)
            flats.append(flat)
            counts.append(np.diff(ends))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flats).astype(np.int32)))

    return _map_text(df, text, output, T.ArrayType(T.IntegerType()), task)


def decode(df: DataFrame, path: str, ids: str = "ids", output: str = "text") -> DataFrame:
    """Add the text of an id array; a null array gives a null text."""
    codec = _codec(df.sparkSession, path)

    def task(column: pa.Array) -> pa.Array:
        return pa.array(
            [None if x is None else text_of(codec.value.decode(np.array(x, np.int64)).tobytes()) for x in column.to_pylist()],
            pa.string(),
        )

    return _map_text(df, ids, output, T.StringType(), task)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; per row the token count and the digests of ids and decoded text."""
    codec = _codec(df.sparkSession, path)
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for _, _, data, offsets in string_chunks(batch.column(1)):
                flat, ends = codec.value.encode(data, offsets)
                decoded = codec.value.decode(flat).tobytes()
                places = np.append(0, np.cumsum(codec.value.lengths(flat)))[ends]
                packed, original = flat.astype("<u4").tobytes(), data.tobytes()
                counts += np.diff(ends).tolist()
                for i in range(len(offsets) - 1):
                    raw = decoded[places[i] : places[i + 1]]
                    if raw != original[offsets[i] : offsets[i + 1]]:
                        raw = text_of(raw).encode()
                    ids_sha.append(hashlib.sha256(packed[4 * ends[i] : 4 * ends[i + 1]]).hexdigest())
                    text_sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["_key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(run, f"_key {kind}, {DIGESTS}").withColumnRenamed("_key", key)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text, by merge rounds and back."""
    return digests(table(spark, sf_dir, "documents"), default_vocabulary())
