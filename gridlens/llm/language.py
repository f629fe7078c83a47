"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments; a forward and a backward network read each segment, every byte position
gets a probability per language, and a document's probabilities are the mean over all of its positions.
The network is trained in numpy by backpropagation through time on a bounded, documented sample: about
``TRAIN_DOCS`` labelled documents of each language (fewer where there are fewer), ``PIECES`` pieces each.

Null texts and texts without a letter are ``und`` with score 0, as is everything where no labelled text
exists. Rows without a key are never held out. Every row gives one row; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.registry import query, table
from gridlens.llm.text import string_chunks
from gridlens.session import ship_package

HIDDEN = 8
SEGMENT = 96
BATCH = 2048
TRAIN_DOCS = 600
PIECES = 6
PIECE_CHARS = 60
TRAIN_STEPS = 48
UPDATES = 260


class Network:
    """Both directions side by side: axis 0 of every weight is the direction."""

    def __init__(self, languages: list[str], seed: int = 11, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.weights = {
            "input": rng.normal(0, 0.3, (2, 256, 3 * hidden)),
            "state": rng.normal(0, 0.3, (2, hidden, 3 * hidden)),
            "bias": np.zeros((2, 1, hidden)),
            "out": rng.normal(0, 0.3, (2, hidden, len(languages))),
            "base": np.zeros(len(languages)),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def states(self, segments: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Hidden states (step, direction, segment, unit); with ``keep`` also what training needs.

        Step t reads byte t forwards and byte length-1-t backwards; steps behind the end mean nothing.
        """
        w, h = self.weights, self.hidden
        steps, n = segments.shape[1], len(segments)
        back = np.maximum(lengths[:, None] - 1 - np.arange(steps), 0)
        reads = np.stack([segments, np.take_along_axis(segments, back, 1)]).astype(np.int64)
        reads[1] += 256
        reads = np.ascontiguousarray(reads.transpose(2, 0, 1))
        inputs = w["input"].reshape(512, 3 * h)
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((steps, 2, n, h), np.float32)
        kept = []
        for t in range(steps):
            given = inputs[reads[t]]
            carried = state @ w["state"]
            gates = 0.5 * np.tanh(0.5 * (given[..., : 2 * h] + carried[..., : 2 * h])) + 0.5
            update, reset = gates[..., :h], gates[..., h:]
            inner = carried[..., 2 * h :] + w["bias"]
            fresh = np.tanh(given[..., 2 * h :] + reset * inner)
            if keep:
                kept.append((state, update, reset, inner, fresh))
            state = fresh + update * (state - fresh)
            out[t] = state
        return out, reads, kept

    def _positions(self, lengths: np.ndarray, steps: int):
        at = np.arange(steps)[:, None]
        return at < lengths, np.maximum(lengths - 1 - at, 0)

    def probabilities(self, segments: np.ndarray, lengths: np.ndarray, states=None):
        """Probabilities (position, segment, language) and which positions exist."""
        out = self.states(segments, lengths)[0] if states is None else states
        exists, mirror = self._positions(lengths, segments.shape[1])
        forward, backward = out[:, 0] @ self.weights["out"][0], out[:, 1] @ self.weights["out"][1]
        scores = forward + np.take_along_axis(backward, mirror[..., None], 0) + self.weights["base"]
        scores = np.exp(scores - scores.max(-1, keepdims=True))
        return scores / scores.sum(-1, keepdims=True), exists

    def gradients(self, segments: np.ndarray, lengths: np.ndarray, labels: np.ndarray):
        """Mean loss over positions and its gradients, through time."""
        w, h = self.weights, self.hidden
        out, reads, kept = self.states(segments, lengths, keep=True)
        p, exists = self.probabilities(segments, lengths, out)
        steps, n = p.shape[:2]
        total = exists.sum()
        loss = -(np.log(p[:, np.arange(n), labels] + 1e-12) * exists).sum() / total
        d = p.copy()
        d[:, np.arange(n), labels] -= 1
        d *= exists[..., None] / total
        # The backward network's step for position i is length-1-i, and the other way round.
        mirror = self._positions(lengths, steps)[1]
        d = np.stack([d, np.take_along_axis(d * 1.0, mirror[..., None], 0) * exists[..., None]], 1).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["base"] = d[:, 0].sum((0, 1))
        g["out"] = np.einsum("tdnh,tdnc->dhc", out, d, optimize=True)
        d_out = d @ w["out"].transpose(0, 2, 1)
        carry = np.zeros((2, n, h), np.float32)
        flat = np.zeros((512, 3 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, update, reset, inner, fresh = kept[t]
            carry = carry + d_out[t]
            d_fresh = carry * (1 - update) * (1 - fresh**2)
            d_update = carry * (state - fresh) * update * (1 - update)
            d_reset = d_fresh * inner * reset * (1 - reset)
            d_inner = d_fresh * reset
            d_gates = np.concatenate([d_update, d_reset, d_fresh], -1)
            d_carried = np.concatenate([d_update, d_reset, d_inner], -1)
            np.add.at(flat, reads[t], d_gates)
            g["bias"] += d_inner.sum(1, keepdims=True)
            g["state"] += state.transpose(0, 2, 1) @ d_carried
            carry = carry * update + d_carried @ w["state"].transpose(0, 2, 1)
        g["input"] = flat.reshape(w["input"].shape)
        return loss, g

    def fit(self, segments, lengths, labels, updates: int = UPDATES, size: int = 256, rate: float = 0.02, seed: int = 3):
        """Adam over random batches with equal shares of the languages."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, updates + 1):
            pick = np.concatenate([rng.choice(rows, max(1, size // len(by))) for rows in by])
            _, g = self.gradients(segments[pick], lengths[pick], labels[pick])
            for k, w in self.weights.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                now = rate * (1 - 0.9 * step / updates)
                w -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each document of a chunk over all its bytes; empty ones get zeros."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = offsets[owner] + number * SEGMENT
        lengths = np.minimum(SEGMENT, offsets[owner + 1] - starts)
        total = np.zeros((len(sizes), len(self.languages)))
        padded = np.append(data, np.zeros(SEGMENT, np.uint8))
        for low in range(0, len(owner), BATCH):
            part = slice(low, low + BATCH)
            p, exists = self.probabilities(padded[starts[part, None] + np.arange(SEGMENT)], lengths[part])
            np.add.at(total, owner[part], (p * exists[..., None]).sum(0))
        return total / np.maximum(sizes, 1)[:, None]


def segments_of(texts: list[str], steps: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode()[:steps] for t in texts]
    segments = np.zeros((len(raw), steps), np.uint8)
    for k, r in enumerate(raw):
        segments[k, : len(r)] = np.frombuffer(r, np.uint8)
    return segments, np.array([len(r) for r in raw], np.int64)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Network | None:
    """Fit a network on the documented sample of ``labelled``; None where nothing is labelled."""
    rows = labelled.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").alias("l"))
    rows = rows.where(F.col("l").isNotNull() & (F.length("t") > 0))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, TRAIN_DOCS / counts[k])))])
    chance = F.pmod(F.xxhash64("k", "t"), F.lit(1_000_000)) / 1e6
    start = lambda i: F.pmod(F.xxhash64("k", i), F.greatest(F.length("t") - PIECE_CHARS, F.lit(1))).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: F.substr(F.col("t"), start(i), F.lit(PIECE_CHARS)))
    sample = rows.where(chance < share[F.col("l")]).select("l", pieces.alias("p"))
    found = sorted((r.l, p) for r in sample.collect() for p in r.p if p)
    segments, lengths = segments_of([p for _, p in found], TRAIN_STEPS)
    labels = np.array([languages.index(x) for x, _ in found])
    if len(np.unique(labels)) < len(languages):
        languages = [languages[k] for k in np.unique(labels)]
        labels = np.unique(labels, return_inverse=True)[1]
    return Network(languages).fit(segments, lengths, labels) if languages else None


def predict(df: DataFrame, network: Network | None, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: all) of every row with ``lang_pred`` and ``score``."""
    columns = df.columns if columns is None else columns
    names = [f"_c{k}" for k in range(len(columns))]
    body = F.col(f"`{text}`")
    rows = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)],
        F.when(body.rlike(r"\p{L}"), body).alias("_body"),
    )
    schema = T.StructType(
        [T.StructField(n, rows.schema[n].dataType) for n in names]
        + [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())]
    )
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            found, scores = [], []
            for _, _, data, offsets in string_chunks(batch.column("_body")):
                if net is None:
                    found += ["und"] * (len(offsets) - 1)
                    scores += [0.0] * (len(offsets) - 1)
                    continue
                p = net.documents(data, offsets)
                best = p.argmax(1)
                some = np.diff(offsets) > 0
                found += [net.languages[k] if s else "und" for k, s in zip(best, some)]
                scores += np.where(some, np.clip(p.max(1), 0, 1), 0.0).tolist()
            columns_ = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns_, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, "_lang", "_score"]
            )

    made = {"lang_pred", "score"}
    kept = [(n, c) for n, c in zip(names, columns) if c.lower() not in made]
    return rows.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for n, c in kept], F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; a fifth of the documents is never learnt from."""
    docs = table(spark, sf_dir, "documents")
    network = train(docs.where(~held_out()))
    return predict(docs, network, columns=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
