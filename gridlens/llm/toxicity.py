"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

Landmarks are words that mark toxic training documents and words of clean ones. The kernel counts common
subsequences of three characters and discounts gaps, so an insult with inserted or dropped characters
stays close to its landmark; a kernel below ``FLOOR`` counts as 0. Words are read without the marks around
them and a second time without those between their letters, letters written apart are read as one word,
and words over ``LONGEST`` symbols in overlapping pieces. Symbols are lower-case code points of any script
(from U+2E80 on two symbols each, so that words of two characters have a kernel). A landmark is not compared
with words that lack so many of its symbols that their kernel is below the floor for certain. A sentence has,
per landmark, its nearest word; a linear machine over the Nyström features of this kernel and of its powers
(which tell an insult from words that merely resemble it) scores sentences, a document scores as its worst
sentence, and a sigmoid fitted on the training documents turns that into 0 to 1.

Labels are of documents, so the training sentences of a toxic document are its worst one and the others
on the toxic side, first by nearness to a marking word, then by the machine so far; weakened copies of
them stand for disguised words. The sample is bounded: about ``TRAIN_DOCS`` documents of each label, of each ``SENTENCES``
sentences, of each its first ``SENTENCE_CHARS`` characters; scored are whole texts of any length, in chunks. Null and empty texts score like a sentence without any known word; where one label is missing all
rows score 0. Every row gives one row; other columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.registry import query, table
from gridlens.llm.text import SPACED, string_chunks, word_hashes, word_spans
from gridlens.session import scratch, ship_package, stage

DECAY = 0.8
LONGEST = 24
# Landmarks up to this length are compared in narrower rows.
SHORT = 12
TRAIN_DOCS = 1000
SENTENCES = 60
SENTENCE_CHARS = 300
PLAIN = 8
POWERS = (1, 4, 16)
# Likelihood ratio from which a word marks toxic documents.
EVIDENCE = 20
# Kernel with a stronger marking word from which on a word needs no landmark of its own.
COVERED = 0.9
# Kernel that a disguised word keeps, about, of its plain form.
DISGUISED = 0.6
WEAK_SHARE = 0.5
# Share of clean sentences near a landmark from which on it is taken literally.
RESEMBLED = 1e-3
# Clean sentences near a landmark that are trained on, at most.
CLEAN_ROWS = 6000
SENTENCE_END = np.zeros(1 << 16, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True
THRESHOLD = 0.3
IS_WORD = np.append(SPACED, np.ones((1 << 16) - 256, bool))
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(1 << 16))], np.uint16)
WIDE = 0x2E80
# Kernel pairs computed at once.
PAIRS = 1 << 15
# Kernels below this count as 0.
FLOOR = 0.5
# Distinct symbols of a landmark up to which every subset of them has its own bound.
SUBSETS = 8
# Words remembered to be near no landmark, and near one, about.
KNOWN, KNOWN_NEAR = 1 << 20, 1 << 16
_LETTER = np.ones(1 << 16, bool)
_LETTER[:128] = [chr(c).isalnum() for c in range(128)]


def subsequence_kernel(left: np.ndarray, lengths: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Kernel of row pairs: symbol rows ``left`` of given lengths, rows ``right`` padded with zeros.

    Sum over common subsequences of three symbols of the decay to the power of their spans in both.
    """
    n, width = right.shape
    step = np.arange(width)
    reach = np.where(step[:, None] <= step, DECAY ** (step - step[:, None]).clip(0), 0).astype(np.float32)
    one, two = np.zeros((n, width + 1), np.float32), np.zeros((n, width + 1), np.float32)
    total = np.zeros(n, np.float32)
    order = np.argsort(-lengths, kind="stable")
    left, right, lengths = left[order], right[order], lengths[order]
    for i in range(int(lengths.max(initial=0))):
        live = np.searchsorted(-lengths, -i, "left")
        match = (right[:live] == left[:live, i, None]) & (right[:live] > 0)
        hit = match * np.float32(DECAY**2)
        total[:live] += (hit * two[:live, :-1]).sum(1)
        two[:live] *= DECAY
        two[:live, 1:] += (hit * one[:live, :-1]) @ reach
        one[:live] *= DECAY
        one[:live, 1:] += hit @ reach
    out = np.empty(n, np.float32)
    out[order] = total
    return out


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes as symbols of 16 bits, and the offsets of the texts in them."""
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(lead)
    size = np.diff(np.append(at, len(data)))
    value = data[at].astype(np.uint32)
    value &= np.where(value >= 0xF0, 7, np.where(value >= 0xE0, 15, np.where(value >= 0xC0, 31, 255))).astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        value[more] = value[more] << 6 | data[at[more] + k] & 63
    out, offsets = _LOWER[value & 0xFFFF], np.searchsorted(at, offsets)
    wide = value >= WIDE
    if wide.any():
        place = np.append(0, np.cumsum(1 + wide))
        out, second = np.repeat(out, 1 + wide), place[1:][wide] - 1
        out[second] = out[second] * np.uint16(40503) | np.uint16(1)
        offsets = place[offsets]
    return out, offsets


def _rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(width)
    padded = np.append(data, np.zeros(width, data.dtype))
    return np.where(at < lengths[:, None], padded[starts[:, None] + at], 0).astype(np.uint16)


def _letters(rows: np.ndarray) -> np.ndarray:
    """A bit per letter a-z that a row has; other symbols share the rest, so a missing bit is a missing symbol."""
    symbol = rows.astype(np.uint64)
    bit = np.where((rows >= 97) & (rows <= 122), symbol - np.uint64(97), np.uint64(26) + symbol % np.uint64(38))
    return np.bitwise_or.reduce(np.where(rows > 0, np.uint64(1) << bit, np.uint64(0)), axis=1)


def _missing(row: np.ndarray, length: int) -> int:
    """How many distinct symbols of a landmark a word must lack at least so that their kernel is surely below ``FLOOR``.

    By Cauchy-Schwarz the kernel is at most the root of the share of the landmark's own kernel that its other
    symbols make.
    """
    distinct = np.unique(row[:length])
    whole = subsequence_kernel(row[None], np.array([length]), row[None])[0]
    for missing in range(1, len(distinct)):
        gone = np.array(list(combinations(distinct, missing)), np.uint16)
        kept = np.where((row == gone[:, :, None]).any(1), 0, row).astype(np.uint16)
        most = max(
            float(subsequence_kernel(k, np.full(len(k), length), k).max())
            for k in np.array_split(kept, -(-len(kept) // PAIRS))
        )
        if most < FLOOR**2 * whole:
            return missing
    return max(1, len(distinct))


def _subsets(row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Letter bits of a landmark's distinct symbols, and for each subset of them whether a word with just these may reach ``FLOOR``.

    The same bound as in :func:`_missing`, for the very symbols that a word lacks.
    """
    distinct = np.unique(row[:length])
    bits = np.array([int(b).bit_length() - 1 for b in _letters(distinct[:, None])], np.uint64)
    present = np.arange(1 << len(distinct))[:, None] >> np.arange(len(distinct)) & 1
    kept = np.where(((row == distinct[:, None]) & (present[:, :, None] > 0)).any(1), row, 0).astype(np.uint16)
    most = subsequence_kernel(kept, np.full(len(kept), length), kept)
    return bits, most >= FLOOR**2 * most[-1] * (1 - 1e-4)


class Landmarks:
    """Landmark words and the kernel of other words with them."""

    def __init__(self, words: list[bytes]):
        self.words = words
        flat, at = symbols(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
        self.lengths = lengths = np.diff(at)
        self.rows = _rows(flat, at[:-1], lengths, LONGEST)
        self.letters = _letters(self.rows)
        self.norms = np.sqrt(subsequence_kernel(self.rows, lengths, self.rows))
        distinct = np.bitwise_count(self.letters).astype(np.int64)
        self.least = distinct + 1 - np.array([_missing(row, n) for row, n in zip(self.rows, lengths)], np.int64)
        self.bits = np.zeros((len(words), SUBSETS), np.uint64)
        self.may = np.ones((len(words), 1 << SUBSETS), bool)
        for k in np.flatnonzero((distinct <= SUBSETS) & (lengths >= 3)) if len(words) <= 256 else ():
            bits, may = _subsets(self.rows[k], lengths[k])
            if len(bits) <= SUBSETS:
                self.bits[k, : len(bits)] = bits
                # Further bits repeat the subset.
                self.may[k] = np.resize(may, 1 << SUBSETS)
        # Hashes of words known to be near no landmark, and of others with their kernels, in order.
        self.far, self.near = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(words)), np.float32)

    def kernel(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Normalised kernel of symbol rows with every landmark."""
        out = np.zeros((len(rows), len(self.words)), np.float32)
        found = [np.zeros((2, 0), np.int64)]
        for low in range(0, len(rows), PAIRS // 8):
            letters = _letters(rows[low : low + PAIRS // 8])
            word, mark = np.nonzero(np.bitwise_count(letters[:, None] & self.letters) >= self.least)
            subset = np.zeros(len(word), np.int64)
            for j in range(SUBSETS):
                subset |= (letters[word] >> self.bits[mark, j] & np.uint64(1)).astype(np.int64) << j
            near = self.may[mark, subset]
            found.append(np.array([word[near] + low, mark[near]]))
        word, mark = np.concatenate(found, axis=1)
        if len(word):
            used = np.unique(word)
            own = np.zeros((len(used), LONGEST), np.uint16)
            own[:, : rows.shape[1]] = rows[used]
            norm = np.zeros(len(rows), np.float32)
            for low in range(0, len(used), PAIRS):
                some = slice(low, low + PAIRS)
                norm[used[some]] = np.sqrt(subsequence_kernel(own[some], lengths[used[some]], own[some]))
            short = self.lengths[mark] <= SHORT
            for some, width in ((np.flatnonzero(short), SHORT), (np.flatnonzero(~short), LONGEST)):
                for low in range(0, len(some), PAIRS):
                    w, m = word[some[low : low + PAIRS]], mark[some[low : low + PAIRS]]
                    value = subsequence_kernel(rows[w], lengths[w], self.rows[m, :width])
                    value /= np.maximum(norm[w] * self.norms[m], 1e-12)
                    out[w, m] = np.where(value >= FLOOR, value, 0)
        return out

    def kernel_of(self, hashes: np.ndarray, rows, lengths: np.ndarray) -> np.ndarray:
        """:meth:`kernel` of words with distinct ``hashes`` in order; words met before are remembered.

        ``rows`` gives the symbol rows of some of the words.
        """
        out = np.zeros((len(hashes), len(self.words)), np.float32)
        old, place = _members(self.near, hashes)
        out[old] = self.values[place[old]]
        new = np.flatnonzero(~old & ~_members(self.far, hashes)[0])
        out[new] = self.kernel(rows(new), lengths[new])
        close = out[new].any(1)
        self.far = np.union1d(self.far if len(self.far) < KNOWN else self.far[:0], hashes[new[~close]])
        if len(self.near) >= KNOWN_NEAR:
            self.near, self.values = self.near[:0], self.values[:0]
        near = np.append(self.near, hashes[new[close]])
        order = np.argsort(near)
        self.near, self.values = near[order], np.concatenate([self.values, out[new[close]]])[order]
        return out


def _members(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is in the ordered ``known``, and where."""
    place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    return (known[place] == hashes if len(known) else np.zeros(len(hashes), bool)), place


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Words, cut to pieces where long, letters written apart as one, and words without the marks between their letters.

    ``(symbols, starts, lengths, sentence, first sentence)``;
    ``sentence`` numbers sentences with a word over the chunk; the last array gives each document's first.
    """
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    if not len(starts):
        return data, starts, starts, starts, np.zeros(len(offsets), np.int64)
    ended = np.append(0, np.cumsum(SENTENCE_END[data]))
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    change = np.append(True, (np.diff(ended[starts]) > 0) | (np.diff(document) > 0))
    sentence = np.cumsum(change) - 1
    first_sentence = np.append(sentence, sentence[-1] + 1)[first]
    lengths = ends - starts
    single = (lengths == 1) & ((data[starts] >= 97) & (data[starts] <= 122) | (data[starts] > 127))
    same = np.append(False, single[1:] & single[:-1] & (sentence[1:] == sentence[:-1]))
    run = np.cumsum(~same)[single]
    apart = []
    if len(run):
        _, head, size = np.unique(run, return_index=True, return_counts=True)
        where = np.flatnonzero(single)
        apart = [(where[h], s) for h, s in zip(head, size) if s >= 3]
    joined = [data[starts[w : w + s]] for w, s in apart]
    extra = len(data) + np.cumsum([0, *map(len, joined)])
    bodies = [(extra[:-1], extra[1:], sentence[[w for w, _ in apart]] if apart else sentence[:0])]
    # A word is read without the marks around its letters, and a second time without those between them.
    letters = np.flatnonzero(_LETTER[data])
    low, high = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
    some = np.flatnonzero(high > low)
    starts[some], ends[some] = letters[low[some]], letters[high[some] - 1] + 1
    marked = some[(ends[some] - starts[some] > high[some] - low[some]) & (high[some] - low[some] >= 3)]
    size = high[marked] - low[marked]
    joined.append(data[letters[np.repeat(low[marked] - np.cumsum(size) + size, size) + np.arange(size.sum())]])
    bodies.append((extra[-1] + np.cumsum(size) - size, extra[-1] + np.cumsum(size), sentence[marked]))
    data = np.concatenate([data, *joined])
    starts, ends, sentence = (np.concatenate([own, *more]) for own, *more in zip((starts, ends, sentence), *bodies))
    pieces = np.maximum(1, -(-(ends - starts - LONGEST // 2) // (LONGEST // 2)))
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(starts, pieces) + number * (LONGEST // 2)
    sentence = np.repeat(sentence, pieces)
    size = np.minimum(LONGEST, np.repeat(ends, pieces) - at)
    order = np.argsort(sentence, kind="stable")
    return data, at[order], size[order], sentence[order], first_sentence


def sentence_features(marks: Landmarks, data: np.ndarray, offsets: np.ndarray):
    """Per sentence and landmark the nearest word's kernel, and each document's first sentence."""
    data, starts, lengths, sentence, first = tokens(*symbols(data, offsets))
    if not len(starts):
        return np.zeros((0, len(marks.words)), np.float32), first
    hashes, one, which = np.unique(word_hashes(data.view(np.uint8), 2 * starts, 2 * (starts + lengths)), return_index=True, return_inverse=True)
    kernel = marks.kernel_of(hashes, lambda k: _rows(data, starts[one[k]], lengths[one[k]], LONGEST), lengths[one])
    # Most words are near no landmark; only the others are spread over their sentences.
    near = kernel.any(1)[which]
    out = np.zeros((sentence[-1] + 1, len(marks.words)), np.float32)
    if near.any():
        rows, at = kernel[which[near]], sentence[near]
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[head]] = np.maximum.reduceat(rows, head)
    return out, first


def _worst(margins: np.ndarray, first: np.ndarray, none: float) -> np.ndarray:
    out = np.full(len(first) - 1, none)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.maximum.reduceat(margins, first[:-1][some])
    return out


def powers(features: np.ndarray) -> np.ndarray:
    """The kernel and its powers, side by side."""
    return np.concatenate([features**k for k in POWERS], axis=1)


class Machine:
    """Landmarks, a linear machine over their kernel values, and the sigmoid of its margins."""

    def __init__(self, marks: Landmarks, weights: np.ndarray, base: float):
        self.marks, self.weights, self.base = marks, weights, base
        self.slope, self.shift = 1.0, 0.0

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features, first = sentence_features(self.marks, data, offsets)
        margins, some = np.full(len(features), self.base), np.flatnonzero(features.any(1))
        margins[some] += powers(features[some]) @ self.weights
        return _worst(margins, first, self.base)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, weighted rows, labels 1 and -1) by Adam over all rows."""
    w, first, second = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    for t in range(1, rounds + 1):
        loss = np.maximum(0, 1 - y * (x @ w)) * share * y
        g = penalty * w - 2 * (loss.astype(np.float32) @ x)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g**2
        w -= 0.1 * (1 - 0.95 * t / rounds) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _sigmoid(margins: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit probabilities to margins of weighted rows, by Newton steps."""
    x, w = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (share * (p - y)) + 1e-2 * (w - [1, 0])), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def _pieces(word: str) -> list[str]:
    """A word of three symbols at least, in overlapping pieces where it is long."""
    size = len(word) + sum(c >= chr(WIDE) for c in word)
    step = LONGEST // 2 if size == len(word) else LONGEST // 4
    return [word] * (size >= 3) if size <= LONGEST else [word[i : i + 2 * step] for i in range(0, len(word) - step, step)]


def _uncovered(words: list[str]) -> list[str]:
    """The words, strongest first, without those that closely resemble a kept one."""
    if not words:
        return []
    marks = Landmarks([w.encode() for w in words])
    kept, covered = [], np.zeros(len(words), bool)
    for k, word in enumerate(words):
        if not covered[k]:
            kept.append(word)
            covered |= Landmarks([word.encode()]).kernel(marks.rows, marks.lengths)[:, 0] >= COVERED
    return kept


def _marking_words(docs: list[list[str]], toxic: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Words surely more frequent in toxic documents (by likelihood ratio), and the most frequent others."""
    seen = {True: Counter(), False: Counter()}
    for sentences, y in zip(docs, toxic):
        words = {w.strip(".,;:!?\"'()").lower() for s in sentences for w in s.split()}
        seen[bool(y)].update({p for w in words for p in _pieces(w)})
    n = {k: max(1, int((toxic == k).sum())) for k in (True, False)}
    rate = n[True] / (n[True] + n[False])

    def evidence(word: str) -> float:
        a, b = seen[True][word], seen[False][word]
        if a <= rate * (a + b):
            return 0.0
        return 2 * (a * np.log(a / (rate * (a + b))) + (b * np.log(b / ((1 - rate) * (a + b))) if b else 0))

    ratios = {w: evidence(w) for w in seen[True]}
    top = sorted((w for w in ratios if ratios[w] >= EVIDENCE), key=lambda w: (-ratios[w], w))
    top = _uncovered(top)
    plain = [w for w, _ in sorted(seen[False].items(), key=lambda x: (-x[1], x[0])) if ratios.get(w, 0) < EVIDENCE][:PLAIN]
    return [w.encode() for w in top], [w.encode() for w in plain]


def _features(marks: Landmarks, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Sentence features of documents given as sentences, a few documents at a time."""
    found, counts = [np.zeros((0, len(marks.words)), np.float32)], []
    for _, _, data, offsets in string_chunks(pa.array([" . ".join(d) for d in docs], pa.string()), 1 << 20):
        features, first = sentence_features(marks, data, offsets)
        found.append(features)
        counts.append(np.diff(first))
    return np.concatenate(found), np.append(0, np.cumsum(np.concatenate(counts)))


def fit(docs: list[list[str]], toxic: np.ndarray, rounds: int = 3) -> Machine | None:
    """A machine from sentences of labelled documents; None where a label or landmarks are missing."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return None
    top, plain = _marking_words(docs, toxic)
    if not top:
        return None
    marks = Landmarks([*top, *plain])
    features, first = _features(marks, docs)
    # Nyström: kernel values times the inverse root of the landmarks' own kernel.
    own = marks.kernel(marks.rows, marks.lengths)
    root = np.zeros((len(POWERS) * len(own), len(POWERS) * len(own)))
    for k, power in enumerate(POWERS):
        values, vectors = np.linalg.eigh(((own + own.T) / 2) ** power + 0.05 * np.eye(len(own)))
        part = slice(k * len(own), (k + 1) * len(own))
        root[part, part] = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    owner = np.repeat(np.arange(len(docs)), np.diff(first))
    clean, suspect = np.flatnonzero(~toxic[owner]), toxic[owner]

    def seen_by(rows: np.ndarray, strength: float = 1.0) -> np.ndarray:
        return (powers(features[rows] * np.float32(strength)) @ root).astype(np.float32)

    margins = features[:, : len(top)].max(1, initial=0) - 0.9
    # No weakened copies for landmarks that clean words resemble that closely.
    distinct = (features[clean] > DISGUISED - 0.1).mean(0) < RESEMBLED
    tolerant = distinct[features[:, : len(top)].argmax(1)] if len(features) else np.zeros(0, bool)
    # Clean sentences near no landmark are all alike: one row with their number stands for them.
    empty = clean[~features[clean].any(1)]
    near = np.setdiff1d(clean, empty)
    few = near[np.linspace(0, len(near) - 1, min(len(near), CLEAN_ROWS)).astype(int)]
    plain_rows = np.append(few, empty[:1])
    blank = np.full(len(plain_rows), max(1, len(near)) / max(1, len(few)))
    blank[len(plain_rows) - len(empty[:1]) :] = len(empty)
    negative = seen_by(plain_rows)
    for _ in range(rounds):
        worst = [first[d] + int(margins[first[d] : first[d + 1]].argmax()) for d in np.flatnonzero(toxic) if first[d + 1] > first[d]]
        bad = np.union1d(np.flatnonzero(suspect & (margins > 0)), np.array(worst, np.int64))
        soft = bad[tolerant[bad]]
        share = np.concatenate([np.ones(len(bad)), np.full(len(soft), WEAK_SHARE), blank])
        y = np.concatenate([np.ones(len(bad) + len(soft)), -np.ones(len(plain_rows))])
        share[y > 0] /= 2 * share[y > 0].sum()
        share[y < 0] /= 2 * share[y < 0].sum()
        w, b = _hinge(np.concatenate([seen_by(bad), seen_by(soft, DISGUISED), negative]), y, share)
        margins = np.full(len(features), b)
        some = np.flatnonzero(suspect & features.any(1))
        margins[some] = seen_by(some) @ w + b
    machine = Machine(marks, (root @ w).astype(np.float32), float(b))

    def worst_of(strength: np.ndarray | float) -> np.ndarray:
        out, step = np.full(len(features), machine.base), 50_000
        for low in range(0, len(features), step):
            rows = slice(low, low + step)
            part = features[rows] * (strength[rows, None] if isinstance(strength, np.ndarray) else np.float32(strength))
            out[rows] = powers(part) @ machine.weights + machine.base
        return _worst(out, first, machine.base)

    weakened = worst_of(np.where(tolerant, np.float32(DISGUISED), np.float32(0)))
    sure = np.flatnonzero(toxic & (weakened > machine.base + 0.5))
    machine.slope, machine.shift = _sigmoid(
        np.append(worst_of(1.0), weakened[sure]), np.append(toxic.astype(float), np.ones(len(sure))),
        np.append(np.ones(len(docs)), np.full(len(sure), WEAK_SHARE / 10)),
    )
    return machine


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine | None:
    """Fit on the documented sample; a document counts as toxic if any of its labels says so."""
    with scratch(docs.sparkSession):
        found, counts = _sample(docs, labels, key, text, label)
    toxic = np.array([y for _, y, _ in found], bool)
    machine = fit([s for _, _, s in found], toxic) if found else None
    if machine:
        # The sample has other shares of the labels than the corpus.
        machine.shift += float(np.log(counts[1] / counts[0]) - np.log(toxic.sum() / (~toxic).sum()))
    return machine


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[list[tuple], dict[int, int]]:
    """Key, label and sentences of the training documents, and the number of documents of each label."""
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(f"`{key}`").alias("k")).agg(F.max(label).alias("y"))
    counts = {int(r.y): r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, TRAIN_DOCS / counts.get(1, 1))).otherwise(min(1.0, TRAIN_DOCS / counts.get(0, 1)))
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), "k"), F.lit(1_000_000)) / 1e6
    # The keys are drawn first: a stored table of a few thousand, so no text but theirs is moved.
    drawn = stage(marked.where(chance < share), "toxicity-sample")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(drawn, "k")
    ordered = F.array_sort(F.transform(F.split("t", "[.!?\\n]+"), lambda s: F.struct(F.xxhash64(s).alias("h"), F.substring(s, 1, SENTENCE_CHARS).alias("s"))))
    picked = F.transform(F.slice(ordered, 1, SENTENCES), lambda x: x["s"])
    sample = rows.select("k", "y", picked.alias("s")).where("s is not null")
    # Of several texts of one key one is taken, so that the sample stays bounded.
    one = sample.groupBy("k", "y").agg(F.min_by("s", F.xxhash64("s")).alias("s"))
    return sorted((r.k, int(r.y), list(r.s)) for r in one.collect()), counts


def score(df: DataFrame, machine: Machine | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted`` of every row."""
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([rows.schema["_key"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [np.zeros(0)]
            for _, _, data, offsets in string_chunks(batch.column(1)):
                parts.append(np.zeros(len(offsets) - 1) if m is None else m.scores(m.margins(data, offsets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=["_key", "score"])

    return rows.mapInArrow(run, schema).select(
        F.col("_key").alias(key), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; a quarter of the documents is never learnt from."""
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
