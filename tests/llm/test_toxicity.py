"""The kernel against its definition, and held-out results."""

import itertools
import os
import zlib

import numpy as np

from gridlens.llm import toxicity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_kernel(s, t):
    def weights(x):
        out = {}
        for at in itertools.combinations(range(len(x)), 3):
            key = tuple(x[i] for i in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel():
    rng = np.random.default_rng(2)
    pairs = [(bytes(rng.integers(97, 101, rng.integers(0, 12)).tolist()), bytes(rng.integers(97, 101, rng.integers(0, 12)).tolist())) for _ in range(60)]
    left = np.zeros((60, 24), np.uint8)
    right = np.zeros((60, 12), np.uint8)
    for k, (s, t) in enumerate(pairs):
        left[k, : len(s)], right[k, : len(t)] = list(s), list(t)
    got = toxicity.subsequence_kernel(left, np.array([len(s) for s, _ in pairs]), right)
    assert np.allclose(got, [plain_kernel(s, t) for s, t in pairs], atol=1e-4)


def test_tokens():
    text = b"one two. i d i o t x\nabc" + b"z" * 60
    offsets = np.array([0, 8, 8, len(text)])
    data, starts, lengths, sentence, first = toxicity.tokens(np.frombuffer(text, np.uint8), offsets)
    words = [(int(s), data[a : a + n].tobytes().decode()) for a, n, s in zip(starts, lengths, sentence)]
    assert (0, "one") in words and (0, "two") in words and (1, "idiotx") in words and (1, "i") in words
    assert first.tolist() == [0, 1, 1, 3]
    assert max(lengths) <= toxicity.LONGEST and (2, "abc" + "z" * 21) in words


def machine(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()))


def test_disguised_insults(spark):
    m = machine(spark, "/root/testdata/sf0.01")
    clean = "The station opens at nine and closes late. People like the small garden"
    plain = ["You are an idiot", "such a i d i o t here", "PATHETIC!"]
    disguised = ["what an id-iot", "you st*upid thing"]
    texts = [clean, "", *[f"{clean}. {b}. {clean}" for b in (*plain, *disguised)]]
    raw = [t.encode() for t in texts]
    scores = m.scores(m.margins(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    assert (scores[:2] < 0.1).all() and (scores[2:5] >= 0.3).all(), scores
    # Insults with inserted marks or letters pass the contract's threshold although only forty documents teach them.
    assert (scores[5:] >= toxicity.THRESHOLD).all() and (scores[5:] > 4 * scores[0]).all(), scores


def plain_words(text):
    """The words of a sentence as they are read: trimmed, joined, and apart ones as one."""
    words, run = [], []
    for word in [*text.lower().split(), ""]:
        letters = [k for k, c in enumerate(word) if c.isalnum() or c > "\x7f"]
        if len(word) == 1 and "a" <= word <= "z":
            run.append(word)
        else:
            words += ["".join(run)] * (len(run) >= 3)
            run = []
        if word:
            trimmed = word[letters[0] : letters[-1] + 1] if letters else word
            words.append(trimmed)
            if 3 <= len(letters) < len(trimmed):
                words.append("".join(word[k] for k in letters))
    return words


def test_document_scores_by_brute_force(spark):
    """Scores from the kernel's definition, without bound, memory or chunks."""
    m = machine(spark, "/root/testdata/sf0.01")
    marks = [w.decode() for w in m.marks.words]

    def kernel(a, b):
        raw = [plain_kernel(list(map(ord, x)), list(map(ord, y))) for x, y in ((a, b), (a, a), (b, b))]
        value = raw[0] / max((raw[1] * raw[2]) ** 0.5, 1e-12)
        return value if value >= toxicity.FLOOR else 0.0

    texts = ["what an id-iot", "such i d i o t here. fine", "Station! closes (loser)", "scumm", "i.d.i.o.t pathxetic", "", "the and", "st*upid. moron?"]
    raw = [t.encode() for t in texts]
    got = m.margins(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    again = m.margins(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for text, margin, second in zip(texts, got, again):
        margins = [m.base] if not text else []
        # A sentence ends behind the word that holds its end.
        sentences, now = [], []
        for word in text.split():
            now.append(word)
            if any(c in ".!?" for c in word):
                sentences.append(" ".join(now))
                now = []
        for sentence in [*sentences, *([" ".join(now)] if now else [])]:
            nearest = np.array([max(kernel(w, k) for w in plain_words(sentence)) for k in marks])
            margins.append(float(np.concatenate([nearest**p for p in toxicity.POWERS]) @ m.weights + m.base))
        assert abs(max(margins) - margin) < 1e-2 and margin == second, (text, margins, margin)


def test_bound_drops_no_near_word():
    """A word over the floor is never left out for the symbols it lacks."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(80)]
    marks = toxicity.Landmarks([w.encode() for w in words[:25]])
    rows = np.zeros((80, toxicity.LONGEST), np.uint16)
    for k, w in enumerate(words):
        rows[k, : len(w)] = list(map(ord, w))
    got = marks.kernel(rows, np.array([len(w) for w in words]))
    for i, a in enumerate(words):
        for j, b in enumerate(words[:25]):
            value = plain_kernel(a.encode(), b.encode()) / max((plain_kernel(a.encode(), a.encode()) * plain_kernel(b.encode(), b.encode())) ** 0.5, 1e-12)
            if abs(value - toxicity.FLOOR) > 1e-3:
                assert abs(got[i, j] - (value if value > toxicity.FLOOR else 0)) < 1e-3, (a, b)


def test_held_out_and_odd_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels if rows[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    clean = [p for p, y in held if not y]
    assert np.mean(clean) < 0.03 and np.mean([p == y for p, y in held]) > 0.93
    texts = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    marks = ("idiot", "moron", "loser", "stupid", "pathetic", "disgusting", "worthless", "trash", "scum", "clown")
    caught = [rows[r.doc_id].predicted for r in labels if rows[r.doc_id].held_out and r.toxic and any(w in texts[r.doc_id] for w in marks)]
    assert len(caught) >= 5 and np.mean(caught) >= 0.9, caught
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "a" * 5000, 1), (1, "a" * 5000, 1)], "doc_id long, text string, score int")
    m = machine(spark, sf_dir)
    assert [r.predicted for r in toxicity.score(odd, m).collect()] == [0, 0, 0, 0]
    assert toxicity.score(odd.limit(0), m).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(odd, empty) is None
    assert [r.score for r in toxicity.score(odd, None).collect()] == [0.0] * 4


def test_scripts_and_many_marks():
    """Marking words of any script, of up to 24 letters and of any number count."""
    clean = ["река течёт мимо города", "the garden is small", "天气 很好"]
    marks = ["идиот", "ηλίθιος", "أحمقكبير", "混蛋", "vollidiotenhaufen", "недоразумение"]
    rng = np.random.default_rng(5)
    marks += ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9)) for _ in range(80)]
    docs = [[f"{clean[k % 3]} {m}"] for m in marks for k in range(30)] + [[clean[k % 3]] for k in range(2600)]
    m = toxicity.fit(docs, np.arange(len(docs)) < 30 * len(marks), rounds=1)
    kernel = m.marks.kernel(m.marks.rows, m.marks.lengths)
    assert np.allclose(np.diag(kernel), 1, atol=1e-3) and {w.encode() for w in marks} <= set(m.marks.words)
    raw = [t.encode() for t in [*clean, *(f"{clean[0]} {w}" for w in marks), "ИДИОТ"]]
    scores = m.scores(m.margins(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    assert (scores[:3] < 0.3).all() and (scores[3:] >= 0.3).all(), scores
