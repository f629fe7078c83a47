"""Gradients, the batched reading against a plain one, and held-out accuracy."""

import os
import zlib

import numpy as np

from gridlens.llm import language

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(network, text):
    """One segment at a time, one byte at a time."""
    w, h = network.weights, network.hidden
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    raw, total = text.encode(), np.zeros(len(network.languages))
    for low in range(0, len(raw), language.SEGMENT):
        piece = raw[low : low + language.SEGMENT]
        states = []
        for d, order in enumerate((piece, piece[::-1])):
            s, out = np.zeros(h), []
            for b in order:
                x, c = w["input"][d, b], s @ w["state"][d]
                z, r = sigmoid(x[:h] + c[:h]), sigmoid(x[h : 2 * h] + c[h : 2 * h])
                n = np.tanh(x[2 * h :] + r * (c[2 * h :] + w["bias"][d, 0]))
                s = (1 - z) * n + z * s
                out.append(s)
            states.append(out if d == 0 else out[::-1])
        for f, b in zip(*states):
            e = np.exp(f @ w["out"][0] + b @ w["out"][1] + w["base"])
            total += e / e.sum()
    return total / max(1, len(raw))


def test_gradients():
    net = language.Network(["a", "b", "c"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    segments, lengths = language.segments_of(["abcab", "ba", "ccé"], 6)
    labels = np.array([0, 1, 2])
    _, g = net.gradients(segments, lengths, labels)
    rng = np.random.default_rng(0)
    for name, w in net.weights.items():
        places = np.argwhere(np.abs(g[name]) > 1e-6)
        for at in map(tuple, places[rng.choice(len(places), min(6, len(places)), replace=False)]):
            kept = w[at]
            losses = []
            for step in (1e-3, -1e-3):
                w[at] = kept + step
                losses.append(net.gradients(segments, lengths, labels)[0])
            w[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-3 - g[name][at]) < 2e-4, (name, at)


def test_documents_equal_plain_reading():
    net = language.Network(["a", "b"])
    texts = ["short", "", "x" * 96, "long text é " * 40, "y" * 97]
    raw = [t.encode() for t in texts]
    got = net.documents(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for text, row in zip(texts, got):
        assert np.allclose(row, plain(net, text), atol=1e-4)


def test_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = language.op2_language_id(spark, SF_DIR).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    net = language.train(docs)
    odd = spark.createDataFrame(
        [(None, None, 1), (1, "", 1), (1, "12 345 !?", 1), (2, "the of and that with " * 3, 1), (2, "the of and that with " * 3, 1)],
        "doc_id long, text string, score int",
    )
    got = language.predict(odd, net).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en"]
    assert [r.score > 0 for r in got] == [False, False, False, True, True]
    assert language.predict(odd.limit(0), net).count() == 0
    nobody = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.train(nobody) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
