"""Documents found in flat files against a plain split, and counts against the tokenizers library."""

import os

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridlens.llm import token_counts
from gridlens.llm.bpe import Codec, default_vocabulary

END = 9


def plain(ids):
    out, start = [], 0
    for at, x in enumerate(ids):
        if x == END:
            out.append((len(out), start, at - start, True))
            start = at + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("kind,block", [("<u2", 2 << 20), ("<u2", 64), ("<u4", 40)])
def test_scan(spark, tmp_path, monkeypatch, kind, block):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", block)
    rng = np.random.default_rng(block)
    files = {f"f{k}": rng.integers(0, 12, rng.integers(0, 400)) for k in range(8)}
    files |= {"none": np.zeros(0, int), "long": np.full(1000, 3), "ends": np.full(200, END), "one": np.array([END])}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype(kind).tobytes())
    (tmp_path / "odd").write_bytes(np.array([1, END], kind).tobytes() + b"\x01")
    got = {}
    for r in token_counts.scan_token_files(spark, str(tmp_path), END, kind).collect():
        got.setdefault(r.file, []).append((r.seq, r.first_token, r.n_tokens, r.complete))
    want = {k: plain(v) for k, v in files.items() if len(v)} | {"odd": [(0, 0, 1, True)]}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_written_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_counts, "FILE_IDS", 50)
    codec, library = Codec(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    library.encode_special_tokens = True
    texts = [None, "", "a b c", "<|endoftext|> in text", "é" * 500, "same", "same"] * 9
    rows = [(i % 50, t, 1) for i, t in enumerate(texts)] + [(None, "no key", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, seq int").repartition(3)
    folder = str(tmp_path / "flat")
    order = token_counts.write_token_files(df, folder, codec, 50256)
    assert all(name.endswith(".bin") for name in os.listdir(folder) if not name.startswith("."))
    found = token_counts.scan_token_files(spark, folder, 50256).join(order, ["file", "seq"], "full").collect()
    want = sorted(
        (-1 if k is None else k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in found) == want
    assert all(r.complete for r in found)
    none = token_counts.write_token_files(df.limit(0), str(tmp_path / "none"), codec, 50256)
    assert none.count() == 0 and token_counts.scan_token_files(spark, str(tmp_path / "none"), 50256).count() == 0
