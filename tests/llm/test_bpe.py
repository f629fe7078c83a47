"""Encoding against the tokenizers library, and the round trip."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridlens.llm import bpe
from gridlens.llm.text import string_chunks


@pytest.fixture(scope="module")
def path():
    return bpe.default_vocabulary()


def test_class_table_in_small_memory():
    """Every worker builds the table; it needs few times the code points' bytes, and is right for each kind."""
    tracemalloc.start()
    classes = bpe.character_classes.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    assert [classes[ord(c)] for c in "aß漢\U0001e943 \n\u3000½٣\U0001f600'"] == [
        *[bpe.LETTER] * 4, *[bpe.SPACE] * 3, *[bpe.NUMBER] * 2, *[bpe.OTHER] * 2
    ]
    assert classes[0xD7FF] == classes[0xD800] == classes[0xDFFF] == classes[0xE000] == bpe.OTHER


CASES = [
    None, "", " ", "  ", "\n", "a", "it's we're I'll he'd'm 'tis ''s 's  's \t's", "  two  blanks \n\n next\r\n ",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>  ", "<|endoftext", "aaaaaaaaaaaaa bbbb aaaa",
    "Straße naïve Ñandú 漢字かな ١٢٣ ½ ² Ⅷ 👩‍👩‍👧 é  x y\u0085z \x1c\x1f q", "x" * 3000, "tail   ", "don'T 'S '1",
    "'re", "'r", "a'", "a'l", "a'll'll", "12ab34  56 .,!? ...x", "\x00\x01", "the " * 4000,
]


def ids_of(codec, texts, special=True):
    out = []
    for _, _, data, offsets in string_chunks(pa.array(texts, pa.string()), 200):
        flat, ends = codec.encode(data, offsets, special)
        out += [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
    return out


def test_ids_equal_the_library(path):
    codec, library = bpe.Codec(path), Tokenizer.from_file(path)
    for case, ids in zip(CASES, ids_of(codec, CASES)):
        assert ids == library.encode(case or "", add_special_tokens=False).ids, case
    library.encode_special_tokens = True
    for case, ids in zip(CASES, ids_of(codec, CASES, False)):
        assert ids == library.encode(case or "", add_special_tokens=False).ids, case


def test_every_character(path):
    codec, library = bpe.Codec(path), Tokenizer.from_file(path)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c} " for c in every[i : i + 2000]) for i in range(0, 0x30000, 2000)]
    wrong = [
        (i, t) for i, (t, ids) in enumerate(zip(texts, ids_of(codec, texts)))
        if ids != library.encode(t, add_special_tokens=False).ids
    ]
    assert not wrong, [i for i, _ in wrong]


def test_random_strings(path):
    codec, library = bpe.Codec(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    letters = list("abcdest'lrvm  \n\t1.é漢")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    assert ids_of(codec, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_frames(spark, path):
    library = Tokenizer.from_file(path)
    rows = [(i, t, "old") for i, t in enumerate(CASES)] + [(None, "null key", "old"), (3, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(df, path)
    assert encoded.columns == ["doc_id", "text", "ids"]
    back = bpe.decode(encoded, path, output="back").collect()
    assert len(back) == len(rows)
    assert all(r.back == (r.text or "") for r in back)
    for r in bpe.digests(df, path).collect():
        if r.doc_id is not None and r.doc_id != 3:
            text = CASES[r.doc_id] or ""
            ids = library.encode(text, add_special_tokens=False).ids
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(df.limit(0), path).count() == 0
