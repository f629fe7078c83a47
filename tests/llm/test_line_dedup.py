"""Kept lines against all pairs of lines."""

import re

import numpy as np
import pytest

from gridlens.llm import line_dedup


def distance_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    table = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(table[j] + 1, new[-1] + 1, table[j - 1] + (x != y)))
        table = new
    return table[-1] <= 1


def units(words, near_words):
    line = " ".join(words)
    dense = len(words) < near_words and len(line) >= line_dedup.NEAR_CHARS and re.search(line_dedup.UNSPACED, line)
    return [("c", c) for c in line] if dense else words


def plain(rows, min_words, near_words):
    """{key: text}; keys are unique and not null."""
    earlier, out = [], {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in text.split("\n") if text is not None else ():
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            long, mine = len(words) >= min_words or len("".join(words)) >= line_dedup.MIN_CHARS, units(words, near_words)
            drop = long and any(
                w == mine or (len(mine) >= near_words and len(w) >= near_words and distance_within_one(w, mine)) for w in earlier
            )
            if long:
                earlier.append(mine)
            if not drop:
                kept.append(line)
        out[key] = None if text is None else "\n".join(kept)
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = lambda n: rng.choice(["a", "b", "c", "dé", "e"] if n < 9 else [f"w{i}" for i in range(30)], n).tolist()
    lines = [words(rng.integers(0, 16)) for _ in range(40)] + [["x"] * n for n in (9, 10, 11, 12)]
    rows = []
    for key in range(60):
        text = []
        for _ in range(rng.integers(0, 8)):
            line = list(lines[rng.integers(0, len(lines))])
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(0, len(line) + 1)
                what = rng.integers(0, 3)
                line[at : at + int(what > 0)] = [str(rng.choice(["new", "w1", "x"]))] * int(what < 2)
            text.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((key, rng.choice(["\n", "\n\n"]).join(text)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, " ".join(["long"] * 3000)), (104, " ".join(["long"] * 2999))]


@pytest.mark.parametrize("seed,min_words,near_words", [(1, 5, 10), (2, 5, 10), (3, 1, 5)])
def test_lines(spark, seed, min_words, near_words):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in rows], "doc_id long, text string, line string, _k int")
    out = line_dedup.dedup_lines(df, min_words=min_words, near_words=near_words)
    assert out.columns == [*df.columns, "_lines", "_removed"]
    got = {r.doc_id: r.text for r in out.collect()}
    want = plain(rows, min_words, near_words)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_short_and_unspaced_lines(spark):
    """Boilerplate of few words, and lines of a script without spaces, equal or one character off."""
    rng = np.random.default_rng(7)
    chinese = ["".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 2000, n)) for n in (160, 25, 12, 9)]
    off = [chinese[0][:80] + "新" + chinese[0][81:], chinese[0][:3] + chinese[0][4:], chinese[1] + "増", chinese[2][:-1] + "x", chinese[1][:5] + "新新" + chinese[1][7:]]
    base = ["Subscribe now", "Read more about cookies", "ok", "a b", *chinese, "สวัสดีครับยินดีต้อนรับทุกท่าน", "one two three " + chinese[1]]
    rows = [(1, "\n".join(base)), (2, "\n".join(base)), (3, "\n".join([*off, "ok", "subscribe now", "own line here"])), (4, "one two three " + chinese[1][:-1])]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows, line_dedup.MIN_WORDS, line_dedup.NEAR_WORDS)
    assert got[1] == rows[0][1] and got[2] == "ok\na b\n" + chinese[3] and got[4] == ""
    assert got[3].split("\n") == [off[3], off[4], "ok", "subscribe now", "own line here"]


def test_odd_rows(spark):
    line = "this line has five words"
    rows = [(1, line), (1, line), (None, line + "\nand own words of its own"), (2, line), (3, None), (3, "")]
    got = sorted((r.doc_id or -1, r.text or "", r._removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, "and own words of its own", 1), (1, line, 0), (1, line, 0), (2, "", 1), (3, "", 0), (3, "", 0)]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_are_described_once(spark):
    """The plan splits a line into words once, and rows without lines to describe leave none."""
    line = " ".join(f"w{i}" for i in range(12))
    rows = [(1, line), (2, "own\n" + line + " more\nshort"), (3, "short\n\n"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup._lines(df, "doc_id", "text", line_dedup.MIN_WORDS, line_dedup.NEAR_WORDS)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count(line_dedup.WHITE) == 1
    assert sorted((r._k, r["at"], r.n) for r in lines.collect()) == [(1, 0, 12), (2, 1, 13)]
    got = {r.doc_id: (r.text, r._removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (line, 0), 2: ("own\nshort", 1), 3: ("short\n\n", 0), 4: (None, 0), 5: ("", 0)}
