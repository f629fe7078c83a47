"""The rule ledger against a plain computation."""

import re

import numpy as np

from gridlens.llm import quality

TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h " * 5, "a b c d e f g h i", "\n\nx\nx\n x\n\ny",
    "#*$ %&|<> é漢 ok", "x " * 200, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " + "w1 w2 w3 w4 w5 w6 w7 w8 z", "\x0b\x0c a\r\nb\r\n a",
    "p q r s t u v w x y z " * 2 + "long" * 3000,
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)
    )


def test_measures(spark):
    rng = np.random.default_rng(1)
    texts = TEXTS + [" ".join(rng.choice(list("ab"), rng.integers(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept int")
    rows = {r.doc_id: r for r in quality.ledger(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert tuple(rows[i][m] for m in quality.MEASURES) == plain(text), text


def test_policies_and_ablations(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[8]), (8, TEXTS[8])], "doc_id long, text string")
    rows = quality.ledger(df)
    kept = quality.apply_policy(rows, 1).collect()
    for r in kept:
        assert r.kept == (r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words)
    got = {(r.policy, r.rule): r for r in quality.ablations(rows).collect()}
    bits = [r.fail_bits for r in kept]
    for version, rules in quality.POLICIES.items():
        full = quality.mask(rules)
        for rule in rules:
            r = got[version, rule]
            assert r.failed == sum(bool(b & quality.BIT[rule]) for b in bits)
            assert r.failed_alone == sum(b & full == quality.BIT[rule] for b in bits)
            assert r.policy_failed == sum(bool(b & full) for b in bits)
    assert quality.apply_policy(quality.ledger(df.limit(0))).count() == 0
