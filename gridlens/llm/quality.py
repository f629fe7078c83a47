"""Quality rules as a ledger of failure bits.

``ledger`` measures every whole text once and stores the measurements and one bit per failed rule.
Policies are versioned sets of rules; ``apply_policy`` and ``ablations`` read only the bits, so a new
policy never looks at a text again. All expressions are native.

Null and empty texts have no words and fail the word minimum. Every row gives one row; repeated rows
and ties are judged alike. Columns of the input that carry a ledger column's name are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.registry import query, table

WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Rules in bit order: a row fails where the condition holds.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "2 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 and 10 * n_dup_lines > 6 * n_lines",
    "long_words": "word_chars > 40 * n_words",
    "short_words": "10 * word_chars < 15 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols"),
    3: tuple(RULES),
}
CURRENT = 3


def mask(rules) -> int:
    return reduce(int.__or__, (BIT[name] for name in rules), 0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def count(ordered: Column) -> Column:
        alike = lambda one, k: ordered[k]["h"].eqNullSafe(one["h"])
        starts = F.array_sort(
            F.transform(
                F.filter(
                    F.transform(ordered, lambda one, k: F.struct(
                        one["i"].alias("i"),
                        (F.when(k > 0, alike(one, k - 1)).otherwise(False)
                         | F.when(k < F.size(ordered) - 1, alike(one, k + 1)).otherwise(False)).alias("twice"),
                    )),
                    lambda one: one["twice"],
                ),
                lambda one: one["i"],
            )
        )
        none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto"))
        return F.aggregate(
            starts, none,
            lambda sofar, at: F.struct(
                (sofar["words"] + at + WINDOW - F.greatest(at, sofar["upto"])).alias("words"),
                (at + WINDOW).alias("upto"),
            ),
        )["words"]

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, count))


def _words_part(text: Column) -> Column:
    """Struct of word count and words in repeated windows."""

    def windows(hashed: Column) -> Column:
        n = F.size(hashed)
        runs = F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashed, i, WINDOW))),
        )
        return F.struct(
            n.cast("long").alias("n_words"),
            F.coalesce(let(runs, lambda h: F.when(h.isNotNull(), _covered(h))), F.lit(0)).cast("long").alias("n_repeat_words"),
        )

    words = F.array_remove(F.split(text, WHITE, -1), "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _lines_part(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_WHITE))
    return let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` of every row, next to the row's other columns; the text goes."""
    made = {*MEASURES, "fail_bits", "_w", "_l", text.lower()}
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    measured = df.select(
        *others,
        _words_part(body).alias("_w"),
        _lines_part(body).alias("_l"),
        F.length(F.translate(body, WHITE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(*others, "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines")
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    return measured.withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(rows: DataFrame, version: int = CURRENT, column: str = "kept") -> DataFrame:
    """Add whether a ledger row passes every rule of a policy."""
    return rows.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(rows: DataFrame, versions=tuple(POLICIES)) -> DataFrame:
    """Per policy and rule: rows that fail it, and rows that would pass without it.

    Rows with equal bits are counted first, so what is shuffled has one row per bit pattern.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = F.array(*[
        F.struct(F.lit(v).alias("policy"), F.lit(mask(POLICIES[v])).alias("mask"), F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit"))
        for v in versions for r in POLICIES[v]
    ])
    case = patterns.select("fail_bits", "n", F.explode(cases).alias("c"))
    failing = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    some = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return case.groupBy("c.policy", "c.rule").agg(
        some(failing.bitwiseAND(F.col("c.bit")) != 0).alias("failed"),
        some(failing == F.col("c.bit")).alias("failed_alone"),
        some(failing != 0).alias("policy_failed"),
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d),
win AS (
    SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (
    SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT rid, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (rid, k)) GROUP BY rid),
m AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
    FROM w LEFT JOIN rep USING (rid)),
b AS (
    SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 2 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 10 * word_chars < 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
    FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits,
    (fail_bits & 3) = 0 AS kept_v1, (fail_bits & 7) = 0 AS kept_v2
FROM b
"""


@query("op5_quality_rules", OP5_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the three policies."""
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = apply_policy(apply_policy(apply_policy(rows), 1, "kept_v1"), 2, "kept_v2")
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[1]))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits", "kept_v1", "kept_v2",
    )
