"""Line deduplication by a deletion-neighbourhood join.

A line is the words between white space. Lines of ``min_words`` words or ``MIN_CHARS`` characters (without white
space) or more that equal an earlier line are removed, and so are lines of ``near_words`` or more within one edit
(inserted, deleted or replaced) of an earlier line; the earliest stays. The unit of an edit is a word; in lines of
fewer words that have characters of scripts without spaces it is a character, and ``NEAR_CHARS`` of them make a line
long enough. Order is by key, then line number; a line counts as earlier even where it is removed itself.

Every variant of a line with one unit deleted is hashed from running sums, with the place of the unit.
Lines that share a variant and the place differ by one replaced unit; a line that equals a variant lacks
one unit. Per variant only the earliest line is kept, so equal variants are aggregated and joined back,
never paired among themselves, and the edit distance to that earliest line is verified. Only lines that
share their first or second half with another line (any pair within one unit does) enter.

Null texts, lines without words and shorter lines stay as they are. Rows with equal key and text are
one document and lose the same lines; rows without a key come last. Keys are whole numbers. A text of any length is
one row, split where it is. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.quality import WHITE, let
from gridlens.llm.registry import query, table
from gridlens.llm.scratch import forget_shuffles
from gridlens.session import scratch, stage

MIN_WORDS = 5
MIN_CHARS = 10
NEAR_WORDS = 10
NEAR_CHARS = 20
# Scripts written without spaces, from the CJK radicals on, and South East Asian ones.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uD7A3\uF900-\uFAFF]"
LAST = 2**63 - 1
# Running sums of hashes of this many bits do not overflow for lines of eight million words.
SUM_BITS = 40


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, WHITE, -1), "")


def _dense(words: Column, near_words: int) -> Column:
    """Whether a line of few words has many characters and some of an unspaced script."""
    line = F.array_join(words, " ")
    return (F.size(words) < near_words) & (F.length(line) >= NEAR_CHARS) & line.rlike(UNSPACED)


def _characters(words: Column) -> Column:
    """The characters of a line, marked so that they equal no word."""
    return F.transform(F.split(F.array_join(words, " "), ""), lambda c: F.concat(F.lit("\x01"), c))


def _units(words: Column, near_words: int) -> Column:
    """What an edit changes: words, or characters in a dense line."""
    return F.when(_dense(words, near_words), _characters(words)).otherwise(words)


def _identity(df: DataFrame, key: str, text: str) -> list[Column]:
    k, t = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")
    return [F.coalesce(k, F.lit(LAST)).alias("_k"), F.xxhash64(k, t).alias("_h")]


def _halves(words: Column) -> Column:
    """Hashes of the first and last words, as many as half of the line or of its neighbours in length."""
    n = F.size(words)
    lengths = F.array_distinct(F.array(F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")))
    return F.flatten(F.transform(lengths, lambda m: F.array(
        F.xxhash64(F.lit("first"), m, F.slice(words, F.lit(1), m)),
        F.xxhash64(F.lit("last"), m, F.slice(words, n - m + 1, m)),
    )))


def _lines(df: DataFrame, key: str, text: str, min_words: int, near_words: int) -> DataFrame:
    """One row per line that may be removed: document, line number, word hash, length in units, half hashes."""
    def describe(line: Column, at: Column) -> Column:
        # Most lines have words enough; characters are looked at in the others only.
        return let(_words(line), lambda w: F.struct(
            at.cast("int").alias("at"),
            F.when(F.size(w) >= near_words, F.size(w)).otherwise(F.size(_units(w, near_words))).alias("n"), F.xxhash64(w).alias("line"),
            F.when(F.size(w) >= near_words, _halves(w)).when(_dense(w, near_words), let(_characters(w), _halves)).alias("halves"),
            ((F.size(w) >= min_words) | (F.length(F.array_join(w, "")) >= MIN_CHARS)).alias("long"),
        ))

    described = F.transform(F.split(F.col(f"`{text}`"), "\n", -1), describe)
    rows = df.select(*_identity(df, key, text), F.filter(described, lambda x: x["long"]).alias("_l"))
    # Not ``inline``: Spark puts a filter on the list before it, and that filter describes every line once more.
    return rows.select("_k", "_h", F.inline_outer("_l")).where("line is not null").drop("long")


def _near(df: DataFrame, distinct: DataFrame, key: str, text: str, near_words: int) -> DataFrame:
    """``line``: hashes of lines within one unit of an earlier line."""
    spark = df.sparkSession
    halves = distinct.where("halves is not null").select("line", F.explode("halves").alias("half"))
    often = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    may = halves.join(often, "half", "left_semi").select("line").distinct()
    wanted = stage(
        distinct.join(may, "line", "left_semi").select("line", "n", "first.*")
        .groupBy("_k", "_h").agg(F.collect_list(F.struct("at", "line", "n")).alias("_w")),
        "line-candidates",
    )
    texts = df.select(*_identity(df, key, text), F.col(f"`{text}`").alias("_t"))
    # One plan at every size, here and where the texts are put together again: a join by shuffle.
    fetched = texts.join(wanted.hint("merge"), ["_k", "_h"]).select(
        "_k", "_h", F.inline(let(F.split("_t", "\n", -1), lambda lines: F.transform(F.col("_w"), lambda w: F.struct(
            w["at"].alias("at"), w["line"].alias("line"), w["n"].alias("n"), let(_words(lines[w["at"]]), lambda x: _units(x, near_words)).alias("words")
        )))),
    )
    read = stage(fetched.dropDuplicates(["line"]), "line-words")
    forget_shuffles(spark)
    # Numbers in the order of the lines; they are stored, so they stay what they are.
    lines = stage(
        read.orderBy("_k", "_h", "at", "line").select("line", "n", "words", F.monotonically_increasing_id().alias("rank")),
        "line-ranks",
    )

    part = lambda *x: F.shiftrightunsigned(F.xxhash64(*x), 64 - SUM_BITS)
    each = lines.select("rank", "n", F.posexplode("words").alias("i", "word"))
    each = each.withColumn("here", part("word", "i")).withColumn("moved", part("word", F.col("i") - 1)).drop("word")
    whole = Window.partitionBy("rank")
    upto = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    since = whole.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum("here").over(upto), F.lit(0)) + F.coalesce(F.sum("moved").over(since), F.lit(0))
    deletions = each.select(F.xxhash64(left, F.col("n") - 1).alias("variant"), "i", "rank")
    itself = each.groupBy("rank", "n").agg(F.sum("here").alias("s")).select(
        F.xxhash64("s", "n").alias("variant"), F.lit(-1).alias("i"), "rank"
    )
    variants = stage(deletions.unionByName(itself), "line-variants")
    forget_shuffles(spark)
    often = variants.groupBy("variant").agg(F.count("*").alias("c")).where("c > 1").select("variant")
    equal = stage(variants.join(often, "variant", "left_semi"), "line-equal-variants")
    forget_shuffles(spark)
    placed = equal.groupBy("variant", "i").agg(F.min("rank").alias("least"))
    any_place = placed.groupBy("variant").agg(
        F.min("least").alias("any"), F.min(F.when(F.col("i") == -1, F.col("least"))).alias("whole")
    )
    earliest = F.when(F.col("i") == -1, F.col("any")).otherwise(F.least("least", "whole"))
    pairs = (
        equal.join(placed, ["variant", "i"]).join(any_place, "variant")
        .withColumn("other", earliest).where("other < rank")
        .groupBy("rank").agg(F.min("other").alias("other"))
    )
    mine = lines.select("rank", "line", F.col("words").alias("a"))
    theirs = lines.select(F.col("rank").alias("other"), F.col("words").alias("b"))
    verified = pairs.join(mine, "rank").join(theirs, "other").where(_within_one("a", "b"))
    return stage(verified.select("line"), "line-near", outer=True)


def _common(a: Column, b: Column) -> Column:
    """Leading words that two lists have in common."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differs, True)
    return F.when(first == 0, F.greatest(F.size(a), F.size(b))).otherwise(first - 1)


def _within_one(a: str, b: str) -> Column:
    """Whether two word lists are within one inserted, deleted or replaced word."""
    x, y = F.col(a), F.col(b)
    longest = F.greatest(F.size(x), F.size(y))
    return (F.abs(F.size(x) - F.size(y)) <= 1) & (_common(x, y) + _common(F.reverse(x), F.reverse(y)) >= longest - 1)


def dedup_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS
) -> DataFrame:
    """All columns of ``df`` with repeated lines cut from the text, ``_lines`` and ``_removed`` counts.

    Columns of these two names are replaced.
    """
    spark = df.sparkSession
    with scratch(spark):
        lines = stage(_lines(df, key, text, min_words, near_words), "lines")
        distinct = stage(
            lines.groupBy("line").agg(
                F.min(F.struct("_k", "_h", "at")).alias("first"), F.count("*").alias("c"),
                F.first("n").alias("n"), F.first("halves").alias("halves"),
            ),
            "line-distinct",
        )
        forget_shuffles(spark)
        with scratch(spark):
            near = _near(df, distinct, key, text, near_words).withColumn("near", F.lit(True))
        forget_shuffles(spark)
        affected = distinct.join(near, "line", "left").where("near or c > 1").select(
            "line", F.coalesce("near", F.lit(False)).alias("near"), F.col("first").alias("earliest")
        )
        gone = stage(
            lines.select("_k", "_h", "at", "line").join(affected, "line").where(
                F.col("near") | (F.struct("_k", "_h", "at") != F.col("earliest"))
            ).groupBy("_k", "_h").agg(F.collect_set("at").alias("_gone")),
            "line-gone", outer=True,
        )
    forget_shuffles(spark)
    kept = [c for c in df.columns if c not in ("_lines", "_removed")]
    source = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], *_identity(df, key, text))
    body = f"_c{kept.index(text)}"
    joined = source.join(gone.hint("merge"), ["_k", "_h"], "left")
    left = let(F.split(body, "\n", -1), lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: x[i]), "\n"
    ))
    new = F.when(F.col("_gone").isNull(), F.col(body)).otherwise(left)
    return joined.select(
        *[(new if f"_c{i}" == body else F.col(f"_c{i}")).alias(c) for i, c in enumerate(kept)],
        F.when(F.col(body).isNull(), 0).otherwise(F.size(F.split(body, "\n", -1))).cast("long").alias("_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_removed"),
    )


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that are earlier ones, or one word off."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), "text"
    )
