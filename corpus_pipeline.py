"""The corpus pipeline: language, lines, near duplicates, benchmark passages, tokens.

Every stage gets the table that its predecessor kept and returns the same columns; the last one returns
token counts and digests. Between stages the table is written to the shared folder and read again.

Null and empty texts are rejected by the first stage, as are texts without a letter. The near-duplicate stage
groups texts, not keys: rows without a key and several texts of one key are documents like others, and of repeated rows
one stays. Columns beyond those of ``documents``, whatever their names, pass through every stage but the last.

All stages run in one application, whose executors keep the heap they once had. What is outside of it, the rows exchanged
with Python workers, is bounded by every stage that has such workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import bpe, decontamination, language, line_dedup, ngram_jaccard
from gridlens.llm.quality import NOT_WHITE
from gridlens.session import bound_batches, scratch, stage

# Mean probability of the found language below which a text is in none of the learnt ones.
LANGUAGE_SCORE = 0.35
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80
# Prefixes at this similarity are long; indexing one and a half of them keeps the index within the disk.
INDEXED_TENTHS = 15


def _sized(docs: DataFrame) -> DataFrame:
    """The number of characters follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _apart(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of the given names called otherwise, and what gives them their names back."""
    taken = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c in names}
    return docs.withColumnsRenamed(taken), [F.col(f"`{taken.get(c, c)}`").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learnt language."""
    bound_batches(spark)
    network = language.train(docs.where(~language.held_out()))
    apart, columns = _apart(docs, ("lang_pred", "score"))
    found = language.predict(apart, network)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select(*columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines; documents of which nothing is left go."""
    apart, columns = _apart(docs, ("_lines", "_removed"))
    left = line_dedup.dedup_lines(apart).where((F.col("_removed") == 0) | F.col("text").rlike(NOT_WHITE))
    return _sized(left.select(*columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the smallest key."""
    bound_batches(spark)
    return ngram_jaccard.first_of_components(docs, size=SHINGLE_WORDS, percent=SHINGLE_PERCENT, tenths=INDEXED_TENTHS).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; documents of which nothing is left go."""
    bound_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _sized(decontamination.decontaminate(docs, benchmark, keep_emptied=False))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    bound_batches(spark)
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("bpe", bpe_tokens),
]

# A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, function in STAGES[:-1]:
            docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        return stage(STAGES[-1][1](spark, docs, sf_dir), "pipeline-tokens", outer=True)
