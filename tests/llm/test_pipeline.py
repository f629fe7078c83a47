"""Every stage on small data with planted cases."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridlens.llm.bpe import default_vocabulary

SF_DIR = "/root/testdata/sf0.001"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [str(w) for w in rng.choice([f"the{i}of" for i in range(3000)], n)]


@pytest.fixture(scope="module")
def planted(spark):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    base = words(1, 200)
    near = [*base[:90], "changed", *base[91:]]
    rows = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(words(2, 150))),
        (5, " ".join(words(3, 80)) + "\n" + bench), (6, "123 456"), (7, None), (8, ""),
        (9, " ".join(words(4, 30)) + "\n" + " ".join(words(5, 20))), (10, " ".join(words(6, 30)) + "\n" + " ".join(words(5, 20))),
        (11, bench),
    ]
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 7) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")


def test_stages(spark, planted):
    texts = {r.doc_id: r.text for r in planted.collect()}
    keep = {r.doc_id for r in corpus_pipeline.language_id(spark, planted, SF_DIR).collect()}
    assert keep == {1, 2, 3, 4, 5, 9, 10, 11}

    lines = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, planted, SF_DIR).collect()}
    assert {1, 4, 5, 9, 10} <= set(lines) and not {2, 3, 11} & set(lines)
    assert lines[9] == texts[9] and lines[10] == texts[10].split("\n")[0]
    assert {6, 7, 8} <= set(lines)

    unique = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, planted, SF_DIR).collect()}
    assert unique == {1, 4, 5, 6, 7, 8, 9, 10, 11}
    named = corpus_pipeline.language_id(spark, planted.withColumn("lang_pred", planted.lang), SF_DIR)
    assert named.columns == [*planted.columns, "lang_pred"] and {(r.score, r.lang_pred) for r in named.collect()} == {(7, "en")}

    clean = {r.doc_id: r for r in corpus_pipeline.benchmark_decontamination(spark, planted, SF_DIR).collect()}
    assert 11 not in clean and clean[5].text.startswith(texts[5].split("\n")[0])
    assert clean[5].n_chars == len(clean[5].text) < len(texts[5])
    assert all(clean[k].text == texts[k] for k in (1, 2, 3, 4, 6, 9, 10))


def test_one_row_of_every_component(spark):
    """Texts are grouped, not keys: several texts of a key, and rows without a key."""
    a, b = words(1, 200), words(2, 200)
    near = [*b[:90], "changed", *b[91:]]
    rows = [(1, a), (2, a), (2, b), (None, a), (None, a), (3, near), (None, words(3, 50)), (None, words(3, 50)), (4, []), (4, []), (None, [])]
    docs = spark.createDataFrame([(k, " ".join(t), "x", 1) for k, t in rows], "doc_id long, text string, h string, score int")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    want = [("1", a), ("2", b), ("None", words(3, 50)), ("4", []), ("None", [])]
    assert got == sorted((k, " ".join(t)) for k, t in want)


def test_run(spark):
    library = Tokenizer.from_file(default_vocabulary())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert 0.5 * len(docs) < len(rows) <= len(docs)
    assert len({r.doc_id for r in rows}) == len(rows)
    same = 0
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        same += r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert same > 0.5 * len(rows)


def test_clashing_names(spark, planted):
    """Columns with the names of the operators' own pass through every stage."""
    extra = {c: F.lit("mine") for c in ("_lines", "_removed", "lang_pred", "_h", "h", "_hit", "_items", "_words", "_c0", "class")}
    docs = planted.withColumns(extra).where("doc_id in (1, 3, 4, 9, 10)")
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == "mine" for r in rows for c in extra)


def test_bounded_batches(spark):
    """Stages with Python workers exchange few megabytes of rows at a time, and a long row whole."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the words of "), 400).alias("text"), F.lit("en").alias("lang"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 1999, F.repeat("text", 2000)).otherwise(F.col("text")))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "b"])

    before = spark.conf.get(name)
    try:
        for step, function in corpus_pipeline.STAGES:
            if step != "line_dedup":
                spark.conf.set(name, "64m")
                function(spark, docs.limit(0), SF_DIR)
                found = docs.mapInArrow(sizes, "n long, b long").collect()
                assert sum(r.n for r in found) == 4000
                # A batch ends with the row that reaches the bound, so one holds the long row and less than the bound before it.
                *others, longest = sorted(r.b for r in found)
                assert others[-1] < 1.01 * most and 10_000_000 < longest < 10_500_000 + most
        spark.conf.set(name, "1m")
        corpus_pipeline.bpe_tokens(spark, docs.limit(0), SF_DIR)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_empty(spark, planted):
    docs = planted.limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF_DIR)
    assert docs.count() == 0
