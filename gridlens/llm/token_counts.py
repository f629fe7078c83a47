"""Token counts of flat token files by a separator scan.

A flat file holds the ids of many documents one after the other, each ended by an end-of-document id,
without any index. Files are cut into blocks that are read independently; a block finds its separators
in one vectorised comparison. Documents that cross blocks are stitched by a prefix scan over the blocks'
summaries (how many separators, where the last one is).

Ids behind the last separator of a file are an incomplete document. Files without ids have no documents;
bytes behind the last whole id are not read. Null and empty texts are documents without ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.bpe import Codec, default_vocabulary
from gridlens.llm.files import listing, open_store, publish
from gridlens.llm.registry import query, table
from gridlens.llm.text import string_chunks
from gridlens.session import scratch, scratch_folder, ship_package, stage

BLOCK_BYTES = 2 << 20
# Bytes that one task scans, about.
TASK_BYTES = 32 << 20
# Ids after which a task begins another file.
FILE_IDS = 16 << 20


def width_of(codec: Codec) -> str:
    """The narrowest little-endian id type of a vocabulary."""
    return "<u2" if len(codec.token_ends) - 1 <= 1 << 16 else "<u4"


def write_token_files(df: DataFrame, folder: str, codec: Codec, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the texts' ids as flat files; the stored order of each file: ``file, seq, key``.

    A file gets its name from its task and appears when it is whole, so a repeated task writes the same
    files again.
    """
    system, root = open_store(folder)
    system.create_dir(root, recursive=True)
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(codec)
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = width_of(codec)
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("seq", T.LongType()), rows.schema["_key"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, place = open_store(folder)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out, name, temporary, ids, seq, number = None, "", "", 0, 0, 0

        def close():
            out.close()
            publish(to, f"{place}/{temporary}", f"{place}/{name}")

        for batch in batches:
            files, places = [], []
            for _, _, data, offsets in string_chunks(batch.column(1)):
                flat, ends = shared.value.encode(data, offsets, special=False)
                n = len(offsets) - 1
                if out is None or ids >= FILE_IDS:
                    if out is not None:
                        close()
                    name, temporary = f"tokens-{task:05d}-{number:05d}.bin", f"_{task}-{attempt}-{number}"
                    out, ids, seq, number = to.open_output_stream(f"{place}/{temporary}"), 0, 0, number + 1
                packed = np.insert(flat, ends[1:], end).astype(kind)
                out.write(packed.tobytes())
                files += [name] * n
                places += range(seq, seq + n)
                ids, seq = ids + len(packed), seq + n
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(places, pa.int64()), batch.column(0)], names=["file", "seq", "_key"]
            )
        if out is not None:
            close()

    return stage(rows.mapInArrow(run, schema).withColumnRenamed("_key", key), "token-order")


def _separators(blocks: DataFrame, end: int, kind: str) -> DataFrame:
    """A row per separator: file, block, number in the block, its position and the one before it there."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = open_store(path)
                with system.open_input_file(place) as file:
                    raw = file.read_at(min(BLOCK_BYTES, length - block * BLOCK_BYTES), block * BLOCK_BYTES)
                ids = np.frombuffer(raw, kind, len(raw) // size)
                at = np.flatnonzero(ids == end) + block * (BLOCK_BYTES // size)
                n = len(at)
                before = pa.array(np.append(0, at)[:n], pa.int64(), mask=np.arange(n) == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array(np.full(n, block, np.int64)), pa.array(np.arange(n)), pa.array(at), before],
                    names=["path", "block", "i", "at", "before"],
                )

    return blocks.mapInArrow(run, T.StructType.fromDDL("path string, block long, i long, at long, before long"))


def scan_token_files(spark: SparkSession, folder: str, end: int, kind: str = "<u2") -> DataFrame:
    """``file, seq, first_token, n_tokens, complete`` of every document in the folder's files."""
    ship_package(spark)
    files, total = listing(spark, folder, "token-listing")
    blocks = files.where("length > 0").select(
        "path", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / BLOCK_BYTES))).alias("block"), "length"
    ).repartition(max(1, -(-total // TASK_BYTES)))
    found = stage(_separators(blocks, end, kind), "token-separators")
    summary = found.groupBy("path", "block").agg(F.count("*").alias("k"), F.max("at").alias("last"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = summary.select(
        "path", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"), F.max("last").over(before).alias("carry")
    )
    first = F.coalesce("before", "carry", F.lit(-1)) + 1
    whole = found.join(stitched, ["path", "block"]).select(
        "path", (F.col("base") + F.col("i")).alias("seq"), first.alias("first_token"), (F.col("at") - first).alias("n_tokens"),
        F.lit(True).alias("complete"),
    )
    ends = summary.groupBy("path").agg(F.sum("k").alias("seq"), F.max("last").alias("last"))
    size = F.floor(F.col("length") / np.dtype(kind).itemsize)
    start = F.coalesce("last", F.lit(-1)) + 1
    rest = files.join(ends, "path", "left").where(size > start).select(
        "path", F.coalesce("seq", F.lit(0)).alias("seq"), start.alias("first_token"), (size - start).alias("n_tokens"),
        F.lit(False).alias("complete"),
    )
    return whole.unionByName(rest).withColumn("file", F.element_at(F.split("path", "/"), -1)).drop("path").select(
        "file", "seq", "first_token", "n_tokens", "complete"
    )


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, scanned from flat files of their ids."""
    codec = Codec(default_vocabulary())
    end = max(codec.special.values())
    with scratch(spark):
        folder = scratch_folder(spark, "token-files")
        order = write_token_files(table(spark, sf_dir, "documents"), folder, codec, end)
        counts = scan_token_files(spark, folder, end, width_of(codec))
        found = counts.join(order, ["file", "seq"], "full").select("doc_id", "n_tokens", "file", "seq", "first_token", "complete")
        return stage(found, "token-counts", outer=True)
