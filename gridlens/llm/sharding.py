"""Sharding by proportional stratified interleaving.

Rows get a seeded random key within their source; the fractional rank (rank over the source's size)
orders all rows, so every stretch of that order has the sources' mixture, and equal cuts of it are the
shards. Ranks come from range partitions of the whole order, ties included, whose counts are added up in a small
table, so no source, no repeated key and no fraction that many sources share is held by one task.

The law is ``rows``: shard sizes differ by one row at most. Null texts count no bytes and have checksum
0, texts of any length their own; rows without a source form a source of their own; rows without a key are ranked like
others. Repeated rows are placed one by one, in any order. An empty table has no shards. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.ranks import numbered
from gridlens.llm.registry import query, table
from gridlens.session import scratch, stage

# Bits of the random key that decide the order of a source.
KEY_BITS = 48


def interleave(
    df: DataFrame, shards: int, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """``key, source, size, text_crc32, shard, slot`` of every row."""
    body, name = F.col(f"`{text}`"), F.col(f"`{source}`").cast("string")
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))))
    ties = ["r", "k", "text_crc32", "bytes", "row"]
    with scratch(df.sparkSession):
        rows = stage(
            df.select(
                F.col(f"`{key}`").alias("k"), F.coalesce(F.concat(F.lit("="), name), F.lit("null")).alias("s"),
                (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("bytes"),
                F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
                F.conv(F.substring(seeded, 1, KEY_BITS // 4), 16, 10).cast("long").alias("r"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "shard-rows",
        )
        ranked = numbered(rows, "s", ties, "shard-source")
        placed = ranked.withColumn("f", (2 * F.col("pos") + 1) / (2 * F.col("size"))).drop("pos", "size")
        placed = stage(placed.withColumn("all", F.lit(0)), "shard-fractions")
        at = numbered(placed, "all", ["f", "s", *ties], "shard-all")
        shard = f"(pos * {shards}) div size"
        return stage(
            at.select(
                F.col("k").alias(key), F.when(F.col("s") != "null", F.substring("s", 2, 1 << 30)).alias(source),
                F.col("bytes").alias("size"), "text_crc32", F.expr(shard).cast("int").alias("shard"),
                F.expr(f"pos - (({shard}) * size + {shards - 1}) div {shards}").alias("slot"),
            ),
            "shards", outer=True,
        )


SHARDS = 24

OP3_SQL = """
WITH RECURSIVE step AS (
    SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
h AS (SELECT doc_id, source, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (
    SELECT doc_id, source, n + 8 AS size, ('0x' || md5('7:' || doc_id)[1:12])::BIGINT AS r,
        list_transform(range(1, 2 * n, 2), lambda p: ('0x' || substring(h, p, 2))::BIGINT) AS bytes
    FROM h),
e AS (
    SELECT doc_id, source, size, r, xor(4294967295, list_reduce(
        list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32
    FROM d, crc),
f AS (
    SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY r, doc_id) - 1)::DOUBLE
        / (2 * count(*) OVER (PARTITION BY source)) AS f FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY f, source, r, doc_id) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 24 // n)::INTEGER AS shard,
    (place - ((place * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM g
"""


@query("op3_sharding", OP3_SQL)
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts and equal mixture."""
    return interleave(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
