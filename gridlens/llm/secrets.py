"""Secret scans with multipart credential linking.

Base parts (assignments, access identifiers, long hex strings) are always reported. Weak parts (other
identifiers, mixed tokens that look like keys, endpoints) are reported only where complementary parts
lie within the same scope: an identifier with a secret, a secret with an identifier or an endpoint, an
endpoint with both. A part's scope is the interval of ``SCOPE`` code points before and after it; parts
are linked by an interval join on scope-wide bins. Everything is native.

Null and empty texts have no parts; a text of any length is one row of its own parts. Every row gives one row: rows with
equal key and text share one scan. Other columns do not matter and may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.registry import query, table

SCOPE = 400

# Fixed patterns of the base parts; group 2 of an assignment is its value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LONG = r"[0-9a-f]{24}"

# Weak parts, reported only next to complementary parts. Identifiers are known by a name before them, or by their shape:
# temporary and role access identifiers, identifiers in groups of hexadecimal digits, and the user in a URL. A secret is a
# token of mixed classes, or the password in a URL.
IDENTIFIER = (
    r"""(?i:\b(?:(?:access|client|user|account|tenant|app|application|project|subscription|service|key|api)[_\x20-]?"""
    r"""(?:access|account|key)?[_\x20-]?(?:id|name|identifier)|user|account|login|e?-?mail)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,})"""
    r"""|\b(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{12,}"""
    r"""|\b[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\b"""
    r"""|(?<=://)[A-Za-z0-9._%+-]+(?=:[^\x09-\x0D\x20/@"'<>]+@)"""
)
KEY = (
    r"(?<![A-Za-z0-9/+_=-])(?=[A-Za-z/+_-]*+[0-9])(?=[a-z0-9/+_-]*+[A-Z])(?=[A-Z0-9/+_-]*+[a-z])[A-Za-z0-9/+_-]{20,}+"
    r"""|(?<=://[A-Za-z0-9._%+-]{1,64}:)[^\x09-\x0D\x20/@"'<>]+(?=@)"""
)
ENDPOINT = r"""(?i:[a-z][a-z0-9+.-]{1,15})://[^\x09-\x0D\x20"'<>]{3,}"""

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "key", "endpoint")
IS_IDENTIFIER, IS_SECRET, IS_ENDPOINT = ("access", "identifier"), ("assign", "hex", "key"), ("endpoint",)


def _found(text: Column, kind: str, pattern: str, value: Column | None = None, least: int = 0, present: str = "") -> Column:
    """Array of (kind order, number, text before since the last match, match length, kept)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if value is None else value
    parts = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("len"))),
        values,
        lambda part, v: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), part["gap"].alias("gap"), part["len"].alias("len"),
            (F.length(v) >= least).alias("kept"),
        ),
    )
    # The piece after the last match has no partner.
    return F.when(text.rlike(present or pattern), F.filter(parts, lambda p: p["len"].isNotNull()))


def parts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per part: key, text hash, kind number and span in code points (end exclusive)."""
    rows = df.select(
        F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.col(f"`{text}`").alias("_text"),
    )
    t = F.col("_text")
    found = [
        _found(t, "assign", ASSIGN, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), 6),
        _found(t, "access", ACCESS, least=20),
        _found(t, "hex", HEX, least=24, present=HEX_LONG),
        _found(t, "identifier", IDENTIFIER),
        _found(t, "key", KEY),
        _found(t, "endpoint", ENDPOINT),
    ]
    return _spans(rows, found)


def _spans(rows: DataFrame, found: list[Column]) -> DataFrame:
    from pyspark.sql import Window

    listed = rows.select("_key", "_hash", F.array(*found).alias("_kinds")).where(
        F.exists("_kinds", lambda part: part.isNotNull())
    )
    flat = listed.select(
        "_key", "_hash", F.posexplode(F.flatten(F.filter("_kinds", lambda part: part.isNotNull()))).alias("_n", "_p")
    ).select("_key", "_hash", "_n", "_p.*").dropDuplicates(["_key", "_hash", "_n"])
    before = Window.partitionBy("_key", "_hash", "kind").orderBy("_n")
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    return (
        flat.withColumn("end", end).where("kept")
        .select("_key", "_hash", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    )


def _near(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Rows of ``left`` with a part of ``right`` within ``reach`` code points; both lie in all of their bins."""
    bins = right.select(
        F.col("_key").alias("_k"), F.col("_hash").alias("_h"), F.col("start").alias("_s"), F.col("end").alias("_e"),
        F.explode(F.sequence(
            F.floor((F.col("start") - reach) / SCOPE), F.floor((F.col("end") + reach) / SCOPE)
        )).alias("_bin"),
    )
    binned = left.withColumn("_at", F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))))
    meets = (
        F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")) & (F.col("_at") == F.col("_bin"))
        & (F.col("start") < F.col("_e") + reach) & (F.col("end") > F.col("_s") - reach)
    )
    return binned.join(bins, meets, "left_semi").drop("_at").distinct()


def link(found: DataFrame) -> DataFrame:
    """The reported parts: base ones, and weak ones with complementary parts in their scope."""
    of = lambda kinds: F.col("kind").isin([KINDS.index(k) for k in kinds])
    base, weak = found.where(of(BASE)), found.where(~of(BASE))
    # A weak part that overlaps a base part is the same thing seen twice. A long part is compared
    # over all of its bins.
    weak = _apart(weak, base)
    every = base.unionByName(weak)
    identifiers, secrets, endpoints = (every.where(of(k)) for k in (IS_IDENTIFIER, IS_SECRET, IS_ENDPOINT))
    weak_identifiers = _near(weak.where(of(("identifier",))), secrets, SCOPE)
    weak_keys = _near(weak.where(of(("key",))), identifiers.unionByName(endpoints), SCOPE)
    weak_endpoints = _near(
        _near(weak.where(of(("endpoint",))), identifiers, SCOPE), secrets, SCOPE
    )
    return reduce(DataFrame.unionByName, [base, weak_identifiers, weak_keys, weak_endpoints])


def _apart(weak: DataFrame, base: DataFrame) -> DataFrame:
    """Weak parts that overlap no base part."""
    hit = base.select(
        F.col("_key").alias("_k"), F.col("_hash").alias("_h"), F.col("start").alias("_s"), F.col("end").alias("_e"),
        F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))).alias("_bin"),
    )
    cut = weak.withColumn("_at", F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))))
    meets = (
        F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")) & (F.col("_at") == F.col("_bin"))
        & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))
    )
    bad = cut.join(hit, meets, "left_semi").select(
        F.col("_key").alias("_k"), F.col("_hash").alias("_h"), F.col("kind").alias("_kd"), F.col("start").alias("_s")
    ).distinct()
    same = (
        F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))
        & (F.col("kind") == F.col("_kd")) & (F.col("start") == F.col("_s"))
    )
    return weak.join(bad, same, "left_anti")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, counts of base parts, ``base_spans`` and ``spans`` as ``kind:start:end`` lists."""
    from gridlens.session import stage

    found = stage(parts(df, key, text), "secret-parts")
    names = F.array(*map(F.lit, KINDS))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    show = lambda items: F.array_join(
        F.transform(items, lambda p: F.concat_ws(":", names[p["kind"]], p["start"].cast("string"), p["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("_all", lambda p: p["kind"] == KINDS.index(kind))).cast("long")
    per_text = link(found).groupBy("_key", "_hash").agg(listed.alias("_all")).select(
        F.col("_key").alias("_k"), F.col("_hash").alias("_h"),
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        show(F.filter("_all", lambda p: p["kind"] < len(BASE))).alias("base_spans"), show(F.col("_all")).alias("spans"),
    )
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"))
    joined = rows.join(per_text, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    return joined.select(
        F.col("_key").alias(key),
        *[F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in BASE],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


@query("op9_secret_scans")
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text."""
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )
