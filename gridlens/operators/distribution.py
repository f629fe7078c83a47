"""Exact quantiles, histograms, ECDF and profiles that stay distributed for hot groups.

Spark's ``percentile`` keeps all distinct values of a group in one task. Here values fall
into ordered slices by plain arithmetic, slices are counted with partial aggregation, and
only the slices that hold a wanted rank are sorted. Exact for any input.

The small tables computed on the way (slices with a wanted rank, ranges of groups) are
stored before they are joined to the rows. Spark then knows their real size: it broadcasts
them below its threshold and shuffles above it, instead of shuffling every row by group
because the size of an aggregate is not known while planning.

Groups are structs of their keys inside, in which NULL equals NULL: a NULL group is a group like any
other. NULL and NaN values are ignored everywhere; histograms also leave out infinities.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.numbers import bin_edge, equal_width_bin, histogram_bin, magnitude_slice, order_slice
from gridlens.session import stage

SLICES = 4096
EXPAND_STEP = 100_000


def _values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.select(*_packed(keys), x.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def _packed(keys: Sequence[str]) -> list[Column]:
    return [F.struct(*keys).alias("_g")] if keys else []


def _group(keys: Sequence[str]) -> list[str]:
    return ["_g"] if keys else []


def _unpacked(keys: Sequence[str]) -> list[Column]:
    return [F.col("_g").getField(k).alias(k) for k in keys]


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def _range(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Finite range and number of values of each group."""
    return rows.groupBy(*group).agg(
        F.min(_finite(F.col("_v"))).alias("_low"), F.max(_finite(F.col("_v"))).alias("_high"), F.count("_v").alias("_n")
    )


def with_group_values(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of a one-row-per-group table; without keys, of a one-row table.

    NULL keys match each other. The table is stored first, so that Spark joins it by its real
    size. Without keys it is a scalar subquery: a join without a key could broadcast the wrong side.
    """
    if keys:
        small = stage(groups, "groups")
        theirs = small.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
        return rows.join(theirs, same, how).drop(*[f"_{i}" for i in range(len(keys))])
    packed = rows.withColumn("_row", groups.select(F.struct(*groups.columns)).scalar())
    return packed.select(*rows.columns, *[F.col(f"_row.{c}").alias(c) for c in groups.columns])


def _up_to(partition: Sequence[str], order: str):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    method: str = "linear",
    slices: int = SLICES,
) -> DataFrame:
    """One row per group with a column per entry of ``probs``.

    ``method`` is ``linear`` (interpolate between neighbours) or ``nearest`` (rank
    ``(n - 1) * p`` rounded half up). NULL and NaN values are ignored; groups without values
    are absent. With no ``keys`` the result has one row, or none for an empty input.

    The rows are read twice. The first pass counts slices by magnitude, which needs no
    knowledge of the data; the second takes the slices with a wanted rank and cuts each into
    ``slices`` equal parts of its own range before sorting.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method: {method}")
    group = _group(keys)
    rows = _values(df, keys, value).withColumn("_slice", magnitude_slice(F.col("_v")))

    def rank(n: Column, p: float) -> Column:
        return (n - 1) * F.lit(float(p))

    def wanted_ranks(n: Column) -> list[Column]:
        if method == "nearest":
            return [F.round(rank(n, p)).cast("long") for p in probs.values()]
        return [f(rank(n, p)).cast("long") for p in probs.values() for f in (F.floor, F.ceil)]

    counts = rows.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    whole = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    ranked = counts.select(
        "*", F.sum("_c").over(_up_to(group, "_slice")).alias("_end"), F.sum("_c").over(whole).alias("_n")
    ).withColumn("_begin", F.col("_end") - F.col("_c"))
    ranks = F.array_distinct(F.array(*wanted_ranks(F.col("_n"))))
    within = F.filter(ranks, lambda r: (r >= F.col("_begin")) & (r < F.col("_end")))
    picked = stage(
        ranked.select(*group, "_slice", "_begin", "_n", "_low", "_high", within.alias("_ranks")).where(
            F.size("_ranks") > 0
        ),
        "slices",
    )

    in_slice, in_part = [*group, "_slice"], [*group, "_slice", "_part"]
    part = equal_width_bin(F.col("_v"), F.col("_low"), F.col("_high"), slices)
    distinct = (
        rows.join(picked.select(*in_slice, "_low", "_high"), in_slice)
        .groupBy(*in_slice, part.alias("_part"), "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    sizes = distinct.groupBy(*in_part).agg(F.sum("_c").alias("_size"))
    offsets = sizes.select(
        *in_part, (F.sum("_size").over(_up_to(in_slice, "_part")) - F.col("_size")).alias("_offset")
    )
    ordered = (
        distinct.withColumn("_in", F.sum("_c").over(_up_to(in_part, "_v")))
        .join(offsets, in_part)
        .join(picked.select(*in_slice, "_begin", "_n", "_ranks"), in_slice)
        .withColumn("_to", F.col("_begin") + F.col("_offset") + F.col("_in"))
    )
    hits = F.filter("_ranks", lambda r: (r >= F.col("_to") - F.col("_c")) & (r < F.col("_to")))
    found = ordered.select(*group, "_n", F.explode(hits).alias("_rank"), "_v")
    # At most two ranks per probability reach this map.
    joined = found.groupBy(*group).agg(
        F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"),
        F.max("_n").alias("_n"),
    ).where(F.col("_n") > 0)

    def at(r: Column) -> Column:
        return F.element_at("_at", r.cast("long"))

    def quantile(p: float) -> Column:
        r = rank(F.col("_n"), p)
        if method == "nearest":
            return at(F.round(r))
        low, high = at(F.floor(r)), at(F.ceil(r))
        return F.when(low == high, low).otherwise(low + (high - low) * (r - F.floor(r)))

    return joined.select(*_unpacked(keys), *[quantile(p).alias(name) for name, p in probs.items()])


def equal_width_histogram(
    df: DataFrame,
    value: str,
    bins: int,
    keys: Sequence[str] = (),
    density: bool = False,
    include_empty: bool = False,
) -> DataFrame:
    """Counts per bin between a group's minimum and maximum.

    Bins are left-closed by their computed edges and the maximum falls into the last one. A group with a single
    distinct value gets a range of one unit around it. ``bin_center`` is the true midpoint.
    """
    group = _group(keys)
    rows = _values(df, keys, value).where(F.abs("_v") < float("inf"))
    flat = F.col("_low") == F.col("_high")
    half = F.when(flat, 0.5).otherwise(0.0)
    span = _range(rows, group).select(
        *group, (F.col("_low") - half).alias("_low"), (F.col("_high") + half).alias("_high"), "_n"
    )
    counts = (
        with_group_values(rows, span, group)
        .withColumn("bin", histogram_bin(F.col("_v"), F.col("_low"), F.col("_high"), bins))
        .groupBy(*group, "bin")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.max("_low").alias("_low"),
            F.max("_high").alias("_high"),
            F.max("_n").alias("_n"),
        )
    )
    if include_empty:
        grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        counts = grid.join(counts.select(*group, "bin", "count"), [*group, "bin"], "left").fillna(
            0, ["count"]
        )
    width = (F.col("_high") - F.col("_low")) / bins
    left = bin_edge(F.col("_low"), F.col("_high"), bins, F.col("bin"))
    columns = [
        F.col("bin").cast("long").alias("bin"),
        left.alias("bin_left"),
        (left + width).alias("bin_right"),
        (left + width / 2).alias("bin_center"),
        "count",
    ]
    if density:
        columns.append((F.col("count") / (F.col("_n") * width)).alias("density"))
    return counts.select(*_unpacked(keys), *columns)


def empirical_cdf(
    df: DataFrame, keys: Sequence[str], value: str, slices: int = SLICES, step: int = EXPAND_STEP
) -> DataFrame:
    """Every observation with its rank and ``rank / n``; ties get consecutive ranks.

    Equal values are counted before anything is sorted. The ranks of a repeated value are
    written out in pieces of ``step`` that are redistributed, so one value holding a third
    of a sample does not stay in one task.
    """
    group = _group(keys)
    rows = _values(df, keys, value)
    span = _range(rows, group)
    distinct = rows.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    sliced = with_group_values(distinct, span, group).withColumn(
        "_slice", order_slice(F.col("_v"), F.col("_low"), F.col("_high"), slices)
    )
    sizes = sliced.groupBy(*group, "_slice").agg(F.sum("_c").alias("_size"))
    earlier = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *group, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    in_slice = (
        Window.partitionBy(*group, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ends = (
        sliced.withColumn("_in", F.sum("_c").over(in_slice))
        .join(offsets, [*group, "_slice"])
        .withColumn("_to", F.col("_offset") + F.col("_in"))
        .withColumn("_from", F.col("_to") - F.col("_c") + 1)
    )
    pieces = ends.select(
        *group, "_v", "_n", "_to",
        F.explode(F.sequence(F.col("_from"), F.col("_to"), F.lit(step).cast("long"))).alias("_piece"),
    )
    spread = pieces.repartition(*group, "_piece")
    last = F.least(F.col("_piece") + step - 1, F.col("_to"))
    return spread.select(
        *group, F.col("_v").alias(value), "_n",
        F.explode(F.sequence(F.col("_piece"), last)).alias("rank"),
    ).select(*_unpacked(keys), value, "rank", (F.col("rank") / F.col("_n")).alias("cdf"))


def profile(
    df: DataFrame, columns: Sequence[str], percentiles: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Count, nulls, mean, deviation, extremes and exact percentiles, one row per column."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "metric", "_x"
    )
    group = [*keys, "metric"]
    basic = long.groupBy(*group).agg(
        F.count("_x").alias("count"),
        F.count_if(F.col("_x").isNull()).alias("null_count"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
    )
    return with_group_values(basic, exact_quantiles(long, group, "_x", percentiles), group, "left")


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Five-number summary and size per group."""
    ends = df.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count")
    )
    middle = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return with_group_values(ends, middle, keys, "left")
