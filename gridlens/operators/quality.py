"""Quality rules: filters, flags, reconciliation, deduplication and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Tolerance of the price components and installed capacity of zone 1 in MW.
COMPONENT_TOLERANCE = 0.05
ZONE1_CAPACITY = 20304

PRICE_COMPONENTS = ("lmp", "mcc", "mec", "mlc")

# Physical bounds (temperature in F, wind in mph, humidity in percent).
TEMPERATURE_BOUNDS = (-60, 120)
WIND_MAX = 200
HUMIDITY_BOUNDS = (0, 100)


def reconcile_prices(prices: DataFrame, tolerance: float = COMPONENT_TOLERANCE) -> DataFrame:
    """Drop rows with a missing component and flag those whose parts do not add up."""
    return with_price_gap(prices.dropna(subset=list(PRICE_COMPONENTS)), tolerance)


# Counters of a quality rule, in the order of reports.
COUNTERS = ("rows_read", "rows_kept", "rows_removed", "rows_mismatched")


def rule_counters(keep: Column, mismatch: Column | None = None) -> list[Column]:
    """Rows seen, kept and removed by a rule, and kept ones that do not reconcile, as metrics to observe."""
    kept = F.coalesce(keep, F.lit(False))
    bad = F.lit(False) if mismatch is None else kept & F.coalesce(mismatch, F.lit(False))
    counts = (F.count(F.lit(1)), F.count_if(kept), F.count_if(~kept), F.count_if(bad))
    return [count.alias(name) for count, name in zip(counts, COUNTERS)]


def with_price_gap(prices: DataFrame, tolerance: float = COMPONENT_TOLERANCE) -> DataFrame:
    """Prices with the difference between their parts and the price, and a flag beyond the tolerance."""
    gap = F.col("mec") + F.col("mcc") + F.col("mlc") - F.col("lmp")
    return prices.withColumn("lmp_check", gap).withColumn("lmp_check_flag", (F.abs("lmp_check") > tolerance).cast("int"))


def apply_rule(rows: DataFrame, not_negative: str | None, counters: Observation | str) -> DataFrame:
    """Rows that pass a feed's rule, counted on the way: no second pass over the source.

    With ``not_negative`` the rule wants that column present and not below zero; without, it wants all
    price components and flags prices that do not reconcile. ``counters`` receives :data:`COUNTERS`, under
    its name where it is a text. A map task that Spark repeats after losing an executor is counted again.
    """
    if not_negative:
        keep, flagged, mismatch = F.col(not_negative) >= 0, rows, None
    else:
        keep, flagged = ~any_null(PRICE_COMPONENTS), with_price_gap(rows)
        mismatch = F.col("lmp_check_flag") == 1
    return flagged.observe(counters, *rule_counters(keep, mismatch)).where(keep)


def keep_non_negative(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) >= 0)


def keep_positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > 0)


def rule_counts(df: DataFrame, keep: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows before, after and removed by a rule, in one pass."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(keep).alias("rows_after"),
        (F.count(F.lit(1)) - F.count_if(keep)).alias("rows_removed"),
    )


def with_capacity_flag(df: DataFrame, load: str, out: str, capacity: float = ZONE1_CAPACITY) -> DataFrame:
    return df.withColumn(out, (F.col(load) > capacity).cast("int"))


def weather_flags(temperature: str, dewpoint: str, wind: str, humidity: str) -> dict[str, Column]:
    """Physical-bounds flags by name; ``excessive_wind_speed_flag`` alone is not an error."""
    return {
        "dew_gt_temp_flag": F.col(dewpoint) > F.col(temperature),
        "temp_out_of_bounds_flag": ~F.col(temperature).between(*TEMPERATURE_BOUNDS),
        "neg_wind_speed_flag": F.col(wind) < 0,
        "excessive_wind_speed_flag": F.col(wind) > WIND_MAX,
        "rh_out_of_bounds_flag": ~F.col(humidity).between(*HUMIDITY_BOUNDS),
    }


def drop_flagged(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Keep rows on which every flag is false."""
    bad = F.lit(False)
    for flag in flags:
        bad = bad | F.col(flag)
    return df.where(~bad)


def flag_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Count and percent of rows per flag, one row per flag, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f)).alias(f) for f in flags]
    )
    pct = F.when(F.col("_rows") > 0, F.col("flagged") * 100.0 / F.col("_rows")).otherwise(0.0)
    return counts.unpivot("_rows", list(flags), "flag", "flagged").select("flag", "flagged", pct.alias("pct"))


def null_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """NULLs per column, wide, with the row count."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )


def any_null(columns: Sequence[str]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNull()
    return found


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``newest_by``.

    An aggregate with map-side combine, so copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*newest_by))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def completeness(df: DataFrame, ts: str, first: Column, last: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Hourly rows expected between two days (inclusive) against rows found."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_found"), first.alias("_f"), last.alias("_l"))
    expected = ((F.datediff(F.col("_l"), F.col("_f")) + 1) * 24).cast("long")
    return found.select(
        *keys, expected.alias("rows_expected"), "rows_found",
        (expected - F.col("rows_found")).alias("rows_missing"),
    )
