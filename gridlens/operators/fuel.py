"""Fuel mix: day-ahead against real-time, flags, and summaries by temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.labels import REGIMES, SCARCITY_REGIMES
from gridlens.functions.numbers import ratio, share
from gridlens.functions.timeparts import is_winter
from gridlens.operators.distribution import exact_quantiles, with_group_values
from gridlens.operators.quality import latest_per_key

# Fuels compared, share of the plan that counts as a miss, low-output quantile.
FUELS = {
    "TotalMW": "totalMw", "CoalMW": "coal", "GasMW": "gas",
    "WindMW": "wind", "SolarMW": "solar", "NuclearMW": "nuclear",
}
MISS_SHARE = 0.8
LOW_QUANTILE = 0.25

FLAGS = ("LowWindFlag", "LowGasFlag", "WindMissFlag", "GasMissFlag")
MIX = ("Coal", "Gas", "Wind", "Solar", "Nuclear")


def fuel_mix_compare(da: DataFrame, rt: DataFrame, newest_by: list[str] | None = None) -> DataFrame:
    """Inner join by region hour with difference and ratio per fuel.

    Of several rows of a (region, start_time) the one with the greatest ``newest_by`` (such as a load
    time) stays, without it the one with the greatest outputs. ``*_PctDiff`` is the ratio RT / DA.
    """
    def side(df: DataFrame, suffix: str) -> DataFrame:
        one = latest_per_key(df, ["region", "start_time"], newest_by or list(FUELS.values()))
        return one.select(
            "region", "start_time", *[F.col(c).alias(f"{name}_{suffix}") for name, c in FUELS.items()]
        )

    joined = side(da, "DA").join(side(rt, "RT"), ["region", "start_time"])
    derived = {}
    for name in FUELS:
        planned, real = F.col(f"{name}_DA"), F.col(f"{name}_RT")
        derived[f"{name}_Diff"] = real - planned
        derived[f"{name}_PctDiff"] = ratio(real, planned)
    return joined.withColumns(derived)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def with_fuel_flags(mix: DataFrame) -> DataFrame:
    """Miss flags (at most 80 % of plan) and low flags (at most the 25 % quantile of the region)."""
    outputs = ["WindMW_RT", "GasMW_RT"]
    long = mix.select("region", *outputs).unpivot("region", outputs, "_fuel", "_mw")
    cuts = exact_quantiles(long, ["region", "_fuel"], "_mw", {"_low": LOW_QUANTILE}, "nearest")
    wide = cuts.groupBy("region").agg(
        *[F.max(F.when(F.col("_fuel") == c, F.col("_low"))).alias(f"_low_{c}") for c in outputs]
    )
    return (
        with_group_values(mix, wide, ["region"], "left")
        .withColumns(
            {
                "WindMissFlag": _flag(F.col("WindMW_PctDiff") <= MISS_SHARE),
                "GasMissFlag": _flag(F.col("GasMW_PctDiff") <= MISS_SHARE),
                "LowWindFlag": _flag(F.col("WindMW_RT") <= F.col("_low_WindMW_RT")),
                "LowGasFlag": _flag(F.col("GasMW_RT") <= F.col("_low_GasMW_RT")),
            }
        )
        .drop(*[f"_low_{c}" for c in outputs])
    )


def regime_by_temperature(df: DataFrame, flags_in_denominator: bool = True) -> DataFrame:
    """Percent of each regime and flag per temperature bucket, one pass over the rows.

    With ``flags_in_denominator`` the flag counts enlarge the base, so regime shares do not
    add up to 100; without it every figure is a share of the bucket's rows.
    """
    rows = df.where(F.col("TemperatureBucket").isNotNull())
    names = [*REGIMES, *FLAGS]
    counts = rows.groupBy("TemperatureBucket").agg(
        *[F.count_if(F.col("regime") == r).alias(r) for r in REGIMES],
        *[F.count_if(F.col(f) == 1).alias(f) for f in FLAGS],
    )
    base = F.lit(0)
    for name in names if flags_in_denominator else REGIMES:
        base = base + F.col(name)
    return counts.select(
        "TemperatureBucket", *[F.round(F.col(n) * 100.0 / base, 2).alias(n) for n in names]
    )


def fuel_mix_by_temperature(df: DataFrame) -> DataFrame:
    """Average real-time output and its percent per fuel, with the scarcity share; one pass."""
    rows = df.where(F.col("TemperatureBucket").isNotNull())
    averages = rows.groupBy("TemperatureBucket").agg(
        *[F.avg(f"{fuel}MW_RT").alias(f"avg_{fuel}MW_RT") for fuel in MIX],
        (share(F.col("regime").isin(*SCARCITY_REGIMES)) * 100).alias("ScarcityPct"),
    )
    total = F.lit(0.0)
    for fuel in MIX:
        total = total + F.col(f"avg_{fuel}MW_RT")
    percents = {
        f"{fuel}Pct_RT": F.round(ratio(F.col(f"avg_{fuel}MW_RT"), F.col("TotalAvgMW_RT")) * 100, 2)
        for fuel in MIX
    }
    return averages.withColumn("TotalAvgMW_RT", total).withColumns(percents)


def pct_of_seasonal_avg(df: DataFrame, value: str, out: str, ts: str = "start_time") -> DataFrame:
    """Value in percent of its winter mean over the whole table, rounded to two digits."""
    mean = df.where(is_winter(F.col(ts))).agg(F.avg(value)).scalar()
    return df.withColumn(out, F.round(ratio(F.col(value), mean) * 100, 2))
