"""Tail risk of price spreads: VaR, CVaR, pricing and event comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.numbers import NORMAL_Z05, ratio, sample_kurtosis, sample_skewness, share
from gridlens.operators.distribution import equal_width_histogram, exact_quantiles, with_group_values


def cvar_metrics(df: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.99) -> DataFrame:
    """Thirteen distribution and tail metrics per group.

    Thresholds are exact interpolated percentiles; tail means include the threshold itself.
    ``CVaR_Value`` weighs the left tail mean and the mean by the tail probability.
    """
    alpha = round(1 - confidence, 12)
    rows = df.select(*keys, F.col(value).alias("_x")).where(F.col("_x").isNotNull())
    limits = exact_quantiles(
        rows, keys, "_x",
        {"Left_Tail_Threshold": alpha, "Median_Spread": 0.5, "Right_Tail_Threshold": 1 - alpha},
    )
    x = F.col("_x")
    left, right = x <= F.col("Left_Tail_Threshold"), x >= F.col("Right_Tail_Threshold")
    joined = with_group_values(rows, limits, keys)
    metrics = joined.groupBy(*keys).agg(
        F.avg(x).alias("Mean_Spread"),
        F.any_value("Median_Spread").alias("Median_Spread"),
        F.stddev_pop(x).alias("Std_Spread"),
        sample_skewness(x).alias("Skewness_Spread"),
        sample_kurtosis(x).alias("Kurtosis_Spread"),
        F.coalesce(F.avg(F.when(left, x)), F.lit(0.0)).alias("CVaR_Left_Tail"),
        F.coalesce(F.avg(F.when(right, x)), F.lit(0.0)).alias("CVaR_Right_Tail"),
        F.any_value("Left_Tail_Threshold").alias("Left_Tail_Threshold"),
        F.any_value("Right_Tail_Threshold").alias("Right_Tail_Threshold"),
        F.count(x).alias("n_observations"),
        F.count_if(left).alias("n_left_tail_events"),
        F.count_if(right).alias("n_right_tail_events"),
        F.min(x).alias("_worst"),
        F.skewness(x).alias("_skewness_pop"),
        F.kurtosis(x).alias("_kurtosis_pop"),
    )
    expected = F.col("CVaR_Left_Tail") * alpha + F.col("Mean_Spread") * (1 - alpha)
    return metrics.withColumn("CVaR_Value", expected)


METRICS = (
    "Mean_Spread", "Median_Spread", "Std_Spread", "Skewness_Spread", "Kurtosis_Spread",
    "CVaR_Value", "CVaR_Left_Tail", "CVaR_Right_Tail", "Left_Tail_Threshold",
    "Right_Tail_Threshold", "n_observations", "n_left_tail_events", "n_right_tail_events",
)


# Metrics set side by side by tail_compare.
COMPARED = {
    "mean": "Mean_Spread", "median": "Median_Spread", "var": "Left_Tail_Threshold",
    "cvar": "CVaR_Left_Tail", "worst": "_worst", "skewness": "_skewness_pop", "kurtosis": "_kurtosis_pop",
}


def cvar_price(metrics: DataFrame, keys: Sequence[str], mw: Column, hours: Column) -> DataFrame:
    """Price of a right under the tail scenario, under the mean, and their difference."""
    tail = F.col("CVaR_Value") * mw * hours
    mean = F.col("Mean_Spread") * mw * hours
    return metrics.select(
        *keys,
        tail.alias("CVaR_FTR_Price"),
        mean.alias("Mean_Spread_Price"),
        (tail - mean).alias("Risk_Premium"),
    )


def normal_var_gap(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """5 % VaR against the one a normal distribution would have (metrics at 0.95)."""
    normal = F.col("Mean_Spread") + F.col("Std_Spread") * NORMAL_Z05
    return metrics.select(
        *keys,
        F.col("Left_Tail_Threshold").alias("var_95"),
        normal.alias("normal_var_95"),
        (F.col("Left_Tail_Threshold") - normal).alias("var_gap"),
    )


def histogram_tail(
    df: DataFrame, keys: Sequence[str], value: str, bins: int = 80, tail: float = 0.05
) -> DataFrame:
    """Histogram per group with the bars starting at or below the VaR marked."""
    limit = exact_quantiles(df, keys, value, {"var": tail})
    bars = equal_width_histogram(df, value, bins, keys).join(limit, list(keys))
    return bars.withColumn("in_tail", F.col("bin_left") <= F.col("var"))


def tail_compare(
    df: DataFrame, keys: Sequence[str], value: str, sample: str, confidence: float = 0.95
) -> DataFrame:
    """Centre, tail and shape of an event sample against history, per group.

    Column ``sample`` is ``hist`` or ``event``; groups need rows of both.
    """
    metrics = cvar_metrics(df, [*keys, sample], value, confidence)
    sides = [
        F.max(F.when(F.col(sample) == side, F.col(column))).alias(f"{side}_{name}")
        for side in ("hist", "event")
        for name, column in COMPARED.items()
    ]
    wide = metrics.groupBy(*keys).agg(*sides)
    x = F.col(value)
    names = [c for c in wide.columns if c not in keys]
    event = df.where((F.col(sample) == "event") & x.isNotNull()).select(*keys, value)
    compared = (
        with_group_values(event, wide, keys)
        .where(F.col("hist_mean").isNotNull())
        .groupBy(*keys)
        .agg(
            *[F.any_value(n).alias(n) for n in names],
            share(x <= F.col("hist_cvar")).alias("share_beyond_hist_cvar"),
            share(x <= F.col("hist_var")).alias("share_beyond_hist_var"),
            F.count(x).alias("event_hours"),
        )
    )
    return compared.withColumns(
        {
            "mean_shift": F.col("event_mean") - F.col("hist_mean"),
            "cvar_gap": F.col("event_cvar") - F.col("hist_cvar"),
            "var_ratio": F.abs(ratio(F.col("event_var"), F.col("hist_var"))),
            "cvar_ratio": F.abs(ratio(F.col("event_cvar"), F.col("hist_cvar"))),
            "worst_ratio": F.abs(ratio(F.col("event_worst"), F.col("hist_worst"))),
        }
    )


def event_outcome(event: DataFrame, keys: Sequence[str], value: str, mw: float, hours: int) -> DataFrame:
    """Actual result of holding a right through an event.

    ``actual_pnl`` sums each hour's spread once. ``scaled_pnl`` multiplies every hourly
    spread by the whole number of hours before summing, as published figures do.
    """
    total = F.sum(value)
    return event.groupBy(*keys).agg(
        (total * mw).alias("actual_pnl"), (total * mw * hours).alias("scaled_pnl")
    )
