"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 5 % quantile of the standard normal distribution (fixed value).
NORMAL_Z05 = -1.6448536269514722


def no_nan(x: Column) -> Column:
    """NaN becomes NULL: Spark ranks NaN above every number, so ``NaN > 180`` is true."""
    return F.when(~F.isnan(x), x)


def ratio(x: Column, y: Column) -> Column:
    """``x / y``, NULL when ``y`` is 0."""
    return F.try_divide(x, y)


def exact_sum(x: Column, scale: int) -> Column:
    """Sum of fixed-point values, the same whatever order the rows arrive in.

    Added up as whole units of the last digit, which is exact and cheaper than decimals.
    """
    unit = 10**scale
    return F.sum(F.rint(x * unit).cast("long")) / unit


def exact_avg(x: Column, scale: int) -> Column:
    """Mean of fixed-point values through :func:`exact_sum`."""
    return F.try_divide(exact_sum(x, scale), F.count(x))


def share(flag: Column) -> Column:
    """Share of true values among the non-null ones."""
    return F.avg(flag.cast("int"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the pairs without NULL; NULL when a side does not vary.

    Spark's ``corr`` raises a division error for a constant side in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(x).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(x) + 6))


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based slice of ``[low, high]``; slices are left-closed, the last one closed."""
    last = F.lit(bins - 1).cast("long")
    inside = F.least(F.floor((x - low) / (high - low) * bins), last)
    return (
        F.when((high > low) & (x > low) & (x < high), inside)
        .when((high > low) & (x >= high), last)
        .otherwise(F.lit(0).cast("long"))
    )


def bin_edge(low: Column, high: Column, bins: int, number: Column) -> Column:
    """Left edge of a histogram bin."""
    return low + number * ((high - low) / bins)


def histogram_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """:func:`equal_width_bin`, then moved to the bin whose edges, as computed, hold ``x``."""
    slot = equal_width_bin(x, low, high, bins)
    below = (slot > 0) & (x < bin_edge(low, high, bins, slot))
    above = (slot < bins - 1) & (x >= bin_edge(low, high, bins, slot + 1))
    return F.when(below, slot - 1).when(above, slot + 1).otherwise(slot)


MAGNITUDE_STEPS = 512


def magnitude_slice(x: Column) -> Column:
    """Slice number that never decreases with ``x``: every power of two in equal steps.

    A rounding error of the logarithm moves a value to the neighbouring power, where the
    step makes up for it, so the number stays the same. Infinities get the outermost numbers.
    """
    size = F.when(F.abs(x) < float("inf"), F.abs(x))
    power = F.floor(F.log2(size))
    step = F.floor(size / F.pow(F.lit(2.0), power) * MAGNITUDE_STEPS)
    finite = F.when(size > 0, (power + 1076) * MAGNITUDE_STEPS + step).when(size == 0, F.lit(0))
    magnitude = F.coalesce(finite, F.lit(2200 * MAGNITUDE_STEPS))
    return F.when(x < 0, -magnitude).otherwise(magnitude)


def order_slice(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Slice number that never decreases with ``x``: an equal-width bin, cut by magnitude.

    Equal widths alone put everything near zero into one slice when a far outlier stretches
    the range, magnitudes alone put a narrow range far from zero into one. Both are
    monotone, so a group occupies at most as many slices as both have together.
    """
    return equal_width_bin(x, low, high, bins) * F.lit(1 << 22) + magnitude_slice(x)
