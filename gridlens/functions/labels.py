"""Ordered rules: temperature buckets, price regimes and display labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket names with inclusive upper bounds in Fahrenheit (None: no bound).
BUCKET_LIMITS = (
    ("Extreme Cold", -10),
    ("Very Cold", 10),
    ("Cold", 32),
    ("Cool", 50),
    ("Mild", 70),
    ("Hot", 85),
    ("Extreme Hot", None),
)
BUCKETS = tuple(name for name, _ in BUCKET_LIMITS)

# Range text shown after the bucket name.
BUCKET_RANGES = {
    "Extreme Cold": "Extreme Cold (≤ -10°F)",
    "Very Cold": "Very Cold (-10°F to 10°F)",
    "Cold": "Cold (10°F to 32°F)",
    "Cool": "Cool (32°F to 50°F)",
    "Mild": "Mild (50°F to 70°F)",
    "Hot": "Hot (70°F to 85°F)",
    "Extreme Hot": "Extreme Hot (>85°F)",
}

# Regime names in rule order.
EXTREME = "Extreme Event"
FALSE_SCARCITY = "False Scarcity"
ANTICIPATED = "Anticipated Scarcity"
UNANTICIPATED = "Unanticipated Scarcity"
OVER_GENERATION = "Over-Generation"
MODERATE = "Moderate Stress"
NORMAL = "Normal Operations"
REGIMES = (EXTREME, FALSE_SCARCITY, ANTICIPATED, UNANTICIPATED, MODERATE, OVER_GENERATION, NORMAL)
SCARCITY_REGIMES = (EXTREME, FALSE_SCARCITY, ANTICIPATED, UNANTICIPATED)

# Price limits of the regime rules in $/MWh.
EXTREME_PRICE = 180
SCARCITY_PRICE = 80
SCARCITY_GAP = 40
SURPRISE_PRICE = 100
LOW_PRICE = 5
STRESS_FLOOR, STRESS_DA_CAP, STRESS_RT_CAP, STRESS_SPREAD = 50, 80, 100, 15


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """Value of the first rule whose condition is true; NULL conditions do not match."""
    (condition, value), *rest = rules
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def temperature_bucket(temp: Column, extreme_cold: float = -10) -> Column:
    """Bucket name; ``extreme_cold`` moves the lowest limit. NULL stays NULL."""
    limits = [extreme_cold] + [limit for _, limit in BUCKET_LIMITS[1:]]
    rules = [
        (temp.isNotNull() if limit is None else temp <= limit, name)
        for name, limit in zip(BUCKETS, limits)
    ]
    return first_match(rules)


def bucket_rank(bucket: Column) -> Column:
    """Position of a bucket from cold (1) to hot (7), for sorting."""
    return first_match([(bucket == name, i) for i, name in enumerate(BUCKETS, start=1)])


def relabel(x: Column, names: dict[str, str]) -> Column:
    """Dictionary lookup that keeps values without an entry."""
    pairs = [F.lit(part) for item in names.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), x)


def bucket_label(bucket: Column) -> Column:
    return relabel(bucket, BUCKET_RANGES)


def direction_label(under: Column) -> Column:
    return F.when(under, "Under Forecast").when(~under, "Over Forecast")


def price_regime(da: Column, rt: Column) -> Column:
    """Regime of a day-ahead and a real-time price. Inputs must carry NULL, not NaN."""
    spread = rt - da
    stressed = (
        da.between(STRESS_FLOOR, STRESS_DA_CAP)
        | rt.between(STRESS_FLOOR, STRESS_RT_CAP)
        | (F.abs(spread) > STRESS_SPREAD)
    )
    high_da = da > SCARCITY_PRICE
    return first_match(
        [
            (rt > EXTREME_PRICE, EXTREME),
            (high_da & (rt < da - SCARCITY_GAP), FALSE_SCARCITY),
            (high_da & (rt > SCARCITY_PRICE) & spread.between(-SCARCITY_GAP, SCARCITY_GAP), ANTICIPATED),
            ((rt > SURPRISE_PRICE) & (spread > SCARCITY_GAP), UNANTICIPATED),
            ((da < LOW_PRICE) | (rt < LOW_PRICE), OVER_GENERATION),
            (stressed, MODERATE),
        ],
        default=NORMAL,
    )
