"""Score columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, without length or null."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed a single time, however often ``then`` uses it, in loops too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalized(a: Column) -> Column:
    """The vector at length 1, so that a dot product is the cosine."""
    scaled = lambda v: F.transform(v["a"], lambda x: F.when(v["n"] > 0, x.cast("double") / v["n"]).otherwise(0.0))
    return once(a, lambda v: once(F.struct(v.alias("a"), norm(v).alias("n")), scaled))


def age_days(at: Column, now: Column) -> Column:
    """Days between two timestamps, with or without zone."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000.0


def freshness_decay(at: Column, now: Column, days: float = 365.0) -> Column:
    """exp(-age / days); 0 for a null or future time."""
    age = age_days(at, now)
    return F.when(age >= 0, F.exp(-age / days)).otherwise(0.0)


def freshness_boost(at: Column, now: Column) -> Column:
    age = F.floor(age_days(at, now))
    return F.when(age <= 30, 0.08).when(age <= 180, 0.04).when(age <= 365, 0.02).otherwise(0.0)


def authority(rank: Column, fresh: Column, navigation: Column) -> Column:
    return F.when(F.coalesce(navigation, F.lit(False)), 0.0).otherwise(0.7 * rank + 0.3 * fresh)


def saturated(raw: Column, at: float = 5.0) -> Column:
    """raw / at, between 0 and 1."""
    return F.when(raw > 0, F.least(F.lit(1.0), raw / at)).otherwise(0.0)


def clamp_boost(value: Column, low: float = 0.5, high: float = 2.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def feedback_delta(hits: Column, positive: Column, negative: Column, least: int = 10, weight: float = 0.1) -> Column:
    return F.when(hits < least, 0.0).otherwise((positive - negative) / hits * weight)


def confidence(top: Column, second: Column, gap: float = 0.05) -> Column:
    """HIGH needs a lead over the second; no result is NONE."""
    lead = top - F.coalesce(second, F.lit(0.0))
    return F.when((top > 0.75) & (lead > gap), "HIGH").when(top > 0.55, "MEDIUM").when(top > 0.35, "LOW").otherwise("NONE")


def route(tier: Column) -> Column:
    return F.when(tier == "HIGH", "cite").when(tier == "MEDIUM", "suggest").when(tier == "LOW", "clarify").otherwise("refuse")


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """Of a rank from 1."""
    return 1.0 / (F.lit(k) + rank)
