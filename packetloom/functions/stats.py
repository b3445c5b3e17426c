"""Statistics as Column expressions: bounded, null-safe, evaluated inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def clamp(c: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    return F.greatest(F.lit(lower), F.least(c.cast("double"), F.lit(upper)))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(c, -35.0, 35.0)))


def logit(c: Column) -> Column:
    p = clamp(c, 1e-6, 1.0 - 1e-6)
    return F.log(p / (1.0 - p))


def rate(c: Column) -> Column:
    """A rate given as a share or as a percentage; null counts as 0."""
    v = F.coalesce(c.cast("double"), F.lit(0.0))
    return clamp(F.when(v > 1.0, v / 100.0).otherwise(v))


def smoothed_rate(successes: Column, total: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Rate with a Beta prior."""
    return (successes + alpha) / (total + alpha + beta)


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the score interval; null without trials."""
    p, z2 = successes / total, z * z
    denominator = 1.0 + z2 / total
    center = (p + z2 / (2.0 * total)) / denominator
    margin = (z / denominator) * F.sqrt(p * (1.0 - p) / total + z2 / (4.0 * total * total))
    lower = F.when(total > 0, F.greatest(F.lit(0.0), center - margin))
    upper = F.when(total > 0, F.least(F.lit(1.0), center + margin))
    return lower, upper


def shrunk_mean(total: Column, n: Column, prior_mean: Column, prior_weight: float) -> Column:
    """Mean drawn towards a prior mean that counts as `prior_weight` observations."""
    return (prior_weight * prior_mean + total) / (prior_weight + n)


def band(c: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """The label of the first step that the value reaches; steps go from high to low."""
    out = None
    for low, label in steps:
        out = F.when(c >= low, label) if out is None else out.when(c >= low, label)
    return out.otherwise(otherwise)
