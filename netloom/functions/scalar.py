"""Decay of influence with distance, cluster numbers from signs, and an exploration schedule."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse(d: Column, at_zero: float = 1.0) -> Column:
    """1 / d; at_zero for distance 0."""
    return F.when(d == 0, F.lit(at_zero)).otherwise(F.lit(1.0) / d)


def exponential_decay(d: Column, rate: float = 0.1) -> Column:
    return F.exp(-F.lit(rate) * d)


def power_law(d: Column, alpha: float = 0.1, at_zero: float = 1.0) -> Column:
    """d ** -alpha; at_zero for distance 0."""
    return F.when(d == 0, F.lit(at_zero)).otherwise(F.pow(d, F.lit(-alpha)))


def cluster_index(signs: Column) -> Column:
    """An array of 0 and 1, least significant first, as a number."""
    weights = F.transform(signs, lambda s, i: s.cast("long") * F.pow(F.lit(2.0), i).cast("long"))
    return F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + x)


def epsilon_schedule(arms: int) -> Callable[[int], float]:
    """Share of exploration at step t: 1 at the first, then (K ln(t + 1) / (t + 1)) ** (1 / 3)."""
    return lambda t: 1.0 if t == 0 else (arms * math.log(t + 1) / (t + 1)) ** (1 / 3)
