"""Scalar building blocks: guarded arithmetic as Columns, step sizes on the driver."""

from __future__ import annotations

import math
from decimal import Decimal
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_sqrt(x: Column) -> Column:
    """Square root, negative rounding errors taken as 0."""
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def guarded(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` where the denominator is positive, else 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def present(column: str | Column) -> Column:
    """Neither null nor NaN."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNotNull() & ~F.isnan(column.cast("double"))


def ceil_step(step: float) -> float:
    """The least of 1, 2 or 5 times a power of ten that is not below ``step``."""
    if not step > 0:
        raise ValueError(f"steps are positive, not {step}")
    decade = math.floor(math.log10(step))
    # from the decade below, lest the logarithm was rounded up
    grid = (Decimal(m).scaleb(d) for d in range(decade - 1, decade + 2) for m in (1, 2, 5))
    return next(float(g) for g in grid if float(g) >= step)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def hash_draw(bound: Column | int, *parts) -> Column:
    """A reproducible draw from 0 .. bound - 1: the first 60 bits of MD5 of the parts, modulo the bound."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), bound if isinstance(bound, Column) else F.lit(bound)).cast("long")


def hash_uniform(*parts) -> Column:
    """A reproducible draw from [0, 1)."""
    return hash_draw(2**52, *parts) / F.lit(float(2**52))
