"""Exact integer arithmetic of the features, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SCALE, U32_MAX


def to_milli(x: Column) -> Column:
    """A FLOAT in thousandths: rounded half away from zero, 0 at the least, 2^32 - 1 at the most. Null stays null.

    The value is narrowed to FLOAT first: 20000.126 gives 20000127.
    """
    wide = F.round(x.cast("float").cast("double") * 1000)
    # CASE and not least/greatest, which skip nulls
    return F.when(x.isNull(), None).when(wide <= 0, 0).when(wide >= U32_MAX, U32_MAX).otherwise(wide).cast("long")


def parse_digits(s: Column) -> Column:
    """Digits as a number up to 2^32 - 1; '' is 0; anything else is null. Leading zeros don't count."""
    bare = F.regexp_replace(s, "^0+(?=[0-9])", "")
    n = F.when(bare == "", F.lit("0")).otherwise(bare).try_cast("long")
    return F.when(bare.rlike(r"\A[0-9]{0,10}\z") & (n <= U32_MAX), n)


def rounded_div(n: Column, d: int | Column) -> Column:
    """(n + d/2) / d in whole numbers, for n >= 0. ``d`` is never 0 where the result is used."""
    d = F.lit(d) if isinstance(d, int) else d
    d = d.cast("long")
    n = n.cast("long") + F.shiftright(d, 1)
    return ((n - n % d) / d).cast("long")


def clamp(n: Column) -> Column:
    """At most SCALE; null stays null."""
    return F.when(n > SCALE, SCALE).otherwise(n).cast("int")


def scaled(n: Column, most: int) -> Column:
    """A count as a share of ``most``, in 1/SCALE, at most SCALE."""
    return clamp(rounded_div(n.cast("long") * SCALE, most))


def scaled_milli(milli: Column, most: int) -> Column:
    """Thousandths as a share of ``most`` units, in 1/SCALE, at most SCALE."""
    return clamp(rounded_div(milli.cast("long") * SCALE, most * 1000))


def amount_ratio(amount_milli: Column, avg_milli: Column) -> Column:
    """amount / average / 10 in 1/SCALE, at most SCALE; SCALE where the average is 0."""
    safe = F.when(avg_milli == 0, 1).otherwise(avg_milli)
    return F.when(avg_milli == 0, SCALE).otherwise(clamp(rounded_div(amount_milli.cast("long") * 1000, safe))).cast("int")


def quantize(x: Column) -> Column:
    """A vector component: -1 and less give -SCALE, up to 0 gives 0, 1 and more SCALE, else rounded in 1/SCALE."""
    x = x.cast("double")
    return F.when(x <= -1, -SCALE).when(x <= 0, 0).when(x >= 1, SCALE).otherwise(F.round(x * SCALE)).cast("int")
