"""Fold change, percent rules and sequence coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is added to both sides of a fold change.
FOLD_PSEUDO = 0.1


def fold_change(a: Column, b: Column, log: bool = False) -> Column:
    """log2(A/B), or A/B where A >= B and -B/A elsewhere, after adding 0.1 to both."""
    x, y = a + F.lit(FOLD_PSEUDO), b + F.lit(FOLD_PSEUDO)
    return F.log2(x / y) if log else F.when(x >= y, x / y).otherwise(-y / x)


def fold_filter(a: Column, b: Column, least: float, log: bool = False, way: str = "either") -> Column:
    """Rows with a value on either side whose fold change is ``least`` or more, up, down or either."""
    fold = fold_change(a, b, log)
    wanted = {"up": fold >= least, "down": fold <= -least, "either": F.abs(fold) >= least}[way]
    return ((a > 0) | (b > 0)) & wanted


def percent_floor(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(0).cast("int")


def percent_round(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(0).cast("int")


def frame_of(start: Column, end: Column, length: Column) -> Column:
    """Reading frame of coordinates: 1 to 3 forwards, -1 to -3 where start is above end."""
    at = F.when(start <= end, start).otherwise(length - start + 1)
    frame = F.when(at % 3 == 0, 3).otherwise(at % 3)
    return F.when(start <= end, frame).otherwise(-frame).cast("int")


def ratio(x: Column, y: Column) -> Column:
    """x/y with 0 for x <= 0 and -2 for y <= 0."""
    return F.when(x <= 0, 0.0).when(y <= 0, -2.0).otherwise(x / y)


def shared_ratio(both: Column, either: Column) -> Column:
    """Jaccard ratio with 1 for 0/0 and 0 for x/0."""
    return F.when((both == 0) & (either == 0), 1.0).when(either == 0, 0.0).otherwise(both / either)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two half-open intervals share a position."""
    return (s1 < e2) & (s2 < e1)


def rounded_whole(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")
