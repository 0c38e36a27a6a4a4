"""Predicates built from optional parts: ranges, AND/OR over conditions, text search."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def combine(parts: Iterable[Column | None], how: str = "and") -> Column | None:
    """All parts joined by AND or OR; missing parts are passed over, and no part at all gives None."""
    kept = [p for p in parts if p is not None]
    return reduce(and_ if how == "and" else or_, kept) if kept else None


def where(df, *parts: Column | None):
    condition = combine(parts)
    return df if condition is None else df.where(condition)


def in_range(value: Column, low=None, high=None) -> Column | None:
    """Half open: low <= value < high. Equal bounds mean equality, a missing bound is open."""
    if low is None and high is None:
        return None
    if low is None:
        return value < high
    if high is None:
        return value >= low
    return value == low if low == high else (value >= low) & (value < high)


def any_of(conditions: list[Column], how: str) -> Column:
    """``all`` or ``any`` of the conditions; a condition that is null does not hold."""
    return combine([F.coalesce(c, F.lit(False)) for c in conditions], "and" if how == "all" else "or")


def like(value: Column, text: str) -> Column:
    """Substring search without regard to case. A ``%`` of the user is a wildcard, ``_`` stands for itself."""
    pattern = text.lower().replace("\\", "\\\\").replace("_", "\\_")
    return F.lower(value).like(pattern if "%" in pattern else f"%{pattern}%")


def direction(value: Column, cutoff: float, way: str = "either") -> Column:
    """abs(value) < cutoff, with the sign asked for: ``up`` is above 0, ``down`` below."""
    small = F.abs(value) < cutoff
    return {"either": small, "up": small & (value > 0), "down": small & (value < 0)}[way]
