"""Compiler from keyword predicates on subset keys to one column expression."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloft.functions.identity import NORMAL, special_of
from keyloft.functions.timeutil import to_epoch_us

#: Columns of the subset table that may be queried beside the keys.
RESERVED_TYPES = {"subset_uuid": "TEXT", "created_at_epoch": "INTEGER", "marked_for_deletion": "BOOLEAN", "total_rows": "INTEGER"}


def as_range(value) -> tuple | None:
    """The two ends of a two-element iterable that is no text."""
    if isinstance(value, str | bytes) or not isinstance(value, Iterable):
        return None
    ends = tuple(value)
    if len(ends) != 2:
        raise TypeError("a range has two ends")
    return ends


def approx_eq(col: Column, value: float, tolerance: float = 1e-6) -> Column:
    """Within tolerance of a number; NaN equals NaN."""
    if value != value:
        return F.isnan(col)
    return col.between(value - tolerance, value + tolerance)


def identity_eq(name: str, value: float, scale: float) -> Column:
    """Equal by special code and quantized value."""
    code, q = special_of(float(value), scale)
    return (F.col(f"{name}_s") == code) & (F.col(f"{name}_q") == q) if code == NORMAL else F.col(f"{name}_s") == code


def predicate(name: str, kind: str, value, tolerance: float | None = None, scale: float | None = None) -> Column:
    """One key against a value or a range (inclusive, ends in any order)."""
    col = F.col(name)
    ends = as_range(value) if kind in ("INTEGER", "REAL") else None
    if kind == "INTEGER":
        if ends:
            lo, hi = sorted(int(x) for x in ends)
            return col.between(F.lit(lo).cast("long"), F.lit(hi).cast("long"))
        return col == F.lit(int(value)).cast("long")
    if kind == "REAL":
        if ends:
            lo, hi = sorted(float(x) for x in ends)
            if lo != lo or hi != hi:
                raise ValueError("a range can't end at NaN")
            return col.between(lo, hi)
        if scale is not None:
            return identity_eq(name, value, scale)
        return approx_eq(col, float(value), 1e-6 if tolerance is None else tolerance)
    if kind == "BOOLEAN":
        return col == F.lit(bool(value))  # whatever is true or false in Python
    if not isinstance(value, str):
        raise TypeError(f"{name} is text")
    return col == F.lit(value)


def time_window(name: str, start=None, end=None) -> Column:
    """Both ends inclusive; either may be missing."""
    out = F.lit(True)
    if start is not None:
        out &= F.col(name) >= F.lit(to_epoch_us(start)).cast("long")
    if end is not None:
        out &= F.col(name) <= F.lit(to_epoch_us(end)).cast("long")
    return out


def live() -> Column:
    return ~F.col("marked_for_deletion")


def compile_predicates(keys: dict[str, str], queries: dict, tolerance: float | None = None, scales: dict[str, float] | None = None) -> Column:
    """All predicates together; none means every row. With scales, real equality goes by identity instead of tolerance."""
    kinds = RESERVED_TYPES | keys
    for name in queries:
        if name not in kinds:
            raise ValueError(f"unknown key: {name}")
    parts = [predicate(n, kinds[n], v, tolerance, scales.get(n) if scales is not None and kinds[n] == "REAL" else None) for n, v in sorted(queries.items())]
    return reduce(and_, parts, F.lit(True))


def not_ignored(col: Column, patterns: list[str]) -> Column:
    """True unless a glob pattern matches."""
    return reduce(and_, [~col.rlike("^" + fnmatch.translate(p)) for p in patterns], F.lit(True))
