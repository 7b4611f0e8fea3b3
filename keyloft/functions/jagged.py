"""Arrays of varying length: length columns, padding, and predicates that need no array."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloft.errors import DataExceedsCanon, named


def length(a: Column) -> Column:
    """Length of an array; 0 for null."""
    return F.coalesce(F.size(a), F.lit(0)).cast("int")


def shape(a: Column, dims: int) -> Column:
    """Longest extent per dimension of a nested array, 0 where there is nothing."""
    out, level = [length(a)], a
    for _ in range(1, dims):
        out.append(F.coalesce(F.array_max(F.transform(level, lambda x: length(x))), F.lit(0)).cast("int"))
        level = F.flatten(level)
    return F.array(*out)


def zero_of(kind: T.DataType) -> Column:
    """Padding value of an element type: 0, false or the empty string."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit(0).cast(kind)


def pad(a: Column, to: int | list[int], kind: T.DataType) -> Column:
    """The array extended to ``to`` elements, nested ones to a list of extents; a longer one fails the job.

    kind is the type of the innermost elements.
    """
    extents = [to] if isinstance(to, int) else list(to)
    inner, array = kind, T.ArrayType(kind)
    for _ in extents[1:]:
        inner, array = array, T.ArrayType(array)
    a = F.coalesce(a, F.array().cast(array))
    fill = zero_of(kind)
    for n in reversed(extents[1:]):
        fill = F.array_repeat(fill, n)
    rows = a if len(extents) == 1 else F.transform(a, lambda x: pad(x, extents[1:], kind))
    message = F.concat(F.lit(named(DataExceedsCanon, f"longer than the canonical {extents[0]}: ")), F.size(a).cast("string"))
    return F.when(F.size(a) > extents[0], F.raise_error(message).cast(array)).otherwise(F.concat(rows, F.array_repeat(fill.cast(inner), F.greatest(F.lit(0), F.lit(extents[0]) - F.size(a)))))


def unpad(a: Column, n: Column) -> Column:
    """The first n elements."""
    return F.slice(a, F.lit(1), n)


def has_any(name: str) -> Column:
    """exists(name), by the stored length."""
    return F.col(f"{name}_len") > 0


def at_least(name: str, k: int | tuple[int, ...]) -> Column:
    """length(name) >= k by the stored length; for nested arrays every extent by the stored shape (0 asks nothing)."""
    if isinstance(k, int):
        return F.col(f"{name}_len") >= k
    return reduce(and_, [F.get(f"{name}_shape", F.lit(d)) >= n for d, n in enumerate(k) if n], F.lit(True))


def width(longest: Column) -> Column:
    """Smallest unsigned type that holds a length."""
    return F.when(longest <= 65535, "uint16").otherwise("uint32")


def rows_of_arrays(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Rows of columns that come as arrays: element i of every array makes row i; unequal lengths fail the job."""
    sizes = [F.size(c) for c in arrays]
    even = F.lit(True)
    for s in sizes[1:]:
        even &= s == sizes[0]
    zipped = F.when(even, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    return df.select(*[c for c in df.columns if c not in arrays], F.posexplode(zipped).alias("row", "_z")).select(*[c for c in df.columns if c not in arrays], "row", *[F.col("_z")[c].alias(c) for c in arrays])
