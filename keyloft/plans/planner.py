"""Pruning of parts by their statistics before anything is read."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloft.functions.jagged import at_least
from keyloft.operators.chunking import running_sum
from keyloft.operators.parts import prune_class


def _stat(name: str, path: str) -> Column:
    return F.get_json_object("part_stats_json", f"$.{name}.{path}").cast("int")


def _class(name: str, k: int | tuple[int, ...]) -> Column:
    """none, all or some, from the statistics of one field; for nested arrays over all dimensions that are asked for."""
    if isinstance(k, int):
        return F.coalesce(prune_class(_stat(name, "min_len"), _stat(name, "max_len"), k), F.lit("some"))
    dims = [F.coalesce(prune_class(_stat(name, f"dims[{d}].min"), _stat(name, f"dims[{d}].max"), n), F.lit("some")) for d, n in enumerate(k) if n]
    return _both(dims)


def _both(classes: list[Column]) -> Column:
    none = reduce(or_, [c == "none" for c in classes], F.lit(False))
    every = reduce(and_, [c == "all" for c in classes], F.lit(True))
    return F.when(none, "none").when(every, "all").otherwise("some")


def classify(parts: DataFrame, lengths: dict[str, int | tuple[int, ...]]) -> DataFrame:
    """Adds match: none, all or some rows of a part have at least the given lengths; parts without statistics are some."""
    return parts.withColumn("match", _both([_class(n, k) for n, k in sorted(lengths.items())]))


def plan_parts(parts: DataFrame, lengths: dict[str, int | tuple[int, ...]]) -> DataFrame:
    """Parts that may hold a matching row."""
    return classify(parts, lengths).filter("match <> 'none'")


def cost_order(planned: DataFrame) -> list[Column]:
    """Order in which parts are best read: those whose every row matches first, then by rows, the most first.

    Ties go by part_uuid. Only asked for where a caller wants a bounded head of the rows soon.
    """
    return [F.when(F.col("match") == "all", 0).otherwise(1).asc(), F.desc("n_rows"), F.asc("part_uuid")]


def bounded(planned: DataFrame, rows: int) -> DataFrame:
    """The first parts in cost order that surely give ``rows`` matching rows, if the parts of full match have as many.

    For a caller that wants any that many rows: parts beyond need not be opened. Parts of partial match promise nothing, so
    all of them stay where the others don't suffice.
    """
    sure = F.when(F.col("match") == "all", F.col("n_rows")).otherwise(0)
    rank = planned.withColumn("_part", F.when(F.col("match") == "all", 0).otherwise(1)).withColumn("_less", -F.col("n_rows"))
    upto = running_sum(rank, ["_part", "_less", "part_uuid"], sure, "_upto")
    return upto.filter(F.col("_upto") - sure < rows).drop("_part", "_less", "_upto")


def residual(rows: DataFrame, lengths: dict[str, int | tuple[int, ...]]) -> DataFrame:
    """Row filter on stored lengths, which Parquet can push down."""
    return rows.filter(reduce(and_, [at_least(n, k) for n, k in sorted(lengths.items())], F.lit(True)))


def explain_parts(parts: DataFrame, lengths: dict[str, int | tuple[int, ...]]) -> DataFrame:
    """How many parts and rows each class has."""
    return classify(parts, lengths).groupBy("match").agg(F.count("*").alias("parts"), F.sum("n_rows").alias("rows"))
