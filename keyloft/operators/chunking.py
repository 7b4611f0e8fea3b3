"""Splitting ordered rows into parts, offsets over parts, and claims on staged payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloft.scratch import Scratch


def numbered_ranges(df: DataFrame, by: list[str], order: list[str], name: str = "_i") -> DataFrame:
    """Rows in ordered ranges, as many as the session has shuffle partitions, with range _p and place ``name`` in the range.

    The result has to be written once before it is used: ranges come from a sample, which two evaluations draw apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number is not coalesced later
    ranged = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    # rows are numbered as they leave the sort; the upper bits of the id are the partition
    return ranged.withColumn("_p", F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def lifted(ranged: DataFrame, by: list[str], place: str = "_i") -> DataFrame:
    """Saved rows of ``numbered_ranges`` with row_in_subset, their place (from 0) among those of equal ``by``.

    A group's rows are neighbours in each range, so they need only the group's first place in the range and what earlier
    ranges hold of it: one row per group and range, joined back without a window over rows.
    """
    counts = ranged.groupBy(*by, "_p").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_p").alias("_q"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_lift"))
    same = F.col("_p") == F.col("_q")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return ranged.join(starts, same).withColumn("row_in_subset", F.col("_lift") + F.col(place)).drop("_p", "_q", place, "_lift", *[f"_by{k}" for k in range(len(by))])


def running_sums(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the sum of a value up to and including each row, in order, without one task for all rows.

    Rows are written in ordered ranges; each range is summed on its own and lifted by the totals of the ranges before it.
    """
    with_values = df.withColumns({f"_v{k}": v for k, v in enumerate(values.values())})
    ranged = Scratch(df.sparkSession, "ranges").save(numbered_ranges(with_values, [], order), "ranged")
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    of_each = range(len(values))
    totals = ranged.groupBy("_p").agg(*[F.sum(f"_v{k}").alias(f"_t{k}") for k in of_each])  # one row per range
    starts = totals.select("_p", *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in of_each])
    summed = ranged.withColumns({f"_s{k}": F.sum(f"_v{k}").over(inside) for k in of_each}).join(F.broadcast(starts), "_p")
    return summed.withColumns({name: F.col(f"_b{k}") + F.col(f"_s{k}") for k, name in enumerate(values)}).drop("_p", "_i", *[f"_{x}{k}" for k in of_each for x in "vsb"])


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """running_sums of one value."""
    return running_sums(df, order, {name: value})


def ordered_numbers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds row_in_subset: the place (from 0) of each row among those of equal ``by``, in ``order``.

    A window over whole groups would put a hot group in one task. Rows are written in ranges over by and order instead,
    numbered inside each range, and lifted by what earlier ranges hold of the group. ``order`` has to be unique within a
    group for a repeatable result.
    """
    return lifted(Scratch(df.sparkSession, "ranges").save(numbered_ranges(df, by, order), "ranged"), by)


def with_part_ordinal(df: DataFrame, by: list[str], order: list[str], part_rows: int) -> DataFrame:
    """Adds part_ordinal and row_in_part: consecutive slices of part_rows rows per group, the last one shorter."""
    numbered = ordered_numbers(df, by, order)
    place = F.col("row_in_subset")
    return numbered.withColumn("part_ordinal", F.floor(place / part_rows).cast("long")).withColumn("row_in_part", (place % part_rows).cast("long")).drop("row_in_subset")


def bounds(parts: DataFrame) -> DataFrame:
    """Offsets of each part among the rows of a selection, in subset and part order; computed on the manifest alone."""
    return running_sum(parts, ["subset_uuid", "created_at_epoch", "part_uuid"], F.col("n_rows"), "row_end").withColumn("row_start", F.col("row_end") - F.col("n_rows"))


def subset_bounds(subsets: DataFrame, parts: DataFrame) -> DataFrame:
    """Per subset, in order, the offsets of its rows and of its parts among those of a selection.

    Subsets without parts have empty ranges, so a selection without parts has zero for all of them.
    """
    held = parts.groupBy("subset_uuid").agg(F.sum("n_rows").alias("_rows"), F.count("*").alias("_parts"))
    rows = subsets.select("subset_uuid", "created_at_epoch").join(held, "subset_uuid", "left").fillna(0, ["_rows", "_parts"])
    summed = running_sums(rows, ["subset_uuid", "created_at_epoch"], {"row_end": F.col("_rows"), "part_end": F.col("_parts")})
    return summed.select("subset_uuid", (F.col("row_end") - F.col("_rows")).alias("row_start"), "row_end", (F.col("part_end") - F.col("_parts")).alias("part_start"), "part_end")


def prefix_claim(staged: DataFrame, part_rows: int) -> DataFrame:
    """Payloads that one claim takes: per subset the longest prefix by id whose rows sum to part_rows at most, or the first alone.

    Payloads without rows are passed over.
    """
    w = Window.partitionBy("subset_uuid").orderBy("id")
    upto = F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return staged.filter("n_rows > 0").withColumn("_s", upto).withColumn("_k", F.row_number().over(w)).filter((F.col("_s") <= part_rows) | (F.col("_k") == 1)).drop("_s", "_k")


def pack_claims(staged: DataFrame, part_rows: int) -> DataFrame:
    """Adds claim: claims repeated until nothing is left, numbered from 0 per subset. Sequential by nature, one subset a task."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        upto = rows["n_rows"].cumsum().to_numpy()
        firsts, at, taken = [], 0, 0
        while at < len(upto):  # one step a claim
            firsts.append(at)
            at = max(at + 1, int(upto.searchsorted(taken + part_rows, "right")))
            taken = upto[at - 1]
        starts = pd.Series(0, index=range(len(upto)))
        starts.iloc[firsts[1:]] = 1
        return rows.assign(claim=starts.cumsum().to_numpy())[["subset_uuid", "id", "n_rows", "claim"]]

    return staged.filter("n_rows > 0").select("subset_uuid", "id", "n_rows").groupBy("subset_uuid").applyInPandas(pack, "subset_uuid string, id long, n_rows long, claim long")


def stale(staged: DataFrame, cutoff_us: int) -> DataFrame:
    """Payloads whose claim is as old as the cutoff."""
    return staged.filter(F.col("claimed_by").isNotNull() & (F.col("claimed_at") <= cutoff_us))


def hot_subsets(staged: DataFrame, limit: int = 256) -> DataFrame:
    """Subsets of unclaimed payloads, by their first id."""
    return staged.filter("claimed_by is null").groupBy("subset_uuid").agg(F.min("id").alias("first_id")).orderBy("first_id", "subset_uuid").limit(limit)


def backlog(staged: DataFrame) -> DataFrame:
    """Rows and payloads that wait, per subset."""
    return staged.groupBy("subset_uuid").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), F.count("*").alias("payloads"))


def pages(df: DataFrame, order: list[str], size: int = 200) -> DataFrame:
    """Adds page: fixed-size pages in order."""
    return ordered_numbers(df, [], order).withColumn("page", F.floor(F.col("row_in_subset") / size).cast("long")).drop("row_in_subset")


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows by key after the last one seen."""
    return (df if after is None else df.filter(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
