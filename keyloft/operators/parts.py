"""Operators on part and batch tables: deduplication, statistics, pruning classes, liveness, change feed, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A codebook of lengths pays up to this many distinct lengths and this share of the rows.
CODEBOOK_LENGTHS, CODEBOOK_SHARE = 256, 0.1


def first_wins(parts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of equal content the first one. A hot key is reduced before the shuffle."""
    rest = [c for c in parts.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return parts.groupBy(*by).agg(first.alias("_r")).select(*[F.col(c) if c in by else F.col("_r")[c].alias(c) for c in parts.columns])


def not_present(new: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """New rows whose key the held table does not have."""
    return new.join(held.select(*by), by, "left_anti")


def in_both(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Keys that both tables have, once each."""
    return a.select(*by).intersect(b.select(*by))


def in_either(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Keys that either table has, once each."""
    return a.select(*by).union(b.select(*by)).distinct()


def live_rows(subsets: DataFrame, parts: DataFrame) -> DataFrame:
    """subset_uuid, live_rows: rows in unmarked parts, 0 where there are none."""
    sums = parts.filter("not marked_for_deletion").groupBy("subset_uuid").agg(F.sum("n_rows").alias("_n"))
    return subsets.select("subset_uuid").join(sums, "subset_uuid", "left").select("subset_uuid", F.coalesce("_n", F.lit(0)).alias("live_rows"))


def length_encoding(n_rows: Column, distinct: Column) -> Column:
    return F.when(distinct == 1, "constant").when((distinct <= CODEBOOK_LENGTHS) & (distinct <= n_rows * CODEBOOK_SHARE), "codebook").otherwise("plain")


def part_stats(rows: DataFrame, by: list[str], length: str, canonical: int | Column) -> DataFrame:
    """Per part: rows, shortest, longest and mean length, rows of full length, and the encoding of the lengths."""
    full = F.col(length) == (F.lit(canonical) if isinstance(canonical, int) else canonical)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.min(length).alias("min_len"),
        F.max(length).alias("max_len"),
        F.avg(length).alias("avg_len"),
        F.sum(F.when(full, 1).otherwise(0)).alias("full_rows"),
        F.count_distinct(F.col(length)).alias("distinct_lens"),
    )
    return out.withColumn("len_encoding", length_encoding(F.col("n_rows"), F.col("distinct_lens")))


def shape_stats(rows: DataFrame, by: list[str], shape: str, dims: int) -> DataFrame:
    """Per part and dimension of nested arrays: shortest, longest and mean extent."""
    aggs = [f(F.get(shape, F.lit(d))).alias(f"{name}_{d}") for d in range(dims) for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), *aggs)


def padded_rows(rows: DataFrame, by: list[str], length: str, canonical: int) -> DataFrame:
    """How many rows padding would extend."""
    return rows.groupBy(*by).agg(F.sum(F.when(F.col(length) < canonical, 1).otherwise(0)).alias("padded_rows"))


def prune_class(min_len: Column, max_len: Column, k: int) -> Column:
    """Whether length >= k holds for none, all or some rows of a part."""
    return F.when(max_len < k, "none").when(min_len >= k, "all").otherwise("some")


def subset_parts(subsets: DataFrame, parts: DataFrame) -> DataFrame:
    """Each subset with its parts in order; subsets without parts keep an empty list."""
    listed = parts.groupBy("subset_uuid").agg(F.sort_array(F.collect_list(F.struct("created_at_epoch", "part_uuid"))).alias("_p"))
    return subsets.join(listed, "subset_uuid", "left").withColumn("parts", F.coalesce(F.transform("_p", lambda x: x["part_uuid"]), F.array().cast("array<string>"))).drop("_p")


def orphans(files: DataFrame, parts: DataFrame, subsets: DataFrame) -> DataFrame:
    """Files that no part names, and whether their subset is known (insert) or not (skip)."""
    lost = files.join(parts.select("file_relpath"), "file_relpath", "left_anti")
    known = subsets.select("subset_uuid", F.lit(True).alias("_k"))
    return lost.join(known, "subset_uuid", "left").withColumn("action", F.when(F.col("_k"), "insert").otherwise("skip")).drop("_k")


def unmerged(batches: DataFrame, merge_log: DataFrame) -> DataFrame:
    """Batches of a source that the target has not merged, in (created_at, bid) order."""
    return batches.join(merge_log.select("producer_id", "bid"), ["producer_id", "bid"], "left_anti").orderBy("created_at", "bid")


def chain_breaks(batches: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Entries whose prev_hash is not the entry before them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return batches.filter(F.lit(True)).withColumn("_prev", F.coalesce(F.lag("entry_hash").over(w), F.lit(""))).filter("prev_hash <> _prev").drop("_prev")
