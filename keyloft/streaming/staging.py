"""Staged payloads: small pieces wait in a table until enough rows of a subset are there to seal a part.

A claim marks the payloads that a writer works on. Payloads leave the table only after their rows are sealed, and a claim
that outlives its writer is taken back, so a crash between the two seals the rows again, which changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloft.operators import chunking
from keyloft.sources.catalog import Added, Snapshot
from keyloft.sources.store import Store

STALE_S = 1800


def route(subset_uuid: str = "subset_uuid", writers: int = 4) -> Column:
    """Writer of a subset: all its rows go to one."""
    return F.pmod(F.xxhash64(subset_uuid), F.lit(writers)).cast("int")


class Staging:
    def __init__(self, store: Store, alias: str, keys: list[str], order: list[str]):
        self.store, self.alias, self.keys, self.order = store, alias, keys, order
        store.catalog.ensure_dataset(alias)

    def table(self, head: Snapshot | None = None) -> DataFrame:
        return self.store.catalog.table(self.alias, head or self.store.catalog.head(self.alias), "staging")

    def _change(self, build, op: str) -> None:
        catalog = self.store.catalog
        catalog.commit(self.alias, lambda head: (head.schema, {"staging": build(self.table(head))}, {"op": op}))

    def enqueue(self, df: DataFrame, writers: int | None = None) -> None:
        """Adds the rows of df, one payload per subset, in a folder of their own.

        With writers, all rows of a subset are written by one of so many tasks.
        """
        catalog = self.store.catalog
        rel = f"{catalog.folder(self.alias)}/staged/{uuid.uuid4().hex}"
        keyed = df.withColumn("_subset", F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys]))
        if writers:
            keyed = keyed.withColumn("_w", route("_subset", writers)).repartition(writers, "_w").drop("_w")
        rows = self.store._save(keyed, rel)
        sizes = chunking.ordered_numbers(rows.groupBy("_subset").agg(F.count("*").alias("n_rows")), [], ["_subset"])

        def add(head: Snapshot):
            top = self.table(head).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            added = sizes.select((F.col("row_in_subset") + 1 + F.lit(top)).cast("long").alias("id"), F.col("_subset").alias("subset_uuid"), "n_rows", F.lit(catalog.now()).alias("created_at_epoch"), F.lit(rel).alias("payload"), F.lit(None).cast("string").alias("claimed_by"), F.lit(None).cast("long").alias("claimed_at"))
            return head.schema, {"staging": Added(added)}, {"op": "stage"}

        catalog.commit(self.alias, add)

    def claim(self, owner: str, part_rows: int) -> DataFrame:
        """Marks, per subset, the longest prefix of unclaimed payloads of part_rows rows at most (or the first alone)."""

        def mark(held: DataFrame) -> DataFrame:
            mine = chunking.prefix_claim(held.filter("claimed_by is null"), part_rows).select("id", F.lit(True).alias("_m"))
            marked = held.join(mine, "id", "left")
            now = F.lit(self.store.catalog.now())
            return marked.withColumn("claimed_by", F.when(F.col("_m"), F.lit(owner)).otherwise(F.col("claimed_by"))).withColumn("claimed_at", F.when(F.col("_m"), now).otherwise(F.col("claimed_at"))).select(held.columns)

        self._change(mark, "claim")
        return self.table().filter(F.col("claimed_by") == owner)

    def unclaim(self, owner: str) -> None:
        self._change(lambda held: held.withColumn("claimed_at", F.when(F.coalesce(F.col("claimed_by") == owner, F.lit(False)), F.lit(None).cast("long")).otherwise(F.col("claimed_at"))).withColumn("claimed_by", F.when(F.coalesce(F.col("claimed_by") == owner, F.lit(False)), F.lit(None).cast("string")).otherwise(F.col("claimed_by"))), "unclaim")

    def reclaim_stale(self, older_than_s: float = STALE_S) -> None:
        cutoff = self.store.catalog.now() - int(older_than_s * 1_000_000)

        def free(held: DataFrame) -> DataFrame:
            old = F.coalesce(F.col("claimed_by").isNotNull() & (F.col("claimed_at") <= cutoff), F.lit(False))
            return held.withColumn("_old", old).withColumn("claimed_by", F.when(F.col("_old"), F.lit(None).cast("string")).otherwise(F.col("claimed_by"))).withColumn("claimed_at", F.when(F.col("_old"), F.lit(None).cast("long")).otherwise(F.col("claimed_at"))).drop("_old")

        self._change(free, "reclaim")

    def delete_claimed(self, owner: str) -> None:
        self._change(lambda held: held.filter(~F.coalesce(F.col("claimed_by") == owner, F.lit(False))), "unstage")

    def seal_claimed(self, owner: str, part_rows: int) -> int:
        """Seals the rows of an owner's claim in one append and takes the payloads off; returns the number of payloads."""
        mine = self.table().filter(F.col("claimed_by") == owner)
        folders = [r[0] for r in mine.select("payload").distinct().toLocalIterator()]
        if not folders:
            return 0
        n = mine.count()
        rows = self.store.spark.read.parquet(*[self.store.files.uri(f) for f in folders]).withColumn("_f", F.regexp_extract(F.input_file_name(), "/staged/([0-9a-f]+)/", 1))
        wanted = mine.select(F.col("subset_uuid").alias("_subset"), F.regexp_extract("payload", "staged/([0-9a-f]+)$", 1).alias("_f"))
        self.store.append(self.alias, rows.join(wanted, ["_subset", "_f"], "left_semi").drop("_subset", "_f"), self.keys, self.order, part_rows)
        self.delete_claimed(owner)
        return n

    def drain(self, owner: str, part_rows: int) -> int:
        """Claims and seals until nothing waits."""
        total = 0
        while not self.claim(owner, part_rows).isEmpty():
            total += self.seal_claimed(owner, part_rows)
        return total
