"""Balanced shards of documents whose equal texts must stay together, by Karmarkar-Karp differencing.

Groups of equal texts that are large beside a shard are items of their own: those of at least one HEAD-th of a shard, so
there are at most shards * HEAD of them. All other groups are bundled by hash into a fixed number of items. The driver
differences these few thousand sums, whatever the size of the corpus.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloft.llm.common import Scratch, table

#: A group is an item of its own from this part of a mean shard on; number of bundles of smaller groups; buckets of a shard's slots.
HEAD, BUNDLES, BUCKETS = 64, 4096, 512


def differencing(sizes: list[int], parts: int) -> list[int]:
    """Part (from 0) of each item, by multi-way Karmarkar-Karp differencing.

    Each partial partition has ``parts`` sums. The two with the largest spread between sums are combined, the largest sum
    of one with the smallest of the other, until one is left. Ties go by item order, so the result is deterministic.
    """
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [0] * (parts - 1) + [size], [None] * (parts - 1) + [(i,)]))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, items_a = heapq.heappop(heap)
        _, _, sums_b, items_b = heapq.heappop(heap)
        merged = sorted(((x + y, k) for k, (x, y) in enumerate(zip(sums_a, reversed(sums_b)))))
        low = merged[0][0]
        joined = [(a, b) if a and b else a or b for a, b in zip(items_a, reversed(items_b))]
        heapq.heappush(heap, (low - merged[-1][0], n, [x - low for x, _ in merged], [joined[k] for _, k in merged]))
        n += 1
    out = [0] * len(sizes)
    for part, tree in enumerate(heap[0][3] if heap else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if node is None:
                continue
            if len(node) == 1:
                out[node[0]] = part
            else:
                stack += node
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs, shards near equal in bytes.

    Size is the UTF-8 bytes of the text plus 8; a null text counts as an empty one, of the same group. Equal texts share a
    shard, so a group larger than a mean shard makes its shard that large. Slots number the rows of a shard from 0 without
    gaps, by doc_id within hash buckets. Null or repeated doc_ids are rows like others; other columns are ignored. A text of
    any length is hashed whole, as one cell. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.md5("text")).alias("key"))
    rows = scratch.save(rows, "rows").withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(BUNDLES)).cast("int"))
    groups = scratch.save(rows.groupBy("key", "bundle").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * shards * HEAD > total
    head = [(bytes(r.key), r.bytes) for r in groups.filter(large).sort("key").select("key", "bytes").collect()]  # fewer than shards * HEAD
    tail = [(r.bundle, r.bytes) for r in groups.filter(~large).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).sort("bundle").collect()]
    placed = differencing([b for _, b in head] + [b for _, b in tail], shards)
    by_key = spark.createDataFrame([(k, s) for (k, _), s in zip(head, placed)], "key binary, head_shard int")
    by_bundle = spark.createDataFrame([(k, s) for (k, _), s in zip(tail, placed[len(head) :])], "bundle int, tail_shard int")
    rows = rows.join(F.broadcast(by_key), "key", "left").join(F.broadcast(by_bundle), "bundle", "left")
    rows = rows.select("doc_id", "size", "text_crc32", F.coalesce("head_shard", "tail_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    rows = scratch.save(rows, "placed")

    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards * BUCKETS rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("place", F.row_number().over(place) - 1).join(F.broadcast(starts), ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"))
