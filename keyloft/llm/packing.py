"""Packing of tokenized documents into sequences by the sum-of-squares rule.

A piece goes to the open bin, or to a new one, for which the sum over all residual gaps of the squared number of open
bins with that gap becomes smallest; of equals, to the fullest bin. Pieces are dealt evenly over groups of bounded size,
each packed on its own from the longest piece to the shortest; bins that stay open are packed once more as whole items
across groups, by the same rule.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.common import Scratch, tokenizer_path, map_arrow, table
from keyloft.llm.tokens import SHARED, Encoder

#: Pieces (or open bins) that one task packs.
GROUP_ROWS = 100_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Items are taken from the longest to the shortest."""
    far = 1 << 60
    leave = np.full(capacity + 1, far, dtype=np.int64)  # change of the sum when a bin of this gap goes
    leave[capacity] = 0  # a new bin
    arrive = np.ones(capacity + 1, dtype=np.int64)  # change when a bin of this gap comes
    arrive[0] = 0
    count = [0] * (capacity + 1)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        gap = size + int(np.argmin(leave[size:] + arrive[: capacity + 1 - size]))
        if gap == capacity:
            at = len(fills)
            fills.append(0)
        else:
            at = open_bins[gap].pop()
            count[gap] -= 1
            leave[gap] = 1 - 2 * count[gap] if count[gap] else far
            arrive[gap] = 2 * count[gap] + 1
        bins[i], offsets[i] = at, fills[at]
        fills[at] += size
        left = gap - size
        if left:
            open_bins[left].append(at)
            count[left] += 1
            leave[left] = 1 - 2 * count[left]
            arrive[left] = 2 * count[left] + 1
    return bins, offsets, np.array(fills, np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: token ids of each document and the end id, cut after every ``capacity`` ids."""

    def run(batches):
        kinds = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32")])
        encoder = Encoder(tokenizer, lambda ids: np.asarray(ids, "<u4").tobytes(), "ids")
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = [array("q") for _ in range(4)]
                doc_ids: list[int | None] = []
                for doc_id, values in zip(part.column("doc_id").to_pylist(), encoder.values([x or "" for x in part.column("text").to_pylist()])):
                    ids = memoryview(b"".join(values) + end)
                    for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        doc_ids.append(doc_id)
                        for column, x in zip(out, (piece, a // 4, len(own) // 4, zlib.crc32(own))):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(np.frombuffer(c, np.int64)) if len(c) else pa.array([], pa.int64()) for c in out)], schema=kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, piece long, start long, length long, ids_crc32 long", SHARED)


def _pack_rows(rows: DataFrame, n: int, capacity: int, keep: list[str], size: str, names: tuple[str, str, str]) -> DataFrame:
    """Packs rows in even groups; adds the bin, the offset in it and the bin's fill, under ``names``."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        bins, offsets, fills = sum_of_squares(whole.column(size).to_numpy(), capacity)
        bins_at = bins + (np.int64(TaskContext.get().partitionId()) << 32)
        for name, values in zip(names, (bins_at, offsets, fills[bins])):
            whole = whole.append_column(name, pa.array(values))
        yield from whole.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"{c} long" for c in [*keep, *names])
    return map_arrow(rows.select(keep).repartition(max(1, -(-n // GROUP_ROWS))), run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its token ids
    and then end_id; only those longer than capacity are cut. A null or empty text is the end id alone. Repeated rows and
    null doc_ids are packed like any other row; other columns are ignored. A text of any length is tokenized whole. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, tokenizer, capacity, end_id), "pieces")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    n = cut.filter(F.col("length") < capacity).count()
    full = cut.filter(F.col("length") == capacity).select(*keep, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = scratch.save(_pack_rows(cut.filter(F.col("length") < capacity), n, capacity, keep, "length", ("bin", "at", "fill")), "packed")
    bins = packed.filter(F.col("at") == 0).filter(F.col("fill") < capacity).select("bin", "fill")
    again = scratch.save(_pack_rows(bins, bins.count(), capacity, ["bin", "fill"], "fill", ("to", "base", "total")), "again")
    moved = packed.join(again.select("bin", "to", "base"), "bin", "left")
    low = 1 << 60  # apart from the numbers of bins that were full at once
    out = full.union(moved.select(*keep, F.coalesce(F.col("to") + low, "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset")))
    return out.withColumn("piece", F.col("piece").cast("int"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 word-BPE tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
