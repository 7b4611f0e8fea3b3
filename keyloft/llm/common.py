"""Shared plumbing of the llm operators: tables, shared scratch tables, worker code and bounded broadcasts."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.scratch import Scratch, shared_dir  # noqa: F401  (used by the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, whichever task runs in it."""
    held = sys.modules.get("_keyloft_worker_store")
    if held is None:
        held = sys.modules["_keyloft_worker_store"] = types.ModuleType("_keyloft_worker_store")
        held.store = {}
    return held.store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(batches, keep: tuple[str, ...] = ()):
    """The same batches; what other operators left in the worker goes first, unused memory goes back to the system last."""
    store = worker_store()
    for key in [k for k in store if (k[0] if isinstance(k, tuple) else k) not in keep]:
        del store[key]
    yield from batches
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def map_arrow(df: DataFrame, run, schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """df.mapInArrow(run, schema) that tidies up around each task; keep names what it shares in the worker's store."""
    return df.mapInArrow(lambda batches: tidy(run(batches), keep), schema)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


#: Words of 64 bits in the bitmap of ``maybe_among``.
BITMAP_WORDS = 1 << 16


def maybe_among(rows: DataFrame, ids: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among ids, and the rest, whose key is not; nothing is shuffled.

    A bitmap of hashed ids, BITMAP_WORDS rows at most, is broadcast. Many more ids than it has bits fill it, and then
    most rows pass.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(64 * BITMAP_WORDS))
    word, bit = F.floor(place / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    bitmap = F.broadcast(ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    hit = (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return rows.join(bitmap, hit, "left_semi"), rows.join(bitmap, hit, "left_anti")


def semi_join(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids, where ids are few beside the rows: most other rows go before the shuffle."""
    return maybe_among(rows, ids, key)[0].join(ids, key, "left_semi")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def white_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
