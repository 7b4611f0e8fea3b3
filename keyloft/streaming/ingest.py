"""Ingest from streams and from user functions over task arguments."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from keyloft.scratch import Scratch
from keyloft.sources.store import Store
from keyloft.streaming.staging import Staging


def stream_into(store: Store, alias: str, stream: DataFrame, keys: list[str], order: list[str], checkpoint: str, part_rows: int = 100_000, compact_every: int = 0, **trigger) -> StreamingQuery:
    """Appends every micro-batch. The batch id is that of the stream and its epoch, so a replayed epoch changes nothing.

    Short parts that small batches leave are joined after every ``compact_every`` batches.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        store.append(alias, batch, keys, order, part_rows, bid=f"stream-{alias}-{epoch}")
        if compact_every and (epoch + 1) % compact_every == 0:
            store.compact(alias)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compute(tasks: DataFrame, worker: Callable[..., pd.DataFrame], schema: str, raise_on_error: bool = True) -> DataFrame:
    """Rows that worker makes of each row of tasks, called with its columns as keywords; plus column error.

    Without raise_on_error a failing task gives one row with nothing but its error.
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for args in batch.to_dict("records"):
                try:
                    yield worker(**args)[columns].assign(error=None)
                except Exception as e:
                    if raise_on_error:
                        raise
                    yield pd.DataFrame([{c: None for c in columns} | {"error": repr(e)}])

    return tasks.mapInPandas(run, f"{schema}, error string")


def ingest(store: Store, alias: str, tasks: DataFrame, worker: Callable[..., pd.DataFrame], schema: str, keys: list[str], order: list[str], part_rows: int = 100_000, raise_on_error: bool = True, staged: bool = False, writers: int | None = None) -> dict[str, int]:
    """Runs worker over tasks and seals what it makes, as one job; counts of tasks, rows and errors.

    With staged, rows wait as payloads by subset and are claimed and sealed part by part until nothing waits; with writers,
    one of so many tasks writes all payloads of a subset. Without, all rows are sealed in one append.
    """
    scratch = Scratch(store.spark, "ingest")
    made = scratch.save(compute(tasks, worker, schema, raise_on_error), "made")
    good = made.filter("error is null").drop("error")
    counts = {"tasks": tasks.count(), "rows": good.count(), "errors": made.filter("error is not null").count()}
    if not staged:
        store.append(alias, good, keys, order, part_rows)
    elif counts["rows"]:
        staging = Staging(store, alias, keys, order)
        staging.enqueue(good, writers)
        staging.drain(f"ingest-{uuid.uuid4().hex}", part_rows)
    scratch.drop(made)
    return counts


def bounded_stream(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None, size: str | None = None, format: str = "parquet") -> DataFrame:
    """A stream over the files of a folder that takes at most so many files, or bytes ("512m"), into one micro-batch.

    This is the back-pressure of an ingest: what waits stays where it is.
    """
    reader = spark.readStream.schema(schema).format(format)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    reader = reader.option("maxBytesPerTrigger", size) if size else reader
    return reader.load(path)
