"""Tables between two steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings for what goes to Python at once. Texts are long, so rows are fewer than by default and bytes are bounded.
ROWS_PER_BATCH, BYTES_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

_own: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without the setting; it gets a temporary folder. On a cluster a missing setting is an
    error, because a machine's own folder is lost with the machine.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if os.getpid() not in _own:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[os.getpid()] = tempfile.mkdtemp(prefix="keyloft-")
        atexit.register(shutil.rmtree, _own[os.getpid()], ignore_errors=True)
    return "file://" + _own[os.getpid()]


#: Folders of the Scratch objects made in each open block; names only, for classes that make one are sent to executors.
_open: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, every table that was written by a Scratch made in it.

    What is to outlive the block has to be written by a Scratch made outside.
    """
    _open.append([])
    try:
        yield
    finally:
        for root in _open.pop():
            _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended; the folder is only scratch
        if path.startswith("file:"):
            shutil.rmtree(path[5:] if not path.startswith("file://") else path[7:], ignore_errors=True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    ``save`` writes and rereads a DataFrame, ``drop`` deletes tables that nothing reads any more. What is left goes when
    the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/keyloft/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if spark.conf.get(ROWS_PER_BATCH) == "10000":
            spark.conf.set(ROWS_PER_BATCH, "1000")
        if int(spark.conf.get(BYTES_PER_BATCH, None) or -1) < 0:
            spark.conf.set(BYTES_PER_BATCH, str(16 << 20))
        atexit.register(_delete, spark, self.root)
        if _open:
            _open[-1].append(self.root)

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the tables of DataFrames that ``save`` returned; others are left alone."""
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                _delete(self.spark, path)
