"""Files of any Hadoop file system, from the driver."""

from __future__ import annotations

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.operators.predicates import not_ignored


class Files:
    """Small files and names under one root. Every path is relative and can't leave the root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, rel: str):
        if rel.startswith("/") or ".." in rel.split("/"):
            raise ValueError(f"{rel!r} leads out of the store")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def uri(self, rel: str) -> str:
        self._path(rel)
        return f"{self.root}/{rel}"

    def exists(self, rel: str) -> bool:
        return self._fs.exists(self._path(rel))

    def create(self, rel: str, text: str) -> bool:
        """Writes a new file; False if it is there already, so of several writers one wins."""
        try:
            out = self._fs.create(self._path(rel), False)
        except Exception as e:
            if self.exists(rel):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        return True

    def read(self, rel: str) -> str:
        stream = self._fs.open(self._path(rel))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, rel: str) -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(rel))) if self.exists(rel) else []

    def age_ms(self, rel: str, now_ms: int) -> int:
        return now_ms - self._fs.getFileStatus(self._path(rel)).getModificationTime()

    def delete(self, rel: str) -> bool:
        return self._fs.delete(self._path(rel), True)

    def prune(self, rel: str, stop: str) -> None:
        """Deletes empty folders from rel upwards, stop excluded."""
        while rel != stop and rel.startswith(f"{stop}/") and self.exists(rel) and not self._fs.listStatus(self._path(rel)):
            self._fs.delete(self._path(rel), False)
            rel = rel.rpartition("/")[0]

    def discover(self, rel: str, include: list[str], exclude: list[str] | None = None) -> DataFrame:
        """path, below the folder, of every file that a glob of include matches and none of exclude."""
        found = self.scan(rel, "*").select(F.expr(f"substring(path, instr(path, '/{rel}/') + {len(rel) + 2})").alias("path"))
        wanted = F.lit(False)
        for pattern in include:
            wanted |= ~not_ignored(F.col("path"), [pattern])
        return found.filter(wanted & not_ignored(F.col("path"), exclude or []))

    def scan(self, rel: str, pattern: str = "*.parquet") -> DataFrame:
        """path of every matching file below a folder, listed by Spark without reading content."""
        try:
            return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(self.uri(rel)).select("path")
        except PySparkException:
            return self.spark.createDataFrame([], "path string")
