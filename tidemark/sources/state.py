"""State tables in versions: a run writes a new version and then points to it, so readers never see half of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Claimed(RuntimeError):
    """Another writer has the next version of a table."""


class StateStore:
    """Named tables under a folder: ``<folder>/<name>/v=<number>``, of which the largest finished number counts.

    Spark marks a version as finished by its commit, so a run that is cut short leaves the old version in force.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self, name: str) -> int:
        """The version in force; 0 if there is none."""
        fs, where = self._fs(f"{self.folder}/{name}")
        if not fs.exists(where):
            return 0
        done = [x.getPath() for x in fs.listStatus(where) if fs.exists(self._fs(f"{x.getPath()}/_SUCCESS")[1])]
        return max((int(p.getName().removeprefix("v=")) for p in done), default=0)

    def load(self, name: str, schema: str) -> DataFrame:
        """The table in force, or an empty one."""
        at = self.version(name)
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v={at}")

    def exists(self, name: str) -> bool:
        return self.version(name) > 0

    def save(self, name: str, rows: DataFrame, after: int | None = None) -> int:
        """Write the next version; the rows may read the one in force.

        ``after`` is the version that the rows were made from, the one in force unless given.  The version that follows it
        is claimed first, by a file that only one writer can create; the other gets :class:`Claimed` and has written
        nothing.  A writer that fails gives its claim back; after one that was killed, :meth:`release` does.  The file
        system must create files atomically, as HDFS and local ones do.
        """
        at = (self.version(name) if after is None else after) + 1
        fs, mark = self._fs(f"{self.folder}/_claims/{name}/v={at}")
        if self.version(name) >= at or not self._create(fs, mark):
            raise Claimed(f"version {at} of {name} is another writer's")
        try:
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={at}")
        except BaseException:
            fs.delete(mark, False)
            raise
        return at

    @staticmethod
    def _create(fs, mark) -> bool:
        fs.mkdirs(mark.getParent())
        return fs.createNewFile(mark)

    def release(self, name: str) -> None:
        """Take back the claim on the next version, of a writer that is known to be dead."""
        fs, mark = self._fs(f"{self.folder}/_claims/{name}/v={self.version(name) + 1}")
        fs.delete(mark, False)


def json_lines(rows: DataFrame) -> DataFrame:
    """The rows as JSON text, for an output that Spark does not write."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
