"""Tables written to the folder that all executors share, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local session gets one of its own; a cluster is an error."""
    where = spark.conf.get(SETTING, None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="edgeframe-"))
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


class Scratch:
    """One run's folder of Parquet tables under :func:`shared_dir`, removed when the driver's JVM ends.

    Results are lazy and read these tables, so none that a result needs can go before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/edgeframe-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        path, system = self._at(self.root)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _at(self, where: str):
        """The path and its file system."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """Write ``df`` once and return the table read back."""
        where = self.path(name)
        writer = df.write
        if codec:
            writer = writer.option("compression", codec)
        writer.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            where = getattr(table, "_scratch_path", None)
            if where:
                path, system = self._at(where)
                system.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
