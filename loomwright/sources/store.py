"""Tables that a run keeps in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Intermediate tables under ``spark.checkpoint.dir``, or in a folder of one's own, which driver and executors share.

    A table that is kept has no lineage: what a lost executor had costs tasks of its own level
    alone. All go when the driver ends, but those of a folder of one's own. Where neither is set a folder in
    /tmp serves on one machine; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark = spark
        if folder is not None:
            self.root = folder.rstrip("/")
            return
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file:///tmp/checkpoints"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, system = self._path("")
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again, with its schema."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        """Whether a table was written whole: Spark marks those."""
        path, system = self._path(f"{name}/_SUCCESS")
        return system.exists(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, system = self._path(name)
            system.delete(path, True)
