"""What the corpus operators share: words, inputs and tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the six ASCII characters that ``bytes.split()`` splits on.
SPACE = r"[\x20\x09-\x0D]+"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"
#: Maps bytes A-Z to a-z and no others.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark's functions take it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def words(text: str | Column) -> Column:
    """The words of a text, in order; none for null. Cutting the ends first leaves no empty word to filter out."""
    text = F.col(text) if isinstance(text, str) else text
    inside = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, SPACE))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what an Arrow batch of whole texts holds; Spark also bounds it in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Workspace:
    """Intermediate tables under ``spark.checkpoint.dir``, which driver and executors share.

    Writing a table there cuts the lineage: a lost executor costs at most the tasks it
    ran, never a whole iteration. ``drop`` removes a table that nothing reads any more; what
    a result still reads goes when the driver ends. Where the setting is absent a folder in
    /tmp serves on one machine (tests); on a cluster, where each executor would write its own,
    that is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file:///tmp/checkpoints"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again; its schema is kept for an empty result too."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)
