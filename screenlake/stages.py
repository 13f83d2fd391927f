"""Written intermediate results in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a single-machine session without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="screenlake-")
    return _local_dirs[sc.applicationId]


#: Makes Spark delete an execution's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stages:
    """Written intermediate results: each ``save`` cuts the lineage, so a lost executor repeats one stage only.

    ``save`` deletes the shuffle files of its own execution; ``finish`` deletes the steps that a result was made of.
    What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEAN, "false")
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEAN, before)
        if not self.names:
            fs, root = self._fs(self.root)
            fs.deleteOnExit(root)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._fs(f"{self.root}/{name}")
            fs.delete(p, True)
            self.names.remove(name)

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """``df`` written, and every step before it deleted."""
        steps = list(self.names)
        out = self.save(name, df)
        self.drop(*steps)
        return out


def numbered(df: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """``df`` with a gapless number from 0 in the order of ``order``, which should be total.

    Rows are dealt by range and numbered inside each range; what comes to the driver is one count for each range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = Stages(spark, "numbered").save("rows", df.repartitionByRange(ranges, *order).withColumn("__pid", F.spark_partition_id()))
    total, rows = 0, []
    for r in placed.groupBy("__pid").count().orderBy("__pid").collect():
        rows.append((r["__pid"], total))
        total += r["count"]
    if not rows:
        return placed.select(*df.columns, F.lit(0).cast("long").alias(name))
    base = F.element_at(F.create_map(*[F.lit(x) for r in rows for x in r]), F.col("__pid")).cast("long")
    nth = base + F.row_number().over(Window.partitionBy("__pid").orderBy(*order)) - 1
    return placed.withColumn(name, nth).drop("__pid")
