"""Where intermediate results that must survive lost executors are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs on this machine."""
    where = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="nullweave-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set(SETTING, where)
    return where.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its files go when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/nullweave/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of `df`: written once to the shared folder, then read."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_row_number(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the place (from 1) of each row in the order of the columns, without a single-task window.

    Rows are range-partitioned and written; a place is the row's number within
    its partition plus the sizes of the partitions before (one row each)."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("_part").count().collect())):
        offsets.append((part, before))
        before += n
    shifts = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before")
