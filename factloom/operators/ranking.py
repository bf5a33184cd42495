"""Positions over a whole table without one task that holds it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() has the partition above these bits and the row's place below.
PLACE_BITS = 33


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, which a cluster names in spark.checkpoint.dir; a temporary one only where all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="factloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written to the shared folder as Parquet, whose columns are read apart."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Adds out: 1, 2, 3, ... in the order given, which must break all ties.

    The rows are sorted over range partitions and checkpointed, so that their
    places stay; a row's rank is its place in its partition plus the rows of the
    partitions before, a table of one row a partition.
    """
    placed = shared_checkpoint(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", PLACE_BITS)
    before = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own: Column = F.col("__place").bitwiseAND((1 << PLACE_BITS) - 1)
    ranked = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return ranked.withColumn(out, own + F.col("__before") + 1).drop("__place", "__part", "__before")
