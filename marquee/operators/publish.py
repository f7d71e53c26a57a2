"""Sinks: a table by day, a snapshot document, and state that is swapped in as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.session import checkpointed, empty


def write_days(df: DataFrame, path: str, by: str = "date") -> None:
    """Replace the published table, one folder per day, so that a reader of one day reads only that."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Documents as JSON lines; absent values are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def numbered(df: DataFrame, *order: Column, into: str = "position") -> DataFrame:
    """`df` with the place of each row in a total order, from 1: sorted by ranges in parallel, written down, then counted through.

    Only the number of rows of each range goes to one place, so no task holds all rows.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_before"))  # a row per range
    at = F.col("_row") - F.shiftleft(F.shiftright("_row", 33), 33) + F.col("_before") + 1
    return placed.withColumn("_part", F.shiftright("_row", 33)).join(F.broadcast(before), "_part").withColumn(into, at).drop("_row", "_part", "_before")


def swap_state(df: DataFrame, base: str) -> str:
    """Write a new version of a state table; it counts from the moment its own mark of completion exists. Returns its folder.

    Versions are never overwritten: a writer that fails leaves the version before it current.
    """
    spark = df.sparkSession
    target = f"{base}/v-{max(_versions(spark, base), default=0) + 1:012d}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(target)
    return target


def _folders(spark: SparkSession, base: str) -> list[str]:
    """The complete versions below `base`, the oldest first."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("v-")]
    done = [p.toString() for p in found if fs.exists(sc._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done, key=lambda p: p.rsplit("/", 1)[1])


def _versions(spark: SparkSession, base: str) -> list[int]:
    return [int(p.rsplit("/", 1)[1].split("-")[1]) for p in _folders(spark, base)]


def read_state(spark: SparkSession, base: str, schema: str | StructType) -> DataFrame:
    """The newest complete version of a state table, an empty one if there is none. A version that cannot be read is an error."""
    done = _folders(spark, base)
    return spark.read.schema(schema).parquet(done[-1]) if done else empty(spark, schema)


def next_failures(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source, failures): one more than before for a source that failed, 0 for one that did not."""
    x = now.join(before.select("source", F.col("failures").alias("old")), "source", "left")
    return x.select("source", F.when(F.col("ok"), 0).otherwise(F.coalesce("old", F.lit(0)) + 1).alias("failures"))
