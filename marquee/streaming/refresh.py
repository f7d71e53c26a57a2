"""The hourly refresh as a stream: landed screenings into a table by day, and counts by event time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marquee.session import shared_folder


def landed(spark: SparkSession, folder: str, schema: StructType, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def refresh(stream: DataFrame, target: str, checkpoint: str, key: str = "showtime_id", order: str = "landed_at", by: str = "date"):
    """Append each batch's newest row per key to `target`, partitioned by day. A repeated batch overwrites its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns]), order).alias("x")).select("x.*")
        newest.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").partitionBy(by).parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per window of event time and group; rows later than `late` behind the newest are not waited for."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(group)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def refreshed(spark: SparkSession, target: str, key: str = "showtime_id", order: str = "landed_at") -> DataFrame:
    """The newest row of every key over all batches of `refresh`, so that a row landed again stands once."""
    rows = spark.read.option("basePath", target).parquet(target)
    cols = [F.col(c) for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, "batch")).alias("x")).select("x.*")


def run_to_table(stream: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over what has landed and return the last value of every key as a table in the shared folder.

    In `update` mode a batch writes the groups that it changed, each batch in a folder of its own (so a repeated batch
    overwrites itself), and groups behind the watermark leave the state.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{name}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    try:
        out = spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out")
    except AnalysisException:  # nothing has landed, so no batch was written
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest]).select(*stream.columns)
