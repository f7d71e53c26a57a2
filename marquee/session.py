"""Session helpers: reading tables, checkpoints in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the directory `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's `spark.checkpoint.dir`.

    Where neither that setting nor a checkpoint folder exists, a temporary folder is made if all executors are
    threads of this machine (`local[...]`, as in tests); on a cluster that is an error, as executors share no such folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marquee-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` as a table written to the shared folder: its lineage is cut and losing an executor loses no data.

    A table is computed once and has statistics, where a checkpoint of rows is computed twice and has none. The
    shuffle files of the writing are deleted with its end; else they stay until the driver collects its garbage.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a `checkpointed` table that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def as_micros(df: DataFrame, name: str) -> F.Column:
    """The column `name` (timestamp with or without zone, the latter read as UTC) as microseconds since 1970."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone()))
    return F.unix_micros(F.col(name))


def utc_wall(df: DataFrame, name: str) -> F.Column:
    """The column `name` as wall time in UTC, whatever the session's time zone."""
    return F.to_utc_timestamp(F.timestamp_micros(as_micros(df, name)), F.current_timezone())


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows; looks at no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left", rows: int = 50_000) -> DataFrame:
    """Join that broadcasts `right` only if a count proves it small; otherwise Spark's shuffled join (AQE splits skew)."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Spread the rows of a table that came as too few files evenly over all cores, by row position (no key, so no skew)."""
    n = cores(df.sparkSession) * per_core
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def tokenizer_dir() -> str:
    """Folder of the public vocabulary files; a parameter, never copied into the repository."""
    return os.environ.get("MARQUEE_TOKENIZERS", "/opt/tokenizers")
