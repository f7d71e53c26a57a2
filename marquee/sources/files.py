"""Readers of the landing zone: JSON documents, pages, tables, with a typed empty result where there is nothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marquee.functions import classify, temporal
from marquee.session import empty


def json_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The JSON documents below `path` that can be read; a broken document gives no row, nothing at all an empty table of that schema."""
    fields = spark.createDataFrame([], schema).schema
    try:
        marked = StructType([*fields.fields, StructField("_broken", StringType())])
        read = spark.read.schema(marked).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    except PySparkException:
        return empty(spark, schema)
    return read.where("_broken is null").drop("_broken")


def landed_pages(spark: SparkSession, path: str, most: int = 8 << 20) -> DataFrame:
    """(url, body, error) of the pages below `path`; a larger file is not read and has an error in place of its body."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most).select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"))
    large = files.where(F.col("length") > most).select(F.col("path").alias("url"), F.lit(None).cast("string").alias("body"), F.concat(F.lit(f"more than {most} bytes: "), F.col("length").cast("string")).alias("error"))
    return small.unionByName(large)


SESSION = "struct<id:string,cinemaId:string,movieId:string,sessionId:string,screenName:string,technologies:array<array<string>>,showtime:string>"


def api_sessions(days: DataFrame, window: list[str] | None = None) -> DataFrame:
    """Screenings of day documents (body): date and time as printed, audio by flag, formats, within the window."""
    doc = F.from_json("body", f"struct<date:string,sessions:array<{SESSION}>>")
    s = days.select("landing_id", F.posexplode(doc["sessions"]).alias("ord", "s")).select("landing_id", "ord", "s.*").where("id is not null")
    return screenings(s, window)


def screenings(sessions: DataFrame, window: list[str] | None = None, films: DataFrame | None = None) -> DataFrame:
    """Screenings of sessions: date and time as printed, audio, format, within the window.

    films (id, titleCalculated, title, titleOriginalCalculated): sessions get the first of these titles that is there
    and are dropped without one; a title that says so makes a screening dubbed, as does the flag among the technologies.
    """
    s = sessions
    if films is not None:
        titles = films.select(F.col("id").alias("movieId"), F.coalesce("titleCalculated", "title", "titleOriginalCalculated").alias("rawTitle")).where("rawTitle is not null and rawTitle <> ''").dropDuplicates(["movieId"])
        s = s.join(titles, "movieId")
    date, time = temporal.wall_parts(F.col("showtime"))
    flat = F.filter(F.flatten(F.filter("technologies", lambda g: g.isNotNull())), lambda x: x.isNotNull())
    dubbed = F.coalesce(F.exists(flat, lambda x: F.upper(x) == "SINH"), F.lit(False))
    if films is not None:
        dubbed = dubbed | (classify.detect_audio(F.col("rawTitle")) == "dubbed")
    out = s.select("landing_id", "ord", "id", "movieId", date.alias("date"), time.alias("time"), F.when(dubbed, "dubbed").otherwise("subtitled").alias("audio"), classify.detect_format(F.array_join(F.coalesce(flat, F.array().cast("array<string>")), " ")).alias("format"), *(["rawTitle"] if films is not None else []))
    out = out.where("date is not null")
    return out.where(F.col("date").isin(window)) if window is not None else out


def scan(readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of all sources that can be read, and the error of each that cannot; one failing source stops none."""
    parts, errors = [], {}
    for name, reader in readers.items():
        try:
            df = reader().withColumn("source", F.lit(name))
            if df.isEmpty():
                errors[name] = "no listings"
            else:
                parts.append(df)
        except Exception as e:
            errors[name] = str(e).split("\n")[0].split("?")[0]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None), errors


def with_last_good(live: DataFrame | None, previous: DataFrame, failed: list[str]) -> DataFrame:
    """Live rows, and for failed sources those of their last good run, marked stale."""
    old = previous.where(F.col("source").isin(failed)).withColumn("stale", F.lit(True))
    return old if live is None else live.withColumn("stale", F.lit(False)).unionByName(old, allowMissingColumns=True)
