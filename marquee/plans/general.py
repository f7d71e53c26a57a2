"""Queries of the general data problems: mixed timestamps (p2) and nested records (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import instants, shred
from marquee.session import spread, table

#: What the lists of the two record types are deep, also where all records of a table have fewer.
DAY_LEVELS = {"sessions": 1, "sessions.technologies": 2}
DETAIL_LEVELS = {"release_dates": 1, "release_dates.release_dates": 1, "videos": 1}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """landing_id, child, ord1, ord2, ord3, leaf of every non-null innermost child."""
    bodies = lambda name: spread(table(spark, sf_dir, name).select("landing_id", "body"))
    days = shred.flatten(bodies("api_session_day"), "landing_id", "body", ["sessions", "sessions.technologies.[]"], DAY_LEVELS)
    details = shred.flatten(bodies("details_response"), "landing_id", "body", ["release_dates.release_dates", "videos"], DETAIL_LEVELS, inherit=True)
    at = lambda i: F.coalesce(F.get("own", F.lit(i)), F.lit(0))
    kind = F.col("element")
    a = days.select(
        F.col("record").alias("landing_id"),
        F.when(kind == "sessions", "session").otherwise("technology").alias("child"),
        at(0).alias("ord1"), at(1).alias("ord2"), at(2).alias("ord3"),
        F.when(kind == "sessions", F.col("columns")["id"]).otherwise(F.col("scalar")).alias("leaf"),
    )
    country = F.coalesce(F.col("columns")["release_dates/iso_3166_1"], F.lit(""))
    b = details.select(
        F.col("record").alias("landing_id"),
        F.when(kind == "videos", "video").otherwise("release_date").alias("child"),
        at(0).alias("ord1"), at(1).alias("ord2"), at(2).alias("ord3"),
        F.when(kind == "videos", F.col("columns")["key"]).otherwise(F.concat(country, F.lit(":"), F.coalesce(F.col("columns")["certification"], F.lit("")))).alias("leaf"),
    )
    return a.unionByName(b).where("landing_id is not null and leaf is not null")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, row_id, instant_us of every start that is not in plain form or falls on a day of clock change."""
    return instants.found(table(spark, sf_dir, "showtime"), table(spark, sf_dir, "api_session"))


def queries() -> dict:
    return {"p2_found": p2_found, "p3_found": p3_found}
