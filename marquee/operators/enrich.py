"""Films of the catalogue for listings: overrides first, then candidates by similarity with an ordered early stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.functions.text import normalize_title


def overrides_by_key(overrides: DataFrame) -> DataFrame:
    """(key, id) of (ord, raw_title, id); of equal keys the last wins."""
    return overrides.groupBy(normalize_title(F.col("raw_title")).alias("key")).agg(F.max_by("id", "ord").alias("override_id"))


def resolve(lookups: DataFrame, candidates: DataFrame, overrides: DataFrame | None = None, least: float = 0.62, stop: float = 0.9) -> DataFrame:
    """(key, id, score) of every lookup key that has an override or a good candidate.

    candidates: (key, query_ord, cand_ord, id, score). Queries are taken in order and none after the first that
    has a score of `stop`; each film counts with its best score; ties go to the film found first.
    """
    first_stop = F.min(F.when(F.col("score") >= stop, F.col("query_ord"))).over(W.partitionBy("key"))
    used = candidates.withColumn("stop", first_stop).where("stop is null or query_ord <= stop")
    per = used.groupBy("key", "id").agg(F.max("score").alias("score"), F.min(F.struct("query_ord", "cand_ord")).alias("first"))
    best = per.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "first"))).where(F.col("rank") == 1).where(F.col("score") >= least)
    # lookups and their films grow with the listings: merged, never broadcast
    out = lookups.select("key").distinct().hint("merge").join(best.select("key", "id", "score"), "key", "left")
    if overrides is not None:
        out = out.join(overrides_by_key(overrides), "key", "left").select("key", F.coalesce("override_id", "id").alias("id"), F.when(F.col("override_id").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"))
    return out.where("id is not null")


def recheck(ranked: DataFrame, details: DataFrame, least: float = 0.62, most: int = 3) -> DataFrame:
    """(key, id): for lookups without a good candidate, the first of their `most` best whose detailed titles are similar.

    ranked: (key, id, rank); details: (id, title, original_title).
    """
    from marquee.functions.text import bigrams, dice

    best = F.greatest(*[F.coalesce(dice(F.col("key"), t, bigrams(F.col("key")), bigrams(t)), F.lit(0.0)) for t in (normalize_title(F.col("title")), normalize_title(F.col("original_title")))])
    ok = ranked.where(F.col("rank") <= most).join(details.select("id", "title", "original_title"), "id").where(best >= least)
    return ok.groupBy("key").agg(F.min_by("id", "rank").alias("id"))


def sessions_with_films(sessions: DataFrame, films: DataFrame) -> DataFrame:
    """Sessions with the title of their film (movieId = id); those without a title are dropped."""
    return sessions.join(films.select(F.col("id").alias("movieId"), "title"), "movieId").where("title is not null and title <> ''")


def venue_or_error(df: DataFrame, venues: DataFrame, on: str = "cinema_id") -> DataFrame:
    """`df` with its venue's city; a venue that does not exist is an error, not a lost row."""
    out = df.join(venues.select(on, "city_id"), on, "left")
    return out.withColumn("city_id", F.when(F.col("city_id").isNull(), F.raise_error(F.concat(F.lit("unknown venue "), F.coalesce(F.col(on), F.lit("null"))))).otherwise(F.col("city_id")))
