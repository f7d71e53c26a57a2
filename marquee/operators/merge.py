"""One record per work: picks by trust and order, ordered unions, display title, domestic films."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.functions.text import clean_title, normalize_title, tidy_title, trimmed
from marquee.session import join_small

DOMESTIC = ["RS", "SRB", "SR"]


def first_by(value: Column, order: Column, usable: Column) -> Column:
    """The usable value that comes first in the order; an aggregate with partial sums."""
    return F.min_by(F.when(usable, value), F.when(usable, order))


def letter_case(title: Column) -> Column:
    """Share of lower-case letters among the letters of a title."""
    letters = F.regexp_replace(title, r"[^\p{L}]", "")
    return F.when(letters == "", 0.0).otherwise(F.length(F.regexp_replace(letters, r"[^\p{Ll}]", "")) / F.length(letters))


def display_title(ordered: Column) -> Column:
    """The title to show of the array of candidates in order: clearly more lower case wins, else the shorter one."""
    better = lambda a, b: letter_case(b) - letter_case(a)
    pick = lambda a, b: F.when(a.isNull(), b).when(better(a, b) > 0.05, b).when(better(a, b) < -0.05, a).when(F.length(b) < F.length(a), b).otherwise(a)
    return F.coalesce(F.aggregate(ordered, F.lit(None).cast("string"), pick), F.lit("Nepoznat film"))


def ordered_union(rows: DataFrame, group: str, items: str, order: list[str]) -> DataFrame:
    """(group, items): the distinct non-null elements of an array column over the rows of a group, as they first appear.

    Elements are made distinct before they are collected, so a group of very many rows stays as small as its set.
    """
    each = rows.select(group, *order, F.posexplode(items).alias("_i", "_x")).where("_x is not null")
    first = each.groupBy(group, "_x").agg(F.min(F.struct(*order, "_i")).alias("_o"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_x"))), lambda e: e["_x"]).alias(items))


def merge_records(listing: DataFrame, group: str, venue: DataFrame) -> DataFrame:
    """One row per group with the values picked from its listings, length and original title from the most trusted venue first.

    The display title depends on the order of all titles and cannot be combined from parts, so the titles of a group
    meet in one row, as do the candidates of the original title (texts only, distinct ones of a venue's listing).
    """
    trust = venue.groupBy("cinema_id").agg(F.min("trust_rank").alias("trust_rank"))
    rows = join_small(listing.drop("trust_rank"), trust, "cinema_id").where(F.col(group).isNotNull())
    by_trust = F.struct(F.coalesce("trust_rank", F.lit(1 << 30)).alias("t"), "venue_ord", "listing_ord", "listing_id")
    by_order = F.struct("venue_ord", "listing_ord", "listing_id")
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    cleaned = clean_title(F.col("raw_title"))
    title = F.when(cleaned != "", cleaned).otherwise(trimmed(F.col("raw_title")))
    agg = rows.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(by_order.alias("o"), title.alias("v")))).alias("x"),
        first_by(F.col("poster_url"), by_order, some("poster_url")).alias("poster_url"),
        first_by(F.col("runtime_minutes"), by_trust, F.col("runtime_minutes") > 0).alias("runtime_minutes"),
        first_by(F.col("synopsis"), by_order, some("synopsis")).alias("synopsis"),
        F.array_sort(F.collect_list(F.struct(by_trust.alias("o"), tidy_title(F.col("original_title")).alias("v"), tidy_title(F.col("clean_title")).alias("c")))).alias("originals"),
        F.coalesce(F.bool_or(F.col("origin_country").isin(DOMESTIC)), F.lit(False)).alias("domestic"),
        F.countDistinct("cinema_id").alias("cinemas"),
    )
    shown = display_title(F.filter(F.transform("x", lambda e: e["v"]), lambda v: v.isNotNull() & (v != "")))
    other = F.filter(F.concat(F.transform("originals", lambda e: e["v"]), F.transform("originals", lambda e: e["c"])), lambda v: v.isNotNull() & (v != ""))
    out = agg.withColumn("title", shown).withColumn("originals", other)
    out = out.withColumn("key", normalize_title(F.col("title"))).withColumn("original_title", F.get(F.filter("originals", lambda v: normalize_title(v) != F.col("key")), F.lit(0)))
    genres = ordered_union(rows, group, "genres", ["venue_ord", "listing_ord", "listing_id"])
    return out.drop("x", "key").hint("merge").join(genres, group, "left").withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def domestic_audio(audio: Column, flag: Column, group: str) -> Column:
    """Subtitled screenings of a domestic film are in its original language: the flag is pushed back to the whole group."""
    home = F.max(flag.cast("int")).over(W.partitionBy(group)) == 1
    return F.when((audio == "subtitled") & F.coalesce(home, F.lit(False)), "original").otherwise(audio)
