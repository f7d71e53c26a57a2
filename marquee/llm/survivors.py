"""One surviving record for each group of duplicates, field by field.

Every listing's fields are unpivoted to (group, field, value); values that cannot be used are dropped; the rest
are ranked by trust, recency and id in a window per (group, field), and rank 1 stays. Spark prunes each map
task's rows to one per (group, field) before the shuffle (window group limit), so a group that holds a third of
all rows reaches its task as one row per map task.

A null group key makes no group; groups of one row give no rows; a field without any usable value gives no
row; null trust ranks last; ties of trust and time go to the smaller listing_id; repeated rows (same id) give
one row. Empty tables give none. Columns with clashing names are dropped before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.session import join_small

FIELDS = ("raw_title", "original_title", "runtime_minutes", "poster_url")
#: What stands in for a missing value, after trimming, lower case and brackets removed.
STAND_INS = ["", "-", "--", "---", "—", "/", "//", "?", "??", "???", ".", "..", "x", "n/a", "na", "n.a.", "null", "none", "nan", "nil", "undefined", "unknown", "untitled", "tba", "tbd", "tbc", "film bez naslova", "bez naslova", "naslov", "naslov filma", "naziv", "naziv filma", "uskoro", "coming soon", "title", "original title", "originalni naslov", "nema", "nema podataka", "nepoznato", "nepoznat", "no title", "test", "lorem ipsum", "0", "—-", "–", "без наслова", "ускоро", "непознато", "нема података"]
#: Texts of other fields: a label and its value, a length, a link.
OTHER_FIELD = r"(?iu)^\s*(?:(?:trajanje|žanr|zanr|žanrovi|režija|rezija|reditelj|glume|uloge|glumci|godina|zemlja|premijera|distributer|jezik|format|opis|sinopsis|cast|genre|runtime|director|duration|year|country|трајање|жанр|режија)\s*:|https?://|www\.|\d{1,3}\s*min\b)"
#: Broken encoding: replacement characters, UTF-8 read as Windows-1252 or Latin-1, question marks inside words.
BROKEN = r"\x{FFFD}|[ÃÄÅÐÑ][\x{0080}-\x{00BF}\x{0152}\x{0153}\x{0160}\x{0161}\x{0178}\x{017D}\x{017E}\x{0192}\x{02C6}\x{02DC}\x{2013}\x{2014}\x{2018}-\x{201E}\x{2020}-\x{2022}\x{2026}\x{2030}\x{2039}\x{203A}\x{20AC}\x{2122}]|\p{L}\?\p{L}|â€|&#\d+;|&[a-z]+;"
CUT_OFF = r"(?:\.\.\.|…)\s*$"
#: A poster's address: web address, a path, a picture's ending; and words of pictures that stand in for one.
POSTER = r"(?i)^https?://[^/\s]+\.[^/\s]+/(?:[^\s?#]*/)?[^\s/?#]+\.(?:jpe?g|png|webp|avif|gif)(?:[?#]\S*)?$"
NO_POSTER = r"(?i)(?:default|placeholder|no[-_]?(?:poster|image|img|photo)|nema[-_]?(?:slike|poster)|blank|uskoro|coming[-_]?soon|dummy|missing|empty|spacer|1x1|undefined|null)[^/]*$"
FEATURE_MINUTES = (40, 300)


def usable_text(c: Column, others: list[Column] = ()) -> Column:
    """Whether a title can be used. `others`: fields whose text a title must not repeat."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^[\s\[({<\"'„“]+|[\s\])}>\"'“”]+$", ""), r"(?U)\s+", " "))
    ok = c.isNotNull() & ~bare.isin(STAND_INS) & c.rlike(r"\p{L}|\p{N}") & ~c.rlike(OTHER_FIELD) & ~c.rlike(BROKEN) & ~c.rlike(CUT_OFF)
    for o in others:
        ok = ok & F.coalesce(F.trim(c) != F.trim(o), F.lit(True))
    return F.coalesce(ok, F.lit(False))


def usable_poster(c: Column) -> Column:
    return F.coalesce(c.rlike(POSTER) & ~c.rlike(NO_POSTER), F.lit(False))


def usable_runtime(c: Column, minutes: tuple[int, int] = FEATURE_MINUTES) -> Column:
    return F.coalesce(c.between(*minutes), F.lit(False))


def usable(field: str) -> Column:
    c = F.col(field)
    if field == "runtime_minutes":
        return usable_runtime(c)
    if field == "poster_url":
        return usable_poster(c)
    return usable_text(c, [F.col("synopsis"), F.col("distributor_code"), F.col("cinema_id")])


def representatives(listing: DataFrame, venue: DataFrame, group: str = "distributor_code", fields=FIELDS) -> DataFrame:
    """(group, field, listing_id, value) of the best usable value of every field in every group of two rows or more."""
    rows = listing.where(F.col(group).isNotNull()).drop("trust_rank", "_all")
    trust = venue.select("cinema_id", "trust_rank").groupBy("cinema_id").agg(F.min("trust_rank").alias("trust_rank"))
    rows = join_small(rows, trust, ["cinema_id"])
    # field `_all` counts the rows of the group; it has the lowest and highest id of the group's listings
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), usable(f).alias("ok")) for f in fields]
    long = rows.select(F.col(group).alias("grp"), "listing_id", "trust_rank", "fetched_at", F.explode(F.filter(F.array(*parts), lambda x: x["ok"])).alias("x"))
    order = W.partitionBy("grp", "field").orderBy(F.col("trust_rank").asc_nulls_last(), F.col("fetched_at").desc_nulls_last(), F.col("listing_id").asc())
    best = long.select("grp", "x.field", "x.value", "listing_id", "trust_rank", "fetched_at").withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    several = rows.groupBy(F.col(group).alias("grp")).agg(F.min("listing_id").alias("lo"), F.max("listing_id").alias("hi")).where("lo < hi").select("grp")
    return best.join(several, "grp", "left_semi").select(F.col("grp").alias(group), "field", "listing_id", "value")


def surviving_records(listing: DataFrame, venue: DataFrame, group: str = "distributor_code", fields=FIELDS) -> DataFrame:
    """One record per group: the surviving value of each field and the listing it came from, null where none is usable."""
    best = representatives(listing, venue, group, fields)
    cols = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields] + [F.max(F.when(F.col("field") == f, F.col("listing_id"))).alias(f"{f}_from") for f in fields]
    return best.groupBy(group).agg(*cols)
