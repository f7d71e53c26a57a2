"""Queries over the programme: counts, facets, picks, text, dates, links, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.functions import classify, links, temporal, text
from marquee.operators import merge, shred, similarity
from marquee.plans import sql as S
from marquee.session import spread, table, utc_wall

QUERIES: dict = {}
SQL: dict[str, str] = {}

PLAIN_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
PLAIN_TIME = r"^[0-9]{2}:[0-9]{2}$"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def day_of(c: str) -> F.Column:
    """The date of a plain day text, null otherwise."""
    return F.when(F.col(c).rlike(PLAIN_DAY), F.try_to_date(F.col(c), "yyyy-MM-dd"))


def shown(spark: SparkSession, d: str) -> DataFrame:
    """Screenings on a plain day, with their venue's city."""
    s = table(spark, d, "showtime").withColumn("day", day_of("date")).where("day is not null")
    v = table(spark, d, "dim_venue").select("cinema_id", "city_id", "venue_ord")
    return s.join(F.broadcast(v), "cinema_id")  # the venues are a fixed dimension


SHOWN = f"SELECT s.*, TRY_CAST(s.date AS DATE) AS day, v.city_id, v.venue_ord FROM showtime s JOIN dim_venue v USING (cinema_id) WHERE regexp_matches(s.date, '{PLAIN_DAY}') AND TRY_CAST(s.date AS DATE) IS NOT NULL"


@query(f"SELECT CAST(day AS VARCHAR) AS day, city_id, count(DISTINCT listing_id) AS movies, count(*) AS showtimes FROM ({SHOWN}) GROUP BY 1, 2")
def q_day_city_counts(spark, d):
    """Films and screenings per day and city."""
    return shown(spark, d).groupBy(F.col("day").cast("string").alias("day"), "city_id").agg(F.countDistinct("listing_id").alias("movies"), F.count("*").alias("showtimes"))


@query(f"WITH s AS ({SHOWN}), w AS (SELECT min(day) AS lo FROM s) SELECT CAST(day AS VARCHAR) AS day, cinema_id, count(*) AS showtimes FROM s, w WHERE day BETWEEN lo AND lo + 7 GROUP BY 1, 2")
def q_window_filter(spark, d):
    """Screenings within eight days of the first."""
    s = shown(spark, d)
    days = s.agg(F.min("day").alias("lo")).select(F.explode(F.sequence("lo", F.date_add("lo", 7))).alias("day"))
    return s.join(F.broadcast(days.limit(8)), "day", "left_semi").groupBy(F.col("day").cast("string").alias("day"), "cinema_id").agg(F.count("*").alias("showtimes"))


AUDIO_SQL = "CASE WHEN audio IN ('dubbed', 'subtitled', 'original') THEN audio ELSE 'unknown' END"
KID_SQL = "coalesce(len(list_filter(genres, lambda g: g IS NOT NULL AND (" + " OR ".join(f"contains(lower(g), {S.lit(w)})" for w in classify.KID_GENRES) + "))) > 0, false)"
GROWN_SQL = KID_SQL.replace(" OR ".join(f"contains(lower(g), {S.lit(w)})" for w in classify.KID_GENRES), " OR ".join(f"contains(lower(g), {S.lit(w)})" for w in classify.ADULT_GENRES))


def facets(spark, d, dubbed: bool, kids: bool, today: str, cutoff: int) -> DataFrame:
    """Visible films and screenings, unknown audio, and whether any is past, per day and city, in one pass."""
    listing = table(spark, d, "listing")
    kid = listing.select("listing_id", (classify.has_genre(F.col("genres"), classify.KID_GENRES) & ~classify.has_genre(F.col("genres"), classify.ADULT_GENRES)).alias("kid"))
    audio = F.when(F.col("audio").isin("dubbed", "subtitled", "original"), F.col("audio")).otherwise("unknown")
    start = temporal.minutes_of(F.coalesce("time", F.lit("")))
    base = shown(spark, d).select("listing_id", "day", "city_id", audio.alias("audio"), start.alias("start")).join(kid, "listing_id", "left")
    if kids:
        base = base.where("kid")
    past = (F.col("day").cast("string") == today) & (F.col("start") >= 0) & (F.col("start") < cutoff)
    seen = ~past & ((F.col("audio") == "dubbed") if dubbed else F.lit(True))
    return base.groupBy(F.col("day").cast("string").alias("day"), "city_id").agg(
        F.countDistinct(F.when(seen, F.col("listing_id"))).alias("visible_movies"), F.count_if(seen).alias("visible_showtimes"),
        F.count_if(~past & (F.col("audio") == "unknown")).alias("unknown_audio"), F.bool_or(past).alias("hid_past"),
    ).withColumn("message", F.when(F.col("visible_showtimes") > 0, "").when(F.col("hid_past") & F.lit(not (dubbed or kids)), "over").otherwise("none"))


def facets_sql(dubbed: bool, kids: bool, today: str, cutoff: int) -> str:
    seen = "NOT past" + (" AND audio = 'dubbed'" if dubbed else "")
    return f"""
    WITH base AS (SELECT s.listing_id, day, city_id, {AUDIO_SQL.replace('audio', 's.audio', 1).replace('THEN audio', 'THEN s.audio')} AS audio,
      coalesce(CASE WHEN regexp_matches(s.time, '{PLAIN_TIME}') THEN TRY_CAST(substring(s.time, 1, 2) AS INT) * 60 + TRY_CAST(substring(s.time, 4, 2) AS INT) END, -1) AS start,
      l.kid FROM ({SHOWN}) s LEFT JOIN (SELECT listing_id, {KID_SQL} AND NOT {GROWN_SQL} AS kid FROM listing) l USING (listing_id)),
    x AS (SELECT *, CAST(day AS VARCHAR) = '{today}' AND start >= 0 AND start < {cutoff} AS past FROM base {'WHERE kid' if kids else ''})
    SELECT CAST(day AS VARCHAR) AS day, city_id, count(DISTINCT CASE WHEN {seen} THEN listing_id END) AS visible_movies,
      count(*) FILTER (WHERE {seen}) AS visible_showtimes, count(*) FILTER (WHERE NOT past AND audio = 'unknown') AS unknown_audio, bool_or(past) AS hid_past,
      CASE WHEN count(*) FILTER (WHERE {seen}) > 0 THEN '' WHEN bool_or(past) AND {'false' if dubbed or kids else 'true'} THEN 'over' ELSE 'none' END AS message
    FROM x GROUP BY 1, 2"""


@query(facets_sql(False, False, "2026-06-01", 18 * 60))
def q_facets_all(spark, d):
    return facets(spark, d, False, False, "2026-06-01", 18 * 60)


@query(facets_sql(True, True, "2026-06-01", 18 * 60))
def q_facets_kids_dubbed(spark, d):
    return facets(spark, d, True, True, "2026-06-01", 18 * 60)


@query(f"SELECT DISTINCT listing_id, CAST(day AS VARCHAR) AS day, coalesce(format, '2D') AS format, {AUDIO_SQL} AS audio FROM ({SHOWN}) WHERE listing_id IS NOT NULL")
def q_variants(spark, d):
    """Distinct format and audio of a film on a day."""
    audio = F.when(F.col("audio").isin("dubbed", "subtitled", "original"), F.col("audio")).otherwise("unknown")
    return shown(spark, d).where("listing_id is not null").select("listing_id", F.col("day").cast("string").alias("day"), F.coalesce("format", F.lit("2D")).alias("format"), audio.alias("audio")).distinct()


@query("""SELECT distributor_code, count(DISTINCT cinema_id) AS cinemas, string_agg(DISTINCT cinema_id, ',' ORDER BY cinema_id) AS venues, count(*) AS listings
FROM listing WHERE distributor_code IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cinema_id) > 1""")
def q_cross_source_entities(spark, d):
    """Films at more than one venue."""
    c = table(spark, d, "listing").where("distributor_code is not null").groupBy("distributor_code", "cinema_id").agg(F.count("*").alias("n"))
    out = c.groupBy("distributor_code").agg(F.count("*").alias("cinemas"), F.array_join(F.sort_array(F.collect_list("cinema_id")), ",").alias("venues"), F.sum("n").alias("listings"))
    return out.where("cinemas > 1")


@query(f"""SELECT a.audio, coalesce(n, 0) AS showtimes FROM (VALUES ('dubbed'), ('subtitled'), ('original'), ('unknown')) a(audio)
LEFT JOIN (SELECT {S.detect_audio('audio', 'language_tag')} AS audio, count(*) AS n FROM showtime GROUP BY 1) s USING (audio)""")
def q_audio_distribution(spark, d):
    """Screenings by detected audio; classes without any are kept with 0."""
    # few distinct labels: counted first, told apart once each
    labels = table(spark, d, "showtime").groupBy("audio", "language_tag").agg(F.count("*").alias("k"))
    h = labels.select(classify.haystack(F.col("audio"), F.col("language_tag")).alias("h"), "k")
    n = h.groupBy(classify.audio_in(F.col("h")).alias("audio")).agg(F.sum("k").alias("n"))
    dim = spark.createDataFrame([("dubbed",), ("subtitled",), ("original",), ("unknown",)], "audio string")
    return dim.join(n, "audio", "left").select("audio", F.coalesce("n", F.lit(0)).alias("showtimes"))


@query("""SELECT v.cinema_id, v.venue_ord, coalesce(l.n, 0) AS listings, coalesce(s.n, 0) AS showtimes, coalesce(l.n, 0) > 0 AS ok,
  v.name || ': ' || CASE WHEN coalesce(l.n, 0) > 0 THEN coalesce(l.n, 0) || ' / ' || coalesce(s.n, 0) ELSE 'nema podataka' END AS line
FROM dim_venue v LEFT JOIN (SELECT cinema_id, count(*) AS n FROM listing GROUP BY 1) l USING (cinema_id) LEFT JOIN (SELECT cinema_id, count(*) AS n FROM showtime GROUP BY 1) s USING (cinema_id)""")
def q_source_status(spark, d):
    """Listings and screenings of every source; one without listings is not ok."""
    count = lambda t: table(spark, d, t).groupBy("cinema_id").agg(F.count("*").alias(f"n_{t}"))
    x = table(spark, d, "dim_venue").join(count("listing"), "cinema_id", "left").join(count("showtime"), "cinema_id", "left")
    n, s = F.coalesce("n_listing", F.lit(0)), F.coalesce("n_showtime", F.lit(0))
    line = F.concat(F.col("name"), F.lit(": "), F.when(n > 0, F.concat(n.cast("string"), F.lit(" / "), s.cast("string"))).otherwise("nema podataka"))
    return x.select("cinema_id", "venue_ord", n.alias("listings"), s.alias("showtimes"), (n > 0).alias("ok"), line.alias("line"))


RUN_SQL = "CAST(CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) AS VARCHAR)"


@query(f"""WITH r AS (SELECT *, substring({RUN_SQL}, 1, 7) AS run FROM listing), now AS (SELECT max(run) AS run FROM r),
live AS (SELECT cinema_id, count(*) AS listings FROM r WHERE run = (SELECT run FROM now) GROUP BY 1),
prev AS (SELECT cinema_id, run, count(*) AS listings FROM r WHERE run < (SELECT run FROM now) GROUP BY 1, 2),
last AS (SELECT cinema_id, arg_max(listings, run) AS listings, max(run) AS run FROM prev GROUP BY 1)
SELECT cinema_id, listings, false AS stale FROM live UNION ALL SELECT cinema_id, listings, true FROM last WHERE cinema_id NOT IN (SELECT cinema_id FROM live)""")
def q_union_fallback(spark, d):
    """Listings of the newest run, for sources without any their last good run, marked stale."""
    l = table(spark, d, "listing")
    r = l.select("cinema_id", F.date_format(utc_wall(l, "fetched_at"), "yyyy-MM").alias("run")).groupBy("cinema_id", "run").agg(F.count("*").alias("listings"))
    newest = r.agg(F.max("run").alias("newest"))
    r = r.join(F.broadcast(newest.limit(1)))
    live = r.where("run = newest").select("cinema_id", "listings", F.lit(False).alias("stale"))
    prev = r.where("run < newest").groupBy("cinema_id").agg(F.max_by("listings", "run").alias("listings")).select("cinema_id", "listings", F.lit(True).alias("stale"))
    return live.unionByName(prev.join(live, "cinema_id", "left_anti"))


HEALTH_SQL = f"""WITH runs AS (SELECT cinema_id, substring({RUN_SQL}, 1, 7) AS run, count(*) FILTER (WHERE poster_url IS NULL OR trim(poster_url) = '') * 2 > count(*) AS failed FROM listing GROUP BY 1, 2),
grp AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY cinema_id ORDER BY run) AS island FROM runs),
streak AS (SELECT cinema_id, run, failed, CASE WHEN failed THEN row_number() OVER (PARTITION BY cinema_id, island ORDER BY run) - CASE WHEN island > 0 THEN 1 ELSE 0 END ELSE 0 END AS failures FROM grp)"""


def streaks(spark, d):
    """Consecutive failures of every source and run: gaps and islands over the runs; a run fails if most posters are missing."""
    l = table(spark, d, "listing")
    empty = F.col("poster_url").isNull() | (F.trim("poster_url") == "")
    runs = l.groupBy("cinema_id", F.date_format(utc_wall(l, "fetched_at"), "yyyy-MM").alias("run")).agg((F.count_if(empty) * 2 > F.count("*")).alias("failed"))
    order = W.partitionBy("cinema_id").orderBy("run")
    grp = runs.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order))
    n = F.row_number().over(W.partitionBy("cinema_id", "island").orderBy("run"))
    return grp.select("cinema_id", "run", "failed", F.when(F.col("failed"), n - F.when(F.col("island") > 0, 1).otherwise(0)).otherwise(0).cast("bigint").alias("failures"))


@query(HEALTH_SQL + " SELECT * FROM streak")
def q_streak(spark, d):
    return streaks(spark, d)


# The words of the alert in q_alert_body and its SQL are fixed values.
NOW_SQL = HEALTH_SQL + ", cur AS (SELECT cinema_id, arg_max(failures, run) AS failures, max(run) AS run FROM streak GROUP BY 1)"


def current_streaks(spark, d):
    """(cinema_id, failures, run) of every source's newest run."""
    return streaks(spark, d).groupBy("cinema_id").agg(F.max_by("failures", "run").alias("failures"), F.max("run").alias("run"))


@query(NOW_SQL + " SELECT cinema_id, failures, run FROM cur WHERE failures >= 2")
def q_degraded(spark, d):
    """Sources whose newest runs failed at least twice in a row."""
    return current_streaks(spark, d).where("failures >= 2")


@query(NOW_SQL + """, bad AS (SELECT v.venue_ord, v.name || ': ' || failures || '. uzastopni neuspeh' AS line FROM cur JOIN dim_venue v USING (cinema_id) WHERE failures >= 2)
SELECT count(*) AS degraded, CASE WHEN count(*) = 0 THEN 'Svi izvori su uspešno osveženi.' ELSE count(*) || ' od ' || (SELECT count(*) FROM cur) || ' izvora nije uspelo da osveži podatke:' || chr(10) || chr(10) || string_agg('- ' || line, chr(10) ORDER BY venue_ord) END AS body FROM bad""")
def q_alert_body(spark, d):
    """The text of an alert: how many of all sources keep failing, and a line for each in the order of the venues."""
    v = table(spark, d, "dim_venue").select("cinema_id", "venue_ord", "name")
    cur = current_streaks(spark, d)
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("failures").cast("string"), F.lit(". uzastopni neuspeh"))
    bad = F.when(F.col("failures") >= 2, F.struct("venue_ord", line.alias("line")))
    # a row per venue, a fixed dimension
    x = cur.join(F.broadcast(v), "cinema_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(bad)).alias("x"))
    text_ = F.concat(F.size("x").cast("string"), F.lit(" od "), F.col("total").cast("string"), F.lit(" izvora nije uspelo da osveži podatke:\n\n"), F.array_join(F.transform("x", lambda e: e["line"]), "\n"))
    return x.select(F.size("x").cast("bigint").alias("degraded"), F.when(F.size("x") == 0, "Svi izvori su uspešno osveženi.").otherwise(text_).alias("body"))


# ---- text ---------------------------------------------------------------------------------------------------------------


def _titles(name: str, doc: str, f, g) -> None:
    def run(spark, d):
        return table(spark, d, "listing").select("listing_id", f(F.col("raw_title")).alias("value"))

    run.__doc__, run.__name__ = doc, name
    query(f"SELECT listing_id, {g('raw_title')} AS value FROM listing")(run)


_titles("q_clean_title", "Titles without marks of format and version.", text.clean_title, S.clean_title)
_titles("q_tidy_title", "Titles without marks, punctuation kept.", text.tidy_title, S.tidy_title)
_titles("q_normalize_title", "Keys for fuzzy comparison.", text.normalize_title, S.normalize_title)
_titles("q_transliterate", "ASCII-like Latin.", text.transliterate, S.transliterate)
_titles("q_serbian_latin", "Serbian Latin with its marks.", text.serbian_latin, S.serbian_latin)
_titles("q_extract_year", "Years in titles.", lambda c: text.extract_year(c, 2029), lambda x: f"(SELECT CASE WHEN y <= 2029 THEN y END FROM (SELECT TRY_CAST(nullif(regexp_extract({x}, '\\b(19[0-9]{{2}}|20[0-9]{{2}})\\b', 1), '') AS INT) AS y))")


@query(f"SELECT showtime_id, {S.detect_audio('audio', 'language_tag')} AS audio, {S.detect_format('format', 'language_tag')} AS format FROM showtime")
def q_detect_audio_format(spark, d):
    h = table(spark, d, "showtime").select("showtime_id", classify.haystack(F.col("audio"), F.col("language_tag")).alias("a"), classify.haystack(F.col("format"), F.col("language_tag")).alias("f"))
    return h.select("showtime_id", classify.audio_in(F.col("a")).alias("audio"), classify.format_in(F.col("f")).alias("format"))


PARTS_SQL = "list_filter(string_split_regex(upper(c), '[^A-Z0-9]+'), lambda x: x <> '')"


@query(f"""WITH p AS (SELECT showtime_id, {PARTS_SQL} AS p FROM (SELECT showtime_id, coalesce(format, '') || '/' || coalesce(language_tag, '') AS c FROM showtime)),
f AS (SELECT showtime_id, p, CASE WHEN list_contains(p, '4DX') THEN '4DX' WHEN list_contains(p, 'SCREENX') THEN 'ScreenX' WHEN list_contains(p, 'IMAX') THEN 'IMAX' WHEN list_contains(p, 'GOLD') THEN 'Gold' END AS a, CASE WHEN list_contains(p, '3D') THEN '3D' END AS b FROM p)
SELECT showtime_id, CASE WHEN list_contains(p, 'SINH') OR list_contains(p, 'SINK') THEN 'dubbed' WHEN list_contains(p, 'TITL') OR list_contains(p, 'OV') OR list_contains(p, 'OMU') THEN 'subtitled' ELSE 'unknown' END AS audio,
coalesce(nullif(concat_ws(' ', a, b), ''), '2D') AS format FROM f""")
def q_format_code(spark, d):
    """Audio and format from codes such as `4DX/3D/TITL`."""
    code = F.concat(F.coalesce("format", F.lit("")), F.lit("/"), F.coalesce("language_tag", F.lit("")))
    return table(spark, d, "showtime").select("showtime_id", classify.audio_of_code(code).alias("audio"), classify.format_of_code(code).alias("format"))


@query("""WITH f AS (SELECT landing_id, list_filter(flatten(list_filter(technologies, lambda g: g IS NOT NULL)), lambda x: x IS NOT NULL) AS f FROM api_session)
SELECT landing_id, coalesce(array_to_string(list_filter(f, lambda x: upper(x) <> 'SINH'), '/'), '') AS formats, CASE WHEN len(list_filter(f, lambda x: upper(x) = 'SINH')) > 0 THEN 'dubbed' ELSE 'subtitled' END AS audio FROM f""")
def q_technologies(spark, d):
    """Nested technology lists flattened; dubbed only if the flag is among them."""
    flat = F.filter(F.flatten(F.filter("technologies", lambda g: g.isNotNull())), lambda x: x.isNotNull())
    dubbed = F.coalesce(F.exists(flat, lambda x: F.upper(x) == "SINH"), F.lit(False))
    return table(spark, d, "api_session").select("landing_id", F.coalesce(F.array_join(F.filter(flat, lambda x: F.upper(x) != "SINH"), "/"), F.lit("")).alias("formats"), F.when(dubbed, "dubbed").otherwise("subtitled").alias("audio"))


KEYS_SQL = f"SELECT DISTINCT {S.normalize_title('title')} AS key FROM title_dim WHERE {S.normalize_title('title')} <> ''"


@query(f"SELECT a, b, round(score, 9) AS score FROM ({S.dice_pairs(KEYS_SQL, None, 0.82)})")
def q_dice_pairs(spark, d):
    """Pairs of similar title keys."""
    keys = table(spark, d, "title_dim").select(text.normalize_title(F.col("title")).alias("key"))
    return similarity.similar_pairs(keys).select("a", "b", F.round("score", 9).alias("score"))


CAND_SQL = f"""WITH q AS (SELECT DISTINCT {S.normalize_title('clean_title')} AS key, year FROM listing WHERE {S.normalize_title('clean_title')} <> ''),
c AS (SELECT id, release_year, unnest([{S.normalize_title('title')}, {S.normalize_title("coalesce(original_title, '')")}]) AS key FROM title_dim),
p AS ({S.dice_pairs('SELECT DISTINCT key FROM q', "SELECT DISTINCT key FROM c WHERE key <> ''", 0.62)}),
s AS (SELECT q.key, q.year, c.id, max(p.score - CASE WHEN abs(q.year - c.release_year) > 1 THEN 0.25 ELSE 0 END) AS score FROM q JOIN p ON p.a = q.key JOIN c ON c.key = p.b GROUP BY 1, 2, 3)
SELECT key, year, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY key, year ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score >= 0.62 - 1e-12) WHERE rank <= 3"""


@query(CAND_SQL)
def q_candidate_match(spark, d):
    """The three best films for each title and year: best Dice over both titles, less 0.25 if the years are apart."""
    q = table(spark, d, "listing").select(text.normalize_title(F.col("clean_title")).alias("key"), "year").where("key <> ''").distinct()
    both = F.array(text.normalize_title(F.col("title")), text.normalize_title(F.coalesce("original_title", F.lit(""))))
    c = table(spark, d, "title_dim").select("id", "release_year", F.explode(both).alias("c")).where("c <> ''")
    p = similarity.similar_pairs(q, c.select(F.col("c").alias("key")), 0.62)
    apart = F.coalesce(F.abs(F.col("year") - F.col("release_year")) > 1, F.lit(False))
    s = q.hint("merge").join(p, F.col("a") == F.col("key")).hint("merge").join(c, F.col("b") == F.col("c")).groupBy("key", "year", "id").agg(F.max(F.col("score") - F.when(apart, 0.25).otherwise(0.0)).alias("score"))
    rank = F.row_number().over(W.partitionBy("key", "year").orderBy(F.desc(F.round("score", 9)), "id"))
    return s.where(F.col("score") >= 0.62 - 1e-12).withColumn("rank", rank.cast("bigint")).where("rank <= 3").select("key", "year", "id", F.round("score", 9).alias("score"), "rank")


# ---- picks and unions ---------------------------------------------------------------------------------------------------

TRUST_SQL = """WITH r AS (SELECT l.*, coalesce(v.trust_rank, 1073741824) AS t FROM listing l LEFT JOIN dim_venue v USING (cinema_id) WHERE distributor_code IS NOT NULL)"""


@query(TRUST_SQL + """ SELECT distributor_code,
  arg_min(poster_url, (venue_ord, listing_ord, listing_id)) FILTER (WHERE poster_url <> '') AS poster_url,
  arg_min(runtime_minutes, (t, venue_ord, listing_ord, listing_id)) FILTER (WHERE runtime_minutes > 0) AS runtime_minutes,
  arg_min(synopsis, (venue_ord, listing_ord, listing_id)) FILTER (WHERE synopsis <> '') AS synopsis,
  coalesce(bool_or(origin_country IN ('RS', 'SRB', 'SR')), false) AS domestic, count(DISTINCT cinema_id) AS cinemas FROM r GROUP BY 1""")
def q_trust_coalesce(spark, d):
    """Poster, length and synopsis of each film by trust and order."""
    return merge.merge_records(table(spark, d, "listing"), "distributor_code", table(spark, d, "dim_venue")).select("distributor_code", "poster_url", "runtime_minutes", "synopsis", "domestic", "cinemas")


@query("""WITH g AS (SELECT distributor_code, venue_ord, listing_ord, listing_id, unnest(genres) AS g, generate_subscripts(genres, 1) AS i FROM listing WHERE distributor_code IS NOT NULL),
f AS (SELECT distributor_code, g, min((venue_ord, listing_ord, listing_id, i)) AS o FROM g WHERE g IS NOT NULL GROUP BY 1, 2)
SELECT distributor_code, string_agg(g, '|' ORDER BY o) AS genres FROM f GROUP BY 1""")
def q_genre_union(spark, d):
    """Genres of each film in the order in which they first appear."""
    rows = table(spark, d, "listing").where("distributor_code is not null")
    return merge.ordered_union(rows, "distributor_code", "genres", ["venue_ord", "listing_ord", "listing_id"]).select("distributor_code", F.array_join("genres", "|").alias("genres"))


@query("""WITH x AS (SELECT s.showtime_id, s.audio, l.origin_country, l.distributor_code FROM showtime s JOIN listing l USING (listing_id) WHERE l.distributor_code IS NOT NULL)
SELECT showtime_id, CASE WHEN audio = 'subtitled' AND coalesce(bool_or(origin_country IN ('RS', 'SRB', 'SR')) OVER (PARTITION BY distributor_code), false) THEN 'original' ELSE audio END AS audio FROM x""")
def q_domestic_remap(spark, d):
    """Subtitled screenings of domestic films are in the original language."""
    l = table(spark, d, "listing").select("listing_id", "distributor_code", F.col("origin_country").isin(merge.DOMESTIC).alias("home")).where("distributor_code is not null")
    flag = l.groupBy("distributor_code").agg(F.coalesce(F.bool_or("home"), F.lit(False)).alias("domestic"))
    x = table(spark, d, "showtime").select("showtime_id", "listing_id", "audio").join(l.join(flag, "distributor_code").select("listing_id", "domestic"), "listing_id")
    return x.select("showtime_id", F.when((F.col("audio") == "subtitled") & F.col("domestic"), "original").otherwise(F.col("audio")).alias("audio"))


DETAILS = {"release_dates": 1, "release_dates.release_dates": 1, "videos": 1}


def detail_rows(spark, d, wanted: str):
    """The children of the details, however their bodies or levels are wrapped or encoded, with the columns of what they stand in."""
    return shred.flatten(spread(table(spark, d, "details_response").select("landing_id", "body")), "landing_id", "body", [wanted], DETAILS, inherit=True)


def videos(spark, d):
    said = lambda c: F.try_element_at("columns", F.lit(c))
    rows = detail_rows(spark, d, "videos")
    return rows.select(F.col("record").alias("landing_id"), F.get("own", F.lit(0)).alias("ord"), *[said(c).alias(c) for c in ("key", "site", "type", "iso_639_1", "iso_3166_1")], (said("official") == "true").alias("official"))


def trailers(spark, d):
    """The trailer of each record: language first, then country, kind and whether it is official; the earlier on ties."""
    v = videos(spark, d).where("key is not null and key <> '' and coalesce(site, 'YouTube') = 'YouTube' and iso_639_1 in ('sr', 'en')")
    score = F.when(F.col("iso_639_1") == "sr", 400).otherwise(100) + F.when(F.col("iso_3166_1") == "RS", 10).otherwise(0) + F.when(F.col("type") == "Trailer", 4).when(F.col("type") == "Teaser", 2).otherwise(0) + F.when(F.col("official"), 1).otherwise(0)
    return v.withColumn("score", score).groupBy("landing_id").agg(F.min_by(F.struct("key", "iso_639_1"), F.struct(-F.col("score"), F.col("ord"))).alias("x")).select("landing_id", "x.key", F.col("x.iso_639_1").alias("language"))


def _open(x: str) -> str:
    """A JSON value without encoding as a string."""
    inner = f"TRY_CAST(({x}->>'$') AS JSON)"
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_type({inner}) IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN {inner} ELSE {x} END"


def _level(name: str, source: str, path: str, keep: str = "landing_id", to: str = "landing_id") -> str:
    """CTEs of the elements of a level (name: keep, ord, v) below the objects j of `source`: a list, a list in an object, or a lone object."""
    return f"""{name}0 AS (SELECT {keep}, {_open(f"json_extract(j, '$.{path}')")} AS v FROM {source}),
{name}1 AS (SELECT {to}, {_open("CASE WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.results') THEN json_extract(v, '$.results') ELSE v END")} AS v FROM {name}0),
{name} AS (SELECT {to}, ord, {_open("v")} AS v FROM (SELECT {to}, _n AS ord, json_extract(v, '$[' || _n || ']') AS v FROM (SELECT *, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS _n FROM {name}1 WHERE json_type(v) = 'ARRAY')) UNION ALL SELECT {to}, 0, v FROM {name}1 WHERE json_type(v) = 'OBJECT')"""


BODY_SQL = f"""b AS (SELECT landing_id, TRY_CAST(body AS JSON) AS j FROM details_response WHERE json_valid(body)), b1 AS (SELECT landing_id, {_open('j')} AS j FROM b), b2 AS (SELECT landing_id, {_open('j')} AS j FROM b1),
r AS (SELECT landing_id, j FROM b2 WHERE json_type(j) = 'OBJECT' UNION ALL SELECT landing_id, {_open('x')} FROM (SELECT landing_id, json_extract(j, '$[' || i || ']') AS x FROM (SELECT *, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS i FROM b2 WHERE json_type(j) = 'ARRAY')))"""
TRAILER_SQL = f"""WITH {BODY_SQL}, {_level('v', 'r', 'videos')},
f AS (SELECT landing_id, ord, v->>'$.key' AS key, v->>'$.site' AS site, v->>'$.type' AS type, v->>'$.official' AS official, v->>'$.iso_639_1' AS lang, v->>'$.iso_3166_1' AS country FROM v WHERE json_type(v) = 'OBJECT'),
s AS (SELECT *, CASE WHEN lang = 'sr' THEN 400 ELSE 100 END + CASE WHEN country = 'RS' THEN 10 ELSE 0 END + CASE type WHEN 'Trailer' THEN 4 WHEN 'Teaser' THEN 2 ELSE 0 END + CASE WHEN official = 'true' THEN 1 ELSE 0 END AS score FROM f WHERE key <> '' AND coalesce(site, 'YouTube') = 'YouTube' AND lang IN ('sr', 'en')),
t AS (SELECT landing_id, key, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY landing_id ORDER BY score DESC, ord) AS n FROM s) WHERE n = 1)"""


@query(TRAILER_SQL + " SELECT * FROM t")
def q_pick_trailer(spark, d):
    return trailers(spark, d)


@query(TRAILER_SQL + """, h AS (SELECT CASE WHEN t.key IS NULL THEN 'pretraga' ELSE coalesce(language, 'nepoznat') END AS bucket, count(*) AS n FROM details_response r LEFT JOIN t USING (landing_id) GROUP BY 1)
SELECT coalesce(string_agg(bucket || ' ' || n, ' · ' ORDER BY coalesce(list_position(['sr', 'sh', 'hr', 'bs', 'en'], bucket), 99), bucket), 'nema') AS summary FROM h""")
def q_trailer_summary(spark, d):
    """How many records have a trailer in which language, in the order of preference."""
    x = table(spark, d, "details_response").select("landing_id").join(trailers(spark, d), "landing_id", "left")
    h = x.groupBy(F.when(F.col("key").isNull(), "pretraga").otherwise(F.coalesce("language", F.lit("nepoznat"))).alias("bucket")).agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, ["sr", "sh", "hr", "bs", "en"])), F.col("bucket"))
    s = F.struct(F.when(at == 0, 99).otherwise(at).alias("o"), "bucket", F.concat_ws(" ", "bucket", F.col("n").cast("string")).alias("t"))
    return h.agg(F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda e: e["t"]), " · ").alias("t")).select(F.when(F.col("t") == "", "nema").otherwise(F.col("t")).alias("summary"))


@query(f"""WITH {BODY_SQL}, {_level('c', 'r', 'release_dates')}, n AS (SELECT landing_id, ord AS i, v->>'$.iso_3166_1' AS country, v AS j FROM c WHERE json_type(v) = 'OBJECT'), {_level('e', 'n', 'release_dates', 'landing_id, i, country', 'landing_id, i, country')}
SELECT landing_id, country, arg_min(x, (i, ord)) AS certification FROM (SELECT landing_id, country, i, ord, v->>'$.certification' AS x FROM e WHERE json_type(v) = 'OBJECT') WHERE country IS NOT NULL AND trim(x) <> '' GROUP BY 1, 2""")
def q_certifications(spark, d):
    """The first label that is not blank of each country of each record."""
    rows = detail_rows(spark, d, "release_dates.release_dates")
    e = rows.select(F.col("record").alias("landing_id"), "own", F.try_element_at("columns", F.lit("release_dates/iso_3166_1")).alias("country"), F.try_element_at("columns", F.lit("certification")).alias("x"))
    return e.where("country is not null and trim(x) <> ''").groupBy("landing_id", "country").agg(F.min_by("x", "own").alias("certification"))


def _age_sql(country: str) -> str:
    c = f"upper(trim(certifications['{country}']))"
    listed = " ".join(f"WHEN {c} = '{k}' THEN {'NULL' if v < 0 else v}" for k, v in classify.LABELS.get(country, {}).items())
    return f"CASE {listed} WHEN {c} IN ('AL', 'A', 'T', 'U', 'VS', 'BEZ') THEN 0 WHEN regexp_matches({c}, '^[0-9]{{1,2}}\\s*\\+?$') THEN CAST(regexp_extract({c}, '^([0-9]{{1,2}})', 1) AS INT) END"


@query("WITH a AS (SELECT id, coalesce(adult, false) AS adult, " + ", ".join(f"{_age_sql(c)} AS a_{c}" for c in classify.COUNTRIES) + f", {KID_SQL} AS kid, {GROWN_SQL} AS grown FROM title_dim), b AS (SELECT *, coalesce(" + ", ".join(f"a_{c}" for c in classify.COUNTRIES) + ") AS sure, CASE " + " ".join(f"WHEN a_{c} IS NOT NULL THEN '{c}'" for c in classify.COUNTRIES) + """ END AS src, CASE WHEN kid AND NOT grown THEN 6 WHEN grown THEN 16 END AS guess FROM a)
SELECT id, age, source, confident, coalesce(age <= 12, false) AS kid_friendly, CASE WHEN age IS NULL THEN 'unknown' WHEN age <= 12 THEN 'kid' WHEN age >= 16 THEN 'adult' ELSE 'teen' END AS badge, CASE WHEN age <= 0 THEN 'Bez ograničenja' ELSE age || '+' END AS label
FROM (SELECT id, CASE WHEN adult THEN 18 ELSE coalesce(sure, guess) END AS age, CASE WHEN adult THEN 'US' ELSE coalesce(src, CASE WHEN guess IS NOT NULL THEN 'heuristic' END) END AS source, CASE WHEN adult OR sure IS NOT NULL THEN true WHEN guess IS NOT NULL THEN false END AS confident FROM b)""")
def q_age_rating(spark, d):
    """Suitability of every film: by the nearest country's label, else guessed by genre."""
    age, source, confident = classify.age_rating(F.col("adult"), F.col("certifications"), F.col("genres"), F.lit(False))
    x = table(spark, d, "title_dim").select("id", age.cast("int").alias("age"), source.alias("source"), confident.alias("confident"))
    return x.select("id", "age", "source", "confident", classify.kid_friendly(F.col("age")).alias("kid_friendly"), classify.age_badge(F.col("age")).alias("badge"), classify.age_label(F.col("age")).alias("label"))


@query("SELECT count(*) AS films, count(*) FILTER (WHERE age IS NULL) AS unrated, count(*) FILTER (WHERE confident = false) AS estimated, count(*) FILTER (WHERE kid_friendly) AS kid_friendly FROM (" + SQL["q_age_rating"] + ")")
def q_rating_coverage(spark, d):
    """How many films have no suitability, a guessed one, or are fit for children."""
    return q_age_rating(spark, d).agg(F.count("*").alias("films"), F.count_if(F.col("age").isNull()).alias("unrated"), F.count_if(~F.col("confident")).alias("estimated"), F.count_if("kid_friendly").alias("kid_friendly"))


@query("SELECT id, CASE WHEN runtime_minutes < 90 THEN 'short' WHEN runtime_minutes < 120 THEN 'medium' WHEN runtime_minutes IS NOT NULL THEN 'long' END AS bucket, CASE WHEN runtime_minutes >= 60 THEN (runtime_minutes // 60) || ' h ' || (runtime_minutes % 60) || ' min' ELSE runtime_minutes || ' min' END AS label, CASE WHEN vote_count >= 20 THEN vote_average END AS score FROM title_dim")
def q_runtime_score(spark, d):
    r = F.col("runtime_minutes")
    return table(spark, d, "title_dim").select("id", classify.runtime_bucket(r).alias("bucket"), classify.format_runtime(r).alias("label"), F.when(F.col("vote_count") >= 20, F.col("vote_average")).alias("score"))
