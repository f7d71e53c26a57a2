"""The programme as a whole: films of the catalogue for listings, groups, merged records, cards, events, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import classify, links, text
from marquee.operators import enrich, merge, publish, resolve
from marquee.plans import sql as S
from marquee.plans.programme import AUDIO_SQL, CAND_SQL, KID_SQL, GROWN_SQL, PLAIN_TIME, QUERIES, SHOWN, SQL, TRAILER_SQL, _age_sql, q_candidate_match, query, shown, trailers
from marquee.plans.publication import component_sql
from marquee.session import checkpointed, join_small, table

__all__ = ["QUERIES", "SQL"]
#: The city whose films are shown first.
HOME_CITY = "numutuda"
FILM_URL = "https://catalogue.example/movie/"


def external_ids(spark: SparkSession, d: str) -> DataFrame:
    """(listing_id, external_id): the film that every listing resolves to, the best of its candidates by title and year."""
    c = q_candidate_match(spark, d).withColumns({"query_ord": F.lit(0), "cand_ord": F.col("rank"), "lookup": F.to_json(F.struct("key", "year"))})
    l = table(spark, d, "listing").select("listing_id", F.to_json(F.struct(text.normalize_title(F.col("clean_title")).alias("key"), "year")).alias("key"))
    found = enrich.resolve(l, c.select(F.col("lookup").alias("key"), "query_ord", "cand_ord", "id", "score"))
    return l.hint("merge").join(found, "key").select("listing_id", F.col("id").alias("external_id"))


EXT_SQL = f"SELECT l.listing_id, c.id AS external_id FROM listing l JOIN ({CAND_SQL}) c ON c.rank = 1 AND c.key = {S.normalize_title('l.clean_title')} AND c.year IS NOT DISTINCT FROM l.year"
#: The greedy grouping listing by listing: gk has the keys of the groups so far, ge the films of those that have one.
GROUP_SQL = f"""ids AS MATERIALIZED ({EXT_SQL}),
o AS (SELECT row_number() OVER (ORDER BY venue_ord, listing_ord, l.listing_id) AS i, l.listing_id, external_id AS ext, list_distinct(list_filter([{S.normalize_title('raw_title')}, {S.normalize_title('clean_title')}], lambda k: k <> '')) AS keys FROM listing l LEFT JOIN ids USING (listing_id)),
k AS MATERIALIZED (SELECT DISTINCT unnest(keys) AS key FROM o), p AS MATERIALIZED ({S.dice_pairs('SELECT key FROM k', None, resolve.THRESHOLD)}),
adj AS (SELECT key, list(other) AS near FROM (SELECT key, key AS other FROM k UNION ALL SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1),
n AS MATERIALIZED (SELECT o.i, o.listing_id, o.ext, o.keys, coalesce(a.adj, []) AS adj FROM o LEFT JOIN (SELECT i, list_distinct(flatten(list(near))) AS adj FROM (SELECT i, unnest(keys) AS key FROM o) JOIN adj USING (key) GROUP BY 1) a USING (i)),
g(i, gk, ge, f) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(g BIGINT, k VARCHAR)[]), CAST([] AS STRUCT(g BIGINT, e BIGINT)[]), CAST(0 AS BIGINT) UNION ALL
  SELECT i, list_distinct(list_concat(gk, list_transform(keys, lambda k: {{'g': f, 'k': k}}))), CASE WHEN ext IS NULL OR known THEN ge ELSE list_append(ge, {{'g': f, 'e': ext}}) END, f FROM (
    SELECT n.i, n.keys, n.ext, gk, ge, coalesce(list_contains(list_transform(ge, lambda x: x.e), n.ext), false) AS known,
      coalesce(CASE WHEN n.ext IS NULL THEN list_min(list_transform(list_filter(gk, lambda x: list_contains(n.adj, x.k)), lambda x: x.g))
        ELSE coalesce(list_min(list_transform(list_filter(ge, lambda x: x.e = n.ext), lambda x: x.g)), list_min(list_transform(list_filter(gk, lambda x: list_contains(n.adj, x.k) AND NOT list_contains(list_transform(ge, lambda y: y.g), x.g)), lambda x: x.g))) END, n.i) AS f
    FROM g JOIN n ON n.i = g.i + 1)),
grouped AS (SELECT n.listing_id, e.listing_id AS entity, n.ext AS external_id FROM g JOIN n USING (i) JOIN n e ON e.i = g.f)"""


@query(f"WITH RECURSIVE {GROUP_SQL} SELECT listing_id, entity FROM grouped")
def q_entity_groups(spark, d):
    """The group of every listing by the order-exact greedy clustering, with the films that listings resolve to."""
    return resolve.group_listings(table(spark, d, "listing"), external_ids(spark, d))


def films_of(title_dim: DataFrame) -> DataFrame:
    """The catalogue's films as they enrich a record: titles in Latin, a score only with enough votes."""
    return title_dim.select(
        F.col("id").alias("external_id"), text.serbian_latin(F.col("title")).alias("film_title"), F.col("original_title").alias("film_original"), F.col("poster_url").alias("film_poster"), text.serbian_latin(F.col("overview")).alias("film_overview"),
        F.nullif(F.col("runtime_minutes"), F.lit(0)).alias("film_minutes"), F.transform(F.filter(F.coalesce("genres", F.array().cast("array<string>")), lambda g: g.isNotNull()), text.serbian_latin).alias("film_genres"),
        "adult", "certifications", F.col("original_language").alias("film_language"), F.when(F.col("vote_count") >= 20, F.col("vote_average")).alias("score"),
    )


def merged_programme(spark: SparkSession, d: str) -> DataFrame:
    """One row per film: resolved, grouped, merged with the catalogue's values first, audio of domestic films put right.

    Listings, groups, films and screenings all grow with the data and are merged; only venues are broadcast.
    """
    listing = table(spark, d, "listing")
    ids = checkpointed(external_ids(spark, d))
    groups = checkpointed(resolve.group_listings(listing, ids).hint("merge").join(ids, "listing_id", "left"))
    one = merge.merge_records(listing.hint("merge").join(groups.select("listing_id", "entity"), "listing_id"), "entity", table(spark, d, "dim_venue"))
    film = groups.groupBy("entity").agg(F.max("external_id").alias("external_id"))  # all resolved listings of a group have one film
    m = one.hint("merge").join(film, "entity").hint("merge").join(films_of(table(spark, d, "title_dim")), "external_id", "left")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    domestic = F.col("domestic") | F.coalesce(F.col("film_language") == "sr", F.lit(False))
    m = m.withColumns({"shown": F.coalesce(some("film_title"), "title"), "home": domestic})
    other = F.get(F.filter("originals", lambda v: text.normalize_title(v) != text.normalize_title(F.col("shown"))), F.lit(0))
    s = table(spark, d, "showtime").select("listing_id", F.when(F.col("audio").isin("dubbed", "subtitled", "original"), F.col("audio")).otherwise("unknown").alias("audio"))
    plays = s.hint("merge").join(groups.select("listing_id", "entity"), "listing_id").groupBy("entity").agg(F.count("*").alias("showtimes"), F.bool_or(F.col("audio") == "dubbed").alias("has_dubbed"), F.count_if(F.col("audio") == "subtitled").alias("subtitled"), F.count_if(F.col("audio") == "unknown").alias("unknown_audio"))
    m = m.hint("merge").join(plays, "entity", "left").withColumns({"genres_all": F.array_distinct(F.concat(F.coalesce("film_genres", F.array().cast("array<string>")), "genres"))})
    dubbed = F.coalesce("has_dubbed", F.lit(False))
    age, source, confident = classify.age_rating(F.col("adult"), F.col("certifications"), F.col("genres_all"), dubbed)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return m.select(
        "entity", "external_id", F.col("shown").alias("title"), F.coalesce(F.when((F.col("film_original") != "") & (F.col("film_original") != F.col("shown")), F.col("film_original")), other).alias("original_title"),
        F.coalesce("film_poster", "poster_url").alias("poster_url"), F.coalesce("film_minutes", "runtime_minutes").alias("runtime_minutes"), F.coalesce(some("film_overview"), "synopsis").alias("synopsis"),
        F.when(F.size("film_genres") > 0, F.col("film_genres")).otherwise(F.col("genres")).alias("genres"), F.col("home").alias("domestic"), dubbed.alias("has_dubbed"), age.cast("int").alias("age"), source.alias("age_source"), confident.alias("age_confident"),
        zero(F.col("showtimes")).alias("showtimes"), F.when(F.col("home"), 0).otherwise(zero(F.col("subtitled"))).alias("subtitled"), zero(F.col("unknown_audio")).alias("unknown_audio"),
        "score", F.when(F.col("score").isNotNull(), F.concat(F.lit(FILM_URL), F.col("external_id").cast("string"))).alias("score_url"),
    )


_case = "coalesce(length(regexp_replace({0}, '[^\\p{{Ll}}]', '', 'g')) / nullif(length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')), 0), 0)".format
_pick = f"lambda a, b: CASE WHEN {_case('b')} - {_case('a')} > 0.05 THEN b WHEN {_case('b')} - {_case('a')} < -0.05 THEN a WHEN length(b) < length(a) THEN b ELSE a END"
_order, _trust = "(venue_ord, listing_ord, listing_id)", "(t, venue_ord, listing_ord, listing_id)"
MERGE_SQL = f"""rows0 AS MATERIALIZED (SELECT l.*, x.entity, coalesce(v.trust_rank, 1073741824) AS t, coalesce(nullif({S.clean_title('raw_title')}, ''), {S.trimmed('raw_title')}) AS shown, {S.tidy_title('original_title')} AS tidy_o, {S.tidy_title('clean_title')} AS tidy_c FROM listing l JOIN members x USING (listing_id) LEFT JOIN dim_venue v USING (cinema_id)),
gen AS (SELECT entity, list(g ORDER BY o) AS genres FROM (SELECT entity, g, min((venue_ord, listing_ord, listing_id, i)) AS o FROM (SELECT entity, venue_ord, listing_ord, listing_id, unnest(genres) AS g, generate_subscripts(genres, 1) AS i FROM rows0) WHERE g IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
one AS (SELECT entity, coalesce(list_reduce(list(shown ORDER BY {_order}) FILTER (WHERE shown <> ''), {_pick}), 'Nepoznat film') AS title, arg_min(poster_url, {_order}) FILTER (WHERE poster_url <> '') AS poster_url, arg_min(runtime_minutes, {_trust}) FILTER (WHERE runtime_minutes > 0) AS runtime_minutes,
  arg_min(synopsis, {_order}) FILTER (WHERE synopsis <> '') AS synopsis, coalesce(bool_or(origin_country IN ('RS', 'SRB', 'SR')), false) AS domestic, count(DISTINCT cinema_id) AS cinemas,
  list_filter(list_concat(list(tidy_o ORDER BY {_trust}), list(tidy_c ORDER BY {_trust})), lambda v: v IS NOT NULL AND v <> '') AS originals FROM rows0 GROUP BY 1)"""
_members = "members AS (SELECT listing_id, entity FROM grouped)"
_latin = S.serbian_latin
FILMS_SQL = f"films AS (SELECT id AS external_id, {_latin('title')} AS film_title, original_title AS film_original, poster_url AS film_poster, {_latin('overview')} AS film_overview, nullif(runtime_minutes, 0) AS film_minutes, list_transform(list_filter(coalesce(genres, []), lambda g: g IS NOT NULL), lambda g: {_latin('g')}) AS film_genres, adult, certifications, original_language AS film_language, CASE WHEN vote_count >= 20 THEN vote_average END AS score FROM title_dim)"
PROGRAMME_SQL = f"""{GROUP_SQL}, {_members}, {MERGE_SQL}, {FILMS_SQL}, ext AS (SELECT entity, max(external_id) AS external_id FROM grouped GROUP BY 1),
plays AS (SELECT entity, count(*) AS showtimes, bool_or(a = 'dubbed') AS has_dubbed, count(*) FILTER (WHERE a = 'subtitled') AS subtitled, count(*) FILTER (WHERE a = 'unknown') AS unknown_audio FROM (SELECT listing_id, {AUDIO_SQL} AS a FROM showtime) JOIN members USING (listing_id) GROUP BY 1),
m AS (SELECT one.*, coalesce(nullif(film_title, ''), title) AS shown, e.external_id, films.* EXCLUDE (external_id), coalesce(gen.genres, []) AS own, domestic OR coalesce(film_language = 'sr', false) AS home, coalesce(has_dubbed, false) AS dub, coalesce(plays.showtimes, 0) AS n, coalesce(plays.subtitled, 0) AS sub, coalesce(plays.unknown_audio, 0) AS unk,
  list_distinct(list_concat(coalesce(film_genres, []), coalesce(gen.genres, []))) AS genres FROM one JOIN ext e USING (entity) LEFT JOIN films ON films.external_id = e.external_id LEFT JOIN gen USING (entity) LEFT JOIN plays USING (entity)),
a AS (SELECT *, """ + ", ".join(f"{_age_sql(c)} AS a_{c}" for c in classify.COUNTRIES) + f", {KID_SQL} AS kid, {GROWN_SQL} AS grown FROM m), b AS (SELECT *, coalesce(" + ", ".join(f"a_{c}" for c in classify.COUNTRIES) + ") AS sure, CASE " + " ".join(f"WHEN a_{c} IS NOT NULL THEN '{c}'" for c in classify.COUNTRIES) + f""" END AS src, CASE WHEN kid AND NOT grown THEN CASE WHEN dub THEN 0 ELSE 6 END WHEN grown THEN 16 END AS guess FROM a),
final AS (SELECT entity, external_id, shown AS title, coalesce(CASE WHEN film_original <> '' AND film_original <> shown THEN film_original END, list_filter(originals, lambda v: {S.normalize_title('v')} <> {S.normalize_title('shown')})[1]) AS original_title, coalesce(film_poster, poster_url) AS poster_url, coalesce(film_minutes, runtime_minutes) AS runtime_minutes,
  coalesce(nullif(film_overview, ''), synopsis) AS synopsis, CASE WHEN len(film_genres) > 0 THEN film_genres ELSE own END AS genres, home AS domestic, dub AS has_dubbed, CASE WHEN coalesce(adult, false) THEN 18 ELSE coalesce(sure, guess) END AS age, CASE WHEN coalesce(adult, false) THEN 'US' ELSE coalesce(src, CASE WHEN guess IS NOT NULL THEN 'heuristic' END) END AS age_source,
  CASE WHEN coalesce(adult, false) OR sure IS NOT NULL THEN true WHEN guess IS NOT NULL THEN false END AS age_confident, n AS showtimes, CASE WHEN home THEN 0 ELSE sub END AS subtitled, unk AS unknown_audio, score, CASE WHEN score IS NOT NULL THEN '{FILM_URL}' || external_id END AS score_url FROM b)"""


@query(f"WITH RECURSIVE {PROGRAMME_SQL} SELECT * REPLACE (array_to_string(genres, '|') AS genres), row_number() OVER (ORDER BY showtimes DESC, title COLLATE sr, entity) AS position FROM final")
def q_programme(spark, d):
    """The whole programme: one row per film in its final order, most screenings first, then by title as Serbian sorts it."""
    m = merged_programme(spark, d).withColumn("genres", F.array_join("genres", "|"))
    return publish.numbered(m, F.desc("showtimes"), F.collate("title", "sr"), F.col("entity"), into="position")


@query(f"WITH codes AS (SELECT listing_id, distributor_code AS entity FROM listing WHERE distributor_code IS NOT NULL), members AS (SELECT * FROM codes), {MERGE_SQL} SELECT entity AS distributor_code, title, poster_url, runtime_minutes, synopsis, domestic, cinemas, coalesce(array_to_string(gen.genres, '|'), '') AS genres, list_filter(originals, lambda v: {S.normalize_title('v')} <> {S.normalize_title('title')})[1] AS original_title FROM one LEFT JOIN gen USING (entity)")
def q_merged_records(spark, d):
    """All picked values of each distributor's film, the display title and the original title among them."""
    m = merge.merge_records(table(spark, d, "listing"), "distributor_code", table(spark, d, "dim_venue"))
    return m.select("distributor_code", "title", "poster_url", "runtime_minutes", "synopsis", "domestic", "cinemas", F.array_join("genres", "|").alias("genres"), "original_title")


# ---- cards, events, navigation ----------------------------------------------------------------------------------------------

_cards_from = f"({SHOWN}) s JOIN listing l USING (listing_id)"
_label_sql = "CASE a WHEN 'dubbed' THEN 'sinhronizovano' WHEN 'subtitled' THEN 'titlovano' WHEN 'original' THEN 'domaći film' ELSE 'nije naznačeno' END"


@query(f"""WITH s AS (SELECT s.listing_id, day, s.cinema_id, venue_ord, city_id, time, showtime_id, coalesce(format, '2D') AS format, {AUDIO_SQL} AS a FROM ({SHOWN}) s WHERE listing_id IS NOT NULL AND regexp_matches(time, '{PLAIN_TIME}')),
v AS (SELECT listing_id, day, string_agg(format || ' · ' || {_label_sql}, ', ' ORDER BY format, a) AS variants FROM (SELECT DISTINCT listing_id, day, format, a FROM s) GROUP BY 1, 2),
b AS (SELECT listing_id, day, cinema_id, venue_ord, city_id, to_json(list({{'time': time, 'format': format, 'audio': a}} ORDER BY time, showtime_id)) AS chips, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT listing_id, day, '[' || string_agg('{{"cinema":"' || cinema_id || '","chips":' || chips || '}}', ',' ORDER BY venue_ord, cinema_id) || ']' AS blocks, sum(n)::BIGINT AS showtimes FROM b GROUP BY 1, 2),
x AS (SELECT listing_id, day, string_agg(city_id, ' ' ORDER BY o) AS cities, bool_or(city_id = '{HOME_CITY}') AS home FROM (SELECT listing_id, day, city_id, min(venue_ord) AS o FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT c.listing_id, CAST(c.day AS VARCHAR) AS day, coalesce(array_to_string(list_filter(genres, lambda g: g IS NOT NULL)[1:3], ', '), '') AS meta, variants, blocks, showtimes, cities, NOT home AS hidden FROM c JOIN v USING (listing_id, day) JOIN x USING (listing_id, day) JOIN listing l USING (listing_id)""")
def q_cards(spark, d):
    """The card of every film and day: nested blocks in the order of the venues, variants in order, cities, three genres, whether it starts hidden."""
    audio = F.when(F.col("audio").isin("dubbed", "subtitled", "original"), F.col("audio")).otherwise("unknown")
    s = shown(spark, d).where(F.col("listing_id").isNotNull() & F.col("time").rlike(PLAIN_TIME)).select("listing_id", F.col("day").cast("string").alias("day"), "cinema_id", "venue_ord", "city_id", "time", "showtime_id", F.coalesce("format", F.lit("2D")).alias("format"), audio.alias("audio"))
    chip = F.struct("time", "showtime_id", "format", "audio")
    # partial per venue first: a block is bounded by the screenings of a film in one venue on one day
    b = s.groupBy("listing_id", "day", "cinema_id", "venue_ord", "city_id").agg(F.array_sort(F.collect_list(chip)).alias("x"), F.collect_set(F.struct("format", "audio")).alias("v"))
    block = F.struct("venue_ord", F.col("cinema_id").alias("cinema"), F.transform("x", lambda e: F.struct(e["time"].alias("time"), e["format"].alias("format"), e["audio"].alias("audio"))).alias("chips"))
    c = b.groupBy("listing_id", "day").agg(F.array_sort(F.collect_list(block)).alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v"), F.array_sort(F.collect_list(F.struct("venue_ord", "city_id"))).alias("c"))
    cities = F.array_distinct(F.transform("c", lambda e: e["city_id"]))
    genres = table(spark, d, "listing").select("listing_id", F.coalesce(F.array_join(F.slice(F.filter("genres", lambda g: g.isNotNull()), 1, 3), ", "), F.lit("")).alias("meta"))
    blocks = F.to_json(F.transform("b", lambda e: F.struct(e["cinema"].alias("cinema"), e["chips"].alias("chips"))))
    variants = F.array_join(F.transform("v", lambda e: F.concat(e["format"], F.lit(" · "), classify.audio_label(e["audio"]))), ", ")
    n = F.aggregate("b", F.lit(0).cast("bigint"), lambda t, e: t + F.size(e["chips"]))
    out = c.select("listing_id", "day", variants.alias("variants"), blocks.alias("blocks"), n.alias("showtimes"), F.array_join(cities, " ").alias("cities"), (~F.array_contains(cities, HOME_CITY)).alias("hidden"))
    return out.join(genres, "listing_id")


def belgrade_offset(day: Column, time: Column) -> Column:
    """The offset that Belgrade has at that time read as UTC, as +HH:00."""
    wall = F.try_to_timestamp(F.concat(day, F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm"))
    hours = F.floor((F.unix_seconds(F.from_utc_timestamp(wall, "Europe/Belgrade")) - F.unix_seconds(wall)) / 3600).cast("int")
    return F.format_string("+%02d:00", hours)


@query(f"""SELECT s.showtime_id, replace(to_json({{'@type': 'ScreeningEvent', 'name': {_latin('l.clean_title')}, 'startDate': CAST(day AS VARCHAR) || 'T' || time || ':00+0' || CAST((epoch((CAST(CAST(day AS VARCHAR) || ' ' || time || ':00' AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Belgrade') - epoch(CAST(CAST(day AS VARCHAR) || ' ' || time || ':00' AS TIMESTAMP))) // 3600 AS INT) || ':00',
'location': {{'@type': 'MovieTheater', 'name': {_latin('v.name')}, 'url': v.url}}}}), '<', '\\u003C') AS event FROM ({SHOWN}) s JOIN listing l USING (listing_id) JOIN (SELECT cinema_id, name, url FROM dim_venue) v ON v.cinema_id = s.cinema_id
WHERE s.city_id = '{HOME_CITY}' AND regexp_matches(time, '^([01][0-9]|2[0-3]):[0-5][0-9]$') AND l.clean_title IS NOT NULL""")
def q_events(spark, d):
    """Structured data: one event per screening in the first city, as a JSON text that cannot end the element it stands in."""
    v = F.broadcast(table(spark, d, "dim_venue").select("cinema_id", "name", "url"))
    l = table(spark, d, "listing").select("listing_id", "clean_title").where("clean_title is not null")
    s = shown(spark, d).where((F.col("city_id") == HOME_CITY) & F.col("time").rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")).join(v, "cinema_id").join(l, "listing_id")
    day = F.col("day").cast("string")
    event = F.struct(F.lit("ScreeningEvent").alias("@type"), text.serbian_latin(F.col("clean_title")).alias("name"), F.concat(day, F.lit("T"), F.col("time"), F.lit(":00"), belgrade_offset(day, F.col("time"))).alias("startDate"), F.struct(F.lit("MovieTheater").alias("@type"), text.serbian_latin(F.col("name")).alias("name"), F.col("url").alias("url")).alias("location"))
    return s.select("showtime_id", F.replace(F.to_json(event), F.lit("<"), F.lit("\\u003C")).alias("event"))


@query(f"""WITH days AS (SELECT DISTINCT CAST(day AS VARCHAR) AS day FROM ({SHOWN})), first AS (SELECT min(day) AS f FROM days), c AS (SELECT city_id, min(venue_ord) AS o, string_agg(name, ' · ' ORDER BY venue_ord) AS venues FROM dim_venue GROUP BY 1)
SELECT 'day' AS kind, day AS id, CASE WHEN day = f THEN 'index.html' ELSE day || '.html' END AS href, row_number() OVER (ORDER BY day) AS ord, NULL AS label FROM days, first UNION ALL
SELECT 'city', city_id, '?grad=' || city_id, row_number() OVER (ORDER BY o), venues FROM c""")
def q_navigation(spark, d):
    """Tabs of the days and of the cities in order, and the list of venues of each city."""
    days = shown(spark, d).select(F.col("day").cast("string").alias("id")).distinct()
    one = days.agg(F.array_sort(F.collect_list("id")).alias("x"))  # one entry per day of the calendar
    tabs = one.select(F.posexplode("x").alias("p", "id"), "x").select(F.lit("day").alias("kind"), "id", links.page_name(F.col("id"), F.get("x", F.lit(0))).alias("href"), (F.col("p") + 1).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("label"))
    v = table(spark, d, "dim_venue").groupBy("city_id").agg(F.array_sort(F.collect_list(F.struct("venue_ord", "name"))).alias("v"))
    cities = v.agg(F.array_sort(F.collect_list(F.struct(F.get("v", F.lit(0))["venue_ord"].alias("o"), "city_id", "v"))).alias("x")).select(F.posexplode("x").alias("p", "c"))
    city = cities.select(F.lit("city").alias("kind"), F.col("c.city_id").alias("id"), F.concat(F.lit("?grad="), F.col("c.city_id")).alias("href"), (F.col("p") + 1).cast("bigint").alias("ord"), F.array_join(F.transform("c.v", lambda e: e["name"]), " · ").alias("label"))
    return tabs.unionByName(city)


#: Requests as they may come: the slug in the address, the stored city, filters in the address and stored.
REQUESTS = "VALUES (1, NULL, NULL, NULL, NULL), (2, 'beograd', NULL, '1', NULL), (3, 'nema-ga', 'numutuda', '0', '1'), (4, NULL, 'nema-ga', NULL, '1'), (5, NULL, NULL, '1', '0'), (6, 'numutuda', 'drugi', '', NULL)"


@query(f"""WITH r AS (SELECT * FROM ({REQUESTS}) t(id, grad, stored, dubbed, stored_dubbed)), c AS (SELECT DISTINCT city_id FROM dim_venue)
SELECT id, coalesce(a.city_id, b.city_id, '{HOME_CITY}') AS city, coalesce(nullif(dubbed, ''), stored_dubbed, '0') = '1' AS dubbed FROM r LEFT JOIN c a ON a.city_id = r.grad LEFT JOIN c b ON b.city_id = r.stored""")
def q_filter_state(spark, d):
    """The filters of requests: the address before what is stored before the default; a city that does not exist counts as none."""
    r = spark.sql(f"SELECT * FROM ({REQUESTS}) AS t(id, grad, stored, dubbed, stored_dubbed)")
    c = table(spark, d, "dim_venue").select("city_id").distinct()
    known = lambda name: F.broadcast(c.select(F.col("city_id").alias(name)))
    x = r.join(known("a"), F.col("grad") == F.col("a"), "left").join(known("b"), F.col("stored") == F.col("b"), "left")
    return x.select("id", F.coalesce("a", "b", F.lit(HOME_CITY)).alias("city"), (F.coalesce(F.nullif(F.col("dubbed"), F.lit("")), "stored_dubbed", F.lit("0")) == "1").alias("dubbed"))


@query("""SELECT l.listing_id, replace(to_json({'title': clean_title, 'n': s.n, 'first': s.first}), '<', '\\u003C') AS document FROM listing l JOIN (SELECT listing_id, count(*) AS n, min(date || ' ' || time) AS first FROM showtime WHERE listing_id IS NOT NULL GROUP BY 1) s USING (listing_id) WHERE clean_title IS NOT NULL AND first IS NOT NULL""")
def q_json_summary(spark, d):
    """A small document per listing: its title, the number of its screenings and the first of them as printed."""
    s = table(spark, d, "showtime").where("listing_id is not null").groupBy("listing_id").agg(F.count("*").alias("n"), F.min(F.concat("date", F.lit(" "), "time")).alias("first")).where("first is not null")
    l = table(spark, d, "listing").select("listing_id", F.col("clean_title").alias("title")).where("title is not null")
    return l.join(s, "listing_id").select("listing_id", F.replace(F.to_json(F.struct("title", "n", "first")), F.lit("<"), F.lit("\\u003C")).alias("document"))


@query(f"""{TRAILER_SQL} SELECT d.landing_id, CASE WHEN t.key IS NULL THEN '{links.SEARCH}' || {component_sql("concat_ws(' ', title, CASE WHEN original_title <> '' AND original_title <> title THEN original_title END, 'trailer', 'srpski')")} ELSE '{links.WATCH}' || {component_sql('t.key')} END AS url, t.key IS NOT NULL AS exact
FROM details_response d JOIN title_dim f ON f.id = d.title_id LEFT JOIN t USING (landing_id)""")
def q_trailer_exact(spark, d):
    """What the poster of every fetched film links to: its trailer where one is known, else a search."""
    r = table(spark, d, "details_response").select("landing_id", F.col("title_id").alias("id")).join(table(spark, d, "title_dim").select("id", "title", "original_title"), "id")
    x = r.join(trailers(spark, d).select("landing_id", "key"), "landing_id", "left")
    url, exact = links.trailer_link(F.col("title"), F.col("original_title"), F.col("key"))
    return x.select("landing_id", url.alias("url"), F.coalesce(exact, F.lit(False)).alias("exact"))


def robots(base: str) -> str:
    """What crawlers may read, and where the list of pages is."""
    return f"User-agent: *\nAllow: /\nSitemap: {base.rstrip('/')}/sitemap.xml\n"


#: The client's clock, as parameters: UTC instants and what the day and the minute in Belgrade are.
NOW = "VALUES (1, TIMESTAMP '2026-06-01 16:00:00'), (2, TIMESTAMP '2026-06-01 22:30:00'), (3, TIMESTAMP '2026-10-25 00:30:00'), (4, TIMESTAMP '2026-10-25 01:30:00'), (5, NULL), (6, TIMESTAMP '2026-12-31 23:00:00')"


@query(f"""WITH n AS (SELECT * FROM ({NOW}) t(id, utc)), l AS (SELECT id, (utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Belgrade' AS wall FROM n)
SELECT l.id, strftime(wall, '%Y-%m-%d') AS today, hour(wall) * 60 + minute(wall) AS cutoff, count(s.showtime_id) AS begun FROM l LEFT JOIN (SELECT showtime_id, CAST(day AS VARCHAR) AS day, TRY_CAST(substring(time, 1, 2) AS INT) * 60 + TRY_CAST(substring(time, 4, 2) AS INT) AS start FROM ({SHOWN}) WHERE regexp_matches(time, '{PLAIN_TIME}')) s ON s.day = strftime(wall, '%Y-%m-%d') AND s.start < hour(wall) * 60 + minute(wall) GROUP BY ALL""")
def q_now(spark, d):
    """Day and minute in Belgrade of given instants, and how many screenings of that day have begun; the instant is a parameter, never the clock."""
    n = spark.sql(f"SELECT id, utc FROM ({NOW.replace('TIMESTAMP ', 'TIMESTAMP_NTZ ')}) AS t(id, utc)")
    at = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Belgrade"), F.col("utc"))
    l = n.select("id", F.date_format(at, "yyyy-MM-dd").alias("today"), (F.hour(at) * 60 + F.minute(at)).alias("cutoff"))
    s = shown(spark, d).where(F.col("time").rlike(PLAIN_TIME)).groupBy(F.col("day").cast("string").alias("today"), (F.substring("time", 1, 2).try_cast("int") * 60 + F.substring("time", 4, 2).try_cast("int")).alias("start")).agg(F.count("*").alias("k"))
    begun = l.join(s, "today", "left").groupBy("id", "today", "cutoff").agg(F.sum(F.when(F.col("start") < F.col("cutoff"), F.col("k")).otherwise(0)).alias("begun"))
    return begun.select("id", "today", "cutoff", "begun")
