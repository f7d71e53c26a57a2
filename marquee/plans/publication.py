"""Queries of what is published: days, links, pages, reports, documents; and the refresh as a stream."""

from __future__ import annotations

import uuid
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.functions import classify, links, temporal, text
from marquee.plans import sql as S
from marquee.plans.programme import AUDIO_SQL, PLAIN_TIME, QUERIES, SHOWN, SQL, query, shown
from marquee.session import table, utc_wall
from marquee.sources import html
from marquee.streaming import refresh

__all__ = ["QUERIES", "SQL"]
TODAY = "2026-06-01"
#: Origins of venues, a fixed dimension; beyond this the list must become a join.
MAX_ORIGINS = 10_000
_array = lambda xs: "[" + ", ".join(S.lit(x) for x in xs) + "]"


@query(f"""WITH d AS (SELECT DISTINCT day FROM ({SHOWN})), x AS (SELECT day, date_diff('day', DATE '{TODAY}', day) AS delta, {_array(temporal.WEEKDAYS)}[dayofweek(day) + 1] AS wd FROM d)
SELECT CAST(day AS VARCHAR) AS day, delta, CASE delta WHEN 0 THEN 'danas' WHEN 1 THEN 'sutra' ELSE wd || ', ' || day(day) || '. ' || {_array(temporal.MONTHS)}[month(day)] END AS label,
CASE delta WHEN 0 THEN 'danas' WHEN 1 THEN 'sutra' ELSE substring(wd, 1, 3) END || ' ' || day(day) || '.' || month(day) || '.' AS short, CAST(lead(day) OVER (ORDER BY day) AS VARCHAR) AS next_day FROM x""")
def q_day_labels(spark, d):
    """Labels of the days with screenings, and the day after each."""
    days = shown(spark, d).select("day").distinct()
    today = F.lit(TODAY).cast("date")
    # one row per day of the programme: a window without partitions is bounded by the calendar
    return days.select(F.col("day").cast("string").alias("day"), F.datediff("day", today).cast("bigint").alias("delta"), temporal.day_label(F.col("day"), today).alias("label"), temporal.day_short(F.col("day"), today).alias("short"), F.lead(F.col("day").cast("string")).over(W.orderBy("day")).alias("next_day"))


TIME_SQL = r"""CASE WHEN TRY_CAST(nullif(regexp_extract(time, '([0-9]{1,2})\s*[:.hH]\s*([0-9]{2})', 1), '') AS INT) <= 23 AND TRY_CAST(nullif(regexp_extract(time, '([0-9]{1,2})\s*[:.hH]\s*([0-9]{2})', 2), '') AS INT) <= 59
THEN lpad(regexp_extract(time, '([0-9]{1,2})\s*[:.hH]\s*([0-9]{2})', 1), 2, '0') || ':' || regexp_extract(time, '([0-9]{1,2})\s*[:.hH]\s*([0-9]{2})', 2) END"""


@query(f"SELECT showtime_id, t AS time, coalesce(CAST(substring(t, 1, 2) AS INT) * 60 + CAST(substring(t, 4, 2) AS INT), -1) AS minutes FROM (SELECT showtime_id, {TIME_SQL} AS t FROM showtime)")
def q_normalize_time(spark, d):
    t = table(spark, d, "showtime").select("showtime_id", temporal.normalize_time(F.col("time")).alias("time"))
    return t.withColumn("minutes", temporal.minutes_of(F.coalesce("time", F.lit(""))))


@query(r"""WITH m AS (SELECT landing_id, regexp_matches(showtime, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}') AS ok, showtime AS s FROM api_session)
SELECT landing_id, CASE WHEN ok THEN substring(s, 1, 10) END AS date, CASE WHEN ok THEN substring(s, 12, 5) END AS time FROM m""")
def q_wall_parts(spark, d):
    """Date and time as printed in ISO stamps."""
    date, time = temporal.wall_parts(F.col("showtime"))
    return table(spark, d, "api_session").select("landing_id", date.alias("date"), time.alias("time"))


LOCAL = "(fetched_at AT TIME ZONE 'Europe/Belgrade')"


@query(f"""SELECT listing_id, strftime({LOCAL}, '%Y-%m-%d') AS day, strftime({LOCAL}, '%H:%M') AS time, strftime({LOCAL}, '%d.%m.%Y. u %H:%M') AS label,
'+0' || CAST((epoch({LOCAL}) - epoch(fetched_at)) // 3600 AS INT) || ':00' AS off FROM listing""")
def q_tz_local(spark, d):
    """Belgrade day, time, label and offset of every fetch; also where the session is not in UTC."""
    l = table(spark, d, "listing")
    utc = utc_wall(l, "fetched_at")
    minutes = (F.unix_seconds(temporal.local(utc)) - F.unix_seconds(utc)) / 60
    off = F.format_string("+%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))
    return l.select("listing_id", temporal.local_date(utc).alias("day"), temporal.local_time(utc).alias("time"), temporal.timestamp_label(utc).alias("label"), off.alias("off"))


WINDOW = [f"2026-06-{i:02d}" for i in range(1, 9)]


@query(rf"""WITH m AS (SELECT showtime_id, regexp_extract(date, '([0-9]{{1,2}}) *\. *([0-9]{{1,2}}) *\.', 1) AS d, regexp_extract(date, '([0-9]{{1,2}}) *\. *([0-9]{{1,2}}) *\.', 2) AS m FROM showtime)
SELECT showtime_id, w AS day FROM m JOIN (SELECT unnest({_array(WINDOW)}) AS w) ON d <> '' AND substring(w, 6) = lpad(m, 2, '0') || '-' || lpad(d, 2, '0')""")
def q_resolve_date(spark, d):
    """Labels without a year as a day of an eight-day window."""
    day = temporal.resolve_date(F.col("date"), F.array(*map(F.lit, WINDOW)))
    return table(spark, d, "showtime").select("showtime_id", day.alias("day")).where("day is not null")


@query(r"""WITH t AS (SELECT listing_id, regexp_replace(regexp_replace(poster_url, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'), '[\t\n\r]', '', 'g') AS t FROM listing),
s AS (SELECT *, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme FROM t)
SELECT listing_id, CASE WHEN t <> '' AND NOT starts_with(t, '//') AND scheme IN ('', 'http', 'https', 'mailto') AND NOT regexp_matches(t, '^https?:/*$', 'i') THEN t END AS url FROM s""")
def q_safe_url(spark, d):
    return table(spark, d, "listing").select("listing_id", links.safe_url(F.col("poster_url")).alias("url"))


@query(r"""SELECT showtime_id, CASE WHEN regexp_matches(booking_url, '^https?://[a-z0-9-]+\.example(/|$)') THEN booking_url END AS url FROM showtime""")
def q_origin_allowlist(spark, d):
    """Booking links on the origins of the venues; anything else is dropped."""
    origins = [r[0] for r in table(spark, d, "dim_venue").select(F.regexp_extract("url", r"^(https?://[^/]+)", 1)).distinct().limit(MAX_ORIGINS + 1).collect()]
    if len(origins) > MAX_ORIGINS:
        raise ValueError(f"more than {MAX_ORIGINS} origins of venues")
    allowed = tuple(sorted({o.replace("http://", "https://") for o in origins} | {o.replace("https://", "http://") for o in origins}))
    return table(spark, d, "showtime").select("showtime_id", links.on_origin("https://programme.example/", allowed)("booking_url").alias("url"))


def component_sql(x: str) -> str:
    return f"replace(replace(replace(replace(replace(url_encode({x}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"


@query(f"SELECT id, '{links.SEARCH}' || {component_sql("concat_ws(' ', title, CASE WHEN original_title <> '' AND original_title <> title THEN original_title END, 'trailer', 'srpski')")} AS url, false AS exact FROM title_dim")
def q_trailer_links(spark, d):
    """What a poster links to: a search where no trailer is known."""
    url, exact = links.trailer_link(F.col("title"), F.col("original_title"), F.lit(None).cast("string"))
    return table(spark, d, "title_dim").select("id", url.alias("url"), exact.alias("exact"))


@query("SELECT landing_id, CASE WHEN id <> '' THEN 'https://programme.example/purchase/wizard/' || id ELSE 'https://programme.example/cinemas/' || cinema_id || '?date=all' END AS url FROM api_session")
def q_booking_url(spark, d):
    base = "https://programme.example"
    return table(spark, d, "api_session").select("landing_id", F.when(F.col("id") != "", F.concat(F.lit(f"{base}/purchase/wizard/"), "id")).otherwise(F.concat(F.lit(f"{base}/cinemas/"), "cinema_id", F.lit("?date=all"))).alias("url"))


@query(f"""WITH c AS (SELECT city_id, count(*) AS n, count(*) FILTER (WHERE {AUDIO_SQL} = 'dubbed') > 0 AS dubbed FROM ({SHOWN}) GROUP BY 1)
SELECT city_id, n, n || ' ' || CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 'projekcija' WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN 'projekcije' ELSE 'projekcija' END AS label,
CASE WHEN city_id = 'numutuda' AND NOT dubbed THEN '' ELSE '?' || concat_ws('&', CASE WHEN city_id <> 'numutuda' THEN 'grad=' || city_id END, CASE WHEN dubbed THEN 'dubbed=1' END) END AS state FROM c""")
def q_plural_state(spark, d):
    """Counts with the right plural, and the filter state of each city as a query string."""
    c = shown(spark, d).groupBy("city_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("audio") == "dubbed", F.lit(False))).alias("dubbed"))
    label = F.concat(F.col("n").cast("string"), F.lit(" "), classify.plural(F.col("n"), "projekcija", "projekcije", "projekcija"))
    return c.select("city_id", "n", label.alias("label"), links.query_string(F.col("city_id"), "numutuda", F.col("dubbed"), F.lit(False)).alias("state"))


@query(f"SELECT id, to_base64(unhex(sha256(title))) AS hash, replace(replace(replace(replace(replace({S.serbian_latin('title')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM title_dim")
def q_hash_escape(spark, d):
    return table(spark, d, "title_dim").select("id", links.content_hash(F.col("title")).alias("hash"), links.escape_html(F.col("title")).alias("html"))


def fixed_one(x: pd.Series) -> pd.Series:
    """One decimal of the exact binary value, half away from zero, with a comma."""
    return x.map(lambda v: None if pd.isna(v) else str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)).replace(".", ","))


@query("SELECT id, replace(printf('%.1f', vote_average), '.', ',') AS score FROM title_dim WHERE vote_average IS NOT NULL")
def q_score_label(spark, d):
    return table(spark, d, "title_dim").where("vote_average is not null").select("id", F.pandas_udf(fixed_one, "string")("vote_average").alias("score"))


#: Chains that get a column of their own in the report; all others share one.
CHAINS = ["zvezdoplex", "kinorama", "platno"]


@query("SELECT CAST(day AS VARCHAR) AS day, " + ", ".join(f"count(*) FILTER (WHERE chain = '{c}') AS {c}" for c in CHAINS) + f", count(*) FILTER (WHERE chain NOT IN ({', '.join(map(S.lit, CHAINS))})) AS other FROM ({SHOWN}) s JOIN (SELECT cinema_id, chain FROM dim_venue) USING (cinema_id) GROUP BY 1")
def q_pivot_report(spark, d):
    """Screenings per day, a column per chain."""
    v = F.broadcast(table(spark, d, "dim_venue").select("cinema_id", F.when(F.col("chain").isin(CHAINS), F.col("chain")).otherwise("other").alias("c")))
    p = shown(spark, d).join(v, "cinema_id").groupBy(F.col("day").cast("string").alias("day")).pivot("c", [*CHAINS, "other"]).agg(F.count(F.lit(1)))
    return p.select("day", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*CHAINS, "other"]])


@query(f"""SELECT count(*) AS listings, count(*) FILTER (WHERE distributor_code IS NOT NULL) AS resolved, count(*) FILTER (WHERE distributor_code IS NULL) AS unresolved,
count(DISTINCT CASE WHEN distributor_code IS NULL THEN clean_title END) AS unresolved_titles, count(*) FILTER (WHERE runtime_minutes IS NULL) AS no_runtime, round(count(distributor_code) / count(*), 9) AS share,
(SELECT count(*) FROM showtime WHERE {AUDIO_SQL} = 'unknown') AS unknown_audio FROM listing""")
def q_unresolved_diag(spark, d):
    """How many listings are resolved, how many titles and screenings are not."""
    code = F.col("distributor_code")
    a = table(spark, d, "listing").agg(F.count("*").alias("listings"), F.count(code).alias("resolved"), F.count_if(code.isNull()).alias("unresolved"), F.countDistinct(F.when(code.isNull(), F.col("clean_title"))).alias("unresolved_titles"), F.count_if(F.col("runtime_minutes").isNull()).alias("no_runtime"), F.round(F.count(code) / F.count("*"), 9).alias("share"))
    b = table(spark, d, "showtime").agg(F.count_if(~F.coalesce(F.col("audio").isin("dubbed", "subtitled", "original"), F.lit(False))).alias("unknown_audio"))
    return a.join(F.broadcast(b))  # one row each


@query("""WITH c AS (SELECT l.clean_title AS title, count(*) AS n, min(l.listing_id) AS listing_id FROM showtime s JOIN listing l USING (listing_id) WHERE l.clean_title IS NOT NULL GROUP BY 1)
SELECT title, n, row_number() OVER (ORDER BY n DESC, listing_id) AS rank FROM c ORDER BY n DESC, listing_id LIMIT 100""")
def q_top_movies(spark, d):
    """The hundred titles with the most screenings."""
    s = table(spark, d, "showtime").groupBy("listing_id").agg(F.count("*").alias("k"))
    c = s.join(table(spark, d, "listing").select("listing_id", "clean_title"), "listing_id").where("clean_title is not null").groupBy(F.col("clean_title").alias("title")).agg(F.sum("k").alias("n"), F.min("listing_id").alias("listing_id"))
    top = c.orderBy(F.desc("n"), "listing_id").limit(100)
    return top.select("title", "n", F.row_number().over(W.orderBy(F.desc("n"), "listing_id")).cast("bigint").alias("rank"))


@query("""SELECT 'listing' AS src, count(*) AS orphans FROM listing WHERE cinema_id NOT IN (SELECT cinema_id FROM dim_venue) UNION ALL
SELECT 'showtime', count(*) FROM showtime WHERE cinema_id NOT IN (SELECT cinema_id FROM dim_venue) UNION ALL
SELECT 'showtime_listing', count(*) FROM showtime WHERE listing_id IS NOT NULL AND listing_id NOT IN (SELECT listing_id FROM listing) UNION ALL
SELECT 'venue_cities', count(*) FROM (SELECT cinema_id FROM dim_venue GROUP BY 1 HAVING count(DISTINCT city_id) > 1)""")
def q_referential(spark, d):
    """Rows that point to nothing, and venues in more than one city."""
    v, l, s = (table(spark, d, t) for t in ("dim_venue", "listing", "showtime"))
    none = lambda df, on, ref, name: df.where(F.col(on).isNotNull()).join(ref, on, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("src"), "orphans")
    ids = l.select("listing_id")
    return none(l, "cinema_id", v, "listing").union(none(s, "cinema_id", v, "showtime")).union(none(s, "listing_id", ids, "showtime_listing")).union(v.groupBy("cinema_id").agg(F.countDistinct("city_id").alias("n")).where("n > 1").agg(F.count("*").alias("orphans")).select(F.lit("venue_cities").alias("src"), "orphans"))


START = f"coalesce(CASE WHEN regexp_matches(time, '{PLAIN_TIME}') THEN TRY_CAST(substring(time, 1, 2) AS INT) * 60 + TRY_CAST(substring(time, 4, 2) AS INT) END, -1)"


@query(f"""WITH c AS (SELECT listing_id, day, cinema_id, venue_ord, string_agg(time || ' ' || coalesce(format, '2D'), ' | ' ORDER BY time, showtime_id) AS chips, count(*) AS n FROM ({SHOWN}) WHERE listing_id IS NOT NULL AND regexp_matches(time, '{PLAIN_TIME}') GROUP BY ALL)
SELECT listing_id, CAST(day AS VARCHAR) AS day, string_agg(cinema_id || ': ' || chips, chr(10) ORDER BY venue_ord, cinema_id) AS card, CAST(sum(n) AS BIGINT) AS showtimes, count(*) AS blocks FROM c GROUP BY 1, 2""")
def q_page_model(spark, d):
    """The card of every film and day: blocks in the order of the venues, screenings in order of time."""
    s = shown(spark, d).where(F.col("listing_id").isNotNull() & F.col("time").rlike(PLAIN_TIME))
    chip = F.struct("time", "showtime_id", F.concat_ws(" ", "time", F.coalesce("format", F.lit("2D"))).alias("t"))
    c = s.groupBy("listing_id", F.col("day").cast("string").alias("day"), "cinema_id", "venue_ord").agg(F.array_sort(F.collect_list(chip)).alias("x"))
    block = F.struct("venue_ord", "cinema_id", F.concat(F.col("cinema_id"), F.lit(": "), F.array_join(F.transform("x", lambda e: e["t"]), " | ")).alias("t"), F.size("x").alias("n"))
    g = c.groupBy("listing_id", "day").agg(F.array_sort(F.collect_list(block)).alias("b"))
    return g.select("listing_id", "day", F.array_join(F.transform("b", lambda e: e["t"]), "\n").alias("card"), F.aggregate("b", F.lit(0).cast("bigint"), lambda a, e: a + e["n"]).alias("showtimes"), F.size("b").cast("bigint").alias("blocks"))


@query()
def q_json_export(spark, d):
    """One document per film with its screenings nested, absent values left out."""
    s = table(spark, d, "showtime").where("listing_id is not null").groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("date", "time", "cinema_id", "format", "audio"))).alias("showtimes"))
    l = table(spark, d, "listing").select("listing_id", F.col("clean_title").alias("title"), "year", "genres")
    doc = F.replace(F.to_json(F.struct("title", "year", "genres", "showtimes")), F.lit("<"), F.lit("\\u003C"))
    return l.join(s, "listing_id").select("listing_id", doc.alias("document"))


@query(f"""WITH d AS (SELECT DISTINCT CAST(day AS VARCHAR) AS day FROM ({SHOWN})), p AS (SELECT day, CASE WHEN day = (SELECT min(day) FROM d) THEN '' ELSE day || '.html' END AS page FROM d)
SELECT '<urlset>' || chr(10) || string_agg('<url><loc>https://programme.example/' || page || '</loc></url>', chr(10) ORDER BY day) || chr(10) || '</urlset>' AS sitemap, count(*) AS pages FROM p""")
def q_sitemap(spark, d):
    """The list of day pages; the first day is the bare address."""
    days = shown(spark, d).select(F.col("day").cast("string").alias("day")).distinct()
    one = days.agg(F.array_sort(F.collect_list("day")).alias("x"))  # one entry per day of the calendar
    loc = F.transform("x", lambda day, i: F.concat(F.lit("<url><loc>https://programme.example/"), F.when(i == 0, "").otherwise(F.concat(day, F.lit(".html"))), F.lit("</loc></url>")))
    return one.select(F.concat(F.lit("<urlset>\n"), F.array_join(loc, "\n"), F.lit("\n</urlset>")).alias("sitemap"), F.size("x").cast("bigint").alias("pages"))


@query(f"""WITH s AS (SELECT cinema_id, max({LOCAL}) AS last FROM listing GROUP BY 1), n AS (SELECT max(last) AS newest FROM s)
SELECT v.city_id, count(*) AS stale, string_agg(v.name || ' (' || strftime(last, '%d.%m.%Y. u %H:%M') || ')', ', ' ORDER BY v.venue_ord) AS notice FROM s JOIN dim_venue v USING (cinema_id), n WHERE last < newest - INTERVAL 7 DAY GROUP BY 1""")
def q_source_notices(spark, d):
    """Per city the sources whose newest listing is a week behind the newest of all."""
    l = table(spark, d, "listing")
    local = temporal.local(utc_wall(l, "fetched_at"))
    s = l.select("cinema_id", local.alias("at")).groupBy("cinema_id").agg(F.max("at").alias("last"))
    n = s.agg(F.max("last").alias("newest"))
    old = s.join(F.broadcast(n)).where(F.col("last") < F.col("newest") - F.expr("interval 7 days"))
    v = F.broadcast(table(spark, d, "dim_venue").select("cinema_id", "city_id", "name", "venue_ord"))
    line = F.concat(F.col("name"), F.lit(" ("), F.date_format("last", "dd.MM.yyyy. 'u' HH:mm"), F.lit(")"))
    return old.join(v, "cinema_id").groupBy("city_id").agg(F.count("*").alias("stale"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("venue_ord", line.alias("t")))), lambda e: e["t"]), ", ").alias("notice"))


#: Bytes of screenings in a page; far below what the parser refuses.
PAGE_BYTES = 1 << 20


def programme_pages(s, most: int = PAGE_BYTES):
    """(url, body): pages of a venue, film and day, in parts of about `most` bytes; texts are escaped."""
    perf = F.concat(F.lit('<a class="perf" href="/show/'), F.col("showtime_id").cast("string"), F.lit('" data-format="'), links.escape_markup(F.coalesce("format", F.lit(""))), F.lit('">'), links.escape_markup(F.col("time")), F.lit("</a>"))
    keys = ["cinema_id", "listing_id", "clean_title", "date"]
    so_far = F.sum(F.octet_length("perf")).over(W.partitionBy(*keys).orderBy("showtime_id").rowsBetween(W.unboundedPreceding, 0))
    parts = s.select(*keys, "showtime_id", perf.alias("perf")).withColumn("part", F.floor(so_far / most))
    body = F.concat(F.lit('<div class="movie-item"><h3><span>Film</span>'), links.escape_markup(F.col("clean_title")), F.lit('</h3><div class="day-wrapper" data-date="'), links.escape_markup(F.col("date")), F.lit('">'), F.array_join("perfs", ""), F.lit("</div></div>"))
    return parts.groupBy(*keys, "part").agg(F.collect_list("perf").alias("perfs")).select(F.col("cinema_id").alias("url"), body.alias("body"))


@query(f"""SELECT cinema_id AS url, {S.trimmed(S.squeezed('clean_title'))} AS title, date, time, count(*) AS n FROM ({SHOWN.replace('SELECT s.*', 'SELECT s.*, l.clean_title').replace('FROM showtime s', 'FROM showtime s JOIN listing l USING (listing_id)').replace('JOIN dim_venue v USING (cinema_id)', 'JOIN dim_venue v ON v.cinema_id = s.cinema_id')})
WHERE {S.trimmed('clean_title')} <> '' AND regexp_matches(time, '{PLAIN_TIME}') GROUP BY ALL""")
def q_html_pages(spark, d):
    """Pages made of the programme and parsed again: screenings per venue, title and time; marks, Cyrillic, signs and quotes are escaped and read back."""
    l = table(spark, d, "listing").select("listing_id", "clean_title").where("clean_title is not null")
    s = shown(spark, d).where(F.col("time").rlike(PLAIN_TIME)).join(l, "listing_id")
    return html.parse_pages(programme_pages(s)).groupBy("url", "title", "date", "time").agg(F.count("*").alias("n"))


@query("SELECT CAST(CAST(date_trunc('day', landed_at AT TIME ZONE 'UTC') AS DATE) AS VARCHAR) AS day, cinema_id, count(*) AS n FROM api_session GROUP BY 1, 2")
def q_stream_counts(spark, d):
    """Landed sessions per day and venue, counted by a stream over event time with a watermark."""
    t = table(spark, d, "api_session")
    at = f"{d}/api_session.parquet"
    files = t.inputFiles()
    folder = at if len(files) > 1 else at.rsplit("/", 1)[0]
    stream = spark.readStream.schema(t.schema).option("pathGlobFilter", "*.parquet" if len(files) > 1 else "api_session.parquet").parquet(folder)
    counts = refresh.windowed_counts(stream.select("landed_at", "cinema_id"), "landed_at", "cinema_id")
    out = refresh.run_to_table(counts, f"counts-{uuid.uuid4().hex}", ["start", "cinema_id"])
    return out.select(F.date_format(F.to_utc_timestamp("start", F.current_timezone()), "yyyy-MM-dd").alias("day"), "cinema_id", "n")
