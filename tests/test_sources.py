import json

from pyspark.sql import functions as F

from marquee.sources import files, html
from marquee.streaming import refresh

PAGE = """<html><body><script>var x = '</p>';</script>
<div class="movie-item"><h3><span>Novo</span>Velika trka</h3><img src="/p/1.jpg"><p><strong>Žanr:</strong>akcija, drama; <br>komedija</p><p><strong>Trajanje:</strong>101 min</p>
 <div class="day-wrapper" data-date="2026-08-19"><a class="perf" data-format="3D/SINH" data-hall="5" href="/s/1">18:00</a><a class="perf" href="https://t.example/sale/index/">00:00</a></div>
 <div class="day-wrapper" data-date="2026-09-30"><a class="perf" href="/s/9">20:00</a></div></div>
<div class="movie-item"><h3>Bez termina</h3></div>
<div class="movie-item"><h1>Tri &amp; po</h1><li class="tab">2026-08-20</li><li class="tab">2026-08-21</li><div class="pane"><a class="perf" href="/s/2">17:30</a></div><div class="pane"><a class="perf" href="/s/3">00:00</a></div></div>
<a href="/film/7#top"></a><a href="/film/7" title="Sedmi"><img src="s.png"></a><a href="/film/8">Osmi</a><a href="/x">Y</a>"""


def test_pages(spark):
    df = spark.createDataFrame([("u1", PAGE), ("u2", None), ("u3", ""), ("u4", "<div class='movie-item'><h3>"), ("u1", PAGE)], "url string, body string")
    rows = html.parse_pages(df, [f"2026-08-{d}" for d in range(19, 27)]).collect()
    got = sorted((r["title"], r["date"], r["time"], r["code"], r["hall"], r["booking_url"]) for r in rows)
    one = [("Tri & po", "2026-08-20", "17:30", "", None, "/s/2"), ("Tri & po", "2026-08-21", "00:00", "", None, "/s/3"), ("Velika trka", "2026-08-19", "18:00", "3D/SINH", "5", "/s/1")]
    assert got == sorted(one * 2)
    assert {tuple(r["genres"]) for r in rows if r["title"] == "Velika trka"} == {("akcija", "drama", "komedija")}
    assert html.parse_pages(df, None, most=10).count() == 0


def test_links():
    assert html.links(PAGE, "/film/") == [("/film/7", "Sedmi", "s.png"), ("/film/8", "Osmi", None)]


def test_json_sessions(spark):
    body = json.dumps({"date": "2026-08-19", "sessions": [{"id": "1-2", "movieId": "M", "technologies": [["3D", "sinh"], None], "showtime": "2026-08-19T20:00:00+02:00"}, {"id": "1-3", "showtime": "x"}, {"id": None, "showtime": "2026-08-19T20:00:00+02:00"}, {"id": "1-4", "technologies": None, "showtime": "2026-08-30T21:15:00+02:00"}]})
    df = spark.createDataFrame([(1, body), (2, None), (3, "{")], "landing_id bigint, body string")
    rows = [tuple(r)[2:] for r in files.api_sessions(df).orderBy("id").collect()]
    assert rows == [("1-2", "M", "2026-08-19", "20:00", "dubbed", "3D"), ("1-4", None, "2026-08-30", "21:15", "subtitled", "2D")]
    assert files.api_sessions(df, ["2026-08-19"]).count() == 1


def test_json_or_empty_and_pages(spark, tmp_path):
    assert files.json_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "a.json").write_text('{"a": 3}')
    assert files.json_or_empty(spark, str(tmp_path / "a.json"), "a int").collect()[0]["a"] == 3
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_text(PAGE)
    (tmp_path / "p" / "big.html").write_text("x" * 9000)
    pages = {r["url"].rsplit("/", 1)[1]: (r["body"] is None, r["error"]) for r in files.landed_pages(spark, str(tmp_path / "p"), 8000).collect()}
    assert pages == {"x.html": (False, None), "big.html": (True, "more than 8000 bytes: 9000")}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"a": 3}')
    (tmp_path / "j" / "b.json").write_text('{"a": ')
    assert [r["a"] for r in files.json_or_empty(spark, str(tmp_path / "j"), "a int").collect()] == [3]


def test_film_pages_and_links(spark):
    home = spark.createDataFrame([("h", '<a href="/film/7#x"></a><a href="http://s.example/film/7" title="Sedmi"><img src="s.png"></a><a href="/film/8/">Osmi</a><a href="/filmovi">Y</a><a href="//[bad">Z</a>'), ("n", None)], "url string, body string")
    got = [tuple(r)[1:] for r in html.film_links(home, "http://s.example/").orderBy("ord").collect()]
    assert got == [("http://s.example/film/7", 0, "Sedmi", "http://s.example/s.png"), ("http://s.example/film/8/", 1, "Osmi", None)]
    body = '<div><h1>Sedmi film</h1><p>The Seventh | Trajanje: 98 min</p></div>'
    pages = spark.createDataFrame([("http://s.example/film/7", body), ("b", '<meta property="og:title" content=" Iz  zaglavlja "><h1></h1>'), ("c", None)], "url string, body string")
    d = html.film_pages(pages)
    assert {r["url"]: r["title"] for r in d.collect()} == {"http://s.example/film/7": "Sedmi film", "b": "Iz zaglavlja", "c": None}
    shows = spark.createDataFrame([("http://s.example/film/7", "18:00"), ("http://s.example/film/8/", "20:00")], "url string, time string")
    out = {r["title"]: (r["original_title"], r["runtime_minutes"], r["time"]) for r in html.with_details(html.film_links(home, "http://s.example/"), d, shows).collect()}
    assert out == {"Sedmi": ("The Seventh", 98, "18:00"), "Osmi": (None, None, "20:00")}
    assert [tuple(r) for r in html.refused(pages, 65).collect()] == [("http://s.example/film/7", f"more than 65 bytes: {len(body)}")]


def test_sessions_take_titles_in_order_and_titles_may_say_dubbed(spark):
    body = json.dumps({"sessions": [{"id": str(i), "movieId": m, "technologies": [["2D"]], "showtime": "2026-08-19T20:00:00+02:00"} for i, m in enumerate(["a", "b", "c", "d"])]})
    s = spark.createDataFrame([(1, body)], "landing_id bigint, body string").select("landing_id", F.posexplode(F.from_json("body", f"struct<sessions:array<{files.SESSION}>>")["sessions"]).alias("ord", "s")).select("landing_id", "ord", "s.*")
    films = spark.createDataFrame([("a", "Prvi", "x", "y"), ("b", None, "Drugi - sinhronizovano", "y"), ("c", None, None, "Treći"), ("d", None, None, None)], "id string, titleCalculated string, title string, titleOriginalCalculated string")
    got = {r["movieId"]: (r["rawTitle"], r["audio"]) for r in files.screenings(s, None, films).collect()}
    assert got == {"a": ("Prvi", "subtitled"), "b": ("Drugi - sinhronizovano", "dubbed"), "c": ("Treći", "subtitled")}


def test_scan_isolates_failures_and_falls_back(spark):
    one = spark.createDataFrame([(1,)], "id int")

    def broken():
        raise RuntimeError("HTTP 500 https://x.example/a?key=secret")

    live, errors = files.scan({"a": lambda: one, "b": broken, "c": lambda: one.where("false")})
    assert errors == {"b": "HTTP 500 https://x.example/a", "c": "no listings"}
    prev = spark.createDataFrame([(8, "b"), (9, "a")], "id int, source string")
    assert sorted((r["id"], r["source"], r["stale"]) for r in files.with_last_good(live, prev, list(errors)).collect()) == [(1, "a", False), (8, "b", True)]
    assert files.with_last_good(None, prev, ["a"]).count() == 1


def test_refresh_stream_equals_batch(spark, small, tmp_path):
    src = spark.read.parquet(f"{small}/showtime.parquet").select("showtime_id", "cinema_id", "landed_at", F.lit("2026-06-01").alias("date"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        q = refresh.refresh(refresh.landed(spark, str(tmp_path / "in"), src.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    out = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert out.count() == src.count() and out.select("batch").distinct().count() == 3
    again = src.limit(5).withColumn("landed_at", F.col("landed_at") + F.expr("interval 1 day"))
    again.write.mode("append").parquet(str(tmp_path / "in"))
    refresh.refresh(refresh.landed(spark, str(tmp_path / "in"), src.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    now = refresh.refreshed(spark, str(tmp_path / "out"))
    assert now.count() == src.count() and now.join(again, ["showtime_id", "landed_at"]).count() == 5
