import pytest
from pyspark.sql import functions as F

from marquee.functions import classify, links, temporal, text


def values(spark, f, xs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_transliterate(spark):
    assert values(spark, text.transliterate, ["Приča o игračkama", "PAMĆENJE", "Đorđe", "Љубав", "Crème brûlée", None, ""]) == ["Prica o igrackama", "PAMCENJE", "Djordje", "Ljubav", "Creme brulee", None, ""]


def test_serbian_latin(spark):
    xs = ["Научна фантастика", "ЉУБАВ", "Његош", "ЊЕГОШ", "Љ", "Џунгла ЏЏ", "Đak", None]
    got = values(spark, text.serbian_latin, xs)
    assert got == ["Naučna fantastika", "LJUBAV", "Njegoš", "NJEGOŠ", "Lj", "Džungla DŽDž", "Đak", None]
    assert values(spark, text.serbian_latin, got) == got


def test_clean_and_tidy(spark):
    xs = ["Malci i monstrumi 3D (sinhronizovano)", "PRICA-O-IGRACKAMA-5-3D", "Odiseja  DS", "Šov film - pretpremijera", "Spider_Man: novi dan (2026)", "a" * 400, "", None]
    assert values(spark, text.clean_title, xs) == ["Malci i monstrumi", "PRICA O IGRACKAMA 5", "Odiseja", "Š film", "Spider Man: novi dan (2026)", "a" * 300, "", None]
    assert values(spark, text.tidy_title, ["Spider-Man : Novi dan IMAX", "  X-Men -"]) == ["Spider-Man: Novi dan", "X-Men"]


def test_normalize_meets_spellings(spark):
    a = values(spark, text.normalize_title, ["ПРИЧА О ИГРАЧКАМА 5", "Pas & mačka", "The Odyssey"])
    b = values(spark, text.normalize_title, ["Priča o igračkama 5 3D", "Pas i macka", "Odyssey (OV)"])
    assert a == b == ["prica o igrackama 5", "pas i macka", "odyssey"]


def test_cleaning_is_fast_on_hostile_titles(spark):
    import time

    t = time.time()
    values(spark, text.clean_title, ["(" * 40_000 + "Film 3D"] * 5)
    assert time.time() - t < 20


def test_dice_properties(spark):
    pairs = [("odiseja", "opsesija", 4 / 13), ("a", "a", 1.0), ("a", "b", 0.0), ("", "x", 0.0), ("ab c", "abc", 1.0), ("aaaa", "aaa", 0.8)]
    rows = spark.createDataFrame(pairs, "a string, b string, w double")
    d = lambda a, b: text.dice(F.col(a), F.col(b), text.bigrams(F.col(a)), text.bigrams(F.col(b)))
    for r in rows.select("w", d("a", "b").alias("x"), d("b", "a").alias("y")).collect():
        assert r["x"] == pytest.approx(r["y"]) == pytest.approx(r["w"])


def test_detect(spark):
    xs = ["Film (sinhronizovano)", "SINH", "titlovano", "OV", "Šov program", "", None, "na srpskom jeziku"]
    assert values(spark, classify.detect_audio, xs) == ["dubbed", "dubbed", "subtitled", "subtitled", "unknown", "unknown", "unknown", "dubbed"]
    assert values(spark, classify.detect_format, ["4DX 3D", "imax", "Screen X", "goldclass", "VIP sala", "3d", "", None]) == ["4DX", "IMAX", "ScreenX", "Gold", "VIP", "3D", "2D", "2D"]


def test_codes(spark):
    xs = ["4DX/3D/TITL", "KIDS/SINH", "3D/OV", "IMAX", "", "GOLD SINK"]
    assert values(spark, classify.format_of_code, xs) == ["4DX 3D", "2D", "3D", "IMAX", "2D", "Gold"]
    assert values(spark, classify.audio_of_code, xs) == ["subtitled", "dubbed", "subtitled", "unknown", "unknown", "dubbed"]


def test_age_labels(spark):
    assert values(spark, lambda c: classify.age_of_label("US", c), ["PG-13", "NR", "R", " g ", "16+", "BEZ", "?", None]) == [13, None, 17, 0, 16, 0, None, None]
    rows = spark.createDataFrame([(1, {"US": "R", "HR": "N12"}, ["Drama"], False), (2, {}, ["Dečji", "Horor"], False), (3, None, ["Animirani"], False), (4, {"US": "G"}, None, True), (5, {"DE": "x"}, None, None)], "i int, c map<string,string>, g array<string>, a boolean")
    age, src, sure = classify.age_rating(F.col("a"), F.col("c"), F.col("g"), F.lit(True))
    assert [tuple(r) for r in rows.select("i", age, src, sure).orderBy("i").collect()] == [(1, 12, "HR", True), (2, 16, "heuristic", False), (3, 0, "heuristic", False), (4, 18, "US", True), (5, None, None, None)]


def test_minutes(spark):
    rows = spark.createDataFrame([(x,) for x in (89, 90, 119, 120, 185, None)], "m int").select(classify.runtime_bucket(F.col("m")), classify.format_runtime(F.col("m"))).collect()
    assert [r[0] for r in rows] == ["short", "medium", "medium", "long", "long", None]
    assert [r[1] for r in rows][:5] == ["1 h 29 min", "1 h 30 min", "1 h 59 min", "2 h 0 min", "3 h 5 min"]
    p = spark.range(0, 130).select(classify.plural(F.col("id"), "a", "b", "c").alias("p")).collect()
    assert [p[i][0] for i in (0, 1, 2, 5, 11, 12, 21, 22, 101, 111, 112, 124)] == ["c", "a", "b", "c", "c", "c", "a", "b", "a", "c", "c", "b"]


def test_times(spark):
    assert values(spark, temporal.normalize_time, ["9:05", "09.05", "9h05", "u 20.15", "25:00", "x", "", None]) == ["09:05", "09:05", "09:05", "20:15", None, None, None, None]
    assert values(spark, temporal.minutes_of, ["09:05", "9:05", "xx:yy"]) == [545, -1, -1]
    days = F.array(*[F.lit(x) for x in ("2026-12-30", "2026-12-31", "2027-01-01")])
    assert values(spark, lambda c: temporal.resolve_date(c, days), ["petak 1.1.", "31.12.", "15.6.", "", None]) == ["2027-01-01", "2026-12-31", None, None, None]


def test_local_time_across_changes(spark):
    rows = spark.createDataFrame([("2026-03-29 00:59:00",), ("2026-03-29 01:00:00",), ("2026-10-25 00:30:00",), ("2026-10-25 01:30:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert [r[0] for r in rows.select(temporal.local_time(F.col("t"))).collect()] == ["01:59", "03:00", "02:30", "02:30"]


def test_day_labels(spark):
    rows = spark.createDataFrame([("2026-08-19",), ("2026-08-20",), ("2026-08-21",)], "d string").select(F.col("d").cast("date").alias("d"))
    t = F.lit("2026-08-19").cast("date")
    assert [tuple(r) for r in rows.select(temporal.day_label(F.col("d"), t), temporal.day_short(F.col("d"), t)).collect()] == [("danas", "danas 19.8."), ("sutra", "sutra 20.8."), ("petak, 21. avgust", "pet 21.8.")]


def test_safe_url(spark):
    good = ["https://a.b/c", "http://x.y", "mailto:a@b.c", "/path?q=1", "page.html"]
    bad = ["javascript:alert(1)", "jav\tascript:alert(1)", "//evil.example", "data:text/html,x", "", "ftp://x.y", None, "https://"]
    assert values(spark, links.safe_url, good) == good
    assert values(spark, links.safe_url, bad) == [None] * len(bad)


def test_origins(spark):
    f = links.on_origin("https://a.example/x/", ("https://a.example", "https://t.a.example"), ("t.a.example",))
    assert values(spark, f, ["/film/1", "http://t.a.example/s", "https://evil.example/", "javascript:1", "y", None]) == ["https://a.example/film/1", "https://t.a.example/s", None, None, "https://a.example/x/y", None]


def test_component_as_browsers_do(spark):
    from urllib.parse import quote

    xs = ["Šta ima? (2) & ~več*'!", "a b+c", "ёж", ""]
    assert values(spark, links.component, xs) == [quote(x, safe="!'()*~-_.") for x in xs]


def test_trailer_link(spark):
    rows = spark.createDataFrame([("Film", "Movie", None), ("Film", "Film", ""), ("Film", None, "k-1")], "t string, o string, k string")
    url, exact = links.trailer_link(F.col("t"), F.col("o"), F.col("k"))
    assert [tuple(r) for r in rows.select(url, exact).collect()] == [(links.SEARCH + "Film%20Movie%20trailer%20srpski", False), (links.SEARCH + "Film%20trailer%20srpski", False), (links.WATCH + "k-1", True)]
