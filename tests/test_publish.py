import pytest
from pyspark.sql import functions as F

from marquee.functions import extract
from marquee.operators import enrich, publish


def one(spark, f, x):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).collect()[0][0]


def test_extract(spark):
    assert [one(spark, extract.original_title, x) for x in ("The Work | 2026", "Trajanje: 90 min", "x", None, "a" * 121)] == ["The Work", None, None, None, None]
    assert [one(spark, extract.country_code, x) for x in ("srb / fra", "RS", "1", "")] == ["SRB", "RS", None, None]
    assert [one(spark, extract.runtime, x) for x in ("Trajanje: 98 min", "trajanje:15min", "Trajanje: 999 min", None)] == [98, None, None, None]
    assert one(spark, extract.hall, "3D Sala: 5 x") == "5"
    assert one(spark, lambda c: extract.labelled(c, "Žanr"), "žanr: drama | x") == "drama"
    assert one(spark, extract.redacted, "HTTP 500 https://a/b?key=1 z") == "HTTP 500 https://a/b z"
    assert one(spark, lambda c: extract.first_of(c, F.lit(None), F.lit("z")), "") == "z"


def test_days_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01", 1, None), ("2026-01-02", 2, "x")], "date string, n int, s string")
    publish.write_days(df, str(tmp_path / "days"))
    back = spark.read.parquet(str(tmp_path / "days"))
    plan = back.where("date = '2026-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and back.count() == 2
    publish.write_snapshot(df, str(tmp_path / "snap"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "snap")).collect()) == ['{"date":"2026-01-01","n":1}', '{"date":"2026-01-02","n":2,"s":"x"}']


def test_state_and_streaks(spark, tmp_path):
    base, schema = str(tmp_path / "state"), "source string, failures int"
    runs = [[("a", True), ("b", False)], [("a", False), ("b", False)], [("a", False), ("b", True), ("c", False)]]
    seen = []
    for run in runs:
        now = spark.createDataFrame(run, "source string, ok boolean")
        publish.swap_state(publish.next_failures(now, publish.read_state(spark, base, schema)), base)
        seen.append({r["source"]: r["failures"] for r in publish.read_state(spark, base, schema).collect()})
    assert seen == [{"a": 0, "b": 1}, {"a": 1, "b": 2}, {"a": 2, "b": 0, "c": 1}]


def test_recheck_and_joins(spark):
    ranked = spark.createDataFrame([("velika trka", 1, 1), ("velika trka", 2, 2), ("velika trka", 3, 4)], "key string, id bigint, rank int")
    det = spark.createDataFrame([(1, "Nešto drugo", None), (2, "Great Race", "Velika trka"), (3, "Velika trka", None)], "id bigint, title string, original_title string")
    assert [tuple(r) for r in enrich.recheck(ranked, det).collect()] == [("velika trka", 2)]
    s = spark.createDataFrame([("s1", "1"), ("s2", "9"), ("s3", "2")], "sid string, movieId string")
    f = spark.createDataFrame([("1", "Film"), ("2", None)], "id string, title string")
    assert [r["sid"] for r in enrich.sessions_with_films(s, f).collect()] == ["s1"]
    v = spark.createDataFrame([("a", "grad")], "cinema_id string, city_id string")
    assert enrich.venue_or_error(spark.createDataFrame([("a",)], "cinema_id string"), v).collect()[0]["city_id"] == "grad"
    with pytest.raises(Exception, match="unknown venue b"):
        enrich.venue_or_error(spark.createDataFrame([("b",)], "cinema_id string"), v).collect()


def test_pages_keep_every_title_and_screening(spark):
    from marquee.plans import publication
    from marquee.sources import html

    titles = ["Žuti <b>balon</b> & \"more\"", "Вукови - O'Neill &amp; sin", "Plain"]
    rows = [(i * 100 + k, "c", i, t, "1. 6.", "18:00", '3D"<&') for i, t in enumerate(titles) for k in range(50)]
    s = spark.createDataFrame(rows, "showtime_id bigint, cinema_id string, listing_id bigint, clean_title string, date string, time string, format string")
    pages = publication.programme_pages(s, most=1000)
    assert pages.count() > 9
    got = html.parse_pages(pages, most=2000).collect()
    assert {t: sum(r["title"] == t for r in got) for t in titles} == dict.fromkeys(titles, 50) and {r["code"] for r in got} == {'3D"<&'}


def test_numbered_counts_through_all_ranges(spark):
    df = spark.range(0, 5_000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000))).repartition(7)
    got = publish.numbered(df, F.desc("k"), F.col("id")).collect()
    want = sorted(got, key=lambda r: (-r["k"], r["id"]))
    assert [r["position"] for r in want] == list(range(1, 5_001)) and set(got[0].asDict()) == {"id", "k", "position"}
    assert publish.numbered(df.where("false"), F.col("id")).count() == 0


def test_a_version_without_its_mark_does_not_count(spark, tmp_path):
    base, schema = str(tmp_path / "state"), "source string, failures int"
    assert publish.read_state(spark, base, schema).count() == 0
    done = publish.swap_state(spark.createDataFrame([("a", 1)], schema), base)
    half = publish.swap_state(spark.createDataFrame([("a", 9)], schema), base)
    (tmp_path / "state" / half.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert done < half and [tuple(r) for r in publish.read_state(spark, base, schema).collect()] == [("a", 1)]
