import datetime as dt

from marquee.llm import survivors as V
from tests.oracle import same

SCHEMA = "listing_id bigint, cinema_id string, raw_title string, original_title string, runtime_minutes int, poster_url string, synopsis string, distributor_code string, fetched_at timestamp, trust_rank int, field string, value string"
P = "https://a.example/posteri/0a1b2c3d4e5f.jpg"


def row(i, code="D", cinema="v1", raw="Naslov dela", original="Title of Work", minutes=100, poster=P, synopsis="opis", at=1, extra=99):
    return (i, cinema, raw, original, minutes, poster, synopsis, code, dt.datetime(2026, 1, at), extra, "raw_title", "x")


def picks(spark, rows, venues=(("v1", 1), ("v2", 2))):
    out = V.representatives(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(venues), "cinema_id string, trust_rank int"))
    return sorted((r["distributor_code"], r["field"], r["listing_id"]) for r in out.collect())


def one(spark, rows, field="raw_title"):
    return [i for _, f, i in picks(spark, rows) if f == field]


def test_trust_then_recency_then_id(spark):
    assert one(spark, [row(1, cinema="v2", at=9), row(2, at=1), row(3, at=2)]) == [3]
    assert one(spark, [row(5, at=2), row(4, at=2), row(6, cinema="none", at=9)]) == [4]


def test_unusable_values(spark):
    for bad in (None, "", "  ", "TBA", "[naslov]", "---", "???", "n/a", "Film bez naslova", "Ostrvo...", "Za�to", "NoÄ‡ veÅ¡tica", "Žanr: komedija", "ŽANR: komedija", "Trajanje: 98 min", "opis", "Noc?enje"):
        assert one(spark, [row(1, raw=bad), row(2, cinema="v2")]) == [2], bad
    for good in ("ФИЛМ", "film 3D (sinh)", "Vuk​ovi", "MISSPELT", "A", "1917"):
        assert one(spark, [row(1, raw=good), row(2, cinema="v2")]) == [1], good
    for bad in (None, "", "N/A", "undefined", "/img/", "https://", "javascript:;", "https://a.example/img/default_poster.webp", "https://a.example/p/blank.gif", "https://a.example/assets/poster-uskoro.svg", "data:image/gif;base64,R0lG", "placeholder.jpg"):
        assert one(spark, [row(1, poster=bad), row(2, cinema="v2")], "poster_url") == [2], bad
    for bad in (None, 0, -95, 1, 9, 600, 1440):
        assert one(spark, [row(1, minutes=bad), row(2, cinema="v2")], "runtime_minutes") == [2], bad


def test_groups(spark):
    assert picks(spark, [row(1)]) == []
    assert picks(spark, [row(1), row(1)]) == []  # one listing that came twice
    assert picks(spark, [row(1, code=None), row(2, code=None)]) == []
    assert [x[1] for x in picks(spark, [row(1, raw=None), row(2, raw="-")])] == ["original_title", "poster_url", "runtime_minutes"]
    assert picks(spark, []) == []
    assert len(picks(spark, [row(i, raw="x" * 100_000) for i in (1, 2)])) == 4


def test_surviving_record(spark):
    df = spark.createDataFrame([row(1, raw=None, minutes=90), row(2, cinema="v2", raw="B")], SCHEMA)
    r = V.surviving_records(df, spark.createDataFrame([("v1", 1), ("v2", 2)], "cinema_id string, trust_rank int")).collect()
    assert [(x["raw_title"], x["raw_title_from"], x["runtime_minutes"], x["runtime_minutes_from"]) for x in r] == [("B", 2, "90", 1)]


def test_hot_group_is_pruned_before_the_shuffle(spark, small):
    df = V.representatives(spark.read.parquet(f"{small}/listing.parquet"), spark.read.parquet(f"{small}/dim_venue.parquet"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_equals_sql(spark, small):
    from marquee.llm import queries, sql

    for name, text in sql.oracle_sql().items():
        same(spark, small, queries.queries()[name], text)
