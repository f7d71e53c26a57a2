import datetime as dt

import numpy as np

import pytest

from marquee.operators import instants as I
from marquee.plans import general

UTC = dt.timezone.utc


def us(text):
    return int(dt.datetime.fromisoformat(text).astimezone(UTC).timestamp() * 1_000_000)


TIMES = {
    "20.45": (20, 45), "13 : 30": (13, 30), "1125": (11, 25), "14:50:00": (14, 50), "17:10h": (17, 10), "16h30": (16, 30), "18.05 časova": (18, 5), "u 23:00": (23, 0), "3:50 PM": (15, 50), "12:05 AM": (0, 5), "12:00 PM": (12, 0), "0:00h": (0, 0),
}


@pytest.mark.parametrize("text", TIMES)
def test_times(text):
    h, m = TIMES[text]
    assert I.read_time(text) == ((h * 60 + m) * 60 * I.US, None, None)


@pytest.mark.parametrize("text", ["25:10", "24:00", "--:--", "", "po dogovoru", "12:60", "13:00 PM", "uskoro", "x" * 10_000])
def test_no_times(text):
    assert I.read_time(text) is None


@pytest.mark.parametrize("text,day", [("29.03.2026.", "2026-03-29"), ("20260901", "2026-09-01"), ("14.01.26", "2026-01-14"), ("06/04/2026", "2026-04-06"), ("2026.07.10", "2026-07-10"), ("21 .03.2026", "2026-03-21"), ("14. 3. 2026.", "2026-03-14"), ("08-Oct-2026", "2026-10-08"), ("10. okt 2026", "2026-10-10"), ("nedelja, 26. oktobar 2025.", "2025-10-26"), ("недеља, 25. октобар 2026.", "2026-10-25"), ("2026-02-28T00:00:00", "2026-02-28"), (" 2026-05-24 ", "2026-05-24")])
def test_dates(text, day):
    assert I.read_date(text) == (I.D_DAY, (dt.date.fromisoformat(day) - I.EPOCH).days)


@pytest.mark.parametrize("text", ["31.02.2026.", "2026-13-05", "", "uskoro", "datum naknadno", "0.0.2026", "2026-02-30T10:00:00"])
def test_no_dates(text):
    assert I.read_date(text) is None


STAMPS = {
    "2026-07-22T14:10+02:00": "2026-07-22T14:10+02:00", "2026-04-22T16:45:00Z": "2026-04-22T16:45+00:00", "1778952900": "2026-05-16T17:35+00:00", "1778952900000": "2026-05-16T17:35+00:00", "1778952900000000": "2026-05-16T17:35+00:00", "1774785300.0": "2026-03-29T11:55+00:00",
    "/Date(1778966700000+0200)/": "2026-05-16T21:25+00:00", "2026-01-12 18:40 GMT+1": "2026-01-12T18:40+01:00", "20260902T192000Z": "2026-09-02T19:20+00:00", "2026-W31-6T18:30+02:00": "2026-08-01T18:30+02:00", "13.10.2026. 15:35 CEST": "2026-10-13T15:35+02:00", "2026-07-30 10:40:00 +0200": "2026-07-30T10:40+02:00",
    "Sun, 25 Oct 2026 02:15:00 +0200": "2026-10-25T02:15+02:00", "2026-06-19T11:10:00 UTC": "2026-06-19T11:10+00:00", "2026-02-10T06:45:00-03:00": "2026-02-10T06:45-03:00", "2026-04-07T21:30:00.000000000Z": "2026-04-07T21:30+00:00",
    "18/11/2026 17:10:00": "2026-11-18T17:10+01:00", "202603081405": "2026-03-08T14:05+01:00", "22.3.2026. u 16.15h": "2026-03-22T16:15+01:00", "30. oktobar 2025. 23:40": "2025-10-30T23:40+01:00", "19. мај 2026. 10:30": "2026-05-19T10:30+02:00", "Oct 14, 2026 1:05 PM": "2026-10-14T13:05+02:00", "2026-05-16T10:55:00+02:00[Europe/Belgrade]": "2026-05-16T10:55+02:00",
    "2026-03-29T02:30:00": "2026-03-29T03:30+02:00", "2026-10-25T02:30:00": "2026-10-25T02:30+02:00",
}


def test_stamps():
    import pandas as pd

    got = I.stamp_instants(pd.Series(list(STAMPS)), pd.Series([None] * len(STAMPS), dtype=object))
    assert dict(zip(STAMPS, map(int, got))) == {k: us(v) for k, v in STAMPS.items()}


def test_nothing_real():
    import pandas as pd

    bad = pd.Series([None, "", "-", "0", "TBD", "0000-00-00T00:00:00", "2026-02-30T18:00:00+01:00", "9" * 500, "2026-01-01T25:00:00Z"])
    assert set(I.stamp_instants(bad, pd.Series([None] * len(bad), dtype=object))) == {-(1 << 63)}


SHOW = "showtime_id bigint, cinema_id string, date string, time string, fetched_at timestamp, row_id string, zone string"
API = "landing_id bigint, cinema_id string, showtime string, landed_at timestamp, zone int"


def at(text):
    return dt.datetime.fromisoformat(text)


def test_found(spark):
    f = at("2026-06-10T22:30:00+00:00").replace(tzinfo=None)  # the 11th in Belgrade
    rows = [
        (1, "c", "2026-06-12", "20:00", f, "r", "z"), (2, "c", "2026-10-25", "02:30", f, "r", "z"), (3, "c", "danas", "20.00", f, "r", "z"), (4, "c", "SUTRA", "1:05 AM", f, "r", "z"), (5, "c", "18.06.", "20:00", f, "r", "z"),
        (6, "c", "19.06.", "20:00", f, "r", "z"), (7, None, "12.06.2026.", "18:00Z", f, None, None), (8, "c", "2026-06-12T22:00:00Z", "10:00", f, "r", "z"), (9, "c", None, "20:00", f, "r", "z"), (10, "c", "12.06.2026.", None, f, "r", "z"),
        (11, "c", "danas", "20:00", None, "r", "z"), (12, "c", "2026-02-30", "20:00h", f, "r", "z"), (13, "c", "12.06.2026", "20:00 CET", f, "r", "z"), (3, "c", "danas", "20.00", f, "r", "z"),
    ]
    api = [(1, "c", "2026-06-12T20:00:00+02:00", f, 1), (2, "c", "2026-06-12T20:00:00+01:00", f, 1), (3, "c", "2026-10-25T20:00:00+01:00", f, 1), (4, "c", None, f, 1), (5, "c", "2026-06-12T20:00:00", f, 1)]
    out = [tuple(r) for r in I.found(spark.createDataFrame(rows, SHOW), spark.createDataFrame(api, API)).collect()]
    want = {
        2: "2026-10-25T02:30+02:00", 3: "2026-06-11T20:00+02:00", 4: "2026-06-12T01:05+02:00", 5: "2026-06-18T20:00+02:00", 7: "2026-06-12T18:00+00:00", 8: "2026-06-13T10:00+02:00", 13: "2026-06-12T20:00+01:00",
    }
    assert sorted(x for x in out if x[0] == "showtime") == sorted([("showtime", k, us(v)) for k, v in want.items()] + [("showtime", 3, us(want[3]))])
    assert {x[1]: x[2] for x in out if x[0] == "api_session"} == {2: us("2026-06-12T20:00+01:00"), 3: us("2026-10-25T20:00+01:00"), 5: us("2026-06-12T20:00+02:00")}


def test_empty_tables(spark):
    assert I.found(spark.createDataFrame([], SHOW), spark.createDataFrame([], API)).count() == 0


def test_zones_are_estimated_from_ingestion(spark):
    """A source that prints Tokyo days is found out, one that prints Belgrade days and one of few rows stay."""
    import random
    from zoneinfo import ZoneInfo

    rnd, rows = random.Random(2), []
    for source, zone, n in (("a", "Europe/Belgrade", 400), ("b", "Asia/Tokyo", 400), ("few", "Asia/Tokyo", 5)):
        for _ in range(n):
            f = dt.datetime(2026, 5, 1, tzinfo=UTC) + dt.timedelta(minutes=rnd.randrange(100_000))
            day = f.astimezone(ZoneInfo(zone)).date() + dt.timedelta(days=rnd.choice([0, 0, 3, 7, 7]))
            rows.append((source, day, f.replace(tzinfo=None)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "s string, day date, f timestamp")
    zones = I.estimate_zones(I.day_evidence(df, "s", F.col("day"), F.unix_seconds("f"), 7))
    assert [tuple(r) for r in zones.collect()] == [("b", "Asia/Tokyo")]
    held = I.with_zone(df, "s", zones)
    assert {(r["s"], r["zone"]) for r in held.select("s", "zone").distinct().collect()} == {("a", None), ("b", "Asia/Tokyo"), ("few", None)}


def test_zones_are_estimated_from_printed_offsets(spark):
    """Two offsets over a year tell a history with summer time from a fixed one; zones of any name are candidates."""
    from zoneinfo import ZoneInfo

    rows = []
    for source, zone in (("home", "Europe/Belgrade"), ("ny", "America/New_York"), ("cairo", "Africa/Lagos"), ("few", "Asia/Tokyo")):
        for i in range(3 if source == "few" else 365):
            f = dt.datetime(2025, 6, 1, tzinfo=UTC) + dt.timedelta(days=i, hours=3)
            rows.append((source, int(f.timestamp()), int(f.astimezone(ZoneInfo(zone)).utcoffset().total_seconds())))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "s string, at bigint, o int")
    found = {r["source"]: r["zone"] for r in I.estimate_zones(I.offset_evidence(df, "s", F.col("at"), F.col("o"))).collect()}
    assert set(found) == {"ny", "cairo"} and found["ny"] == "America/New_York"
    at = np.array([1_750_000_000, 1_765_000_000])
    assert (I.utc_to_wall(at, found["cairo"]) - at == 3600).all()


def test_session_zone_does_not_matter(spark, small):
    want = sorted(map(tuple, general.p2_found(spark, small).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(tuple, general.p2_found(spark, small).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
