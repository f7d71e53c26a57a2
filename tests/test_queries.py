import pytest

from marquee.plans import catalogue
from tests.oracle import same

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    same(spark, small, catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_prune_and_broadcast(spark, small):
    plan = catalogue.queries()["q_day_city_counts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    scan = next(x for x in plan.split("\n") if "showtime.parquet" in x)
    assert "booking_url" not in scan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["q_tz_local", "q_union_fallback", "q_streak", "q_source_notices", "q_stream_counts", "q_facets_all"])
def test_session_zone_does_not_matter(spark, small, name):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        same(spark, small, catalogue.queries()[name], SQL[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_programme_broadcasts_venues_only(spark, small, monkeypatch):
    """Of all its steps, the maps of contraction too: what grows with the listings, films or screenings is merged; rows of ranges are counts."""
    from marquee.operators import contraction, publish, resolve, similarity
    from marquee.plans import assembly

    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (contraction, publish, resolve, similarity, assembly):
        written = module.checkpointed
        monkeypatch.setattr(module, "checkpointed", lambda df, written=written: (plan(df), written(df))[1])
    plan(catalogue.queries()["q_programme"](spark, small))
    joins = [x for p in plans for x in p.split("\n") if "BroadcastHashJoin" in x]
    assert len(plans) > 15 and any("SortMergeJoin" in p for p in plans)
    assert [x for x in joins if "[cinema_id#" not in x and "[_part#" not in x] == []


def test_dice_pairs_run_without_broadcasts(spark, tmp_path, monkeypatch):
    """Of the plans that ran: adaptive execution turns a join without a hint into a broadcast where its tables turn out small."""
    from marquee.operators import similarity

    plans = []
    ran = lambda df: (df.collect(), plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]))
    written = similarity.checkpointed
    monkeypatch.setattr(similarity, "checkpointed", lambda df: (ran(df), written(df))[1])
    spark.createDataFrame([("Velika trka",), ("Velika trkaa",), ("Velikatrka",), ("Mala sirena",)], "title string").write.parquet(f"{tmp_path}/title_dim.parquet")
    df = catalogue.queries()["q_dice_pairs"](spark, str(tmp_path))
    ran(df)
    assert len(plans) == 4 and all("isFinalPlan=true" in p for p in plans)
    assert "SortMergeJoin [x#" in plans[-1] and "Broadcast" not in "".join(plans)
    assert {(r["a"], r["b"]) for r in df.collect()} == {("velika trka", "velika trkaa"), ("velika trka", "velikatrka"), ("velika trkaa", "velikatrka")}
