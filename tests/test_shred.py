import json

from pyspark.sql import functions as F

from marquee.operators import shred
from marquee.plans import general


def brute_days(landing_id, body):
    """The sessions and technologies of one day document, told apart by hand."""
    try:
        x = json.loads(body)
        while isinstance(x, str):
            x = json.loads(x)
    except (TypeError, ValueError):
        return []
    out = []
    for day in x if isinstance(x, list) else [x]:
        s = day.get("sessions")
        s = json.loads(s) if isinstance(s, str) else s
        for i, e in enumerate(s if isinstance(s, list) else [] if s is None else [s]):
            if e is None:
                continue
            if e.get("id") is not None:
                out.append((landing_id, "session", i, 0, 0, str(e["id"])))
            t = e.get("technologies")
            t = [[t]] if isinstance(t, str) else t or []
            if t and not any(isinstance(g, list) for g in t):
                t = [t]
            for j, g in enumerate(t):
                for k, v in enumerate(g or []):
                    if v is not None:
                        out.append((landing_id, "technology", i, j, k, v))
    return out


def test_days_equal_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/api_session_day.parquet").select("landing_id", "body").collect()
    want = sorted(x for r in rows for x in brute_days(r[0], r[1]))
    got = sorted(tuple(r) for r in general.p3_found(spark, small).where("child in ('session', 'technology')").collect())
    assert got == want and len(set(got)) == len(got)


BODIES = [
    {"id": 1, "release_dates": {"results": [{"iso_3166_1": "RS", "release_dates": [{"certification": "12"}, {}, None]}, {"iso_3166_1": "HR", "release_dates": {"certification": ""}}]}, "videos": {"results": [None, {"key": "a"}, {"site": "x"}]}},
    {"id": 2, "release_dates": [{"iso_3166_1": "DE", "release_dates": None}], "videos": []},
    {"id": 3, "videos": {"key": "solo"}, "release_dates": {}},
    {"status": 34},
]
WANT = {(0, "release_date", 0, 0, 0, "RS:12"), (0, "release_date", 0, 1, 0, "RS:"), (0, "release_date", 1, 0, 0, "HR:"), (0, "video", 1, 0, 0, "a"), (2, "video", 0, 0, 0, "solo")}


def details(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "landing_id bigint, body string")
    out = shred.flatten(df, "landing_id", "body", ["release_dates.release_dates", "videos"], general.DETAIL_LEVELS, inherit=True)
    at = lambda r, i: r["own"][i] if i < len(r["own"]) else 0
    found = set()
    for r in out.collect():
        leaf = r["columns"].get("key") if r["element"] == "videos" else f"{r['columns'].get('release_dates/iso_3166_1', '')}:{r['columns'].get('certification', '')}"
        if leaf is not None:
            found.add((r["record"], "video" if r["element"] == "videos" else "release_date", at(r, 0), at(r, 1), at(r, 2), leaf))
    return found


def test_wrapping_changes_nothing(spark):
    plain = [json.dumps(b) for b in BODIES]
    assert details(spark, plain) == WANT
    assert details(spark, [json.dumps(p) for p in plain]) == WANT
    assert details(spark, [f"[{p}]" for p in plain]) == WANT
    assert details(spark, ["﻿ " + json.dumps(b, indent=2, ensure_ascii=False) for b in BODIES]) == WANT
    inner = [json.dumps({k: json.dumps(v) if k in ("videos", "release_dates") else v for k, v in b.items()}) for b in BODIES]
    assert details(spark, inner) == WANT


def test_broken_null_and_empty(spark):
    assert details(spark, [None, "", "{", '{"videos": {"results": [{"key": "a"', "<html>", "null", "[]", "5"]) == set()
    assert details(spark, []) == set()


def test_repeated_rows_and_clashing_columns(spark):
    body = json.dumps(BODIES[0])
    df = spark.createDataFrame([(7, body, "x", "y")] * 2, "landing_id bigint, body string, record string, element string")
    n = shred.flatten(df, "landing_id", "body", ["videos"], general.DETAIL_LEVELS).count()
    assert n == 2 * 2


def tables_of(spark, *docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs, 1)], "k bigint, body string")
    plan = shred.plan_of(df, "body")
    return plan, {n: [r.asDict() for r in t.collect()] for n, t in shred.relations(df, "k", "body").items()}


def test_graph_inlines_singletons_and_links_parents(spark):
    doc = {"id": 5, "owner": {"name": "A", "city": {"zip": "1"}}, "parts": [{"no": 1, "size": {"w": 2.5}, "tags": ["x", "y"]}, {"no": 2, "tags": []}]}
    plan, t = tables_of(spark, doc)
    assert plan.tables["$"].columns == {"id": "bigint", "owner.city.zip": "string", "owner.name": "string"}
    assert plan.tables["parts"].parents == {"$"} and plan.tables["parts"].columns == {"no": "bigint", "size.w": "double"}
    assert plan.tables["parts.tags"].parents == {"parts"} and plan.tables["parts.tags"].scalar == "string"
    assert [(r["_key"], r["_parent_key"], r["_own"], r["_value"]) for r in t["parts.tags"]] == [("/parts/0/tags/0", "/parts/0", [0, 0], "x"), ("/parts/0/tags/1", "/parts/0", [0, 1], "y")]
    assert [(r["_key"], r["no"], r["size.w"]) for r in t["parts"]] == [("/parts/0", 1, 2.5), ("/parts/1", 2, None)]


def test_every_child_has_its_parent(spark, small):
    """Foreign keys of all tables of both record types lead to a row of the parent's table."""
    for name in ("api_session_day", "details_response"):
        tables = shred.relations(spark.read.parquet(f"{small}/{name}.parquet"), "landing_id", "body")
        keys = {n: {(r["_record"], r["_key"]) for r in t.select("_record", "_key").collect()} for n, t in tables.items()}
        assert len(tables) > 2
        for t in tables.values():
            assert all(r["_parent"] is None or (r["_record"], r["_parent_key"]) in keys[r["_parent"]] for r in t.select("_record", "_parent", "_parent_key").collect())


def test_nothing_is_lost(spark):
    """Keys with dots, keys named like wrappers, objects and scalars in one place, empty keys."""
    plan, t = tables_of(spark, {"o": {"value": {"k": 1}}, "a.b": 5, "c": {"addr": {"c": 1}}, "": "e", "m": 7}, {"m": {"n": 8}, "data": "d"})
    one, two = sorted(t["$"], key=lambda r: r["_record"])
    assert (one["o.value.k"], one['"a.b"'], one["c.addr.c"], one['""'], one["m.$"], one["m.n"]) == (1, 5, 1, "e", 7, None)
    assert (two["m.n"], two["data"]) == (8, "d")


def test_shared_elements_have_one_table(spark):
    plan, t = tables_of(spark, {"b": {"addr": {"street": "s", "no": 1}}, "c": {"addr": {"street": "t", "no": 2}}, "d": 1})
    assert plan.tables["addr"].why == "shared"
    assert sorted((r["_parent"], r["_parent_key"], r["_key"], r["street"], r["no"]) for r in t["addr"]) == [("$", "", "/b/addr", "s", 1), ("$", "", "/c/addr", "t", 2)]


def test_recursive_elements_have_one_table(spark):
    tree = {"name": "r", "node": {"name": "a", "kids": [{"name": "b", "kids": [{"name": "c", "kids": []}]}, {"name": "d", "kids": None}]}}
    plan, t = tables_of(spark, tree)
    table = next(n for n, e in plan.tables.items() if e.why == "recursive")
    assert sorted(r["name"] for r in t[table]) == ["b", "c", "d"] or sorted(r["name"] for r in t[table]) == ["a", "b", "c", "d"]
    assert len(plan.tables) <= 3
    assert {r["name"]: r["_parent_key"] for r in t[table]}["c"] == next(r["_key"] for r in t[table] if r["name"] == "b")


def test_deep_recursion_keeps_every_level(spark):
    doc = {"name": "a", "child": None}
    for i in range(200):
        doc = {"name": f"n{i}", "child": doc}
    plan, t = tables_of(spark, doc)
    assert sorted(r["name"] for rows in t.values() for r in rows if r.get("name")) == sorted(["a", *(f"n{i}" for i in range(200))])
    assert len(plan.tables) <= 2


def test_many_encodings_are_opened(spark):
    body = json.dumps({"videos": {"results": [{"key": "a"}]}})
    for _ in range(12):
        body = json.dumps(body)
        if len(body) > 100_000:
            break
    assert details(spark, [body]) == {(0, "video", 0, 0, 0, "a")}
    df = spark.createDataFrame([(1, "{}")], "k bigint, body string")
    assert shred.schema_graph(df.withColumn("body", F.lit(None).cast("string")), "body").count() == 0


def test_objects_around_records_and_lists(spark):
    """Wrappers follow from the structure, whatever their names."""
    plain = {"date": "d", "items": [{"id": 1, "x": "a"}, {"id": 2, "x": "b"}]}
    _, t = tables_of(spark, plain, {"envelope": plain}, [plain, plain], {"date": "d", "items": {"inside": plain["items"]}}, {"date": "d", "items": plain["items"][0]})
    assert sorted((r["_record"], r["id"], r["_own"][0]) for r in t["items"]) == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 1, 0), (3, 2, 1), (3, 2, 1), (4, 1, 0), (4, 2, 1), (5, 1, 0)]
