import itertools
import random

from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import enrich, merge, resolve, similarity


def brute_dice(a, b):
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if not a or not b:
        return 0.0
    if x == y:
        return 1.0
    ga, gb = [x[i : i + 2] for i in range(len(x) - 1)], [y[i : i + 2] for i in range(len(y) - 1)]
    if not ga and not gb:
        return 0.0
    n, rest = 0, list(gb)
    for g in ga:
        if g in rest:
            rest.remove(g)
            n += 1
    return 2 * n / (len(ga) + len(gb))


def test_similarity_join_equals_brute_force(spark):
    rnd = random.Random(5)
    keys = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 12))).strip() for _ in range(150)} - {""})
    df = spark.createDataFrame([(k,) for k in keys] + [(None,), ("",), (keys[0],)], "key string")
    for t in (0.62, 0.82):
        got = {(r["a"], r["b"]): round(r["score"], 9) for r in similarity.similar_pairs(df, threshold=t).collect()}
        want = {(a, b): round(brute_dice(a, b), 9) for a, b in itertools.combinations(keys, 2) if brute_dice(a, b) >= t}
        assert got == want


def test_similarity_join_of_empty_tables(spark):
    none = spark.createDataFrame([], "key string")
    assert similarity.similar_pairs(none).count() == 0
    assert similarity.similar_pairs(none, spark.createDataFrame([("a",)], "key string")).count() == 0


def brute_groups(rows):
    return resolve.fold(rows, {(a, b) for a in {k for _, ks, _ in rows for k in ks} for b in {k for _, ks, _ in rows for k in ks} if a != b and brute_dice(a, b) >= 0.82})


def listings(spark, titles, ids=None):
    rows = [(i, 0, i, t, t) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "listing_id bigint, venue_ord int, listing_ord int, raw_title string, clean_title string")


def test_greedy_groups_equal_replay(spark):
    rnd = random.Random(3)
    base = ["velika trka", "mala sirena", "povratak kuci", "tri musketara"]
    titles = []
    for _ in range(60):
        t = list(rnd.choice(base))
        if rnd.random() < 0.7:
            t[rnd.randrange(len(t))] = rnd.choice("abcde")
        titles.append("".join(t))
    titles += ["", None, titles[0]]
    df = listings(spark, titles)
    got = {r["listing_id"]: r["entity"] for r in resolve.group_listings(df).collect()}
    keys = {r["listing_id"]: list(r["keys"]) for r in resolve.title_keys(df).collect()}
    rows = [(i, keys[i], None) for i in range(len(titles)) if keys[i]]
    want = {rows[k][0]: rows[g][0] for k, g in enumerate(brute_groups(rows))}
    assert {k: v for k, v in got.items() if k in want} == want
    assert got[60] == 60 and got[61] == 61


def test_fold_with_external_ids():
    near = {("a", "b")}
    assert resolve.fold([(1, ["a"], None), (2, ["b"], 7), (3, ["z"], 7), (4, ["b"], 8), (5, ["a"], None)], near) == [0, 0, 0, 3, 0]
    # two groups that exist are never merged by a later row
    assert resolve.fold([(1, ["a"], 1), (2, ["b"], 2), (3, ["a", "b"], None)], near) == [0, 1, 0]


def test_components_match_union_find(spark):
    rnd = random.Random(1)
    edges = [(f"k{rnd.randrange(60)}", f"k{rnd.randrange(60)}") for _ in range(45)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["v"]: r["root"] for r in resolve.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    sets = lambda m: {frozenset(v for v in m if m[v] == r) for r in m.values()}
    assert sets(got) == sets({v: find(v) for v in {x for e in edges for x in e}})


def test_merge_picks_by_trust_and_order(spark):
    schema = "listing_id bigint, venue_ord int, listing_ord int, cinema_id string, raw_title string, clean_title string, original_title string, poster_url string, synopsis string, runtime_minutes int, genres array<string>, origin_country string, g string, trust_rank int"
    rows = [
        (1, 0, 0, "v2", "MALCI I MONSTRUMI 3D", "MALCI", "Minions", "", "", 0, ["a", None], None, "x", 9),
        (2, 1, 0, "v1", "Malci i monstrumi", None, "Malci i monstrumi", "p1", None, None, ["b", "a"], "SRB", "x", 9),
        (3, 2, 0, "v3", "Malci", None, None, "p3", "opis", 91, None, None, "x", 9),
        (4, 3, 0, "v3", None, None, None, None, None, None, None, None, None, None),
    ]
    venue = spark.createDataFrame([("v1", 1), ("v2", 2)], "cinema_id string, trust_rank int")
    r = merge.merge_records(spark.createDataFrame(rows, schema), "g", venue).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["title"], r["original_title"], r["poster_url"], r["runtime_minutes"], r["synopsis"], r["domestic"], r["cinemas"], r["genres"]) == ("Malci i monstrumi", "Minions", "p1", 91, "opis", True, 3, ["a", "b"])


def test_display_title_order(spark):
    f = lambda xs: spark.createDataFrame([(xs,)], "x array<string>").select(merge.display_title(F.col("x"))).collect()[0][0]
    assert f(["MALCI", "Malci i svi"]) == "Malci i svi"
    assert f(["Malci i svi", "Malci"]) == "Malci i svi"
    assert f(["Malci i svi", "Malci svi"]) == "Malci svi"
    assert f([]) == "Nepoznat film"
    assert f(["123", "45"]) == "45"


def test_enrich_override_and_early_stop(spark):
    cand = spark.createDataFrame([("k", 1, 0, 5, 0.7), ("k", 1, 1, 6, 0.92), ("k", 2, 0, 7, 0.99), ("l", 1, 0, 8, 0.5), ("m", 1, 0, 9, 0.8), ("m", 1, 1, 4, 0.8)], "key string, query_ord int, cand_ord int, id bigint, score double")
    look = spark.createDataFrame([("k",), ("l",), ("m",), ("film",)], "key string")
    over = spark.createDataFrame([(1, "Film", 100), (2, "FILM 3D", 101)], "ord int, raw_title string, id bigint")
    got = {r["key"]: r["id"] for r in enrich.resolve(look, cand, over).collect()}
    assert got == {"k": 6, "m": 9, "film": 101}


def test_partitioning_does_not_matter(spark, small):
    from marquee.plans import catalogue
    from marquee.session import table

    df = table(spark, small, "listing")
    one = {tuple(r) for r in resolve.group_listings(df.coalesce(1)).collect()}
    assert one == {tuple(r) for r in resolve.group_listings(df.repartition(7)).collect()}
    assert "q_entity_groups" in catalogue.queries()
    assert text.CAP == 300


def test_fold_equals_a_plain_replay():
    """The indexed replay gives the groups of the plain one: by id, by adoption, by the first similar group."""
    rnd = random.Random(7)
    for _ in range(200):
        names = [f"k{i}" for i in range(8)]
        similar = {(a, b) for a in names for b in names if a < b and rnd.random() < 0.15}
        rows = [(i, rnd.sample(names, rnd.randint(0, 2)), rnd.choice([None, None, 1, 2, 3])) for i in range(12)]
        alike = lambda x, y: x == y or (x, y) in similar or (y, x) in similar  # noqa: B023, E731
        groups, want = [], []
        for i, keys, ext in rows:
            fits = [g for g in groups if any(alike(k, x) for k in keys for x in g["keys"])]
            found = next((g for g in groups if ext is not None and g["ext"] == ext), None) or next((g for g in fits if ext is None or g["ext"] is None), None)
            if found is None:
                found = {"keys": set(), "ext": None, "first": i}
                groups.append(found)
            found["ext"] = found["ext"] if found["ext"] is not None else ext
            found["keys"] |= set(keys)
            want.append(found["first"])
        assert resolve.fold(rows, similar) == want


def test_lists_of_keys_that_meet_are_not_broadcast(spark):
    """Keys times their pairs of bigrams are far more than the table of keys, whose size is all that the planner knows."""
    a, b = (spark.createDataFrame([(f"{w} {i}",) for i in range(20)], "key string") for w in ("velika trka", "velika trkaa"))
    for right in (None, b):
        df = similarity.similar_pairs(a, right, 0.62)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [x#" in plan and "BroadcastHashJoin [x#" not in plan
        assert df.count() > 0


def test_groups_are_joined_without_broadcasts_of_listings(spark):
    df = resolve.group_listings(listings(spark, ["velika trka", "velika trkaa", "mala sirena", ""]))
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["listing_id"]: r["entity"] for r in df.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_similar_pairs_are_found_without_any_broadcast(spark, monkeypatch):
    """Keys, their numbers and their sets of bigrams are as many as the titles, in every step."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    written = similarity.checkpointed
    monkeypatch.setattr(similarity, "checkpointed", lambda df: (plan(df), written(df))[1])
    df = similarity.similar_pairs(spark.createDataFrame([("velika trka",), ("velika trkaa",), ("velikatrka",)], "key string"))
    plan(df)
    assert len(plans) == 4 and "BroadcastExchange" not in "".join(plans)
    assert {(r["a"], r["b"]) for r in df.collect()} == {("velika trka", "velika trkaa"), ("velika trka", "velikatrka"), ("velika trkaa", "velikatrka")}
