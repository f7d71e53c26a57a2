import random

from marquee.llm import components as C


def find_all(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return find, parent


def check(spark, edges):
    got = {r["v"]: r["root"] for r in C.contract(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    find, parent = find_all(real)
    vs = {v for e in real for v in e}
    assert set(got) == vs
    for a in vs:
        for b in vs:
            if len(vs) < 80:
                assert (got[a] == got[b]) == (find(a) == find(b))
    assert len({got[v] for v in vs}) == len({find(v) for v in vs})


def test_random_graphs(spark):
    rnd = random.Random(8)
    check(spark, [(rnd.randrange(70), rnd.randrange(70)) for _ in range(50)])


def test_chain_star_and_dirt(spark):
    check(spark, [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5), (None, 3), (4, None), (1, 0), (0, 1)])


def test_empty(spark):
    assert C.contract(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


GROUPS = "group_no bigint, normalized_keys array<string>, key string, root string, row int, id int"
MATCH = "left_key string, right_key string, a int"


def rows(spark, groups, matches):
    out = C.group_rows(spark.createDataFrame([(n, k, "x", "y", 1, 2) for n, k in groups], GROUPS), spark.createDataFrame([(a, b, 1) for a, b in matches], MATCH))
    return {r["group_no"]: (r["root_no"], r["several"]) for r in out.collect()}


def test_rows_and_keys(spark):
    got = rows(spark, [(5, ["a", "b"]), (3, ["b"]), (9, ["c", None]), (7, ["e"]), (1, None), (2, []), (8, [""]), (6, [""]), (4, ["z"]), (4, ["z"])], [("a", "x1"), ("x1", "c"), ("x1", "c"), ("c", "x1"), ("e", "e"), (None, "e"), ("e", "nobody")])
    assert got == {5: (3, True), 3: (3, True), 9: (3, True), 7: (7, False), 8: (6, True), 6: (6, True), 4: (4, False)}


def test_empty_tables(spark):
    assert rows(spark, [], []) == {}
    assert rows(spark, [(1, ["a"]), (2, ["a"])], []) == {1: (1, True), 2: (1, True)}
