import random

import pytest

from marquee.llm import packing, tokens as T


def test_against_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("Hello, world's  end\n\n x", "Žuti балон 🦉👩‍👧", "<|endoftext|>", "   ", "a" * 3000, "1234567 don't", "\r\n\t x"):
        assert T.encode(text) == t.encode(text, add_special_tokens=False).ids
        assert T.decode(T.encode(text)) == text


def test_pieces_equal_the_whole():
    rnd = random.Random(7)
    parts = ["foo", " ", "  ", "\n", "\n\n", "žuti", "балон", "don't", "12345", "🦉", "...", "a" * 90, " " * 70, "日本語のテキスト"]
    for _ in range(60):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 400)))
        for chunk, overlap in ((64, 16), (100, 40), (16, 4)):
            pieces = T.pieces_of(text, chunk, overlap)
            assert "".join(pieces) == text
            assert sum((T.encode(p) for p in pieces), []) == T.encode(text)


DOCS = "doc_id bigint, text string, ids string, row int"


def test_documents(spark):
    rnd = random.Random(1)
    long = " ".join("".join(rnd.choice("abcdežš") for _ in range(rnd.randint(1, 12))) for _ in range(3000))
    rows = [(1, "kratak"), (2, None), (3, ""), (4, long), (5, "x" * 5000 + " kraj. " * 900), (4, long), (6, " "), (None, "bez broja")]
    got = [(r["doc_id"], r["ids"]) for r in T.encode_documents(spark.createDataFrame([(*r, "i", 1) for r in rows], DOCS), chunk=1000, overlap=100).collect()]
    assert sorted(got, key=str) == sorted([(k, T.encode(t)) for k, t in rows], key=str)
    assert T.encode_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_query_covers_all_documents(spark, small):
    from marquee.llm import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, small).collect()}
    assert got == {k: T.encode(t) for k, t in docs.items()}


def brute_first_fit(sizes, cap):
    free, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
        if k is None:
            k = len(free)
            free.append(cap)
        free[k] -= sizes[i]
        out[i] = k
    return out


def test_tree_equals_first_fit():
    rnd = random.Random(3)
    for _ in range(200):
        cap = rnd.randint(1, 30)
        sizes = [rnd.randint(0, cap) for _ in range(rnd.randint(1, 40))]
        assert packing.first_fit_decreasing(sizes, cap) == brute_first_fit(sizes, cap)


def test_pack(spark):
    sizes = spark.createDataFrame([(i, 7 * i % 60, "k") for i in range(500)] + [(900, 1234, "k"), (901, None, "k"), (901, None, "k"), (None, 5, "k")], "doc_id bigint, tokens int, key string")
    budgets = spark.createDataFrame([(1, 50), (2, 100)], "budget_id int, capacity_tokens int")
    rows = packing.pack(sizes, budgets, group_size=100).collect()
    for b, cap in ((1, 50), (2, 100)):
        mine = [r for r in rows if r["budget_id"] == b]
        used = {}
        for r in mine:
            used[r["pack_group"], r["container"]] = used.get((r["pack_group"], r["container"]), 0) + r["tok_end"] - r["tok_start"]
        assert max(used.values()) <= cap and sum(used.values()) == sum(7 * i % 60 for i in range(500)) + 1234 + 5
        whole = {}
        for r in mine:
            whole.setdefault(r["doc_id"], []).append((r["tok_start"], r["tok_end"]))
        assert sorted(whole[900]) == [(i, min(i + cap, 1234)) for i in range(0, 1234, cap)]
        assert whole[901] == [(0, 0), (0, 0)] and whole[None] == [(0, 5)]
        assert all(len(v) == 1 for k, v in whole.items() if k is not None and k < 500 and 7 * k % 60 <= cap)
        assert sum(used.values()) / (len(used) * cap) > 0.9
    assert {r["budget_id"]: r["filled"] > 0.9 for r in packing.fill(packing.pack(sizes, budgets, group_size=100), budgets).collect()} == {1: True, 2: True}


def test_pack_edges(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, tokens int")
    good = spark.createDataFrame([(1, 50)], "budget_id int, capacity_tokens int")
    assert packing.pack(sizes, good).count() == 0
    assert packing.pack(sizes, good.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sizes, spark.createDataFrame([(1, 0)], "budget_id int, capacity_tokens int"))
