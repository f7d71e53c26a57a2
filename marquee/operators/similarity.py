"""Similarity join of title keys by bigram Dice, as a blocked equi join with exact verification."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.session import checkpointed


def numbered(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """(side, id, key, flat, n, g): distinct non-empty keys with a number, their bigrams as sorted ranks, the rarest first.

    The k-th same bigram of a key is a bigram of its own, so that a multiset is a set.
    """
    key = lambda df, side: df.select(F.col("key")).where("key is not null and key <> ''").distinct().withColumn("side", F.lit(side))
    both = key(left, "a") if right is None else key(left, "a").unionByName(key(right, "b"))
    flat = F.replace("key", F.lit(" "), F.lit(""))
    both = checkpointed(both.withColumn("id", F.monotonically_increasing_id()).withColumn("flat", flat).withColumn("n", F.greatest(F.length("flat") - 1, F.lit(0))))
    at = both.where("n > 0").select("id", "flat", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select("id", F.substring("flat", F.col("i"), F.lit(2)).alias("x"))
    each = checkpointed(at.groupBy("id", "x").agg(F.count("*").alias("c")).select("id", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("k"), "x"))
    freq = each.groupBy("x", "k").agg(F.count("*").alias("f"))
    # as many rows as there are bigrams of the alphabet, each with a small number: one task ranks them
    ranks = freq.select("x", "k", F.row_number().over(W.orderBy("f", "x", "k")).alias("rank"))
    sets = each.hint("merge").join(ranks, ["x", "k"]).groupBy("id").agg(F.array_sort(F.collect_list("rank")).alias("g"))
    return checkpointed(both.hint("merge").join(sets, "id", "left").select("side", "id", "key", "flat", "n", F.coalesce("g", F.array().cast("array<int>")).alias("g")))


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.82) -> DataFrame:
    """(a, b, score) of the pairs of keys with Dice >= threshold; without `right`, pairs a < b within `left`.

    A key of n bigrams shares at least o = ceil(t n / (2-t)) of them with any key that is similar to it, so the first
    two that the keys share, in one global order, are among the n - o + 2 rarest of either. Keys meet in such pairs of
    bigrams, of which there are as many as squares of the alphabet, so the lists of keys that meet in one stay short
    where those of single bigrams would grow with the data. Only very short keys (o = 1) and those that can be
    similar to them meet in single bigrams. A pair of keys counts where it first meets, so it comes out once without
    a shuffle of candidates; what is left there of either bounds what they can share. Keys equal without spaces are
    joined on that. No pair is lost, every candidate is verified with the exact value.
    """
    t = threshold
    share = t / (2 - t)
    keys = numbered(left, right)
    a = keys.where("side = 'a'")
    b = a if right is None else keys.where("side = 'b'")
    few = math.floor(1 / share + 1e-9)  # keys of up to so many bigrams may share only one with a similar one
    short = math.floor(few / share + 1e-9)  # and these have at most so many

    def prefix(df: DataFrame, name: str) -> DataFrame:
        least = F.greatest(F.ceil(F.lit(share) * F.col("n") - 1e-9), F.lit(1))
        rare = lambda more: F.slice("g", F.lit(1), F.least(F.col("n") - least + more, F.col("n")).cast("int"))
        df = df.where("n > 0").withColumns({"p1": rare(1), "p2": rare(2)})
        at = lambda x, i: F.get(x, (i - 1).cast("int"))
        upto = lambda m: F.when(m > 0, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>"))
        entry = lambda x, i: F.struct(x.cast("bigint").alias("x"), i.cast("int").alias("i"))
        twos = F.flatten(F.transform(upto(F.size("p2")), lambda j: F.transform(upto(j - 1), lambda i: entry(F.shiftleft(at(F.col("p2"), i).cast("bigint") + 1, 32) + at(F.col("p2"), j), j))))
        ones = F.when(F.col("n") <= short, F.transform(upto(F.size("p1")), lambda i: entry(at(F.col("p1"), i), i))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
        return df.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("g").alias(f"g_{name}"), F.explode(F.concat(twos, ones)).alias("e")).select(name, f"n_{name}", f"g_{name}", F.col("e.x").alias("x"), F.col("e.i").alias(f"i_{name}"))

    # either side is many times the table that it is made of, which is all that Spark counts for a broadcast: it would fill the driver
    joined = prefix(a, "a").hint("merge").join(prefix(b, "b"), "x")
    close = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * share - 1e-9
    joined = joined.where(close & (F.col("a") < F.col("b")) if right is None else close)
    two = (F.shiftright("x", 32) > 0).cast("int") + 1  # how many bigrams the keys meet in
    need = F.ceil(t * (F.col("n_a") + F.col("n_b")) / 2 - 1e-9)
    most = two + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    # met in one only if one is all they need to share, else in their first two
    fits = F.when(two == 1, need <= 1).otherwise(need >= 2) & (most >= need)
    first = F.size(F.array_intersect(F.slice("g_a", F.lit(1), F.col("i_a")), F.slice("g_b", F.lit(1), F.col("i_b")))) == two
    met = joined.where(fits).where(first)
    score = 2.0 * F.size(F.array_intersect("g_a", "g_b")) / (F.col("n_a") + F.col("n_b"))
    near = met.select("a", "b", score.alias("score")).where(F.col("score") >= t)
    # the keys are as many as the titles, and their texts compress well: merged as well
    flat = a.select("flat", F.col("id").alias("a")).hint("merge").join(b.select("flat", F.col("id").alias("b")), "flat").select("a", "b", F.lit(1.0).alias("score"))
    found = near.unionByName(flat.where("a < b") if right is None else flat).groupBy("a", "b").agg(F.max("score").alias("score"))
    out = found.hint("merge").join(a.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").hint("merge").join(b.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b")
    if right is None:
        return out.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "score")
    return out.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "score")
