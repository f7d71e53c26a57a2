"""Connected components of graphs too large for one machine, by randomised contraction.

In every round each vertex hooks to the neighbour (or itself) that comes first in a fresh hash order, edges are
relabelled and made distinct, and the map of the round is written to the shared folder; a constant share of the
vertices vanishes per round, so the rounds grow with the logarithm of the number of vertices. Afterwards the maps are
expanded from the last to the first, each into a table of its own, and forgotten. A vertex of very many edges is
combined before the shuffle when hooking and is split by AQE when relabelling.

Null vertices and loops link nothing; repeated and reversed edges count once; ties of the hash order go to the
smaller vertex. Vertices may be of any type that has an order. Maps are merged with what they relabel: broadcasts of
every round's map would add up in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import checkpointed, forget

#: Rounds after which something is wrong: every round keeps at most three quarters of the vertices, as expected.
ROUNDS = 100


def contract(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(v, root) of every vertex of `edges` (a, b) that has an edge to another; equal roots if and only if connected."""
    both = edges.where("a is not null and b is not null and a <> b")
    left = checkpointed(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    maps: list[DataFrame] = []
    for r in range(rounds):
        if left.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(r * 7919 + 17), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        hook = checkpointed(left.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("v"), F.least(order("a"), F.col("m"))["v"].alias("root")))
        maps.append(hook)
        half = left.hint("merge").join(hook.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").select("ra", "b").distinct()
        moved = half.hint("merge").join(hook.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        before, left = left, checkpointed(moved)
        forget(before)
    else:
        raise RuntimeError(f"not contracted after {rounds} rounds")
    forget(left)
    if not maps:
        return both.select(F.col("a").alias("v"), F.col("a").alias("root")).where("false")
    out = maps.pop()
    while maps:
        earlier = maps.pop()
        on = out.select(F.col("v").alias("root"), F.col("root").alias("far"))
        wider = checkpointed(earlier.hint("merge").join(on, "root", "left").select("v", F.coalesce("far", "root").alias("root")))
        forget(out)
        forget(earlier)
        out = wider
    return out
