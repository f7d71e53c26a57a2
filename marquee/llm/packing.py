"""Items into containers of fixed capacity: first-fit decreasing with a tournament tree, in random groups.

Items are dealt to groups of about `group_size` by a hash of their row number, so no group depends on a key and
none can be hot; the number of groups grows with the data. Within a group the items are sorted by falling size
and each goes to the first container with room, found in a tournament tree over the containers' free space in
O(log n). An item larger than the capacity is divided into pieces of the capacity and a rest; nothing else is.

Items of size 0 (null and empty texts) are put into the first container of their group. Null sizes count as 0.
Equal sizes are taken by row number and piece. Repeated rows are items of their own. A capacity below 1 or null
is refused. Empty tables give no rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import checkpointed

GROUP = 4_000
MAX_BUDGETS = 1_000


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; items in the given order among equal sizes."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    width = 1 << max(0, (len(sizes) - 1).bit_length())
    tree = [capacity] * (2 * width)  # largest free space below each node
    out = [0] * len(sizes)
    for i in order:
        need, at = sizes[i], 1
        while at < width:
            at *= 2
            if tree[at] < need:
                at += 1
        out[i] = at - width
        tree[at] -= need
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return out


PACKED = "budget_id int, pack_group int, container int, key bigint, piece int, tok_start bigint, tok_end bigint"


def pack(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id", size: str = "tokens", group_size: int = GROUP) -> DataFrame:
    """(budget_id, pack_group, container, key, piece, tok_start, tok_end) of every piece of every item for every budget."""
    rows = budgets.select("budget_id", "capacity_tokens").limit(MAX_BUDGETS + 1).collect()  # a short list by nature
    if len(rows) > MAX_BUDGETS or any(r[1] is None or r[1] < 1 for r in rows):
        raise ValueError("budgets: a short list of capacities of at least 1")
    items = checkpointed(sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size")).withColumn("row", F.monotonically_increasing_id()))
    pieces_in = lambda cap: F.greatest(F.ceil(F.col("size") / F.lit(cap)), F.lit(1)).cast("int")
    if not rows:
        return items.select(F.lit(0).alias("budget_id"), F.lit(0).alias("pack_group"), F.lit(0).alias("container"), F.col("key").alias(key), F.lit(0).alias("piece"), F.col("size").alias("tok_start"), F.col("size").alias("tok_end")).where("false")
    totals = items.agg(*[F.sum(pieces_in(r[1])).alias(f"n{i}") for i, r in enumerate(rows)]).collect()[0]
    each = []
    for i, (budget, cap) in enumerate(rows):
        groups = max(1, math.ceil((totals[i] or 0) / group_size))
        piece = items.select(F.lit(budget).alias("budget_id"), F.lit(cap).alias("cap"), "key", "row", "size", F.explode(F.sequence(F.lit(0), pieces_in(cap) - 1)).alias("piece"))
        each.append(piece.withColumn("pack_group", F.pmod(F.xxhash64("row", "piece", "budget_id"), F.lit(groups)).cast("int")))
    long = each[0]
    for e in each[1:]:
        long = long.unionByName(e)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["row", "piece"], kind="stable")
        cap = int(b["cap"].iloc[0])
        start = b["piece"].astype("int64") * cap
        end = pd.concat([start + cap, b["size"]], axis=1).min(axis=1)
        return pd.DataFrame({"budget_id": b["budget_id"], "pack_group": b["pack_group"], "container": first_fit_decreasing((end - start).tolist(), cap), "key": b["key"], "piece": b["piece"], "tok_start": start, "tok_end": end})

    return long.groupBy("budget_id", "pack_group").applyInPandas(run, PACKED).withColumnRenamed("key", key)


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, containers, tokens, filled) of a packing: the share of the containers' space that is used."""
    used = packed.groupBy("budget_id", "pack_group", "container").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("used"))
    total = used.groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return total.join(F.broadcast(budgets.limit(MAX_BUDGETS)), "budget_id").select("budget_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
