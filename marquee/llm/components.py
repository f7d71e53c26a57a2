"""Connected groups of records from pairwise matches, by randomised contraction.

Vertices are keys, linked by the rows that carry them (a star around the row's first key) and by the matches. The
core's `contract` hooks every vertex to the neighbour that comes first in a fresh hash order, relabels, makes edges
distinct and repeats; then its maps are expanded, table by table, and forgotten.

Null keys link nothing; a key matched with itself links nothing new; repeated and reversed pairs count once;
keys that no row carries link on; rows without keys form no group. Empty tables give none. Ties of the hash
order go to the smaller vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.contraction import contract
from marquee.session import checkpointed, forget


def key_ids(keys: DataFrame) -> DataFrame:
    """(key, id) of the distinct keys; exact (no hashes), fixed by a checkpoint."""
    return checkpointed(keys.where("key is not null").distinct().withColumn("id", F.monotonically_increasing_id()))


def group_rows(groups: DataFrame, matches: DataFrame, row: str = "group_no", keys: str = "normalized_keys") -> DataFrame:
    """(row, root) of every row: root is the smallest row linked to it. Rows without keys are their own root."""
    carried = groups.select(F.col(row).alias("row"), F.explode(F.col(keys)).alias("key")).where("key is not null and row is not null")
    pairs = matches.select("left_key", "right_key").where("left_key is not null and right_key is not null")
    ids = key_ids(carried.select("key").union(pairs.select("left_key")).union(pairs.select("right_key")))
    held = checkpointed(carried.join(ids, "key").select("row", "id"))
    first = held.groupBy("row").agg(F.min("id").alias("a"))
    own = held.join(first, "row").where("id <> a").select("a", F.col("id").alias("b"))
    named = pairs.where("left_key <> right_key").distinct().join(ids.select(F.col("key").alias("left_key"), F.col("id").alias("a")), "left_key").join(ids.select(F.col("key").alias("right_key"), F.col("id").alias("b")), "right_key").select("a", "b")
    root = contract(own.union(named))
    placed = checkpointed(first.join(root.select(F.col("v").alias("a"), "root"), "a", "left").select("row", F.coalesce("root", "a").alias("set")))
    for done in (ids, held, root):
        forget(done)
    least = placed.groupBy("set").agg(F.min("row").alias("root"), F.max("row").alias("most"))
    linked = placed.join(least, "set").select("row", "root", (F.col("root") < F.col("most")).alias("several"))
    return linked.select(F.col("row").alias(row), F.col("root").alias("root_no"), "several")
