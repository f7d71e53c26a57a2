"""Listings of the same work as one group: order-exact greedy clustering inside connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import normalize_title
from marquee.operators.contraction import contract
from marquee.operators.similarity import similar_pairs
from marquee.session import checkpointed

THRESHOLD = 0.82


def title_keys(listing: DataFrame, raw: str = "raw_title", clean: str = "clean_title") -> DataFrame:
    """`listing` with `keys`: its distinct non-empty comparison keys, in order."""
    keys = F.array_distinct(F.filter(F.array(normalize_title(F.col(raw)), normalize_title(F.col(clean))), lambda k: k.isNotNull() & (k != "")))
    return listing.withColumn("keys", keys)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of `edges` (a, b): root is the same within a component; loops keep a vertex without other edges."""
    linked = contract(edges)
    alone = edges.select(F.col("a").alias("v")).union(edges.select("b")).where("v is not null").distinct()
    return checkpointed(alone.hint("merge").join(linked, "v", "left").select("v", F.coalesce("root", "v").alias("root")))


def fold(rows: list[tuple[int, list[str], int | None]], similar: set[tuple[str, str]]) -> list[int]:
    """Group number (index of its first row) of each row (id, keys, external id) in order.

    A row with an external id joins that id's group, else adopts the first group without id that is similar, else
    founds one; a row without joins the first similar group, else founds one.
    """
    near: dict[str, set[str]] = {}
    for a, b in similar:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    keys_of: list[set[str]] = []  # the keys, the external id and the first row of each group
    ids: list[int | None] = []
    first: list[int] = []
    having: dict[str, set[int]] = {}  # groups that have a key, and those of them without an external id
    free: dict[str, set[int]] = {}
    by_id: dict[int, int] = {}
    out = []
    for i, (_, keys, ext) in enumerate(rows):
        at = by_id.get(ext) if ext is not None else None
        if at is None:
            where = having if ext is None else free
            at = min((g for k in keys for x in (k, *near.get(k, ())) for g in where.get(x, ())), default=None)
        if at is None:
            at = len(ids)
            keys_of.append(set())
            ids.append(None)
            first.append(i)
        if ids[at] is None and ext is not None:
            ids[at] = ext
            by_id[ext] = at
            for k in keys_of[at]:
                free[k].discard(at)
        for k in keys:
            if k not in keys_of[at]:
                keys_of[at].add(k)
                having.setdefault(k, set()).add(at)
                if ids[at] is None:
                    free.setdefault(k, set()).add(at)
        out.append(first[at])
    return out


def group_listings(listing: DataFrame, ids: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(listing_id, entity): entity is the first listing of the group, in the order of venue_ord, listing_ord, listing_id.

    Similar keys are found by the blocked join; the graph of keys (and external ids) splits into components that
    cannot meet; inside a component the greedy order is replayed exactly, in one task. Listings alike in keys and
    external id are replayed once, as they share one group whatever comes between; those without an external id may
    part when an older group gains a similar key, so each of them is replayed.
    """
    rows = title_keys(listing).select("listing_id", "venue_ord", "listing_ord", "keys")
    rows = rows.hint("merge").join(ids.select("listing_id", "external_id"), "listing_id", "left") if ids is not None else rows.withColumn("external_id", F.lit(None).cast("bigint"))
    rows = checkpointed(rows.withColumn("sig", F.to_json(F.struct("keys", "external_id", F.when(F.col("external_id").isNull(), F.col("listing_id")).alias("own")))))
    first = rows.groupBy("sig").agg(F.min_by(F.struct("listing_id", "keys", "external_id", "venue_ord", "listing_ord"), F.struct("venue_ord", "listing_ord", "listing_id")).alias("x")).select("sig", "x.*")
    first = checkpointed(first.where((F.size("keys") > 0) | F.col("external_id").isNotNull()))
    keys = first.select("sig", "external_id", F.explode("keys").alias("key"))
    pairs = checkpointed(similar_pairs(keys, threshold=threshold))
    node = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    anchor = F.coalesce(node("k", F.get(F.col("keys"), F.lit(0))), node("x", F.col("external_id")))
    edges = first.select(anchor.alias("a"), F.explode(F.concat(F.transform("keys", lambda k: node("k", k)), F.when(F.col("external_id").isNotNull(), F.array(node("x", F.col("external_id")))).otherwise(F.array().cast("array<string>")))).alias("b"))
    edges = edges.union(pairs.select(node("k", F.col("a")), node("k", F.col("b"))))
    comp = components(edges)
    # texts compress well, so the planner takes tables as large as the listings for small enough to broadcast
    placed = first.hint("merge").join(comp.select(F.col("v").alias("v0"), "root"), anchor == F.col("v0")).drop("v0")
    near = pairs.hint("merge").join(comp.select(F.col("v").alias("v1"), F.col("root").alias("at")), node("k", F.col("a")) == F.col("v1")).groupBy("at").agg(F.collect_list(F.struct("a", "b")).alias("near"))
    members = F.collect_list(F.struct("venue_ord", "listing_ord", "listing_id", "sig", "keys", "external_id"))
    sets = placed.groupBy("root").agg(F.array_sort(members).alias("members")).where(F.size("members") > 1)
    sets = sets.hint("merge").join(near, F.col("root") == F.col("at"), "left").select("members", F.coalesce("near", F.array().cast("array<struct<a:string,b:string>>")).alias("near"))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for members, pairs in zip(batch["members"], batch["near"]):
                similar = {(p["a"], p["b"]) for p in pairs}
                at = fold([(m["listing_id"], list(m["keys"]), m["external_id"]) for m in members], similar)
                out += [(m["sig"], members[i]["listing_id"]) for m, i in zip(members, at)]
            yield pd.DataFrame(out, columns=["sig", "entity"])

    sets = sets.mapInPandas(replay, "sig string, entity bigint")
    alone = first.select("sig", F.col("listing_id").alias("own"))
    rows = rows.join(alone.hint("merge"), "sig", "left")
    return rows.join(sets.hint("merge"), "sig", "left").select("listing_id", F.coalesce("entity", "own", "listing_id").alias("entity"))
