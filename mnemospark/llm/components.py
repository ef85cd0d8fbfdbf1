"""Consolidating pairwise matches into groups: randomised graph contraction.

In every round each vertex hooks to the vertex of its closed neighbourhood that comes first in a fresh hash order; edges
are relabelled, loops dropped and repeats removed, until no edge is left. The expected number of vertices falls by a
constant factor a round, whatever the shape of the graph, so long chains and huge stars need O(log n) rounds alike.
Afterwards the mappings are expanded from the last round back to the first. A vertex with a third of all edges is
relabelled through session.lookup, and its neighbours are reduced to one hook by map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import cut, lookup

MAX_ROUNDS = 200


def _canonical(e: DataFrame, a: str, b: str) -> DataFrame:
    return e.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group_id) for every vertex with an edge to another one; group_id is the smallest id of its component.

    edges: two columns of one comparable type. Nulls at either end and self links are no edges, repeats count once;
    an empty input gives an empty result.
    """
    e = cut(_canonical(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b))
    maps: list[DataFrame] = []
    for k in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min(order("v")).alias("m")).select(F.col("u").alias("id"), F.least("m", order("u"))["x"].alias("to"))
        hook = cut(hook)
        maps.append(hook)
        e = lookup(e, "u", hook, "id", "inner").select(F.col("to").alias("u"), "v")
        e = cut(_canonical(lookup(e, "v", hook, "id", "inner").select("u", F.col("to").alias("v")), "u", "v"))
    else:
        raise RuntimeError("contraction did not end")
    if not maps:
        return edges.select(F.col(a).alias("id"), F.col(a).alias("group_id")).limit(0)
    label = maps[-1]
    for m in reversed(maps[:-1]):
        nxt = label.select(F.col("id").alias("mid"), F.col("to").alias("end"))
        label = cut(lookup(m, "to", nxt, "mid", "left").select("id", F.coalesce("end", "to").alias("to")))
    least = label.groupBy("to").agg(F.min("id").alias("group_id"))
    return lookup(label, "to", least.withColumnRenamed("to", "rep"), "rep", "inner").select("id", "group_id")


def merge_links(entities: DataFrame) -> DataFrame:
    """(a, b): each id's merge targets that have a row themselves; self links and null targets are none."""
    ids = entities.select(F.col("id").alias("b")).where("b is not null").distinct()
    e = entities.select(F.col("id").alias("a"), F.col("merged_into_id").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    return lookup(e, "b", ids.withColumn("there", F.lit(True)).withColumnRenamed("b", "bid"), "bid", "inner").select("a", "b")
