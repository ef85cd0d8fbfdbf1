"""Parent-child links to full hierarchies.

Method: weighted disjoint-set forests. Each partition contracts its own links into a forest whose nodes carry the offset
(number of steps) to their local root. The forests are then merged level by level: a merge hangs the root of one forest
under the node of another that it names and adds the offsets, so the paths covered at least double with every level. What
never reaches an end is on a loop or leads into one. Paths are materialised by the same indexed traversal of parents.

Only portals, the nodes in which some other partition's forest ends, take part in the merging; all other nodes wait for
one last lookup. No component is ever gathered in one task, and hub parents go through session.lookup.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import cut, latest, lookup

_FOREST = "id string, root string, steps long, low string, looped boolean"


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contract the links of one partition: union-find with offsets and path compression."""
    up: dict[str, str] = {}
    for b in batches:
        up.update(zip(b["id"], b["parent"]))
    root: dict[str, str] = {}
    steps: dict[str, int] = {}
    low: dict[str, str] = {}
    loops: set[str] = set()
    for start in up:
        trail, x, at = [], start, {}
        while x in up and x not in root and x not in at:
            at[x] = len(trail)
            trail.append(x)
            x = up[x]
        if x in at:  # a loop within the partition
            ring = trail[at[x] :]
            least = min(ring)
            for y in trail:
                root[y], steps[y], low[y] = least, -1, least
                loops.add(y)
            continue
        if x in loops:
            for y in trail:
                root[y], steps[y], low[y] = root[x], -1, root[x]
                loops.add(y)
            continue
        base_root, base, base_low = (root[x], steps[x], low[x]) if x in root else (x, 0, None)
        for y in reversed(trail):
            base += 1
            base_low = y if base_low is None or y < base_low else base_low
            root[y], steps[y], low[y] = base_root, base, base_low
    ids = list(up)
    for i in range(0, len(ids), 10_000):
        part = ids[i : i + 10_000]
        yield pd.DataFrame({"id": part, "root": [root[x] for x in part], "steps": [steps[x] for x in part], "low": [low[x] for x in part], "looped": [x in loops for x in part]})


def _double(r: DataFrame) -> DataFrame:
    """One merge level: every open node takes over the root of its root."""
    o = r.select(F.col("id").alias("oid"), F.col("root").alias("oroot"), F.col("steps").alias("osteps"), F.col("low").alias("olow"), F.col("looped").alias("olooped"), F.col("open").alias("oopen"))
    still, rest = r.where("open"), r.where("not open")
    m = lookup(still, "root", o, "oid", "left")
    met = F.col("oroot").isNotNull()
    m = m.select(
        "id",
        F.when(met, F.col("oroot")).otherwise(F.col("root")).alias("root"),
        F.when(met & F.col("olooped"), F.lit(-1)).when(met, F.col("steps") + F.col("osteps")).otherwise(F.col("steps")).alias("steps"),
        F.when(met & F.col("olooped"), F.col("oroot")).when(met, F.least("low", "olow")).otherwise(F.col("low")).alias("low"),
        F.coalesce(F.col("olooped"), F.lit(False)).alias("looped"),
        (met & F.coalesce(F.col("oopen"), F.lit(False))).alias("open"),
    )
    return m.unionByName(rest.select(*m.columns))


def _close(r: DataFrame) -> DataFrame:
    """Merge portals (id, root, steps, low, looped) until each ends at a true root or is known to lead into a loop."""
    r = cut(r.withColumn("open", ~F.col("looped")))
    before = -1
    while (n := r.where("open").count()) and n != before:
        before, r = n, cut(_double(r))
    if not n:
        return r.drop("open")
    # As many open as before a doubling: all of them lead into loops. Double until every pointer is on its loop
    # (the set of pointers no longer shrinks) and each has seen the whole loop (the smallest ids no longer change).
    ring, last = r.where("open"), None
    while True:
        state = ring.agg(F.countDistinct("root"), F.sum(F.xxhash64("root", "low").cast("decimal(38,0)"))).first()
        tips = ring.join(ring.select(F.col("root").alias("id")).distinct(), "id", "left_semi").agg(F.count("*"), F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first()
        state = (state[0], *tips)
        if state == last:
            break
        last, ring = state, cut(_double(ring))
    tip = ring.select(F.col("id").alias("tid"), F.col("low").alias("tlow"))
    done = lookup(ring, "root", tip, "tid", "left").select("id", F.col("tlow").alias("root"), F.lit(-1).cast("long").alias("steps"), F.col("tlow").alias("low"), F.lit(True).alias("looped"))
    return cut(r.where("not open").drop("open").unionByName(done))


def resolve(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Root and depth of every node.

    nodes: one row per id (repeat ids: pass them through session.latest first). Returns (id, parent, root, depth, looped)
    for every row with a non-null id. parent is null where none is named or the named one has no row; such a node is its own
    root at depth 0. Where the path never ends, looped is true, root is the smallest id on the loop and depth is -1; a node
    that names itself is a loop of one. An empty input gives an empty result. Extra columns are ignored.
    """
    n = cut(nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("named")).where("id is not null"))
    has = lookup(n.where("named is not null"), "named", n.select(F.col("id").alias("pid"), F.lit(True).alias("there")), "pid", "left")
    links = has.where("there").select("id", F.col("named").alias("parent"))
    forest = cut(links.repartition("id").mapInPandas(_forest, _FOREST))
    portal = forest.join(forest.where("not looped").select(F.col("root").alias("id")).distinct(), "id", "left_semi")
    ends = _close(portal)
    o = ends.select(F.col("id").alias("oid"), F.col("root").alias("oroot"), F.col("steps").alias("osteps"), F.col("looped").alias("olooped"))
    open_, rest = forest.where("not looped"), forest.where("looped")
    m = lookup(open_, "root", o, "oid", "left").select(
        "id",
        F.coalesce("oroot", "root").alias("root"),
        F.when(F.col("olooped"), F.lit(-1)).otherwise(F.col("steps") + F.coalesce("osteps", F.lit(0))).alias("depth"),
        F.coalesce("olooped", F.lit(False)).alias("looped"),
    )
    solved = m.unionByName(rest.select("id", "root", F.lit(-1).cast("long").alias("depth"), "looped"))
    return (
        n.join(links, "id", "left").join(solved, "id", "left")
        .select("id", "named", "parent", F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("looped", F.lit(False)).alias("looped"))
    )


def paths(resolved: DataFrame) -> DataFrame:
    """resolved with path, the array of ids from the root to the node; null for looped nodes.

    Indexed parent traversal by doubling: a node holds the next 2^k ancestors and appends those its last ancestor holds.
    """
    r = cut(resolved)
    p = cut(r.where("not looped and parent is not null").select("id", F.col("parent").alias("tip"), F.array("parent").alias("up")))
    deepest = r.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach < deepest:
        o = p.select(F.col("id").alias("oid"), F.col("tip").alias("otip"), F.col("up").alias("oup"))
        p = cut(lookup(p, "tip", o, "oid", "left").select("id", F.coalesce("otip", "tip").alias("tip"), F.when(F.col("oup").isNull(), F.col("up")).otherwise(F.concat("up", "oup")).alias("up")))
        reach *= 2
    full = r.join(p.select("id", "up"), "id", "left")
    own = F.array("id")
    path = F.when(F.col("looped"), F.lit(None)).when(F.col("up").isNull(), own).otherwise(F.concat(F.reverse("up"), own))
    return full.withColumn("path", path).drop("up")


def descendants(with_paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every proper ancestor of every node that is on no loop."""
    e = with_paths.where("path is not null and size(path) > 1").select("id", "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor"))
    return e.select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def newest_memories(memories: DataFrame) -> DataFrame:
    """One row per memory id, the one with the greatest updated_at (ties: created_at, then parent)."""
    return latest(memories.where("id is not null"), "id", F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.asc_nulls_last("parent_memory_id"))
