"""Graph operators: bounded hops, shared entities, entity merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import lexical as L
from mnemospark.functions import text as T
from mnemospark.session import cut, lookup

#: Memories with more entities than this take the plain join instead of the subset lists.
SUBSETS = 8
#: Pairs that one task links.
FOREST = 1_000_000


def hops(e: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """(seed, id, hop): the nodes within `most` undirected steps of each seed, the seed itself excluded.

    e: source_id, target_id of any type; one equi-join a hop, the frontier deduplicated before it moves on.
    """
    both = cut(e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).distinct())
    front = seeds.select(F.col("id").alias("seed"), "id").where("id is not null").distinct()
    found = front.withColumn("hop", F.lit(0))
    for h in range(1, most + 1):
        step = front.join(both, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id")).distinct()
        front = cut(step.join(found, ["seed", "id"], "left_anti"))
        found = found.unionByName(front.withColumn("hop", F.lit(h)))
    return found.where("hop > 0")


def canonical_mentions(mentions: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(memory_id, entity_id) of unmerged entities, distinct. Hot aliases meet a broadcast of their few rows."""
    a = aliases.select(F.col("id").alias("aid"), "entity_id")
    open_ = entities.where("merged_into_id is null").select(F.col("id").alias("eid"))
    m = lookup(mentions.select("memory_id", "alias_id"), "alias_id", a.join(open_, F.col("entity_id") == F.col("eid")).select("aid", "entity_id"), "aid", "inner")
    return m.select("memory_id", "entity_id").distinct()


def shared(me: DataFrame, mem: DataFrame, ask: DataFrame, most: int, extra: DataFrame | None = None) -> DataFrame:
    """(id, other, shared, created_at): for each asking memory the candidates that can be among its `most` best by (shared, created_at).

    me: memory_id, entity_id. mem: id, created_at of those that may be candidates. Exact without emitting the pairs of a hub:
    whoever shares exactly the set S with a memory is beaten only by rows newer in the list of S or sharing more, so it is
    enough to look at the newest most + 1 of the list of every subset of a memory's entities. Memories of more than SUBSETS
    entities use the join itself. extra: (id, other) candidates to be counted as well.
    """
    per = me.groupBy("memory_id").agg(F.sort_array(F.collect_set("entity_id")).alias("es"))
    small, large = per.where(F.size("es") <= SUBSETS), per.where(F.size("es") > SUBSETS)
    bits = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("es")) - 1).cast("int"))
    pick = F.expr("transform(filter(sequence(0, size(es) - 1), i -> (shiftright(mask, i) & 1) = 1), i -> es[i])")
    # Lists need the subsets of every candidate, long ones included up to the sizes any asking memory has.
    subs = small.select("memory_id", "es", F.explode(bits).alias("mask")).select("memory_id", pick.alias("s"))
    asks = cut(ask.select(F.col("id").alias("memory_id")).distinct().join(subs, "memory_id"))
    wanted = asks.select("s").distinct()
    cand = mem.select(F.col("id").alias("memory_id"), "created_at")
    listed = subs.join(wanted, "s", "left_semi").join(cand, "memory_id")
    big = large.join(cand, "memory_id").select("memory_id", "created_at", F.explode("es").alias("entity_id"))
    w = Window.partitionBy("s").orderBy(F.desc("created_at"), "memory_id")
    newest = listed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most + 1).select("s", F.col("memory_id").alias("other"))
    pairs = asks.join(newest, "s").select(F.col("memory_id").alias("id"), "other")
    ent = me.select(F.col("memory_id").alias("other"), "entity_id")
    long_ask = ask.select("id").distinct().join(large.select(F.col("memory_id").alias("id"), F.explode("es").alias("entity_id")), "id").join(ent, "entity_id").select("id", "other")
    long_other = me.select(F.col("memory_id").alias("id"), "entity_id").join(ask.select("id").distinct(), "id").join(big.select("entity_id", F.col("memory_id").alias("other")), "entity_id").select("id", "other")
    pairs = pairs.unionByName(long_ask).unionByName(long_other)
    if extra is not None:
        pairs = pairs.unionByName(extra.select("id", "other"))
    pairs = pairs.where("id <> other").distinct()
    es = per.select("memory_id", "es")
    c = pairs.join(es.select(F.col("memory_id").alias("id"), "es"), "id", "left").join(es.select(F.col("memory_id").alias("other"), F.col("es").alias("os")), "other", "left")
    c = c.select("id", "other", F.coalesce(F.size(F.array_intersect("es", "os")), F.lit(0)).alias("shared"))
    return c.join(cand.select(F.col("memory_id").alias("other"), "created_at"), "other")


def related(me: DataFrame, mem: DataFrame, ask: DataFrame, most: int = 5) -> DataFrame:
    """(id, other, shared, position): up to `most` related edges of each asking memory, by shared entities, then newest."""
    c = shared(me, mem, ask, most).where("shared > 0")
    w = Window.partitionBy("id").orderBy(F.desc("shared"), F.desc("created_at"), "other")
    return c.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).drop("created_at")


def update_candidates(me: DataFrame, mem: DataFrame, ask: DataFrame, near: DataFrame, most: int = 12) -> DataFrame:
    """(id, other, shared, vector_score, position): memories that a new one may update.

    mem: id, created_at, memory_type of active memories; ask: id, memory_type; near: id, other, score of vector candidates.
    Candidates share an entity or are near, and have the same type.
    """
    n = near.groupBy("id", "other").agg(F.max("score").alias("vector_score"))
    kinds = mem.select(F.col("id").alias("other"), "memory_type")
    out = None
    for kind in ("fact", "preference", "episode"):
        c = shared(me, mem.where(F.col("memory_type") == kind), ask.where(F.col("memory_type") == kind), most, n)
        out = c if out is None else out.unionByName(c)
    c = out.join(n, ["id", "other"], "left").join(kinds, "other").join(ask.select("id", F.col("memory_type").alias("kind")).distinct(), "id").where("memory_type = kind")
    c = c.withColumn("vector_score", F.coalesce("vector_score", F.lit(0.0))).where("shared > 0 or vector_score > 0")
    w = Window.partitionBy("id").orderBy(F.desc("shared"), F.desc(F.round("vector_score", 9)), F.desc("created_at"), "other")
    return c.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("id", "other", "shared", "vector_score", "position")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after new ones: known (source, target, type) stay as they are, each new one comes once."""
    key = ["source_id", "target_id", "relation_type"]
    fresh = new.where("source_id <> target_id").groupBy(*key).agg(F.min("created_at").alias("created_at"))
    return old.select(*key, "created_at").unionByName(fresh.join(old, key, "left_anti").select(*key, "created_at"))


def superseded_by(e: DataFrame) -> DataFrame:
    """(id): targets of an edge that updates them."""
    return e.where("relation_type = 'updates'").select(F.col("target_id").alias("id")).distinct()


def merge_pairs(ent: DataFrame, entities_limit: int = 120, pairs_limit: int = 24, least: float = 0.74, vectors: DataFrame | None = None, least_cosine: float = 0.86) -> DataFrame:
    """(left_id, right_id, score): the likeliest pairs among the most recently seen unmerged entities.

    The limits are the operator's own. Pairs share a name token or their whole folded name (nothing else reaches the
    threshold by text); with vectors (id, vector) given, also all pairs of the limited set by cosine.
    """
    few = ent.where("merged_into_id is null").orderBy(F.desc("last_seen"), "id").limit(entities_limit)
    few = cut(few.select("id", "last_seen", T.folded("canonical_name").alias("name")).withColumn("toks", F.array_distinct(F.filter(F.split("name", r"[^-\p{L}\p{N}]+"), lambda x: x != ""))))
    side = lambda p: few.select(F.col("id").alias(f"{p}_id"), F.col("last_seen").alias(f"{p}_seen"), F.col("name").alias(f"{p}_name"), F.col("toks").alias(f"{p}_toks"), F.explode(F.array_union("toks", F.array(F.concat(F.lit("="), "name")))).alias("tok"))
    ahead = (F.col("left_seen") > F.col("right_seen")) | ((F.col("left_seen") == F.col("right_seen")) & (F.col("left_id") < F.col("right_id")))
    p = side("left").join(side("right"), "tok").where(ahead).drop("tok").distinct()
    p = p.withColumn("score", L.string_similarity(F.col("left_toks"), F.col("right_toks"), F.col("left_name"), F.col("right_name"))).select("left_id", "right_id", "score").where(F.col("score") >= least)
    if vectors is not None:
        from mnemospark.operators.vectors import cosine

        v = few.select("id", "last_seen").join(vectors.select("id", "vector"), "id")
        a = v.select(F.col("id").alias("left_id"), F.col("last_seen").alias("left_seen"), F.col("vector").alias("lv"), F.lit(1).alias("j"))
        b = v.select(F.col("id").alias("right_id"), F.col("last_seen").alias("right_seen"), F.col("vector").alias("rv"), F.lit(1).alias("j"))
        c = a.join(b, "j").where(ahead).select("left_id", "right_id", cosine("lv", "rv").alias("score")).where(F.col("score") >= least_cosine)
        p = p.unionByName(c).groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
    return p.orderBy(F.desc("score"), "left_id", "right_id").limit(pairs_limit)


def _forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """(id, root): the nodes of the pairs (a, b), each with the smallest of its component."""
    up: dict = {}

    def top(x: object) -> object:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(pairs["a"], pairs["b"]):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return pd.DataFrame({"id": list(up), "root": [top(x) for x in up]}, dtype=object)


def merge_groups(pairs: DataFrame, ent: DataFrame, most: int = FOREST) -> DataFrame:
    """(id, survivor): every entity of a decided pair with the entity that survives of its chain: the one first seen (ties: smaller id).

    Chains end at one root. Tasks of about `most` pairs bring theirs down to stars; where one task holds them all, this is
    the result. Where there are more, labels spread over the stars by repeated minimum over neighbours with pointer jumping.
    """
    p = cut(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).where("a <> b").distinct())
    parts = max(1, -(-p.count() // most))
    key = p.schema["a"].dataType.simpleString()
    stars = cut(p.groupBy(F.pmod(F.xxhash64("a"), F.lit(parts)).alias("part")).applyInPandas(_forest, f"id {key}, root {key}"))
    label = stars.select("id", F.col("root").alias("label"))
    if parts > 1:
        both = stars.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(stars.select(F.col("root").alias("a"), F.col("id").alias("b"))).where("a <> b").distinct()
        both = cut(both)
        label = cut(label.select("id").distinct().withColumn("label", F.col("id")))
    while parts > 1:  # each round but the last lowers a label, so it ends
        near = both.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        nxt = cut(label.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label")))
        jump = nxt.select(F.col("id").alias("jid"), F.col("label").alias("jlabel"))
        nxt = cut(lookup(nxt, "label", jump, "jid", "left").select("id", F.coalesce("jlabel", "label").alias("label")))
        changed = nxt.join(label.withColumnRenamed("label", "was"), "id").where("label <> was").isEmpty()
        label = nxt
        if changed:
            break
    seen = label.join(ent.select("id", "first_seen"), "id")
    best = seen.groupBy("label").agg(F.min(F.struct("first_seen", "id")).alias("m")).select("label", F.col("m.id").alias("survivor"))
    return seen.join(best, "label").select("id", "survivor")


def apply_merges(ent: DataFrame, al: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases after merging: aliases point to the survivor, which takes the latest sighting and a kind if it has none."""
    g = groups.where("id <> survivor")
    gain = g.join(ent.select("id", F.col("last_seen").alias("seen"), F.col("kind").alias("its_kind")), "id").groupBy("survivor").agg(F.max("seen").alias("seen"), F.min("its_kind").alias("its_kind"))
    e = ent.join(g.select("id", F.col("survivor").alias("into")), "id", "left").join(gain, F.col("id") == gain["survivor"], "left")
    e = e.select("id", "canonical_name", F.coalesce("kind", "its_kind").alias("kind"), "first_seen", F.greatest("last_seen", F.coalesce("seen", "last_seen")).alias("last_seen"), F.coalesce("into", "merged_into_id").alias("merged_into_id"))
    a = lookup(al, "entity_id", g.select(F.col("id").alias("gid"), F.col("survivor").alias("into")), "gid", "left")
    return e, a.withColumn("entity_id", F.coalesce("into", "entity_id")).drop("into")
