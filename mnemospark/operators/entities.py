"""Entities as a whole: created from mentions, offered for merging, merged by decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import graph, ingest, vectors
from mnemospark.session import cut

#: decide(pairs) -> pairs (left_id, right_id, decision): "same" or anything else.
Decide = Callable[[DataFrame], DataFrame]


def merge_inputs(ent: DataFrame, al: DataFrame, most: int = 200) -> DataFrame:
    """(id, canonical_name, aliases): the most recently seen unmerged entities with their spellings in order. most is the operator's own."""
    few = ent.where("merged_into_id is null").orderBy(F.desc("last_seen"), "id").limit(most).select("id", "canonical_name")
    a = al.where("surface_text is not null").join(few.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").groupBy("entity_id").agg(F.sort_array(F.collect_set("surface_text")).alias("aliases"))
    return few.join(a, few["id"] == a["entity_id"], "left").select("id", "canonical_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def name_vectors(ent: DataFrame, cache: DataFrame, embedder: object, provider: str, model: str, dims: int) -> DataFrame:
    """(id, vector): the vector of each entity's name, joined on the name, each name embedded once. Null names have none."""
    names = ent.where("canonical_name is not null").select(F.col("canonical_name").alias("id"), F.col("canonical_name").alias("text")).distinct()
    v = vectors.embed(names, cache, embedder, provider, model, dims).select(F.col("id").alias("name"), "vector")
    return ent.select("id", F.col("canonical_name").alias("name")).join(v, "name").select("id", "vector")


def resolve_or_create(m: DataFrame, al: DataFrame, ent: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, aliases, entities) after mentions (owner, pos, mention, kind) were looked up by normal form.

    A known alias and its entity are seen now and keep a kind they have; an unknown normal form makes an alias and an entity,
    once however often it is mentioned, under ids that depend on it alone. links: memory_id, alias_id. Blank mentions
    make nothing.
    """
    d = cut(ingest.resolve_aliases(ingest.mention_dedup(m), al, ent).join(ingest.mention_dedup(m).select("owner", "key", "kind"), ["owner", "key"]))
    new = d.where("alias_id is null").groupBy("key").agg(F.min(F.struct("owner", "mention", "kind")).alias("r"))
    ids = lambda what: F.sha2(F.concat_ws("|", F.lit(what), "key"), 256)
    new = cut(new.select("key", ids("alias").alias("aid"), ids("entity").alias("eid"), "r.mention", "r.kind"))
    at = F.lit(now).cast("long")
    fresh_al = new.select(F.col("aid").alias("id"), F.col("eid").alias("entity_id"), F.col("mention").alias("surface_text"), F.col("key").alias("normalized_text"), "kind", at.alias("first_seen"), at.alias("last_seen"))
    fresh_ent = new.select(F.col("eid").alias("id"), F.col("mention").alias("canonical_name"), "kind", at.alias("first_seen"), at.alias("last_seen"), F.lit(None).cast("string").alias("merged_into_id"))

    def seen(old: DataFrame, key: str) -> DataFrame:
        hit = d.where("alias_id is not null").groupBy(F.col(key).alias("hid")).agg(F.min("kind").alias("hkind"))
        t = old.join(hit, F.col("id") == F.col("hid"), "left")
        return t.withColumn("last_seen", F.when(F.col("hid").isNotNull(), F.greatest("last_seen", at)).otherwise(F.col("last_seen"))).withColumn("kind", F.coalesce("kind", "hkind")).drop("hid", "hkind")

    links = d.join(new.select("key", "aid"), "key", "left").select(F.col("owner").alias("memory_id"), F.coalesce("alias_id", "aid").alias("alias_id")).distinct()
    return links, seen(al, "alias_id").unionByName(fresh_al), seen(ent, "entity_id").unionByName(fresh_ent)


def merge_cycle(ent: DataFrame, al: DataFrame, decide: Decide, vectors_: DataFrame | None = None, entities_limit: int = 120, pairs_limit: int = 24) -> tuple[DataFrame, DataFrame, int]:
    """(entities, aliases, merged) after one cycle: likely pairs of the entities seen last, decided, merged into the one first seen.

    Decisions on pairs that were not offered are left out. The limits are the operator's own.
    """
    offered = cut(graph.merge_pairs(ent, entities_limit, pairs_limit, vectors=vectors_))
    if offered.isEmpty():
        return ent, al, 0
    same = cut(decide(offered).where("decision = 'same'").select("left_id", "right_id").join(offered.select("left_id", "right_id"), ["left_id", "right_id"], "left_semi"))
    if same.isEmpty():
        return ent, al, 0
    groups = cut(graph.merge_groups(same, ent))
    e, a = graph.apply_merges(ent, al, groups)
    return e, a, groups.where("id <> survivor").count()
