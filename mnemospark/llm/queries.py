"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import components as cc
from mnemospark.llm import history, ivfpq, mixing, names, packing, pii, skeleton, subjects, tokens
from mnemospark.operators.hierarchy import newest_memories
from mnemospark.session import cut


#: The key of the query p5_text; an application passes its own secret.
SURROGATE_KEY = "example-key"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    a = _read(spark, d, "entity_aliases").select("id", "surface_text", "normalized_text")
    return skeleton.lookalike_pairs(a, "id", "surface_text", "normalized_text").select(F.col("id_a").alias("alias_id_a"), F.col("id_b").alias("alias_id_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.lookalike_classes(_read(spark, d, "entity_aliases"), "id", "surface_text").withColumnRenamed("id", "alias_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links = cc.merge_links(_read(spark, d, "entities").select("id", "merged_into_id"))
    return cc.components(links).select(F.col("id").alias("entity_id"), "group_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    m = newest_memories(_read(spark, d, "memories").select("id", "text", "vector", "updated_at", "created_at", "parent_memory_id"))
    r = history.repeats(m, _read(spark, d, "ingest_log").select("memory_id", "batch_no", "arrived_at"))
    return r.select(F.least("id", "accepted").alias("memory_id_a"), F.greatest("id", "accepted").alias("memory_id_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    m = newest_memories(_read(spark, d, "memories").select("id", "text", "updated_at", "created_at", "parent_memory_id"))
    return pii.pieces(m, "id", "text").withColumnRenamed("id", "memory_id")


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    m = newest_memories(_read(spark, d, "memories").select("id", "text", "updated_at", "created_at", "parent_memory_id"))
    return pii.redact(m, "id", "text", key=SURROGATE_KEY).withColumnRenamed("id", "memory_id")


def p5_collisions(spark: SparkSession, d: str) -> DataFrame:
    """By type: pieces, surrogates, surrogates of more than one piece, pieces that are their own surrogate."""
    return pii.collisions(p5_found(spark, d), SURROGATE_KEY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    m = newest_memories(_read(spark, d, "memories").select("id", "vector", "updated_at", "created_at", "parent_memory_id"))
    return ivfpq.nearest(m, "id", "vector", k=5).select(F.col("id").alias("memory_id"), F.col("neighbour").alias("neighbour_id"))


def _name_groups(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "entities").select("id", "canonical_name", "kind", "merged_into_id")
    return names.link(e, _read(spark, d, "entity_aliases").select("entity_id", "surface_text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(cut(_name_groups(spark, d))).select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per linked entity: its class and the number of other entities in it."""
    g = cut(_name_groups(spark, d))
    n = g.groupBy("group_id").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("links")).where("links > 0")
    return g.join(n, "group_id").select(F.col("id").alias("entity_id"), "class_id", "links")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.sizes(_read(spark, d, "documents"), "doc_id", "text", keep=("source",))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one larger than a container, with its container."""
    packed, _ = packing.pack(_sizes(spark, d).select("id", "n_tokens"))
    return packed.select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    packed, _ = packing.pack(_sizes(spark, d).select("id", "n_tokens"))
    return packing.report(cut(packed), packing.CAPACITY)


def p8_certificates(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d).select("id", "n_tokens"))[1]


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its rate and the number of copies it contributes."""
    return mixing.mix(_sizes(spark, d), _read(spark, d, "source_targets")).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "source_targets")
    return mixing.shares(cut(mixing.mix(_sizes(spark, d), t)), t)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    areas = sorted(r[0] for r in _read(spark, d, "subject_areas").select("subject").distinct().collect())
    return subjects.assign(_read(spark, d, "documents"), _read(spark, d, "document_labels"), areas)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by subject; a document about two subjects counts for both."""
    return _subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


P3_FOUND = """
WITH RECURSIVE ids AS (SELECT DISTINCT id FROM entities WHERE id IS NOT NULL),
e AS (SELECT DISTINCT x.id a, x.merged_into_id b FROM entities x JOIN ids ON ids.id = x.merged_into_id WHERE x.id <> x.merged_into_id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b)
SELECT a AS entity_id, min(b) AS group_id FROM r GROUP BY a
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND}
