"""The store's tables in canonical form, and scans over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.session import latest


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def memories(df: DataFrame) -> DataFrame:
    """One row per id, the newest."""
    return latest(df.where("id is not null"), "id", F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.asc_nulls_last("parent_memory_id"))


def entities(df: DataFrame) -> DataFrame:
    """One row per id; merged where any of its rows is."""
    return df.where("id is not null").groupBy("id").agg(F.min("canonical_name").alias("canonical_name"), F.min("kind").alias("kind"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("merged_into_id").alias("merged_into_id"))


def aliases(df: DataFrame) -> DataFrame:
    return df.where("id is not null").groupBy("id").agg(F.min("entity_id").alias("entity_id"), F.min("surface_text").alias("surface_text"), F.min("normalized_text").alias("normalized_text"), F.min("kind").alias("kind"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def mentions(df: DataFrame) -> DataFrame:
    return df.where("memory_id is not null and alias_id is not null").select("memory_id", "alias_id").distinct()


def edges(df: DataFrame) -> DataFrame:
    """Logical edges: one per source, target and type (types in lower case), with the oldest id; self links and rows without an end are none."""
    e = df.where("source_id is not null and target_id is not null and source_id <> target_id").withColumn("relation_type", F.lower("relation_type"))
    e = e.where("relation_type in ('updates', 'related')")
    return e.groupBy("source_id", "target_id", "relation_type").agg(F.min(F.struct("created_at", "id")).alias("m")).select("source_id", "target_id", "relation_type", F.col("m.created_at").alias("created_at"), F.col("m.id").alias("id"))


def active(mem: DataFrame) -> DataFrame:
    return mem.where("not is_superseded")


def page(df: DataFrame, limit: int, offset: int, *order: F.Column) -> DataFrame:
    """A page of an ordered listing: a distributed top-k, never a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def active_page(mem: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(active(mem), limit, offset, F.desc("created_at"), F.asc("id"))


def missing_vectors(mem: DataFrame, limit: int = 100) -> DataFrame:
    """Active rows without a vector, oldest first."""
    return page(active(mem).where("vector is null"), limit, 0, F.asc("created_at"), F.asc("id"))


def canonical_page(ent: DataFrame, limit: int = 200) -> DataFrame:
    return page(ent.where("merged_into_id is null"), limit, 0, F.desc("last_seen"), F.asc("id"))


def multi_get(mem: DataFrame, wanted: DataFrame, pos: str, key: str) -> DataFrame:
    """Rows in the order asked for: repeated ids come repeatedly, missing ones not at all."""
    return wanted.select(F.col(pos).alias("pos"), F.col(key).alias("id")).where("id is not null").join(mem, "id")


def ranked_aliases(al: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.desc("last_seen"), T.nocase("surface_text"), F.asc("id"))
    return al.withColumn("position", F.row_number().over(w))


def touching(e: DataFrame) -> DataFrame:
    """(node, id, other, relation_type, created_at): every edge at both its ends."""
    a = e.select(F.col("source_id").alias("node"), "id", F.col("target_id").alias("other"), "relation_type", "created_at")
    b = e.select(F.col("target_id").alias("node"), "id", F.col("source_id").alias("other"), "relation_type", "created_at")
    return a.unionByName(b)


def exact_matches(mem: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """For each wanted text the newest active memory with the same exact key."""
    k = latest(active(mem).withColumn("key", T.exact_key("text")).where("key is not null"), "key", F.desc("created_at"), F.asc("id"))
    w = wanted.select(T.exact_key(text_col).alias("key")).where("key is not null").distinct()
    return w.join(k, "key")


def stats(mem: DataFrame, ent: DataFrame, e: DataFrame) -> DataFrame:
    """total, active, superseded, entities, relationships; one pass over each table."""
    m = mem.agg(F.count("*").alias("total"), F.count_if(~F.col("is_superseded")).alias("active"))
    return m.join(ent.agg(F.count_if(F.col("merged_into_id").isNull()).alias("entities"))).join(e.agg(F.count("*").alias("relationships"))).select("total", "active", (F.col("total") - F.col("active")).alias("superseded"), "entities", "relationships")


def vector_stats(mem: DataFrame, index: DataFrame) -> DataFrame:
    """indexed, missing_vectors, missing_index_rows, pending of the active memories; index: the ids that are indexed."""
    m = active(mem).join(index.select(F.col("id").alias("ix")).distinct(), F.col("id") == F.col("ix"), "left")
    return m.agg(
        F.count_if(F.col("ix").isNotNull()).alias("indexed"),
        F.count_if(F.col("vector").isNull()).alias("missing_vectors"),
        F.count_if(F.col("vector").isNotNull() & F.col("ix").isNull()).alias("missing_index_rows"),
    ).withColumn("pending", F.col("missing_vectors") + F.col("missing_index_rows"))
