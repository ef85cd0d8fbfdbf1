"""Mutations of the store, as new snapshots: expiry, decay, deletion, duplicate merging, access counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000


def expired(now: int) -> Column:
    """Past its expiry; pinned and superseded rows too."""
    return F.col("expires_at").isNotNull() & (F.col("expires_at") < now)


def decayed(now: int, days: int) -> Column:
    """An active, unpinned episode that nobody looked at, older than the given days."""
    return (F.col("memory_type") == "episode") & (F.col("access_count") == 0) & (F.col("created_at") < now - days * DAY) & ~F.col("is_superseded") & ~F.col("pinned")


def delete(ids: DataFrame, mem: DataFrame, mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories, mentions and edges without the given ids. Entities, aliases and what the deleted ones superseded stay."""
    d = ids.select(F.col("id").alias("did")).distinct()
    return mem.join(d, F.col("id") == F.col("did"), "left_anti"), mentions.join(d, F.col("memory_id") == F.col("did"), "left_anti"), edges.join(d, F.col("source_id") == F.col("did"), "left_anti").join(d, F.col("target_id") == F.col("did"), "left_anti")


def sweep_counts(mem: DataFrame, now: int, days: int) -> DataFrame:
    """(expired, decayed): what one maintenance cycle removes; expiry goes first."""
    x, y = F.coalesce(expired(now), F.lit(False)), F.coalesce(decayed(now, days), F.lit(False))
    return mem.agg(F.count_if(x).alias("expired"), F.count_if(~x & y).alias("decayed"))


def bump(mem: DataFrame, log: DataFrame) -> DataFrame:
    """Counters after an append-only access log (id, at); updated_at stays."""
    n = log.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    m = mem.join(n, "id", "left")
    return m.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("n", F.lit(0))).withColumn("last_accessed_at", F.greatest("last_accessed_at", "at")).drop("n", "at")


def merge_duplicates(mem: DataFrame, dup: DataFrame, now: int) -> DataFrame:
    """mem after duplicates (id, seq, memory_type, pinned, expires_at) were merged into it, in the order of seq.

    The last type given holds, pinned once is pinned, an episode's expiry replaces the old one even by none, each one counts
    as an access.
    """
    d = dup.groupBy("id").agg(
        F.max_by("memory_type", F.when(F.col("memory_type").isNotNull(), F.col("seq"))).alias("t"),
        F.max("pinned").alias("p"),
        F.max_by(F.struct("expires_at"), F.when((F.col("memory_type") == "episode") | F.col("expires_at").isNotNull(), F.col("seq"))).alias("x"),
        F.count("*").alias("n"),
    )
    m = mem.join(d, "id", "left")
    hit = F.col("n").isNotNull()
    return m.select(
        *[c for c in mem.columns if c not in ("memory_type", "pinned", "expires_at", "access_count", "updated_at", "last_accessed_at")],
        F.coalesce("t", "memory_type").alias("memory_type"),
        (F.col("pinned") | F.coalesce("p", F.lit(False))).alias("pinned"),
        F.when(F.col("x").isNotNull(), F.col("x.expires_at")).otherwise(F.col("expires_at")).alias("expires_at"),
        (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"),
        F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, F.lit(now)).otherwise(F.col("last_accessed_at")).alias("last_accessed_at"),
    )


def upsert_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, the new ones replacing the old."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def set_vectors(mem: DataFrame, new: DataFrame) -> DataFrame:
    """mem with new vectors (id, vector) put in where given."""
    n = new.groupBy("id").agg(F.first("vector").alias("nv"))
    return mem.join(n, "id", "left").withColumn("vector", F.coalesce("nv", "vector")).drop("nv")


def set_parents(mem: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Parent pointers (id, parent_memory_id) and superseded marks; both bump updated_at."""
    n = new.groupBy("id").agg(F.max("parent_memory_id").alias("np"))
    old = n.select(F.col("np").alias("sid")).where("sid is not null").distinct()
    m = mem.join(n, "id", "left").join(old, F.col("id") == F.col("sid"), "left")
    touched = F.col("np").isNotNull() | F.col("sid").isNotNull()
    return m.withColumn("parent_memory_id", F.coalesce("np", "parent_memory_id")).withColumn("is_superseded", F.col("is_superseded") | F.col("sid").isNotNull()).withColumn("updated_at", F.when(touched, F.lit(now)).otherwise(F.col("updated_at"))).drop("np", "sid")


def reconcile_signature(mem: DataFrame, same: bool) -> DataFrame:
    """Vectors of another embedding space are void."""
    return mem if same else mem.withColumn("vector", F.lit(None).cast("array<double>"))
