"""Queries and SQL of the hierarchy operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import hierarchy as h
from mnemospark.session import cut


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    m = spark.read.parquet(f"{d}/memories.parquet").select("id", "parent_memory_id", "updated_at", "created_at")
    return h.resolve(h.newest_memories(m), "id", "parent_memory_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).where("named is not null").select(F.col("id").alias("memory_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every memory with its root, depth and full path (null on and above loops)."""
    return h.paths(_resolved(spark, d)).select(F.col("id").alias("memory_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"), "looped")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return h.descendants(cut(h.paths(_resolved(spark, d)))).select(F.col("ancestor").alias("memory_id"), F.col("descendant").alias("descendant_id"), "distance")


_WALK = """
WITH RECURSIVE m AS (
  SELECT id, parent_memory_id AS named FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, parent_memory_id NULLS LAST) AS rn FROM memories WHERE id IS NOT NULL
  ) WHERE rn = 1
), n AS (SELECT m.id, m.named, p.id AS parent FROM m LEFT JOIN m p ON p.id = m.named),
w(id, cur, depth, trail) AS (
  SELECT id, id, 0, [id] FROM n
  UNION ALL
  SELECT w.id, n.parent, w.depth + 1, list_append(w.trail, n.parent) FROM w JOIN n ON n.id = w.cur WHERE n.parent IS NOT NULL AND NOT list_contains(w.trail, n.parent)
), last AS (SELECT id, max_by(cur, depth) AS cur, max(depth) AS depth, max_by(trail, depth) AS trail FROM w GROUP BY id),
f AS (
  SELECT last.id, c.parent IS NOT NULL AS looped, me.named,
    CASE WHEN c.parent IS NOT NULL THEN list_min(list_slice(trail, list_position(trail, c.parent), len(trail))) ELSE cur END AS root,
    CASE WHEN c.parent IS NOT NULL THEN -1 ELSE depth END AS depth, trail
  FROM last JOIN n c ON c.id = last.cur JOIN n me ON me.id = last.id
)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _WALK + "SELECT id AS memory_id, root AS root_id, CAST(depth AS INTEGER) AS depth FROM f WHERE named IS NOT NULL",
        "p2_paths": _WALK + "SELECT id AS memory_id, root AS root_id, CAST(depth AS INTEGER) AS depth, CASE WHEN looped THEN NULL ELSE array_to_string(list_reverse(trail), '/') END AS path, looped FROM f",
        "p2_descendants": _WALK + "SELECT trail[k + 1] AS memory_id, id AS descendant_id, CAST(k AS INTEGER) AS distance FROM (SELECT id, trail, unnest(range(1, len(trail))) AS k FROM f WHERE NOT looped)",
    }
