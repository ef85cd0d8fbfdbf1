"""Hybrid search over many queries: vector and keyword candidates, graph expansion, weighted merge, diversity re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import Config
from mnemospark.operators import bm25, graph, vectors
from mnemospark.session import drop, release, table

# Fixed values.
GRAPH_NEW, GRAPH_KNOWN, SAME_SOURCE, OVERFETCH, KNN_OVERFETCH = 0.5, 0.3, 0.8, 3, 4


def mode(embedding: bool, vectors_available: bool, graph_weight: float) -> str:
    """hybrid with vectors; else keywords with graph, or keywords alone."""
    return "hybrid" if embedding and vectors_available else "fts+graph" if graph_weight > 0 else "fts-only"


def combined(v: Column, f: Column, g: Column, cfg: Config) -> Column:
    """Weighted mean of the scores; the greatest one where all weights are 0."""
    total = cfg.vector_weight + cfg.text_weight + cfg.graph_weight
    if total <= 0:
        return F.greatest(v, f, g)
    return (v * cfg.vector_weight + f * cfg.text_weight + g * cfg.graph_weight) / F.lit(float(total))


def primary_source(v: Column, f: Column, g: Column) -> Column:
    v, f, g = F.round(v, 9), F.round(f, 9), F.round(g, 9)  # equal scores stay equal whatever the order of summation was
    return F.when((v >= f) & (v >= g), "vector").when(f >= g, "fts").otherwise("graph")


def merge_scores(vec: DataFrame, fts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(query_id, id, v, f, g, vr, fr): one row per candidate, absent scores 0 and absent ranks null; a union and one aggregation, not outer joins."""
    z, none = F.lit(0.0), F.lit(None).cast("int")
    rank = lambda d: F.col("position").cast("int") if "position" in d.columns else none
    u = vec.select("query_id", "id", F.col("score").cast("double").alias("v"), z.alias("f"), z.alias("g"), rank(vec).alias("vr"), none.alias("fr")).unionByName(fts.select("query_id", "id", z.alias("v"), F.col("score").cast("double").alias("f"), z.alias("g"), none.alias("vr"), rank(fts).alias("fr")))
    if extra is not None:
        u = u.unionByName(extra.select("query_id", "id", z.alias("v"), z.alias("f"), F.col("score").cast("double").alias("g"), none.alias("vr"), none.alias("fr")))
    u = u.repartition("query_id")  # windows by query after the aggregation need no further shuffle
    return u.groupBy("query_id", "id").agg(F.max("v").alias("v"), F.max("f").alias("f"), F.max("g").alias("g"), F.min("vr").alias("vr"), F.min("fr").alias("fr"))


def mmr(ranked: DataFrame, limit: int, weight: float) -> DataFrame:
    """The first `limit` rows of each query after re-ranking: among the rest, a source other than the last pick's is preferred.

    ranked: query_id, id, score, source, rk (the order before). Queries with no more than `limit` rows keep their order. A
    greedy pick takes the head of one of the sources' queues, so a fold over the bounded head of each queue is exact.
    """
    w = Window.partitionBy("query_id", "source").orderBy("rk")
    n = Window.partitionBy("query_id")
    r = ranked.withColumn("n", F.count("*").over(n)).withColumn("qpos", F.row_number().over(w)).where(F.col("qpos") <= limit)
    r = r.groupBy("query_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rk", "id", "score", "source"))).alias("items"))
    kind = r.schema["items"].dataType.simpleString()
    value = f"round({weight}D * x.score + (1.0D - {weight}D) * (CASE WHEN acc.last = x.source THEN {SAME_SOURCE}D ELSE 1.0D END), 9)"
    fold = f"""aggregate(sequence(1, {limit}), struct(cast(array() as {kind}) as picked, items as remaining, cast(null as string) as last), (acc, i) ->
      CASE WHEN size(acc.remaining) = 0 THEN acc ELSE
      aggregate(array(array_max(transform(acc.remaining, (x, k) -> struct(CASE WHEN acc.last IS NULL THEN -cast(k as double) ELSE {value} END as s, -k as o)))), acc, (a, m) ->
        struct(concat(a.picked, array(a.remaining[-m.o])) as picked, filter(a.remaining, (x, k) -> k <> -m.o) as remaining, a.remaining[-m.o].source as last)) END, acc -> acc.picked)"""
    out = r.select("query_id", F.when(F.col("n") <= limit, F.col("items")).otherwise(F.expr(fold)).alias("items"))
    return out.select("query_id", F.posexplode("items").alias("pos", "x")).select("query_id", F.col("x.id").alias("id"), F.col("x.score").alias("score"), F.col("x.source").alias("source"), (F.col("pos") + 1).alias("position"))


def hybrid(mem: DataFrame, queries: DataFrame, edges: DataFrame, cfg: Config, dims: int = 64, max_results: int | None = None, min_score: float | None = None, include_superseded: bool = False, with_vectors: bool = True) -> DataFrame:
    """(query_id, id, score, source, position).

    mem: id, text, vector, is_superseded; queries: query_id, text, vector (null: keywords only); edges: source_id, target_id.
    Superseded rows never come from vectors or keywords; through the graph they take places and then vanish, unless
    include_superseded. The query changes nothing: see retention.bump for the access log.
    """
    limit = int(max_results or cfg.max_recall_results)
    least = cfg.min_score if min_score is None else min_score
    fetch = limit * OVERFETCH
    m = mem.select("id", "text", "vector", "is_superseded")
    gone = m.where("is_superseded").select("id")
    if with_vectors:
        vec = vectors.nearest(m, queries.where("vector is not null"), fetch * KNN_OVERFETCH, dims)
        vec = vec.where(F.col("score") >= least * cfg.vector_min_score_factor).join(gone, "id", "left_anti")
    else:
        vec = m.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("position"))
    vec = table(vec.select("query_id", "id", "score", "position"), "vec")
    release(mem.sparkSession)
    fts = table(bm25.search(m, queries, fetch, keep="not is_superseded"), "fts")
    release(mem.sparkSession)
    base = table(merge_scores(vec, fts).drop("g"), "base")
    drop(vec)
    drop(fts)
    s = base.select("*", F.lit(True).alias("known"), F.lit(False).alias("linked"))
    if cfg.graph_weight > 0:
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("v") * cfg.vector_weight + F.col("f") * cfg.text_weight, 9)), "id")
        seeds = base.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= int(cfg.graph_seed_limit)).select("query_id", F.col("id").alias("seed"))
        near = graph.hops(edges, seeds.select(F.col("seed").alias("id")), int(cfg.graph_hop_depth))
        g = table(seeds.join(near, "seed").select("query_id", "id").distinct(), "linked")
        release(mem.sparkSession)
        s = s.unionByName(g.select("query_id", "id", F.lit(False).alias("known"), F.lit(True).alias("linked")), allowMissingColumns=True)
    s = s.repartition("query_id").groupBy("query_id", "id").agg(*[F.coalesce(F.max(x), F.lit(0.0)).alias(x) for x in "vf"], F.min("vr").alias("vr"), F.min("fr").alias("fr"), F.max("known").alias("known"), F.max("linked").alias("linked"))
    s = s.withColumn("g", F.when(~F.col("linked"), 0.0).when(F.col("known"), GRAPH_KNOWN).otherwise(GRAPH_NEW))
    score = combined(F.col("v"), F.col("f"), F.col("g"), cfg)
    s = s.withColumn("score", score).where(F.round("score", 9) >= least).withColumn("source", primary_source(F.col("v"), F.col("f"), F.col("g")))
    s = s.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("vr"), F.asc_nulls_last("fr"), "id")))
    picked = mmr(s.select("query_id", "id", "score", "source", "rk"), limit, cfg.mmr_lambda)
    kept = picked.join(m.select("id", "is_superseded"), "id")
    if not include_superseded:
        kept = kept.where("not is_superseded")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("position") <= limit).drop("is_superseded")


def hit_projection(hits: DataFrame, mem: DataFrame, scheme: str = "memory") -> DataFrame:
    """Hits as paths with snippets."""
    return hits.join(mem.select("id", "text"), "id").select("query_id", F.concat(F.lit(f"{scheme}://"), "id").alias("path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), "score", F.substring("text", 1, 200).alias("snippet"), "source", "position")


def context_block(hits: DataFrame, mem: DataFrame, cfg: Config) -> DataFrame:
    """(query_id, block): the recalled memories of each query as one prompt block, repeats by normal form removed."""
    from mnemospark.functions import text as T

    h = hits.join(mem.select("id", "text"), "id").withColumn("norm", T.normalized("text", cfg.tag_prefix)).where(~T.is_synthetic("text", cfg.tag_prefix) & (F.col("norm") != ""))
    h = h.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "norm").orderBy("position"))).where("rn = 1")
    h = h.where(F.col("position") <= int(cfg.auto_recall_max_memories) * 20)
    line = F.concat(F.lit("- "), T.for_prompt("text", int(cfg.prompt_memory_max_chars), cfg.tag_prefix), F.lit(" ["), T.percent("score"), F.lit("]"))
    return h.select("query_id", "position", line.alias("line")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), "\n").alias("block"))
