"""Vector operators: validation, cosine, exact nearest neighbours for many queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block of queries that one task holds, and how many of them pass over its rows at once.
BLOCK, PASS = 16_384, 64
#: Rows that one task holds against a block.
ROWS = 131_072


def valid(c: str, dims: int) -> Column:
    """An array of dims finite numbers."""
    return F.col(c).isNotNull() & (F.size(c) == dims) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def as_float32(c: str) -> Column:
    return F.transform(c, lambda x: x.cast("float"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """Cosine in double precision; 0 for null, unequal lengths or a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.col(a).isNull() | F.col(b).isNull() | (F.size(a) != F.size(b)), 0.0).when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def zeros(dims: int) -> Column:
    return F.array_repeat(F.lit(0.0), dims)


def nearest(rows: DataFrame, queries: DataFrame, k: int, dims: int = 64, id_col: str = "id", vec_col: str = "vector", query_id: str = "query_id", query_vec: str = "vector", least: float | None = None) -> DataFrame:
    """(query_id, id, score, position): the k rows of greatest cosine for every query, exactly; equal ones by id.

    A stated set of queries is held against all rows in blocks: each block of BLOCK queries passes once over every partition
    of the rows, where numpy keeps the best k a query and partition, and only these meet in a shuffle. Unusable vectors
    (wrong length, not finite, zero) neither ask nor answer. least: the least cosine of a result; single precision then finds
    the few pairs that can reach it, and only these are worked out in double precision and ranked.
    """
    ok = lambda c: valid(c, dims) & F.exists(c, lambda x: x != 0)
    q = queries.where(ok(query_vec)).select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qv"))
    r = rows.where(ok(vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    n = q.count()
    parts = max(1, -(-r.count() // ROWS))
    blocks = max(1, -(-n // BLOCK), min(-(-n // 512), -(-6 // parts)))  # few copies of the rows, and work for several tasks
    w = Window.partitionBy("block").orderBy("query_id")
    qb = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("at", F.row_number().over(w))
    packed = qb.groupBy("block").agg(F.collect_list(F.struct("query_id", "qv")).alias("qs"))
    r = r.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind, key = q.schema["query_id"].dataType.simpleString(), r.schema["id"].dataType.simpleString()

    def unit(x: pd.Series) -> np.ndarray:
        m = np.stack(x.to_numpy()).astype(np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(_: tuple, rs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(rs) or not len(qs):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype=object)
        ask = qs["qs"].iloc[0]
        ids, x = rs["id"].to_numpy(), unit(rs["v"])
        qx = unit(pd.Series([a["qv"] for a in ask]))
        names = np.array([a["query_id"] for a in ask], object)
        m, found = min(k, len(x)), []
        x32, q32 = (x.astype(np.float32).T, qx.astype(np.float32)) if least is not None else (None, None)
        for i in range(0, len(qx), PASS):
            if least is not None:
                at, to = np.nonzero(q32[i : i + PASS] @ x32 >= np.float32(least - 1e-5))
                s = np.concatenate([np.einsum("nd,nd->n", qx[at[j : j + 65536] + i], x[to[j : j + 65536]]) for j in range(0, len(at), 65536)] or [np.empty(0)])
                o = np.lexsort((-s, at))
                at, to, s = at[o], to[o], s[o]
                start = np.searchsorted(at, at)
                last = np.minimum(start + m, np.searchsorted(at, at, "right")) - 1
                few = (s >= least) & (s >= s[last] - 1e-12)  # all that tie with the k-th, so that ids can decide
                found.append((at[few] + i, to[few], s[few]))
                continue
            s = qx[i : i + PASS] @ x.T
            if m < s.shape[1]:  # all that tie with the k-th, so that ids can decide
                kth = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                at, to = np.nonzero(s >= kth[:, None] - 1e-12)
            else:
                at, to = np.nonzero(np.ones_like(s, bool))
            found.append((at + i, to, s[at, to]))
        at, to, s = (np.concatenate(f) for f in zip(*found))
        return pd.DataFrame({"query_id": names[at], "id": ids[to], "score": s})

    spread = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    got = r.groupBy("part", "block").cogroup(spread.groupBy("part", "block")).applyInPandas(best, f"query_id {kind}, id {key}, score double")
    top = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return got.withColumn("position", F.row_number().over(top)).where(F.col("position") <= k)


def embed(texts: DataFrame, cache: DataFrame, embedder: object, provider: str, model: str, dims: int) -> DataFrame:
    """texts (id, text), cache (hash, vector) -> (id, hash, vector): only what the cache lacks goes to the embedder, each text once."""
    from mnemospark.functions.text import cache_key

    t = texts.withColumn("hash", cache_key(provider, model, dims, "text"))
    known = cache.groupBy("hash").agg(F.first("vector").alias("vector"))
    miss = t.where("text is not null").join(known, "hash", "left_anti").groupBy("hash").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = embedder.embed(list(b["text"])) if len(b) else []
            if len(got) != len(b):
                raise ValueError("the embedder returned another number of vectors than it got texts")
            yield pd.DataFrame({"hash": b["hash"], "vector": [list(map(float, v)) for v in got]})

    new = miss.select("hash", "text").mapInPandas(run, "hash string, vector array<double>")
    return t.join(known.select("hash", F.col("vector").cast("array<double>").alias("vector")).unionByName(new), "hash", "left").select("id", "hash", "vector")
