"""Keyword retrieval: BM25 over many queries at once.

Scores follow the FTS5 ranking function: k1 = 1.2, b = 0.75, idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. A query term
that falls into several tokens is a phrase. Superseded rows count in the statistics and are filtered before the limit.

The corpus is tokenised in one scan. Query phrases meet it on their first token: the phrase table is broadcast as long as it
is small (BROADCAST rows, counted), and shuffled beyond. The scores are never a table of query by document: parts of the
postings meet blocks of the queries in tasks that keep the best documents of each query (best), and only these are shuffled.
"""

from __future__ import annotations

import unicodedata as u
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import cut, table

K1, B, BROADCAST = 1.2, 0.75, 50_000
#: Postings and queries that one task holds; a difference of ranks that rounding to nine places may hide.
POSTINGS, QUERIES, SLACK = 2_000_000, 65_536, 1e-8


def tokens(c: str | F.Column) -> F.Column:
    """Runs of letters and digits, without accents, lower case; all of it inside the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(c, *_accents()), r"\p{M}", "")).otherwise(c)
    return F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Accented letters of the alphabets, and the letters without their marks: by canonical decomposition."""
    a, b = [], []
    for o in [*range(0xC0, 0x590), *range(0x1E00, 0x2000)]:
        d = u.normalize("NFD", chr(o))
        if len(d) > 1 and u.category(d[0])[0] == "L" and all(u.category(x)[0] == "M" for x in d[1:]):
            a.append(chr(o))
            b.append(d[0])
    return "".join(a), "".join(b)


def phrases(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, phrase, times): the terms of each query, quotes removed, split at blanks; times counts repeated ones."""
    q = queries.select(F.col(id_col).alias("query_id"), F.explode(F.split(F.regexp_replace(F.col(text_col), "['\"]", ""), r"(?U)\s+")).alias("term"))
    q = q.select("query_id", tokens("term").alias("phrase")).where("size(phrase) > 0")
    return q.groupBy("query_id", "phrase").agg(F.count("*").alias("times"))


def search(docs: DataFrame, queries: DataFrame, limit: int = 30, id_col: str = "id", text_col: str = "text", keep: str = "true", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, id, rank, score, position): the best documents of each query, scores relative to the best one.

    docs: id, text and whatever `keep`, the predicate on what may be returned, needs. Null texts hold no tokens but count as
    documents. Queries without tokens find nothing. Equal ranks go by id.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(tokens(text_col), F.array().cast("array<string>")).alias("toks"), F.expr(keep).alias("kept"))
    d = d.withColumn("dl", F.size("toks"))
    p = cut(phrases(queries, query_id, query_text))
    words = cut(p.select("phrase").distinct()).withColumn("term", F.monotonically_increasing_id())
    terms = words.select("phrase", "term", F.element_at("phrase", 1).alias("head"), F.size("phrase").alias("words"), F.concat(F.lit(" "), F.array_join("phrase", "  "), F.lit(" ")).alias("needle"))
    few = lambda x: F.broadcast(x) if x.limit(BROADCAST + 1).count() <= BROADCAST else x
    total = d.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    ones, more = terms.where("words = 1").select("term", "head"), terms.where("words > 1").select("term", "head", "needle")
    hits = d.select("id", "dl", "kept", F.explode("toks").alias("head")).join(few(ones), "head").select("id", "dl", "kept", "term")  # other tokens go before anything is counted
    if not more.isEmpty():
        first = d.select("id", "dl", "kept", F.concat(F.lit(" "), F.array_join("toks", "  "), F.lit(" ")).alias("line"), F.explode(F.array_distinct("toks")).alias("head"))
        many = first.join(few(more), "head").withColumn("tf", ((F.length("line") - F.length(F.replace("line", "needle"))) / F.length("needle")).cast("int")).where("tf > 0")
        hits = hits.unionByName(many.select("id", "dl", "kept", F.explode(F.array_repeat("term", F.col("tf"))).alias("term")))
    hits = table(hits.groupBy("id", "dl", "kept").agg(F.collect_list("term").alias("terms")), "hits")  # a term comes as often as it is there
    df = hits.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = words.join(df, "term").join(F.broadcast(total)).select("phrase", "term", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"), "avgdl")
    kept = hits.where("kept")
    parts, blocks = _grid(kept.agg(F.sum(F.size("terms"))).first()[0] or 0, p.select("query_id").distinct().count())
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    posts = kept.select("id", "dl", "terms", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).withColumn("block", copies(blocks))
    asks = p.join(words, "phrase").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("times").alias("times"), F.collect_list("idf").alias("idf"), F.first("avgdl").alias("avgdl"))
    asks = asks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", copies(parts))
    kind, key = asks.schema["query_id"].dataType.simpleString(), posts.schema["id"].dataType.simpleString()

    def run(posts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(posts) or not len(asks):
            return pd.DataFrame({"query_id": [], "id": [], "rank": []}, dtype=object)
        ids, num = np.unique(posts["id"].to_numpy(), return_inverse=True)  # numbers in the order of the ids
        at = np.repeat(np.arange(len(posts)), posts["terms"].map(len))
        names, term = np.unique(np.concatenate(posts["terms"].to_list()), return_inverse=True)
        key, tf = np.unique(term.astype(np.int64) * len(posts) + at, return_counts=True)
        term, at = key // len(posts), key % len(posts)
        dl = posts["dl"].to_numpy()[at] / asks["avgdl"].iloc[0]
        q, n, rank = best(names[term], num[at], tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl)), asks["terms"], asks["times"] * asks["idf"], limit)
        return pd.DataFrame({"query_id": asks["query_id"].to_numpy()[q], "id": ids[n], "rank": rank})

    s = posts.groupBy("part", "block").cogroup(asks.groupBy("part", "block")).applyInPandas(run, f"query_id {kind}, id {key}, rank double")
    w = Window.partitionBy("query_id")
    s = s.withColumn("position", F.row_number().over(w.orderBy(F.round("rank", 9), "id"))).where(F.col("position") <= limit)
    best_rank = F.max(F.abs("rank")).over(w)
    return s.withColumn("score", F.when(best_rank > 0, F.abs("rank") / best_rank).otherwise(F.lit(0.5)))


def _grid(postings: int, queries: int) -> tuple[int, int]:
    """Parts of the documents and blocks of the queries: few copies of the postings, and work for several tasks where there is enough."""
    parts = max(1, -(-postings // POSTINGS))
    return parts, max(1, -(-queries // QUERIES), min(-(-queries // 512), -(-6 // parts)))


def best(term: np.ndarray, num: np.ndarray, weight: np.ndarray, terms: Sequence, times: Sequence, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, num, rank): exactly the `limit` best documents of each query by (rank to nine places, num).

    Postings (term, num, weight, above 0); a query's terms with what each counts, above 0. The rarest terms of a query are added first. As soon as
    the terms left over cannot lift a document that has none of those added into the best, only the documents met so far
    go on, and of them only those that may still be among the best.
    """
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(term) or not len(terms):
        return empty
    names, tid = np.unique(term, return_inverse=True)
    docs, did = np.unique(num, return_inverse=True)
    order = np.lexsort((did, tid))
    key = (tid[order].astype(np.int64) * len(docs) + did[order]).astype(np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    at, by = did[order][first], np.add.reduceat(weight[order], first)  # a repeated document counts once a term
    edges = np.searchsorted(tid[order][first], np.arange(len(names) + 1))
    top = np.maximum.reduceat(by, edges[:-1])
    acc, out_q, out_n, out_r = np.zeros(len(docs)), [], [], []
    for i, (ts, ns) in enumerate(zip(terms, times)):
        ts, ns = np.asarray(ts, np.int64), np.asarray(ns, np.float64)
        k = np.minimum(np.searchsorted(names, ts), len(names) - 1)
        have = names[k] == ts
        k, ns = k[have], ns[have]
        if not len(k):
            continue
        o = np.argsort(edges[k + 1] - edges[k], kind="stable")
        k, ns = k[o], ns[o]
        rest = np.r_[np.cumsum((ns * top[k])[::-1])[::-1][1:], 0.0]
        met, step, n = [], 0, 0
        while step < len(k):
            a, b = edges[k[step]], edges[k[step] + 1]
            where = at[a:b]
            have = acc[where]
            met.append(where[have == 0.0])  # every weight is above 0
            acc[where] = have + ns[step] * by[a:b]
            n += len(met[-1])
            step += 1
            if step < len(k) and n >= limit:
                s = acc[np.concatenate(met)]
                if np.partition(s, n - limit)[n - limit] > rest[step - 1] + SLACK:
                    break
        c = np.concatenate(met)
        s = acc[c]
        acc[c] = 0.0
        while step < len(k):
            if len(c) > limit:
                stay = s + rest[step - 1] >= np.partition(s, len(s) - limit)[len(s) - limit] - SLACK
                c, s = c[stay], s[stay]
            a, b = edges[k[step]], edges[k[step] + 1]
            j = np.minimum(np.searchsorted(at[a:b], c), b - a - 1)
            s = s + np.where(at[a:b][j] == c, ns[step] * by[a:b][j], 0.0)
            step += 1
        if len(c) > limit:
            near = s >= np.partition(s, len(s) - limit)[len(s) - limit] - SLACK
            c, s = c[near], s[near]
        pick = np.lexsort((c, -np.round(s, 9)))[:limit]
        c, s = c[pick], s[pick]
        out_q.append(np.full(len(c), i))
        out_n.append(docs[c])
        out_r.append(-s)
    return (np.concatenate(out_q), np.concatenate(out_n), np.concatenate(out_r)) if out_q else empty
