"""Most similar vectors for every vector: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a bounded sample (SAMPLE vectors or DEEP a list, the first by hash of
their content); every vector is indexed. Equal vectors count as one point with k + 1 of its ids, which is all any answer can
use. A point visits its PROBES nearest lists and all further ones that are nearly as near (MARGIN, at most MOST), and a point
between two lists stands in both (TWICE): neighbours that a list's border parts are met all the same, however many lists
there are. In each list the residual codes estimate the cosine; whatever can be among the k best, given how far each point is
from its code, is reranked, first in single precision, then with exact cosines in double precision. Lists are split into blocks of at most BLOCK points,
so no task grows with the largest list. Vectors travel in the shortest form that holds them without loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemospark.session import table

SAMPLE, DEEP, PROBES, MOST, BLOCK, SUBSPACES, CODES = 65_536, 32, 8, 64, 4_096, 32, 256
#: Cosines by which a list may be farther than the nearest one: to be visited, and to hold a point a second time.
MARGIN, TWICE = 0.12, 0.05
#: Most lists that are fitted in one go; more are fitted in two levels.
FLAT, LISTS = 512, 8_192


def usable(col: str, dims: int) -> F.Column:
    """A vector of dims finite numbers that are not all zero."""
    big = 1.7976931348623157e308
    return F.col(col).isNotNull() & (F.size(col) == dims) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big)) & F.exists(col, lambda x: x != 0)


def unit_rows(col: pd.Series) -> np.ndarray:
    return _unit(np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 1)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack(x: np.ndarray) -> list[bytes]:
    """Rows in half, single or double precision, the shortest that holds all numbers of the row exactly."""
    with np.errstate(over="ignore"):
        forms = [x.astype(np.float16), x.astype(np.float32), x]
    half, single = ((f == x).all(1) for f in forms[:2])
    return [forms[0 if h else 1 if s else 2][i].tobytes() for i, (h, s) in enumerate(zip(half, single))]


def unpack(col: list[bytes] | pd.Series, dims: int) -> np.ndarray:
    """Unit vectors of packed rows, in double precision."""
    held = np.asarray(col, object)
    width, x = np.fromiter(map(len, held), np.int64, len(held)), np.empty((len(held), dims))
    for w in np.unique(width).tolist():
        at = width == w
        x[at] = np.frombuffer(b"".join(held[at]), f"f{w // dims}").reshape(-1, dims)
    return _unit(x)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7, spherical: bool = False) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster is reseeded from the points farthest from their centroids."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, best = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
        half = (c * c).sum(1) / 2
        for i in range(0, len(x), 8192):
            s = x[i : i + 8192] @ c.T - half
            near[i : i + 8192], best[i : i + 8192] = s.argmax(1), s.max(1)
        order = np.argsort(near, kind="stable")
        edges = np.searchsorted(near[order], np.arange(len(c)))
        counts = np.bincount(near, minlength=len(c))
        full = np.flatnonzero(counts)
        c[full] = np.add.reduceat(x[order], edges[full], axis=0) / counts[full, None]
        if (empty := np.flatnonzero(counts == 0)).size:
            far = np.argsort(best)[: empty.size]
            c[empty[: far.size]] = x[far]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of about `lists` lists; beyond FLAT of them, in two levels."""
    if lists <= FLAT:
        return kmeans(x, lists, spherical=True)
    top = kmeans(x, lists // 128, spherical=True)
    near = _nearest(x, top)
    parts = [x[near == i] for i in range(len(top))]
    return np.concatenate([kmeans(p, max(1, round(lists * len(p) / len(x))), spherical=True) for p in parts if len(p)])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])


class Index:
    """What is broadcast: coarse centroids and codebooks. Its size depends on the parameters, not on the data."""

    def __init__(self, sample: np.ndarray, lists: int):
        x = sample.astype(np.float32)
        self.centroids = centroids(x, lists)
        part = x[: 64 * CODES]
        res = part - self.centroids[_nearest(part, self.centroids)]
        w = -(-x.shape[1] // SUBSPACES)
        self.cuts = [slice(j, min(j + w, x.shape[1])) for j in range(0, x.shape[1], w)]
        self.books = [kmeans(res[:, s], CODES, rounds=6) for s in self.cuts]

    def codes(self, res: np.ndarray) -> np.ndarray:
        out = np.empty((len(res), len(self.cuts)), np.uint8)
        for j, (s, b) in enumerate(zip(self.cuts, self.books)):
            out[:, j] = (res[:, s] @ b.T - (b * b).sum(1) / 2).argmax(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for: their inner products with a query are the sums of its distance tables."""
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)

    def visits(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lists, wanted, twice) of points: their nearest lists in order, which of these they visit, whether they stand in the second one too."""
        s = x @ self.centroids.T
        m = min(max(probes, MOST), s.shape[1])
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        v = np.take_along_axis(s, top, 1)
        o = np.argsort(-v, axis=1, kind="stable")
        top, v = np.take_along_axis(top, o, 1), np.take_along_axis(v, o, 1)
        return top, (np.arange(m) < probes) | (v >= v[:, :1] - MARGIN), (v[:, 1] >= v[:, 0] - TWICE) if m > 1 else np.zeros(len(x), bool)

    def search(self, at: int, q: pd.DataFrame, m: pd.DataFrame, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pid, nid, cosine): of list `at`, or a block of it, m, the k nearest of each point of q that it does not meet in their home list."""
        dims, qid, mid, home = self.centroids.shape[1], q["pid"].to_numpy(), m["mid"].to_numpy(), m["home"].to_numpy(np.int64)
        coded = self.centroids[at] + self.decode(np.frombuffer(b"".join(m["code"]), np.uint8).reshape(len(m), -1))
        mx, last = unpack(m["mx"], dims), max(0, len(m) - k - 1)
        m32 = mx.astype(np.float32).T
        off = (np.linalg.norm(mx - coded, axis=1) + 2e-6).astype(np.float32)  # no cosine is farther than this from its estimate
        for i in range(0, len(q), 512):
            qx = unpack(q["x"].iloc[i : i + 512], dims)
            q32 = qx.astype(np.float32)
            est = q32 @ coded.T
            least = np.partition(est - off, last, axis=1)[:, last]  # k + 1 points reach this, of which one may be the query itself
            near = np.where(est + off >= least[:, None], q32 @ m32, np.float32(-9))
            r, c = np.nonzero(near >= np.partition(near, last, axis=1)[:, last, None] - np.float32(4e-6))
            met = home[c] != at
            if met.any():
                seen = [np.frombuffer(p, np.int16).astype(np.int64) for p in q["visited"].iloc[i : i + 512]]
                key = np.concatenate([j * LISTS + p for j, p in enumerate(seen)])
                met[met] = np.isin(r[met] * LISTS + home[c[met]], key)
            keep = ~met & (mid[c] != qid[i + r])
            r, c = r[keep], c[keep]
            cos = np.concatenate([np.einsum("nd,nd->n", qx[r[j : j + 65536]], mx[c[j : j + 65536]]) for j in range(0, len(r), 65536)] or [np.empty(0)])
            o = np.lexsort((mid[c], -cos, r))
            r, c, cos = r[o], c[o], cos[o]
            few = np.arange(len(r)) - np.searchsorted(r, r) < k
            yield qid[i + r[few]], mid[c[few]], cos[few]


def points(named: DataFrame, k: int) -> DataFrame:
    """(pid, x, ids, h): one point per distinct vector of named (id, x), with its k + 1 smallest ids."""
    w = Window.partitionBy("x").orderBy("id")
    p = named.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return table(p.select(F.monotonically_increasing_id().alias("pid"), "x", "ids", F.pmod(F.xxhash64("x"), F.lit(2**32)).alias("h")), "points")


def fit(p: DataFrame, n: int, dims: int) -> Index:
    """Fit on a bounded sample (about; chosen by hash)."""
    lists = int(np.clip(2 ** round(np.log2(max(n, 1) ** 0.5 * 3)), 1, LISTS))
    sample = max(SAMPLE, DEEP * lists)
    part = p.where(F.col("h") < int(2**32 * min(1.0, sample / max(n, 1)))) if n > sample else p
    got = part.select("x").toArrow()["x"].to_pylist()
    x = np.concatenate([unpack(got[i : i + 8192], dims).astype(np.float32) for i in range(0, len(got), 8192)])
    return Index(x, min(lists, len(x)))


def nearest(rows: DataFrame, id_col: str, vec_col: str, k: int = 5, probes: int = PROBES, dims: int = 64, queries_where: str | None = None) -> DataFrame:
    """(id, neighbour, cosine): the k most similar other rows of every row with a usable vector.

    Rows with null ids or unusable vectors neither ask nor answer. Of equally similar neighbours the one with the smaller
    id comes first. Fewer than k + 1 usable rows give fewer than k neighbours. queries_where, an expression over `id`,
    limits who asks, never who answers.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "x": pack(np.stack(b["vector"].to_numpy()).astype(np.float64)) if len(b) else []})

    kind = rows.schema[id_col].dataType.simpleString()
    named = rows.where(usable(vec_col, dims)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector")).where("id is not null")
    named = table(named.mapInPandas(packed, f"id {kind}, x binary").distinct(), "vectors")
    p = points(named, k)
    n = p.count()
    if n == 0:
        return rows.select(F.col(id_col).alias("id"), F.col(id_col).alias("neighbour"), F.lit(0.0).alias("cosine")).limit(0)
    held = p.sparkSession.sparkContext.broadcast(fit(p, n, dims))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = held.value
        for b in (f.iloc[i : i + 2048] for f in batches for i in range(0, len(f), 2048)):
            x = unpack(b["x"], dims).astype(np.float32)
            top, wanted, twice = ix.visits(x, probes)
            code = [ix.codes(x - ix.centroids[top[:, j]]) for j in range(min(2, top.shape[1]))]
            stands = [[(int(t[j]), code[j][i].tobytes()) for j in range(1 + int(two))] for i, (t, two) in enumerate(zip(top, twice))]
            yield pd.DataFrame({"pid": b["pid"], "x": b["x"], "stands": stands, "visited": [t[w].astype(np.int16).tobytes() for t, w in zip(top, wanted)], "probe": [t[w].astype(np.int32) for t, w in zip(top, wanted)]})

    a = table(p.select("pid", "x").mapInPandas(assign, "pid long, x binary, stands array<struct<list:int,code:binary>>, visited binary, probe array<int>"), "assigned")
    stood = a.select("pid", "x", F.col("stands")[0]["list"].alias("home"), F.explode("stands").alias("s")).select(F.col("s.list").alias("list"), F.col("s.code").alias("code"), "pid", "x", "home")
    blocks = stood.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = stood.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int").alias("block"), F.col("pid").alias("mid"), F.col("x").alias("mx"), "code", "home").alias("m")
    ask = a
    if queries_where:
        ask = a.join(p.join(named.where(queries_where).select("x"), "x", "left_semi").select("pid"), "pid", "left_semi")
    asks = ask.select("pid", "x", "visited", F.explode("probe").alias("list")).join(F.broadcast(blocks), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "pid", "x", "visited").alias("q")

    def search(key: tuple, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        found = list(held.value.search(key[0], q, m, k)) if len(q) and len(m) else []
        cat = lambda j, t: np.concatenate([f[j] for f in found]) if found else np.empty(0, t)
        return pd.DataFrame({"pid": cat(0, np.int64), "nid": cat(1, np.int64), "cosine": cat(2, np.float64)})

    found = asks.groupBy("q.list", "q.block").cogroup(members.groupBy("m.list", "m.block")).applyInPandas(search, "pid long, nid long, cosine double")
    top = found.withColumn("rn", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("cosine"), "nid"))).where(F.col("rn") <= k).select("pid", "nid", "cosine")
    own = p.select("pid", F.col("pid").alias("nid"), F.lit(1.0).alias("cosine")).where("size(ids) > 1")
    if queries_where:
        own = own.join(ask.select("pid"), "pid", "left_semi")
    links = top.unionByName(own)
    ids = p.select(F.col("pid").alias("nid"), F.explode("ids").alias("neighbour"))
    per = links.join(ids, "nid").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("neighbour").alias("n")))).alias("near"))
    # every row of the table, also those beyond the k + 1 ids kept for a point
    full = (named.where(queries_where) if queries_where else named).join(p.select("pid", "x"), "x").join(per, "pid")
    return full.select("id", F.explode(F.slice(F.filter("near", lambda x: x["n"] != F.col("id")), 1, k)).alias("x")).select("id", F.col("x.n").alias("neighbour"), (-F.col("x.c")).alias("cosine"))
