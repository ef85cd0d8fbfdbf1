"""Filling fixed-capacity containers with items: bound-certified repacking.

Items are spread over partitions of bounded size, and each is packed by best-fit decreasing. Dual-feasible functions give a
lower bound on the containers a partition needs. A partition that meets its bound is certified and keeps what it has, but
for its emptiest container; one with a gap gives up its poorly filled containers. What is given up is exchanged, that is
dealt to fewer partitions, and packed again, until nothing improves. No task ever holds more than PART items.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import cut

CAPACITY, PART, FILL, ROUNDS = 4_096, 20_000, 0.995, 6


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound among dual-feasible functions: thresholds (large items count whole, small ones not) and roundings."""
    x = sizes[sizes > 0].astype(np.int64)
    if not len(x):
        return 0
    v, n = np.unique(x, return_counts=True)
    best = -(-int((v * n).sum()) // capacity)
    lows = np.unique(np.r_[v[v <= capacity // 2], 1])
    lows = lows[:: max(1, len(lows) // 256)]
    for e in lows.tolist():
        f = np.where(v > capacity - e, capacity, np.where(v < e, 0, v))
        best = max(best, -(-int((f * n).sum()) // capacity))
    for k in range(1, 21):
        f = np.where(v * (k + 1) % capacity == 0, v * k, (v * (k + 1) // capacity) * capacity)  # times k, to stay whole
        best = max(best, -(-int((f * n).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; items go, largest first, to the fullest container that still takes them."""
    out = np.empty(len(sizes), np.int64)
    free: list[int] = []
    at: dict[int, list[int]] = {}
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect_left(free, s)
        if k < len(free):
            room = free[k]
            b = at[room].pop()
            if not at[room]:
                del at[room]
                free.pop(k)
        else:
            room, b = capacity, used
            used += 1
        room -= s
        if room not in at:
            at[room] = []
            insort(free, room)
        at[room].append(b)
        out[i] = b
    return out


def items(sizes: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, size): an item larger than a container becomes full pieces and a rest; others stay whole. Empty ones too."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    d = sizes.where("id is not null").select("id", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    return d.select("id", "piece", F.when((F.col("piece") + 1) * capacity <= F.col("n_tokens"), F.lit(capacity)).otherwise(F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """sizes (id, n_tokens) -> the packing (id, piece, size, container) and the certificates (round, partition, items, containers, bound).

    Every item of the input is in exactly one container; rows with a null id are left out, null sizes count as 0.
    """
    todo = cut(items(sizes.select("id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), capacity))
    full = todo.where(F.col("size") == capacity).select("id", "piece", "size", F.concat(F.lit("full-"), "id", F.lit("-"), "piece").alias("container"))
    todo = todo.where(F.col("size") < capacity)
    placed, proofs = [full], []

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["id", "piece"], kind="stable")
        x = df["size"].to_numpy()
        b = best_fit_decreasing(x, capacity)
        load = np.bincount(b, weights=x)
        bound = lower_bound(x, capacity)
        loose = load < FILL * capacity
        if len(load) <= bound and loose.sum() > 1:  # certified: only the emptiest container may go on
            loose = np.arange(len(load)) == int(load.argmin())
        return df.assign(container=b, loose=loose[b], bound=bound, used=len(load))

    n = todo.count()
    last = None
    for r in range(ROUNDS):
        if not n:
            break
        k = max(1, -(-n // part))
        schema = "id " + todo.schema["id"].dataType.simpleString() + ", piece int, size int, part int, container long, loose boolean, bound long, used long"
        todo = todo.select("id", "piece", "size", F.pmod(F.xxhash64(F.lit(r), "id", "piece"), F.lit(k)).cast("int").alias("part"))
        done = cut(todo.groupBy("part").applyInPandas(run, schema))
        proofs.append(done.groupBy("part").agg(F.count("*").alias("items"), F.max("used").alias("containers"), F.max("bound").alias("bound")).select(F.lit(r).alias("round"), F.col("part").alias("partition"), "items", "containers", "bound"))
        final = k == 1 or r == ROUNDS - 1
        name = F.concat_ws("-", F.lit(r), "part", "container")
        keep = done if final else done.where("not loose")
        placed.append(keep.select("id", "piece", "size", name.alias("container")))
        if final:
            break
        todo = done.where("loose")
        n, before = todo.count(), n
        if n == before and last == n:
            placed.append(done.where("loose").select("id", "piece", "size", name.alias("container")))
            break
        last = n
    out, cert = placed[0], None
    for p in placed[1:]:
        out = out.unionByName(p)
    for p in proofs:
        cert = p if cert is None else cert.unionByName(p)
    if cert is None:
        cert = todo.sparkSession.createDataFrame([], "round int, partition int, items long, containers long, bound long")
    return out, cert


def report(packing: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the share of unused space, and a lower bound on the containers of any packing."""
    per = packing.groupBy("container").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    t = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"), F.coalesce(F.max("load"), F.lit(0)).alias("fullest"))
    hist = packing.where("size > 0").groupBy("size").agg(F.count("*").alias("n"))  # at most `capacity` rows
    lows = hist.select(F.col("size").alias("e")).where(F.col("e") <= capacity // 2)
    value = F.when(F.col("size") > capacity - F.col("e"), capacity).when(F.col("size") < F.col("e"), 0).otherwise(F.col("size"))
    bound = lows.unionByName(lows.sparkSession.createDataFrame([(1,)], "e int")).distinct().join(F.broadcast(hist)).groupBy("e").agg(F.sum(value * F.col("n")).alias("s")).agg(F.ceil(F.coalesce(F.max("s"), F.lit(0)) / capacity).alias("lower_bound"))
    return t.join(bound).select("containers", "lower_bound", "tokens", "fullest", F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0).alias("unused_share"))
