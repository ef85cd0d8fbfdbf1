"""Session helpers: lineage cuts, shared scratch tables and skew-safe lookups."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the probing rows, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 512


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where none is set, a local one if the session is local (tests), else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith(("local[", "local-")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="mnemospark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: dict[int, tuple[DataFrame, str]] = {}


def table(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write df as Parquet beside the checkpoints and read it back: columnar, compressed, prunable; by: a column that becomes folders."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that table() wrote and nothing needs any more."""
    _, path = _written.pop(id(df))
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files removed that belong to no DataFrame in use: Spark does so when the driver's garbage is collected, which on its own comes late."""
    gc.collect()
    spark._jvm.System.gc()


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first by the given order."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def hot_keys(df: DataFrame, key: str, total: int | None = None) -> list:
    """The keys that hold more than HOT_SHARE of the rows; at most 1 / HOT_SHARE values reach the driver."""
    total = df.count() if total is None else total
    least = max(int(total * HOT_SHARE), 1000)
    if total <= least:
        return []
    return [r[0] for r in df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > least).collect()]


def lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Join df with dim, whose dim_key is unique. Rows of hot keys meet a broadcast of those few dim rows, all others shuffle.

    The broadcast holds at most 1 / HOT_SHARE rows whatever the input, so a key with a third of all rows stays spread
    over the partitions it came from. dim's columns, dim_key aside, must not clash with df's.
    """
    hot = hot_keys(df, key) if hot is None else hot
    side = dim.withColumnRenamed(dim_key, "__k")
    if not hot:
        return df.join(side, F.col(key) == F.col("__k"), how).drop("__k")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(side.where(F.col("__k").isin(hot)))
    a = df.where(is_hot).join(few, F.col(key) == F.col("__k"), how).drop("__k")
    b = df.where(~is_hot).join(side, F.col(key) == F.col("__k"), how).drop("__k")
    return a.unionByName(b)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's executors, once for each application."""
    import io
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="mnemospark-code-"), "mnemospark.zip")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    with open(path, "wb") as f:
        f.write(held.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
