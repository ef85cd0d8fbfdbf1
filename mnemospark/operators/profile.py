"""User profile: ranked, deduplicated, capped sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import Config
from mnemospark.functions import text as T
from mnemospark.operators.tables import active

DAY = 86_400_000


def priority() -> list[F.Column]:
    return [F.desc("pinned"), F.desc("access_count"), F.desc("updated_at"), F.desc("created_at"), F.asc("id")]


def scan(mem: DataFrame, cfg: Config) -> DataFrame:
    """The newest active memories, as many as a build looks at: the operator's own limit."""
    return active(mem).orderBy(F.desc("created_at"), "id").limit(int(cfg.profile_scan_limit))


def sections(mem: DataFrame, now: int, cfg: Config) -> DataFrame:
    """(section, position, text): long-term facts and preferences (and all pinned ones), and recent episodes.

    A text that already has a place, by normal form, is passed over; one that found its section full is not remembered, so a
    later copy may still enter the other section. That makes it a fold, over rows bounded by the scan limit.
    """
    p = cfg.tag_prefix
    m = scan(mem, cfg).select("id", "pinned", "memory_type", "access_count", "updated_at", "created_at", T.normalized("text", p).alias("norm"), T.for_prompt("text", int(cfg.prompt_memory_max_chars), p).alias("shown"), T.is_synthetic("text", p).alias("syn"))
    m = m.where("not syn and norm <> '' and shown <> ''")
    long = F.col("pinned") | F.col("memory_type").isin("fact", "preference")
    recent = (F.col("memory_type") == "episode") & (F.lit(now) - F.col("created_at") < int(cfg.recent_window_days) * DAY)
    m = m.withColumn("long", long).withColumn("recent", recent).where("long or recent")
    m = m.withColumn("rk", F.row_number().over(Window.orderBy(*priority())))
    items = m.agg(F.array_sort(F.collect_list(F.struct("rk", "norm", "shown", "long", "recent"))).alias("items"))
    nl, nr = int(cfg.max_long_term_items), int(cfg.max_recent_items)
    fold = f"""aggregate(items, struct(cast(array() as array<string>) as l, cast(array() as array<string>) as r, cast(array() as array<string>) as seen), (a, x) -> CASE
      WHEN array_contains(a.seen, x.norm) THEN a
      WHEN x.long AND size(a.l) < {nl} THEN struct(concat(a.l, array(x.shown)) as l, a.r as r, concat(a.seen, array(x.norm)) as seen)
      WHEN x.recent AND size(a.r) < {nr} THEN struct(a.l as l, concat(a.r, array(x.shown)) as r, concat(a.seen, array(x.norm)) as seen)
      ELSE a END)"""
    f = items.select(F.expr(fold).alias("f"))
    one = lambda s, c: f.select(F.lit(s).alias("section"), F.posexplode(f"f.{c}").alias("position", "text"))
    return one("longTerm", "l").unionByName(one("recent", "r"))


def cache_rows(built: DataFrame, now: int) -> DataFrame:
    """(profile_type, content, updated_at): the sections as JSON arrays."""
    kinds = built.sparkSession.createDataFrame([("longTerm",), ("recent",)], "profile_type string")
    g = built.groupBy(F.col("section").alias("profile_type")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]).alias("items"))
    return kinds.join(g, "profile_type", "left").select("profile_type", F.to_json(F.coalesce("items", F.array().cast("array<string>"))).alias("content"), F.lit(now).cast("long").alias("updated_at"))


def from_cache(cache: DataFrame) -> DataFrame:
    return cache.select("profile_type", F.posexplode(F.from_json("content", "array<string>")).alias("position", "text"))


def stale(cache_updated_at: int | None, interactions: int, now: int, cfg: Config, ttl: int = 3_600_000) -> bool:
    """Whether a build is due: none yet, a multiple of the frequency, or older than the time to live."""
    return cache_updated_at is None or interactions % int(cfg.profile_frequency) == 0 or now - cache_updated_at > ttl


def markdown(built: DataFrame) -> DataFrame:
    """(text): the profile for a prompt; a section without items has no heading."""
    g = built.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: F.concat(F.lit("- "), s["text"])), "\n").alias("t"))
    head = F.when(F.col("section") == "longTerm", F.lit("## User Profile (Long-term)\n")).otherwise(F.lit("\n## Recent Context\n"))
    return g.select("section", F.concat(head, "t").alias("t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "t"))), lambda s: s["t"]), "\n").alias("text"))
