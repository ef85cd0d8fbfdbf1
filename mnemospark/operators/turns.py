"""Conversation turns: last turn, rounds, capture text, event guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.session import lookup

# Fixed values.
SKIPPED_PROVIDERS = ("exec-event", "cron-event", "heartbeat")


def scope(session_key: str, session_id: str, run_id: str) -> Column:
    """The first of the three that is not empty."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in (session_key, session_id, run_id)])


def helper_session(c: str, prefix: str = "memory") -> Column:
    return F.coalesce(F.col(c).contains(f":subagent:{prefix}:"), F.lit(False))


def recall_guard(enabled: bool, prompt: str, session_key: str, provider: str, prefix: str = "memory") -> Column:
    return F.lit(enabled) & ~helper_session(session_key, prefix) & ~F.coalesce(F.col(provider).isin(*SKIPPED_PROVIDERS), F.lit(False)) & (F.length(F.coalesce(prompt, F.lit(""))) >= 5)


def capture_guard(enabled: bool, success: str, messages: str, session_key: str, provider: str, prefix: str = "memory") -> Column:
    return F.lit(enabled) & F.coalesce(F.col(success), F.lit(False)) & (F.size(messages) > 0) & ~helper_session(session_key, prefix) & ~F.coalesce(F.col(provider).isin(*SKIPPED_PROVIDERS), F.lit(False))


def last_turn(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text): from the last user row of each conversation on; all rows where there is none."""
    at = turns.where("role = 'user'").groupBy(F.col("conv").alias("lconv")).agg(F.max("turn").alias("at"))
    return lookup(turns, "conv", at, "lconv", "left").where("at is null or turn >= at").drop("at")


def rounds(turns: DataFrame) -> DataFrame:
    """turns with round, counted from 0: a user row and an assistant row directly after it are one; any other row is its own."""
    w = Window.partitionBy("conv").orderBy("turn")
    start = ~((F.col("role") == "assistant") & (F.lag("role").over(w) == "user"))
    return turns.withColumn("round", F.sum(F.coalesce(start, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def round_blocks(r: DataFrame, base: str) -> DataFrame:
    """(conv, round, at, text): the text of each round under its date, and its time, one second apart."""
    line = F.concat("role", F.lit(": "), "text")
    g = r.groupBy("conv", "round", base).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(base) / 86_400_000).cast("int")).cast("string")
    return g.select("conv", "round", (F.col(base) + 1000 * F.col("round")).alias("at"), F.concat(F.lit("Session Date: "), day, F.lit("\nRound Content:\n"), "lines").alias("text"))


def capture_text(turns: DataFrame, most: int = 2000, least: int = 10, prefix: str = "memory") -> DataFrame:
    """(conv, text): the last turn as role blocks, texts of fewer than `least` characters left out, cut at `most`."""
    t = last_turn(turns).where("role in ('user', 'assistant')").withColumn("clean", T.strip_injected("text", prefix)).where(F.length("clean") >= least)
    block = F.concat(F.lit("[role: "), "role", F.lit("]\n"), "clean", F.lit("\n["), "role", F.lit(":end]"))
    return t.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("text")).select("conv", F.substring("text", 1, most).alias("text"))


def latest_assistant(turns: DataFrame) -> DataFrame:
    """(conv, text): the last assistant text that is not empty."""
    return turns.where("role = 'assistant' and text <> ''").groupBy("conv").agg(F.max_by("text", "turn").alias("text"))


def first_per_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """The first row of every group, and the first abstention (id ending in _abs) of all."""
    w = Window.partitionBy(group).orderBy(order)
    a = df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    b = df.where(F.col(order).endswith("_abs")).orderBy(order).limit(1)
    return a.unionByName(b).distinct()
