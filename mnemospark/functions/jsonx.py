"""Coercion of JSON that a language model wrote: what does not fit is dropped, never repaired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.text import col

# Fixed values.
MEMORY_TYPES, RELATIONS, DECISIONS = ("fact", "preference", "episode"), ("updates", "related", "none"), ("same", "different")


def _items(c: str | Column, most: int | None = None) -> Column:
    """The elements of a JSON array as variants, the first `most`; null where it is no array."""
    v = F.try_parse_json(col(c))
    a = F.try_variant_get(v, "$", "array<variant>")
    return a if most is None else F.slice(a, 1, most)


def _string(v: Column, field: str) -> Column:
    """A field that is a string; numbers and the like do not count as one."""
    s = F.try_variant_get(v, f"$.{field}", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    return F.when(kind == "STRING", s)


def extraction(c: str | Column, most: int = 10, least_chars: int = 10, most_chars: int = 500) -> Column:
    """array<struct<text, memory_type, entities array<struct<mention, kind>>, expires_at_iso>>; null where there is no array.

    Only the first `most` elements are looked at. An element needs a text of the right length and a known type. Only episodes
    keep an expiry, and only one that can be read.
    """
    from mnemospark.functions.text import iso_normal, trim_all

    def mention(e: Column) -> Column:
        m, k = trim_all(_string(e, "mention")), trim_all(_string(e, "kind"))
        return F.struct(m.alias("mention"), F.when(k != "", k).alias("kind"))

    def item(v: Column) -> Column:
        t, kind = trim_all(_string(v, "text")), _string(v, "memoryType")
        es = F.coalesce(F.try_variant_get(v, "$.entities", "array<variant>"), F.array().cast("array<variant>"))
        return F.struct(t.alias("text"), F.when(kind.isin(*MEMORY_TYPES), kind).alias("memory_type"), F.filter(F.transform(es, mention), lambda x: x["mention"] != "").alias("entities"), F.when(kind == "episode", iso_normal(_string(v, "expiresAtIso"))).alias("expires_at_iso"))

    got = F.transform(_items(c, most), item)
    return F.filter(got, lambda x: F.coalesce(F.length(x["text"]).between(least_chars, most_chars), F.lit(False)) & x["memory_type"].isNotNull())


def relations(c: str | Column) -> Column:
    """array<struct<target_id, relation_type>> of the valid elements."""
    got = F.transform(_items(c), lambda v: F.struct(_string(v, "targetId").alias("target_id"), _string(v, "relationType").alias("relation_type")))
    return F.filter(got, lambda x: F.coalesce((x["target_id"] != "") & x["relation_type"].isin(*RELATIONS), F.lit(False)))


def merge_decisions(c: str | Column) -> Column:
    """array<struct<left_id, right_id, decision>> of the valid elements."""
    got = F.transform(_items(c), lambda v: F.struct(_string(v, "leftEntityId").alias("left_id"), _string(v, "rightEntityId").alias("right_id"), _string(v, "decision").alias("decision")))
    return F.filter(got, lambda x: F.coalesce((x["left_id"] != "") & (x["right_id"] != "") & x["decision"].isin(*DECISIONS), F.lit(False)))


def first_object(c: str | Column) -> Column:
    """From the first { to the last }, if that parses; else null."""
    s = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(s).isNotNull(), s)


def content_texts(c: str | Column) -> Column:
    """Texts of a message's content: a JSON string, or an array of blocks of which those of type text count."""
    v = F.try_parse_json(col(c))
    blocks = F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), lambda b: F.coalesce((_string(b, "type") == "text") & _string(b, "text").isNotNull(), F.lit(False)))
    return F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.transform(blocks, lambda b: _string(b, "text")))


def keep_known_targets(decisions: Column, known: Column) -> Column:
    """Decisions about candidates that were asked for, with at most one update, the first."""
    d = F.filter(decisions, lambda x: F.array_contains(known, x["target_id"]))
    first = F.array_position(F.transform(d, lambda x: x["relation_type"]), "updates")
    return F.filter(d, lambda x, i: (x["relation_type"] != "updates") | (i + 1 == first))
