"""Streams: capture of conversation turns, and maintenance, as micro-batches over the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemospark.config import Config
from mnemospark.functions import text as T
from mnemospark.operators import entities, graph, ingest, retention, turns, vectors
from mnemospark.operators import tables as S
from mnemospark.session import cut
from mnemospark.sources.store import Store

#: extract(turns) -> (conv, pos, text, memory_type, expires_at[, mentions]): what is worth keeping of the captured texts (conv, text); mentions: array<struct<mention, kind>>.
Extract = Callable[[DataFrame], DataFrame]
#: relate(candidates) -> (id, other, relation): which of the candidates (id, other, shared, vector_score, position) a new memory updates.
Relate = Callable[[DataFrame], DataFrame]


def plain(captured: DataFrame) -> DataFrame:
    """Without a model: the captured text itself, as a fact."""
    return captured.select("conv", F.lit(0).alias("pos"), "text", F.lit("fact").alias("memory_type"), F.lit(None).cast("long").alias("expires_at"))


def _embedded(store: Store, rows: DataFrame, embedder: object | None, dims: int) -> tuple[DataFrame, DataFrame | None]:
    """rows (id, text) -> (id, vector), and the cache with what was embedded now; null vectors and no cache without an embedder."""
    if embedder is None:
        return rows.select("id", F.lit(None).cast("array<double>").alias("vector")), None
    cache = store.read("embedding_cache")
    name = type(embedder).__name__
    v = cut(vectors.embed(rows, cache, embedder, name, getattr(embedder, "model", name), dims))
    new = v.where("vector is not null").select("hash", "vector").dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")
    return v.select("id", "vector"), cache.unionByName(new.select("hash", "vector", F.lit(0).cast("long").alias("created_at")))


def store_batch(store: Store, new: DataFrame, now: int, cfg: Config, embedder: object | None = None, dims: int = 64, relate: Relate | None = None) -> None:
    """new (seq, text, memory_type, expires_at[, mentions]): one transaction: cleaned, embedded, held against the store and among
    themselves, stored, linked to the entities they mention, related to what shares these, and committed together.

    Ids are hashes of text, time and place, so a batch that is run again writes the same rows, and its texts are found as
    duplicates of the first run's. An episode updates nothing; of several updates of one memory the first candidate counts.
    """
    store.begin()
    old = S.memories(store.read("memories"))
    if "mentions" not in new.columns:
        new = new.withColumn("mentions", F.lit(None).cast("array<struct<mention: string, kind: string>>"))
    fresh = cut(new.withColumn("id", F.sha2(F.concat_ws("|", "text", F.lit(str(now)), F.col("seq").cast("string")), 256)))
    clean = fresh.select("id", T.for_storage("text", int(cfg.capture_max_chars), prefix=cfg.tag_prefix).alias("text")).where("text is not null")
    vec, cache = _embedded(store, clean, embedder, dims)
    vec = cut(vec)
    seq = F.struct(F.lit(1).alias("g"), F.col("seq").cast("string").alias("s"), F.col("id").alias("i"))
    both = old.where("not is_superseded").select("id", F.struct(F.lit(0).alias("g"), F.lpad(F.col("created_at").cast("string"), 16, "0").alias("s"), F.col("id").alias("i")).alias("seq"), "text", "vector")
    both = both.unionByName(fresh.join(vec, "id", "left").select("id", seq.alias("seq"), "text", "vector"))
    r = cut(ingest.ingest(both, cfg, dims, new=fresh).join(fresh.drop("text"), "id"))
    kept = cut(r.where("kept").join(vec, "id", "left"))
    rows = kept.select("id", F.col("clean").alias("text"), "vector", "memory_type", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), "expires_at", F.lit(False).alias("is_superseded"), F.lit(False).alias("pinned"), F.lit(None).cast("string").alias("parent_memory_id"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("long").alias("last_accessed_at"))
    dup = r.where("into is not null").select(F.col("into").alias("id"), "seq", "memory_type", F.lit(False).alias("pinned"), "expires_at")
    merged = retention.merge_duplicates(old.unionByName(rows.select(*old.columns)), dup, now)

    tables = {"memories": merged}
    mem = kept.select(F.col("id").alias("owner"), F.posexplode("mentions").alias("pos", "x")).select("owner", "pos", "x.mention", "x.kind")
    if not mem.isEmpty():
        links, al, ent = entities.resolve_or_create(mem, S.aliases(store.read("entity_aliases")), S.entities(store.read("entities")), now)
        mt = S.mentions(store.read("entity_mentions")).select("memory_id", "alias_id").unionByName(links).distinct()
        al, ent, mt = cut(al), cut(ent), cut(mt)
        tables |= {"entity_aliases": al, "entities": ent, "entity_mentions": mt}
        me = cut(graph.canonical_mentions(mt, al, ent))
        live, ask = cut(S.active(merged).select("id", "created_at", "memory_type")), kept.select("id", "memory_type")
        edges = graph.related(me, live, ask, int(cfg.max_related_edges)).select(F.col("id").alias("source_id"), F.col("other").alias("target_id"), F.lit("related").alias("relation_type"), F.lit(now).cast("long").alias("created_at"))
        if relate is not None:
            near = vectors.nearest(merged.select("id", "vector"), kept.select(F.col("id").alias("query_id"), "vector"), 13, dims).where(F.col("query_id") != F.col("id")).where(F.col("score") >= cfg.update_vector_min_score).select(F.col("query_id").alias("id"), F.col("id").alias("other"), "score")
            c = cut(graph.update_candidates(me, live, ask.where("memory_type <> 'episode'"), cut(near)))
            first = F.min_by("other", "position")
            up = cut(relate(c).where("relation = 'updates'").select("id", "other").join(c, ["id", "other"]).groupBy("id").agg(first.alias("other")))
            tables["memories"] = retention.set_parents(merged, up.select("id", F.col("other").alias("parent_memory_id")), now)
            edges = edges.unionByName(up.select(F.col("id").alias("source_id"), F.col("other").alias("target_id"), F.lit("updates").alias("relation_type"), F.lit(now).cast("long").alias("created_at")))
        e = graph.upsert_edges(S.edges(store.read("relationships")), edges)
        tables["relationships"] = e.withColumn("id", F.sha2(F.concat_ws("|", "source_id", "target_id", "relation_type"), 256))
    if cache is not None:
        tables["embedding_cache"] = cache
    store.commit(**tables)


def backfill(store: Store, embedder: object, dims: int = 64, batch: int = 20) -> dict[str, int]:
    """One step: up to `batch` active memories without a vector get one (oldest first). Returns how many, and how many are left to do.

    batch is the operator's own bound for a service that answers between two steps; a batch job passes the number it wants.
    """
    store.begin()
    m = S.memories(store.read("memories"))
    lack = cut(backfill_due(m, batch))
    n = lack.count()
    if n:
        v, cache = _embedded(store, lack, embedder, dims)
        store.commit(memories=retention.set_vectors(m, v), embedding_cache=cache)
    return {"embedded": n, "pending": S.active(S.memories(store.read("memories"))).where("vector is null").count()}


def backfill_due(m: DataFrame, batch: int = 20) -> DataFrame:
    """(id, text): the active memories that the next backfill step embeds."""
    return S.active(m).where("vector is null and text is not null").orderBy("created_at", "id").limit(batch).select("id", "text")


def capture(stream: DataFrame, store: Store, cfg: Config, checkpoint: str, clock: Callable[[], int], extract: Extract = plain, trigger: dict | None = None, embedder: object | None = None, dims: int = 64, relate: Relate | None = None) -> StreamingQuery:
    """stream (conv, turn, role, text): the last turn of each conversation of a micro-batch is captured and stored."""

    def batch(df: DataFrame, _: int) -> None:
        got = turns.capture_text(df, int(cfg.capture_max_chars), prefix=cfg.tag_prefix)
        x = extract(got)
        new = x.select(F.concat_ws("/", F.col("conv").cast("string"), F.lpad(F.col("pos").cast("string"), 6, "0")).alias("seq"), "text", "memory_type", "expires_at", *[c for c in x.columns if c == "mentions"])
        if not new.isEmpty():
            store_batch(store, new, clock(), cfg, embedder, dims, relate)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def maintain(store: Store, now: int, cfg: Config, decide: entities.Decide | None = None, embedder: object | None = None, dims: int = 64) -> dict[str, int]:
    """One cycle: expired and decayed memories go, with their mentions and edges; with decide, likely pairs of entities are merged. Returns how many."""
    store.begin()
    m = S.memories(store.read("memories"))
    days = int(cfg.temporal_decay_days)
    n = retention.sweep_counts(m, now, days).first()
    gone = m.where(F.coalesce(retention.expired(now), F.lit(False)) | F.coalesce(retention.decayed(now, days), F.lit(False))).select("id")
    mem, men, rel = retention.delete(gone, m, store.read("entity_mentions"), store.read("relationships"))
    tables, merged = {"memories": mem, "entity_mentions": men, "relationships": rel}, 0
    if decide is not None:
        ent, al = S.entities(store.read("entities")), S.aliases(store.read("entity_aliases"))
        v = entities.name_vectors(ent, store.read("embedding_cache"), embedder, type(embedder).__name__, getattr(embedder, "model", type(embedder).__name__), dims) if embedder else None
        ent, al, merged = entities.merge_cycle(ent, al, decide, v)
        tables |= {"entities": ent, "entity_aliases": al}
    store.commit(**tables)
    return {"expired": n["expired"], "decayed": n["decayed"]} | ({"merged": merged} if decide is not None else {})


def maintenance(ticks: DataFrame, store: Store, cfg: Config, checkpoint: str, clock: Callable[[], int]) -> StreamingQuery:
    """Run maintain() with every micro-batch of a rate stream; foreachBatch never overlaps itself."""
    every = f"{int(cfg.forget_expired_interval_minutes)} minutes"
    return ticks.writeStream.foreachBatch(lambda df, i: maintain(store, clock(), cfg)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
