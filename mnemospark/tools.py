"""The engine's surface for applications: search, store, forget, profile, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.config import Config
from mnemospark.functions import text as T
from mnemospark.operators import profile, retention, search
from mnemospark.operators import tables as S
from mnemospark.sources.store import Store
from mnemospark.streaming.capture import store_batch

# What forgetting by query looks at.
FORGET_RESULTS, FORGET_MIN, FORGET_SURE = 5, 0.5, 0.8


class Memory:
    """One store with its settings. `now` is always given, never read from a clock."""

    def __init__(self, store: Store, cfg: Config | None = None, dims: int = 64, embedder: object | None = None):
        self.store, self.cfg, self.dims, self.embedder = store, cfg or Config(), dims, embedder

    def _queries(self, texts: list[str]) -> DataFrame:
        vec = self.embedder.embed(texts) if self.embedder else [None] * len(texts)
        return self.store.spark.createDataFrame([(i, t, None if v is None else [float(x) for x in v]) for i, (t, v) in enumerate(zip(texts, vec))], "query_id long, text string, vector array<double>")

    def search(self, texts: list[str], limit: int | None = None, min_score: float | None = None) -> DataFrame:
        m = S.memories(self.store.read("memories"))
        return search.hybrid(m, self._queries(texts), S.edges(self.store.read("relationships")), self.cfg, self.dims, limit, min_score, with_vectors=self.embedder is not None)

    def search_text(self, text: str, limit: int | None = None) -> str:
        """The hits of one text as numbered lines with their share of certainty."""
        hits = self.search([text], limit).join(self.store.read("memories").select("id", "text", "memory_type"), "id").orderBy("position").collect()
        return "\n".join(f"{i}. [{r['memory_type']}] {r['text']} ({round(r['score'] * 100)}%)" for i, r in enumerate(hits, 1)) or "No memories found."

    def touch(self, ids: list[str], now: int) -> None:
        """Note that memories were looked at: rows of the access log, which fold() adds to the counters."""
        self.store.begin()
        self.store.commit(access_log=self.store.read("access_log").unionByName(self.store.spark.createDataFrame([(i, now) for i in ids], "id string, at long")))

    def fold(self) -> None:
        """Put the access log into the counters and empty it."""
        self.store.begin()
        log = self.store.read("access_log")
        self.store.commit(memories=retention.bump(S.memories(self.store.read("memories")), log), access_log=log.limit(0))

    def sign(self, provider: str, model: str, now: int) -> None:
        """Record which embedding space the vectors belong to; vectors of another one are voided in the same commit."""
        self.store.begin()
        same = self.store.signature_matches(provider, model, self.dims)
        old = self.store.read("embedding_signature")
        row = self.store.spark.createDataFrame([("memories", provider, model, self.dims, now)], old.schema)
        self.store.commit(embedding_signature=retention.upsert_latest(old, row, "scope"), memories=retention.reconcile_signature(S.memories(self.store.read("memories")), same))

    def remember(self, texts: list[str], now: int, memory_type: str = "fact") -> None:
        new = self.store.spark.createDataFrame([(f"{i:06d}", t, memory_type, None) for i, t in enumerate(texts)], "seq string, text string, memory_type string, expires_at long")
        store_batch(self.store, new, now, self.cfg, self.embedder, self.dims)

    def forget_ids(self, ids: list[str]) -> None:
        spark = self.store.spark
        d = spark.createDataFrame([(i,) for i in ids], "id string").where(T.is_uuid("id") | F.col("id").rlike("^[0-9a-f]{64}$"))
        mem, men, rel = retention.delete(d, S.memories(self.store.read("memories")), self.store.read("entity_mentions"), self.store.read("relationships"))
        self.store.commit(memories=mem, entity_mentions=men, relationships=rel)

    def forget(self, text: str, inclusive: bool = False) -> list[tuple[str, float]]:
        """Delete the one memory that a text surely means; otherwise return the candidates. inclusive: the bound itself is sure."""
        hits = [(r["id"], r["score"]) for r in self.search([text], FORGET_RESULTS, FORGET_MIN).orderBy("position").collect()]
        sure = len(hits) == 1 and (hits[0][1] >= FORGET_SURE if inclusive else hits[0][1] > FORGET_SURE)
        if sure:
            self.forget_ids([hits[0][0]])
            return []
        return hits

    def profile(self, now: int, interactions: int = 1) -> DataFrame:
        """(profile_type, position, text): from the cache while it is fresh, else rebuilt and cached."""
        cache = self.store.read("profile_cache")
        at = cache.agg(F.max("updated_at")).first()[0]
        if profile.stale(at, interactions, now, self.cfg):
            built = profile.sections(S.memories(self.store.read("memories")), now, self.cfg)
            self.store.commit(profile_cache=profile.cache_rows(built, now))
        return profile.from_cache(self.store.read("profile_cache"))

    def status(self) -> dict[str, object]:
        m = S.memories(self.store.read("memories"))
        n = S.stats(m, S.entities(self.store.read("entities")), S.edges(self.store.read("relationships"))).first().asDict()
        v = S.vector_stats(m, m.where(F.size("vector") == self.dims)).first().asDict()
        return n | v | {"mode": search.mode(self.cfg.embedding, self.embedder is not None, self.cfg.graph_weight)}
