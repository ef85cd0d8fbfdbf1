"""Queries over the store's tables, each with the SQL that has to give the same rows.

Everything runs over whole tables; NOW stands for the present.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.config import Config
from mnemospark.functions import jsonx as J
from mnemospark.functions import lexical as L
from mnemospark.functions import text as T
from mnemospark.operators import bm25, entities, graph, ingest, profile, retention, search, turns, vectors
from mnemospark.operators import tables as S
from mnemospark.session import cut, release, table
from mnemospark.streaming.capture import backfill_due

NOW, DECAY_DAYS, LAST_BATCH = 1_782_864_000_000, 90, 8
CFG = Config()

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PRE = """WITH RECURSIVE
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, parent_memory_id NULLS LAST) AS rn FROM memories WHERE id IS NOT NULL) WHERE rn = 1),
e AS (SELECT id, min(canonical_name) AS canonical_name, min(kind) AS kind, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(merged_into_id) AS merged_into_id FROM entities WHERE id IS NOT NULL GROUP BY id),
al AS (SELECT id, min(entity_id) AS entity_id, min(surface_text) AS surface_text, min(normalized_text) AS normalized_text, min(kind) AS kind, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM entity_aliases WHERE id IS NOT NULL GROUP BY id),
mt AS (SELECT DISTINCT memory_id, alias_id FROM entity_mentions WHERE memory_id IS NOT NULL AND alias_id IS NOT NULL),
rel AS (SELECT source_id, target_id, lower(relation_type) AS relation_type, min({'c': created_at, 'i': id}) AS x FROM relationships WHERE source_id <> target_id AND lower(relation_type) IN ('updates', 'related') GROUP BY ALL),
cm AS (SELECT DISTINCT mt.memory_id, al.entity_id FROM mt JOIN al ON al.id = mt.alias_id JOIN e ON e.id = al.entity_id WHERE e.merged_into_id IS NULL),
arr AS (SELECT memory_id AS id, min(arrived_at) AS at, arg_min(batch_no, arrived_at) AS batch FROM ingest_log GROUP BY memory_id)
"""
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None, pre: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = (PRE if pre else "") + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


class _Store:
    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def raw(self, name: str) -> DataFrame:
        return S.read(self.spark, self.d, name)

    def mem(self, *cols: str) -> DataFrame:
        need = {"id", "updated_at", "created_at", "parent_memory_id", *cols}
        return S.memories(self.raw("memories").select(*[c for c in self.raw("memories").columns if c in need] if cols else self.raw("memories").columns))

    def ent(self) -> DataFrame:
        return S.entities(self.raw("entities"))

    def al(self) -> DataFrame:
        return S.aliases(self.raw("entity_aliases"))

    def mt(self) -> DataFrame:
        return S.mentions(self.raw("entity_mentions"))

    def rel(self) -> DataFrame:
        return S.edges(self.raw("relationships"))

    def cm(self) -> DataFrame:
        return graph.canonical_mentions(self.mt(), self.al(), self.ent())

    def arrivals(self) -> DataFrame:
        return self.raw("ingest_log").groupBy(F.col("memory_id").alias("id")).agg(F.min("arrived_at").alias("at"), F.min_by("batch_no", "arrived_at").alias("batch"))


# Scans


@query("sc1_point_lookup", "SELECT id, text, memory_type, created_at FROM m WHERE id = (SELECT min(id) FROM memories)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    first = s.raw("memories").agg(F.min("id").alias("id"))
    return s.mem("text", "memory_type").join(F.broadcast(first), "id").select("id", "text", "memory_type", "created_at")


@query("sc2_multi_get", f"SELECT strftime(w.arrived_at, '%Y-%m-%d %H:%M:%S') AS pos, m.id, m.text FROM ingest_log w JOIN m ON m.id = w.memory_id WHERE w.batch_no = {LAST_BATCH}")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    w = s.raw("ingest_log").where(F.col("batch_no") == LAST_BATCH).withColumn("pos", F.date_format(F.col("arrived_at").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"))
    return S.multi_get(s.mem("text"), w, "pos", "memory_id").select("pos", "id", "text")


@query("sc3_active_page", "SELECT id, created_at FROM m WHERE NOT is_superseded ORDER BY created_at DESC, id LIMIT 100 OFFSET 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.active_page(_Store(spark, d).mem("is_superseded"), 100, 100).select("id", "created_at")


@query("sc4_missing_vectors", "SELECT id, created_at FROM m WHERE NOT is_superseded AND vector IS NULL ORDER BY created_at, id LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.missing_vectors(_Store(spark, d).mem("is_superseded", "vector")).select("id", "created_at")


@query("sc5_canonical_entities", "SELECT id, canonical_name, last_seen FROM e WHERE merged_into_id IS NULL ORDER BY last_seen DESC, id LIMIT 200")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.canonical_page(_Store(spark, d).ent()).select("id", "canonical_name", "last_seen")


@query("sc6_entities_by_id", "SELECT e.id, e.canonical_name, e.merged_into_id FROM e JOIN (SELECT DISTINCT merged_into_id AS id FROM entities) t ON t.id = e.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    return s.ent().join(s.raw("entities").select(F.col("merged_into_id").alias("id")).distinct(), "id", "left_semi").select("id", "canonical_name", "merged_into_id")


@query("sc7_ranked_aliases", f"SELECT id, entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY last_seen DESC, {_FOLD.format('surface_text')}, id) AS INTEGER) AS position FROM al")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked_aliases(_Store(spark, d).al()).select("id", "entity_id", "position")


@query("sc8_edges_touching", "SELECT source_id AS node, x.i AS id, target_id AS other, relation_type, x.c AS created_at FROM rel UNION ALL SELECT target_id, x.i, source_id, relation_type, x.c FROM rel")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.touching(_Store(spark, d).rel())


@query("sc15_disabled_embedder", "SELECT id, 64 AS dims, 0.0::DOUBLE AS largest FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem().select("id", F.size(vectors.zeros(64)).alias("dims"), F.array_max(vectors.zeros(64)).alias("largest"))


@query("sc18_uri_read", "SELECT m.id, m.text FROM m JOIN (SELECT DISTINCT target_id AS id FROM relationships) r ON r.id = m.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    uri = s.raw("relationships").select(F.concat(F.lit("memory://"), "target_id").alias("uri")).distinct()
    return uri.select(T.uri_id("uri").alias("id")).join(s.mem("text"), "id").select("id", "text")


# Predicates


@query("pf1_active_count", "SELECT count(*) AS n, count(*) FILTER (WHERE vector IS NULL) AS without_vector FROM m WHERE NOT is_superseded")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.active(_Store(spark, d).mem("is_superseded", "vector")).agg(F.count("*").alias("n"), F.count_if(F.col("vector").isNull()).alias("without_vector"))


@query(
    "pf2_exact_match",
    f"""SELECT id, key FROM (SELECT id, {_FOLD.format("trim(text, ' ')")} AS key, row_number() OVER (PARTITION BY {_FOLD.format("trim(text, ' ')")} ORDER BY created_at DESC, id) AS k FROM m WHERE NOT is_superseded AND text IS NOT NULL) x
WHERE k = 1 AND key IN (SELECT {_FOLD.format("trim(text, ' ')")} FROM m JOIN arr ON arr.id = m.id WHERE arr.batch > 0)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = s.mem("text", "is_superseded")
    return S.exact_matches(m, m.join(s.arrivals().where("batch > 0"), "id")).select("id", "key")


@query("pf3_expired", f"SELECT id FROM m WHERE expires_at < {NOW}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem("expires_at").where(retention.expired(NOW)).select("id")


@query("pf4_decayed", f"SELECT id FROM m WHERE memory_type = 'episode' AND access_count = 0 AND created_at < {NOW - DECAY_DAYS * 86_400_000} AND NOT is_superseded AND NOT pinned")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem("memory_type", "access_count", "is_superseded", "pinned").where(retention.decayed(NOW, DECAY_DAYS)).select("id")


@query("pf7_uuid_guard", "SELECT id, regexp_matches(id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AS ok FROM (SELECT id FROM m UNION ALL SELECT message_id FROM documents WHERE message_id IS NOT NULL)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    return s.mem().select("id").unionByName(s.raw("documents").select(F.col("message_id").alias("id")).where("id is not null")).select("id", T.is_uuid("id").alias("ok"))


_EV = "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'a:subagent:memory:b' ELSE 'main' END AS session_key, CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'chat' END AS provider, CASE WHEN value > 50 THEN props ELSE 'hi' END AS prompt, event_type <> 'view' AS success FROM events"


def _hook_events(spark: SparkSession, d: str) -> DataFrame:
    e = S.read(spark, d, "events")
    return e.select("event_id", F.when(F.col("event_type") == "error", "a:subagent:memory:b").otherwise("main").alias("session_key"), F.when(F.col("event_type") == "signup", "heartbeat").otherwise("chat").alias("provider"), F.when(F.col("value") > 50, F.col("props")).otherwise("hi").alias("prompt"), (F.col("event_type") != "view").alias("success"), F.array("props").alias("messages"))


@query("pf8_recall_guard", f"SELECT event_id FROM ({_EV}) WHERE NOT contains(session_key, ':subagent:memory:') AND provider NOT IN ('exec-event', 'cron-event', 'heartbeat') AND length(prompt) >= 5", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _hook_events(spark, d).where(turns.recall_guard(True, "prompt", "session_key", "provider")).select("event_id")


@query("pf9_capture_guard", f"SELECT event_id FROM ({_EV}) WHERE success AND NOT contains(session_key, ':subagent:memory:') AND provider NOT IN ('exec-event', 'cron-event', 'heartbeat')", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _hook_events(spark, d).where(turns.capture_guard(True, "success", "messages", "session_key", "provider")).select("event_id")


@query("pf11_scope_key", "SELECT doc_id, coalesce(nullif(trim(in_reply_to), ''), nullif(trim(message_id), ''), nullif(trim(mailbox), '')) AS scope FROM documents", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "documents").select("doc_id", turns.scope("in_reply_to", "message_id", "mailbox").alias("scope"))


# Joins and aggregates


@query("jn5_memory_mentions", f"SELECT mt.memory_id, al.surface_text, e.canonical_name, CAST(row_number() OVER (PARTITION BY mt.memory_id ORDER BY {_FOLD.format('al.surface_text')}, al.id) AS INTEGER) AS position FROM mt JOIN al ON al.id = mt.alias_id JOIN e ON e.id = al.entity_id WHERE e.merged_into_id IS NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    from mnemospark.session import lookup

    s = _Store(spark, d)
    a = s.al().join(s.ent().where("merged_into_id is null").select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id").select("id", "surface_text", "canonical_name")
    j = lookup(s.mt(), "alias_id", a.withColumnRenamed("id", "aid"), "aid", "inner")
    w = Window.partitionBy("memory_id").orderBy(T.nocase("surface_text"), "alias_id")
    return j.select("memory_id", "surface_text", "canonical_name", F.row_number().over(w).alias("position"))


@query("jn6_memory_entities", "SELECT memory_id, entity_id FROM cm")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).cm()


@query("jn7_entity_memories", "SELECT DISTINCT al.entity_id, m.id FROM mt JOIN al ON al.id = mt.alias_id JOIN e ON e.id = al.entity_id JOIN m ON m.id = mt.memory_id WHERE NOT m.is_superseded")
def _(spark: SparkSession, d: str) -> DataFrame:
    from mnemospark.session import lookup

    s = _Store(spark, d)
    a = s.al().join(s.ent().select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(F.col("id").alias("aid"), "entity_id")
    j = lookup(s.mt(), "alias_id", a, "aid", "inner")
    return j.select("entity_id", F.col("memory_id").alias("id")).distinct().join(S.active(s.mem("is_superseded")).select("id"), "id").select("entity_id", "id")


@query(
    "jn8_alias_lookup",
    """SELECT k.key, a.alias_id, a.entity_id FROM (SELECT DISTINCT normalized_text AS key FROM al) k LEFT JOIN
(SELECT al.normalized_text AS key, min({'i': al.id, 'e': al.entity_id}).i AS alias_id, min({'i': al.id, 'e': al.entity_id}).e AS entity_id FROM al JOIN e ON e.id = al.entity_id WHERE e.merged_into_id IS NULL GROUP BY al.normalized_text) a ON a.key = k.key WHERE k.key IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    al = s.al()
    m = al.select(F.lit("x").alias("owner"), F.col("normalized_text").alias("key"), F.col("normalized_text").alias("mention")).where("key is not null").distinct()
    return ingest.resolve_aliases(m, al, s.ent()).select("key", "alias_id", "entity_id")


@query(
    "jn11_related_edges",
    """SELECT id, other, shared, position FROM (SELECT a.memory_id AS id, b.memory_id AS other, CAST(count(*) AS INTEGER) AS shared, CAST(row_number() OVER (PARTITION BY a.memory_id ORDER BY count(*) DESC, max(o.created_at) DESC, b.memory_id) AS INTEGER) AS position
FROM cm a JOIN m s ON s.id = a.memory_id JOIN cm b ON b.entity_id = a.entity_id AND b.memory_id <> a.memory_id JOIN m o ON o.id = b.memory_id AND NOT o.is_superseded GROUP BY a.memory_id, b.memory_id) WHERE position <= 5""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = cut(s.mem("is_superseded"))
    return graph.related(cut(s.cm()), S.active(m).select("id", "created_at"), m.select("id"), 5)


_KNN = "q AS (SELECT m.id AS query_id, m.vector AS qv, m.memory_type, m.text FROM m JOIN arr ON arr.id = m.id WHERE arr.batch = {b}), good AS (SELECT id, vector FROM m WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0), knn AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS position FROM (SELECT q.query_id, g.id, list_cosine_similarity(q.qv, g.vector) AS score FROM (SELECT * FROM q JOIN good USING (id)) q, good g))".replace("SELECT * FROM q JOIN good USING (id)", "SELECT q.* FROM q JOIN good ON good.id = q.query_id").format(b=LAST_BATCH)


@query(
    "jn12_update_candidates",
    f""", {_KNN}, near AS (SELECT query_id AS id, id AS other, score FROM knn WHERE position <= 17 AND id <> query_id AND score >= 0.55),
c AS (SELECT a.memory_id AS id, b.memory_id AS other, count(*) AS shared, 0.0::DOUBLE AS vs FROM cm a JOIN cm b ON b.entity_id = a.entity_id AND b.memory_id <> a.memory_id WHERE a.memory_id IN (SELECT query_id FROM q) GROUP BY 1, 2 UNION ALL SELECT id, other, 0, score FROM near),
g AS (SELECT c.id, c.other, sum(shared) AS shared, max(vs) AS vector_score FROM c GROUP BY 1, 2),
r AS (SELECT g.*, row_number() OVER (PARTITION BY g.id ORDER BY shared DESC, round(vector_score, 9) DESC, o.created_at DESC, other) AS position FROM g JOIN m s ON s.id = g.id JOIN m o ON o.id = g.other WHERE NOT o.is_superseded AND o.memory_type = s.memory_type)
SELECT id, other, CAST(shared AS INTEGER) AS shared, CAST(round(vector_score, 6) AS DOUBLE) AS vector_score, CAST(position AS INTEGER) AS position FROM r WHERE position <= 12""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = cut(s.mem("is_superseded", "memory_type", "vector"))
    ask = m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select("id", "memory_type", "vector")
    near = vectors.nearest(m, ask.select(F.col("id").alias("query_id"), "vector"), 17).where("query_id <> id and score >= 0.55").select(F.col("query_id").alias("id"), F.col("id").alias("other"), "score")
    c = graph.update_candidates(cut(s.cm()), S.active(m).select("id", "created_at", "memory_type"), cut(ask.select("id", "memory_type")), cut(near))
    return c.withColumn("vector_score", F.round("vector_score", 6))


@query("jn13_merge_pairs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_pairs(_Store(spark, d).ent())


@query("ag3_stats", "SELECT (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m WHERE NOT is_superseded) AS active, (SELECT count(*) FROM m WHERE is_superseded) AS superseded, (SELECT count(*) FROM e WHERE merged_into_id IS NULL) AS entities, (SELECT count(*) FROM rel) AS relationships")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    return S.stats(s.mem("is_superseded"), s.ent(), s.rel())


@query("ag4_vector_stats", "SELECT count(*) FILTER (WHERE len(vector) = 64) AS indexed, count(*) FILTER (WHERE vector IS NULL) AS missing_vectors, count(*) FILTER (WHERE len(vector) <> 64) AS missing_index_rows, count(*) FILTER (WHERE vector IS NULL OR len(vector) <> 64) AS pending FROM m WHERE NOT is_superseded")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = _Store(spark, d).mem("is_superseded", "vector")
    return S.vector_stats(m, m.where("size(vector) = 64"))


@query("ag9_totals_by_type", "SELECT memory_type, count(*) AS n, CAST(sum(access_count) AS BIGINT) AS accesses FROM m GROUP BY memory_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem("memory_type", "access_count").groupBy("memory_type").agg(F.count("*").alias("n"), F.sum("access_count").alias("accesses"))


@query("ag11_relation_tally", "SELECT relation_type, count(*) AS n FROM rel GROUP BY relation_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).rel().groupBy("relation_type").agg(F.count("*").alias("n"))


@query("ag12_sweep_counts", f"SELECT count(*) FILTER (WHERE x) AS expired, count(*) FILTER (WHERE NOT x AND y) AS decayed FROM (SELECT coalesce(expires_at < {NOW}, false) AS x, memory_type = 'episode' AND access_count = 0 AND created_at < {NOW - DECAY_DAYS * 86_400_000} AND NOT is_superseded AND NOT pinned AS y FROM m)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retention.sweep_counts(_Store(spark, d).mem("expires_at", "memory_type", "access_count", "is_superseded", "pinned"), NOW, DECAY_DAYS)


# Graph


@query("gr1_hops", f", s AS (SELECT source_id AS a, target_id AS b FROM rel UNION SELECT target_id, source_id FROM rel), w(seed, id, hop) AS (SELECT id, id, 0 FROM arr WHERE batch = {LAST_BATCH} UNION SELECT w.seed, s.b, w.hop + 1 FROM w JOIN s ON s.a = w.id WHERE w.hop < 2) SELECT seed, id, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY seed, id HAVING min(hop) > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    return graph.hops(s.rel(), s.arrivals().where(F.col("batch") == LAST_BATCH).select("id"), 2)


@query(
    "gr2_edge_upsert",
    f""", o AS (SELECT source_id, target_id, relation_type, x.c AS created_at FROM rel WHERE x.c < {NOW - 200 * 86_400_000}), n AS (SELECT source_id, target_id, relation_type, x.c AS created_at FROM rel)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source_id = n.source_id AND o.target_id = n.target_id AND o.relation_type = n.relation_type)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    r = cut(_Store(spark, d).rel())
    return graph.upsert_edges(r.where(F.col("created_at") < NOW - 200 * 86_400_000), r)


@query(
    "gr6_merge_groups",
    """, p AS (SELECT DISTINCT x.id AS a, x.merged_into_id AS b FROM entities x JOIN e ON e.id = x.merged_into_id WHERE x.id <> x.merged_into_id), s AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b) SELECT r.a AS id, min({'f': e.first_seen, 'i': e.id}).i AS survivor FROM r JOIN e ON e.id = r.b GROUP BY r.a""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    ent = cut(s.ent())
    p = s.raw("entities").select(F.col("id").alias("left_id"), F.col("merged_into_id").alias("right_id")).where("left_id <> right_id").distinct()
    return graph.merge_groups(p.join(ent.select(F.col("id").alias("right_id")), "right_id", "left_semi"), ent)


@query("gr10_superseded", "SELECT DISTINCT target_id AS id FROM rel WHERE relation_type = 'updates'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.superseded_by(_Store(spark, d).rel())


@query(
    "gr11_set_parents",
    f"""SELECT m.id, coalesce(p.np, m.parent_memory_id) AS parent_memory_id, m.is_superseded OR s.sid IS NOT NULL AS is_superseded, CASE WHEN p.np IS NOT NULL OR s.sid IS NOT NULL THEN {NOW} ELSE m.updated_at END AS updated_at
FROM m LEFT JOIN (SELECT source_id, max(target_id) AS np FROM rel WHERE relation_type = 'updates' GROUP BY source_id) p ON p.source_id = m.id LEFT JOIN (SELECT DISTINCT np AS sid FROM (SELECT source_id, max(target_id) AS np FROM rel WHERE relation_type = 'updates' GROUP BY source_id)) s ON s.sid = m.id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    new = s.rel().where("relation_type = 'updates'").select(F.col("source_id").alias("id"), F.col("target_id").alias("parent_memory_id"))
    return retention.set_parents(s.mem("is_superseded"), new, NOW).select("id", "parent_memory_id", "is_superseded", "updated_at")


# Keyword retrieval

_TOK = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(docs: str, qs: str, limit: int) -> str:
    return f""", docs AS MATERIALIZED ({docs}), tk AS MATERIALIZED (SELECT id, kept, {_TOK.format("coalesce(text, '')")} AS toks FROM docs), ln AS MATERIALIZED (SELECT id, kept, len(toks) AS dl, ' ' || array_to_string(toks, '  ') || ' ' AS line FROM tk),
qs AS ({qs}), qt AS (SELECT query_id, {_TOK.format('t')} AS p FROM (SELECT query_id, unnest(regexp_split_to_array(replace(replace(text, '"', ''), chr(39), ''), '\\s+')) AS t FROM qs)),
ph AS (SELECT query_id, p, ' ' || array_to_string(p, '  ') || ' ' AS needle, count(*) AS times FROM qt WHERE len(p) > 0 GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM ln),
hit AS MATERIALIZED (SELECT x.p, ln.id, ln.kept, ln.dl, (length(line) - length(replace(line, needle, ''))) / length(needle) AS tf FROM (SELECT DISTINCT p, needle FROM ph) x JOIN ln ON contains(ln.line, x.needle)),
dfs AS (SELECT p, count(*) AS df FROM hit GROUP BY p),
sc AS (SELECT ph.query_id, hit.id, -sum(times * greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM ph JOIN hit ON hit.p = ph.p JOIN dfs ON dfs.p = ph.p CROSS JOIN st WHERE hit.kept GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), id) AS position FROM sc),
top AS (SELECT *, abs(rank) / max(abs(rank)) OVER (PARTITION BY query_id) AS score FROM rk WHERE position <= {limit})"""


@query("ft3_bm25_documents", _bm25_sql("SELECT doc_id AS id, text, true AS kept FROM documents", "SELECT subject AS query_id, description AS text FROM subject_areas", 30) + " SELECT query_id, id, CAST(position AS INTEGER) AS position, round(score, 6) AS score FROM top")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    r = bm25.search(s.raw("documents").select("doc_id", "text"), s.raw("subject_areas"), 30, "doc_id", query_id="subject", query_text="description")
    return r.select("query_id", "id", "position", F.round("score", 6).alias("score"))


@query("ft6_bm25_memories", _bm25_sql("SELECT id, text, NOT is_superseded AS kept FROM m", f"SELECT m.id AS query_id, m.text FROM m JOIN arr ON arr.id = m.id WHERE arr.batch = {LAST_BATCH}", 12) + " SELECT query_id, id, CAST(position AS INTEGER) AS position, round(score, 6) AS score FROM top")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = cut(s.mem("text", "is_superseded"))
    q = m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select(F.col("id").alias("query_id"), "text")
    r = bm25.search(m, q, 12, keep="not is_superseded")
    return r.select("query_id", "id", "position", F.round("score", 6).alias("score"))


# Vectors


@query("ve1_knn", f", {_KNN} SELECT query_id, id, CAST(position AS INTEGER) AS position, round(score, 6) AS score FROM knn WHERE position <= 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = cut(s.mem("vector"))
    q = m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select(F.col("id").alias("query_id"), "vector")
    return vectors.nearest(m, q, 10).select("query_id", "id", "position", F.round("score", 6).alias("score"))


@query("ve2_parent_cosine", "SELECT a.id, CASE WHEN a.vector IS NULL OR b.vector IS NULL OR len(a.vector) <> len(b.vector) THEN 0.0 ELSE round(coalesce(CASE WHEN isfinite(list_cosine_similarity(a.vector, b.vector)) THEN list_cosine_similarity(a.vector, b.vector) END, 0.0), 6) END AS cosine FROM m a JOIN m b ON b.id = a.parent_memory_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_Store(spark, d).mem("vector"))
    j = m.join(m.select(F.col("id").alias("pid"), F.col("vector").alias("pv")), F.col("parent_memory_id") == F.col("pid"))
    c = vectors.cosine("vector", "pv")
    return j.select("id", F.round(F.when(F.isnan(c), 0.0).otherwise(c), 6).alias("cosine"))


@query("ve3_valid_vectors", "SELECT id, vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem("vector").select("id", F.coalesce(vectors.valid("vector", 64), F.lit(False)).alias("ok"))


@query("ve6_cache_key", "SELECT id, 'local:hash:64:' || sha256(text) AS key FROM m WHERE text IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem("text").where("text is not null").select("id", T.cache_key("local", "hash", 64, "text").alias("key"))


@query("ve7_embed_through_cache")
def _(spark: SparkSession, d: str) -> DataFrame:
    from mnemospark.sources.embedders import HashEmbedder

    m = _Store(spark, d).mem("text", "vector")
    cache = m.where("vector is not null").select(T.cache_key("local", "hash", 64, "text").alias("hash"), "vector")
    return vectors.embed(m.select("id", "text"), cache, HashEmbedder(64), "local", "hash", 64).select("id", "hash", F.size("vector").alias("dims"))


@query("ve8_near_duplicates", f", {_KNN} SELECT k.query_id AS id, k.id AS earlier, round(k.score, 6) AS score FROM knn k JOIN m a ON a.id = k.query_id JOIN m b ON b.id = k.id WHERE k.position <= 17 AND k.id <> k.query_id AND k.score >= 0.95 AND (b.created_at, b.id) < (a.created_at, a.id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = cut(s.mem("vector").withColumn("seq", F.struct("created_at", "id")))
    ask = m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select(m["*"])
    return ingest.vector_pairs(m, ask, 0.95).select("id", "earlier", F.round("score", 6).alias("score"))


@query("ve9_clear_vectors", "SELECT id, false AS has_vector FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retention.reconcile_signature(_Store(spark, d).mem("vector"), False).select("id", F.col("vector").isNotNull().alias("has_vector"))


# Search


@query(
    "jn10_merge_scores",
    _bm25_sql("SELECT id, text, NOT is_superseded AS kept FROM m", f"SELECT m.id AS query_id, m.text FROM m JOIN arr ON arr.id = m.id WHERE arr.batch = {LAST_BATCH}", 30)
    + f""", {_KNN}, u AS (SELECT query_id, id, score AS v, 0.0::DOUBLE AS f FROM knn WHERE position <= 120 AND id IN (SELECT id FROM m WHERE NOT is_superseded) AND score >= 0.05 UNION ALL SELECT query_id, id, 0.0::DOUBLE, score FROM top),
g AS (SELECT query_id, id, max(v) AS v, max(f) AS f FROM u GROUP BY 1, 2)
SELECT query_id, id, round((v * 0.5 + f * 0.3) / 1.0, 6) AS score, CASE WHEN round(v, 9) >= round(f, 9) AND v >= 0 THEN 'vector' WHEN f >= 0 THEN 'fts' ELSE 'graph' END AS source FROM g WHERE round((v * 0.5 + f * 0.3) / 1.0, 9) >= 0.1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = table(s.mem("text", "vector", "is_superseded"), "memories")
    q = table(m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select(F.col("id").alias("query_id"), "text", "vector"), "queries")
    v = vectors.nearest(m, q, 120).where("score >= 0.05").join(m.where("is_superseded").select("id"), "id", "left_anti")
    v = table(v.select("query_id", "id", "score"), "vec")
    release(spark)
    g = search.merge_scores(v, bm25.search(m, q, 30, keep="not is_superseded"))
    c = search.combined(F.col("v"), F.col("f"), F.col("g"), CFG)
    return g.where(F.round(c, 9) >= CFG.min_score).select("query_id", "id", F.round(c, 6).alias("score"), search.primary_source(F.col("v"), F.col("f"), F.col("g")).alias("source"))


def _hybrid(spark: SparkSession, d: str, **more: object) -> tuple[DataFrame, DataFrame]:
    s = _Store(spark, d)
    m = s.mem("text", "vector", "is_superseded") if more.get("with_vectors", True) else s.mem("text", "is_superseded").withColumn("vector", F.lit(None).cast("array<double>"))
    m = table(m, "memories")
    q = table(m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select(F.col("id").alias("query_id"), "text", "vector"), "queries")
    return search.hybrid(m, q, s.rel(), CFG, **more), m


def _hybrid_sql(limit: int, least: float, vec: bool = True) -> str:
    """The whole search in SQL: picked (query_id, id, score, source, position); the re-ranking takes one pick a step from the heads of three queues."""
    near = f"SELECT query_id, id, score AS v, 0.0::DOUBLE AS f, position AS vr, NULL::BIGINT AS fr FROM knn WHERE position <= {12 * limit} AND id IN (SELECT id FROM m WHERE NOT is_superseded) AND score >= {least * 0.5} UNION ALL " if vec else ""
    return _bm25_sql("SELECT id, text, NOT is_superseded AS kept FROM m", f"SELECT m.id AS query_id, m.text FROM m JOIN arr ON arr.id = m.id WHERE arr.batch = {LAST_BATCH}", 3 * limit) + f""", {_KNN},
base AS MATERIALIZED (SELECT query_id, id, max(v) AS v, max(f) AS f, min(vr) AS vr, min(fr) AS fr FROM ({near}SELECT query_id, id, 0.0::DOUBLE AS v, score AS f, NULL::BIGINT AS vr, position AS fr FROM top) GROUP BY 1, 2),
seeds AS (SELECT query_id, id AS seed FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(v * 0.5 + f * 0.3, 9) DESC, id) AS k FROM base) WHERE k <= 5),
ed AS (SELECT source_id AS a, target_id AS b FROM rel UNION SELECT target_id, source_id FROM rel),
h1 AS (SELECT DISTINCT s.query_id, s.seed, ed.b AS id FROM seeds s JOIN ed ON ed.a = s.seed), h2 AS (SELECT * FROM h1 UNION SELECT h1.query_id, h1.seed, ed.b FROM h1 JOIN ed ON ed.a = h1.id),
gr AS (SELECT DISTINCT h2.query_id, h2.id, CASE WHEN base.id IS NULL THEN 0.5 ELSE 0.3 END::DOUBLE AS g FROM h2 LEFT JOIN base ON base.query_id = h2.query_id AND base.id = h2.id WHERE h2.id <> h2.seed),
al3 AS (SELECT query_id, id, coalesce(v, 0.0) AS v, coalesce(f, 0.0) AS f, coalesce(g, 0.0) AS g, vr, fr FROM base FULL JOIN gr USING (query_id, id)),
sd AS (SELECT query_id, id, (v * 0.5 + f * 0.3 + g * 0.2) AS score, CASE WHEN round(v, 9) >= round(f, 9) AND round(v, 9) >= round(g, 9) THEN 'vector' WHEN round(f, 9) >= round(g, 9) THEN 'fts' ELSE 'graph' END AS source, vr, fr FROM al3 WHERE round(v * 0.5 + f * 0.3 + g * 0.2, 9) >= {least}),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vr NULLS LAST, fr NULLS LAST, id) AS rk, count(*) OVER (PARTITION BY query_id) AS n FROM sd),
queue AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rk) AS qpos FROM ranked WHERE n > {limit}),
pick AS (SELECT DISTINCT query_id, 0 AS step, 0 AS tv, 0 AS tf, 0 AS tg, NULL::VARCHAR AS source, NULL::VARCHAR AS id, NULL::DOUBLE AS score FROM queue UNION ALL
SELECT query_id, step + 1, tv + (src = 'vector')::INTEGER, tf + (src = 'fts')::INTEGER, tg + (src = 'graph')::INTEGER, src, nid, nscore FROM (SELECT p.query_id, p.step, p.tv, p.tf, p.tg, q.source AS src, q.id AS nid, q.score AS nscore, row_number() OVER (PARTITION BY p.query_id ORDER BY CASE WHEN p.source IS NULL THEN -q.rk::DOUBLE ELSE round(0.7 * q.score + 0.3 * (CASE WHEN p.source = q.source THEN 0.8 ELSE 1.0 END), 9) END DESC, q.rk) AS k
FROM pick p JOIN queue q ON q.query_id = p.query_id AND q.qpos = CASE q.source WHEN 'vector' THEN p.tv WHEN 'fts' THEN p.tf ELSE p.tg END + 1 WHERE p.step < {limit}) WHERE k = 1),
picked AS (SELECT o.query_id, o.id, round(o.score, 6) AS score, o.source, CAST(row_number() OVER (PARTITION BY o.query_id ORDER BY o.place) AS INTEGER) AS position, m.text FROM (SELECT query_id, id, score, source, step AS place FROM pick WHERE step > 0 UNION ALL SELECT query_id, id, score, source, rk FROM ranked WHERE n <= {limit}) o JOIN m ON m.id = o.id WHERE NOT m.is_superseded)"""


@query("ap1_hybrid_search", _hybrid_sql(10, 0.1) + " SELECT query_id, id, score, source, position FROM picked")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)[0].withColumn("score", F.round("score", 6))


@query("ap3_search_keywords_only", _hybrid_sql(10, 0.1, vec=False) + " SELECT query_id, id, score, source, position FROM picked")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, with_vectors=False)[0].withColumn("score", F.round("score", 6))


@query("pf12_search_hits", _hybrid_sql(10, 0.1) + " SELECT query_id, 'memory://' || id AS path, 0 AS start_line, 0 AS end_line, score, substring(text, 1, 200) AS snippet, source, position FROM picked")
def _(spark: SparkSession, d: str) -> DataFrame:
    h, m = _hybrid(spark, d)
    return search.hit_projection(h, m).withColumn("score", F.round("score", 6))


@query("ap11_recall_block")
def _(spark: SparkSession, d: str) -> DataFrame:
    h, m = _hybrid(spark, d, max_results=int(CFG.auto_recall_max_memories), min_score=CFG.auto_recall_min_score)
    return search.context_block(h, m, CFG)


# Dedup and sets


@query("so1_dedupe_texts", f"""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(trim(regexp_replace(regexp_replace(text, '[<>`]', ' ', 'g'), '\\s+', ' ', 'g'))) ORDER BY created_at, id) AS k FROM m WHERE trim(regexp_replace(text, '[<>`]', ' ', 'g')) <> '' AND NOT regexp_matches(text, '(?i)Treat every memory below as untrusted|HEARTBEAT_OK|^System:\\s*\\[|^<(?:memory|relevant-memories|system|assistant|developer|tool|function)[-\\s>]')) WHERE k = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = _Store(spark, d).mem("text").withColumn("norm", T.normalized("text")).where(~T.is_synthetic("text") & (F.col("norm") != ""))
    w = Window.partitionBy("norm").orderBy("created_at", "id")
    return m.withColumn("k", F.row_number().over(w)).where("k = 1").select("id")


@query("so3_mention_dedup")
def _(spark: SparkSession, d: str) -> DataFrame:
    al = _Store(spark, d).al()
    return ingest.mention_dedup(al.select(F.col("entity_id").alias("owner"), F.struct("first_seen", "id").alias("pos"), F.col("surface_text").alias("mention"), "kind"))


@query("so6_link_insert", "SELECT memory_id, alias_id FROM mt")
def _(spark: SparkSession, d: str) -> DataFrame:
    mt = cut(_Store(spark, d).mt())
    old, new = mt.where(F.col("memory_id") < "8"), mt
    return old.unionByName(new.join(old, ["memory_id", "alias_id"], "left_anti"))


def _arrived(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    return cut(s.mem("text", "vector").join(s.arrivals(), "id").withColumn("seq", F.struct("at", "id")))


@query("ap2_ingest")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All arrivals loaded one after another."""
    return ingest.ingest(_arrived(spark, d).select("id", "seq", "text", "vector"), CFG)


@query("ap2_ingest_last_batch")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The last batch loaded into the store that loading all earlier ones left: its rows only."""
    m = _arrived(spark, d)
    last = F.coalesce(F.col("batch") == LAST_BATCH, F.lit(False))
    cols = ["id", "seq", "text", "vector"]
    old, new = m.where(~last).select(cols), cut(m.where(last).select(cols))
    stored = cut(old.join(ingest.ingest(old, CFG).where("kept").select("id"), "id", "left_semi"))
    return ingest.ingest(stored.unionByName(new), CFG, new=new).join(new.select("id"), "id", "left_semi")


@query("st25_lexical_duplicates")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = _Store(spark, d).mem("text").withColumn("seq", F.struct("created_at", "id"))
    return ingest.lexical_pairs(m, CFG.lexical_duplicate_threshold).select("id", "earlier", F.round("score", 6).alias("score"))


# Mutations


@query("mu2_merge_duplicates", f"""SELECT m.id, coalesce(t.t, m.memory_type) AS memory_type, m.pinned OR coalesce(t.p, false) AS pinned, m.access_count + coalesce(t.n, 0) AS access_count, CASE WHEN t.n IS NOT NULL THEN {NOW} ELSE m.updated_at END AS updated_at, CASE WHEN t.x IS NOT NULL THEN t.x.e ELSE m.expires_at END AS expires_at
FROM m LEFT JOIN (SELECT p.parent_memory_id AS id, arg_max(p.memory_type, (p.created_at, p.id)) AS t, bool_or(p.pinned) AS p, arg_max({{'e': p.expires_at}}, (p.created_at, p.id)) FILTER (WHERE p.memory_type = 'episode' OR p.expires_at IS NOT NULL) AS x, count(*) AS n FROM m p WHERE p.parent_memory_id IS NOT NULL GROUP BY 1) t ON t.id = m.id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_Store(spark, d).mem("memory_type", "pinned", "expires_at", "access_count", "last_accessed_at"))
    dup = m.where("parent_memory_id is not null").select(F.col("parent_memory_id").alias("id"), F.struct("created_at", "id").alias("seq"), "memory_type", "pinned", "expires_at")
    return retention.merge_duplicates(m, dup, NOW).select("id", "memory_type", "pinned", "access_count", "updated_at", "expires_at")


@query("mu3_bump_access", "SELECT m.id, m.access_count + coalesce(n, 0) AS access_count, greatest(m.last_accessed_at, t.at) AS last_accessed_at FROM m LEFT JOIN (SELECT memory_id AS id, count(*) AS n, max(epoch_us(arrived_at) // 1000) AS at FROM ingest_log GROUP BY 1) t ON t.id = m.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    log = s.raw("ingest_log").select(F.col("memory_id").alias("id"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', arrived_at)").alias("at"))
    return retention.bump(s.mem("access_count", "last_accessed_at"), log).select("id", "access_count", "last_accessed_at")


@query(
    "mu4_delete_cascade",
    f""", d AS (SELECT id FROM m WHERE expires_at < {NOW}) SELECT 'memories' AS part, count(*) AS n FROM m WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT 'mentions', count(*) FROM mt WHERE memory_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'edges', count(*) FROM rel WHERE source_id NOT IN (SELECT id FROM d) AND target_id NOT IN (SELECT id FROM d)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = cut(s.mem("expires_at"))
    a, b, c = retention.delete(m.where(retention.expired(NOW)), m, s.mt(), s.rel())
    n = lambda x, k: x.agg(F.lit(k).alias("part"), F.count("*").alias("n"))
    return n(a, "memories").unionByName(n(b, "mentions")).unionByName(n(c, "edges"))


@query("mu10_upsert_cache", "SELECT id, coalesce(k, 'old') AS v FROM (SELECT id, CASE WHEN memory_type = 'fact' THEN 'new' END AS k FROM m)")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = _Store(spark, d).mem("memory_type")
    return retention.upsert_latest(m.select("id", F.lit("old").alias("v")), m.where("memory_type = 'fact'").select("id", F.lit("new").alias("v")), "id")


@query("gr6_apply_merges", """, p AS (SELECT DISTINCT x.id AS a, x.merged_into_id AS b FROM entities x JOIN e ON e.id = x.merged_into_id WHERE x.id <> x.merged_into_id), s AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b), g AS (SELECT r.a AS id, min({'f': e.first_seen, 'i': e.id}).i AS survivor FROM r JOIN e ON e.id = r.b GROUP BY r.a)
SELECT al.id, coalesce(g.survivor, al.entity_id) AS entity_id FROM al LEFT JOIN g ON g.id = al.entity_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    ent = cut(s.ent())
    p = s.raw("entities").select(F.col("id").alias("left_id"), F.col("merged_into_id").alias("right_id")).where("left_id <> right_id").distinct()
    g = graph.merge_groups(p.join(ent.select(F.col("id").alias("right_id")), "right_id", "left_semi"), ent)
    return graph.apply_merges(ent, s.al(), cut(g))[1].select("id", "entity_id")


# Profile


@query("ap9_profile")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.sections(_Store(spark, d).mem(), NOW, CFG)


@query("ap10_profile_prompt")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.markdown(profile.sections(_Store(spark, d).mem(), NOW, CFG))


@query("sc9_profile_cache")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.from_cache(profile.cache_rows(profile.sections(_Store(spark, d).mem(), NOW, CFG), NOW))


@query("rk7_profile_priority", "SELECT id, CAST(row_number() OVER (ORDER BY pinned DESC, access_count DESC, updated_at DESC, created_at DESC, id) AS INTEGER) AS rk FROM (SELECT * FROM m WHERE NOT is_superseded ORDER BY created_at DESC, id LIMIT 1000)")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = profile.scan(_Store(spark, d).mem("is_superseded", "pinned", "access_count"), CFG)
    return m.select("id", F.row_number().over(Window.orderBy(*profile.priority())).alias("rk"))


# Text

_ALL_TEXTS = "(SELECT id, text FROM m UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents)"
_WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x0B]"
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    return s.mem("text").select("id", "text").unionByName(s.raw("documents").select(F.col("doc_id").cast("string").alias("id"), "text"))


@query("st2_collapse_whitespace", f"SELECT id, {_CLEAN} AS text FROM {_ALL_TEXTS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", T.collapse_whitespace("text").alias("text"))


@query("st6_for_storage", f"SELECT id, CASE WHEN length(c) BETWEEN 10 AND 2000 AND NOT regexp_matches(c, '(?i)^<(?:memory|relevant-memories|system|assistant|developer|tool|function)[-\\s>]') THEN c END AS text FROM (SELECT id, {_CLEAN} AS c FROM {_ALL_TEXTS})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", T.for_storage("text").alias("text"))


@query("st7_normalized", f"SELECT id, lower(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[<>`]', ' ', 'g'), '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g')) AS norm FROM {_ALL_TEXTS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", T.normalized("text").alias("norm"))


@query("st8_for_prompt", f"SELECT id, substr(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[<>]', '', 'g'), '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g'), 1, 200) AS shown FROM {_ALL_TEXTS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", T.for_prompt("text").alias("shown"))


@query("st1_strip_metadata", r"SELECT id, regexp_replace(regexp_replace(text, '^\[[A-Za-z]{3} \d{4}-\d\d-\d\d \d\d:\d\d[^\]]*\] *', ''), '^\n+|\n+$', '', 'g') AS text FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem("text").select("id", T.strip_metadata("text").alias("text"))


@query("st9_alias_key")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).al().select("id", T.alias_key("surface_text").alias("key"), T.folded("surface_text").alias("folded"))


@query("st14_tokens", r"SELECT id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[.@:/+-][\p{L}\p{N}]+)*'), ' ') AS toks FROM m WHERE text IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem("text").where("text is not null").select("id", F.array_join(L.tokens(F.lower("text")), " ").alias("toks"))


_STOP = "[" + ", ".join(f"'{w}'" for w in L.STOPWORDS) + "]"
_PAIR = rf"(SELECT a.id, regexp_extract_all(lower(a.text), '[\p{{L}}\p{{N}}]+(?:[.@:/+-][\p{{L}}\p{{N}}]+)*') AS x, regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+(?:[.@:/+-][\p{{L}}\p{{N}}]+)*') AS y, lower(a.text) AS s, lower(b.text) AS t FROM m a JOIN m b ON b.id = a.parent_memory_id WHERE a.text IS NOT NULL AND b.text IS NOT NULL)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_Store(spark, d).mem("text").where("text is not null"))
    j = m.join(m.select(F.col("id").alias("pid"), F.col("text").alias("pt")), F.col("parent_memory_id") == F.col("pid"))
    return j.select("id", L.tokens(F.lower("text")).alias("x"), L.tokens(F.lower("pt")).alias("y"), F.lower("text").alias("s"), F.lower("pt").alias("t"))


@query("rk12_query_terms", rf"""SELECT id, array_to_string(term_list, ' ') AS terms FROM (SELECT id, list_slice(list_transform(list_sort(list_transform(range(1, len(d) + 1), lambda i: {{'l': -length(d[i]), 'i': i, 'x': d[i]}})), lambda z: z.x), 1, 8) AS term_list FROM (SELECT id, list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN list_position(c, c[i]) = i THEN c[i] END), lambda z: z IS NOT NULL) AS d FROM (SELECT id, CASE WHEN len(k) > 0 THEN k ELSE x END AS c FROM (SELECT id, x, list_filter(x, lambda w: regexp_matches(w, '[@:/]|\d') OR (length(w) >= 3 AND NOT list_contains({_STOP}, w))) AS k FROM (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:[.@:/+-][\p{{L}}\p{{N}}]+)*') AS x FROM m WHERE text IS NOT NULL)))))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem("text").where("text is not null").select("id", F.array_join(L.query_terms(L.tokens(F.lower("text"))), " ").alias("terms"))


@query(
    "st20_set_scores",
    f"""SELECT id, round(CASE WHEN least(nx, ny) > 0 THEN common / least(nx, ny) ELSE 0 END, 6) AS containment, round(CASE WHEN nx + ny > 0 THEN 2 * common / (nx + ny) ELSE 1 END, 6) AS dice, round(CASE WHEN nx + ny - common > 0 THEN common / (nx + ny - common) ELSE 0 END, 6) AS jaccard
FROM (SELECT id, CAST(len(list_distinct(x)) AS DOUBLE) AS nx, CAST(len(list_distinct(y)) AS DOUBLE) AS ny, CAST(len(list_intersect(list_distinct(x), list_distinct(y))) AS DOUBLE) AS common FROM {_PAIR})""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    r = lambda c, n: F.round(c, 6).alias(n)
    return _pairs(spark, d).select("id", r(L.containment(x, y), "containment"), r(L.dice(x, y), "dice"), r(L.jaccard(x, y), "jaccard"))


_GRAMS = "CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) <= 3 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) END"


@query("st23_trigram_dice", f"SELECT id, round(CASE WHEN s = t THEN 1.0 WHEN s = '' OR t = '' THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS score FROM (SELECT id, s, t, {_GRAMS.format('s')} AS a, {_GRAMS.format('t')} AS b FROM {_PAIR})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", F.round(L.ngram_dice(F.col("s"), F.col("t")), 6).alias("score"))


@query("st22_lcs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", L.lcs(F.col("x"), F.col("y")).alias("lcs"), F.round(L.score(F.col("x"), F.col("y"), F.col("s"), F.col("t")), 6).alias("score"))


@query("st26_string_similarity")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    j = s.al().select("id", "entity_id", "surface_text").join(s.ent().select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id")
    return j.select("id", F.round(L.string_similarity(T.alias_tokens("surface_text"), T.alias_tokens("canonical_name"), T.folded("surface_text"), T.folded("canonical_name")), 6).alias("score"))


@query("st27_percent", "SELECT id, CAST(floor((access_count % 101) / 100.0 * 100 + 0.5) AS BIGINT)::VARCHAR || '%' AS shown FROM m WHERE access_count IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).mem("access_count").where("access_count is not null").select("id", T.percent((F.col("access_count") % 101) / 100.0).alias("shown"))


@query("st28_slug", r"SELECT doc_id, regexp_replace(regexp_replace(lower(trim(mailbox)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(sha256(mailbox), 1, 16) AS scope FROM documents WHERE mailbox IS NOT NULL", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "documents").where("mailbox is not null").select("doc_id", T.slug("mailbox").alias("slug"), T.scope_hash("mailbox").alias("scope"))


@query("st31_mention_display", "SELECT al.id, CASE WHEN al.surface_text = e.canonical_name THEN e.canonical_name ELSE al.surface_text || ' -> ' || e.canonical_name END || CASE WHEN e.kind IS NULL OR e.kind = '' THEN '' ELSE ' (' || e.kind || ')' END AS shown FROM al JOIN e ON e.id = al.entity_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    j = s.al().select("id", "entity_id", "surface_text").join(s.ent().select(F.col("id").alias("entity_id"), "canonical_name", F.col("kind").alias("ek")), "entity_id")
    return j.select("id", T.mention_display("surface_text", "canonical_name", "ek").alias("shown"))


@query("pf6_synthetic_filter", f"SELECT id, c = '' OR regexp_matches(c, '(?i)^<(?:memory|relevant-memories|system|assistant|developer|tool|function)[-\\s>]') OR regexp_matches(c, '(?i)HEARTBEAT_OK|Pre-compaction memory flush|^System:\\s*\\[|##\\s*User Profile\\b|Sender \\(untrusted metadata\\):') AS synthetic FROM (SELECT id, {_CLEAN} AS c FROM {_ALL_TEXTS} WHERE text IS NOT NULL)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).where("text is not null").select("id", T.is_synthetic("text").alias("synthetic"))


# JSON and dates


@query("js1_extraction", rf"SELECT id, t AS text, memory_type FROM (SELECT id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS t, memory_type FROM m) WHERE length(t) BETWEEN 10 AND 500 AND memory_type IN ('fact', 'preference', 'episode')")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = _Store(spark, d).mem("text", "memory_type")
    j = m.select("id", F.to_json(F.array(F.struct("text", F.col("memory_type").alias("memoryType"), F.array(F.struct(F.lit(" A ").alias("mention"), F.lit("").alias("kind"))).alias("entities")))).alias("j"))
    return j.select("id", F.explode(J.extraction("j")).alias("x")).select("id", "x.text", "x.memory_type")


@query("js4_relations", "SELECT id, target_id, lower(relation_type) AS relation_type FROM relationships WHERE target_id <> '' AND lower(relation_type) IN ('updates', 'related', 'none')", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    r = S.read(spark, d, "relationships")
    j = r.select("id", F.to_json(F.array(F.struct(F.col("target_id").alias("targetId"), F.lower("relation_type").alias("relationType")))).alias("j"))
    return j.select("id", F.explode(J.relations("j")).alias("x")).select("id", "x.target_id", "x.relation_type")


@query("js5_merge_decisions", "SELECT id AS left_id, merged_into_id AS right_id FROM entities WHERE id <> '' AND merged_into_id <> ''", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = S.read(spark, d, "entities")
    j = e.select(F.to_json(F.array(F.struct(F.col("id").alias("leftEntityId"), F.col("merged_into_id").alias("rightEntityId"), F.lit("same").alias("decision")))).alias("j"))
    return j.select(F.explode(J.merge_decisions("j")).alias("x")).select("x.left_id", "x.right_id")


@query("js7_first_object", "SELECT event_id, props AS obj FROM events WHERE props IS NOT NULL", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "events").where("props is not null").select("event_id", J.first_object(F.concat(F.lit("Sure: "), "props", F.lit(" ok"))).alias("obj"))


@query("js8_content_texts", "SELECT event_id, event_type AS texts FROM events", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = S.read(spark, d, "events")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))))
    plain = F.concat(F.lit('"'), "event_type", F.lit('"'))
    return e.select("event_id", F.array_join(J.content_texts(F.when(F.col("event_type") == "view", plain).otherwise(blocks)), "|").alias("texts"))


@query("dt2_iso_millis", "SELECT event_id, epoch_ms(date_trunc('second', ts)) AS ms FROM events", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = S.read(spark, d, "events")
    return e.select("event_id", T.iso_millis(F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("ms"))


@query("dt4_session_date", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = S.read(spark, d, "events")
    return e.select("event_id", F.date_format(T.session_date(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy/MM/dd '(Mon)' HH:mm")), "yyyy-MM-dd HH:mm").alias("at"))


# Turns

_TURNS = ", t AS (SELECT user_id AS conv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, CASE WHEN event_type IN ('view', 'click') THEN 'user' WHEN event_type IN ('signup', 'purchase') THEN 'assistant' ELSE 'system' END AS role, event_type || ' ' || props AS text, event_id FROM events)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    e = S.read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    role = F.when(F.col("event_type").isin("view", "click"), "user").when(F.col("event_type").isin("signup", "purchase"), "assistant").otherwise("system")
    return e.select(F.col("user_id").alias("conv"), F.row_number().over(w).alias("turn"), role.alias("role"), F.concat("event_type", F.lit(" "), "props").alias("text"), "event_id")


@query("rk15_last_turn", _TURNS + " SELECT conv, turn, role, text FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv) AS since FROM t) WHERE since IS NULL OR turn >= since")
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.last_turn(_turns(spark, d)).select("conv", "turn", "role", "text")


_ROUNDS = _TURNS + ", r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv ORDER BY turn) - 1 AS BIGINT) AS round FROM (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY conv ORDER BY turn) = 'user' THEN 0 ELSE 1 END AS s FROM t))"


@query("rk16_rounds", _ROUNDS + " SELECT conv, turn, round FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.rounds(_turns(spark, d)).select("conv", "turn", "round")


@query("ap18_round_blocks", _ROUNDS + f" SELECT conv, round, {NOW} + 1000 * round AS at, 'Session Date: 2026-07-01' || chr(10) || 'Round Content:' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv, round")
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.round_blocks(turns.rounds(_turns(spark, d)).withColumn("base", F.lit(NOW).cast("long")), "base")


@query("ap13_capture_text", _TURNS + " SELECT conv, substr(string_agg('[role: ' || role || ']' || chr(10) || text || chr(10) || '[' || role || ':end]', chr(10) || chr(10) ORDER BY turn), 1, 2000) AS text FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv) AS since FROM t) WHERE (since IS NULL OR turn >= since) AND role IN ('user', 'assistant') AND length(text) >= 10 GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.capture_text(_turns(spark, d))


@query("rk19_latest_assistant", _TURNS + " SELECT conv, arg_max(text, turn) AS text FROM t WHERE role = 'assistant' AND text <> '' GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.latest_assistant(_turns(spark, d))


@query("rk18_first_per_group", "SELECT source, min(message_id) AS message_id FROM documents WHERE message_id IS NOT NULL GROUP BY source", pre=False)
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.first_per_group(S.read(spark, d, "documents").where("message_id is not null").select("source", "message_id"), "source", "message_id").select("source", "message_id")


# Index upkeep, decision validation and inserts


@query("jn2_indexed_count", "SELECT count(*) AS n FROM m WHERE NOT is_superseded AND len(vector) = 64")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = _Store(spark, d).mem("is_superseded", "vector")
    return S.active(m).join(m.where("size(vector) = 64").select("id"), "id", "left_semi").agg(F.count("*").alias("n"))


@query("jn3_missing_index_rows", "SELECT id FROM m WHERE NOT is_superseded AND vector IS NOT NULL AND len(vector) <> 64")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_Store(spark, d).mem("is_superseded", "vector"))
    return S.active(m).where("vector is not null").join(m.where("size(vector) = 64").select("id"), "id", "left_anti").select("id")


@query("jn4_reindex_listing", "SELECT id, created_at FROM m WHERE NOT is_superseded AND vector IS NOT NULL AND len(vector) <> 64 ORDER BY created_at, id LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_Store(spark, d).mem("is_superseded", "vector"))
    miss = S.active(m).where("vector is not null").join(m.where("size(vector) = 64").select("id"), "id", "left_anti")
    return S.page(miss, 20, 0, F.asc("created_at"), F.asc("id")).select("id", "created_at")


@query("jn9_active_neighbours", f", {_KNN} SELECT k.query_id, k.id, round(k.score, 6) AS score FROM knn k JOIN m ON m.id = k.id WHERE k.position <= 16 AND NOT m.is_superseded")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = cut(s.mem("vector", "is_superseded"))
    q = m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select(F.col("id").alias("query_id"), "vector")
    near = vectors.nearest(m, q, 16)  # the limit comes before the filter
    return near.join(m.where("is_superseded").select("id"), "id", "left_anti").select("query_id", "id", F.round("score", 6).alias("score"))


@query("rk14_first_active_neighbour", f", {_KNN} SELECT query_id, id FROM (SELECT k.query_id, k.id, row_number() OVER (PARTITION BY k.query_id ORDER BY k.position) AS r FROM knn k JOIN m ON m.id = k.id WHERE k.position <= 16 AND NOT m.is_superseded AND k.id <> k.query_id) WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = cut(s.mem("vector", "is_superseded"))
    q = m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select(F.col("id").alias("query_id"), "vector")
    near = vectors.nearest(m, q, 16).where("query_id <> id").join(m.where("is_superseded").select("id"), "id", "left_anti")
    return near.groupBy("query_id").agg(F.min_by("id", "position").alias("id"))


@query("jn14_known_targets", "SELECT r.id, r.source_id, r.target_id FROM relationships r WHERE EXISTS (SELECT 1 FROM m WHERE m.id = r.target_id) AND EXISTS (SELECT 1 FROM m WHERE m.id = r.source_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = s.mem().select("id")
    r = s.raw("relationships")
    r = r.join(m.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(m.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return r.select("id", "source_id", "target_id")


@query("jn15_oriented_decisions", "SELECT DISTINCT x.id AS left_id, x.merged_into_id AS right_id FROM entities x JOIN e a ON a.id = x.id JOIN e b ON b.id = x.merged_into_id WHERE (a.first_seen, a.id) < (b.first_seen, b.id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    ent = cut(s.ent().select("id", "first_seen"))
    p = s.raw("entities").select(F.col("id").alias("left_id"), F.col("merged_into_id").alias("right_id")).where("left_id is not null and right_id is not null").distinct()
    sent = p.join(ent.select(F.col("id").alias("left_id"), F.col("first_seen").alias("lf")), "left_id").join(ent.select(F.col("id").alias("right_id"), F.col("first_seen").alias("rf")), "right_id")
    sent = sent.where(F.struct("lf", "left_id") < F.struct("rf", "right_id")).select("left_id", "right_id")
    return p.join(sent, ["left_id", "right_id"], "left_semi")


@query("rk3_search_seeds", f", {_KNN} SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score * 0.5, 9) DESC, id) AS r FROM knn WHERE position <= 120) WHERE r <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    m = cut(s.mem("vector"))
    q = m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select(F.col("id").alias("query_id"), "vector")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("score") * CFG.vector_weight, 9)), "id")
    return vectors.nearest(m, q, 120).withColumn("r", F.row_number().over(w)).where(F.col("r") <= int(CFG.graph_seed_limit)).select("query_id", "id")


@query("rk20_first_update", "SELECT source_id, arg_min(target_id, (x.c, target_id)) AS target_id FROM rel WHERE relation_type = 'updates' GROUP BY source_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    u = _Store(spark, d).rel().where("relation_type = 'updates'")
    return u.groupBy("source_id").agg(F.min_by("target_id", F.struct("created_at", "target_id")).alias("target_id"))


@query("so5_never_superseded", "SELECT id FROM m WHERE id NOT IN (SELECT target_id FROM rel WHERE relation_type = 'updates')")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    return s.mem().select("id").join(graph.superseded_by(s.rel()), "id", "left_anti")


@query("so7_mentioned_entities", "SELECT DISTINCT entity_id FROM cm")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).cm().select("entity_id").distinct()


@query("mu1_insert_batch", f"SELECT (SELECT count(*) FROM m JOIN arr ON arr.id = m.id WHERE batch < {LAST_BATCH}) + (SELECT count(*) FROM m JOIN arr ON arr.id = m.id WHERE batch = {LAST_BATCH}) AS n")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    a = cut(s.mem().join(s.arrivals(), "id").select("id", "batch"))
    old, new = a.where(F.col("batch") < LAST_BATCH), a.where(F.col("batch") == LAST_BATCH)
    return old.unionByName(new.join(old.select("id"), "id", "left_anti")).agg(F.count("*").alias("n"))


@query("mu6_after_sweeps", f"SELECT id FROM m WHERE NOT coalesce(expires_at < {NOW}, false) AND NOT (memory_type = 'episode' AND access_count = 0 AND created_at < {NOW - DECAY_DAYS * 86_400_000} AND NOT is_superseded AND NOT pinned)")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = _Store(spark, d).mem("expires_at", "memory_type", "access_count", "is_superseded", "pinned")
    gone = F.coalesce(retention.expired(NOW), F.lit(False)) | F.coalesce(retention.decayed(NOW, DECAY_DAYS), F.lit(False))
    return m.where(~gone).select("id")


# Entities as a whole, backfill


@query("gr9_merge_inputs", "SELECT f.id, f.canonical_name, coalesce(a.aliases, '') AS aliases FROM (SELECT id, canonical_name FROM e WHERE merged_into_id IS NULL ORDER BY last_seen DESC NULLS LAST, id LIMIT 200) f LEFT JOIN (SELECT entity_id, array_to_string(list_sort(list_distinct(list(surface_text))), '|') AS aliases FROM al WHERE surface_text IS NOT NULL GROUP BY 1) a ON a.entity_id = f.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    return entities.merge_inputs(s.ent(), s.al()).withColumn("aliases", F.array_join("aliases", "|"))


@query("jn16_name_vectors", "SELECT e.id, 64 AS dims, sum(1) OVER (PARTITION BY canonical_name) AS same_name FROM e WHERE canonical_name IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with its name's vector; entities of one name share it."""
    from mnemospark.sources.embedders import HashEmbedder

    none = spark.createDataFrame([], "hash string, vector array<double>")
    v = entities.name_vectors(_Store(spark, d).ent(), none, HashEmbedder(64), "hash", "hash", 64)
    return v.join(_Store(spark, d).ent().select("id", "canonical_name"), "id").select("id", F.size("vector").alias("dims"), F.count("*").over(Window.partitionBy("canonical_name")).alias("same_name"))


@query("ve10_backfill_due", "SELECT id, text FROM m WHERE NOT is_superseded AND vector IS NULL AND text IS NOT NULL ORDER BY created_at, id LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return backfill_due(_Store(spark, d).mem("text", "vector", "is_superseded"))


@query("ap15_merge_cycle", """, few AS (SELECT id, first_seen, canonical_name, lower(trim(canonical_name)) AS n FROM e WHERE merged_into_id IS NULL AND canonical_name IS NOT NULL)
SELECT id, arg_min(id, (first_seen, id)) OVER (PARTITION BY n) AS survivor FROM few QUALIFY count(*) OVER (PARTITION BY n) > 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Merging by a stated decision over the whole table: names that are equal but for case are the same."""
    e = cut(_Store(spark, d).ent().where("merged_into_id is null and canonical_name is not null").withColumn("n", F.lower(F.trim("canonical_name"))))
    first = e.groupBy("n").agg(F.min("id").alias("left_id"))
    pairs = e.join(first, "n").where("id <> left_id").select("left_id", F.col("id").alias("right_id"))
    return graph.merge_groups(pairs, e)


@query("rk4_candidate_order", f""", {_KNN}, top AS (SELECT query_id, id, score, position AS vr FROM knn WHERE position <= 30 AND score >= 0.05)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 2) DESC, vr NULLS LAST, id) AS INTEGER) AS place FROM top""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Equal scores (here rounded to two places) keep the order of the vector hits."""
    s = _Store(spark, d)
    m = cut(s.mem("vector"))
    q = m.join(s.arrivals().where(F.col("batch") == LAST_BATCH), "id").select(F.col("id").alias("query_id"), "vector")
    v = vectors.nearest(m, q, 30).where("score >= 0.05")
    g = search.merge_scores(v, v.limit(0))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("v", 2)), F.asc_nulls_last("vr"), F.asc_nulls_last("fr"), "id")
    return g.select("query_id", "id", F.row_number().over(w).alias("place"))
