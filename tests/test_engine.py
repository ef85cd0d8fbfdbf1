import itertools
import math
import random
import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.config import Config, clamp, expand_env
from mnemospark.operators import bm25, graph, ingest, profile, retention, search, turns, vectors
from mnemospark.sources import embedders as E
from mnemospark.sources import jsonio
from mnemospark.sources.store import Store
from mnemospark.streaming import capture
from mnemospark.tools import Memory


def test_config():
    c = Config.of(vector_weight=3, max_recall_results="x", debug=1, auto_recall=None)
    assert (c.vector_weight, c.max_recall_results, c.debug, c.auto_recall) == (1, 10, False, True)
    assert clamp(float("nan"), 5, 0, 9) == 5 and expand_env("a${X}", {"X": "1"}) == "a1"
    with pytest.raises(ValueError):
        Config.of(nothing=1)
    with pytest.raises(KeyError):
        expand_env("${Y}", {})


def test_embedders():
    assert E.resolve("ollama")[2] == 768 and E.Disabled(3).embed(["a"]) == [[0.0] * 3] and E.probe(None) == "disabled"
    with pytest.raises(ValueError):
        E.resolve("mine", "model")


def test_bm25_against_fts5(spark):
    rnd = random.Random(3)
    words = "Iván ivan foo-bar foo_bar alpha beta gamma delta ?! x1 naïve".split()
    docs = [(str(i), " ".join(rnd.choices(words, k=rnd.randint(0, 12))), i % 7 == 0) for i in range(80)]
    c = sqlite3.connect(":memory:")
    try:
        c.execute("create virtual table f using fts5(id unindexed, text)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    c.executemany("insert into f values (?, ?)", [d[:2] for d in docs])
    qs = ["ivan alpha", "foo-bar beta beta", "it's \"gamma\" ?", "delta foo_bar naive", "zzz"]
    got = bm25.search(spark.createDataFrame(docs, "id string, text string, gone boolean"), spark.createDataFrame(list(enumerate(qs)), "query_id int, text string"), 1000, keep="true").collect()
    for k, q in enumerate(qs):
        terms = [f'"{t}"' for t in q.replace("'", "").replace('"', "").split()]
        want = {r[0]: r[1] for r in c.execute("select id, rank from f where f match ?", (" OR ".join(terms),))}
        mine = {r["id"]: r["rank"] for r in got if r["query_id"] == k}
        assert mine.keys() == want.keys() and all(abs(mine[i] - want[i]) < 1e-9 for i in want)


def shuffled(spark, run):
    """Rows that run() writes into shuffles."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    out = run()
    return total() - before, out


def test_bm25_never_pairs_all_queries_with_all_documents(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"{i:03d}", " ".join(["the", "on", *rnd.choices(words, k=6), f"own{i}"]), i % 9 == 0) for i in range(400)]
    d = spark.createDataFrame(docs, "id string, text string, gone boolean")
    rows, got = shuffled(spark, lambda: bm25.search(d, d.select(F.col("id").alias("query_id"), "text"), 5, keep="not gone").collect())
    assert rows < 60_000  # a row for each query and document would be 142,000
    sets = [(i, t.split(), gone) for i, t, gone in docs]
    df = Counter(w for _, t, _ in sets for w in set(t))
    avg = sum(len(t) for _, t, _ in sets) / len(sets)
    for q, text, _ in sets[::37]:
        rank = {}
        for i, t, gone in sets:
            part = lambda w, t=t: (math.log((400 - df[w] + 0.5) / (df[w] + 0.5)) if df[w] <= 200 else 1e-6) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg))
            parts = [-part(w) for w in text if w in t]
            if parts and not gone:
                rank[i] = sum(parts)
        want = sorted(rank, key=lambda i: (round(rank[i], 9), i))[:5]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["position"])] == want


def test_bm25_best_is_exact_with_ties():
    rnd = np.random.default_rng(5)
    n, words = 300, 40
    grid = np.where(rnd.random((words, n)) < rnd.random((words, 1)) ** 3, np.round(rnd.random((words, n)) * 3 + 0.1, 1), 0.0)
    term, num = np.nonzero(grid)
    terms = [rnd.choice(words + 3, rnd.integers(1, 9), replace=False) for _ in range(200)]
    times = [rnd.integers(1, 3, len(t)) for t in terms]
    q, got, rank = bm25.best(term, num, grid[term, num], terms, times, 7)
    for i, (t, m) in enumerate(zip(terms, times)):
        ok = t < words
        s = m[ok] @ grid[t[ok]]
        want = [j for j in np.lexsort((np.arange(n), -np.round(s, 9)))[:7] if s[j] > 0]
        assert list(got[q == i]) == want and np.allclose(-rank[q == i], s[want])


def brute_mmr(items, limit, lam):
    if len(items) <= limit:
        return items
    rest, out = list(items), []
    while rest and len(out) < limit:
        val = [lam * s + (1 - lam) * (0.8 if out and out[-1][2] == src else 1.0) for _, s, src in rest] if out else [1.0] + [0.0] * (len(rest) - 1)
        out.append(rest.pop(val.index(max(val))))
    return out


def test_mmr(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for q in range(25):
        s = sorted((round(rnd.random(), 1 if q % 2 else 3) for _ in range(rnd.randint(1, 14))), reverse=True)
        items = [(f"i{k:02d}", x, rnd.choice(["vector", "fts", "graph"])) for k, x in enumerate(s)]
        rows += [(q, i, x, src, k + 1) for k, (i, x, src) in enumerate(items)]
        want[q] = [x[0] for x in brute_mmr(items, 6, 0.7)]
    d = spark.createDataFrame(rows, "query_id int, id string, score double, source string, rk int")
    got = {}
    for r in search.mmr(d, 6, 0.7).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want


def test_profile_fold(spark):
    rnd = random.Random(6)
    rows = [(f"m{i}", f"note {rnd.randint(1, 30)} text", rnd.choice(["fact", "episode", "preference"]), rnd.random() < 0.1, rnd.randint(0, 3), 1000 + i, 1000 + i, False) for i in range(120)]
    m = spark.createDataFrame(rows, "id string, text string, memory_type string, pinned boolean, access_count long, updated_at long, created_at long, is_superseded boolean")
    cfg = Config.of(max_long_term_items=5, max_recent_items=4)
    now = 2000
    order = sorted(rows, key=lambda r: (-r[3], -r[4], -r[5], -r[6], r[0]))
    long, recent, seen = [], [], set()
    for r in order:
        if r[1] in seen:
            continue
        if (r[3] or r[2] != "episode") and len(long) < 5:
            long.append(r[1])
            seen.add(r[1])
        elif r[2] == "episode" and len(recent) < 4:
            recent.append(r[1])
            seen.add(r[1])
    got = profile.sections(m, now, cfg).orderBy("section", "position").collect()
    assert [r["text"] for r in got if r["section"] == "longTerm"] == long and [r["text"] for r in got if r["section"] == "recent"] == recent
    assert profile.markdown(profile.sections(m, now, cfg)).first()[0].startswith("## User Profile (Long-term)\n- ")


def test_first_survivors(spark):
    rnd = random.Random(8)
    n = 120
    pairs = {(j, i) for j in range(n) for i in range(j) if rnd.random() < 0.03}
    kept, into = [], {}
    for j in range(n):
        hit = [i for i in kept if (j, i) in pairs]
        if hit:
            into[j] = hit[0]
        else:
            kept.append(j)
    rows = spark.createDataFrame([(str(i), i) for i in range(n)], "id string, seq int")
    got = ingest.first_survivors(rows, spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "id string, earlier string")).collect()
    assert {int(r["id"]) for r in got if r["kept"]} == set(kept)
    assert {int(r["id"]): int(r["into"]) for r in got if not r["kept"]} == into


def test_ingest_checks_every_batch(spark, data):
    import __spark_entry__ as entry

    got = {r["id"]: r for r in entry.queries()["ap2_ingest"](spark, data).collect()}
    texts = [r["clean"] for r in got.values() if r["kept"]]
    assert len(texts) == len(set(texts))
    last = {r["id"]: r for r in entry.queries()["ap2_ingest_last_batch"](spark, data).collect()}
    early = [r for i, r in got.items() if i not in last and r["clean"] is not None]
    assert last and any(not r["kept"] for r in early) and all(got[r["into"]]["kept"] for r in got.values() if r["into"])
    assert {i: got[i]["kept"] for i in last} == {i: r["kept"] for i, r in last.items()}


def test_survivors_of_unknown_partners(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, seq int")
    with pytest.raises(ValueError):
        ingest.first_survivors(rows, spark.createDataFrame([("b", "z")], "id string, earlier string"))


def test_lexical_pairs_are_complete(spark):
    from test_text import py_score

    rnd = random.Random(9)
    base = [" ".join(rnd.sample("anna bob carla meets plans trip madrid rome spring autumn train plane 12 2026 hotel late early group".split(), 7)) for _ in range(25)]
    texts = base + [t + " soon" for t in base[:12]] + [t.replace("trip", "trips") for t in base[5:15]]
    rows = [(f"r{i:02d}", i, t) for i, t in enumerate(dict.fromkeys(texts))]
    got = {tuple(sorted((r["id"], r["earlier"]))) for r in ingest.lexical_pairs(spark.createDataFrame(rows, "id string, seq int, text string"), 0.88).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if round(py_score(a[2], b[2]), 9) >= 0.88}
    assert got == want and want


def test_related_is_exact_with_a_hub(spark):
    rnd = random.Random(10)
    me = {(f"m{i:03d}", e) for i in range(150) for e in {"hub", *rnd.sample("abcdefghijkl", rnd.randint(0, 11) if i < 6 else rnd.randint(0, 3))}}
    made = {f"m{i:03d}": rnd.randint(0, 40) for i in range(150)}
    mem = spark.createDataFrame(list(made.items()), "id string, created_at int")
    got = graph.related(spark.createDataFrame(list(me), "memory_id string, entity_id string"), mem, mem.select("id"), 5).collect()
    es = {m: {e for x, e in me if x == m} for m in made}
    for m in made:
        want = sorted(((-len(es[m] & es[o]), -made[o], o) for o in made if o != m and es[m] & es[o]))[:5]
        assert [o for _, _, o in want] == [r["other"] for r in sorted(got, key=lambda r: r["position"]) if r["id"] == m]


def test_knn_and_cosine(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((60, 8))
    rows = [(f"v{i:02d}", list(map(float, v))) for i, v in enumerate(x)] + [("zero", [0.0] * 8), ("short", [1.0]), ("none", None), ("nan", [float("nan")] * 8)]
    d = spark.createDataFrame(rows, "id string, vector array<double>")
    got = vectors.nearest(d, d.select(F.col("id").alias("query_id"), "vector"), 4, 8).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(60):
        want = [f"v{j:02d}" for j in np.argsort(-(u @ u[i]))[:4]]
        assert [r["id"] for r in sorted(got, key=lambda r: r["position"]) if r["query_id"] == f"v{i:02d}"] == want
    assert len(got) == 240
    assert vectors.nearest(d, d.select(F.col("id").alias("query_id"), "vector").limit(0), 4, 8).count() == 0


def test_hybrid_rules(spark):
    mem = spark.createDataFrame([("a", "red fox", None, False), ("b", "blue dog", None, False), ("c", "green cat", None, True), ("d", "old owl", None, False)], "id string, text string, vector array<double>, is_superseded boolean")
    q = spark.createDataFrame([(1, "fox", None), (2, "?", None)], "query_id int, text string, vector array<double>")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source_id string, target_id string")
    got = search.hybrid(mem, q, e, Config(), with_vectors=False).collect()
    assert [(r["query_id"], r["id"], round(r["score"], 6), r["source"]) for r in got] == [(1, "a", 0.3, "fts"), (1, "b", 0.1, "graph")]
    got = search.hybrid(mem, q, e, Config(), with_vectors=False, include_superseded=True).collect()
    assert {r["id"] for r in got} == {"a", "b", "c"}


def test_turns(spark):
    t = spark.createDataFrame([("x", 1, "user", "first question"), ("x", 2, "assistant", "an answer here"), ("x", 3, "user", "second question"), ("x", 4, "system", "note for all"), ("x", 5, "assistant", "short"), ("y", 1, "assistant", "only an answer")], "conv string, turn int, role string, text string")
    got = {r["conv"]: r["text"] for r in turns.capture_text(t).collect()}
    assert got == {"x": "[role: user]\nsecond question\n[user:end]", "y": "[role: assistant]\nonly an answer\n[assistant:end]"}
    assert [r["round"] for r in turns.rounds(t).orderBy("conv", "turn").collect()] == [0, 0, 1, 2, 3, 0]


def test_mutations(spark):
    m = spark.createDataFrame([("a", "episode", False, 5, 0, 10, 10, None, False)], "id string, memory_type string, pinned boolean, expires_at long, access_count long, created_at long, updated_at long, last_accessed_at long, is_superseded boolean")
    dup = spark.createDataFrame([("a", 1, "fact", True, None), ("a", 2, "episode", False, None)], "id string, seq int, memory_type string, pinned boolean, expires_at long")
    r = retention.merge_duplicates(m, dup, 99).first()
    assert (r["memory_type"], r["pinned"], r["expires_at"], r["access_count"], r["updated_at"]) == ("episode", True, None, 2, 99)
    assert m.where(retention.expired(6)).count() == 1 and m.where(retention.expired(5)).count() == 0


def test_store_stream_and_tools(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("memories").count() == 0
    src = tmp_path / "in"
    spark.createDataFrame([("c", 1, "user", "My flat is in Madrid since May"), ("c", 2, "assistant", "Noted, Madrid it is")], "conv string, turn int, role string, text string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("conv string, turn int, role string, text string").parquet(str(src))
    for k in range(2):  # the second run sees nothing new
        capture.capture(stream, store, Config(), str(tmp_path / "cp"), lambda: 1_000).awaitTermination()
        assert store.read("memories").count() == 1
    m = Memory(store)
    m.remember(["Peter keeps the ladder in the blue shed", "peter keeps the ladder in the blue shed"], 2_000)
    assert store.read("memories").count() == 2
    assert store.read("memories").agg(F.max("access_count")).first()[0] == 1
    hit = m.search(["ladder shed"], min_score=0.1).collect()
    assert len(hit) == 1 and m.status()["active"] == 2
    assert [r["text"] for r in m.profile(3_000).where("profile_type = 'longTerm'").collect()][0].startswith("Peter keeps")
    m.forget_ids([hit[0]["id"]])
    assert store.read("memories").count() == 1
    assert capture.maintain(store, 10, Config()) == {"expired": 0, "decayed": 0}
    store.commit(embedding_signature=spark.createDataFrame([("memories", "p", "m", 3, 1)], "scope string, provider_id string, model_id string, dimensions int, updated_at long"))
    store.wipe()
    assert store.read("memories").count() == 0 and store.signature_matches("p", "m", 3)


def test_pipeline_embeds_links_relates_and_merges(spark, tmp_path):
    from mnemospark import cli
    from mnemospark.sources.embedders import HashEmbedder

    store, emb = Store(spark, str(tmp_path / "store")), HashEmbedder(64)
    schema = "seq string, text string, memory_type string, expires_at long, mentions array<struct<mention: string, kind: string>>"
    batch = lambda rows, now, **k: capture.store_batch(store, spark.createDataFrame(rows, schema), now, Config(), emb, **k)
    batch([("1", "Anna moved to Madrid in May", "fact", None, [("Anna", "person"), ("Madrid", None)]), ("2", "The blue shed holds a ladder", "fact", None, [(" ", None)])], 1_000)
    m = {r["text"]: r for r in store.read("memories").collect()}
    assert all(len(r["vector"]) == 64 for r in m.values()) and store.read("entities").count() == 2 and store.read("entity_mentions").count() == 2
    pick = lambda c: c.select("id", "other", F.lit("updates").alias("relation"))
    batch([("1", "Anna has left and lives in Rome these days", "fact", None, [("ANNA", None), ("Rome", "place"), ("madrid", "place")])], 2_000, relate=pick)
    e = {(r["relation_type"]) for r in store.read("relationships").collect()}
    new = store.read("memories").where("created_at = 2000").first()
    assert e == {"related", "updates"} and new["parent_memory_id"] == m["Anna moved to Madrid in May"]["id"]
    assert store.read("memories").where("is_superseded").count() == 1 and store.read("entities").count() == 3
    seen = {r["canonical_name"]: (r["kind"], r["last_seen"]) for r in store.read("entities").collect()}
    assert seen == {"Anna": ("person", 2_000), "Madrid": ("place", 2_000), "Rome": ("place", 2_000)}
    batch([("1", "the blue shed holds a ladder", "fact", None, None)], 3_000)  # a repeat changes no vector
    assert store.read("memories").count() == 3 and store.read("memories").agg(F.max("access_count")).first()[0] == 1
    hit = Memory(store, embedder=emb).search(["ladder in the shed"]).collect()
    assert hit and hit[0]["id"] == m["The blue shed holds a ladder"]["id"]
    store.commit(memories=store.read("memories").withColumn("vector", F.when(F.col("created_at") == 1_000, F.col("vector"))))
    assert capture.backfill(store, emb) == {"embedded": 1, "pending": 0} and capture.backfill(store, emb) == {"embedded": 0, "pending": 0}
    batch([("1", "Ana Maria sings on Friday nights", "fact", None, [("Anna.", None), ("Ana", None), ("Roma", None)]), ("2", "Nobody knows the Rome office", "fact", None, [("Rome office", None)])], 4_000)
    n = store.read("entities").count()
    got = capture.maintain(store, 5_000, Config(), decide=lambda p: p.select("left_id", "right_id", F.lit("same").alias("decision")))
    assert got["merged"] == store.read("entities").where("merged_into_id is not null").count() and store.read("entities").count() == n
    # tools, command line, versions
    t = Memory(store, embedder=emb)
    t.touch([hit[0]["id"]], 6_000)
    t.fold()
    assert store.read("memories").where(F.col("id") == hit[0]["id"]).first()["access_count"] == 2 and store.read("access_log").count() == 0
    t.sign("hash", "hash", 7_000)
    assert store.signature_matches("hash", "hash", 64) and store.read("memories").where("vector is not null").count() == 0
    run = lambda *a: cli.main(["--store", str(tmp_path / "store"), "--now", "8000", *a], spark)
    assert "ladder" in run("search", "ladder shed") and "Long-term" in run("profile", "--rebuild") and "active" in run("stats") and "mode" in run("status") and "confirm" in run("wipe")
    other = Store(spark, str(tmp_path / "store"))
    other.begin()
    store.commit(profile_cache=store.read("profile_cache").limit(0))
    with pytest.raises(FileExistsError):
        other.commit(profile_cache=other.read("profile_cache").limit(0))
    (tmp_path / "store" / "versions" / "000000009999").write_text("{")  # a writer that ended halfway
    assert store.read("memories").count() > 0
    assert "empty" in run("wipe", "--confirm") and store.read("memories").count() == 0


def test_first_survivors_of_long_chains(spark):
    """A chain of 60 duplicates is settled whole, and the best-scoring partner is taken."""
    rows = spark.createDataFrame([(f"r{i:03d}", i) for i in range(60)], "id string, seq int")
    pairs = spark.createDataFrame([(f"r{i:03d}", f"r{i - 1:03d}") for i in range(1, 60)], "id string, earlier string")
    got = {r["id"]: (r["kept"], r["into"]) for r in ingest.first_survivors(rows, pairs).collect()}
    assert len(got) == 60 and all(got[f"r{i:03d}"] == ((True, None) if i % 2 == 0 else (False, f"r{i - 1:03d}")) for i in range(60))
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, seq int")
    pairs = spark.createDataFrame([("c", "a", 1, 0.9), ("c", "b", 1, 0.95), ("d", "a", 2, 0.99), ("d", "b", 1, 0.9)], "id string, earlier string, stage int, score double")
    assert {r["id"]: r["into"] for r in ingest.first_survivors(rows, pairs).collect()} == {"a": None, "b": None, "c": "b", "d": "b"}


def test_json_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"question_id": "q_abs", "question": "Who?", "answer": 3, "question_date": "2023/05/20 (Sat) 02:21", "haystack_dates": ["2023/05/01 (Mon) 10:00"], "haystack_sessions": [[{"role": "user", "content": "hi"}]]}]')
    b = jsonio.read_array(spark, str(tmp_path / "b.json"))
    assert b.first()["answer"] == "3" and jsonio.sessions(b).first()["text"] == "hi" and "do not know" in jsonio.question_prompt(b).first()["prompt"]
    jsonio.write_lines(b.select("question_id", "answer"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_without_optional_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['mnemospark.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('p1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    hits = [p for p in (root / "mnemospark").rglob("*.py") if "llm" not in p.parts and "mnemospark.llm" in p.read_text()]
    assert not hits


def test_hybrid_search_shuffles_no_pair_of_query_and_document(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"{i:03d}", " ".join(["the", "on", *rnd.choices(words, k=6), f"own{i}"]), [rnd.gauss(0, 1) for _ in range(8)], i % 9 == 0) for i in range(400)]
    m = spark.createDataFrame(rows, "id string, text string, vector array<double>, is_superseded boolean")
    edges = spark.createDataFrame([(f"{i:03d}", f"{(i * 7) % 400:03d}") for i in range(0, 400, 5)], "source_id string, target_id string")
    q = m.select(F.col("id").alias("query_id"), "text", "vector")
    n, got = shuffled(spark, lambda: search.hybrid(m, q, edges, Config(), dims=8, max_results=2).collect())
    assert len(got) and n < 140_000  # a row for each query and document would be 142,000 more


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_merge_groups_of_long_chains_takes_few_jobs(spark, most):
    rnd = random.Random(11)
    names = [f"e{i:03d}" for i in range(90)]
    rnd.shuffle(names)
    pairs = list(zip(names[:60], names[1:60])) + list(zip(names[60:80], names[61:80])) + [(names[3], names[50]), (names[81], names[82])]
    rnd.shuffle(pairs)
    seen = {n: rnd.randint(0, 20) for n in names}
    spark.sparkContext.setJobGroup(f"merge-{most}", "")
    p, ent = spark.createDataFrame(pairs, "left_id string, right_id string"), spark.createDataFrame(list(seen.items()), "id string, first_seen long")
    got = {r["id"]: r["survivor"] for r in graph.merge_groups(p, ent, most).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"merge-{most}"))
    spark.sparkContext._jsc.clearJobGroup()
    want = {}
    for group in (names[:60], names[60:80], names[81:83]):
        want |= dict.fromkeys(group, min(group, key=lambda n: (seen[n], n)))
    assert got == want
    assert most == 7 or jobs < 20  # rounds of joins took more, and their plans filled the driver


def test_lexical_candidates_are_whole_and_no_table_of_pairs(spark):
    rnd = np.random.default_rng(12)
    sets = [[f"t{x}" for x in rnd.choice(30, rnd.integers(1, 9), replace=False)] for _ in range(150)]
    fresh = rnd.random(150) < 0.4
    for need in (0.0, 0.6, 0.782):
        q, h = ingest.overlaps(sets[:90], fresh[:90], sets, fresh, need)
        want = {(i, j) for i in range(90) for j in range(150) if (fresh[i] or fresh[j]) and len(sets[i]) <= len(sets[j]) and len({*sets[i]} & {*sets[j]}) >= max(1, need * len(sets[i]) - 1e-9)}
        assert {*zip(q.tolist(), h.tolist())} == want and len(q) == len(want)
    word = lambda x: "".join(chr(97 + int(c)) * 2 for c in f"{x:03d}")
    rows = spark.createDataFrame([(f"{i:03d}", i, f"{word(i)}son prefers the quiet seat on long train rides near {word(i % 200)}ville") for i in range(400)], "id string, seq int, text string")
    n, got = shuffled(spark, lambda: ingest.lexical_pairs(rows, 0.88).collect())
    assert {(r["id"], r["earlier"]) for r in got} == {(f"{i + 200:03d}", f"{i:03d}") for i in range(200)}
    assert n < 20_000  # joined tokens made 80,000 pairs and more


def test_near_vectors_are_whole_from_a_least_cosine_on(spark):
    rng = np.random.default_rng(13)
    x = np.repeat(rng.standard_normal((12, 64)), 25, axis=0) + 0.15 * rng.standard_normal((300, 64))
    x[1], x[2] = x[0], 3 * x[0]  # ties, of which ids decide
    d = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    q = d.withColumnRenamed("id", "query_id")
    rows = lambda f: {(r["query_id"], r["id"], round(r["score"], 9), r["position"]) for r in f.collect()}
    for k in (3, 17, 400):
        assert rows(vectors.nearest(d, q, k, least=0.97)) == {r for r in rows(vectors.nearest(d, q, k)) if r[2] >= 0.97}
    seq = d.withColumn("seq", F.col("id"))
    got = {(r["id"], r["earlier"]) for r in ingest.vector_pairs(seq, d, 0.97, k=400).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(f"v{i:03d}", f"v{j:03d}") for i, j in zip(*np.nonzero(np.tril(u @ u.T >= 0.97, -1)))} and len(got) > 1000
