import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import jsonx as J
from mnemospark.functions import lexical as L
from mnemospark.functions import text as T


def col(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in d.orderBy("i").select(f("t")).collect()]


def test_cleaning(spark):
    x = ["a\r\n\r\n\r\nb  \n", "<memory-context>x\ny</memory-context> Hello there", "\u00a0 hi \u3000", "", None]
    assert col(spark, x, T.strip_injected) == ["a\n\nb", "Hello there", "hi", "", None]
    assert col(spark, ["A <b>`c`</b>\u00a0 D", None], T.normalized) == ["a b c /b d", None]
    assert col(spark, ["<b>one\ntwo</b>"], lambda c: T.for_prompt(c, 6)) == ["bone t"]


@pytest.mark.parametrize("n,kept", [(9, False), (10, True), (2000, True), (2001, False)])
def test_storage_lengths(spark, n, kept):
    assert (col(spark, ["x" * n], T.for_storage)[0] is not None) is kept


def test_synthetic(spark):
    x = ["", "<system> x", "please HEARTBEAT_OK", "## User Profile here", "System: [x", "a memory about tools", "<toolbox", "use memory_search to find"]
    assert col(spark, x, T.is_synthetic) == [True, True, True, True, True, False, False, True]


def test_metadata(spark):
    s = "Sender (untrusted metadata):"
    x = [
        "[Mon 2026-01-05 10:00 UTC] hello",
        f'{s}\n```json\n{{"a": 1}}\n```\n\nhello',
        f"{s}\nno fence",
        f"{s}\n```json\nnever closed",
        f'a\n{s}\n```json\n```\n{s}\n```json\n{{}}\n```\nb',
        None,
    ]
    assert col(spark, x, T.strip_metadata) == ["hello", "hello", f"{s}\nno fence", "", "a\nb", None]


def test_names_and_ids(spark):
    assert col(spark, ["  Iván\u00a0 B ", "ＡＢ"], T.alias_key) == ["iván b", "ab"]
    assert col(spark, ["Iván", "Ivan"], T.folded) == ["ivan", "ivan"]
    assert col(spark, [" My Agent! 2 ", "--x--"], T.slug) == ["my-agent-2", "x"]
    assert col(spark, [0.625, 0.0, 1.0], T.percent, "double") == ["63%", "0%", "100%"]
    assert col(spark, ["memory://a/b", "x://a", "memory://"], T.uri_id) == ["a/b", None, None]
    assert col(spark, ["2026-01-05T10:00:00Z", "soon", None], T.iso_normal) == ["2026-01-05T10:00:00.000Z", None, None]
    assert [str(x) for x in col(spark, ["2023/05/20 (Sat) 02:21", "2023-05-20", "x"], T.session_date)] == ["2023-05-20 02:21:00", "2023-05-20 00:00:00", "None"]


def py_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def py_score(a, b):
    import regex

    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.category(c).startswith("M")).lower()
    ka, kb = (" ".join(fold(x).split()) for x in (a, b))
    ta, tb = (regex.findall(L.TOKEN, x) for x in (ka, kb))
    st = lambda t: {x for x in t if any(c in "@:/" or c.isdigit() for c in x)}
    if st(ta) and st(tb) and st(ta) != st(tb):
        return 0.0
    ct = lambda t: {x for x in t if x in st(t) or (len(x) >= 3 and x not in L.STOPWORDS)} or set(t)
    ca, cb = ct(ta), ct(tb)
    cont = len(ca & cb) / min(len(ca), len(cb)) if ca and cb else 0.0
    order = py_lcs(ta, tb) / min(len(ta), len(tb)) if ta and tb else 0.0
    g = lambda s: {s[i : i + 3] for i in range(len(s) - 2)} if len(s) > 3 else {s}
    dice = 1.0 if ka == kb else 0.0 if not ka or not kb else 2 * len(g(ka) & g(kb)) / (len(g(ka)) + len(g(kb)))
    return 0.55 * cont + 0.3 * order + 0.15 * dice


def test_lexical_score(spark):
    rnd = random.Random(2)
    words = "the red fox jumps over 12 lazy dogs at 10:30 café x@y.z and sleeps".split()
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(60)]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1]))] + [(99, "", "")]
    d = spark.createDataFrame(pairs, "i int, a string, b string").withColumn("ka", T.dedup_text("a")).withColumn("kb", T.dedup_text("b"))
    d = d.withColumn("ta", L.tokens("ka")).withColumn("tb", L.tokens("kb"))
    got = d.select("a", "b", L.score(F.col("ta"), F.col("tb"), F.col("ka"), F.col("kb")).alias("s"), L.lcs(F.col("ta"), F.col("tb")).alias("l"), "ta", "tb").collect()
    for r in got:
        assert r["l"] == py_lcs(r["ta"], r["tb"])
        if r["a"] or r["b"]:
            assert abs(r["s"] - py_score(r["a"], r["b"])) < 1e-9


def test_json(spark):
    e = '[{"text": " A text of ten ", "memoryType": "episode", "entities": [{"mention": " X ", "kind": " "}, {"mention": ""}], "expiresAtIso": "2026-01-01"}, {"text": 12345678901, "memoryType": "fact"}, 7, {"text": "short", "memoryType": "fact"}, {"text": "long enough text", "memoryType": "dream"}]'
    got = col(spark, [e, "no", "{}", None], J.extraction)
    assert [tuple(map(str, x)) for x in got[0]] == [("A text of ten", "episode", "[Row(mention='X', kind=None)]", "2026-01-01T00:00:00.000Z")]
    assert got[1:] == [None, None, None]
    r = '[{"targetId": "a", "relationType": "updates"}, {"targetId": "b", "relationType": "updates"}, {"targetId": "z", "relationType": "related"}, {"targetId": "", "relationType": "none"}, {"targetId": "c", "relationType": "odd"}]'
    d = spark.createDataFrame([(r,)], "t string").select(J.keep_known_targets(J.relations("t"), F.array(F.lit("a"), F.lit("b"))).alias("x")).first()["x"]
    assert [tuple(x) for x in d] == [("a", "updates")]
    assert col(spark, ['"hi"', '[{"type": "text", "text": "a"}, {"type": "image"}]', "7"], J.content_texts) == [["hi"], ["a"], []]
    assert col(spark, ['x {"a": 1} y', "none"], J.first_object) == ['{"a": 1}', None]
