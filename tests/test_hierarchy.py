import random

import pytest

from mnemospark.operators import hierarchy as h


def brute(par: dict) -> dict:
    out = {}
    for x in par:
        trail, y = [x], x
        while par.get(y) in par:
            y = par[y]
            if y in trail:
                out[x] = (min(trail[trail.index(y) :]), -1, None)
                break
            trail.append(y)
        else:
            out[x] = (y, len(trail) - 1, trail[::-1])
    return out


def run(spark, rows):
    r = h.resolve(spark.createDataFrame(rows, "id string, parent string, root string"), "id", "parent")
    p = h.paths(r).collect()
    return {x["id"]: (x["root"], x["depth"], x["path"]) for x in p}, h.paths(r)


CASES = {
    "empty": {},
    "single": {"a": None},
    "missing parent": {"a": "zz", "b": "a"},
    "self": {"a": "a", "b": "a"},
    "loop with tail": {"a": "b", "b": "c", "c": "a", "d": "c", "e": "d"},
    "two loops": {"a": "b", "b": "a", "c": "d", "d": "c", "e": "c"},
    "chain": {f"n{i:03d}": f"n{i - 1:03d}" if i else None for i in range(70)},
    "hub": {"r": None, **{f"c{i}": "r" for i in range(300)}},
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    par = CASES[name]
    got, _ = run(spark, [(k, v, "clashing name") for k, v in par.items()])
    assert got == brute(par)


def test_random_and_descendants(spark):
    rnd = random.Random(5)
    ids = [f"x{i}" for i in range(400)]
    par = {x: rnd.choice([None, "gone", *ids[: i + 1], *ids[max(0, i - 3) : i + 4]]) for i, x in enumerate(ids)}
    got, p = run(spark, [(k, v, None) for k, v in par.items()])
    want = brute(par)
    assert got == want
    d = {(r["ancestor"], r["descendant"], r["distance"]) for r in h.descendants(p).collect()}
    assert d == {(a, x, len(t) - 1 - i) for x, (_, _, t) in want.items() if t for i, a in enumerate(t[:-1])}


def test_null_ids_and_repeats(spark):
    got, _ = run(spark, [(None, "a", None), ("a", None, None)])
    assert got == {"a": ("a", 0, ["a"])}
    m = spark.createDataFrame([("a", None, 1, 1), ("a", "b", 2, 1), ("b", None, None, 1)], "id string, parent_memory_id string, updated_at long, created_at long")
    assert {(r["id"], r["parent_memory_id"]) for r in h.newest_memories(m).collect()} == {("a", "b"), ("b", None)}


def test_hot_parent_uses_lookup(spark):
    from mnemospark.session import hot_keys, lookup

    d = spark.range(5000).selectExpr("cast(id as string) as id", "if(id % 3 = 0, 'hub', cast(id as string)) as k")
    assert hot_keys(d, "k") == ["hub"]
    dim = d.select("k").distinct().selectExpr("k as dk", "upper(k) as v")
    got = lookup(d, "k", dim, "dk", "left")
    assert got.count() == 5000 and got.where("v is null or v <> upper(k)").count() == 0
