"""Near duplicates against all pairs by brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexeum.llm import neardup as N

LOW = {k: k + 32 for k in range(65, 91)}


def brute(rows, percent=75):
    sets, out = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    seen = set()
    for v in holders.values():
        for x in range(len(v)):
            for y in range(x):
                seen.add((v[y], v[x]))
    for a, b in seen:
        k = len(sets[a] & sets[b])
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    for i in ids:
        out[i] = (len(sets[i]), find(i))
    return out


def texts(rng, n):
    vocab = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(vocab, size=int(rng.integers(1, 120)))) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        for _ in range(int(rng.integers(1, 6))):
            w = t.split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
            out.append(" ".join(w))
    return out + base[:5] + ["", " \t ", None, "ONE two", "one TWO", "x" * 50_000, "é a b c d e " * 3000]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 3, t, "x") for i, t in enumerate(texts(rng, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r[0]: (r[1], r[2]) for r in N.near_duplicates(df).collect()}
    want = brute([r[:2] for r in rows])
    assert got == want
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


@pytest.mark.parametrize("block,hot,n", [(500, 50_000, 300), (7, 10, 60)])
def test_hot_bucket_with_strays(spark, monkeypatch, block, hot, n):
    """A large group of near copies and texts that only share a passage with it; with blocks and slices that buckets cross."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N.C, "HOT", hot)
    rng = np.random.default_rng(5)
    core = [f"c{k}" for k in range(200)]
    rows = []
    for i in range(n):
        w = list(core)
        w[int(rng.integers(200))] = f"n{i}"
        rows.append((i, " ".join(w)))
    for i in range(n, n * 4 // 3):
        rows.append((i, " ".join(core[:100] + [f"z{i}_{k}" for k in range(60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in N.near_duplicates(df).collect()} == brute(rows)


def test_strays_cost_linear_work(spark, monkeypatch):
    """A bucket of near copies and one stray: each copy is dealt once, the stray once a block."""
    monkeypatch.setattr(N, "BLOCK", 50)
    rows = spark.range(2000).select((F.col("id") == 1999).alias("stray"), F.xxhash64("id").alias("h"))
    made = rows.select("stray", F.explode(N._grid(F.lit(2000), F.lit(1), F.col("stray"), F.col("h"))).alias("at")).select("stray", "at.*")
    assert made.count() == 2000 + 40
    assert made.filter("side = 0").count() == 40 and made.filter("side = 1").select("j").distinct().count() == 40


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(twice).collect())) == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (2, 0, 2)]
    assert N.drop_near_duplicates(twice).count() == 2


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 107), (107, 101), (200, 200), (301, 300), (302, 300), (303, 300)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = dict(map(tuple, N.components(df).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 107: 100, 300: 300, 301: 300, 302: 300, 303: 300}
    assert N.components(df.limit(0)).count() == 0


def test_ids_of_several_texts_join_their_classes(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (10, a), (10, b), (20, b), (30, c), (30, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r[0], r[2]) for r in N.near_duplicates(df).collect()) == [(3, 3), (10, 3), (10, 3), (20, 3), (30, 30), (30, 30)]
    assert sorted(map(tuple, N.drop_near_duplicates(df).collect())) == [(3, a), (30, c)]


@pytest.mark.parametrize("size", [1, 3, 50, 5000])
def test_sketch_fills_and_estimates(size):
    rng = np.random.default_rng(size)
    a = rng.integers(0, 2**63, size=size).astype(np.uint64)
    b = a.copy()
    b[: size // 10] = rng.integers(0, 2**63, size=size // 10)
    e, ptr = np.concatenate([a, b]), np.array([0, size, 2 * size])
    s = N.sketch(e, ptr)
    assert (s != np.iinfo(np.uint64).max).all()
    j = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((s[0] == s[1]).mean() - j) < 0.15


def test_shingles_of_sliced_and_null_arrays():
    arr = pa.array(["q", "a b c d e f", None, "a"]).slice(1)
    e, ptr = N.shingle_sets(arr)
    assert np.diff(ptr).tolist() == [2, 0, 1]


def test_split_by_loses_no_row(spark):
    from lexeum.llm import common as C

    df = spark.createDataFrame([(i if i % 10 else None, str(i), i, "c") for i in range(200)], "doc_id long, _bits string, _bucket long, `a.b` string")
    ids = df.filter("doc_id % 3 = 0").select("doc_id")
    maybe, rest = C.split_by(df, "doc_id", C.bitmap(ids, "doc_id"))
    assert maybe.columns == rest.columns == df.columns
    assert maybe.count() + rest.count() == 200
    have = {r.doc_id for r in maybe.collect()}
    assert {i for i in range(200) if i % 10 and i % 3 == 0} <= have and None not in have and len(have) < 70


def test_spread_join_is_a_join(spark):
    from lexeum.llm import common as C

    many = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k long, v long")
    one = many.groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", F.col("k") * 10)
    got = sorted(map(tuple, C.spread_join(many, one.filter("k <> 5"), "k", "n", hot=20).select("k", "v", "x").collect()))
    assert got == sorted((k, v, k * 10) for k, v in map(tuple, many.collect()) if k != 5)
