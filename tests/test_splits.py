"""Splits that keep the shares of every label, and quantiles of groups, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexeum import schema
from lexeum.functions import text as T
from lexeum.operators import association, splits, statistics


def strata(rng, labels, most):
    sets = {tuple(rng.choice([0.0, 1.0, None]) for _ in range(labels)) for _ in range(rng.randint(1, 60))}
    return [(s, rng.choice([1, 1, 1, 2, 2, 3, rng.randint(1, most)])) for s in sorted(sets, key=str)]


@pytest.mark.parametrize("seed", range(25))
def test_every_label_value_is_within_one_row(seed):
    rng = random.Random(seed)
    rows = strata(rng, rng.randint(1, 5), 200)
    got = splits.allocate(rows)
    assert [sum(g) for g in got] == [n for _, n in rows] and all(min(g) >= 0 for g in got)
    worst = 0.0
    for i in range(len(rows[0][0])):
        for v in (0.0, 1.0, None):
            own = [g for (s, _), g in zip(rows, got, strict=True) if s[i] == v]
            total = sum(map(sum, own))
            for j, f in enumerate(splits.FRACTIONS):
                worst = max(worst, abs(sum(g[j] for g in own) - f * total))
    assert worst <= 1 + 1e-9


def test_single_rows_are_spread():
    rows = [((i % 2 * 1.0, i % 3 * 0.5, float(i)), 1) for i in range(200)]
    got = np.array(splits.allocate(rows)).sum(axis=0)
    assert np.abs(got - 200 * np.array(splits.FRACTIONS)).max() <= 1


def test_balanced_splits_of_a_table(spark):
    rng = random.Random(9)
    rows = [{"text": f"t{i % 900}", "source": rng.choice(["a", "b", "-", None]), "split": "test" if i % 5 == 0 else None, **{x: rng.choice([0.0, 0.0, 1.0, None]) for x in schema.LABELS}} for i in range(1200)]
    df = schema.from_rows(spark, rows).repartition(3)
    one, two = splits.balanced_splits(df), splits.balanced_splits(df.repartition(5))
    assert one.columns == df.columns and one.count() == 1200 and one.filter("split IS NULL").isEmpty()
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    new = splits.balanced_splits(df.filter("split IS NULL")).collect()
    for source in ("a", "b", "-", None):
        for x in schema.LABELS:
            for v in (0.0, 1.0, None):
                own = [r.split for r in new if r.source == source and r[x] == v]
                for s, f in zip(splits.NAMES, splits.FRACTIONS, strict=True):
                    assert abs(own.count(s) - f * len(own)) <= 1 + 1e-9
    assert splits.balanced_splits(df.limit(0)).count() == 0


@pytest.mark.parametrize("bins,few", [(4096, 10_000), (8, 5), (2, 1)])
def test_quantiles_of_groups(spark, bins, few):
    rng = np.random.default_rng(4)
    groups = {"even": rng.normal(size=700), "ties": rng.integers(0, 3, size=300).astype(float), "one": np.array([7.5]), "two": np.array([-1.0, 1e300]), "far": np.concatenate(([-1e308, 1e308], rng.random(50))), None: rng.exponential(size=40), "same": np.full(90, 0.1)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    got = {r.k: r.q for r in statistics.grouped_quantiles(df, "v", "k", shares, bins=bins, few=few).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        x = np.sort(x)
        for p, q in zip(shares, got[k], strict=True):
            at = (len(x) - 1) * p
            a, b = x[int(at)], x[min(len(x) - 1, int(at) + 1)]
            assert q == pytest.approx(a + (at - int(at)) * (b - a), rel=1e-12, abs=1e-300), (k, p)
    box = {r.k: r.q50 for r in statistics.box_stats(df, "v", "k").collect()}
    assert box["none"] is None and box["one"] == 7.5 and set(box) == set(groups) | {"none"}


def test_no_task_of_a_quantile_sees_all_values(spark):
    """A million different doubles in two groups: what is settled by rank is a small part of them."""
    df = spark.range(1_000_000).select((F.col("id") % 2).alias("k"), F.sqrt("id").alias("v"))
    got = {r.k: r.q for r in statistics.grouped_quantiles(df, "v", "k", (0.25, 0.5)).collect()}
    for k in (0, 1):
        x = np.sqrt(np.arange(k, 1_000_000, 2))
        assert got[k] == pytest.approx([np.quantile(x, 0.25), np.quantile(x, 0.5)], rel=1e-12)


def test_lemmas_by_table_and_suffix(spark):
    table = spark.createDataFrame([("houses", "house"), ("mice", "mouse"), ("walking", "walk"), ("talking", "talk"), ("being", "be"), ("cats", "cat"), ("dogs", "dog"), ("bus", "bus")], "form string, lemma string")
    words = spark.createDataFrame([(w, n) for w, n in [("mice", 2), ("mouse", 1), ("barking", 3), ("birds", 4), ("bird", 1), ("tree", 5), ("s", 1), ("dogs", 1), ("dogs", 0)]], "word string, count long")
    got = {r.word: r.lemma for r in association.lemmas(words, table).collect()}
    assert got == {"mice": "mouse", "mouse": "mouse", "barking": "bark", "birds": "bird", "bird": "bird", "tree": "tree", "s": "s", "dogs": "dog"}
    assert {r.lemma: r["count"] for r in association.lemma_counts(words, table).collect()}["bird"] == 5
    rules = {r.suffix: (r.cut, r.add) for r in association.suffix_rules(table).collect()}
    assert rules["ing"] == ("ing", "") and rules["s"] == ("s", "") and "mice" in rules and rules["mice"] == ("ice", "ouse")


def test_lemma_counts_read_their_words_once(spark):
    """the counts and the table were made anew for every join."""
    seen = spark.sparkContext.accumulator(0)

    def mark(w):
        seen.add(1)
        return w

    marked = F.udf(mark, "string").asNondeterministic()
    counts = spark.range(40).select(marked(F.concat(F.lit("word"), F.col("id").cast("string"))).alias("word"), F.lit(2).alias("count"))
    table = spark.range(10).select(marked(F.concat(F.lit("word"), F.col("id").cast("string"))).alias("form"), F.lit("x").alias("lemma"))
    assert sum(r.forms for r in association.lemma_counts(counts, table).collect()) == 40
    assert seen.value == 50


def test_words_are_split_once(spark):
    """a regular expression put a blank between all words before these were split."""
    texts = ["Ein Haus, ÄÖÜß äöü", "xTwitterUsery İK 5ẞ Kelvin\n\tA-b_c", "", None, "🙂a😀B ", "İstanbul ſtraße Å ÉCOLE", "TwitterTwitterUserUser"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = F.split(F.lower(T.letters_only(F.col("text"))), " ")
    full = lambda c: F.filter(c, lambda w: w != "")
    assert df.filter(~full(old).eqNullSafe(full(association.raw_tokens(F.col("text"))))).count() == 0
    assert "regexp_replace" not in str(association.raw_tokens(F.col("text")))


def test_densities_of_counts_and_bins(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 60, size=4000)
    df = spark.createDataFrame([("a" if i % 3 else "b", int(v)) for i, v in enumerate(x)], "k string, v int")
    points = [float(p) for p in np.linspace(0, 60, 64)]
    exact = {(r.k, r.point): r.density for r in statistics.density(df, "v", "k", points, 4.0).collect()}
    binned = {(r.k, r.point): r.density for r in statistics.density(df.withColumn("v", F.col("v") + 0.0), "v", "k", points, 4.0, bin_width=0.25).collect()}
    for k, own in (("a", x[np.arange(4000) % 3 > 0]), ("b", x[::3])):
        for p in points:
            want = np.exp(-0.5 * ((own - p) / 4.0) ** 2).mean() / (4.0 * np.sqrt(2 * np.pi))
            assert exact[k, p] == pytest.approx(want, rel=1e-9) and binned[k, p] == pytest.approx(want, abs=2e-3 * 0.1)


def test_rows_move_once_for_ranks_and_their_counts(spark):
    """One exchange of rows, null strata among them, whatever the join."""
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = []
    try:
        for limit in ("-1", old):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            out = splits.hashed_rank(df, ["s"], F.col("k").cast("string"), ["k"], bins=64)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert limit != "-1" or plan.count("Exchange hashpartitioning") == 4 and "SortMergeJoin" in plan  # of rows one, of counts three
            found.append(sorted((r.s or 0, r._rank, r._n) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found[0] == found[1] == [(s, i, 1000) for s in range(3) for i in range(1000)]
