"""Agreement, splits, associations and statistics against plain Python."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexeum import schema
from lexeum.operators import agreement as A
from lexeum.operators import association, splits, statistics
from lexeum.plans import catalogue


def kappa(votes):
    """Plain kappa of (item, label) pairs."""
    items = {}
    for i, x in votes:
        items.setdefault(i, Counter())[x] += 1
    seen = [(sum(c * c for c in v.values()) - v.total()) / (v.total() * (v.total() - 1)) for v in items.values() if v.total() > 1]
    total = Counter(x for _, x in votes)
    pe = sum((c / total.total()) ** 2 for c in total.values())
    return (sum(seen) / len(seen) - pe) / (1 - pe)


def some_votes(n=60, raters=5, seed=1, holes=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        truth = rng.choice("abc")
        for r in range(raters):
            if not holes or rng.random() < 0.8:
                out.append((i, r, truth if rng.random() < 0.4 + 0.1 * r else rng.choice("abc")))
    return out


def frame(spark, votes):
    return spark.createDataFrame(votes, "item int, rater int, label string")


def test_published_value(spark):
    """52 items of two raters: 15 both positive, 3 positive by one, 34 negative."""
    votes = [(i, r, "y" if i < 15 or (i < 18 and r == 48) else "n") for i in range(52) for r in (48, 54)]
    assert A.fleiss_kappa(frame(spark, votes), "item", "label").first().kappa == pytest.approx(0.866837, abs=5e-7)


@pytest.mark.parametrize("holes", [False, True])
def test_kappa_and_leave_one_out(spark, holes):
    votes = some_votes(holes=holes)
    df = frame(spark, votes)
    assert A.fleiss_kappa(df, "item", "label").first().kappa == pytest.approx(kappa([(i, x) for i, _, x in votes]))
    got = {r.without: r.kappa for r in A.leave_one_out(df, "item", "rater", "label").collect()}
    assert got == {w: pytest.approx(kappa([(i, x) for i, r, x in votes if r != w])) for w in range(5)}


def test_complete_agreement_has_no_kappa(spark):
    assert A.fleiss_kappa(frame(spark, [(1, 1, "a"), (1, 2, "a")]), "item", "label").first().kappa is None


def test_two_votes_of_a_rater(spark):
    df = frame(spark, [(1, 1, "a"), (1, 1, "b")])
    with pytest.raises(Exception, match="voted twice"):
        A.check_one_vote_each(df, "item", "rater").collect()
    assert A.check_one_vote_each(frame(spark, some_votes(3)), "item", "rater").count() == 15


def test_expert_and_prefixes(spark):
    votes = some_votes()
    df = frame(spark, votes).withColumn("split", F.when(F.col("item") % 3 == 0, "train").when(F.col("item") % 3 == 1, "val").otherwise("test"))
    ranked = A.expert_agreement(df, "item", "rater", "label", 4)
    got = {r.rater: r.kappa for r in ranked.collect()}
    assert got == {r: 1.0 if r == 4 else pytest.approx(kappa([(i, x) for i, s, x in votes if s in (r, 4)])) for r in range(5)}
    order = sorted(got, key=lambda r: (-got[r], r))
    rows = A.prefix_groups(ranked, df, "item", "rater", "label", "split", "a").orderBy("rank").collect()
    assert [r.members for r in rows] == [order[: k + 1] for k in range(5)]
    assert rows[0].kappa == 1.0 and rows[4].kappa == pytest.approx(kappa([(i, x) for i, _, x in votes]))
    assert rows[0].bound == f"{got[order[1]]:.4f} < x ≤ 1.0000" and rows[4].bound == f"x ≥ {got[order[4]]:.4f}"
    assert rows[1].posts_total == 120 and rows[1].posts_train == 40
    share = [x for i, r, x in votes if r in order[:2] and i % 3 == 0]
    assert rows[1].share_train == pytest.approx(100 * share.count("a") / len(share))


def test_buckets(spark):
    votes = some_votes()
    df = frame(spark, votes)
    ranked = spark.createDataFrame([(0, "fair"), (1, "fair"), (2, "poor"), (3, "moderate")], "rater int, interpretation string")
    got = {r.bucket: (r.n_raters, r.kappa) for r in A.bucket_kappas(df, ranked, "item", "rater", "label", {"both": ["fair", "moderate"]}).collect()}
    pick = lambda rs: pytest.approx(kappa([(i, x) for i, r, x in votes if r in rs]))
    assert got == {"fair": (2, pick([0, 1])), "poor": (1, None), "moderate": (1, None), "both": (3, pick([0, 1, 3]))}


@pytest.mark.parametrize("n,k", [(7, 3), (9, 5), (5, 1), (3, 5)])
def test_quorums_closed_form_and_enumeration(spark, n, k):
    rng = random.Random(n)
    votes = [(i, r, rng.choice("yn")) for i in range(4) for r in range(n)]
    df = frame(spark, votes)
    want = {}
    for i in range(4):
        own = [x for j, _, x in votes if j == i]
        won = [sum(x == "y" for x in c) * 2 > k for c in itertools.combinations(own, k)]
        want[i] = (len(won), sum(won))
    assert {r.item: (r.groups, r.positive_groups) for r in A.quorum_majorities(df, "item", "label", "y", k).collect()} == want
    rows = A.quorums(df, "item", "rater", "label", k).collect()
    got = {i: (0, 0) for i in range(4)}
    for r in rows:
        got[r.item] = (got[r.item][0] + 1, got[r.item][1] + (r.label == "y"))
    assert got == want


def test_quorum_errors_and_samples(spark):
    df = frame(spark, [(i, r, "y") for i in range(3) for r in range(6)])
    for size, combos in ((2, None), (3, 1)):
        with pytest.raises(ValueError):
            A.quorums(df, "item", "rater", "label", size, combos)
    rows = A.quorums(df, "item", "rater", "label", 3, 4)
    assert rows.count() == 12 and {r.group_id for r in rows.collect()} == {1, 2, 3, 4}
    assert A.quorums(df, "item", "rater", "label", 5, 100).count() == 3 * 6


@pytest.mark.parametrize("n,k", [(5, 3), (6, 1), (7, 7), (9, 5)])
def test_groups_come_from_their_ranks(spark, n, k):
    rows = spark.range(math.comb(n, k)).select("id", A._unranked(F.col("id"), F.lit(n), F.lit(math.comb(n, k)), k).alias("c"))
    assert [tuple(r.c) for r in rows.orderBy("id").collect()] == list(itertools.combinations(range(n), k))


def test_listed_groups_have_order_and_label(spark, monkeypatch):
    """All groups, listed or made from their ranks, against plain Python: labels that tie, and missing ones."""
    rng = random.Random(11)
    votes = [(i, r, rng.choice(["a", "b", "c", None])) for i, n in enumerate((0, 1, 3, 4, 7, 9)) for r in range(n)]
    df = spark.createDataFrame(votes, "item long, rater long, label string")
    for k in (1, 3, 5, 7):
        want = {}
        for i in range(6):
            own = [x for j, _, x in votes if j == i]
            for g, c in enumerate(itertools.combinations(own, k), 1):
                said = [x for x in c if x is not None]
                want[i, g] = min(set(said), key=lambda x: (-said.count(x), x)) if said else None
        for listed in (7, 0):
            monkeypatch.setattr(A, "LISTED_SIZE", listed)
            rows = A.quorums(df, "item", "rater", "label", k).collect()
            assert {(r.item, r.group_id): r.label for r in rows} == want and len(rows) == len(want), (k, listed)


def test_groups_of_one_item_are_not_held(spark):
    """1,331,334,000 groups of one item, of which some are looked at: their ranks are no array."""
    df = spark.range(2000).select(F.lit(1).alias("item"), F.col("id").alias("rater"), F.lit("y").alias("label"))
    assert [r.group_id for r in A.quorums(df, "item", "rater", "label", 3).take(5000)] == list(range(1, 5001))


def test_samples_of_many_groups(spark):
    """77,558,760 groups of one item, of which five are made: different ones, the same on each run."""
    rng = random.Random(3)
    votes = [(i, r, rng.choice("abc")) for i in range(3) for r in range(29)]
    df = frame(spark, votes)
    one, two = (sorted(map(tuple, A.quorums(x, "item", "rater", "label", 15, 5).collect())) for x in (df, df.repartition(3)))
    assert one == two and len(one) == 15
    total = math.comb(29, 15)
    ranks = spark.createDataFrame([(0,), (1,), (total // 2,), (total - 1,)], "id long")
    got = [tuple(r.c) for r in ranks.select(A._unranked(F.col("id"), F.lit(29), F.lit(total), 15).alias("c")).collect()]
    assert got[0] == tuple(range(15)) and got[1] == (*range(14), 15) and got[3] == tuple(range(14, 29)) and len(set(got[2])) == 15
    big = frame(spark, [(1, r, "ny"[r % 3 == 0]) for r in range(60)])
    assert len(set(map(tuple, A.quorums(big, "item", "rater", "label", 29, 200).select("group_id", "label").collect()))) == 200
    r = A.quorum_majorities(big, "item", "label", "y", 29).first()
    assert r.groups == math.comb(60, 29) and r.positive_groups == sum(math.comb(20, j) * math.comb(40, 29 - j) for j in range(15, 21))
    huge = frame(spark, [(1, r, "ny"[r % 3 == 0]) for r in range(100)])
    r = A.quorum_majorities(huge, "item", "label", "y", 41, exact=True).first()
    assert int(r.groups) == math.comb(100, 41) and int(r.positive_groups) == sum(math.comb(34, j) * math.comb(66, 41 - j) for j in range(21, 35))


@pytest.mark.parametrize("listed", [1 << 16, 8])
def test_samples_are_uniform(spark, monkeypatch, listed):
    """Over many items every group of three of six is drawn as often as any other, and so is every pair of groups; both ways of drawing."""
    monkeypatch.setattr(A, "LISTED", listed)
    n = 6000
    rows = spark.range(n).select(F.col("id").alias("item"), F.lit(20).cast(A.WHOLE).alias("all"), F.lit(4).cast("long").alias("m"))
    got = [tuple(int(x) for x in r.ranks) for r in A._drawn(rows, "item", 7).collect()]
    assert all(len(set(r)) == 4 and r == tuple(sorted(r)) and 0 <= r[0] and r[3] < 20 for r in got)
    ones = Counter(x for r in got for x in r)
    pairs = Counter(p for r in got for p in itertools.combinations(r, 2))
    chi = sum((ones[x] - n * 4 / 20) ** 2 / (n * 4 / 20) for x in range(20))
    chi2 = sum((pairs[p] - n * 6 / 190) ** 2 / (n * 6 / 190) for p in itertools.combinations(range(20), 2))
    assert chi < 45 and chi2 < 260  # 19 and 189 degrees of freedom: one in a thousand


def test_samples_are_the_ranks_of_least_hash(spark):
    rng = random.Random(8)
    votes = [(i, r, rng.choice("abc")) for i in range(30) for r in range(2 + i % 7)]
    got = {(r.item, r.group_id): r.label for r in A.quorums(frame(spark, votes), "item", "rater", "label", 3, 6, seed=5).collect()}
    want = {}
    for i in range(30):
        own = [x for j, _, x in votes if j == i]
        groups = list(itertools.combinations(own, 3))
        picked = sorted(sorted(range(len(groups)), key=lambda k: hashlib.md5(f"5|{i}|{k}".encode()).hexdigest())[:6])
        for g, k in enumerate(picked):
            c = Counter(groups[k])
            want[i, g + 1] = min(x for x in c if c[x] == max(c.values()))
    assert got == want


def test_prefixes_with_votes_missing_and_repeated(spark):
    votes = some_votes(holes=True) + [(3, 1, "a"), (3, 1, "b"), (7, 2, "c")]
    df = frame(spark, votes)
    ranked = spark.createDataFrame([(r, 1.0 - r / 10) for r in range(5)], "rater int, kappa double")
    got = {r["rank"]: r.kappa for r in A.prefix_groups(ranked, df, "item", "rater", "label").collect()}
    assert got == {k: 1.0 if k == 1 else pytest.approx(kappa([(i, x) for i, r, x in votes if r < k])) for k in range(1, 6)}


def test_encodings_and_matrix(spark):
    votes = some_votes()
    df = frame(spark, votes)
    two = F.when(F.col("label") == "a", "a").otherwise("o")
    got = {r.encoding: r.kappa for r in A.kappa_by_encoding(df, "item", {"raw": F.col("label"), "two": two}).collect()}
    assert got["two"] == pytest.approx(kappa([(i, x if x == "a" else "o") for i, _, x in votes]))
    phased = df.withColumn("phase", F.col("item") % 2)
    rows = A.result_matrix(phased, "item", "rater", ["label"], "phase").collect()
    assert len(rows) == 12
    for w in range(5):
        assert next(r.kappa for r in rows if r.without == str(w) and r.phase == 1) == pytest.approx(kappa([(i, x) for i, r, x in votes if i % 2 and r != w]))
    all0 = next(r.kappa for r in rows if r.without == "All" and r.phase == 0)
    assert all0 == pytest.approx(kappa([(i, x) for i, _, x in votes if i % 2 == 0]))


# ------------------------------------------------------------------ splits


def test_kappa_does_not_hang_on_the_order_of_items(spark):
    """means over many items were sums of doubles, off in the ninth digit at 1 GB."""
    n = 90_000
    votes = spark.range(0, 3 * n, 1, 3).selectExpr("id div 3 as item", "id % 3 as rater", "case when id div 3 % 7 = 0 or id % 3 < 1 + id div 3 % 2 then 'a' else 'b' end as label")
    same = sum(i % 7 == 0 for i in range(n))
    odd = sum(i % 2 for i in range(n) if i % 7)
    a = Fraction(3 * same + 2 * odd + (n - same - odd), 3 * n)
    p_e = a * a + (1 - a) ** 2
    want = float(((same + Fraction(n - same, 3)) / n - p_e) / (1 - p_e))
    assert A.fleiss_kappa(votes, "item", "label").first().kappa == pytest.approx(want, abs=2e-16, rel=2e-15)
    table = spark.createDataFrame([(r, "slight") for r in range(3)], "rater long, interpretation string")
    assert A.bucket_kappas(votes, table, "item", "rater", "label").first().kappa == pytest.approx(want, abs=2e-16, rel=2e-15)
    got = {r.without: r.kappa for r in A.leave_one_out(votes, "item", "rater", "label", whole=True).collect()}
    assert got[None] == pytest.approx(want, abs=2e-16, rel=2e-15)


def test_a_task_sorts_no_more_votes_where_there_are_more(spark, monkeypatch):
    """F4 to F8: votes lay in as many partitions for any number of them."""
    monkeypatch.setattr(A, "TASK_VOTES", 100)
    df = frame(spark, some_votes(n=400))
    parts = A.dealt(df, "item")
    assert parts.rdd.getNumPartitions() == 20 and A.dealt(df.limit(10), "item").rdd.getNumPartitions() == 4
    assert parts.rdd.glom().map(len).reduce(max) < 220
    assert catalogue.ratings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4
    one, two = ({r.without: r.kappa for r in A.leave_one_out(x, "item", "rater", "label").collect()} for x in (parts, df))
    assert one == pytest.approx(two)


def test_votes_of_many_partitions_are_dealt_twice(spark, monkeypatch):
    """F7, F8: past the number of partitions that tasks write to directly, no task holds all the votes it has read."""
    monkeypatch.setattr(A, "TASK_VOTES", 10)
    votes = some_votes(n=500)
    df = frame(spark, votes)
    parts = A.dealt(df, "item")
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(item#\d+, (\d+)\), REPARTITION_BY_NUM", plan) == ["250", "200"]
    assert sorted(map(tuple, parts.collect())) == sorted(votes)
    assert parts.select("item", F.spark_partition_id()).distinct().count() == 500
    one, two = ({r.rater: r.kappa for r in A.expert_agreement(x, "item", "rater", "label", 4).collect()} for x in (parts, df))
    assert one == pytest.approx(two)
    few = df.limit(100)
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        assert A.dealt(few, "item").rdd.getNumPartitions() == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_what_is_dealt_again_is_only_what_is_left(spark, monkeypatch):
    """F8: the second exchange moved all columns once more, though only item, rater and label were wanted."""
    plan = lambda: catalogue.ratings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    one = sorted(map(tuple, catalogue.ratings(spark, "/root/testdata/sf0.001").collect()))
    assert plan().count("REPARTITION_BY_NUM") == 1
    monkeypatch.setattr(A, "TASK_VOTES", 20)
    top, bottom = plan().split("Window [row_number()")
    assert top.count("REPARTITION_BY_NUM") == bottom.count("REPARTITION_BY_NUM") == 1
    assert sorted(map(tuple, catalogue.ratings(spark, "/root/testdata/sf0.001").collect())) == one


@pytest.mark.parametrize("task_votes", [500_000, 20])
def test_prefixes_read_the_votes_of_their_ranking_once(spark, monkeypatch, task_votes):
    """F8: the ranking was a job of its own, which read and dealt all votes before the prefixes did so again."""
    monkeypatch.setattr(A, "TASK_VOTES", task_votes)
    votes = catalogue.ratings(spark, "/root/testdata/sf0.001")

    def prefixes():
        return A.prefix_groups(A.expert_agreement(votes, "item", "rater", "label", 1), votes, "item", "rater", "label")

    out = prefixes()
    got = {r["rank"]: (r.members, r.kappa) for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")]
    assert plan.count("Scan parquet") == 1 and re.search(r"ReusedExchange.*hashpartitioning\(item#.*REPARTITION_BY_NUM", plan)
    rows = votes.collect()
    assert got and got == {k: (m, 1.0 if k == 1 else pytest.approx(kappa([(r["item"], r.label) for r in rows if r.rater in m]))) for k, (m, _) in got.items()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {r["rank"]: (r.members, r.kappa) for r in prefixes().collect()} == {k: (m, x if k == 1 else pytest.approx(x)) for k, (m, x) in got.items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_stratified_sizes_and_reruns(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 200, "a").when(F.col("id") < 998, "b"))
    one = splits.stratified_split(df, "s", "id")
    sizes = {(r.s, r.split): r["count"] for r in one.groupBy("s", "split").count().collect()}
    assert sizes[("a", "train")] == 120 and sizes[("a", "val")] == 30 and sizes[("a", "test")] == 50
    assert sum(v for (s, _), v in sizes.items() if s is None) == 2 and one.count() == 1000
    two = splits.stratified_split(df.repartition(7), "s", "id")
    assert one.exceptAll(two).count() == 0
    assert one.exceptAll(splits.stratified_split(df, "s", "id", seed=1)).count() > 0


def test_split_errors(spark):
    df = spark.range(3)
    for fractions in ((0.5, 0.5, 0.5), (0.6, 0.4), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            splits.stratified_split(df, "id", "id", fractions)
    with pytest.raises(ValueError, match="nope"):
        splits.stratified_split(df, "nope", "id")


def test_only_missing_splits_are_assigned(spark):
    rows = [{"text": f"t{i}", "source": "s", "split": "test" if i < 10 else None, "toxic": float(i % 2) if i % 3 else None} for i in range(210)]
    df = schema.from_rows(spark, rows)
    got = splits.assign_missing_splits(df)
    assert got.columns == df.columns and got.count() == 210 and got.filter("split is null").count() == 0
    assert {r.split for r in got.filter(F.col("text").isin([f"t{i}" for i in range(10)])).collect()} == {"test"}
    shares = {(r.split, r.toxic): r.share for r in splits.split_shares(got, "toxic").collect()}
    assert abs(sum(v for (s, _), v in shares.items() if s == "train") - 1) < 1e-9


# ------------------------------------------------------------------ words


def test_token_cleaning(spark):
    df = spark.createDataFrame([("TwitterUser Die HURE ist so schön, 123 schöne! ab Haus",)], "t string")
    got = df.select(association.clean_tokens(F.col("t"), stop_words=["die", "IST"]).alias("a"), association.clean_tokens(F.col("t"), for_transformer=True).alias("b")).first()
    assert got.a == ["schön", "schöne", "haus"]
    assert got.b == ["die", "hure", "ist", "so", "schön", "schöne", "ab", "haus"]


def test_npmi(spark):
    docs = [(0, "x", ["a", "b", "a"]), (1, "x", ["a", "c"]), (2, "y", ["a", "c", "c"]), (3, "y", ["c", "d"]), (4, None, ["c"])]
    df = spark.createDataFrame(docs, "doc int, cls string, words array<string>")
    got = {(r.cls, r.word): r.npmi for r in association.npmi(df, "words", "cls").collect()}
    n = 11
    want = lambda xy, x, y: math.log((xy / n) / ((x / n) * (y / n))) / -math.log(xy / n)
    assert got == {("x", "a"): pytest.approx(want(3, 2, 4)), ("y", "c"): pytest.approx(want(3, 2, 5))}
    top = association.top_words(association.npmi(df, "words", "cls"), "cls", 1, 100).collect()
    assert {(r.cls, r.word, r["rank"]) for r in top} == {("x", "a", 1), ("y", "c", 1)}


# ------------------------------------------------------------------ statistics


def test_empty_table_statistics(spark):
    df = schema.from_rows(spark, [])
    assert statistics.label_stats(df).count() == 5
    assert {r.pos_rate for r in statistics.label_stats(df).collect()} == {None}
    for f in (statistics.split_stats, statistics.null_texts, statistics.missing_rates, statistics.summary, statistics.positive_negative, statistics.length_stats):
        assert f(df).count() == 0
    assert statistics.labels_with_data(df).first()[0] == 0


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("s", " ".join(["w"] * n)) for n in range(1, 51)], "source string, text string")
    r = statistics.length_stats(df).first()
    assert r.p99 == pytest.approx(49.51) and r.median == 25.5 and r.min == 1 and r.max == 50
    assert max(x.clipped for x in statistics.clipped_lengths(df).collect()) == pytest.approx(49.51)


def test_summary_row(spark):
    rows = [{"text": "a", "source": "s", "language": "de", "split": "train", "toxic": 1.0}, {"text": "b", "source": "s", "language": "en", "split": "None", "toxic": 0.0}]
    r = statistics.summary(schema.from_rows(spark, rows)).first()
    assert (r.languages, r.labels, r.rates, r.splits, r.no_split) == ("de, en", "toxic", "toxic: 50.0%", "train: 1", 1)


def test_exact_quantiles_of_any_numbers(spark):
    rng = random.Random(5)
    for values in ([rng.gauss(0, 1) for _ in range(501)], [1.0] * 50 + [2.0], [rng.expovariate(1e-3) ** 5 for _ in range(200)], [-1.7e308, 0.0, 1.7e308], [1.0, 1.0000000000000002], [7.0]):
        df = spark.createDataFrame([(v,) for v in values + [float("nan")]] + [(None,)], "x double").repartition(3)
        s = sorted(values)
        want = [s[int(v)] + (v - int(v)) * (s[min(len(s) - 1, int(v) + 1)] - s[int(v)]) for v in ((len(s) - 1) * p for p in (0.0, 0.25, 0.5, 0.99, 1.0))]
        assert statistics.exact_quantiles(df, "x", (0.0, 0.25, 0.5, 0.99, 1.0), bins=8) == [pytest.approx(w) for w in want]
    assert statistics.exact_quantiles(spark.createDataFrame([], "x double"), "x", (0.5,)) == [None]
    assert statistics.describe(spark.createDataFrame([], "x int"), "x").first()["count"] == 0


def test_dense_ranks_of_many_values(spark):
    df = spark.createDataFrame([(f"v{i % 300:03d}",) for i in range(1000)] + [(None,)], "c string")
    assert [(r.c, r["rank"]) for r in statistics.dense_ranks(df, "c", bins=8).orderBy("rank").collect()] == [(f"v{i:03d}", i + 1) for i in range(300)]
    assert statistics.dense_ranks(df.limit(0), "c").count() == 0


def test_rows_in_front_and_names(spark):
    from lexeum.functions import text as T

    df = spark.createDataFrame([("2",), ("All",), ("1",)], "w string")
    assert [r.w for r in statistics.last_first(df, "w", "All").collect()] == ["All", "1", "2"]
    r = spark.range(1).select(T.capitalised(F.lit("almost Perfect")).alias("a"), T.thousands(F.lit(1234567)).alias("b"), T.percent(F.lit(12.345), 1, blank=False).alias("c"), T.numeric(F.lit("١٢½")).alias("d"), T.numeric(F.lit("1a")).alias("e")).first()
    assert tuple(r) == ("Almost perfect", "1,234,567", "12.3%", True, False)
