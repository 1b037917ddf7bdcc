"""Agreement of annotators on a long table of votes (item, rater, label).

Kappa needs, of each item, only how often each label was given: two small
aggregations, never a matrix. Groups (a rater left out, a prefix of a ranking)
are one more grouping key, so all groups are computed in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeum.functions import text as T
from lexeum.functions.labels import kappa_bucket
from lexeum.session import scratch_path


#: Votes that one task sorts.
TASK_VOTES = 500_000


def dealt(votes: DataFrame, *item: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The votes dealt by item to as many partitions as their number needs (they are counted by a job), so that no task's memory grows with them. What is grouped by item afterwards stays where it is.

    Up to as many partitions as ``spark.shuffle.sort.bypassMergeThreshold``
    tells, tasks write votes to files as they come; to more, a task first holds
    all that it has read. So votes that need more are dealt twice: to so many
    partitions, and from there on, where a task has its share of them.
    ``then``, a function of the votes that keeps the item's columns and needs
    only an item's votes together, is applied once they first are: what it
    drops does not move again.
    """
    conf = votes.sparkSession.conf
    direct = max(int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200")), 1)
    parts = max(min(int(conf.get("spark.sql.shuffle.partitions")), direct), -(-votes.count() // TASK_VOTES))
    votes = votes.repartition(min(parts, direct), *item)
    votes = then(votes) if then else votes
    if parts > direct:
        votes = votes.filter(F.spark_partition_id() >= 0).repartition(parts, *item)  # always true; two exchanges in a row would be made one
    return votes


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """A small table that several parts of a plan read, written to the shared folder by a job."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _agreeing(sq: Column, r: Column) -> Column:
    """The share of pairs of an item's ``r`` votes that agree, from the sum of its squared label counts."""
    return F.try_divide(sq - r, r * (r - 1))


def fleiss_kappa(votes: DataFrame, item: str, label: str, by: Sequence[str] = (), rater: str | None = None) -> DataFrame:
    """(by..., kappa): null where chance agreement is complete. Items with one vote do not enter the observed agreement.

    With ``rater`` the votes are checked to be one a rater and item (and group).
    Items are counted by their votes and squared label counts, whole numbers, so
    that the result hangs neither on the number of items nor on their order.
    """
    by = list(by)
    votes = check_one_vote_each(votes, item, rater, by) if rater else votes
    own = Window.partitionBy(*by, item)
    n_ij = votes.groupBy(*by, item, label).agg(F.count("*").alias("n"))
    each = n_ij.select(*by, label, "n", F.sum("n").over(own).alias("r"), F.sum(F.col("n") * F.col("n")).over(own).alias("sq"))
    few = each.groupBy(*by, label, "n", "r", "sq").agg(F.count("*").alias("c"))  # a row's c items have n of their r votes for the label
    items = few.groupBy(*by, "r", "sq").agg(F.expr("sum(c * n) div r").alias("m"))
    shares = few.groupBy(*by, label).agg(F.sum(F.col("c") * F.col("n")).alias("c"))
    seen = F.try_divide(F.sum(F.col("m") * _agreeing(F.col("sq"), F.col("r"))), F.sum(F.when(F.col("r") > 1, F.col("m")))).alias("p_bar")
    if by:
        observed = items.groupBy(*by).agg(seen)
        chance = shares.groupBy(*by).agg(F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("c").alias("t"))
        both = observed.join(chance, by)
    else:
        both = items.agg(seen).crossJoin(shares.agg(F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("c").alias("t")))  # one row each
    p_e = F.col("cc") / (F.col("t").cast("double") * F.col("t"))
    return both.select(*by, F.try_divide(F.col("p_bar") - p_e, 1.0 - p_e).alias("kappa"))


def check_one_vote_each(votes: DataFrame, item: str, rater: str, by: Sequence[str] = ()) -> DataFrame:
    """The votes, or an error where a rater voted twice on an item (raised when the result is read)."""
    twice = F.count("*").over(Window.partitionBy(*by, item, rater)) > 1
    marked = votes.withColumn("_twice", twice)
    return marked.filter(F.when(F.col("_twice"), F.raise_error(F.lit("a rater voted twice on an item")).cast("boolean")).otherwise(True)).drop("_twice")


def leave_one_out(votes: DataFrame, item: str, rater: str, label: str, by: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """(by..., without, kappa): the agreement of the others, for each rater; with ``whole`` also a row with a null rater, of all.

    An item's label counts without a rater are those of all less the rater's
    own, so votes are not multiplied by raters: each vote knows its item's
    totals from one exchange, and a rater's own items are corrected. Votes are
    then counted by whole numbers, of which there are few, and all that is left
    comes from these counts.
    """
    by = list(by)
    v = votes.select(*by, F.col(item).alias("_i"), F.col(rater).alias("without"), F.col(label).alias("_l"))
    item_w, own_w = Window.partitionBy(*by, "_i"), Window.partitionBy(*by, "_i", "without")
    v = v.withColumn("n", F.count("*").over(Window.partitionBy(*by, "_i", "_l")))
    v = v.withColumns({"r": F.count("*").over(item_w), "sq": F.sum("n").over(item_w)})
    v = v.withColumn("same", F.count("*").over(Window.partitionBy(*by, "_i", "without", "_l")))
    v = v.withColumns({"k": F.count("*").over(own_w), "d": F.sum(2 * F.col("n") - F.col("same")).over(own_w)})
    few = v.groupBy(*by, "without", "_l", "r", "sq", "k", "d").agg(F.count("*").alias("m"))  # m votes, k of them on an item
    agree = lambda sq, r: F.coalesce(_agreeing(sq, r), F.lit(0.0))
    new_r, new_sq = F.col("r") - F.col("k"), F.col("sq") - F.col("d")
    own = few.groupBy(*by, "without", "r", "sq", "k", "d").agg(F.expr("sum(m) div k").alias("c"))
    mine = own.groupBy(*by, "without").agg(
        F.sum(F.col("c") * (agree(new_sq, new_r) - agree(F.col("sq"), F.col("r")))).alias("dp"),
        F.sum(F.col("c") * ((F.col("r") > 1).cast("long") - (new_r > 1).cast("long"))).alias("dn"),
    )
    items = few.groupBy(*by, "r", "sq").agg(F.expr("sum(m) div r").alias("c"))
    group = Window.partitionBy(*by, "_g")
    totals = items.groupBy(*by).agg(F.sum(F.col("c") * agree(F.col("sq"), F.col("r"))).alias("p"), F.coalesce(F.sum(F.when(F.col("r") > 1, F.col("c"))), F.lit(0)).alias("pn"))
    mine = mine.join(F.broadcast(totals), by) if by else mine.crossJoin(F.broadcast(totals))  # a row a group
    marks = few.groupBy(*by, "without", "_l").agg(F.sum("m").alias("m")).withColumn("_g", F.lit(0))
    marks = marks.withColumn("c", F.sum("m").over(Window.partitionBy(*by, "_g", "_l")))
    less = marks.groupBy(*by, "_g", "without").agg(F.sum(2 * F.col("c") * F.col("m") - F.col("m") * F.col("m")).alias("dcc"), F.sum("m").alias("dt"), F.sum(F.col("c") * F.col("m")).alias("cc"))
    less = less.select(*by, "without", "dcc", "dt", F.sum("cc").over(group).alias("cc"), F.sum("dt").over(group).alias("t"))
    both = mine.join(less, [*by, "without"])

    def kappa(p, n, cc, t) -> Column:
        p_e = F.try_divide(cc.cast("double"), t.cast("double") * t)
        return F.try_divide(F.try_divide(p, n) - p_e, 1.0 - p_e).alias("kappa")

    c = F.col
    if not whole:
        return both.select(*by, "without", kappa(c("p") + c("dp"), c("pn") - c("dn"), c("cc") - c("dcc"), c("t") - c("dt")))
    both = both.withColumn("_g", F.lit(0))  # a row a rater
    first = F.row_number().over(group.orderBy("without")) == 1
    rest = F.struct(c("without"), kappa(c("p") + c("dp"), c("pn") - c("dn"), c("cc") - c("dcc"), c("t") - c("dt")))
    everyone = F.struct(F.lit(None).cast(both.schema["without"].dataType).alias("without"), kappa(c("p"), c("pn"), c("cc"), c("t")))
    return both.withColumn("_f", first).select(*by, F.explode(F.when(c("_f"), F.array(rest, everyone)).otherwise(F.array(rest))).alias("_r")).select(*by, "_r.*")


def expert_agreement(votes: DataFrame, item: str, rater: str, label: str, expert) -> DataFrame:
    """(rater, kappa, interpretation) of each rater with the expert on the items both voted on; the expert's own is 1."""
    said = F.collect_list(F.when(F.col(rater) == expert, F.col(label))).over(Window.partitionBy(item))
    pairs = votes.select(item, rater, label, said.alias("_e")).filter(F.col(rater) != expert)
    pairs = pairs.select(item, rater, label, F.explode("_e").alias("_e"))  # what the expert said of the item, if anything
    both = pairs.select(rater, item, F.explode(F.array(label, "_e")).alias(label))
    k = fleiss_kappa(both, item, label, [rater])
    own = votes.sparkSession.range(1).select(F.lit(expert).cast(votes.schema[rater].dataType).alias(rater), F.lit(1.0).alias("kappa"))
    return k.unionByName(own).withColumn("interpretation", kappa_bucket(F.col("kappa")))


def prefix_groups(ranked: DataFrame, votes: DataFrame, item: str, rater: str, label: str, split: str | None = None, positive=None) -> DataFrame:
    """For each prefix of a ranking (rater, kappa descending): bounds, size, members, the prefix's own kappa, and with ``split`` its posts and share of ``positive``.

    A vote enters its item at its rater's rank and changes the item's agreement
    there; kappa of all prefixes is a running sum of these changes, so votes are
    not copied for the prefixes. The ranking has one row a rater; where it is
    made of the same votes, the plan reads and deals them once for both.
    """
    w = Window.orderBy(F.desc("kappa"), rater)
    ranked = ranked.select(rater, "kappa")
    if ranked.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
        ranked = _stored(ranked, "ranking")  # else the broadcast below would wait for the whole ranking, and give up after a while
    r = ranked.select(rater, "kappa", F.row_number().over(w).alias("rank"), F.lead("kappa").over(w).alias("next"), F.collect_list(rater).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("members"))
    bound = F.when(F.col("next").isNull(), F.concat(F.lit("x ≥ "), T.fixed(F.col("kappa"), 4))).otherwise(F.concat(T.fixed(F.col("next"), 4), F.lit(" < x ≤ "), T.fixed(F.col("kappa"), 4)))
    heads = r.select("rank", bound.alias("bound"), F.size("members").alias("n_raters"), "members")
    v = votes.join(F.broadcast(r.select(rater, "rank")), rater)  # a row a rater
    at = Window.partitionBy(item).orderBy("rank", label)
    v = v.withColumn("n", F.row_number().over(Window.partitionBy(item, label).orderBy("rank"))).withColumn("r", F.row_number().over(at))
    v = v.withColumn("sq", F.sum(2 * F.col("n") - 1).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    names = ("train", "val", "test") if split else ()
    own = [x for s in names for x in (F.count_if(F.col(split) == s).alias(f"n_{s}"), F.count_if((F.col(split) == s) & (F.col(label) == positive)).alias(f"p_{s}"))]
    few = v.groupBy("rank", label, "n", "r", "sq").agg(F.count("*").alias("m"), *own)  # votes by whole numbers
    agree = lambda sq, n: F.coalesce(_agreeing(sq, n), F.lit(0.0))
    ds = agree(F.col("sq"), F.col("r")) - agree(F.col("sq") - 2 * F.col("n") + 1, F.col("r") - 1)
    per = few.groupBy("rank", label).agg(F.sum("m").alias("m"), F.sum(F.col("m") * ds).alias("ds"), F.sum(F.when(F.col("r") == 2, F.col("m")).otherwise(0)).alias("dn"), *(F.sum(f"{x}_{s}").alias(f"{x}_{s}") for s in names for x in ("n", "p")))
    c = F.sum("m").over(Window.partitionBy(label).orderBy("rank"))
    per = per.withColumn("dcc", c * c - (c - F.col("m")) * (c - F.col("m")))
    sums = ["m", "ds", "dn", "dcc", *(f"{x}_{s}" for s in names for x in ("n", "p"))]
    steps = per.groupBy("rank").agg(*(F.sum(x).alias(x) for x in sums))
    run = steps.select("rank", *(F.sum(x).over(Window.orderBy("rank")).alias(x) for x in sums))  # a row a rater
    p_e = F.col("dcc") / (F.col("m").cast("double") * F.col("m"))
    kappa = F.when(F.col("rank") == 1, 1.0).otherwise(F.try_divide(F.try_divide("ds", "dn") - p_e, 1.0 - p_e))
    posts = [sum((F.col(f"n_{s}") for s in names), F.lit(0)).alias("posts_total")] if split else []
    posts += [x for s in names for x in (F.col(f"n_{s}").alias(f"posts_{s}"), F.try_divide(F.col(f"p_{s}") * 100.0, F.col(f"n_{s}")).alias(f"share_{s}"))]
    return heads.join(run.select("rank", kappa.alias("kappa"), *posts), "rank", "left")


def bucket_kappas(votes: DataFrame, ranked: DataFrame, item: str, rater: str, label: str, unions: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(bucket, kappa) of the raters of each interpretation, and of unions of interpretations; null with one member."""
    names = {n: (n,) for n in ("poor", "slight", "fair", "moderate", "substantial", "almost perfect")} | dict(unions or {})
    table = votes.sparkSession.createDataFrame([(g, b) for g, bs in names.items() for b in bs], "bucket string, interpretation string")
    members = _stored(ranked.join(F.broadcast(table), "interpretation").select(rater, "bucket"), "members")  # a few rows
    size = members.groupBy("bucket").agg(F.countDistinct(rater).alias("n_raters"))
    k = fleiss_kappa(votes.join(F.broadcast(members), rater), item, label, ["bucket"])
    return size.join(k, "bucket", "left").select("bucket", "n_raters", F.when(F.col("n_raters") > 1, F.col("kappa")).alias("kappa"))


def kappa_by_encoding(votes: DataFrame, item: str, encodings: dict[str, Column]) -> DataFrame:
    """(encoding, kappa) of the same votes under several label encodings."""
    rows = votes.select(item, F.explode(F.array(*(F.struct(F.lit(k).alias("encoding"), c.cast("string").alias("label")) for k, c in encodings.items()))).alias("r")).select(item, "r.*")
    return fleiss_kappa(rows, item, "label", ["encoding"])


def _check_quorum(size: int, combinations: int | None) -> None:
    if size % 2 == 0:
        raise ValueError("a quorum needs an odd number of annotators")
    if combinations is not None and combinations < 2:
        raise ValueError("at least two combinations are needed")


WHOLE = "decimal(38,0)"


def _whole(c: Column) -> Column:
    return c.cast(WHOLE)


def _over(a: Column, b: Column) -> Column:
    """``a / b`` of whole decimals where ``b`` divides ``a``: exact up to 31 digits, an error beyond."""
    return (a / b.cast("decimal(20,0)")).cast(WHOLE)


def _choose(n: Column, k: int) -> Column:
    """How many groups of ``k`` of ``n`` there are, exactly: each step's product is divisible."""
    out = F.lit(1).cast(WHOLE)
    for i in range(k):
        out = _over((out * F.greatest(n - i, F.lit(0)).cast("decimal(20,0)")).cast(WHOLE), F.lit(i + 1))
    return F.when(n >= k, out).otherwise(F.lit(0).cast(WHOLE))


def _number(c: Column) -> Column:
    """A count as a long where it is one, which all counts of up to 18 digits are; an error beyond."""
    return c.cast("long")


def quorum_majorities(votes: DataFrame, item: str, label: str, positive, size: int, exact: bool = False) -> DataFrame:
    """(item, groups, positive_groups): how many of all groups of ``size`` raters have a positive majority, as DECIMAL(38,0) with ``exact``, else as longs (an error where they do not fit).

    Closed form over the label counts; no group is built.
    """
    _check_quorum(size, None)
    per = votes.groupBy(item).agg(F.count("*").alias("n"), F.count_if(F.col(label) == positive).alias("h"))
    won = F.lit(0).cast(WHOLE)
    for j in range(size // 2 + 1, size + 1):
        won = _whole(won + _whole(_choose(F.col("h"), j) * _choose(F.col("n") - F.col("h"), size - j)))
    shown = _whole if exact else _number
    return per.select(item, shown(_choose(F.col("n"), size)).alias("groups"), shown(won).alias("positive_groups"))


def _unranked(rank: Column, n: Column, groups: Column, size: int) -> Column:
    """The group of that rank among all groups of ``size`` of 0..n-1 in lexicographic order: one pass over the places.

    ``b`` counts the groups that begin with the place looked at; it follows
    from the one before by a multiplication and an exact division.
    """
    zero = F.lit(0).cast(WHOLE)
    start = F.struct(_whole(rank).alias("rank"), _over(_whole(_whole(groups) * F.lit(size).cast("decimal(20,0)")), F.greatest(n, F.lit(1))).alias("b"), F.lit(size).cast("long").alias("need"), F.array().cast("array<int>").alias("c"))

    def step(s: Column, i: Column) -> Column:
        rest = n.cast("long") - 1 - i  # places behind this one
        take = (s["need"] > 0) & (s["rank"] < s["b"])
        after = F.greatest(rest, F.lit(1).cast("long"))
        times = lambda k: _whole(s["b"] * F.greatest(k, F.lit(0).cast("long")).cast("decimal(20,0)"))
        taken = F.struct(s["rank"].alias("rank"), _over(times(s["need"] - 1), after).alias("b"), (s["need"] - 1).alias("need"), F.concat(s["c"], F.array(i.cast("int"))).alias("c"))
        left = F.struct(_whole(s["rank"] - F.when(s["need"] > 0, s["b"]).otherwise(zero)).alias("rank"), _over(times(rest - s["need"] + 1), after).alias("b"), s["need"].alias("need"), s["c"].alias("c"))
        return F.when(take, taken).otherwise(left)

    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["c"])


#: Up to so many groups of an item are put in hashed order to draw from; of more, ranks are drawn until enough differ.
LISTED = 1 << 16


def _hashed(seed: int, item: str, what: Column) -> Column:
    """The MD5 of seed, item and a number."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string"), what.cast("string")))


def _drawn(rows: DataFrame, item: str, seed: int) -> DataFrame:
    """``rows`` (with ``all`` groups, ``m`` of them wanted) with ``ranks``: ``m`` different ranks in order, every set of ranks as likely as any other.

    Of up to ``LISTED`` groups, or where half of all are wanted, the ranks of
    least hash. Of more, the first ``m`` different ones of a row of 120-bit
    hashes modulo the number of groups, 4 m + 64 of them, of which far more than
    ``m`` differ (the bias is ``all`` / 2**120).
    """
    few = (F.col("all") <= LISTED) | (F.col("m") * 2 >= F.col("all"))
    listed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("all").cast("long") - 1), lambda r: F.struct(_hashed(seed, item, r).alias("h"), r.cast(WHOLE).alias("r")))
    least = F.transform(F.slice(F.array_sort(listed), F.lit(1), F.col("m").cast("int")), lambda x: x["r"])
    part = lambda h, at: _whole(F.conv(F.substr(h, F.lit(at), F.lit(15)), 16, 10))
    big = lambda h: _whole(part(h, 1) * F.lit(1 << 60).cast("decimal(19,0)")) + part(h, 16)
    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") * 4 + 63), lambda j: _whole(F.pmod(_whole(big(_hashed(seed, item, j))), F.col("all"))))
    first = F.slice(F.array_distinct(draws), F.lit(1), F.col("m").cast("int"))
    enough = F.when(F.size(first) == F.col("m"), first).otherwise(F.raise_error(F.lit("too few different groups were drawn")).cast(f"array<{WHOLE}>"))
    return rows.withColumn("ranks", F.array_sort(F.when(few, least).otherwise(enough)))


#: Groups of up to so many raters are listed by one explode for each of them; larger ones are made from their rank.
LISTED_SIZE = 7


def _every_group(own: DataFrame, item: str, size: int) -> DataFrame:
    """(g, item, said): all groups of ``size`` of each item's ``v``, ``n`` of them, and their rank from 0 in lexicographic order.

    One explode for each place. Only the last is compiled, since a compiled one
    keeps all that comes of a row until the row is done: the function over the
    sequence stops that for the others, so that a task holds no more rows than
    an item has votes. The groups that a place passes over are counted by the
    difference of two binomial coefficients of places behind.
    """
    rows = own.withColumn("g", F.lit(0).cast("long")).withColumn("_at0", F.lit(-1))
    for i in range(size):
        last, need = F.col("n") - (size - i), size - i
        places = F.sequence(F.col(f"_at{i}") + 1, last)
        rows = rows.withColumn(f"_at{i + 1}", F.explode(places if need == 1 else F.transform(places, lambda at: at)))
        passed = _choose_long(F.col("n") - 1 - F.col(f"_at{i}"), need) - _choose_long(F.col("n") - F.col(f"_at{i + 1}"), need)
        rows = rows.withColumn("g", F.col("g") + passed)
    return rows.select("g", item, *(F.get("v", F.col(f"_at{i + 1}")).alias(f"_s{i}") for i in range(size)))


def _choose_long(n: Column, k: int) -> Column:
    """How many groups of ``k`` of ``n`` there are, as a long: an error beyond, in the last product too."""
    out = F.lit(1).cast("long")
    for i in range(k):
        out = F.call_function("div", out * (n - i).cast("long"), F.lit(i + 1).cast("long"))
    return F.when(n >= k, out).otherwise(F.lit(0).cast("long"))


def _most(said: Sequence[Column]) -> Column:
    """The most frequent of the columns' values, ties to the first by name; null only where all are."""
    votes_ = [sum((F.coalesce(x == y, F.lit(False)).cast("int") for y in said), F.lit(0)) for x in said]
    best = F.greatest(*votes_) if len(said) > 1 else votes_[0]
    picked = [F.when(n == best, x) for n, x in zip(votes_, said, strict=True)]
    return F.least(*picked) if len(said) > 1 else picked[0]


def quorums(votes: DataFrame, item: str, rater: str, label: str, size: int, combinations: int | None = None, seed: int = 42) -> DataFrame:
    """(group_id, item, label): the majority label of groups of ``size`` raters of each item, all or a seeded sample.

    Groups are ranks 0..C(n, size)-1 in lexicographic order of an item's votes.
    All groups of up to ``LISTED_SIZE`` raters are listed in that order; others
    are made from their rank alone, in whole decimals of 38 digits. A sample
    is drawn uniformly without replacement, by hashes of seed, item and rank, and
    its groups are numbered from 1 in order of rank (the original's random
    numbers cannot be had outside Python). Ties of labels go to the first by name.
    """
    _check_quorum(size, combinations)
    own = votes.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(rater, label))).alias("v"))
    own = own.withColumn("n", F.size("v")).filter(F.col("n") >= size)
    if combinations is None and size <= LISTED_SIZE:
        every = _every_group(own.withColumn("v", F.col("v")[label]), item, size)
        return every.select((F.col("g") + 1).cast("int").alias("group_id"), item, _most([F.col(f"_s{i}") for i in range(size)]).alias(label))
    own = own.withColumn("all", _choose(F.col("n"), size))
    if combinations is None:
        rows = own.select(item, "v", "n", "all", F.explode(F.sequence(F.lit(0).cast("long"), _number(F.col("all")) - 1)).alias("g")).withColumn("rank", _whole(F.col("g")))
    else:
        drawn = _drawn(own.withColumn("m", F.least(F.col("all"), F.lit(combinations).cast(WHOLE)).cast("long")), item, seed)
        rows = drawn.select(item, "v", "n", "all", F.posexplode("ranks").alias("g", "rank"))
    picked = F.transform(_unranked(F.col("rank"), F.col("n"), F.col("all"), size), lambda i: F.get("v", i)[label])
    said = rows.select((F.col("g") + 1).cast("int").alias("group_id"), item, picked.alias("said"))
    votes_ = lambda x: F.size(F.filter("said", lambda y: y == x))
    best = F.array_max(F.transform(F.array_distinct("said"), votes_))
    return said.select("group_id", item, F.array_min(F.filter("said", lambda x: votes_(x) == best)).alias(label))


def result_matrix(votes: DataFrame, item: str, rater: str, labels: Sequence[str], phase: str) -> DataFrame:
    """(without, phase, label, kappa): all raters and each left out, for each phase and label; 'All' is nobody left out.

    The matrix is whole: where a rater has no votes in a phase, leaving them out
    leaves the kappa of all. One plan for all cells; it runs as a job, whose
    result (a row a cell) goes to the shared folder.
    """
    rows = votes.select(item, rater, F.col(phase).alias("phase"), F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).cast("string").alias("v")) for x in labels))).alias("x"))
    rows = rows.select(item, rater, "phase", "x.label", "x.v")
    path = scratch_path(votes.sparkSession, "matrix")
    leave_one_out(rows, item, rater, "v", ["phase", "label"], whole=True).write.parquet(path)
    found = votes.sparkSession.read.parquet(path)
    every = F.broadcast(found.filter("without IS NULL").agg(F.collect_list(F.struct("phase", "label", "kappa")).alias("c")))  # one row
    cells = found.filter("without IS NOT NULL").select(F.col("without").alias("w"), F.col("phase").alias("p"), F.col("label").alias("l"))
    absent = found.select("without").filter("without IS NOT NULL").distinct().crossJoin(every).select("without", F.explode("c").alias("c")).select("without", "c.*")
    absent = absent.join(cells, F.col("without").eqNullSafe(F.col("w")) & F.col("phase").eqNullSafe(F.col("p")) & (F.col("label") == F.col("l")), "left_anti")
    out = found.unionByName(absent)
    return out.select(F.coalesce(F.col("without").cast("string"), F.lit("All")).alias("without"), "phase", "label", "kappa")
