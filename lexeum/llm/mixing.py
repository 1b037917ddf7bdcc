"""Mixing sources to target weights by Pareto order sampling.

Sources, ordered by name with null last, share all words by their weights; a
target stops at ``CAP`` times its source's words and the excess is shared anew.
A document's expected copies are lambda = min(CAP, c * importance), with c set
per source so that expected words meet the target. The whole part of lambda is
certain; the rest is an inclusion probability p, and documents are ranked by
random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), with u a hash
of the row. Documents are taken in rank order until the source's words are met.
Importance is rounded to quarters of an octave, and 2**-10 at least, so that a
source's c follows from its words at each level.

Sources are a table throughout, however many there are: nothing is collected
but totals over all of them. The rank at which a source is full is found by
counting words in 4,096 ranges of ranks, then in 4,096 parts of the range in
which it is reached, and so on, until a range of ``TAIL`` ranks or fewer is
left. From the first rank that does not fit, the next ``TAIL``, whatever range
they are in, are settled one by one: those that still fit are taken, and at last
the one whose words come nearest to what is missing, if that brings the source
nearer. So a
source misses its target by about the words of the shortest of these documents.
Up to ``MANY`` sources are broadcast; more are joined, hot ones dealt over
several partitions.

Defined cases: null text has no words; documents without words are taken in no
copy beyond the certain ones; equal rows (same doc_id and text) share a rank;
a source without words has target 0; an empty table gives an empty result.
Other columns stay.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeum.llm import common as C

#: ``MANY`` sources are at most 25 MB: a name, a few numbers and up to ``TAIL`` ranks each.
WEIGHTS, CAP, TAIL, MANY = (5.0, 2.0, 1.0), 3, 256, 10_000
_BITS, _STEP = 52, 12


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def by_length(text: str, full: int = 512) -> Column:
    """An importance that grows with the text: the root of its share of ``full`` bytes, 1 from there on."""
    return F.sqrt(F.least(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(full)) / full)


def settle(rows: list[tuple[int, int]], gap: float, tail: int) -> list[int]:
    """Of (rank, size) in rank order: those taken for ``gap`` more words, looking at ``tail`` ranks from the first that does not fit."""
    took, rest, end = [], [], len(rows)
    for i, (z, s) in enumerate(rows):
        if i >= end:
            break
        if s <= gap:
            took.append(z)
            gap -= s
        else:
            end = end if rest else i + tail
            rest.append((z, s))
    if rest:
        z, s = min(rest, key=lambda r: (abs(r[1] - gap), r[0]))
        if abs(s - gap) < gap:
            took.append(z)
    return took


def _settler(tail: int):
    """:func:`settle` of each source's last ranks."""

    def settled(tails: pa.Array, gap: pa.Array) -> pa.Array:
        return pa.array([settle(sorted((r["z"], r["s"]) for r in t), g, tail) for t, g in zip(tails.to_pylist(), gap.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return settled


def with_facts(rows: DataFrame, facts: DataFrame, key: str, n: str, sources: int) -> DataFrame:
    """``rows`` joined to one row a source. ``facts`` is broadcast if there are ``MANY`` sources at most."""
    return rows.join(F.broadcast(facts.drop(n)), key) if sources <= MANY else C.spread_join(rows, facts, key, n)


def with_targets(sources: DataFrame, weights, cap: int) -> DataFrame:
    """``sources`` (source, s) with ``goal``: shares of all words by the weights, repeating in order of name, none above ``cap`` times its words. Stored."""
    ordered = C.stored(sources.orderBy(F.asc_nulls_last("source")).withColumn("_part", F.spark_partition_id()), "ordered")
    at, before = 0, []
    for r in sorted(ordered.groupBy("_part").count().collect()):  # one row a partition
        before.append((r[0], at))
        at += r[1]
    offset = F.broadcast(ordered.sparkSession.createDataFrame(before, "_part int, _before long"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    out = C.stored(ordered.join(offset, "_part").withColumn("weight", weight).drop("_part", "_before"), "sources")
    C.forget(ordered)
    total, level, capped = float(out.agg(F.sum("s")).first()[0] or 0), 0.0, -1
    while True:  # words for one unit of weight: rises as full sources leave theirs to others
        over = F.col("weight") * level > F.col("s") * cap
        r = out.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("s") * cap)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if r.n == capped or not r.open:
            break
        capped, level = r.n, (total - float(r.full or 0)) / r.open
    return out.withColumn("goal", F.least(F.col("weight") * level, (F.col("s") * cap).cast("double"))).drop("weight")


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, text: str = "text", doc_id: str = "doc_id", source: str = "source", importance: Column | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document)."""
    size, total, goal, copies = (C.fresh(docs, x) for x in ("size", "source_size", "target", "copies"))
    key, cu, cw, whole, p_, z_ = (C.fresh(docs, x) for x in ("_k", "_u", "_w", "_whole", "_p", "_z"))
    facts_ = {x: C.fresh(docs, f"_{x}") for x in ("s", "goal", "c", "z0", "more", "n", "slice")}
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text)), F.lit(1 << _BITS))
    level = F.lit(1.0) if importance is None else F.pow(F.lit(2.0), F.round(4 * F.log2(F.greatest(F.coalesce(importance.cast("double"), F.lit(0.0)), F.lit(2.0**-10)))) / 4)
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    keyed = docs.withColumn(size, word_count(text)).withColumn(cu, u).withColumn(cw, level).withColumn(key, name)
    rows = C.stored(keyed.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(size).alias("size"), F.col(cu).alias("u"), F.col(cw).alias("w")), "sizes")
    levels = C.stored(rows.groupBy("k", "w").agg(F.first("source").alias("source"), F.sum("size").alias("s"), F.count("*").alias("n")), "levels")
    sources = with_targets(levels.groupBy("k").agg(F.first("source").alias("source"), F.sum("s").alias("s"), F.sum("n").alias("n")), weights, cap)
    n_sources = sources.count()
    sources = C.stored(sources.join(_scales(levels, sources, cap), "k", "left").withColumn("c", F.coalesce("c", F.lit(0.0))), "scales")

    def ranked(df: DataFrame, w: str, u_: str, c: str) -> DataFrame:
        """With the certain copies ``_whole``, the rest ``_p`` and the rank ``_z``."""
        lam = F.least(F.lit(float(cap)), F.col(w) * F.col(c))
        df = df.withColumn(whole, F.floor(lam + 1e-9).cast("long")).withColumn(p_, F.greatest(lam - F.col(whole), F.lit(0.0)))
        df = df.withColumn(p_, F.when(F.col(p_) < 1e-9, 0.0).otherwise(F.col(p_)))
        x = (F.col(u_).cast("double") + 0.5) / float(1 << _BITS)
        odds = x / (1.0 - x) * (1.0 - F.col(p_)) / F.greatest(F.col(p_), F.lit(1e-12))
        return df.withColumn(z_, F.least(F.floor(odds / (1.0 + odds) * float(1 << _BITS)).cast("long"), F.lit((1 << _BITS) - 1)))

    part = ranked(with_facts(rows.drop("source"), sources.select("k", "c", "n"), "k", "n", n_sources), "w", "u", "c")
    part = C.stored(part.select("k", "size", F.col(z_).alias("z"), F.col(whole).alias("whole"), F.col(p_).alias("p")), "ranks")
    certain = part.groupBy("k").agg(F.sum(F.col("size") * F.col("whole")).alias("certain"))
    gaps = sources.join(certain, "k").select("k", F.greatest(F.col("goal") - F.col("certain"), F.lit(0.0)).alias("gap"), "n")
    ends = full_ranks(part.filter("p > 0 and size > 0").select("k", "size", "z"), gaps, n_sources)
    f = facts_
    facts = C.stored(sources.join(ends, "k", "left").select(F.col("k").alias(key), *(F.col(x).alias(f[x]) for x in ("s", "goal", "c", "n")), F.coalesce("z0", F.lit(0)).alias(f["z0"]), F.coalesce("more", F.array().cast("array<long>")).alias(f["more"])), "facts")
    C.forget(rows, levels, part)
    out = ranked(with_facts(keyed, facts, key, f["n"], n_sources), cw, cu, f["c"])
    taken = F.col(whole) + ((F.col(p_) > 0) & (F.col(size) > 0) & ((F.col(z_) < F.col(f["z0"])) | F.array_contains(F.col(f["more"]), F.col(z_)))).cast("long")
    return out.select(*C.columns(docs), size, F.col(f["s"]).alias(total), F.col(f["goal"]).alias(goal), taken.alias(copies))


def _scales(levels: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """(k, c): expected copies min(cap, c * w) make each source's goal; the levels of highest importance reach the cap first."""
    down = Window.partitionBy("k").orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("k")
    at = levels.filter("s > 0").select("k", "w", "s").join(sources.select("k", "goal"), "k")
    ws = F.col("w") * F.col("s")
    at = at.withColumn("full", F.coalesce(F.sum("s").over(down), F.lit(0)) * cap).withColumn("open", F.sum(ws).over(all_) - F.coalesce(F.sum(ws).over(down), F.lit(0.0)))
    at = at.withColumn("c", (F.col("goal") - F.col("full")) / F.greatest(F.col("open"), ws)).filter(F.col("c") * F.col("w") <= cap * (1 + 1e-9))
    return at.groupBy("k").agg(F.max_by("c", "w").alias("c"))


def full_ranks(rows: DataFrame, gaps: DataFrame, sources: int) -> DataFrame:
    """(k, z0, more): of each source with a gap, the rank below which all are taken, and single ranks from there on. Stored.

    ``rows``: k, size, z. A source's window is over its 4,096 ranges, and over
    the few ranks that each task has left of it.
    """
    now = gaps.filter("gap > 0")
    shift, ends, kept, inside = _BITS, [], [], rows
    while True:
        step = max(0, shift - _STEP)
        joined = with_facts(rows, now, "k", "n", sources) if not kept else inside
        bins = joined.groupBy("k", F.shiftright("z", step).alias("b")).agg(F.first("gap").alias("gap"), F.sum("size").alias("s"), F.count("*").alias("n"))
        run = bins.withColumn("upto", F.sum("s").over(Window.partitionBy("k").orderBy("b")))
        # the range in which the gap is reached; none where all fit
        full = C.stored(run.groupBy("k").agg(F.first("gap").alias("gap"), F.min(F.when(F.col("upto") > F.col("gap"), F.struct("b", "upto", "s", "n"))).alias("x")), "full")
        left = F.col("gap") - (F.col("x.upto") - F.col("x.s"))
        cross = full.filter("x IS NOT NULL").select("k", F.col("x.b").alias("b"), left.alias("gap"), F.col("x.n").alias("n"))
        last = F.lit(True) if step == 0 else F.col("n") <= TAIL
        ends.append(full.filter("x IS NULL").select("k", F.lit(1 << _BITS).alias("z0"), F.lit(0.0).alias("gap"), F.lit(0).cast("long").alias("n")))
        ends.append(cross.filter(last).select("k", F.shiftleft("b", step).alias("z0"), F.col("gap").cast("double").alias("gap"), "n"))
        kept.append(full)
        open_ = cross.filter(~last)
        shift = step
        if shift == 0 or open_.isEmpty():
            break
        here = joined.drop("gap", "n").withColumn("b", F.shiftright("z", step)).join(F.broadcast(open_) if sources <= MANY else open_, ["k", "b"])
        inside = C.stored(here.select("k", "z", "size", "gap", "n"), "inside")
        kept.append(inside)
    found = ends[0]
    for e in ends[1:]:
        found = found.union(e)
    found = C.stored(found, "crossings")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    after = with_facts(rows, found.drop("n").filter("gap > 0").join(counts, "k"), "k", "n", sources).filter("z >= z0")
    each = after.groupBy("k", "z").agg(F.sum("size").alias("s"), F.first("gap").alias("gap"))
    near = each.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("z"))).filter(F.col("place") <= 2 * TAIL)  # a range of TAIL ranks, and TAIL from the first that does not fit
    tails = near.groupBy("k").agg(F.collect_list(F.struct("z", "s")).alias("t"), F.first("gap").alias("gap"))
    more = tails.select("k", F.arrow_udf(_settler(TAIL), "array<bigint>").asNondeterministic()("t", "gap").alias("more"))
    out = C.stored(found.join(more, "k", "left").select("k", "z0", F.coalesce("more", F.array().cast("array<long>")).alias("more")), "ends")
    C.forget(*kept, found)
    return out


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies. Columns stay as they are."""
    out = mixed(docs, **options)
    copies = out.columns[-1]
    return out.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*C.columns(docs))
