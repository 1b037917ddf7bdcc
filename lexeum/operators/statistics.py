"""Statistics of a unified table. Each is one pass with partial aggregation; matrices come out long."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeum import schema
from lexeum.functions import labels as L
from lexeum.functions import text as T
from lexeum.session import scratch_path


def _long(df: DataFrame, keys: Sequence[str], parts: dict[str, dict[str, Column]], name: str) -> DataFrame:
    """Rows of one aggregate per entry of ``parts``; computed as one aggregation and then unfolded."""
    flat = [c.alias(f"{k}·{m}") for k, row in parts.items() for m, c in row.items()]
    wide = df.groupBy(*keys).agg(*flat) if keys else df.agg(*flat)
    rows = F.array(*(F.struct(F.lit(k).alias(name), *(F.col(f"`{k}·{m}`").alias(m) for m in row)) for k, row in parts.items()))
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def _pos(label: str) -> Column:
    return F.count_if(F.col(label) == 1.0)


def _neg(label: str) -> Column:
    return F.count_if(F.col(label) == 0.0)


def label_stats(df: DataFrame, labels: Sequence[str] = schema.LABELS) -> DataFrame:
    """label, corpora, total, positive, negative, pos_rate (unrounded; null without annotations)."""
    out = _long(df, [], {x: {"total": F.count(x), "positive": _pos(x), "negative": _neg(x)} for x in labels}, "label")
    corpora = F.create_map(*(F.lit(v) for x in labels for v in (x, ", ".join(c for c, names in schema.CORPUS_LABELS.items() if x in names))))
    return out.select("label", corpora[F.col("label")].alias("corpora"), "total", "positive", "negative", F.try_divide("positive", "total").alias("pos_rate"))


def split_stats(df: DataFrame) -> DataFrame:
    """Rows by source and split; missing ones are groups of their own."""
    return df.groupBy("source", "split").agg(F.count("*").alias("count"))


def null_texts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count_if(F.col("text").isNull()).alias("null_texts"), F.count("*").alias("rows"))


def missing_rates(df: DataFrame, labels: Sequence[str] = schema.LABELS) -> DataFrame:
    return df.groupBy("source").agg(*(F.avg(F.col(x).isNull().cast("double")).alias(x) for x in labels))


def annotated_counts(df: DataFrame, labels: Sequence[str] = schema.LABELS, by: str | None = "source") -> DataFrame:
    return (df.groupBy(by) if by else df).agg(*(F.count(x).alias(x) for x in labels))


def positive_negative(df: DataFrame, by: str = "source", labels: Sequence[str] = schema.LABELS) -> DataFrame:
    """Long table of counts; a source's labels without annotations are left out."""
    out = _long(df, [by], {x: {"positive": _pos(x), "negative": _neg(x), "total": F.count(x)} for x in labels}, "label")
    return out.filter("total > 0")


def positive_rates(df: DataFrame, by: str = "source", labels: Sequence[str] = schema.LABELS) -> DataFrame:
    """(by, label, pos_percent), 0 where nothing is annotated."""
    out = _long(df, [by], {x: {"positive": _pos(x), "total": F.count(x)} for x in labels}, "label")
    return out.select(by, "label", F.coalesce(F.try_divide(F.col("positive") * 100.0, F.col("total")), F.lit(0.0)).alias("pos_percent"))


def pivot_rates(df: DataFrame, values: Sequence[str], by: str = "source", labels: Sequence[str] = schema.LABELS) -> DataFrame:
    """A row for each label, a column for each of the given groups; 0 where there is none."""
    return positive_rates(df, by, labels).groupBy("label").pivot(by, list(values)).agg(F.first("pos_percent")).na.fill(0.0)


def labels_with_data(df: DataFrame, labels: Sequence[str] = schema.LABELS) -> DataFrame:
    one = df.agg(*(F.count(x).alias(x) for x in labels))
    return one.select(sum(((F.col(x) > 0).cast("int") for x in labels), F.lit(0)).alias("labels_with_data"))


def value_counts(df: DataFrame, c: str, keep_null: bool = True) -> DataFrame:
    df = df if keep_null else df.filter(F.col(c).isNotNull())
    return df.groupBy(c).agg(F.count("*").alias("count"))


def value_shares(df: DataFrame, c: str) -> DataFrame:
    """Counts and shares of all rows; the total is one row, joined to the counts."""
    counts = df.groupBy(c).agg(F.count("*").alias("count"))
    total = F.broadcast(df.agg(F.count("*").alias("_all")))
    return counts.crossJoin(total).select(c, "count", (F.col("count") / F.col("_all")).alias("share"))


def grouped_shares(df: DataFrame, group: str, c: str) -> DataFrame:
    counts = df.groupBy(group, c).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(group)))


def exact_quantiles(df: DataFrame, c: str, shares: Sequence[float], bins: int = 4096) -> list[float | None]:
    """Interpolated quantiles of a numeric column, without missing values; runs jobs.

    The ranks wanted are located by counting values in ``bins`` equal ranges
    between the least and the greatest, then in parts of the ranges that hold a
    rank, until a range holds one value: no task sees all distinct values.
    """
    x = df.select(F.col(c).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    n, lo, hi = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None for _ in shares]
    at = {p: (n - 1) * p for p in shares}
    found: dict[int, float] = {}
    spans = {(lo, hi, 0): {r for v in at.values() for r in (int(v), min(n - 1, int(v) + 1))}}  # least, greatest, values below
    while spans:
        for a, b, below in [s for s in spans if s[0] == s[1]]:
            found |= dict.fromkeys(spans.pop((a, b, below)), a)
        if not spans:
            break
        keys = sorted(spans)
        where = F.lit(None).cast("int")
        bin_ = F.lit(None).cast("int")
        for i, (a, b, _) in enumerate(keys):
            inside = (F.col("x") >= a) & (F.col("x") <= b)
            share = (F.col("x") - a) / (b - a) if b - a < float("inf") else F.col("x") / b / 2 + 0.5
            where = F.when(inside, i).otherwise(where)
            bin_ = F.when(inside, F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * bins))).cast("int")).otherwise(bin_)
        rows = x.select("x", where.alias("s"), bin_.alias("b")).filter("s is not null").groupBy("s", "b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        nxt: dict = {}
        for i, key in enumerate(keys):
            upto = key[2]
            for r in sorted((r for r in rows if r.s == i), key=lambda r: r.lo):
                for k in [k for k in spans[key] if upto <= k < upto + r.n]:
                    nxt.setdefault((r.lo, r.hi, upto), set()).add(k)
                upto += r.n
        spans = nxt
    return [found[int(v)] + (v - int(v)) * (found[min(n - 1, int(v) + 1)] - found[int(v)]) for v in at.values()]


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grouped_quantiles(df: DataFrame, c: str, by: str, shares: Sequence[float], name: str = "q", bins: int = 4096, few: int = 10_000, stored: bool = False) -> DataFrame:
    """(by, name): exact interpolated quantiles of each group, an array in the order of ``shares``, without missing values; runs jobs.

    As :func:`exact_quantiles`, for all groups at once: the ranges that hold a
    wanted rank are a table (a row a group and range), each refined ``bins``-fold
    a round by counts that tasks add up first, until it holds one value or no
    more than ``few`` rows, which are then numbered. No task sees all values of
    a group, whatever its share of the rows. Groups of no values have no row.
    The values are read once a round; they are written to the shared folder
    first, unless ``df`` is ``stored`` already.
    """
    x = df.select(F.col(by).alias("k"), F.col(c).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    x = x if stored else _stored(x, "values")
    facts = _stored(x.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "facts")
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    low = lambda p: F.floor(at(p)).cast("long")
    high = lambda p: F.least(F.col("n") - 1, low(p) + 1)
    ranks = F.array_distinct(F.array(*(r for p in shares for r in (low(p), high(p)))))
    spans = facts.select(F.col("k").alias("g"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("here"), ranks.alias("ranks"))
    found = []
    while True:
        done = F.col("lo") == F.col("hi")
        found.append(spans.filter(done).select("g", F.explode("ranks").alias("rank"), F.col("lo").alias("value")))
        within = F.col("k").eqNullSafe(F.col("g")) & F.col("x").between(F.col("lo"), F.col("hi"))
        small = x.join(spans.filter(~done & (F.col("here") <= few)), within)
        placed = small.withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy("g", "lo").orderBy("x")) - 1)
        found.append(placed.filter(F.array_contains("ranks", F.col("rank"))).select("g", "rank", F.col("x").alias("value")))
        open_ = spans.filter(~done & (F.col("here") > few))
        if open_.isEmpty():
            break
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counts = x.join(open_, within).groupBy("g", F.col("lo").alias("from"), F.least(F.lit(bins - 1), F.floor(share * bins).cast("int")).alias("bin")).agg(F.count("*").alias("here"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("below").alias("below"), F.first("ranks").alias("ranks"))
        upto = F.col("below") + F.sum("here").over(Window.partitionBy("g", "from").orderBy("bin"))
        counts = counts.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("here"))
        counts = counts.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("upto")))).filter(F.size("ranks") > 0)
        spans = _stored(counts.select("g", "lo", "hi", "below", "here", "ranks"), "spans")
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    of = values.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    value = lambda r: F.element_at("v", r)
    out = facts.join(of, F.col("k").eqNullSafe(F.col("g")))
    return out.select(F.col("k").alias(by), F.array(*(value(low(p)) + (at(p) - low(p)) * (value(high(p)) - value(low(p))) for p in shares)).alias(name))


def _with_quantiles(stats: DataFrame, q: DataFrame, by: str) -> DataFrame:
    """The groups' rows and their array of quantiles; null keys meet."""
    q = q.select(F.col(by).alias("_by"), "q")
    return stats.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def describe(df: DataFrame, c: str) -> DataFrame:
    """Count, mean, deviation, least, exact quartiles, most. The quartiles are found before (see :func:`exact_quantiles`)."""
    q = exact_quantiles(df, c, (0.25, 0.5, 0.75))
    return df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *(F.lit(v).cast("double").alias(k) for k, v in zip(("q25", "q50", "q75"), q, strict=True)), F.max(c).alias("max"))


def without_split(df: DataFrame, name: str = "without_split") -> DataFrame:
    """One row: how many rows have no split."""
    return df.agg(F.count_if(F.col("split").isNull()).alias(name))


def length_stats(df: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """Words a text: mean, median, p95, p99, least, most, by group; interpolated exactly (see :func:`grouped_quantiles`)."""
    wc = _stored(df.filter(F.col(text).isNotNull()).select(by, T.word_count(F.col(text)).alias("wc")), "words")
    stats = wc.groupBy(by).agg(F.count("*").alias("texts"), F.avg("wc").alias("mean"), F.min("wc").alias("min"), F.max("wc").alias("max"))
    both = _with_quantiles(stats, grouped_quantiles(wc, "wc", by, (0.5, 0.95, 0.99), stored=True), by)
    return both.select(by, "texts", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "min", "max")


def length_table(df: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """:func:`length_stats` as shown: whole numbers, cut and not rounded, and the mean to one digit."""
    stats = length_stats(df, by, text)
    return stats.select(by, "texts", "min", *(F.col(x).cast("int").alias(x) for x in ("median",)), T.rounded(F.col("mean"), 1).alias("mean"), *(F.col(x).cast("int").alias(x) for x in ("p95", "p99")), "max")


def clipped_lengths(df: DataFrame, by: str = "source", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Each text's words, at most its group's 99th percentile."""
    wc = _stored(df.filter(F.col(text).isNotNull()).select(*keep, by, T.word_count(F.col(text)).alias("wc")), "words")
    return _with_quantiles(wc, grouped_quantiles(wc, "wc", by, (0.99,), stored=True), by).select(*keep, by, F.least(F.col("wc").cast("double"), F.col("q")[0]).alias("clipped"))


def box_stats(df: DataFrame, c: str, by: str) -> DataFrame:
    """Quartiles of each group, null where it has no values."""
    return _with_quantiles(df.select(by).distinct(), grouped_quantiles(df, c, by, (0.25, 0.5, 0.75)), by).select(by, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def density(df: DataFrame, c: str, by: str, points: Sequence[float], bandwidth: float, bin_width: float | None = None) -> DataFrame:
    """(by, point, density): a Gaussian kernel estimate at the given points.

    Rows are counted by value first (by the nearest multiple of ``bin_width``, where
    that is given: for columns of many different values), in one aggregation; the
    kernel is then laid over the counts, so its cost does not grow with the rows.
    """
    x = F.col(c).cast("double")
    value = x if bin_width is None else F.rint(x / bin_width) * float(bin_width)
    counts = df.filter(F.col(c).isNotNull()).groupBy(by, value.alias("_x")).agg(F.count("*").alias("_n"))
    z = (F.col("_x") - F.col("point")) / bandwidth
    at = counts.select(by, "_x", "_n", F.explode(F.array(*(F.lit(float(p)) for p in points))).alias("point"))
    return at.groupBy(by, "point").agg((F.sum(F.col("_n") * F.exp(-0.5 * z * z)) / F.sum("_n") / (bandwidth * sqrt(2 * pi))).alias("density"))


def label_percents(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, value, count, percent) of several labels, one below the other."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("value")) for x in labels))).alias("r")).select("r.*")
    out = grouped_shares(rows, "label", "value")
    return out.select("label", "value", "count", (F.col("share") * 100.0).alias("percent"))


def _pairs(labels: Sequence[str], lower: bool) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(labels) for j, b in enumerate(labels) if not lower or i >= j]


def correlations(df: DataFrame, labels: Sequence[str], listwise: bool = False, lower: bool = False) -> DataFrame:
    """(label_a, label_b, corr): over rows that have both, or with ``listwise`` all; one pass for the whole matrix."""
    df = df.na.drop(subset=list(labels)) if listwise else df
    pairs = _pairs(labels, lower)
    wide = df.agg(*(L.correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("r")).select("r.*")


def overlaps(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label_a, label_b, rows): rows where both are annotated."""
    pairs = _pairs(labels, False)
    wide = df.agg(*(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), F.col(f"c{i}").alias("rows")) for i, (a, b) in enumerate(pairs)))).alias("r")).select("r.*")


def summary(df: DataFrame, labels: Sequence[str] = schema.LABELS) -> DataFrame:
    """One row a source: rows, languages, labels with data and their rates, splits, rows without split."""
    no_split = F.col("split").isNull() | (F.col("split") == "None")
    per = df.groupBy("source").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"), F.count_if(no_split).alias("no_split"), *(F.count(x).alias(f"{x}_n") for x in labels), *(_pos(x).alias(f"{x}_p") for x in labels))
    known = F.filter(F.array(*(F.struct(F.lit(x).alias("l"), F.col(f"{x}_n").alias("n"), F.col(f"{x}_p").alias("p")) for x in labels)), lambda s: s["n"] > 0)
    splits = df.filter(~no_split).groupBy("source", "split").agg(F.count("*").alias("n"))
    splits = splits.groupBy(F.col("source").alias("_s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "n"))), lambda s: F.concat(s["split"], F.lit(": "), s["n"].cast("string"))), ", ").alias("splits"))
    out = per.join(splits, F.col("source").eqNullSafe(F.col("_s")), "left")
    rate = lambda s: F.concat(s["l"], F.lit(": "), T.percent(s["p"] / s["n"] * 100.0, 1, blank=False))
    return out.select("source", "rows", "languages", F.size(known).alias("n_labels"), F.array_join(F.transform(known, lambda s: s["l"]), ", ").alias("labels"), F.array_join(F.transform(known, rate), ", ").alias("rates"), F.coalesce("splits", F.lit("none")).alias("splits"), "no_split")


def summary_table(df: DataFrame, catalog: dict[str, Sequence[str]] | None = None, labels: Sequence[str] = schema.LABELS) -> DataFrame:
    """:func:`summary` as it is shown: a source's labels are those of the catalog, with 0.0% where nothing is annotated, its splits stand by falling counts, and numbers have commas.

    Sources that are not in the catalog have all ``labels``; splits of equal counts stand by name.
    """
    catalog = schema.CORPUS_LABELS if catalog is None else catalog
    no_split = F.col("split").isNull() | (F.col("split") == "None")
    per = df.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("language"), F.count_if(no_split).alias("_none"), *(F.count(x).alias(f"{x}_n") for x in labels), *(_pos(x).alias(f"{x}_p") for x in labels))
    splits = df.filter(F.col("split").isNotNull()).groupBy("source", "split").agg(F.count("*").alias("n"))
    each = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "split", "n"))), lambda s: F.concat(s["split"], F.lit(": "), T.thousands(s["n"])))
    splits = splits.groupBy(F.col("source").alias("_s")).agg(F.array_join(each, "  ").alias("splits"))
    out = per.join(splits, F.col("source").eqNullSafe(F.col("_s")), "left")
    own = F.lit(None).cast("array<string>")
    for name, names in catalog.items():
        own = F.when(F.col("source") == name, F.array(*map(F.lit, names))).otherwise(own)
    named = out.withColumn("_labels", F.coalesce(own, F.array(*map(F.lit, labels))))
    rate = F.array(*(F.struct(F.lit(x).alias("l"), F.concat(F.lit(f"{x}: "), T.percent(F.coalesce(F.try_divide(f"{x}_p", f"{x}_n") * 100.0, F.lit(0.0)), 1, blank=False)).alias("r")) for x in labels))
    rates = F.transform("_labels", lambda x: F.get(F.filter(rate, lambda r: r["l"] == x), F.lit(0))["r"])
    return named.select("source", T.thousands(F.col("n")).alias("rows"), "language", F.size("_labels").cast("string").alias("n_labels"), F.array_join("_labels", ", ").alias("labels"), F.array_join(rates, "  |  ").alias("positive_rates"), F.coalesce("splits", F.lit("none")).alias("splits"), T.thousands(F.col("_none")).alias("no_split_rows"))


def non_null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count(c).alias(c) for c in df.columns))


def pivot_first(df: DataFrame, index: str, column: str, value: str, values: Sequence, order: str) -> DataFrame:
    """The first value, in ``order``, of each cell."""
    return df.groupBy(index).pivot(column, list(values)).agg(F.min_by(value, order))


def pivot_size(df: DataFrame, index: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(index).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def dense_ranks(df: DataFrame, c: str, bins: int = 256) -> DataFrame:
    """(c, rank) of the distinct values; join back to rank rows.

    Values are numbered inside ranges and the ranges offset by the counts of
    those before, so no task sees all of them; the ranges' bounds come from a
    sample of 16 values a range (a job).
    """
    values = df.select(c).filter(F.col(c).isNotNull()).distinct()
    some = sorted(r[0] for r in values.orderBy(F.xxhash64(c), c).limit(16 * bins).collect())
    edges = some[16::16]
    at = sum(((F.col(c) >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    binned = values.withColumn("_bin", at)
    before = binned.groupBy("_bin").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy(c))
    return binned.withColumn("_in", inside).join(F.broadcast(before.drop("_n")), "_bin").select(c, (F.col("_before") + F.col("_in")).cast("int").alias("rank"))  # a row a range


def last_first(df: DataFrame, order: str, last, *then: str) -> DataFrame:
    """The rows by ``order`` and ``then``, with those whose value is ``last`` in front."""
    return df.orderBy(F.when(F.col(order) == last, 0).otherwise(1), order, *then)


def top(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def gold_silver(df: DataFrame, language: str = "de") -> DataFrame:
    """Rows in the target language: all, translated, and original."""
    here = F.col("language") == language
    return df.agg(F.count_if(here).alias("total"), F.count_if(F.col("is_translated")).alias("silver"), F.count_if(here & ~F.col("is_translated")).alias("gold"))
