"""Source divergence audit: how a source's words differ from those of the other sources of its language.

Terms are runs of letters and signs above ASCII, A-Z in small letters; each
language keeps those in at least ``DOCS`` of its documents. With n occurrences
in a group of N (kept terms only) and V kept terms of the language,

    p = 1 + floor(10**9 * (n + 1) / (N + V)),   f = floor((p - q)**2 / q)

for the group's p and another's q; all of it in whole numbers.

Tasks cut the texts into terms and add up their occurrences and documents, one
row for each (lang, source, term) of a task. These rows go to shards by lang and
term. In each shard DuckDB runs the SQL: first the counts and which terms are
kept, then, with the sums of all shards at hand, partial sums over pairs of
sources, how many terms of a source occur n times, and the shard's ``RANKS``
best terms of each source. Spark merges sums and rankings.

A pair of sources is summed over all V terms without listing them: where neither
source has the term, f is one value; where one has it, f depends on its count
alone, and the numbers of terms by count give the sum; only terms that both have
are met in the shard, as a correction to these.

Bounds: a shard's tables are DuckDB's, which holds ``MEMORY`` of them and spills
the rest to the task's own folder while the task runs; a term's rows in a shard
are one for each task and source at most, so a frequent word is no hot key; the
second exchange has one row for each kept (lang, source, term). The table of
groups is joined, not broadcast by force. Set ``shards`` (the session's shuffle
partitions) with the data.

Defined cases: null text, lang and source are ''; a document is a row, so rows
that repeat a doc_id are several; a group without kept terms has N = 0 and its
pairs are listed like all others, with value 0 where V = 0; a language of one
source has no pairs; ties rank by the UTF-8 bytes of the item; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeum.llm import common as C

DOCS, RANKS, UNIT, FLUSH, MEMORY = 3, 200, 1_000_000_000, 1_000_000, "256MB"
_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_WHOLE = pa.decimal128(38, 0)


@contextmanager
def _duck():
    """A DuckDB of one thread and bounded memory, spilling to a folder that goes with it."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder}) as con:
        con.execute("SET preserve_insertion_order = false")
        yield con


def _answers(batches: Iterator[pa.RecordBatch], columns: str, prepare: str, queries: tuple[str, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A shard's rows as DuckDB's table ``r``, and the rows of each query."""
    with _duck() as con:
        con.execute(f"CREATE TABLE r ({columns})")
        for batch in batches:
            part = pa.Table.from_batches([batch])  # noqa: F841  DuckDB finds it by name
            con.execute("INSERT INTO r SELECT * FROM part")
        if prepare:
            con.execute(prepare)
        for sql in queries:
            for found in con.sql(sql).to_arrow_reader(50_000):
                yield from pa.Table.from_batches([found]).cast(schema).to_batches()


def terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All terms of the rows in order, and each one's row."""
    word = _WORD[data]
    head = np.zeros(len(data) + 1, bool)
    head[off] = True  # rows begin: no term runs on
    first = word & (head[:-1] | ~np.concatenate(([False], word[:-1])))
    start = np.flatnonzero(first)
    size = np.cumsum(word)
    at = np.empty(len(start) + 1, np.int64)
    at[:-1] = size[start] - 1
    at[-1] = size[-1] if len(size) else 0
    said = np.ascontiguousarray(_LOW[data[word]])
    row = np.searchsorted(off, start, "right") - 1
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(said)), row


def _counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> Iterator[pa.Table]:
    """(lang, source, term, n, docs) of runs of rows of bounded size."""
    data, off = C.utf8(text)
    for a, b in C.slices(off, 4 * C.PIECE):
        said, row = terms(data[off[a] : off[b]], off[a : b + 1] - off[a])
        if not len(said):
            continue
        coded = said.dictionary_encode()
        words = len(coded.dictionary)
        pair, n = np.unique(row * words + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        groups = pa.table({"lang": lang[a:b], "source": source[a:b]})
        names = [f"{len(x)}:{x}{y}" for x, y in zip(*(c.to_pylist() for c in groups.columns), strict=True)]
        _, lead, group = np.unique(np.array(names, object), return_index=True, return_inverse=True)
        key, place = np.unique(group[pair // words] * words + pair % words, return_inverse=True)
        total = np.bincount(place, weights=n).astype(np.int64)
        mine = groups.take(pa.array(lead[key // words]))
        yield pa.table([mine["lang"].cast(pa.string()), mine["source"].cast(pa.string()), coded.dictionary.take(pa.array(key % words)).cast(pa.string()), pa.array(total), pa.array(np.bincount(place))], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (lang, source, term) of the task, or of a part of it where these are many."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        part = pa.concat_tables(held)  # noqa: F841  read by name
        held.clear()
        with _duck() as con:
            return con.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL").to_arrow_table().cast(_COUNTS)

    for batch in batches:
        for table in _counted(*batch.columns):
            held.append(table)
            if sum(len(t) for t in held) > FLUSH:
                one = merged()
                if len(one) > FLUSH // 2:
                    yield from one.to_batches(50_000)
                else:
                    held.append(one)
    if held:
        yield from merged().to_batches(50_000)


KEPT = f"""SELECT lang, source, term, n, sum(n) OVER t::BIGINT AS lang_n, row_number() OVER (t ORDER BY source) = 1 AS lead
FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM r GROUP BY ALL)
WINDOW t AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER t >= {DOCS}"""
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64()), ("lead", pa.bool_())])


def _p(n: str, total: str) -> str:
    return f"(1 + ({UNIT}::HUGEINT * ({n} + 1)) // ({total} + v))::BIGINT"


def _f(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) // {q})"


_PARTIAL = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("value", _WHOLE)])
SEEN = f"CREATE TABLE x AS SELECT *, {_p('n', 'total')} AS p, {_p('0', 'total')} AS p0, {_p('lang_n', 'lang_total')} AS q FROM r"
PAIRS = f"""SELECT 'pair' AS part, a.lang, a.source, b.source AS item, NULL::BIGINT AS n,
sum({_f("a.p", "b.p")}::HUGEINT - {_f("a.p", "b.p0")} - {_f("a.p0", "b.p")} + {_f("a.p0", "b.p0")})::DECIMAL(38, 0) AS value
FROM x a JOIN x b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL"""
LEVELS = "SELECT 'level' AS part, lang, source, NULL::VARCHAR AS item, n, count(*)::DECIMAL(38, 0) AS value FROM x GROUP BY ALL"
TERMS = f"""SELECT 'term' AS part, lang, source, term AS item, NULL::BIGINT AS n, {_f("p", "q")}::DECIMAL(38, 0) AS value FROM x WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_f("p", "q")} DESC, term) <= {RANKS}"""


def _kept(batches):
    yield from _answers(batches, "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT", "", (KEPT,), _KEPT)


def _partial(batches):
    columns = "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, lang_n BIGINT, total BIGINT, v BIGINT, lang_total BIGINT"
    yield from _answers(batches, columns, SEEN, (PAIRS, LEVELS, TERMS), _PARTIAL)


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _column_p(n: Column, total: Column, v: Column) -> Column:
    return F.lit(1).cast("long") + F.call_function("div", _whole(F.lit(UNIT)) * (n + 1).cast("decimal(20,0)"), (total + v).cast("decimal(20,0)"))


def _column_f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, shards: int | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language, and the terms the source has most above its language."""
    spark = C.ready(docs.sparkSession)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    kept = C.stored(counts.repartition(shards, "lang", "term").mapInArrow(_kept, "lang string, source string, term string, n bigint, lang_n bigint, lead boolean"), "kept")

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("lang_total"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = C.stored(groups.select("lang", "source", none("total"), none("v"), none("lang_total")), "groups")

    met = kept.drop("lead").join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", "total", "v", "lang_total")
    parts = C.stored(met.repartition(shards, "lang", "term").mapInArrow(_partial, "part string, lang string, source string, item string, n bigint, value decimal(38,0)"), "partial")
    return _ranked(_pair_sums(parts, groups), None).unionByName(_ranked(parts.filter("part = 'term'").drop("n"), RANKS))


def _pair_sums(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """The value of each ordered pair of sources of a language, from the partial sums of all shards."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("its_total"))
    pairs = groups.join(other, "lang").filter("source <> item")
    zero = lambda total: _column_p(F.lit(0).cast("long"), F.col(total), F.col("v"))
    both_zero = F.when(F.col("v") > 0, _whole(F.col("v")) * _column_f(zero("total"), zero("its_total")).cast("decimal(19,0)")).otherwise(0)
    levels = parts.filter("part = 'level'").groupBy("lang", "source", "n").agg(F.sum("value").alias("k"))
    at = levels.join(pairs.drop("lang_total"), ["lang", "source"])
    p = _column_p(F.col("n"), F.col("total"), F.col("v"))
    times = lambda f: F.col("k").cast("decimal(18,0)") * f.cast("decimal(19,0)")
    # the source has the term n times and the other one never; the same seen from the other one
    one_way = at.select("lang", "source", "item", _whole(times(_column_f(p, zero("its_total")) - _column_f(zero("total"), zero("its_total")))).alias("value"))
    back = at.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), _whole(times(_column_f(zero("its_total"), p) - _column_f(zero("its_total"), zero("total")))).alias("value"))
    base = pairs.select("lang", "source", "item", _whole(both_zero).alias("value"))
    met = parts.filter("part = 'pair'").select("lang", "source", "item", "value")
    sums = base.unionByName(one_way).unionByName(back).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.withColumn("part", F.lit("pair"))


def _ranked(rows: DataFrame, most: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    return (out.filter(F.col("rank") <= most) if most else out).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
