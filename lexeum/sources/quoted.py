"""Delimited files with line breaks inside quotes, read by as many tasks as they have ranges.

A line break ends a record only outside quotes, which a task that begins in the
middle of a file cannot see. But every quote turns inside to outside and back
(one that is doubled inside quotes turns twice), so it takes only the parity of
the quotes before:

1.  each range of a file reports how many quotes its lines hold; sums over the
    ranges before tell whether a range begins inside quotes (a row a range,
    stored in the shared folder);
2.  each range puts its lines together to records from that state on. What
    stands before the first record that begins in the range, and a record that
    is open at its end, are fragments;
3.  fragments, two a range at most, are joined along each file.

Records are then parsed by Spark's own parser. Lines never move between tasks;
the file is read once for the states, and by the plan once for the whole records
and once for the fragments. A task holds one record.

This is right for files whose quotes all belong to quoted fields, as programs
write them. Where the quotes of a file are odd in number, a field holds a quote
of its own, and the file is read by one task instead.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexeum.session import scratch_path

#: Ranges whose states are broadcast, about 100 bytes each; more are joined, and lines sorted inside their range again.
MANY = 100_000
#: Lines that a worker turns to Python strings at a time.
SLICE = 256
log = logging.getLogger(__name__)
_RECORD = "file string, start bigint, n bigint, record string, open_left boolean, open_right boolean"
_SCHEMA = pa.schema([("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("record", pa.string()), ("open_left", pa.bool_()), ("open_right", pa.bool_())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and start (of the range) of each line."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def states(spark: SparkSession, path: str) -> DataFrame | None:
    """file, start, odd (the range begins inside quotes); null where a file has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = _lines(spark, path).groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    at = scratch_path(spark, "ranges")
    sums.select("file", "start", "quotes", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("odd")).write.parquet(at)
    stored = spark.read.parquet(at)
    if stored.groupBy("file").agg((F.sum("quotes") % 2 == 1).alias("open")).filter("open").isEmpty():
        return stored.select("file", "start", "odd")
    return None


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of ranges, each range's in order, to records and fragments."""
    key, inside, left, held, n = None, False, False, [], 0
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[] for _ in _SCHEMA]
        out.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
        value, file, start, odd = (batch.column(c) for c in ("value", "file", "start", "odd"))
        turns = pc.bit_wise_and(pc.count_substring(value, '"'), 1).to_pylist()
        for v, f, s, o, turn in zip(value.to_pylist(), file.to_pylist(), start.to_pylist(), odd.to_pylist(), turns, strict=True):
            if (f, s) != key:
                if inside:
                    out.append((*key, n, "\n".join(held), left, True))
                key, inside, left, held, n = (f, s), o, o, [], 0
            if inside:
                held.append(v)
                if turn:
                    out.append((*key, n, "\n".join(held), left, False))
                    inside, left, n = False, False, n + 1
            elif turn:
                inside, held = True, [v]
            else:
                out.append((*key, n, v, False, False))
                n += 1
        if out:
            yield flushed()
    if inside:
        out.append((*key, n, "\n".join(held), left, True))
        yield flushed()


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """file, start, n (where the record begins: its range and its place in it) and record, of each file's records in any order, headers included; null where quotes do not match."""
    at = states(spark, path)
    if at is None:
        log.warning("quotes of %s do not match; it is read by one task a file", path)
        return None
    lines = _lines(spark, path)
    if at.count() <= MANY:
        joined = lines.join(F.broadcast(at), ["file", "start"], "left")
    else:
        joined = lines.withColumn("line", F.monotonically_increasing_id()).join(at, ["file", "start"], "left").repartition("file", "start").sortWithinPartitions("file", "start", "line")
    known = F.when(F.col("odd").isNull(), F.raise_error(F.lit("the ranges of a file have changed since their quotes were counted; read it again")).cast("boolean")).otherwise(F.col("odd"))
    found = joined.select("value", "file", "start", known.alias("odd")).mapInArrow(_assemble, _RECORD)
    whole = found.filter("NOT open_left AND NOT open_right").select("file", "start", "n", "record")
    along = Window.partitionBy("file").orderBy("start", F.col("open_left").desc())
    parts = found.filter("open_left OR open_right").withColumn("chain", F.sum(F.when(F.col("open_left"), 0).otherwise(1)).over(along))
    joined = parts.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("start", F.col("open_left").cast("int").alias("o"), "n", "record"))).alias("p"))
    first = F.col("p")[0]
    return whole.unionByName(joined.select("file", first["start"].alias("start"), first["n"].alias("n"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))


def read(spark: SparkSession, path: str, names: list[str], sep: str, order: str) -> DataFrame | None:
    """The columns of the files' header, all as strings, and ``order``, a struct of file, start and n; null where quotes do not match."""
    found = records(spark, path)
    if found is None:
        return None
    body = found.withColumn("record", F.regexp_replace("record", "\r$", "")).filter("NOT (start = 0 AND n = 0) AND record <> ''")
    parsed = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})
    rows = body.select(F.struct("file", "start", "n").alias("_order"), parsed.alias("r"))
    return rows.select(*(F.col(f"r.c{i}").alias(x) for i, x in enumerate(names)), F.col("_order").alias(order))
