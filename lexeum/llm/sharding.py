"""Histogram sort into shards of near-equal bytes.

Rows are keyed by a 64-bit hash of the text, so equal texts stand together.
Groups that alone weigh more than ``HEAVY`` of a shard (in bytes or rows; their
number is bounded by shards / HEAVY twice over) are placed first, the largest
on the emptiest shard. The other rows fill what the shards have left: exact
bytes below candidate boundaries are counted over all partitions, the probes
around each splitter are refined 4,096-fold a round until a splitter is within
``TOLERANCE`` of its target or holds a single key, and then rows are
exchanged once. A group larger than a shard's share has a shard of its own and
the others share the rest evenly.

Slots count each shard's rows from 0 in key order, then doc_id: rows are
numbered inside bins of bounded size (hot groups are dealt over many bins by
their doc_id) and bins are offset by the counts of those before them.

Defined cases: null text weighs one byte and groups with null; rows that
repeat a doc_id and text get slots of their own; an empty table gives an empty
result; other columns stay.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexeum.llm import common as C

HEAVY, TOLERANCE, PROBE_BITS, BIN_ROWS = 1 / 200, 1 / 2000, 12, 100_000


def size_of(text: str):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def capacities(total: int, heavy: list[int], shards: int) -> tuple[list[int], list[float]]:
    """Where each heavy group goes, and the bytes of other rows that each shard then takes."""
    load, place = [0] * shards, [0] * len(heavy)
    for i in sorted(range(len(heavy)), key=lambda i: (-heavy[i], i)):
        s = min(range(shards), key=lambda s: (load[s], s))
        place[i] = s
        load[s] += heavy[i]
    light, level = total - sum(heavy), 0.0
    for n in range(1, shards + 1):  # the level to which the n emptiest fill up
        low = sorted(load)[:n]
        level = (light + sum(low)) / n
        if n == shards or level <= sorted(load)[n]:
            break
    return place, [max(0.0, level - x) for x in load]


def splitters(rows: DataFrame, targets: list[float], slack: float) -> list[int]:
    """Keys at which the bytes below come near each target; ``rows``: key (long), size."""
    want = {t: None for t in targets}
    spans = [(-(1 << 63), 64, 0.0)]  # first key, bits, bytes below
    while spans:
        bits = spans[0][1]
        step = max(0, bits - PROBE_BITS)
        part = rows
        if bits < 64:
            part = rows.filter(F.shiftright("key", bits).isin([a >> bits for a, _, _ in spans]))
        found = sorted((r.b << step, int(r.s)) for r in part.groupBy(F.shiftright("key", step).alias("b")).agg(F.sum("size").alias("s")).collect())
        nxt = {}
        for a, _, below in spans:
            end, at = a + (1 << bits), below
            mine = found[bisect_left(found, (a, -1)) : bisect_left(found, (end, -1))]
            todo = sorted(t for t in want if want[t] is None and t >= below - 0.5)
            for key, s in mine:
                while todo and todo[0] <= at + s:
                    t = todo.pop(0)
                    if t - at <= slack or (step == 0 and t - at <= s / 2):
                        want[t] = key
                    elif at + s - t <= slack or step == 0:
                        want[t] = key + (1 << step)
                    else:
                        nxt[key] = at
                at += s
        spans = [(k, step, b) for k, b in sorted(nxt.items())]
    top = (1 << 63) - 1
    return [min(top, want[t]) if want[t] is not None else top for t in targets]


def sharded(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless in each shard), written to match by one exchange."""
    key, size, shard, slot, hk, hs, hn, at_, bin_, sub, row, first_ = (C.fresh(docs, x) for x in ("_key", "_size", "shard", "slot", "_hk", "_hs", "_hn", "_s", "_bin", "_sub", "_row", "_first"))
    keyed = docs.withColumn(key, F.xxhash64(text)).withColumn(size, size_of(text))
    probe = C.stored(keyed.select(F.col(key).alias("key"), F.col(size).alias("size"), F.xxhash64(F.col(doc_id).cast("string")).alias("own")), "keys")
    n, total = probe.agg(F.count("*"), F.sum("size")).first()
    total = int(total or 0)
    least_b, least_n = max(1.0, HEAVY * total / shards), max(1.0, HEAVY * n / shards)
    heavy = probe.groupBy("key").agg(F.sum("size").alias("s"), F.count("*").alias("n")).filter((F.col("s") >= least_b) | (F.col("n") > least_n)).orderBy("key").collect()
    place, room = capacities(total, [int(r.s) for r in heavy], shards)
    bins = 1 << max(9, (n // BIN_ROWS).bit_length())
    shift = 64 - (bins.bit_length() - 1)
    spark = docs.sparkSession
    cut = max(1, n // bins)
    big = F.broadcast(spark.createDataFrame([(r.key, p, max(1, -(-r.n // cut))) for r, p in zip(heavy, place, strict=True)], f"`{hk}` long, `{hs}` int, `{hn}` int"))
    light = probe.join(big, F.col("key") == F.col(hk), "left_anti")
    targets, at = [], 0.0
    for x in room[:-1]:
        at += x
        targets.append(at)
    edges = splitters(light, targets, TOLERANCE * max(1.0, total / shards))

    def placed(df: DataFrame, k: str, own) -> DataFrame:
        df = df.join(big, F.col(k) == F.col(hk), "left")
        by_range = F.lit(0)
        for e in edges:
            by_range = by_range + (F.col(k) >= F.lit(e)).cast("int")
        df = df.withColumn(at_, F.coalesce(hs, by_range))
        return df.withColumn(bin_, F.shiftright(k, shift)).withColumn(sub, F.coalesce(F.pmod(own, F.col(hn)).cast("int") + 1, F.lit(0))).drop(hk, hs, hn)

    counts = placed(probe, "key", F.col("own")).groupBy(at_, bin_, sub).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(at_).orderBy(bin_, sub).rowsBetween(Window.unboundedPreceding, -1)
    first = C.stored(counts.withColumn(first_, F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "bins")
    inside = Window.partitionBy(at_, bin_, sub).orderBy(key, doc_id)
    out = placed(keyed, key, F.xxhash64(F.col(doc_id).cast("string"))).withColumn(row, F.row_number().over(inside))
    out = out.join(first, [at_, bin_, sub])
    return out.select(*C.columns(docs), F.col(at_).alias(shard), (F.col(first_) + F.col(row) - 1).alias(slot))
