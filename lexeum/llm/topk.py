"""Exact top-k inner-product search over impact-ordered posting segments, score at a time.

Vectors become integers, floor(scale * x). Rows are indexed in tiles of up to
``TILE``: a posting (row, dimension, component) for every non-zero component,
in segments of equal quantised impact (half octaves of the component's absolute
value) by descending impact, and inside a segment by row. With each segment
goes what the later segments can still add: the length of what is left of each
row. A query's segments are processed in that order; accumulators are touched
only for the rows of a segment. After each, a row's score is known up to
(query length) times (length left of the row), by Cauchy-Schwarz; rows whose
upper bound lies under the k-th best score proven so far, here or in an earlier
tile, cannot be among the k best. The search of a tile stops when the rows left
have a ``RESCORE``-th of the postings that are still to come, or when all
segments are done, and these rows are rescored exactly. Ties go to the smaller
id.

A tile's index is made once for all queries of a batch. Query batches are
bounded in bytes (``QUERY_BYTES``) and broadcast one after the other over all
rows; each task keeps k rows a query.

Defined cases: vectors that are null or hold null or non-finite components and
rows without id take no part; vectors are compared with those of equal length
only; a row is no candidate for a query of the same id; where a query's id is
repeated, its least vector asks; components saturate at 64 bits, and scores
are computed exactly and saturate too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeum.llm import common as C

QUERY_BYTES, TILE = 32 << 20, 16_384
#: A posting rescored costs as much as so many processed; bounds are looked at from this share of a tile's postings on.
RESCORE, LOOK = 4, 1 / 4
_LONG = np.iinfo(np.int64)


def integers(df: DataFrame, vec_id: str, embedding: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    e = F.col(embedding)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return df.filter(F.col(vec_id).isNotNull() & e.isNotNull() & F.forall(e, finite)).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("v"))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, saturated at 64 bits."""
    if q.size == 0:
        return np.zeros(len(q), np.int64)
    if float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", q, x)
    return np.array([min(_LONG.max, max(_LONG.min, sum(int(a) * int(b) for a, b in zip(r, s, strict=True)))) for r, s in zip(q, x, strict=True)], np.int64)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, in order."""
    order = np.lexsort((ids, ~score, query))  # ~ turns the order round without overflow
    q = query[order]
    head = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.empty(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(head, np.arange(len(q)), 0))
    return order[rank < k]


class Tile:
    """The index of some rows: posting segments by descending impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        xf = x.astype(float)
        size = np.abs(xf)
        self.most = float(size.max()) if size.size else 0.0
        level = np.full(x.shape, -1, np.int16)
        some = size > 0
        level[some] = np.floor(2 * np.log2(size[some]))
        left = (xf * xf).sum(1)
        #: (dimensions, components, rows touched, where each row's postings begin, length left of each row, share of postings so far)
        self.segments, done, total = [], 0, int(some.sum())
        self.postings = total
        for v in sorted(set(np.unique(level).tolist()) - {-1}, reverse=True):
            row, dim = np.nonzero(level == v)
            value = xf[row, dim]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            left = left.copy()
            left[row[first]] -= np.add.reduceat(value * value, first)
            done += len(row)
            rest = np.sqrt(np.maximum(left, 0.0)) if done < total else np.zeros(len(ids))
            self.segments.append((dim, value, row[first], first, rest, done / total))

    def candidates(self, me, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, int]:
        """Places of the rows that may be among the query's k best with a score of ``floor`` at least, and the postings processed."""
        qf = q.astype(float)
        length, n = float(np.sqrt((qf * qf).sum())), len(self.ids)
        slack = 1e-9 * (np.abs(qf).sum() * self.most) + 1e-6  # of float sums
        acc = np.where(self.ids == me, -np.inf, 0.0)
        seen = 0
        for dim, value, touched, first, rest, share in self.segments:
            acc[touched] += np.add.reduceat(qf[dim] * value, first)
            seen += len(dim)
            if share < LOOK:
                continue
            err = length * rest * (1 + 1e-9) + slack
            bar = max(floor, float(np.partition(acc - err, -k)[-k])) if n >= k else floor
            alive = acc + err >= bar
            if share == 1.0 or alive.sum() * self.x.shape[1] * RESCORE <= self.postings - seen:
                return np.flatnonzero(alive & (self.ids != me)), seen
        return np.flatnonzero(self.ids != me), seen  # no postings at all


def search(qid: np.ndarray, q: np.ndarray, tile: Tile, k: int, kept) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of the k best rows of each query in the tile and in ``kept``, those of earlier tiles."""
    at, ids, score = kept or (np.empty(0, np.int64),) * 3
    full = np.bincount(at, minlength=len(qid)) >= k
    floor = np.full(len(qid), np.inf)
    np.minimum.at(floor, at, score.astype(float))
    floor = np.where(full, floor - 1e-12 * np.abs(floor), -np.inf)
    places, rows = [at], [ids]
    scores = [score]
    for p in range(len(qid)):
        alive, _ = tile.candidates(qid[p], q[p], k, float(floor[p]))
        if len(alive):
            places.append(np.full(len(alive), p))
            rows.append(tile.ids[alive])
            scores.append(exact(np.broadcast_to(q[p], (len(alive), q.shape[1])), tile.x[alive]))
    at, ids, score = (np.concatenate(x) for x in (places, rows, scores))
    top = best(at, ids, score, k)
    return at[top], ids[top], score[top]


def top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query; ``is_query`` is over ``df``'s columns."""
    spark = df.sparkSession
    rows = integers(df, vec_id, embedding, scale)
    asked = C.stored(integers(df.filter(is_query), vec_id, embedding, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    batches = max(1, -(-n * 8 * (dim or 1) // QUERY_BYTES))
    out = None
    for b in range(batches):
        part = asked if batches == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == b)
        sent = spark.sparkContext.broadcast(_by_length(part.toArrow()))

        def run(batches_, sent=sent):
            kept: dict = {}
            for table in _tiles(batches_):
                for d, (ids, x) in _by_length(table).items():
                    if d in sent.value:
                        kept[d] = search(*sent.value[d], Tile(ids, x), k, kept.get(d))
            for d, (at, ids, score) in kept.items():
                yield pa.record_batch([pa.array(sent.value[d][0][at]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

        found = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        out = found if out is None else out.union(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tiles(batches):
    """The batches as tables of about ``TILE`` rows."""
    held, n = [], 0
    for batch in batches:
        for a in range(0, len(batch), TILE):
            held.append(batch.slice(a, TILE))
            n += len(held[-1])
            if n >= TILE:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors as matrices, by the vectors' length."""
    table = table.combine_chunks()
    if not len(table):
        return {}
    ids = table["vec_id"].to_numpy()
    v = table["v"].combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    size = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    return {int(d): (ids[size == d], flat[start[size == d][:, None] + np.arange(d)[None, :]]) for d in np.unique(size)}
