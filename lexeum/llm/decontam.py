"""Benchmark decontamination by a prefix-filtered set join.

Words are runs of ASCII letters, digits and all above ASCII, A-Z lower-cased.
An item's windows are its runs of ``WINDOW`` words (an item of fewer is one
window). A document contains a window when all its words stand there in a
row. Every shingle of a window (``SHINGLE`` words, fewer in shorter windows)
must then occur, so at containment 1 the necessary prefix is the one rarest
shingle: shingles are ordered by their document frequency over the whole
corpus, documents are joined on that one, positional and length bounds place
the window in the text, and its words are compared, hashes first and then
bytes.

The benchmark is taken in parts of ``PART_BYTES`` of text, each broadcast for
one pass that counts shingles and one that finds windows; hits of several parts
are united per row. What is broadcast is at most three times a part: its text,
and five bytes for each window's place in the order of rarity. A worker makes
word hashes, windows and shingles of it as arrays, about eight times the text.

Defined cases: null text has no words and no hits; an item without words or
id is never found; items that share a window are each found by it, rows of one
item id are one item; repeated rows each get a result; an empty benchmark finds nothing; other columns
stay, and the new one's name gets underscores until it is free.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeum.llm import common as C

WINDOW, SHINGLE, PART_BYTES = 10, 3, 8 << 20
HITS = "struct<n_words:bigint,hits:array<bigint>,items:array<string>>"
_KIND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


class Windows:
    """The distinct windows of some items, their shingles, and after ``rank`` an index on each window's rarest.

    What is sent to workers is the items' text in small letters and, in the
    index, five bytes a window; words and hashes are made from the text once in
    each worker. A window is the place of its first word.
    """

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW, shingle: int = SHINGLE):
        self.ids, self.window, self.shingle = [str(i) for i, _ in items], window, shingle
        data, self.off = C.utf8(pa.array([t for _, t in items], pa.large_string()))
        self.low = data.copy()
        self.low[(self.low >= 65) & (self.low <= 90)] += 32
        self.order: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("text", "places", "shingles", "index")}

    @functools.cached_property
    def text(self) -> tuple[np.ndarray, ...]:
        """Word hashes, first and end bytes, and each item's place among the words."""
        return C.words(self.low, self.off, C.ALNUM)

    @functools.cached_property
    def places(self) -> tuple[np.ndarray, ...]:
        """Of each distinct window its first word and its size; and the (window, item) of all items that have it, by window."""
        h, _, _, ptr = self.text
        many = np.diff(ptr)
        item = np.repeat(np.arange(len(many)), np.where(many > 0, np.maximum(many - self.window, 0) + 1, 0))
        head = np.append(True, item[1:] != item[:-1])[: len(item)]
        start = ptr[item] + np.arange(len(item)) - np.repeat(np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), len(item))))
        size = np.minimum(many[item], self.window)
        own = np.zeros(len(start), C.U)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            own[at] = C.ngrams(h, n)[start[at]]
        by = np.lexsort((start, own, size))
        start, size, own, item = start[by], size[by], own[by], item[by]
        new = np.append(True, (own[1:] != own[:-1]) | (size[1:] != size[:-1]))[: len(own)]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(own) else np.empty(0, np.int64)
        for j in range(self.window):  # equal hashes of other words are windows of their own
            on = j < size
            new |= on & (h[np.where(on, start + j, 0)] != h[np.where(on, start[lead] + j, 0)]) if len(h) else False
        which = np.cumsum(new) - 1
        pairs = np.unique(which * max(1, len(self.ids)) + item)
        return start[new], size[new], pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    @functools.cached_property
    def shingles(self) -> dict[int, np.ndarray]:
        """The distinct shingles of the windows, by their number of words."""
        h, _, _, ptr = self.text
        start, size, _, _ = self.places
        out = {}
        for n in np.unique(np.minimum(size, self.shingle)).tolist():
            mine = np.flatnonzero(np.minimum(size, self.shingle) == n)
            at = np.unique(np.concatenate([start[mine][size[mine] - n >= k] + k for k in range(int(size[mine].max()) - n + 1)]))
            out[n] = np.unique(C.ngrams(h, n)[at])
        return out

    def rank(self, df: dict[int, np.ndarray]) -> None:
        """Order the windows by their rarest shingle; ``df``: document frequencies in the order of ``shingles``."""
        h, _, _, _ = self.text
        start, size, _, _ = self.places
        for n, known in self.shingles.items():
            at = np.flatnonzero(np.minimum(size, self.shingle) == n)
            g = C.ngrams(h, n)
            best, count, shift = np.zeros(len(at), C.U), np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.uint8)
            for k in range(int(size[at].max()) - n + 1):
                has = k + n <= size[at]
                mine = g[np.where(has, start[at] + k, 0)]
                seen = df[n][np.minimum(np.searchsorted(known, mine), len(known) - 1)]
                less = has & ((seen < count) | ((seen == count) & (mine < best)))
                best, count, shift = np.where(less, mine, best), np.where(less, seen, count), np.where(less, k, shift).astype(np.uint8)
            by = np.argsort(best, kind="stable")
            self.order[n] = (at[by].astype(np.int32), shift[by])
        self.__dict__.pop("index", None)

    @functools.cached_property
    def index(self) -> dict[int, tuple[np.ndarray, ...]]:
        """The rarest shingles in order, where their windows begin and how many there are, the windows, and the shingle's place in each."""
        h, _, _, _ = self.text
        out = {}
        for n, (win, shift) in self.order.items():
            keys, first, count = np.unique(C.ngrams(h, n)[self.places[0][win] + shift], return_index=True, return_counts=True)
            out[n] = (keys, first, count, win, shift.astype(np.int64))
        return out

    def member(self, g: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``g`` holds entries of the sorted ``known``, and which."""
        flags = np.zeros(1 << 20, bool)
        flags[(known & C.U((1 << 20) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(flags[(g & C.U((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(known):
            return at[:0], at[:0]
        pos = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
        ok = known[pos] == g[at]
        return at[ok], pos[ok]

    def frequencies(self, texts: pa.Array) -> dict[int, np.ndarray]:
        """Of each shingle: the rows that hold it."""
        data, off = C.utf8(texts)
        out = {n: np.zeros(len(k), np.int64) for n, k in self.shingles.items()}
        for a, b in C.slices(off):
            h, _, _, ptr = C.words(data[off[a] : off[b]], off[a : b + 1] - off[a], C.ALNUM)
            for n, known in self.shingles.items():
                g = C.ngrams(h, n)
                at, which = self.member(g, known)
                ok = C.inside(ptr, n, len(h))[at]
                at, which = at[ok], which[ok]
                row = np.searchsorted(ptr, at, "right") - 1
                both = np.unique(row * len(known) + which)
                np.add.at(out[n], both % len(known), 1)
        return out

    def find(self, texts: pa.Array) -> pa.Array:
        """Of each row: words, places of hit words, ids of the items found."""
        data, off = C.utf8(texts)
        its, low, first_byte, end_byte = self.text[0], self.low, self.text[1], self.text[2]
        begin, size, of_window, of_item = self.places
        lead = np.searchsorted(of_window, np.arange(len(begin) + 1))
        parts = []
        for a, b in C.slices(off):
            part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
            h, s, e, ptr = C.words(part, o, C.ALNUM)
            mark = np.zeros(len(h) + 1, np.int64)
            found: list[set] = [set() for _ in range(b - a)]
            for n, (keys, first, count, win, shift) in self.index.items():
                at, which = self.member(C.ngrams(h, n), keys)
                for lo in range(0, len(at), 1 << 16):
                    p, w = at[lo : lo + (1 << 16)], which[lo : lo + (1 << 16)]
                    reps = count[w]
                    pos = np.repeat(p, reps)
                    slot = np.repeat(first[w], reps) + np.arange(len(pos)) - np.repeat(np.cumsum(reps) - reps, reps)
                    i, start = win[slot], pos - shift[slot]
                    row = np.searchsorted(ptr, pos, "right") - 1
                    ok = (start >= ptr[row]) & (start + size[i] <= ptr[row + 1])
                    i, start, row = i[ok], start[ok], row[ok]
                    for j in range(self.window):
                        on = j < size[i]
                        same = ~on | (h[np.where(on, start + j, 0)] == its[np.where(on, begin[i] + j, 0)]) if len(h) else on
                        i, start, row = i[same], start[same], row[same]
                    for x, st, r in zip(i.tolist(), start.tolist(), row.tolist(), strict=True):
                        b0, m = int(begin[x]), int(size[x])
                        if all(part[s[st + j] : e[st + j]].tobytes().lower() == low[first_byte[b0 + j] : end_byte[b0 + j]].tobytes() for j in range(m)):
                            mark[st] += 1
                            mark[st + m] -= 1
                            found[r].update(of_item[lead[x] : lead[x + 1]].tolist())
            hit = np.cumsum(mark)[:-1] > 0
            at = np.flatnonzero(hit)
            row = np.searchsorted(ptr, at, "right") - 1
            local = at - ptr[row] if len(at) else at
            edges = np.searchsorted(row, np.arange(b - a + 1))
            names = [list(dict.fromkeys(self.ids[x] for x in sorted(f))) for f in found]
            parts.append(pa.StructArray.from_arrays([pa.array(np.diff(ptr), pa.int64()), C.list_array(local, edges, pa.int64()), pa.array(names, pa.list_(pa.string()))], ["n_words", "hits", "items"]).cast(_KIND))
        return pa.concat_arrays(parts) if parts else pa.array([], _KIND)


def _finder(windows):
    return lambda texts: windows.value.find(texts)


def with_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "found", window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct: n_words, hits (places of the words hit, from 0), items (ids found, in item order)."""
    spark, name = C.ready(docs.sparkSession), C.fresh(docs, name)
    items = benchmark.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    cols = []
    for p in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == p)
        w = Windows([(r.i, r.t) for r in part.orderBy("i").collect()], window)
        sent = spark.sparkContext.broadcast(w)

        def count(batches, sent=sent):
            total = {n: np.zeros(len(k), np.int64) for n, k in sent.value.shingles.items()}
            for batch in batches:
                for n, c in sent.value.frequencies(batch.column(0)).items():
                    total[n] += c
            for n, c in total.items():
                at = np.flatnonzero(c)
                yield pa.record_batch([pa.array(np.full(len(at), n), pa.int32()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["n", "at", "df"])

        df = {n: np.zeros(len(k), np.int64) for n, k in w.shingles.items()}
        if len(w.places[0]):  # one row for each shingle of this part at most
            for r in docs.select(text).mapInArrow(count, "n int, at bigint, df bigint").groupBy("n", "at").agg(F.sum("df").alias("df")).collect():
                df[r.n][r["at"]] = r.df
        w.rank(df)
        ready = spark.sparkContext.broadcast(w)
        col = C.fresh(docs, f"{name}_{p}")
        docs = docs.withColumn(col, F.arrow_udf(_finder(ready), HITS).asNondeterministic()(F.col(text)))
        cols.append(col)
    if parts == 1:
        return docs.withColumnRenamed(cols[0], name)
    hits = F.array_sort(F.array_distinct(F.flatten(F.array(*[f"{c}.hits" for c in cols]))))
    found = F.array_distinct(F.flatten(F.array(*[f"{c}.items" for c in cols])))
    return docs.withColumn(name, F.struct(F.col(f"{cols[0]}.n_words").alias("n_words"), hits.alias("hits"), found.alias("items"))).drop(*cols)


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark window; columns stay as they are."""
    name = C.fresh(docs, "found")
    return with_contamination(docs, benchmark, text, name=name).filter(F.size(f"{name}.hits") == 0).drop(name)
