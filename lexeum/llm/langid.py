"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and read as words of letters and marks, each padded with
blanks. Every language has a model of ``ORDER`` characters over these words:
counts at the highest order, continuation counts below, one discount for each
order, interpolated down to a uniform share. A language's n-grams and contexts
are hashed and stand in sorted arrays. A document's
cross-entropy is per character; the least wins, ties to the smaller code.
Words are scored once each in a worker and remembered.

Rejection is calibrated on the training documents: a language's cross-entropy
there has a mean and a spread; a document further out than ``REJECT`` spreads
(wider for short texts) is marked ``rejected``.

Counts come from a bounded sample of documents with a language: ``TRAIN_ROWS``
of all, and ``LEAST_ROWS`` of each language that has so many. All n-grams of
the sample are counted and kept, so that discounts and continuation counts are
the sample's own; each language has arrays of its own, as large as its n-grams.

Defined cases: null, and texts without a letter, are ``und`` with score 0;
without training rows every text is ``und``; other columns stay,
and the new one's name gets underscores until it is free.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeum.llm import common as C

ORDER, TRAIN_ROWS, LEAST_ROWS, REJECT = 4, 20_000, 1_000, 6.0
#: Word scores that a worker remembers, one for each word and language.
REMEMBERED = 6_000_000
SLICE = 2 << 20
FOUND = "struct<lang:string,score:double,cross_entropy:double,rejected:boolean>"
_KIND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])


@functools.lru_cache(1)
def _letters():
    """Of each code point: is it a letter or mark; its hash; its 16-bit symbol (from 2)."""
    flag = np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        flag[c] = ch.isalpha() or (c > 0x2FF and unicodedata.category(ch)[0] == "M")
    cp = np.arange(0x110000, dtype=C.U)
    value = np.where(flag, C.mix(cp * C.U(0xD1342543DE82EF95) + C.U(77)), C.U(0))
    symbol = np.where(cp < 0xFFFE, cp, C.mix(cp) % C.U(0xFFF0) + C.U(2)).astype(C.U)
    symbol[:2] = 2
    return flag, value, symbol


def read(texts: list[str]):
    """Code points of all texts, and the words among them."""
    parts = [C.code_points(t.lower()) for t in texts]
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    cp = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    flag, value, _ = _letters()
    return cp, *C.words(cp, off, (flag, value))


def grams(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character and at the closing blank of each word, and the word of each."""
    n = e - s + 1
    word = np.repeat(np.arange(len(s)), n)
    at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    sym = _letters()[2]
    out = np.zeros(len(word), C.U)
    for back in range(ORDER):
        k = at - back
        inside = (k >= 0) & (k < (n - 1)[word])
        ch = np.full(len(word), 1, C.U)  # a blank
        ch[inside] = sym[cp[(s[word] + k)[inside]]]
        out |= ch << C.U(16 * back)
    return out, word


_low = lambda n: C.U((1 << (16 * n)) - 1)


class Models:
    """Sorted hash arrays of n-grams and contexts of each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        k = len(self.langs)
        self.mean, self.spread = np.zeros(k), np.ones(k)
        if not k:
            return
        symbols = set()
        for g, _ in counts.values():
            symbols.update(np.unique(g & _low(1)).tolist())
        self.floor = -np.log(len(symbols) + 1.0)
        probs = [[] for _ in range(ORDER + 1)]
        backs = [[] for _ in range(ORDER + 1)]
        for lang in self.langs:
            g, c = counts[lang]
            order = np.argsort(g)
            level = {ORDER: (g[order], c[order].astype(float))}
            for n in range(ORDER - 1, 0, -1):
                low, cont = np.unique(level[n + 1][0] & _low(n), return_counts=True)
                level[n] = (low, cont.astype(float))
            prev = None
            for n in range(1, ORDER + 1):
                g, c = level[n]
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
                ctx = g >> C.U(16)
                keys, inv = np.unique(ctx, return_inverse=True)
                total = np.bincount(inv, c)
                back = d * np.bincount(inv) / total
                if n == 1:
                    lower = np.full(len(g), np.exp(self.floor))
                else:
                    lower = prev[1][np.searchsorted(prev[0], g & _low(n - 1))]
                p = (c - np.minimum(c, d)) / total[inv] + back[inv] * lower
                prev = (g, p)
                probs[n].append((g, np.log(p)))
                backs[n].append((keys, np.log(back)))
        self.p = [None] + [[self._hashed(*x) for x in probs[n]] for n in range(1, ORDER + 1)]
        self.b = [None] + [[self._hashed(*x) for x in backs[n]] for n in range(1, ORDER + 1)]

    @staticmethod
    def _hashed(keys, values):
        h = C.mix(keys)
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def _find(where, g, missing):
        """A column for each language."""
        h = C.mix(g)
        order = np.argsort(h)  # searches in order stay in the cache
        out = np.full((len(g), len(where)), missing, np.float32)
        for j, (keys, values) in enumerate(where):
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h[order]), len(keys) - 1)
                hit = keys[i] == h[order]
                out[order[hit], j] = values[i[hit]]
        return out

    def words(self, cp, s, e) -> np.ndarray:
        """Log probability of each word, a column for each language."""
        out = np.zeros((len(s), len(self.langs)))
        step = 20_000
        for a in range(0, len(s), step):
            g, word = grams(cp, s[a : a + step], e[a : a + step])
            u, inv = np.unique(g, return_inverse=True)
            v = np.full((len(u), len(self.langs)), self.floor, np.float32)
            for n in range(1, ORDER + 1):
                x = u & _low(n)
                p = self._find(self.p[n], x, np.nan)
                v = np.where(np.isnan(p), self._find(self.b[n], x >> C.U(16), 0.0) + v, p)
            v = v[inv]
            heads = np.searchsorted(word, np.arange(word[-1] + 1 if len(word) else 0))
            out[a : a + step] = np.add.reduceat(v.astype(float), heads, 0)
        return out

    def entropies(self, texts: list[str], memory: dict) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language; characters of each text."""
        cp, h, s, e, ptr = read(texts)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        known = memory.get("h", np.empty(0, C.U))
        if (len(known) + len(u)) * len(self.langs) > REMEMBERED:
            memory.clear()
            known = np.empty(0, C.U)
        at = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
        new = known[at] != u if len(known) else np.ones(len(u), bool)
        table = memory.get("v", np.zeros((0, len(self.langs))))
        if new.any():
            v = self.words(cp, s[first[new]], e[first[new]])
            known, table = np.concatenate([known, u[new]]), np.concatenate([table, v])
            order = np.argsort(known)
            known, table = known[order], table[order]
            memory["h"], memory["v"] = known, table
        each = table[np.searchsorted(known, u)]
        total = np.zeros((len(texts), len(self.langs)))
        n = np.diff(ptr)
        some = n > 0
        for j in range(len(self.langs)):
            if some.any():
                total[some, j] = np.add.reduceat(each[:, j][inv], ptr[:-1][some])
        size = np.zeros(len(texts))
        if some.any():
            size[some] = np.add.reduceat(e - s + 1, ptr[:-1][some])
        return -total / np.maximum(size, 1)[:, None], size

    def find(self, texts: pa.Array, memory: dict) -> pa.Array:
        _, off = C.utf8(texts)
        parts = []
        for a, b in C.slices(off, SLICE):
            some = [t or "" for t in texts.slice(a, b - a).to_pylist()]
            h, size = self.entropies(some, memory) if self.langs else (np.zeros((len(some), 1)), np.zeros(len(some)))
            size[[not any(map(str.isalpha, t)) for t in some]] = 0  # marks alone are no letters
            k = h.argmin(1)
            least = h[np.arange(len(h)), k]
            lang = np.array([*self.langs, "und"], object)[np.where((size > 0) & (len(self.langs) > 0), k, len(self.langs))]
            w = np.exp(-(h - least[:, None]) * np.minimum(size, 60)[:, None])
            score = np.where(lang == "und", 0.0, 1.0 / w.sum(1))
            if self.langs:
                far = least > self.mean[k] + REJECT * self.spread[k] * np.sqrt(1 + 400 / np.maximum(size, 1))
            else:
                far = np.ones(len(h), bool)
            parts.append(pa.StructArray.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(np.where(size > 0, least, np.nan)), pa.array(far | (size == 0))], ["lang", "score", "cross_entropy", "rejected"]).cast(_KIND))
        return pa.concat_arrays(parts) if parts else pa.array([], _KIND)


def sample(docs: DataFrame, lang: str, key: str, rows: int = TRAIN_ROWS, least: int = LEAST_ROWS) -> DataFrame:
    """About ``rows`` rows of all, and about ``least`` of each language that has so many; all of a language with fewer. The same on each run."""
    n = {r[lang]: r["count"] for r in docs.groupBy(lang).count().collect()}  # one row a language
    total = sum(n.values())
    if total <= rows:
        return docs
    full = 1 << 31
    cuts = [(k, min(full, int(full * max(rows / total, least / v)))) for k, v in n.items()]
    cut = docs.sparkSession.createDataFrame(cuts, "_l string, _cut long")
    kept = docs.join(F.broadcast(cut), F.col(lang) == F.col("_l"))
    return kept.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(full)) < F.col("_cut")).select(*C.columns(docs))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Models:
    """Count n-grams over at most about ``rows`` of the rows of ``docs`` that have a language."""
    sc = C.ready(docs.sparkSession).sparkContext
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("_id"))
    some = sample(known, "lang", "_id", rows)

    def count(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for name in table["lang"].unique().to_pylist():
                part = table.filter(pa.compute.equal(table["lang"], name))["text"].combine_chunks()
                _, off = C.utf8(part)
                for a, b in C.slices(off):
                    cp, h, s, e, _ = read(part.slice(a, b - a).to_pylist())
                    if not len(h):
                        continue
                    _, first, times = np.unique(h, return_index=True, return_counts=True)
                    g, word = grams(cp, s[first], e[first])
                    u, inv = np.unique(g, return_inverse=True)
                    c = np.bincount(inv, times[word]).astype(np.int64)
                    yield pa.record_batch([pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c)], ["lang", "g", "c"])

    summed = some.select("lang", "text").mapInArrow(count, "lang string, g bigint, c bigint").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    best = summed.toArrow()
    names = np.array(best["lang"].to_pylist(), object)
    g, c = best["g"].to_numpy().view(C.U), best["c"].to_numpy()
    models = Models({n: (g[names == n], c[names == n]) for n in sorted(set(names))})
    if not models.langs:
        return models
    sent = sc.broadcast(models)

    def own(t: pa.Array, name: pa.Array) -> pa.Array:
        h, size = sent.value.entropies([x or "" for x in t.to_pylist()], {})
        k = [sent.value.langs.index(x) if x in sent.value.langs else -1 for x in name.to_pylist()]
        return pa.array([float(h[i, j]) if j >= 0 and size[i] >= 50 else None for i, j in enumerate(k)], pa.float64())

    check = sample(some.withColumn("_c", F.concat(F.lit("c"), F.col("_id").cast("string"))), "lang", "_c", rows // 10, LEAST_ROWS // 10)
    for r in check.select("lang", F.arrow_udf(own, "double").asNondeterministic()("text", "lang").alias("h")).groupBy("lang").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s")).collect():
        if r.m is not None and r.lang in models.langs:
            j = models.langs.index(r.lang)
            models.mean[j], models.spread[j] = r.m, max(r.s, 0.02)
    return models


def with_language(docs: DataFrame, models: Models, text: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with a struct: lang, score, cross_entropy, rejected."""
    sent = C.ready(docs.sparkSession).sparkContext.broadcast(models)
    memory: dict = {}
    return docs.withColumn(C.fresh(docs, name), F.arrow_udf(lambda t: sent.value.find(t, memory), FOUND).asNondeterministic()(F.col(text)))
