"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding, which keeps each character's place: lower case, base letters without
marks, homoglyphs of other scripts as the Latin letters they look like, digits
and signs inside words as the letters they stand for (1 as i, and whole words
with l are matched with i there too, where no clean row has that word), runs of
three or more equal letters as one, single letters that are spaced out by dots,
dashes, stars or underscores joined; zero-width characters go. All else is one
blank.

The lexicon holds whole words and word beginnings of 3 to 8 letters
(``STEMS``): ``SEEDS`` with a prior weight, and those learned from labelled
rows. A word or beginning is learned if it stands in ``LEAST_ROWS`` toxic rows
at least, its smoothed log-odds reach ``LEAST_ODDS``, and as many toxic rows
among those that hold it would come by chance with a probability under
``CHANCE`` (a Chernoff bound). Its weight is the lower bound of its log-odds,
so that entries seen in few rows weigh little. A match inside an exception
phrase does not count. A
document's score is a logistic curve over its summed weights (an entry's
repeats count by their logarithm), their share of the document's length, and
the number of different entries.

Lexicon and curve are fitted on disjoint parts of a bounded sample of
``TRAIN_ROWS`` labelled rows, which also bounds the lexicon.

Defined cases: null and empty texts have no match and the curve's least score;
without labelled rows of both classes the seeds and a fixed curve are used;
other columns stay,
and the new one's name gets underscores until it is free.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeum.llm import common as C

TRAIN_ROWS, LEAST_ROWS, LEAST_ODDS, LEAST_WEIGHT, CHANCE, STEMS = 20_000, 3, 3.0, 0.25, 1e-3, range(3, 9)
FOUND = "struct<score:double,weight:double,n_words:bigint,starts:array<bigint>,ends:array<bigint>,terms:array<string>>"
_KIND = pa.struct([("score", pa.float64()), ("weight", pa.float64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))])

SEEDS = ("asshole", "bastard", "bitch", "clown", "cunt", "degenerate", "disgusting", "dumbass", "fuck", "idiot", "imbecile", "loser", "moron", "pathetic", "retard", "scum", "scumbag", "shithead", "slut", "stupid", "subhuman", "trash", "vermin", "whore", "worthless", "arschloch", "dummkopf", "hurensohn", "schlampe", "connard", "salope", "enculé", "gilipollas", "imbécil", "puta")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash collection", "take out the trash", "clown fish", "circus clown", "class clown", "pond scum", "soap scum", "stupid question", "sore loser", "son of a bitch", "idiot proof", "moron de la frontera")
_LOOKS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s", "æ": "a", "œ": "o"}
_STANDS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l", "+": "t"}
_GONE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
BLANK, EDGE = 32, 10


@functools.lru_cache(1)
def _tables():
    """Of each code point: the folded one (a blank where it is none of a word); is it a sign that may stand in a word; does it go."""
    fold = np.full(0x110000, BLANK, np.uint32)
    sign, gone = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalnum():
            base = unicodedata.normalize("NFKD", ch.lower())[:1].lower() or ch
            base = _LOOKS.get(base, base)
            fold[c] = ord(_STANDS.get(base, base))
        elif c >= 0x300 and unicodedata.category(ch) in ("Mn", "Me"):
            gone[c] = True
    for ch, to in _SIGNS.items():
        fold[ord(ch)], sign[ord(ch)] = ord(_STANDS.get(to, to)), True
    gone[list(_GONE)] = True
    return fold, sign, gone


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts folded, each between blanks and closed by an edge; the place of each character in its text, and where texts begin."""
    fold, sign, gone = _tables()
    parts = []
    for t in texts:
        parts += [np.array([BLANK], np.uint32), C.code_points(t), np.array([BLANK, EDGE], np.uint32)]
    cp = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    size = np.array([len(parts[3 * i + 1]) for i in range(len(texts))], np.int64)
    ptr = np.concatenate(([0], np.cumsum(size + 3)))
    place = np.arange(len(cp)) - np.repeat(ptr[:-1], np.diff(ptr)) - 1
    f, signs = fold[cp], sign[cp]
    f[cp == EDGE] = BLANK
    solid = (f != BLANK) & ~signs
    after = np.append(solid[1:], False)
    before = np.insert(solid[:-1], 0, False)
    before_sign = np.insert(signs[:-1], 0, False)
    lone = signs & ~(after & (before | ~before_sign & (cp != ord("+")) & (cp != ord("!"))))
    f[lone] = BLANK
    f[ptr[1:] - 1] = EDGE
    keep = ~gone[cp]
    f, place = f[keep], place[keep]
    word = (f != BLANK) & (f != EDGE)
    raw = cp[keep]
    if len(f) > 4:  # s.p.a.c.e.d letters: a dot between two single letters
        dots = np.isin(raw, [ord(x) for x in "._-*"]) & ~word
        single = np.zeros(len(f), bool)
        single[1:-1] = word[1:-1] & ~word[:-2] & ~word[2:]
        join = np.zeros(len(f), bool)
        join[1:-1] = dots[1:-1] & single[:-2] & single[2:]
        f, place, word = f[~join], place[~join], word[~join]
    same = np.zeros(len(f), bool)
    if len(f) > 1:
        same[1:] = f[1:] == f[:-1]
    run = same.copy()
    run[:-1] |= same[1:]
    starts = np.flatnonzero(~same)
    length = np.diff(np.append(starts, len(f)))
    long_run = np.repeat(length >= 3, length)
    drop = same & (~word & (f == BLANK) | word & long_run)
    f, place = f[~drop], place[~drop]
    return f, place, np.concatenate(([0], np.flatnonzero(f == EDGE) + 1))


def fold_term(term: str) -> str:
    f, _, _ = folded([term])
    return f[:-1].tobytes().decode("utf-32-le").strip(" ")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients and shift by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    pen = np.full(len(b), ridge)
    pen[-1] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        g = x.T @ (p - y) + pen * b
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, g)
        b -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class Lexicon:
    """Entries, folded: ' word ' for whole words and ' beginning'; their weights; exception phrases; the curve."""

    entries: dict[str, float] = field(default_factory=lambda: {f" {fold_term(s)} ": 3.0 for s in SEEDS})
    exceptions: tuple[str, ...] = tuple(f" {fold_term(e)} " for e in EXCEPTIONS)
    curve: tuple[float, ...] = (0.9, 0.8, 0.3, -4.0)
    #: Whole words in which 1 stood for l: the form with i, and the entry.
    also: dict[str, str] = field(default_factory=lambda: {e.replace("l", "i"): e for e in (f" {fold_term(s)} " for s in SEEDS) if "l" in e})

    def automaton(self):
        if "_machine" not in self.__dict__:
            import ahocorasick

            a = ahocorasick.Automaton()
            for form, e in self.also.items():
                a.add_word(form, (len(e), self.entries[e], e))
            for e, w in self.entries.items():
                a.add_word(e, (len(e), w, e))
            for e in self.exceptions:
                a.add_word(e, (len(e), None, e))
            a.make_automaton()
            self.__dict__["_machine"] = a
        return self.__dict__["_machine"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_machine"}

    def matches(self, texts: list[str]):
        """For each text the matches (start, end, entry, weight) in it, and its number of words."""
        f, place, ptr = folded(texts)
        text = f.tobytes().decode("utf-32-le")
        out: list[list] = [[] for _ in texts]
        hits, shield = [], []
        for end, (n, w, e) in self.automaton().iter(text) if self.entries or self.exceptions else ():
            a = end - n + 2  # after the blank in front
            b = end if e.endswith(" ") else end + 1
            (shield if w is None else hits).append((a, b, e, w))
        heads = ptr[1:]
        if shield:
            starts = np.array([s[0] for s in shield])
            ends = np.maximum.accumulate(np.array([s[1] for s in sorted(shield)]))
            starts = np.sort(starts)
        best: dict[int, tuple] = {}
        for a, b, e, w in hits:
            if shield:
                k = int(np.searchsorted(starts, a, "right")) - 1
                if k >= 0 and ends[k] >= b:
                    continue
            if a not in best or (w, b) > (best[a][3], best[a][1]):
                best[a] = (a, b, e, w)
        for a, b, e, w in best.values():
            d = int(np.searchsorted(heads, a, "right"))
            out[d].append((int(place[a]), int(place[b - 1]) + 1, e, w))
        word = (f != BLANK) & (f != EDGE)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        n_words = np.add.reduceat(begins.astype(np.int64), ptr[:-1]) if len(texts) else np.empty(0, np.int64)
        return out, n_words

    @staticmethod
    def features(found, n_words) -> np.ndarray:
        x = np.zeros((len(found), 3))
        for i, m in enumerate(found):
            times = Counter((e, w) for _, _, e, w in m)
            s = sum(w * (1 + np.log(k)) for (_, w), k in times.items())
            x[i] = np.log1p(s), np.log1p(100 * s / (n_words[i] + 20)), len(times)
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        b = np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -35, 35)))

    def find(self, texts: pa.Array) -> pa.Array:
        _, off = C.utf8(texts)
        parts = []
        for a, b in C.slices(off):
            found, n = self.matches([t or "" for t in texts.slice(a, b - a).to_pylist()])
            found = [sorted(m) for m in found]
            score = self.score(self.features(found, n))
            rows = [(s, sum(w for *_, w in m), k, [y[0] for y in m], [y[1] for y in m], [y[2].strip() for y in m]) for s, m, k in zip(score.tolist(), found, n.tolist(), strict=True)]
            cols = list(zip(*rows, strict=True))
            parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _KIND, strict=True)], fields=list(_KIND)))
        return pa.concat_arrays(parts) if parts else pa.array([], _KIND)


def _terms(texts: list[str]):
    """Hashes of each text's distinct words and word beginnings with a place where each stands: (text, hash, start, end or -end of a whole word)."""
    f, _, ptr = folded(texts)
    ok = (f != BLANK) & (f != EDGE)
    value = C.mix(np.where(ok, f, 0).astype(C.U) + C.U(11))
    begin = ok.copy()
    begin[1:] &= ~ok[:-1]
    close = ok.copy()
    close[:-1] &= ~ok[1:]
    s, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
    doc = np.searchsorted(ptr, s, "right") - 1
    power, inverse = C._powers(1 << max(20, len(f).bit_length()))
    run = np.zeros(len(f) + 1, C.U)
    np.cumsum(value * power[: len(f)], out=run[1:], dtype=C.U)
    docs, hashes, starts, ends = [], [], [], []
    for n in [0, *STEMS]:
        use = (e - s >= n) if n else np.ones(len(s), bool)
        a, b = s[use], (s[use] + n if n else e[use])
        docs.append(doc[use])
        hashes.append(C.mix((run[b] - run[a]) * inverse[a] + C.U(2 if n else 1)))
        starts.append(a)
        ends.append(b if n else -b)
    return f, np.concatenate(docs), np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def significant(toxic: int, other: int, base: float) -> bool:
    """Would so many toxic rows among those of a term come by chance with a probability under ``CHANCE``? (Chernoff)"""
    k = toxic / (toxic + other)
    gain = toxic * np.log(k / base) + (other * np.log((1 - k) / (1 - base)) if other else 0.0)
    return bool(k > base and gain >= -np.log(CHANCE))


def lower_bound(odds: float, toxic: int, other: int) -> float:
    """The log-odds less two standard errors, and a little at least: rare entries weigh little."""
    return max(LEAST_WEIGHT, odds - 2 * float(np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))))


def word_hash(word: str) -> int:
    """The hash of a whole word as :func:`_terms` gives it."""
    _, _, h, _, e = _terms([word])
    return int(h.view(np.int64)[e < 0][0])


def _count(batches):
    """(hash, toxic rows, other rows) of the terms of each batch."""
    for batch in batches:
        texts, y = batch.column(0), batch.column(1).to_numpy()
        _, off = C.utf8(texts)
        for a, b in C.slices(off, 1 << 20):
            _, d, h, _, _ = _terms([t or "" for t in texts.slice(a, b - a).to_pylist()])
            order = np.lexsort((h, d))
            d, h = d[order], h[order]
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            d, h = d[head], h[head]
            u, inv = np.unique(h, return_inverse=True)
            one = np.bincount(inv, y[a:b][d], len(u)).astype(np.int64)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(one), pa.array(np.bincount(inv, minlength=len(u)) - one, pa.int64())], ["h", "n1", "n0"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Lexicon:
    """Learn weights and curve from at most about ``rows`` of the labelled rows."""
    spark = C.ready(docs.sparkSession)
    known = C.bounded_sample(labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")), F.col("_id"), rows)
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).join(F.broadcast(known), "_id")
    fold = F.crc32(F.concat(F.col("_id").cast("string"), F.lit("c"))) % 5 == 0
    sample = C.stored(sample.select("t", "y", fold.alias("judge")).dropDuplicates(["t", "y"]), "labelled")
    share = {(r.judge, r.y): r.n for r in sample.groupBy("judge", "y").agg(F.count("*").alias("n")).collect()}
    lexicon = Lexicon()
    p, n = share.get((False, 1), 0), share.get((False, 0), 0)
    if p and n:
        odds = F.log((F.col("n1") + 0.5) / (p + 1.0)) - F.log((F.col("n0") + 0.5) / (n + 1.0))
        found = sample.filter("not judge").select("t", "y").mapInArrow(_count, "h bigint, n1 bigint, n0 bigint").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        found = C.stored(found, "counts")
        base = p / (p + n)
        rows_ = found.filter((F.col("n1") >= LEAST_ROWS) & (F.col("n1") > base * (F.col("n1") + F.col("n0")))).withColumn("w", odds).filter(F.col("w") >= LEAST_ODDS)
        got = {r.h: lower_bound(r.w, r.n1, r.n0) for r in rows_.collect() if significant(r.n1, r.n0, base)}
        sent = spark.sparkContext.broadcast(np.sort(np.array(list(got), np.int64)))

        def name(batches):
            want, seen = sent.value, set()
            for batch in batches:
                hashes, words = [], []
                for t in batch.column(0).to_pylist():
                    f, _, h, s, e = _terms([t or ""])
                    h = h.view(np.int64)
                    i = np.minimum(np.searchsorted(want, h), max(0, len(want) - 1))
                    for j in np.flatnonzero(want[i] == h) if len(want) else ():
                        if h[j] not in seen:
                            seen.add(h[j])
                            word = f[s[j] : abs(e[j])].tobytes().decode("utf-32-le")
                            hashes.append(h[j])
                            words.append(f" {word} " if e[j] < 0 else f" {word}")
                yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array(words, pa.string())], ["h", "e"])

        names = sample.filter("not judge and y = 1").select("t").mapInArrow(name, "h bigint, e string").groupBy("h").agg(F.min("e").alias("e")).collect()
        accepted: dict[str, float] = {}
        for r in sorted(names, key=lambda r: (len(r.e.rstrip(" ")), r.e.endswith(" "), r.e)):
            w = got[r.h]
            shorter = [accepted[r.e[:k]] for k in range(1 + STEMS.start, len(r.e)) if r.e[:k] in accepted]
            if not shorter or max(shorter) < w - 1.0:
                accepted[r.e] = max(w, lexicon.entries.get(r.e, 0.0))
        lexicon.entries |= accepted
        forms = {word_hash(e.replace("l", "i")): e for e in accepted if "l" in e and e.endswith(" ")}
        if forms:
            clean = {r.h for r in found.filter((F.col("n0") > 0) & F.col("h").isin(list(forms))).select("h").collect()}
            for h, e in forms.items():
                if h not in clean and e.replace("l", "i") not in lexicon.entries:
                    lexicon.also.setdefault(e.replace("l", "i"), e)
        C.forget(found)
    if share.get((True, 0), 0) and share.get((True, 1), 0):
        sent_l = spark.sparkContext.broadcast(lexicon)

        def feats(t: pa.Array) -> pa.Array:
            _, off = C.utf8(t)
            out = []
            for a, b in C.slices(off):
                out += Lexicon.features(*sent_l.value.matches([x or "" for x in t.slice(a, b - a).to_pylist()])).tolist()
            return pa.array(out, pa.list_(pa.float64()))

        got_x = sample.filter("judge").select("y", F.arrow_udf(feats, "array<double>").asNondeterministic()("t").alias("x")).toArrow()
        x, y = np.array(got_x["x"].to_pylist(), float).reshape(-1, 3), got_x["y"].to_numpy().astype(float)
        order = np.lexsort((y, x[:, 2], x[:, 1], x[:, 0]))
        lexicon.curve = tuple(float(b) for b in logistic(x[order], y[order], 0.1))
    return lexicon


def with_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with a struct: score, weight, n_words, and the matches' starts, ends and entries."""
    sent = C.ready(docs.sparkSession).sparkContext.broadcast(lexicon)
    return docs.withColumn(C.fresh(docs, name), F.arrow_udf(lambda t: sent.value.find(t), FOUND).asNondeterministic()(F.col(text)))
