"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text (none depends on its length alone), most of them
shares under a square root, are standardised. Each class has a Gaussian whose
covariance is shrunk towards the pooled one (lambda) and then towards a
multiple of the identity (gamma); both are chosen on a hashed fifth of the
training rows. Scores are log-density differences by Mahalanobis distances
through cached Cholesky factors, mapped to 0..1 by a logistic curve fitted on
the same fifth.

The fit uses a bounded sample of ``TRAIN_ROWS`` labelled rows.

Defined cases: null and empty texts have the statistics of an empty text and
a score like all others; without labelled rows of both classes every score is
the share of class 1 (0.5 without any); other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexeum.llm import common as C

TRAIN_ROWS, LEAST, LAGS = 20_000, 0.7, 8
GRID = [(lam, gam) for lam in (0.0, 0.1, 0.4, 0.8) for gam in (0.02, 0.1, 0.3)]


def _class_of_bytes() -> np.ndarray:
    """One column for each kind of byte."""
    kinds = [b"#$%&*^~=<>@{}[]\\/+_`", b"|", b"0123456789", bytes(range(65, 91)), b".,;:!?", b"\n", b" \t\r\x0b\x0c"]
    out = np.zeros((256, len(kinds)), np.uint8)
    for i, k in enumerate(kinds):
        out[list(k), i] = 1
    return out


_KINDS = _class_of_bytes()
NAMES = ("symbols", "pipes", "digits", "capitals", "stops", "lines", "repeat_1", "repeat_near", "odd_words", "word_bytes")


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    data, off = C.utf8(texts)
    out = np.zeros((len(off) - 1, len(NAMES)))
    for a, b in C.slices(off):
        part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        n_bytes = np.diff(o)
        some = n_bytes > 0
        h, s, e, ptr = C.words(part, o, C.NOT_BLANK)
        n = np.diff(ptr)
        kinds = np.zeros((b - a, _KINDS.shape[1]))
        sums = lambda flags, ptr_, some_: np.add.reduceat(flags, ptr_[:-1][some_], dtype=np.int64) if some_.any() else np.empty(0, np.int64)
        for j in range(_KINDS.shape[1]):
            kinds[some, j] = sums(_KINDS[:, j][part], o, some)
        row = np.repeat(np.arange(b - a), n)
        first = ptr[row]
        near = np.zeros(len(h), bool)
        last = np.zeros(len(h), bool)
        for lag in range(1, LAGS + 1):
            same = np.zeros(len(h), bool)
            same[lag:] = h[lag:] == h[:-lag]
            same &= np.arange(len(h)) - lag >= first
            near |= same
            if lag == 1:
                last = same
        within = lambda kind: (c := np.concatenate(([0], np.cumsum(_KINDS[:, kind][part], dtype=np.int64))))[e] - c[s]
        words = n > 0
        per_word = np.zeros((b - a, 5))
        for j, flags in enumerate((last, near, within(0) >= 2, within(2) >= 1, within(3) >= 2)):
            per_word[words, j] = sums(flags.astype(np.uint8), ptr, words)
        solid = n_bytes - kinds[:, 5] - kinds[:, 6]
        x = out[a:b]
        x[:, :5] = np.sqrt(kinds[:, :5] / np.maximum(solid, 20)[:, None])
        x[:, 5] = np.sqrt(kinds[:, 5] / np.maximum(n, 10))
        x[:, 6:9] = np.sqrt(per_word[:, :3] / np.maximum(n, 8)[:, None])
        x[:, 2:4] = np.sqrt(per_word[:, 3:] / np.maximum(n, 8)[:, None])  # of words, so that one odd word stays one
        x[:, 9] = np.log((solid + 50.0) / (n + 10.0))
    return out


@dataclass
class Discriminant:
    """Means, Cholesky factors with their inverses, and log-determinants of both classes; slope and shift of the logistic curve."""

    centre: np.ndarray
    scale: np.ndarray
    mean: list = field(default_factory=list)
    factor: list = field(default_factory=list)
    whitener: list = field(default_factory=list)
    logdet: list = field(default_factory=list)
    prior: float = 0.5
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        d = []
        for k in (0, 1):
            w = (z - self.mean[k]) @ self.whitener[k].T
            d.append(-0.5 * ((w * w).sum(1) + self.logdet[k]))
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.margin(x)) + self.shift, -35, 35)))


def inverse(low: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, by forward substitution."""
    out = np.zeros_like(low)
    for i in range(len(low)):
        out[i, i] = 1.0
        out[i] = (out[i] - low[i, :i] @ out[:i]) / low[i, i]
    return out


def squash(d: np.ndarray) -> np.ndarray:
    """Keeps order, and keeps far margins from ruling the logistic fit."""
    return np.sign(d) * np.log1p(np.abs(d))


def logistic(d: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps with a small ridge."""
    x = np.stack([d, np.ones_like(d)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        g = x.T @ (p - y) + 1e-2 * np.array([b[0] - 1.0, b[1]])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, g)
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> Discriminant:
    """``valid`` marks the rows on which shrinkage is chosen and the curve is fitted."""
    m = Discriminant(x.mean(0) if len(x) else np.zeros(x.shape[1]), np.maximum(x.std(0), 1e-3) if len(x) else np.ones(x.shape[1]))
    m.prior = float(y.mean()) if len(y) else 0.5
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return m
    if min(((y == k) & w).sum() for k in (0, 1) for w in (valid, ~valid)) < 2:
        valid = np.zeros(len(y), bool)
    z = (x - m.centre) / m.scale
    use = ~valid
    judged = valid if valid.any() else use
    d = z.shape[1]
    cov = [np.cov(z[use & (y == k)].T, bias=True) for k in (0, 1)]
    share = [(use & (y == k)).sum() / use.sum() for k in (0, 1)]
    pooled = share[0] * cov[0] + share[1] * cov[1]
    m.mean = [z[use & (y == k)].mean(0) for k in (0, 1)]
    best = None
    for lam, gam in GRID:
        m.factor, m.whitener, m.logdet = [], [], []
        for k in (0, 1):
            s = (1 - lam) * cov[k] + lam * pooled
            s = (1 - gam) * s + gam * max(np.trace(s) / d, 1e-3) * np.eye(d)
            low = np.linalg.cholesky(s)
            m.factor.append(low)
            m.whitener.append(inverse(low))
            m.logdet.append(2 * np.log(np.diag(low)).sum())
        t = squash(m.margin(x[judged]))
        a, b = logistic(t, y[judged])
        p = np.clip(1 / (1 + np.exp(-np.clip(a * t + b, -35, 35))), 1e-9, 1 - 1e-9)
        loss = -(y[judged] * np.log(p) + (1 - y[judged]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-9:
            best = (loss, m.factor, m.whitener, m.logdet, a, b)
    _, m.factor, m.whitener, m.logdet, m.slope, m.shift = best
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Discriminant:
    """Fit on at most about ``rows`` of the labelled rows; a row of statistics for each goes to the driver."""
    known = C.bounded_sample(labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")), F.col("_id"), rows)
    C.ready(docs.sparkSession)
    stats = F.arrow_udf(lambda t: pa.array(list(statistics(t)), pa.list_(pa.float64())), "array<double>").asNondeterministic()
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(known), "_id")
    got = joined.select("_y", (F.crc32(F.concat(F.col("_id").cast("string"), F.lit("v"))) % 5 == 0).alias("_v"), stats("_t").alias("_x")).orderBy("_id").toArrow()
    x = np.array(got["_x"].to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x, np.array(got["_y"].to_pylist(), float), np.array(got["_v"].to_pylist(), bool))


def score(docs: DataFrame, model: Discriminant, text: str = "text") -> Column:
    """A column over ``docs``: 0..1, higher where quality 1 is likelier."""
    sent = C.ready(docs.sparkSession).sparkContext.broadcast(model)
    return F.arrow_udf(lambda t: pa.array(sent.value.score(statistics(t)), pa.float64()), "double").asNondeterministic()(F.col(text))


def keep_good(docs: DataFrame, model: Discriminant, text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` without those scored under ``least``; columns stay as they are."""
    name = C.fresh(docs, "score")
    return docs.withColumn(name, score(docs, model, text)).filter(F.col(name) >= least).drop(name)
