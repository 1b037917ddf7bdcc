"""Stratified splits by hashed rank: sizes are exact in each stratum, and the same rows always fall the same way.

Equal keys hash alike and stand together, so copies of a text mostly share a
split. Ranks come from counts of hash bins and ranks inside bins, so that no
stratum, however large, is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from math import isclose

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeum import schema

FRACTIONS = (0.60, 0.15, 0.25)
NAMES = ("train", "val", "test")
BINS = 4096


def check_fractions(fractions: Sequence[float]) -> None:
    if len(fractions) != 3 or not isclose(sum(fractions), 1.0, abs_tol=1e-9) or min(fractions) < 0:
        raise ValueError(f"fractions must be three and sum to 1: {tuple(fractions)}")


def hashed_rank(df: DataFrame, stratum: Sequence[str], key: Column, tie: Sequence[str], bins: int = BINS, known: DataFrame | None = None) -> DataFrame:
    """With ``_rank`` (from 0) of each row in its stratum by md5 of ``key`` and ties, and ``_n``, the stratum's rows.

    ``known`` has a row a stratum, whose other columns come with the rows. Rows
    move once: ranks in bins and the join with their counts share one key.
    """
    stratum = list(stratum)
    hex_ = F.md5(key)
    df = df.withColumn("_h", F.unhex(hex_)).withColumn("_bin", (F.conv(F.substring(hex_, 1, 4), 16, 10).cast("int") * bins / 65536).cast("int"))
    counts = df.groupBy(*stratum, "_bin").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*stratum)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*stratum, "_bin", before.alias("_before"), F.sum("_c").over(w).alias("_n"))
    extra = []
    if known is not None:
        extra = [c for c in known.columns if c not in stratum]
        names = {c: f"_k{i}" for i, c in enumerate(stratum)}
        counts = counts.join(known.withColumnsRenamed(names), reduce(and_, (F.col(c).eqNullSafe(F.col(k)) for c, k in names.items())))
    place = F.struct(*(F.col(c) for c in stratum), F.col("_bin"))  # never null itself; nulls inside are equal
    counts = counts.select(place.alias("_at"), "_before", "_n", *extra)
    ranked = df.withColumn("_at", place).withColumn("_in", F.row_number().over(Window.partitionBy("_at").orderBy("_h", *tie)))
    out = ranked.join(counts, "_at")
    return out.withColumn("_rank", F.col("_before") + F.col("_in") - 1).drop("_h", "_bin", "_before", "_in", "_at")


def _placed(fractions: Sequence[float]) -> Column:
    p = F.col("_rank") / F.col("_n")
    return F.when(p < fractions[0], NAMES[0]).when(p < fractions[0] + fractions[1], NAMES[1]).otherwise(NAMES[2])


def stratified_split(df: DataFrame, stratum: str, key: str, fractions: Sequence[float] = FRACTIONS, seed: int = 0, name: str = "split") -> DataFrame:
    """``df`` with every row in train, val or test, each stratum by the fractions."""
    check_fractions(fractions)
    for c in (stratum, key):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    text = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))
    ranked = hashed_rank(df, [stratum], text, [key])
    return ranked.withColumn(name, _placed(fractions)).drop("_rank", "_n")


def label_stratum(labels: Sequence[str] = schema.LABELS) -> Column:
    """Source and all labels as one string: rows of equal label sets share a stratum."""
    return F.concat_ws("|", F.coalesce("source", F.lit("-")), *(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in labels))


def allocate(strata: Sequence[tuple[Sequence, int]], fractions: Sequence[float] = FRACTIONS) -> list[list[int]]:
    """Rows of each stratum (label values, rows) in each split, so that every value of every label is near its fractions.

    Each stratum first gives every split the whole part of its share. What is
    left, fewer rows a stratum than there are splits, is dealt by iterative
    stratification: the label value with the fewest rows left goes first, each of
    its rows to the split that lacks it most, ties to the split that lacks rows
    most. Then rows change splits, one or two at a time, as long as that brings
    label values nearer that are off by more than one row.
    """
    parts = range(len(fractions))
    marks = [[("", 0), *((i, v) for i, v in enumerate(values))] for values, _ in strata]  # "": any row
    whole = [[int(n * f + 1e-9) for f in fractions] for _, n in strata]
    left = [n - sum(w) for (_, n), w in zip(strata, whole, strict=True)]
    size: dict = {}
    lack: dict = {}
    for (_, n), own, w in zip(strata, marks, whole, strict=True):
        for m in own:
            size[m] = size.get(m, 0) + n
            have = lack.setdefault(m, [0.0] * len(fractions))
            for j in parts:
                have[j] += n * fractions[j] - w[j]
    open_ = {m: sum(k for k, own in zip(left, marks, strict=True) if m in own) for m in size if m[0] != ""}
    while any(left):
        waiting = [m for m, k in open_.items() if k]
        rare = min(waiting, key=lambda m: (open_[m], str(m))) if waiting else ("", 0)
        for s, own in enumerate(marks):
            while left[s] and rare in own:
                j = max(parts, key=lambda j: (round(lack[rare][j], 9), round(lack["", 0][j], 9), -j))
                whole[s][j] += 1
                left[s] -= 1
                for m in own:
                    lack[m][j] -= 1
                    if m in open_:
                        open_[m] -= 1
    names = list(size)
    has = np.array([[m in own for m in names] for own in marks], float)
    return _exchanged(np.array(whole), has, np.array([lack[m] for m in names])).tolist()


def _exchanged(whole: np.ndarray, has: np.ndarray, lack: np.ndarray) -> np.ndarray:
    """``whole`` (strata by splits) after changes of single rows, or of two at a time, that bring the label values nearer to their shares.

    ``has``: strata by label values; ``lack``: rows that each value lacks in each split.
    """
    off = lambda x: np.maximum(0.0, np.abs(x) - 1 + 1e-9) ** 2 + 1e-4 * x * x
    moves = [(i, j) for i in range(whole.shape[1]) for j in range(whole.shape[1]) if i != j]

    def gains() -> np.ndarray:
        """Of a row of each stratum (column) for each move (row)."""
        out = [has @ (off(lack[:, i]) + off(lack[:, j]) - off(lack[:, i] + 1) - off(lack[:, j] - 1)) for i, j in moves]
        return np.array([np.where(whole[:, i] > 0, g, -np.inf) for g, (i, _) in zip(out, moves, strict=True)])

    def move(k: int, s: int, back: int = 1) -> None:
        i, j = moves[k]
        whole[s, i] -= back
        whole[s, j] += back
        lack[:, i] += back * has[s]
        lack[:, j] -= back * has[s]

    while True:
        g = gains()
        k, s = np.unravel_index(np.argmax(g), g.shape)
        if g[k, s] > 1e-9:
            move(k, s)
            continue
        if np.abs(lack).max(initial=0.0) <= 1 + 1e-9:
            return whole
        best = (1e-9, None)
        for k, s in np.argwhere(np.isfinite(g)):
            move(k, s)
            two = gains()
            at = np.unravel_index(np.argmax(two), two.shape)
            if g[k, s] + two[at] > best[0]:
                best = (g[k, s] + two[at], ((k, s), at))
            move(k, s, -1)
        if best[1] is None:
            return whole
        for at in best[1]:
            move(*at)


def balanced_splits(df: DataFrame, labels: Sequence[str] = schema.LABELS, fractions: Sequence[float] = FRACTIONS, seed: int = 0, group: str = "source") -> DataFrame:
    """Rows without split get one, so that in each ``group`` the rows of every label value (positive, negative, missing) fall by the fractions, and small label sets are spread over the splits too; rows with one keep it.

    How many rows of a label set each split takes is decided for a group at a
    time from its counts, 3 to the power of the labels at most (see
    :func:`allocate`); which rows, by hashed rank.
    """
    check_fractions(fractions)
    todo = df.filter(F.col("split").isNull()).withColumn("_s", F.to_json(F.struct(group, *labels)))
    strata = todo.groupBy(group, "_s").agg(*(F.first(x).alias(x) for x in labels), F.count("*").alias("_c"))
    names = list(labels)

    def dealt(rows):
        rows = rows.sort_values("_s")
        values = [tuple(None if v != v else v for v in r) for r in rows[names].astype(float).itertuples(index=False)]
        got = allocate(list(zip(values, rows["_c"].tolist(), strict=True)), fractions)
        rows["_a"], rows["_b"] = [g[0] for g in got], [g[0] + g[1] for g in got]
        return rows[["_s", "_a", "_b"]]

    ends = strata.groupBy(group).applyInPandas(dealt, "_s string, _a bigint, _b bigint")
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(group, F.lit("")), F.coalesce("text", F.lit("")))
    ranked = hashed_rank(todo, ["_s"], key, ["text"], known=ends)
    place = F.when(F.col("_rank") < F.col("_a"), NAMES[0]).when(F.col("_rank") < F.col("_b"), NAMES[1]).otherwise(NAMES[2])
    return df.filter(F.col("split").isNotNull()).unionByName(ranked.withColumn("split", place).select(*df.columns))


def assign_missing_splits(df: DataFrame, fractions: Sequence[float] = FRACTIONS, seed: int = 0) -> DataFrame:
    """Rows without split get one, stratified by source and label set; rows with one keep it.

    A stratum of one or two rows falls to train; see :func:`balanced_splits`.
    """
    check_fractions(fractions)
    todo = df.filter(F.col("split").isNull()).withColumn("_s", label_stratum())
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    ranked = hashed_rank(todo, ["_s"], key, ["text"])
    done = ranked.withColumn("split", _placed(fractions)).select(*df.columns)
    return df.filter(F.col("split").isNotNull()).unionByName(done)


def split_shares(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Counts and shares of each label value inside each split."""
    counts = df.groupBy(split, label).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(split)))
