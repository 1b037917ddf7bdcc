"""Votes of several annotators collapsed to one row an item. Null items are dropped, as votes for nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_by(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, mean): missing scores do not count."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(score).alias("mean"))


def first_non_null(c: str, order: str) -> Column:
    """The value of the first row, in ``order``, that has one."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def collapse(df: DataFrame, key: str, means: tuple[str, ...] = (), firsts: tuple[str, ...] = (), order: str = "ord") -> DataFrame:
    """One row an item: means of scores, and first known values in row order. One partial and one final aggregate."""
    aggs = [F.avg(m).alias(m) for m in means] + [first_non_null(c, order).alias(c) for c in firsts]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each item in ``order``, whole."""
    whole = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(key).agg(F.min_by(whole, F.col(order)).alias("_row")).select("_row.*")


def not_sentinel(c: Column, value) -> Column:
    """False for the sentinel only; missing values stay."""
    return ~c.eqNullSafe(F.lit(value))
