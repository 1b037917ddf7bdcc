"""The unified dataset: a selection of corpora, and what one asks of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeum.operators import splits, statistics
from lexeum.operators.translation import Translator
from lexeum.sources import corpora


class UnifiedDataset:
    """Lazy: nothing is read before a result is."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._df: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise RuntimeError("load a dataset first")
        return self._df

    def load(self, names: list[str] | None = None) -> UnifiedDataset:
        """All corpora in registry order, or those named, each once, in the order given."""
        names = list(corpora.REGISTRY) if names is None else list(dict.fromkeys(names))
        if unknown := sorted(set(names) - set(corpora.REGISTRY)):
            raise ValueError(f"unknown corpora: {unknown}; known: {list(corpora.REGISTRY)}")
        if not names:
            raise ValueError("no corpora to load")
        self._df = reduce(DataFrame.unionByName, [corpora.REGISTRY[n](self.spark, self.root) for n in names])
        return self

    def use(self, df: DataFrame) -> UnifiedDataset:
        self._df = df
        return self

    def get_split(self, split: str) -> DataFrame:
        return self.df.filter(F.col("split") == split)

    def get_corpus(self, source: str) -> DataFrame:
        return self.df.filter(F.col("source") == source)

    def label_stats(self) -> DataFrame:
        return statistics.label_stats(self.df)

    def split_stats(self) -> DataFrame:
        """Sorted, missing names last."""
        return statistics.split_stats(self.df).orderBy(F.asc_nulls_last("source"), F.asc_nulls_last("split"))

    def translate(self, translator: Translator) -> UnifiedDataset:
        return self.use(translator.translate(self.df))

    def assign_splits(self, seed: int = 0) -> UnifiedDataset:
        return self.use(splits.balanced_splits(self.df, seed=seed))

    def register_view(self, name: str = "unified") -> None:
        """For ``spark.sql``."""
        self.df.createOrReplaceTempView(name)
