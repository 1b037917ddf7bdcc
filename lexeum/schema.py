"""The unified schema: one row a text, five labels that are 1.0, 0.0 or null for not annotated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

# Label names, corpora and what each annotates.
LABELS = ("hate_speech", "toxic", "threat", "insult", "impolite")
CORPUS_LABELS = {
    "gmhp7k": ("hate_speech",),
    "hocon34k": ("hate_speech",),
    "detox": ("toxic",),
    "jigsaw": ("hate_speech", "toxic", "threat", "insult"),
    "wikipedia_attacks": ("insult",),
    "wikipedia_politeness": ("impolite",),
    "gutefrage": ("hate_speech", "insult", "toxic"),
}
COLUMNS = ("text", "source", "language", "split", *LABELS)
UNIFIED = StructType([StructField(c, DoubleType() if c in LABELS else StringType()) for c in COLUMNS])
TRANSLATION_COLUMNS = ("text_original", "is_translated", "translation_status")
TRANSLATED = StructType([*UNIFIED.fields, StructField("text_original", StringType()), StructField("is_translated", BooleanType()), StructField("translation_status", StringType())])


def unify(df: DataFrame, *, text: Column, source: str | Column, language: str | Column, split: Column | None = None, labels: dict[str, Column] | None = None) -> DataFrame:
    """Project ``df`` to the unified columns; labels that are not given are null."""
    labels = labels or {}
    if unknown := set(labels) - set(LABELS):
        raise ValueError(f"unknown labels: {sorted(unknown)}")
    fixed = lambda v: F.lit(v) if isinstance(v, str) else v
    cols = [text.cast("string").alias("text"), fixed(source).alias("source"), fixed(language).alias("language"), (F.lit(None) if split is None else split).cast("string").alias("split")]
    return df.select(*cols, *(labels.get(name, F.lit(None)).cast("double").alias(name) for name in LABELS))


def check_columns(df: DataFrame) -> DataFrame:
    if tuple(df.columns) != COLUMNS:
        raise ValueError(f"expected the columns {list(COLUMNS)}, got {df.columns}")
    return df


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A unified frame of row dictionaries; what they leave out is null."""
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], UNIFIED)


def catalog(spark: SparkSession) -> DataFrame:
    """(corpus, label) for each label that a corpus annotates."""
    return spark.createDataFrame([(c, x) for c, names in CORPUS_LABELS.items() for x in names], "corpus string, label string")
