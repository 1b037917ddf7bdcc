"""Command line: load, translate, assign splits, report, save.

    python -m lexeum.job --root data/raw --out data/processed [--corpora a b] [--translate] [--assign-splits]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexeum import schema
from lexeum.dataset import UnifiedDataset
from lexeum.operators import statistics, translation
from lexeum.operators.association import stored
from lexeum.session import ship
from lexeum.sources import readers, sinks


def run(spark: SparkSession, root: str, out: str, corpora: list[str] | None = None, translate: bool = False, assign_splits: bool = False, batch_size: int = 32, device: str | None = None, cache: str | None = None, backend: translation.Backend | None = None) -> str:
    """Returns the path of the table written.

    What several steps read, the loaded rows and the translated ones, is stored
    in the shared folder, and reports on the result read the table written: the
    raw files are read and joined once.
    """
    data = UnifiedDataset(spark, root).load(corpora)
    if translate or assign_splits:
        data.use(stored(data.df, "loaded"))
    translated = None
    if translate:
        chosen = backend or translation.marian_backend(device=device)
        data.translate(translation.Translator(chosen, cache or f"{out.rstrip('/')}/translation_cache", batch_size))
        translated = stored(data.df, "translated")
        translation.status_counts(translated).show()
        data.use(translated.drop(*schema.TRANSLATION_COLUMNS))
    if assign_splits:
        statistics.without_split(data.df, "without_split_before").show()
        data.assign_splits()
    path = sinks.save(data.df, out, translate, assign_splits)
    data.use(spark.read.schema(schema.UNIFIED).parquet(path))
    if assign_splits:
        statistics.without_split(data.df, "without_split_after").show()
    data.label_stats().show(truncate=False)
    data.split_stats().show(1000, truncate=False)
    if translated is not None:
        statistics.gold_silver(translated).show()
    return path


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--root", default="data/raw")
    p.add_argument("--out", default="data/processed")
    p.add_argument("--corpora", nargs="*", default=None)
    p.add_argument("--translate", action="store_true")
    p.add_argument("--assign-splits", action="store_true")
    p.add_argument("--batch-size", type=int, default=32)
    p.add_argument("--device", default=None)
    p.add_argument("--cache", default=None)
    p.add_argument("--single-line", action="store_true", help="no line breaks inside quotes: large files are split among tasks")
    a = p.parse_args(args)
    spark = ship(SparkSession.builder.appName("lexeum").getOrCreate())
    if a.single_line:
        spark.conf.set(readers.MULTILINE, "false")
    print(run(spark, a.root, a.out, a.corpora, a.translate, a.assign_splits, a.batch_size, a.device, a.cache))


if __name__ == "__main__":
    main()
