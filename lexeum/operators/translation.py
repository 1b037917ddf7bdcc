"""Translation of one language's rows by a pluggable backend, in batches, with a cache of content hashes.

The plan: clean and hash, look up the cache, translate each missing text once
(``mapInArrow``, the only Python in it), store the new entries, join back.
The cache grows with the data, so it is joined by hash, and Spark broadcasts
it only if its size allows. New entries go to a folder of their own beside the
old ones, which are never written again: the cache stays linear in the texts,
and jobs that add to it at the same time do not meet. Entries lie in 256 buckets
by the first two digits of their hash: where the cache has more than
``WHOLE_FILES`` files, a job first finds out which buckets its texts are in (256
values at most) and reads only their files.
``compact`` makes one table of many.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeum.functions import text as T
from lexeum.sources import readers as R

#: A factory that is called once in each worker and gives a function from texts to translations.
Backend = Callable[[], Callable[[list[str]], list[str]]]
CACHE = "hash string, translated string"
#: Caches of up to so many files are read whole.
WHOLE_FILES = 256
log = logging.getLogger(__name__)


def _bucket(hash_: Column) -> Column:
    return F.substring(hash_, 1, 2)


def tagging_backend(tag: str = "[de] ") -> Backend:
    """Puts a tag in front: deterministic, for tests and dry runs."""
    return lambda: lambda texts: [tag + t for t in texts]


def marian_backend(model: str = "Helsinki-NLP/opus-mt-en-de", max_length: int = 512, max_new_tokens: int = 128, beams: int = 4, device: str | None = None) -> Backend:
    """A sequence model, loaded in the worker; needs torch and transformers there."""

    def load():
        import torch
        from transformers import AutoModelForSeq2SeqLM, AutoTokenizer

        where = device or default_device()
        tokenizer, net = AutoTokenizer.from_pretrained(model), AutoModelForSeq2SeqLM.from_pretrained(model).to(where).eval()

        def translate(texts: list[str]) -> list[str]:
            batch = tokenizer(texts, return_tensors="pt", padding=True, truncation=True, max_length=max_length).to(where)
            with torch.no_grad():
                out = net.generate(**batch, num_beams=beams, max_new_tokens=max_new_tokens)
            return tokenizer.batch_decode(out, skip_special_tokens=True)

        return translate

    return load


def default_device() -> str:
    try:
        import torch
    except ImportError:
        return "cpu"
    if torch.cuda.is_available():
        return "cuda"
    return "mps" if torch.backends.mps.is_available() else "cpu"


def in_batches(call: Callable[[list[str]], list[str]], texts: list[str], size: int) -> list[str | None]:
    """Batch by batch; a batch that fails is tried text by text; a text that fails is None."""
    out: list[str | None] = []
    for i in range(0, len(texts), size):
        part = texts[i : i + size]
        try:
            got: list[str | None] = list(call(part))
            if len(got) != len(part):
                raise ValueError("the backend lost texts")
        except Exception as e:  # noqa: BLE001  any failure of a model
            log.error("texts %d to %d of a batch failed (%s); trying them one by one", i, i + len(part) - 1, e)
            got = []
            for t in part:
                try:
                    got.append(call([t])[0])
                except Exception as one:  # noqa: BLE001
                    log.error("a text failed (%s) and stays as it is", one)
                    got.append(None)
        out += got
    return out


@dataclass
class Translator:
    """Rows in ``source_lang`` are translated to ``target_lang``; all others stay as they are."""

    backend: Backend
    cache_path: str | None = None
    batch_size: int = 32
    source_lang: str = "en"
    target_lang: str = "de"

    def cache(self, spark: SparkSession, hashes: DataFrame | None = None) -> DataFrame:
        """The entries, one a hash; empty where there is no cache or it cannot be read. With ``hashes`` at least those whose hash it has."""
        if not self.cache_path:
            return spark.createDataFrame([], CACHE)
        found = self._files(spark, hashes)
        if found is None:
            found = R.read_parquet_or_empty(spark, self.cache_path, CACHE)
        return found.filter(F.col("hash").isNotNull()).dropDuplicates(["hash"])

    def _files(self, spark: SparkSession, hashes: DataFrame | None) -> DataFrame | None:
        """What the buckets of ``hashes`` hold, and files that are in none; null where the whole cache is to be read."""
        root = self.cache_path.rstrip("/")
        if hashes is None or len(R.list_files(spark, f"{root}/added-*/bucket=*/*.parquet")) <= WHOLE_FILES:
            return None
        wanted = {r[0] for r in hashes.select(_bucket(F.col("hash"))).distinct().collect()}
        paths = [p for p in R.list_files(spark, f"{root}/added-*/bucket=*") if p.rsplit("=", 1)[1] in wanted]
        paths += R.list_files(spark, f"{root}/*.parquet") + R.list_files(spark, f"{root}/added-*/*.parquet")
        return spark.read.schema(CACHE).parquet(*paths) if paths else spark.createDataFrame([], CACHE)

    def _add(self, entries: DataFrame) -> str:
        """Write entries to a folder of their own, in buckets; its path."""
        path = f"{self.cache_path.rstrip('/')}/added-{uuid.uuid4().hex}"
        rows = entries.select("hash", "translated", _bucket(F.col("hash")).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "hash")
        rows.write.partitionBy("bucket").parquet(path)
        return path

    def compact(self, spark: SparkSession) -> None:
        """The cache as one table instead of one for each job. No other job may add to it meanwhile."""
        old = R.list_files(spark, f"{self.cache_path.rstrip('/')}/added-*")
        if len(old) > 1:
            self._add(self.cache(spark))
            for path in old:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    def _missing(self, spark: SparkSession, marked: DataFrame, cache: DataFrame) -> DataFrame:
        todo = marked.filter(F.col("_eligible") & (F.col("_clean") != "")).select(F.col("_hash").alias("hash"), F.col("_clean").alias("clean")).dropDuplicates(["hash"]).join(cache, "hash", "left_anti")
        backend, size = self.backend, self.batch_size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            call, step = None, size * 16  # rows that are Python strings at a time
            for b in (x.slice(at, step) for x in batches for at in range(0, x.num_rows, step)):
                call = call or backend()
                got = in_batches(call, b.column("clean").to_pylist(), size)
                yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array(got, pa.string())], names=["hash", "translated"])

        return todo.select("hash", "clean").mapInArrow(run, CACHE)

    @staticmethod
    def _asked(marked: DataFrame) -> DataFrame:
        """The hashes of the texts to translate."""
        return marked.filter(F.col("_eligible") & (F.col("_clean") != "")).select(F.col("_hash").alias("hash"))

    def mark(self, df: DataFrame) -> DataFrame:
        """With the helper columns: eligible, cleaned text, hash."""
        if missing := sorted({"text", "language"} - set(df.columns)):
            raise ValueError(f"missing columns: {missing}")
        clean = T.cleaned(F.col("text"))
        return df.withColumn("_eligible", F.coalesce(F.col("language") == self.source_lang, F.lit(False))).withColumn("_clean", clean).withColumn("_hash", T.content_hash(F.col("_clean")))

    def translate(self, df: DataFrame) -> DataFrame:
        """``df`` with translated texts and text_original, is_translated, translation_status."""
        spark = df.sparkSession
        marked = self.mark(df)
        cache = self.cache(spark, self._asked(marked))
        fresh = self._missing(spark, marked, cache)
        if self.cache_path:  # write before the join, so that no text is translated twice
            path = self._add(fresh.filter(F.col("translated").isNotNull()))
            known = cache.unionByName(spark.read.schema(CACHE).option("recursiveFileLookup", True).parquet(path))
        else:
            known = cache.unionByName(fresh)
        marked = marked.withColumn("_empty", F.col("_clean") == "").drop("_clean")  # cleaned texts need not move
        out = marked.join(known.filter(F.col("translated").isNotNull()).select(F.col("hash").alias("_hash"), "translated"), "_hash", "left")
        empty = F.col("_empty")
        done = F.col("_eligible") & ~empty & F.col("translated").isNotNull()
        status = F.when(~F.col("_eligible"), "not_applicable").when(empty, "empty").when(done, "success").otherwise("failed")
        new = {
            "text": F.when(done, F.col("translated")).otherwise(F.col("text")),
            "language": F.when(done, self.target_lang).otherwise(F.col("language")),
        }
        keep = [new[c].alias(c) if c in new else F.col(c) for c in df.columns if c not in ("text_original", "is_translated", "translation_status")]
        return out.select(*keep, F.when(F.col("_eligible"), T.filled(F.col("text"))).alias("text_original"), done.alias("is_translated"), status.alias("translation_status"))

    def metrics(self, df: DataFrame) -> DataFrame:
        """Rows: eligible, empty, in the cache, and not."""
        m = self.mark(df).filter("_eligible")
        m = m.join(self.cache(df.sparkSession, self._asked(m)).select(F.col("hash").alias("_hash"), F.lit(True).alias("_hit")), "_hash", "left")
        some, hit = F.col("_clean") != "", F.coalesce("_hit", F.lit(False))
        return m.agg(F.count("*").alias("eligible"), F.count_if(~some).alias("empty"), F.count_if(some & hit).alias("hits"), F.count_if(some & ~hit).alias("misses"))


def status_counts(df: DataFrame) -> DataFrame:
    s = F.col("translation_status")
    return df.agg(*(F.count_if(s == x).alias(x) for x in ("success", "failed", "empty", "not_applicable")))
