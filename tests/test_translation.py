"""Translation: statuses, cache, failures, streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexeum import job, schema
from lexeum.operators import translation as X

ROWS = [
    {"text": "hello <b>world</b>", "source": "detox", "language": "en", "toxic": 0.0},
    {"text": "hallo", "source": "gmhp7k", "language": "de", "hate_speech": 1.0},
    {"text": "  ", "source": "detox", "language": "en"},
    {"text": None, "source": "detox", "language": "en"},
    {"text": "bad", "source": "detox", "language": "en"},
    {"text": "x", "source": "jigsaw", "language": "multilingual"},
    {"text": "y", "source": "other", "language": None},
]


def failing():
    def call(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return ["[de] " + t for t in texts]

    return call


def frame(spark):
    return schema.from_rows(spark, ROWS)


def test_statuses(spark):
    got = X.Translator(lambda: failing()).translate(frame(spark))
    assert got.columns == [*schema.COLUMNS, *schema.TRANSLATION_COLUMNS]
    by = {(r.text_original, r.text, r.language): (r.is_translated, r.translation_status) for r in got.collect()}
    assert by == {
        ("hello <b>world</b>", "[de] hello world", "de"): (True, "success"),
        (None, "hallo", "de"): (False, "not_applicable"),
        ("  ", "  ", "en"): (False, "empty"),
        ("", None, "en"): (False, "empty"),
        ("bad", "bad", "en"): (False, "failed"),
        (None, "x", "multilingual"): (False, "not_applicable"),
        (None, "y", None): (False, "not_applicable"),
    }
    assert X.status_counts(got).first().asDict() == {"success": 1, "failed": 1, "empty": 2, "not_applicable": 3}
    assert {r.source: r.hate_speech for r in got.collect()}["gmhp7k"] == 1.0


def test_missing_columns(spark):
    with pytest.raises(ValueError, match=r"\['language', 'text'\]"):
        X.Translator(X.tagging_backend()).translate(spark.range(1))


def test_cache_is_used_and_grows(spark, tmp_path):
    path = str(tmp_path / "cache")
    t = X.Translator(lambda: failing(), path)
    first = t.translate(frame(spark)).collect()
    assert t.cache(spark).count() == 1
    never = X.Translator(lambda: 1 / 0, path)
    assert t.metrics(frame(spark)).first().asDict() == {"eligible": 4, "empty": 2, "hits": 1, "misses": 1}
    known = frame(spark).filter(~F.coalesce(F.col("text"), F.lit("")).eqNullSafe("bad"))
    again = never.translate(known).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in first if r.text != "bad")


def test_batches_retry_one_by_one():
    seen = []

    def call(texts):
        seen.append(list(texts))
        return failing()(texts)

    assert X.in_batches(call, ["a", "bad", "c", "d"], 2) == ["[de] a", None, "[de] c", "[de] d"]
    assert seen == [["a", "bad"], ["a"], ["bad"], ["c", "d"]]
    assert X.in_batches(lambda t: t[:-1], ["a"], 2) == [None]
    assert X.default_device() in ("cpu", "cuda", "mps")


def test_equal_texts_are_translated_once(spark, tmp_path):
    twice = schema.from_rows(spark, [ROWS[0]] * 5)
    t = X.Translator(X.tagging_backend(), str(tmp_path / "c"))
    assert t.translate(twice).count() == 5 and t.cache(spark).count() == 1


def test_a_job_reads_only_the_buckets_of_its_texts(spark, tmp_path, monkeypatch):
    """Forty jobs of sixty texts, two entries beside the buckets; then three texts, one of them new."""
    monkeypatch.setattr(X, "WHOLE_FILES", 100)
    path = str(tmp_path / "cache")
    t = X.Translator(X.tagging_backend(), path)
    said = lambda k: spark.createDataFrame([(f"text {k} {i}", "en") for i in range(60)], "text string, language string")
    for k in range(40):
        t._add(t.mark(said(k)).select(F.col("_hash").alias("hash"), F.concat(F.lit("old "), "text").alias("translated")))
    spark.createDataFrame([("0" * 32, "a"), ("f" * 32, "b")], X.CACHE).write.mode("append").parquet(path)
    df = spark.createDataFrame([("text 3 5", "en"), ("text 39 59", "en"), ("a new text", "en"), ("stays", "de")], "text string, language string")
    found = t.cache(spark, t._asked(t.mark(df)))
    every, read = len(list(tmp_path.glob("cache/**/*.parquet"))), found.inputFiles()
    wanted = {hashlib.md5(x.encode()).hexdigest()[:2] for x in ("text 3 5", "text 39 59", "a new text")}
    assert {f.split("bucket=")[1][:2] for f in read if "bucket=" in f} <= wanted and len(read) < 0.05 * every
    assert sorted(r.text for r in t.translate(df).collect()) == ["[de] a new text", "old text 3 5", "old text 39 59", "stays"]
    assert t.cache(spark).count() == 40 * 60 + 3
    t.compact(spark)
    assert t.cache(spark).count() == 40 * 60 + 3 and {r.text for r in t.translate(df).collect()} == {"[de] a new text", "old text 3 5", "old text 39 59", "stays"}
    assert t.metrics(df).first().hits == 3


def test_cache_grows_by_what_is_new(spark, tmp_path):
    path = str(tmp_path / "cache")
    t = X.Translator(X.tagging_backend(), path)
    for k in range(3):
        t.translate(schema.from_rows(spark, [{"text": f"text {i}", "source": "s", "language": "en"} for i in range(2 * k + 2)])).count()
    parts = sorted(tmp_path.glob("cache/added-*"))
    assert len(parts) == 3 and sum(spark.read.parquet(str(p)).count() for p in parts) == 6 == t.cache(spark).count()
    t.compact(spark)
    assert len(list(tmp_path.glob("cache/added-*"))) == 1 and t.cache(spark).count() == 6
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.parquet").write_text("no table")
    assert X.Translator(X.tagging_backend(), str(tmp_path / "bad")).cache(spark).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "odd"))
    assert X.Translator(X.tagging_backend(), str(tmp_path / "odd")).cache(spark).count() == 0


def test_failures_are_logged(caplog):
    X.in_batches(failing(), ["a", "bad"], 2)
    assert [r.levelname for r in caplog.records] == ["ERROR", "ERROR"] and "one by one" in caplog.text


def test_model_is_loaded_once_and_called_with_its_limits(monkeypatch):
    """The model's backend with stand-ins for its libraries."""
    import contextlib
    import sys
    from types import ModuleType, SimpleNamespace

    calls = []

    class Batch(dict):
        def to(self, where):
            calls.append(("to", where))
            return self

    class Tokenizer:
        def __call__(self, texts, **options):
            calls.append(("tokens", options["max_length"], options["truncation"], options["padding"]))
            return Batch(input_ids=[t.upper() for t in texts])

        def batch_decode(self, ids, skip_special_tokens):
            assert skip_special_tokens
            return ids

    class Net:
        def to(self, where):
            return self

        def eval(self):
            return self

        def generate(self, input_ids, num_beams, max_new_tokens):
            calls.append(("generate", num_beams, max_new_tokens))
            return input_ids

    torch, transformers = ModuleType("torch"), ModuleType("transformers")
    torch.cuda = SimpleNamespace(is_available=lambda: False)
    torch.backends = SimpleNamespace(mps=SimpleNamespace(is_available=lambda: True))
    torch.no_grad = contextlib.nullcontext
    made = []
    transformers.AutoTokenizer = SimpleNamespace(from_pretrained=lambda m: made.append(m) or Tokenizer())
    transformers.AutoModelForSeq2SeqLM = SimpleNamespace(from_pretrained=lambda m: made.append(m) or Net())
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "transformers", transformers)
    assert X.default_device() == "mps"
    call = X.marian_backend(device=None)()
    assert made == ["Helsinki-NLP/opus-mt-en-de"] * 2
    assert X.in_batches(call, ["a", "b", "c"], 2) == ["A", "B", "C"] and len(made) == 2
    assert calls[:3] == [("tokens", 512, True, True), ("to", "mps"), ("generate", 4, 128)]
    torch.cuda = SimpleNamespace(is_available=lambda: True)
    assert X.default_device() == "cuda"


def test_other_direction(spark):
    t = X.Translator(X.tagging_backend("[en] "), source_lang="de", target_lang="en")
    got = {r.source: r.text for r in t.translate(frame(spark)).filter("is_translated").collect()}
    assert got == {"gmhp7k": "[en] hallo"}


def test_job_end_to_end(spark, tmp_path):
    base = tmp_path / "raw/wikipedia_attacks"
    base.mkdir(parents=True)
    (base / "attack_annotated_comments.csv").write_text("rev_id,comment\n" + "".join(f"{i},text {i}\n" for i in range(20)))
    (base / "attack_annotations.csv").write_text("rev_id,worker_id,attack\n" + "".join(f"{i},1,{i % 2}\n" for i in range(20)))
    path = job.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"), ["wikipedia_attacks"], translate=True, assign_splits=True, backend=X.tagging_backend())
    out = spark.read.parquet(path)
    assert path.endswith("unified_translated_with_splits.parquet") and tuple(out.columns) == schema.COLUMNS
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 12, "val": 4, "test": 4} or out.filter("split is null").count() == 0
    assert out.filter("language = 'de' and text like '[de] %'").count() == 20


def test_job_reads_raw_files_once(spark, tmp_path, monkeypatch):
    """However many steps and reports there are, a row is loaded once."""
    from lexeum.sources import corpora

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def loader(spark_, root):
        rows = spark_.range(0, 40, 1, 2).select(F.concat(F.lit("text "), "id").alias("t")).mapInArrow(counted, "t string")
        return schema.unify(rows, text=F.col("t"), source="own", language="en", labels={"toxic": F.lit(1.0)})

    monkeypatch.setitem(corpora.REGISTRY, "own", loader)
    path = job.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"), ["own"], translate=True, assign_splits=True, backend=X.tagging_backend())
    assert spark.read.parquet(path).filter("split is not null and text like '[de] %'").count() == 40
    assert seen.value == 40


def test_streams(spark, tmp_path):
    from lexeum.streaming import flow

    frame(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema.UNIFIED).parquet(str(tmp_path / "in"))
    q = flow.translate_stream(stream, X.Translator(X.tagging_backend()), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("is_translated").count() == 2
    timed = frame(spark).withColumn("ts", F.timestamp_seconds(F.monotonically_increasing_id() % 2 * 7200))
    timed.write.parquet(str(tmp_path / "timed"))
    s = flow.label_counts(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "timed")), "ts", "toxic")
    q = s.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("total")).first()[0] == 1
