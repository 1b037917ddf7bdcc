"""Loaders over small files, from raw columns to the unified schema."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexeum import schema
from lexeum.dataset import UnifiedDataset
from lexeum.plans import files
from lexeum.session import with_conf
from lexeum.sources import corpora, quoted, readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(r["text"]))


# ------------------------------------------------------------------ schema


def test_labels_and_columns():
    assert schema.LABELS == ("hate_speech", "toxic", "threat", "insult", "impolite")
    assert schema.COLUMNS[:4] == ("text", "source", "language", "split") and len(schema.COLUMNS) == 9
    gone = set(corpora.JIGSAW_FLAGS) - set(schema.LABELS)  # raw names that become others or go
    assert gone and gone < set(corpora.JIGSAW_FLAGS) and not gone & {x for names in schema.CORPUS_LABELS.values() for x in names}
    assert len(corpora.REGISTRY) == 7 and list(corpora.REGISTRY) == list(schema.CORPUS_LABELS)
    assert all(set(v) <= set(schema.LABELS) for v in schema.CORPUS_LABELS.values())


def test_unify_rejects_unknown_labels(spark):
    df = schema.from_rows(spark, [{"text": "a"}])
    with pytest.raises(ValueError, match="misogyny"):
        schema.unify(df, text=df.text, source="x", language="de", labels={"misogyny": df.toxic})
    assert schema.catalog(spark).count() == sum(map(len, schema.CORPUS_LABELS.values()))


# ------------------------------------------------------------------ gmhp7k


@pytest.mark.parametrize("hs,m_hs,want", [(0, 1, 1.0), (1, 1, 1.0), (1, 0, 1.0), (0, 0, 0.0)])
def test_gmhp7k_either_kind(spark, tmp_path, hs, m_hs, want):
    write(tmp_path / "corpus-gmhp7k/datasets/misogynistic_hatespeech_phase1.csv", f"tweet_id,review_text,hs,m_hs\n1,text,{hs},{m_hs}\n")
    (r,) = rows(corpora.gmhp7k(spark, str(tmp_path)))
    assert r["hate_speech"] == want and r["split"] is None and r["language"] == "de" and r["toxic"] is None


def test_gmhp7k_phases(spark, tmp_path):
    base = tmp_path / "corpus-gmhp7k/datasets"
    write(base / "misogynistic_hatespeech_phase1.csv", 'tweet_id,review_text,hs,m_hs\n1,"first, ""quoted""\nline",1,0\n1,other,0,0\n2,,0,0\nabc,c,,\n')
    write(base / "misogynistic_hatespeech_phase3.csv", "tweet_id,review_text,hs,m_hs,split_hs\n2,late,0,0,\n2,later,0,0,test\n1,third,0,0,train\n,lost,1,1,train\n")
    got = {r["text"]: (r["hate_speech"], r["split"]) for r in rows(corpora.gmhp7k(spark, str(tmp_path)))}
    assert got == {'first, "quoted"\nline': (0.0, "train"), "late": (0.0, "test"), "c": (0.0, None)}
    with pytest.raises(FileNotFoundError):
        corpora.gmhp7k(spark, str(tmp_path / "none"))


# ------------------------------------------------------------------ hocon34k


def test_hocon34k(spark, tmp_path):
    write(tmp_path / "hocon34k/corpus-hocon34k/datasets/hatespeech_hocon34k.csv", "post_id,annotator_id,text,label_hs,split_all\n1,48,,1,  \n1,54,body,0,train\n2,48,two,0,\n2,54,two,0,\n,1,lost,1,test\n")
    got = {r["text"]: (r["hate_speech"], r["split"]) for r in rows(corpora.hocon34k(spark, str(tmp_path)))}
    assert got == {"body": (1.0, None), "two": (0.0, None)}


# ------------------------------------------------------------------ detox, attacks


@pytest.mark.parametrize("swapped", [False, True])
def test_detox_finds_the_comments(spark, tmp_path, swapped):
    comments = "rev_id\tcomment\tsplit\n1\taNEWLINE_TOKENNEWLINE_TOKENb\ttrain\n2\tunrated\ttest\n"
    marks = "rev_id\ttoxicity\n1\t1\n1\t0\n3\t1\n"
    one, two = (marks, comments) if swapped else (comments, marks)
    write(tmp_path / "detox/toxicity_comments.tsv", one)
    write(tmp_path / "detox/toxicity_annotations.tsv", two)
    (r,) = rows(corpora.detox(spark, str(tmp_path)))
    assert (r["text"], r["toxic"], r["split"], r["source"], r["language"]) == ("a\n\nb", 1.0, "train", "detox", "en")


@pytest.mark.parametrize("votes,want", [((1, 1), 1.0), ((0, 0), 0.0)])
def test_attacks_become_insult(spark, tmp_path, votes, want):
    write(tmp_path / "wikipedia_attacks/attack_annotated_comments.csv", "rev_id,comment\n1.0,some text\n")
    write(tmp_path / "wikipedia_attacks/attack_annotations.csv", "rev_id,worker_id,attack\n" + "".join(f"1,{i},{v}\n" for i, v in enumerate(votes)))
    df = corpora.wikipedia_attacks(spark, str(tmp_path))
    (r,) = rows(df)
    assert tuple(df.columns) == schema.COLUMNS and r["insult"] == want and r["split"] is None


# ------------------------------------------------------------------ jigsaw

FLAGS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")


def jigsaw(tmp_path, train, test=()):
    write(tmp_path / "jigsaw/train.csv", "comment_text," + ",".join(FLAGS) + "\n" + "".join(f"t{i}," + ",".join(str(r.get(f, 0)) for f in FLAGS) + "\n" for i, r in enumerate(train)))
    write(tmp_path / "jigsaw/test.csv", "id,comment_text\n" + "".join(f"{i},x{i}\n" for i, _ in enumerate(test)))
    write(tmp_path / "jigsaw/test_labels.csv", "id," + ",".join(FLAGS) + "\n" + "".join(f"{i}," + ",".join(str(r.get(f, 0)) for f in FLAGS) + "\n" for i, r in enumerate(test)))


@pytest.mark.parametrize("flag,label", [("identity_hate", "hate_speech"), ("toxic", "toxic"), ("severe_toxic", "toxic"), ("threat", "threat"), ("insult", "insult"), ("obscene", None)])
def test_jigsaw_flags(spark, tmp_path, flag, label):
    jigsaw(tmp_path, [{flag: 1}])
    (r,) = rows(corpora.jigsaw(spark, str(tmp_path)))
    assert {x: r[x] for x in schema.LABELS} == {x: None if x == "impolite" else float(x == label) for x in schema.LABELS}
    assert r["split"] == "train" and r["language"] == "multilingual"


def test_jigsaw_test_rows(spark, tmp_path):
    jigsaw(tmp_path, [{}], [dict.fromkeys(FLAGS, -1), {"toxic": ""}, {"severe_toxic": 1}])
    got = {r["text"]: (r["toxic"], r["split"]) for r in rows(corpora.jigsaw(spark, str(tmp_path)))}
    assert got == {"t0": (0.0, "train"), "x1": (1.0, "test"), "x2": (1.0, "test")}


# ------------------------------------------------------------------ politeness


def test_politeness(spark, tmp_path):
    lines = [{"text": "a", "meta": {"Binary": 1}}, {"text": "b", "meta": {"Binary": -1}}, {"text": "c", "meta": {"Binary": 0}}, {"text": "d", "meta": {}}, {"text": "e"}]
    path = tmp_path / "politeness/wikipedia-politeness-corpus/utterances.jsonl"
    write(path, "\n".join(map(json.dumps, lines)))
    assert [r["impolite"] for r in rows(corpora.wikipedia_politeness(spark, str(tmp_path)))] == [0.0, 1.0, None, None, None]
    write(path, '{"meta": {"Binary": 1}}')
    with pytest.raises(Exception, match="no text"):
        corpora.wikipedia_politeness(spark, str(tmp_path)).collect()


# ------------------------------------------------------------------ gutefrage

HATE, ATTACK, INSULT, HOSTILE = corpora.REASON_LABELS
#: The columns that the loader reads.
READ = sorted({"body", "question_title", *(f"{x}_{y}" for x, y in (("moderation", "state"), ("deletion", "reason"), ("notice", "reason")))})


def moderated(spark, **known):
    """One raw row of the fields that a test is about; all others are null."""
    return corpora.moderated(spark.createDataFrame([{"body": "said", **known}], ", ".join(f"{c} string" for c in READ)))


@pytest.mark.parametrize("field", ["deletion_reason", "notice_reason"])
@pytest.mark.parametrize("reason,want", [(HATE, (1.0, 0.0, 1.0)), (ATTACK, (0.0, 1.0, 1.0)), (INSULT, (0.0, 1.0, 1.0)), (HOSTILE, (0.0, 0.0, 1.0)), *((r, (0.0, 0.0, 0.0)) for r in corpora.UNMAPPED_REASONS), (None, (0.0, 0.0, 0.0)), (f" {INSULT} ", (0.0, 1.0, 1.0))])
def test_reasons(spark, field, reason, want):
    (r,) = rows(moderated(spark, **{field: reason}))
    assert (r["hate_speech"], r["insult"], r["toxic"]) == want and r["threat"] is None and r["impolite"] is None


def test_both_reasons_and_state(spark):
    (r,) = rows(moderated(spark, deletion_reason=HATE, notice_reason=INSULT))
    assert (r["hate_speech"], r["insult"], r["toxic"]) == (1.0, 1.0, 1.0)
    for state in ("Rejected", "Rejected (Final)", "Accepted"):
        (r,) = rows(moderated(spark, moderation_state=state))
        assert (r["toxic"], r["moderation_state_raw"], r["deletion_reason_raw"], r["notice_reason_raw"]) == (0.0, state, "", "")


@pytest.mark.parametrize("body", [None, "None", "<NA>", "   ", "nan"])
def test_title_stands_in(spark, body):
    assert [r["text"] for r in rows(moderated(spark, body=body, question_title=" title "))] == ["title"]
    assert rows(moderated(spark, body=body)) == []


def test_gutefrage_from_an_export(spark, tmp_path):
    write(tmp_path / "gutefrage.net/dataset/datensatz_moderiert.csv", f"notice_reason,other,body,moderation_state,deletion_reason,question_title\n,x,said,Accepted,{INSULT},\n")
    assert tuple(corpora.gutefrage(spark, str(tmp_path)).columns) == schema.COLUMNS
    wide = corpora.gutefrage_with_provenance(spark, str(tmp_path))
    assert len(wide.columns) == 12 and wide.first().insult == 1.0
    with pytest.raises(FileNotFoundError):
        corpora.gutefrage(spark, str(tmp_path / "none"))


# ------------------------------------------------------------------ dataset, sinks, readers


def tiny(spark, tmp_path):
    jigsaw(tmp_path, [{"toxic": 1}, {}], [{"insult": 1}])
    write(tmp_path / "wikipedia_attacks/attack_annotated_comments.csv", "rev_id,comment\n1,some text\n")
    write(tmp_path / "wikipedia_attacks/attack_annotations.csv", "rev_id,worker_id,attack\n1,1,1\n")
    return UnifiedDataset(spark, str(tmp_path))


def test_dataset(spark, tmp_path):
    data = tiny(spark, tmp_path)
    with pytest.raises(RuntimeError):
        data.df  # noqa: B018
    with pytest.raises(ValueError, match="nowhere"):
        data.load(["jigsaw", "nowhere"])
    with pytest.raises(ValueError):
        data.load([])
    data.load(["wikipedia_attacks", "jigsaw", "jigsaw"])
    assert data.df.count() == 4 and data.get_split("test").count() == 1
    assert data.get_corpus("jigsaw").count() == 3 and data.get_corpus("none").count() == 0
    stats = {r.label: (r.corpora, r.total, r.positive, r.negative, r.pos_rate) for r in data.label_stats().collect()}
    assert stats["insult"] == ("jigsaw, wikipedia_attacks, gutefrage", 4, 2, 2, 0.5)
    assert stats["impolite"] == ("wikipedia_politeness", 0, 0, 0, None)
    assert [(r.source, r.split, r["count"]) for r in data.split_stats().collect()] == [("jigsaw", "test", 1), ("jigsaw", "train", 2), ("wikipedia_attacks", None, 1)]
    data.register_view("tiny")
    assert spark.sql("select count(*) from tiny where toxic = 1").first()[0] == 1


def test_own_corpus(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpora, "REGISTRY", dict(corpora.REGISTRY))
    monkeypatch.setattr(schema, "CORPUS_LABELS", dict(schema.CORPUS_LABELS))
    corpora.register_corpus("mine", lambda s, root: schema.from_rows(s, [{"text": "a", "source": "mine", "toxic": 1.0}]), ("toxic",))
    assert UnifiedDataset(spark, str(tmp_path)).load(["mine"]).df.count() == 1
    with pytest.raises(ValueError):
        corpora.register_corpus("bad", None, ("nope",))


@pytest.mark.parametrize("t,s,name", [(False, False, "unified"), (True, False, "unified_translated"), (False, True, "unified_with_splits"), (True, True, "unified_translated_with_splits")])
def test_output_name(t, s, name):
    assert sinks.output_name(t, s) == name + ".parquet"


def test_save_checks_columns_first(spark, tmp_path):
    df = schema.from_rows(spark, [{"text": "a", "toxic": 1.0}])
    from pyspark.sql import functions as F

    path = sinks.save(df.withColumn("is_translated", F.lit(False)), str(tmp_path / "out"))
    assert tuple(spark.read.parquet(path).columns) == schema.COLUMNS
    with pytest.raises(ValueError):
        sinks.save(df.drop("split"), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    sinks.save_report(df.select("text"), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).first().text == "a"


def test_words_and_broken_cache(spark, tmp_path):
    write(tmp_path / "stop.txt", "und\nder\nund\n\n")
    assert sorted(r.word for r in readers.read_words(spark, str(tmp_path / "stop.txt")).collect()) == ["der", "und"]
    assert readers.read_parquet_or_empty(spark, str(tmp_path / "none"), "hash string").count() == 0
    spark.range(1).write.parquet(str(tmp_path / "odd"))
    assert readers.read_parquet_or_empty(spark, str(tmp_path / "odd"), "hash string").count() == 0


# ------------------------------------------------------------------ readers and sinks


def test_sheet_through_its_parser(spark, monkeypatch):
    import sys
    from types import ModuleType, SimpleNamespace

    cell = lambda v: SimpleNamespace(value=v)
    grid = [["body", "n"], ["a", 1.0], [None, 2.0]]
    parser = ModuleType("numbers_parser")
    parser.Document = lambda path: SimpleNamespace(sheets=[SimpleNamespace(tables=[SimpleNamespace(iter_rows=lambda: [[cell(v) for v in r] for r in grid])])])
    monkeypatch.setitem(sys.modules, "numbers_parser", parser)
    assert [tuple(r) for r in readers.sheet(spark, "x.numbers").collect()] == [("a", "1.0"), (None, "2.0")]


def test_files_without_line_breaks_are_split(spark, tmp_path):
    write(tmp_path / "big.csv", "a,b\n" + "".join(f"{i},x{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert readers.read_csv(spark, str(tmp_path / "big.csv")).rdd.getNumPartitions() == 1
        spark.conf.set(readers.MULTILINE, "false")
        split = readers.read_csv(spark, str(tmp_path / "big.csv"), {"a": "long"})
        assert split.rdd.getNumPartitions() > 1 and split.count() == 20_000 and split.agg({"a": "max"}).first()[0] == 19_999
    finally:
        spark.conf.unset(readers.MULTILINE)
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_other_errors_than_a_missing_cache_are_raised(spark, tmp_path):
    assert readers.read_parquet_or_empty(spark, str(tmp_path / "none"), "a string").count() == 0
    with pytest.raises(Exception, match="nofs"):
        readers.read_parquet_or_empty(spark, "nofs://x/y", "a string")


def test_latex_table(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.12345, None), ("50 %", 1.0, 3)], "name string, kappa double, n int")
    want = "\n".join([r"\begin{tabular}{lll}", r"\toprule", r"name & kappa & n \\", r"\midrule", r"a\_b & 0.1235 & - \\", r"50 \% & 1.0000 & 3 \\", r"\bottomrule", r"\end{tabular}"])
    assert sinks.latex_table(df) == want
    path = sinks.save_latex(df, str(tmp_path / "t.tex"))
    assert "\n".join(r.value for r in spark.read.text(path).collect()) == want


# ------------------------------------------------------------------ line breaks in quotes


def quoted_file(path, rows, sep=",", end="\n"):
    field = lambda v: '"' + v.replace('"', '""') + '"'
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(end.join([sep.join(("id", "text", "n")), *(sep.join((str(i), field(t), str(n))) for i, t, n in rows), ""]).encode())


def odd_texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "word ", '"', '""', "\n", "\n\n", ",", "\t", "é🙂", '"\n"', " "]
    return [(i, "x" + "".join(rng.choices(bits, k=rng.randint(0, 40))) + "y", i % 7) for i in range(n)]


@pytest.mark.parametrize("size,sep,end", [(97, ",", "\n"), (700, "\t", "\r\n"), (5000, ",", "\n")])
def test_ranges_of_a_file_with_line_breaks_in_quotes(spark, tmp_path, size, sep, end):
    """Read in ranges by as many tasks, equal to the one-task read and to what was written, and in order."""
    rows = odd_texts(size, 400)
    rows[200] = (200, "z\n" * 3000, 1)  # over many ranges
    for k in (0, 1):
        quoted_file(tmp_path / "in" / f"part{k}.csv", rows[k * 250 : 250 + k * 150], sep, end)
    small = with_conf(spark, {readers.WHOLE: 0, "spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0})
    path = str(tmp_path / "in")
    got = readers.read_csv(small, path, {"id": "long", "n": "int"}, sep, order="at")
    bytes_ = sum(f.stat().st_size for f in (tmp_path / "in").iterdir())
    assert quoted._lines(small, path).select(F.spark_partition_id()).distinct().count() > 0.5 * bytes_ / max(size, 200)
    assert [tuple(r) for r in got.orderBy("at").drop("at").collect()] == rows
    assert got.select("at").distinct().count() == len(rows)
    whole = readers.read_csv(spark, path, {"id": "long", "n": "int"}, sep, multiline=True)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.drop("at").collect()))


def test_python_holds_few_lines_at_a_time():
    """a batch of ten thousand lines became Python strings at once."""
    n = 2000
    batch = pa.record_batch({"value": ["a,b"] * n, "file": ["f"] * n, "start": [0] * n, "odd": [False] * n})
    got = list(quoted._assemble(iter([batch])))
    assert max(b.num_rows for b in got) <= 256 and [x for b in got for x in b.column("n").to_pylist()] == list(range(n))


def test_ranges_do_not_grow_in_number(spark, monkeypatch):
    """ranges of 64 KB made 40,000 tasks a reading at 1 GB."""
    seen = []
    real = files.with_conf
    monkeypatch.setattr(files, "with_conf", lambda s, conf: seen.append(conf) or real(s, conf))
    monkeypatch.setattr(files.corpora, "jigsaw", lambda s, root: None)
    monkeypatch.setattr(files, "_csv", lambda *a: None)
    monkeypatch.setattr(readers, "sizes", lambda s, p: [1 << 29, 1 << 29])
    files.load_jigsaw(spark, "/root/testdata/sf0.001")
    assert seen[0]["spark.sql.files.maxPartitionBytes"] >= 1 << 22


def test_many_ranges_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "MANY", 0)
    rows = odd_texts(4, 200)
    quoted_file(tmp_path / "one.csv", rows)
    small = with_conf(spark, {readers.WHOLE: 0, "spark.sql.files.maxPartitionBytes": 300, "spark.sql.files.openCostInBytes": 0})
    assert sorted(map(tuple, readers.read_csv(small, str(tmp_path / "one.csv"), {"id": "long", "n": "int"}).collect())) == rows


def test_quotes_that_do_not_match_are_read_by_one_task(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('id,text\n1,5" wide\n2,"a\nb"\n')
    small = with_conf(spark, {readers.WHOLE: 0})
    got = readers.read_csv(small, str(tmp_path / "odd.csv"))
    assert quoted.records(small, str(tmp_path / "odd.csv")) is None
    assert sorted(r.text for r in got.collect()) == ['5" wide', "a\nb"]
    (tmp_path / "empty.csv").write_text("id,text\n")
    assert readers.read_csv(small, str(tmp_path / "empty.csv")).count() == 0
