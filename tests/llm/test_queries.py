"""The contract's queries and the pipeline on the smallest tables."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexeum.llm import common as C
from lexeum.llm import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
COLUMNS = {
    1: "doc_id held_out score predicted",
    2: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    3: "doc_id size text_crc32 law shard slot grown_shard",
    4: "doc_id n_bytes n_tokens over_limit",
    5: "doc_id n_shingles component_id kept",
    6: "query_id rank vec_id score",
    7: "doc_id size source_size target taken",
    8: "doc_id held_out score predicted",
    9: "doc_id held_out lang_pred score",
    10: "doc_id n_words n_hit n_items items_sha256 contaminated",
    11: "lang source part item value rank",
    12: "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    13: "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in C.read_table(spark, str(DATA), "documents").collect()}


@pytest.mark.parametrize("name", registry.QUERIES)
def test_contract(spark, docs, name):
    number = int(name[2:].split("_")[0])
    rows = registry.QUERIES[name](spark, str(DATA)).collect()
    want = COLUMNS[number].split()
    assert set(want) <= set(rows[0].asDict())
    if number not in (6, 11, 12):
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if number in (1, 8, 9):
        mod, rest = (4, 2) if number == 8 else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in rows)
    if number in (1, 8):
        assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    if number == 2:
        for r in rows:
            base = ",".join(s for s in r.spans.split(",") if not s.startswith(("term", "secret")))
            assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
            assert base.count("email:") == r.n_email and base.count("card:") == r.n_card
    if number == 3:
        assert all(r.size == len((docs[r.doc_id].text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((docs[r.doc_id].text or "").encode()) for r in rows)
        load = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
        assert max(load) <= 1.1 * min(load) and {r.law for r in rows} == {"bytes"}
    if number == 12:
        assert len(rows) == 600 * len({r.part for r in rows}) and all(r.filter == r.filter_order[r.step - 1] for r in rows)
    if number == 13:
        for r in rows:
            base = ",".join(s for s in r.spans.split(",") if not s.startswith("random"))
            assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256 and base.count("hex:") == r.n_hex
    if number == 7:
        assert all(0 <= r.taken <= 3 * r.size for r in rows)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = registry.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    found = c.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[k] for k in cols) for r in df.collect()) == sorted(tuple(r[names.index(k)] for k in cols) for r in found.fetchall())


def test_pipeline(spark, docs):
    stage_rows, now = {}, C.read_table(spark, str(DATA), "documents")
    cols = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = C.stored(stage(spark, now, str(DATA)), name)
        stage_rows[name] = now.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == cols
    ids = {k: [r.doc_id for r in v] for k, v in stage_rows.items()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    scores = {r.doc_id: r.predicted for r in registry.QUERIES["op8_quality"](spark, str(DATA)).collect()}
    assert sorted(ids[names[0]]) == sorted(i for i, p in scores.items() if p)
    assert len(set(ids[names[1]])) == len(ids[names[1]]) and set(ids[names[1]]) < set(ids[names[0]])
    texts = [r.text for r in stage_rows[names[1]]]
    assert len(set(texts)) == len(texts)
    assert set(ids[names[2]]) < set(ids[names[1]])
    assert set(ids[names[3]]) <= set(ids[names[2]]) and len(ids[names[3]]) > len(set(ids[names[3]]))
    last = stage_rows[names[4]]
    assert sorted(r.doc_id for r in last) == sorted(ids[names[3]])
    assert sorted((r.shard, r.slot) for r in last) == [(s, k) for s in range(8) for k in range(sum(r.shard == s for r in last))]


ODD_COLUMNS = ("_bits", "_bucket", "shard", "slot", "found", "size", "score", "copies", "target", "_k", "_key", "a.b")


def odd_tables(spark, path):
    """The smallest tables with nulls, a text of a megabyte, repeated and empty rows, equal texts, ids in two rows and columns of clashing names."""
    docs = C.read_table(spark, str(DATA), "documents")
    long = "Plain words of one long and ordinary text, said in many different ways. "
    odd = [(10**6, None, None, None, 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, " \n\t ", "en", "src1", 4), (10**6 + 3, "".join(f"{long[:-2]} {i} times. " for i in range(14_000)), "en", "src1", 10**6)]
    more = spark.createDataFrame(odd, docs.schema)
    some = docs.filter("doc_id < 6")
    again = docs.filter("doc_id between 10 and 15").withColumn("text", F.concat(F.lit("Another text of the same id. "), "text"))
    out = docs.union(more).union(some).union(some).union(again)
    for c in ODD_COLUMNS:
        out = out.withColumn(c, F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")))
    out.write.parquet(f"{path}/documents.parquet")
    C.read_table(spark, str(DATA), "labels").write.parquet(f"{path}/labels.parquet")
    bench = C.read_table(spark, str(DATA), "benchmark")
    bench.union(bench.limit(3)).union(spark.createDataFrame([(None, "x"), (77, None)], bench.schema)).write.parquet(f"{path}/benchmark.parquet")


def brute_stages(spark, path):
    """What each stage keeps, by plain Python on the rows that the stage before kept: (name, rows in, ids kept)."""
    from test_neardup import brute
    from test_operators import brute_hits

    items = [(r.item_id, r.text) for r in C.read_table(spark, path, "benchmark").collect()]
    now = C.read_table(spark, path, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = now.collect()
        if name == "minhash_near_dedup":
            # texts of one id are one document: what any of them is linked with is in its class
            keyed, ids = [], {}
            for k, r in enumerate(sorted(rows, key=lambda r: r.doc_id)):
                keyed.append((k, r.text))
                ids[k] = r.doc_id
            label = {k: ids[c] for k, (_, c) in brute(keyed).items()}
            for _ in range(len(odd_ids := [i for i, n in Counter(ids.values()).items() if n > 1]) + 1):
                for i in odd_ids:
                    mine = {label[k] for k in ids if ids[k] == i}
                    label = {k: min(mine) if c in mine else c for k, c in label.items()}
            want = Counter({(ids[k], t): 1 for k, t in keyed if label[k] == ids[k]})
        elif name == "benchmark_decontamination":
            hits = brute_hits([r.text for r in rows], items)
            want = Counter((r.doc_id, r.text) for r, h in zip(rows, hits, strict=True) if not h[1])
        else:
            want = None
        last, now = now, C.stored(stage(spark, now, path), name)
        yield name, rows, want, Counter((r.doc_id, r.text) for r in now.select("doc_id", "text").collect()), now, last


def test_pipeline_of_odd_tables_against_brute_force(spark, tmp_path):
    odd_tables(spark, str(tmp_path))
    docs = C.read_table(spark, str(tmp_path), "documents")
    for name, rows, want, got, now, last in brute_stages(spark, str(tmp_path)):
        assert now.columns == docs.columns, name
        if want is not None:
            assert got == want, name
        if name == "quality_classifier":
            from lexeum.llm import quality

            labels = C.read_table(spark, str(tmp_path), "labels").filter(~C.held_out(F.col("doc_id"), 4, 2))
            scored = last.select("doc_id", "text", quality.score(last, quality.train(last, labels)).alias("p")).collect()
            assert got == Counter((r.doc_id, r.text) for r in scored if r.p >= 0.7)
        if name == "source_mixing":
            assert set(got) <= {(r.doc_id, r.text) for r in rows}
            have = Counter((r.doc_id, r.text) for r in rows)
            assert all(n <= 3 * have[k] for k, n in got.items())
        r = now.first()
        assert r is None or all(r[c] == f"{c} {r.doc_id}" for c in ODD_COLUMNS)
    out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert out.columns == [*docs.columns, "shard_", "slot_"]
    last = out.collect()
    assert Counter((r.doc_id, r.text) for r in last) == got
    assert sorted((r.shard_, r.slot_) for r in last) == [(s, k) for s in range(8) for k in range(sum(r.shard_ == s for r in last))]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        C.read_table(spark, str(DATA), t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
