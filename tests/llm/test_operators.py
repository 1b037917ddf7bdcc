"""The other training-data operators against brute force, and their defined cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexeum.llm import common as C
from lexeum.llm import decontam, langid, mixing, pii, quality, sharding, tokens, topk, toxicity

LOW = {k: k + 32 for k in range(65, 91)}
ODD = [None, "", " ", "\n\t", "a", "Ü é 漢字", "x" * 100_000, "one two " * 20_000, "a\x00b", "🙂 " * 10]


def frame(spark, texts, **cols):
    rows = [(i, t, *(c[i] for c in cols.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in cols))


# ------------------------------------------------------------------ kernels


@pytest.mark.parametrize("table,pattern", [(C.NOT_BLANK, r"[^\x20\x09-\x0D]+"), (C.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_match_the_patterns(table, pattern, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 64)
    rng = np.random.default_rng(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(list("aB9 .\néß\x00-"), size=int(rng.integers(0, 300)))) for _ in range(50)]
    data, off = C.utf8(pa.array(texts))
    h, s, e, ptr = C.words(data, off, table)
    raw = data.tobytes()
    seen = {}
    for i, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(s[ptr[i] : ptr[i + 1]], e[ptr[i] : ptr[i + 1]], strict=True)]
        assert [w.translate(LOW) for w in got] == re.findall(pattern, t.translate(LOW))
        for w, x in zip(got, h[ptr[i] : ptr[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w.translate(LOW), x) == x
    assert len(set(seen.values())) == len(seen)


# ------------------------------------------------------------------ tokens


def test_token_counts_of_whole_texts(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    texts = [*ODD, "<|endoftext|> a <|endoftext|>", "it's   two  spaces\n\n x 12 34 'll"] + ["".join(rng.choice(list("abc  .,1é\n'"), size=500)) for _ in range(30)]
    texts += ["".join(rng.choice(list(s), size=500)) for s in ("的一是漢字。，「」 ", "привет мир.,! ", "مرحبا ؟،. ", "abcДя漢²½ 1。 '", "नमस्ते। ") for _ in range(6)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(P.path(name))
        want = [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
        with monkeypatch.context() as m:
            m.setattr(tokens, "pieces", lambda x, f=tokens.pieces, safe=None: f(x, 40, safe))
            with open(P.path(name), "rb") as f:
                assert tokens.count_batch([x or "" for x in texts], name, f.read()).tolist() == want
    df = frame(spark, texts, n_tokens=["kept"] * len(texts))
    got = tokens.with_token_counts(df, P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [r["n_tokens_"] for r in got] == [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
    assert got[0].n_tokens == "kept"
    assert tokens.with_token_counts(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_long_texts_of_all_scripts_are_cut():
    for t in ("слово " * 100_000, "漢字的文。" * 100_000, "λόγος και " * 50_000, "كلمة هنا " * 50_000, "word " * 100_000):
        cut = tokens.pieces(t, safe=tokens._SIGN)
        assert "".join(cut) == t and max(map(len, cut)) <= tokens.PIECE_CHARS + 16


def test_sentence_pieces(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    monkeypatch.setattr(tokens, "pieces", lambda x, f=tokens.pieces, safe=None: f(x, 20, safe))
    texts = ["быстрая лиса прыгает через ленивую собаку и бежит дальше", "The quick brown fox jumps over the lazy dog and then some more words follow", "", "a"]
    assert tokens.count_batch(texts, "piece_bpe_32k.model", model).tolist() == [len(sp.encode(t)) for t in texts]


# ------------------------------------------------------------------ top k


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    vecs = [rng.normal(size=8).astype(float).tolist() for _ in range(300)] + [[1.0] * 8] * 40
    rows = [(i, v) for i, v in enumerate(vecs)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (950, [2.0] * 3), (951, [1.0] * 3), (1000, []), (904, [1e300] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = {i: [min(2**63 - 1, max(-(2**63), int(np.floor(256.0 * x)))) if abs(x) < 1e17 else 2**63 - 1 for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in ok if i % 50 == 0]:
        mine = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ok[q], v, strict=True)))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(mine)], q


def test_top_k_stops_on_proof():
    """On clustered rows few are rescored, not all postings are processed, and the k best are always among the candidates."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 32))
    x = centre[rng.integers(0, 40, size=4000)] + 0.35 * rng.normal(size=(4000, 32))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    ids = rng.permutation(4000)
    tile = topk.Tile(ids, x)
    total = (x != 0).sum()
    assert sum(len(s[0]) for s in tile.segments) == total
    kept = seen = 0
    for p in range(0, 4000, 80):
        score = np.where(ids == ids[p], -np.inf, x @ x[p])
        want = np.lexsort((ids, -score))[:5]
        alive, n = tile.candidates(ids[p], x[p], 5, -np.inf)
        assert set(want) <= set(alive) and p not in alive
        high, _ = tile.candidates(ids[p], x[p], 5, float(score[want[0]]))
        assert want[0] in high and len(high) <= len(alive)
        kept, seen = kept + len(alive), seen + n
    assert kept <= 50 * 4000 / 10 and seen <= 0.8 * 50 * total


def test_top_k_of_zeros_and_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 3)
    df = spark.createDataFrame([(i, [0.0, 0.0] if i % 2 else [float(i % 5), -1.0]) for i in range(40)], "vec_id long, embedding array<double>").repartition(2)
    vec = {r.vec_id: [int(256 * v) for v in r.embedding] for r in df.collect()}
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 4 < 2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (i for i in vec if i % 4 < 2):
        mine = sorted((-sum(a * b for a, b in zip(vec[q], v, strict=True)), i) for i, v in vec.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(mine)]


def test_top_k_with_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).collect()) == [(1, 1, 131072), (2, 1, 131072)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


# ------------------------------------------------------------------ sharding


@pytest.mark.parametrize("kind", ["even", "hot", "tiny", "empty"])
def test_shards(spark, kind):
    rng = np.random.default_rng(6)
    n = {"even": 1500, "hot": 1500, "tiny": 3, "empty": 0}[kind]
    texts = ["w" * int(rng.integers(0, 200)) + str(i % 1300) for i in range(n)]
    if kind == "hot":
        texts[:500] = ["hot " * 20] * 500
        texts[500:510] = [None] * 10
    df = frame(spark, texts, shard=["mine"] * n, _key=["k"] * n, _s=["s"] * n)
    rows = sharding.sharded(df, 8).collect()
    assert len(rows) == n
    where, load, slots = {}, [0] * 8, {}
    for r in rows:
        assert where.setdefault(r.text, r.shard_) == r.shard_ and r.shard == "mine"
        load[r.shard_] += len(r.text or "") + 1
        slots.setdefault(r.shard_, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if kind == "even":
        assert max(load) - min(load) <= 0.02 * sum(load) / 8
    if kind == "hot":
        hot = where["hot " * 20]
        rest = [x for i, x in enumerate(load) if i != hot]
        assert load[hot] == 500 * 81 and max(rest) - min(rest) <= 0.03 * sum(rest) / 7


def test_splitters_against_sorting(spark):
    """Every splitter lies where the bytes below come within the slack of its target, or at the nearest end of the one key that spans it."""
    rng = np.random.default_rng(7)
    rows = [(int(k), int(s)) for k, s in zip(rng.integers(-(2**63), 2**63, size=2000), rng.integers(1, 50, size=2000), strict=True)]
    rows += [(5, 4000), (5, 4000), (-9, 3000)]
    df = spark.createDataFrame(rows, "key long, size long")
    total = sum(s for _, s in rows)
    goals = [total * k / 8 for k in range(1, 8)]
    edges = sharding.splitters(df, goals, 40.0)
    assert edges == sorted(edges)
    keys = sorted({k for k, _ in rows})
    sums = dict.fromkeys(keys, 0)
    for k, s in rows:
        sums[k] += s
    below = np.concatenate(([0], np.cumsum([sums[k] for k in keys])))
    for e, t in zip(edges, goals, strict=True):
        have = sum(s for k, s in rows if k < e)
        assert abs(have - t) <= max(40.0, np.abs(below - t).min() + 1e-9)


def test_shards_against_sorting(spark):
    """Groups of one text placed whole, the rest by key between the splitters, slots in order of key and doc_id."""
    rng = np.random.default_rng(17)
    texts = [f"text {int(rng.integers(0, 700))} " + "w" * int(rng.integers(0, 90)) for _ in range(1200)] + ["big " * 40] * 100 + [None] * 5
    df = frame(spark, texts)
    key = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    rows = sharding.sharded(df, 8).collect()
    size = lambda r: len((r.text or "").encode()) + 1
    whole = sum(map(size, rows))
    group = {}
    for r in rows:
        group.setdefault(key[r.doc_id], []).append(r)
    heavy = {k for k, v in group.items() if sum(map(size, v)) >= max(1, sharding.HEAVY * whole / 8) or len(v) > max(1, sharding.HEAVY * len(rows) / 8)}
    assert all(len({r.shard for r in v}) == 1 for v in group.values())
    light = sorted((key[r.doc_id], r.shard) for r in rows if key[r.doc_id] not in heavy)
    assert [s for _, s in light] == sorted(s for _, s in light)  # shards are ranges of keys
    place, room = sharding.capacities(whole, [sum(map(size, group[k])) for k in sorted(heavy)], 8)
    assert [group[k][0].shard for k in sorted(heavy)] == place
    for s in range(8):
        mine = sum(size(r) for r in rows if r.shard == s and key[r.doc_id] not in heavy)
        assert abs(mine - room[s]) <= 2 * max(sharding.TOLERANCE * whole / 8, max(size(r) for r in rows if key[r.doc_id] not in heavy))
        order = [(key[r.doc_id] in heavy, key[r.doc_id], r.doc_id) for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)]
        assert [x for x in order if not x[0]] == sorted(x for x in order if not x[0])


def test_capacities_fill_level():
    place, room = sharding.capacities(100, [60, 5], 4)
    assert place[0] != place[1] and sum(room) == pytest.approx(35)
    assert room[place[0]] == 0


# ------------------------------------------------------------------ mixing


def targets(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    """Shares of the total by weight (repeating), none above ``cap`` times its size, in plain Python."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def brute_mix(spark, df, cap=3):
    """Copies of each document by sorting every source's documents by rank, from the hashes Spark gives."""
    u = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), "text"), F.lit(1 << 52))
    rows = [(r.doc_id, r.source, r.u, len(re.findall("[^\x20\x09-\x0D]+", r.text or "")), len((r.text or "").encode())) for r in df.select("doc_id", "source", "text", u.alias("u")).collect()]
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None] * any(r[1] is None for r in rows)
    goals = targets([sum(r[3] for r in rows if r[1] == k) for k in names])
    out = {}
    for k, goal in zip(names, goals, strict=True):
        mine = [(i, u, n, 2.0 ** (round(4 * math.log2(max(math.sqrt(min(b, 512) / 512), 2**-10))) / 4)) for i, s, u, n, b in rows if s == k]
        lo, hi = 0.0, 1e9
        for _ in range(200):  # the scale by bisection
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(cap, c * w) * n for *_, n, w in mine) < goal else (lo, c)
        c, ranked, gap = hi, [], goal
        for i, u, n, w in mine:
            lam = min(cap, c * w)
            whole = int(lam + 1e-9)
            p = max(0.0, lam - whole)
            out[i] = whole
            gap -= whole * n
            if p >= 1e-9 and n:
                x = (u + 0.5) / 2**52
                odds = x / (1 - x) * (1 - p) / p
                ranked.append((odds / (1 + odds), i, n))
        rest, end = [], None
        for j, (_, i, n) in enumerate(sorted(ranked)):  # all that fit, up to TAIL ranks after the first that does not
            if end is not None and j >= end:
                break
            if n <= gap:
                out[i] += 1
                gap -= n
            else:
                end = j + mixing.TAIL if end is None else end
                rest.append((abs(n - gap), j, i))
        if rest and min(rest)[0] < gap:
            out[min(rest)[2]] += 1
    return out, dict(zip(names, goals, strict=True))


def mix_texts():
    rng = np.random.default_rng(8)
    n = 900
    texts = [" ".join(["w"] * int(rng.integers(0, 60))) if i % 50 else None for i in range(n)]
    return texts, [("big" if i % 3 else ["a", "b", None, "é"][i % 4]) for i in range(n)]


@pytest.mark.parametrize("tail,many,hot", [(8, 100_000, 50_000), (256, 0, 40)])
def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch, tail, many, hot):
    monkeypatch.setattr(mixing, "TAIL", tail)
    monkeypatch.setattr(mixing, "MANY", many)
    monkeypatch.setattr(C, "HOT", hot)
    texts, source = mix_texts()
    n = len(texts)
    df = frame(spark, texts, source=source, target=["kept"] * n, _k=["k"] * n, _z=["z"] * n, _slice=["x"] * n, _c=["c"] * n)
    one = {r.doc_id: r for r in mixing.mixed(df).collect()}
    two = {r.doc_id: r for r in mixing.mixed(df.repartition(7)).collect()}
    assert len(one) == n and {k: r.copies for k, r in one.items()} == {k: r.copies for k, r in two.items()}
    by = {}
    for r in one.values():
        assert 0 <= r.copies <= 3 and r.target == "kept" and r._slice == "x"
        g = by.setdefault(r.source, [0, r.target_, r.source_size, 0])
        g[0] += r.copies * r.size
        g[3] += r.size
    names = sorted((k for k in by if k is not None)) + [None]
    want = targets([by[k][3] for k in names])
    for k, t in zip(names, want, strict=True):
        assert by[k][1] == pytest.approx(t) and by[k][2] == by[k][3]
        assert abs(by[k][0] - t) <= max(5, 0.01 * t), k
    rows = mixing.mix(df)
    assert rows.columns == df.columns and rows.count() == sum(r.copies for r in one.values())
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mix_against_sorting_all_documents(spark):
    texts, source = mix_texts()
    df = frame(spark, texts, source=source)
    want, goals = brute_mix(spark, df)
    rows = mixing.mixed(df, importance=mixing.by_length("text")).collect()
    assert {r.source: r.target for r in rows} == {k: pytest.approx(v) for k, v in goals.items()}
    assert {r.doc_id: r.copies for r in rows} == want
    for k, goal in goals.items():
        assert abs(goal - sum(r.size * r.copies for r in rows if r.source == k)) <= max(5, 0.002 * goal)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.format_string("s%05d", F.col("id") % 1000).alias("source"))
    got = {r.source: r.target for r in mixing.mixed(many).collect()}
    assert [got[k] for k in sorted(got)] == [pytest.approx(t) for t in targets([9] * 1000)]


@pytest.mark.parametrize("step", [2, 12])
def test_mix_settles_across_ranges(spark, monkeypatch, step):
    """The outcome does not depend on where the ranges end."""
    monkeypatch.setattr(mixing, "_STEP", step)
    monkeypatch.setattr(mixing, "TAIL", 16)
    texts, source = mix_texts()
    df = frame(spark, texts[:300], source=source[:300])
    assert {r.doc_id: r.copies for r in mixing.mixed(df, importance=mixing.by_length("text")).collect()} == brute_mix(spark, df)[0]


@pytest.mark.parametrize("sf,share", [("sf0.01", 0.01), ("sf0.1", 0.001)])
def test_mix_of_the_drivers_documents_meets_its_targets(spark, sf, share):
    docs = C.read_table(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text", "source")
    rows = mixing.mixed(docs, importance=mixing.by_length("text")).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("took"), F.first("target").alias("target")).collect()
    assert rows and all(abs(r.took - r.target) <= share * r.target for r in rows)


def test_mix_by_importance(spark):
    texts = ["w " * 30] * 400
    df = frame(spark, texts, source=["a"] * 200 + ["b"] * 200)
    rows = mixing.mixed(df, importance=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    even = sum(r.copies for r in rows if r.source == "b" and r.doc_id % 2 == 0)
    odd = sum(r.copies for r in rows if r.source == "b" and r.doc_id % 2)
    assert even > 1.5 * odd
    assert abs(sum(r.copies * r.size for r in rows if r.source == "b") - rows[-1].target) <= 60


# ------------------------------------------------------------------ decontamination


def brute_hits(texts, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    win = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        k = min(n, len(w))
        for a in range(len(w) - k + 1):
            win.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in win}:
            for a in range(len(w) - k + 1):
                if x := win.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= x
        out.append((len(w), sorted(hit), sorted(found)))
    return out


@pytest.mark.parametrize("part", [8 << 20, 200])
def test_contamination_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(decontam, "PART_BYTES", part)
    rng = np.random.default_rng(9)
    vocab = list("abcdefgh")
    items = [(i, " ".join(rng.choice(vocab, size=int(rng.integers(1, 25))))) for i in range(12)] + [(50, None), (51, "... !"), (52, "Ünï CODE"), (None, "a b"), (53, "solo"), (54, "solo"), (54, "solo"), (54, "solo too"), (0, "a b c d")]
    texts = ODD + [" ".join(rng.choice(vocab, size=200)) for _ in range(10)] + ["pre " + t.upper() + ", post" for _, t in items if t] + ["x ünï code. SOLO-solo"]
    texts += ["ÜNÏ code"]
    df = frame(spark, texts, found=["kept"] * len(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.with_contamination(df, bench, name="hit").orderBy("doc_id").collect()
    for r, want in zip(got, brute_hits(texts, items), strict=True):
        assert (r.hit.n_words, r.hit.hits, sorted(r.hit["items"])) == want, r.text
        assert r.found == "kept"
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not w[1] for w in brute_hits(texts, items))


def test_windows_are_small(spark):
    """What is broadcast of 1 MB of items is at most 4 MB; a worker's copy finds the same."""
    import pickle

    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=int(rng.integers(2, 10)))) for _ in range(5000)]
    items = [(i, " ".join(rng.choice(vocab, size=int(rng.integers(1, 400))))) for i in range(800)] + [(900 + i, "one shared passage of ten words that many items have in common") for i in range(300)]
    size = sum(len(t) for _, t in items)
    w = decontam.Windows(items)
    first = len(pickle.dumps(w))
    w.rank({n: np.ones(len(k), np.int64) for n, k in w.shingles.items()})
    assert first <= 1.2 * size and len(pickle.dumps(w)) <= 3 * size
    texts = pa.array([items[3][1].upper() + " tail", "said: one shared passage of ten words that many items have, in common", "", None, items[7][1]])
    again = pickle.loads(pickle.dumps(w)).find(texts)
    assert again.equals(w.find(texts)) and len(again.to_pylist()[1]["items"]) == 300


def test_contamination_with_empty_tables(spark):
    df, bench = frame(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")
    r = decontam.with_contamination(df, bench).first().found
    assert (r.n_words, r.hits, r["items"]) == (2, [], [])
    assert decontam.with_contamination(df.limit(0), bench).count() == 0
    assert decontam.digest([]) == hashlib.sha256(b"").hexdigest()
    assert decontam.digest(["10", "9"]) == hashlib.sha256(b"10,9").hexdigest()


# ------------------------------------------------------------------ personal data

SLOW = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and pii.luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def slow_spans(text):
    out = [(m.start(), m.end(), k) for k, (p, ok) in SLOW.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_as_the_patterns_say():
    rng = np.random.default_rng(10)
    texts = ["a@b.c@d.e", " @b.c@d.e", "a@b@c.de", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.0255", "1.2.3.4.5", "4111 1111 1111 1111", "+1 (886) 555-9674.", "+1((((", "é@é.é a.b@c-d.e.", "4111111111111111 0", "٣.1.2.3.4"]
    texts += ["".join(rng.choice(list("a1.@+- (54é\n"), size=int(rng.integers(0, 60)))) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t) == slow_spans(t), t
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1(" * 50_000, "a@" * 50_000):
        pii.base_spans(t)


def test_terms_that_give_an_entity_away(spark, monkeypatch):
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rng = np.random.default_rng(11)
    texts = []
    for i in range(12):
        w = list(rng.choice(filler, size=6))
        texts.append(" ".join(w[:3]) + " Zorbina writes from zorb@mail.com the " + " ".join(w[3:]))
    texts += ["the " + " ".join(rng.choice(filler, size=20)) + " mail x@y.org" for _ in range(60)]
    texts += ["copy of the Quendal text q@r.st ends"] * 5 + [None, "", "Zorbina alone"]
    df = frame(spark, texts, found=["kept"] * len(texts))
    rules = pii.learn(df)
    said = {(r.t, r.action) for r in rules.collect()}
    assert ("zorbina", "remove") in said and not any(t in ("the", "quendal") for t, _ in said)
    for part in (pii.PART, 1):
        monkeypatch.setattr(pii, "PART", part)
        got = {r.doc_id: r for r in pii.with_spans(df, rules, name="hit").collect()}
        for i, t in enumerate(texts):
            spans = list(zip(got[i].hit.starts, got[i].hit.ends, got[i].hit.kinds, strict=True))
            assert [s for s in spans if s[2] in pii.BASE] == slow_spans(t or "")
            assert got[i].found == "kept"
        assert "Zorbina" in {texts[0][a:b] for a, b, k in zip(got[0].hit.starts, got[0].hit.ends, got[0].hit.kinds, strict=True) if k == "term"}
        assert "term" not in got[len(texts) - 1].hit.kinds
    clean = pii.sanitise(df).orderBy("doc_id").collect()
    assert "Zorbina" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[len(texts) - 3].text is None
    assert pii.with_spans(df.limit(0), pii.learn(df.limit(0))).count() == 0


def rare_entities(spark, *more):
    """300 documents of common words; the texts given stand behind them."""
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rng = np.random.default_rng(21)
    return frame(spark, [" ".join(rng.choice(common, size=20)) for _ in range(300)] + list(more))


def test_single_meetings_are_no_evidence(spark):
    """A word met once or twice with an address has a large share of its information, and no rule; one met five times has."""
    often = [f"wordaa {w} Quillon wordda six@mail.com" for w in ("wordea", "wordfa", "wordga", "wordha", "wordia")]
    df = rare_entities(spark, "wordaa Ombretta one@mail.com wordba", "wordca Tarvis two@mail.com wordda", "wordea wordfa two@mail.com Tarvis", *["Marbeck seven@mail.com said once"] * 6, *often)
    rules = {(r.t, r.action) for r in pii.learn(df).collect()}
    assert rules == {("quillon", "remove")}
    clean = [r.text for r in pii.sanitise(df).orderBy("doc_id").collect()]
    assert "Ombretta" in clean[300] and "Tarvis" in clean[301] and "Marbeck" in clean[303] and not any("Quillon" in t for t in clean[309:])


def test_terms_far_from_their_entity(spark):
    far = " ".join(f"word{chr(97 + i)}a" for i in range(20))
    df = rare_entities(spark, *(f"Ombretta {far} one@mail.com said{i}x" for i in range(6)), *(f"{far} two@mail.com Quillon.Co@mail.com {far} Tarvis said{i}y" for i in range(6)))
    counts = {(r.t, r.action) for r in pii.learn(df).collect()}
    assert {("ombretta", "remove"), ("tarvis", "remove")} <= counts and not any(t in ("quillon", "mail", "com") for t, _ in counts)
    clean = [r.text for r in pii.sanitise(df).orderBy("doc_id").collect()]
    assert "Ombretta" not in clean[300] and "Tarvis" not in clean[307]


def planted_links(spark):
    """3,000 documents of a rare vocabulary; 40 people named in 6 documents each beside their address, 40 in 2, and 300 addresses of one document."""
    rng = np.random.default_rng(41)
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=int(rng.integers(4, 10)))) for _ in range(6000)]
    odds = 1 / np.arange(1, 6001)
    say = lambda k: " ".join(rng.choice(vocab, size=k, p=odds / odds.sum()))
    known, met = [f"Knownname{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)], [f"Metname{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    texts = [say(40) for _ in range(2380)] + [f"{say(30)} lone{i}@mail.org {say(30)}" for i in range(300)]
    texts += [f"{say(15)} {n} {say(10)} p{i}@mail.com {say(15)}" for i, n in enumerate(known) for _ in range(6)]
    texts += [f"{say(15)} {n} {say(10)} q{i}@mail.com {say(15)}" for i, n in enumerate(met) for _ in range(2)]
    return frame(spark, texts), {n.lower() for n in known}


def test_rules_of_planted_links(spark):
    """Precision and recall of the rules, and the share of words that they mark."""
    df, known = planted_links(spark)
    found = [r.t for r in pii.learn(df).collect() if not 0 <= r.c < len(pii.KINDS)]
    assert len(set(found) & known) >= 0.95 * len(known) and sum(t in known for t in found) >= 0.95 * len(found)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_few_words_of_the_drivers_documents_are_marked(spark, sf):
    docs = C.read_table(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text")
    found = pii.with_spans(docs, pii.learn(docs))
    marked = F.size(F.filter("found.kinds", lambda k: k == "term"))
    words, terms = found.filter(F.size("found.kinds") > 0).agg(F.sum(F.regexp_count("text", F.lit(r"\w{3,}"))), F.sum(marked)).first()
    assert terms < 0.02 * words


def test_pages_of_many_addresses_yield_few_pairs():
    """Entities and terms of one document are never paired; those that are need documents enough of both."""
    enough = math.log(0.01 / 10**9)
    assert pii.reach(1, 10_000, enough, pii.GENERALISE) == (1, 0) and pii.reach(2, 10_000, enough, pii.GENERALISE)[1] == 0
    least, most = pii.reach(6, 10_000, enough, pii.GENERALISE)
    assert 2 <= least <= 6 <= most < 200
    for nt in range(1, 400):
        can = any(pii.log_chance(x, n, 6, nt, 10_000) <= enough for n in range(1, min(6, nt) + 1) for x in range(1, n + 1))
        assert not can or least <= nt
    page = " ".join([*(f"a{i}@x.org" for i in range(500)), *(f"term{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000))])
    batch = pa.record_batch([pa.array([page])], ["text"])
    assert sum(b.num_rows for b in pii._met([batch], {}, (1, 0), {}, 0, {})) == 0


def brute_rules(texts):
    """(c, t) -> (disclosure, action) from counts of documents in plain Python."""
    entities, terms, n = {}, {}, len(texts)
    for i, x in enumerate(texts):
        spans = pii.known_spans(x or "")
        for c in pii.entities(x or "", spans):
            entities.setdefault(c, set()).add(i)
        inside = [s for s in spans if s[2] != "secret"]
        for m in re.finditer(r"[^\W_]{3,}", x or ""):
            if not any(a < m.end() and m.start() < b for a, b, _ in inside):
                for t in pii.names(m[0]):
                    terms.setdefault(t, set()).add(i)
    out = {}
    for c, own in entities.items():
        if len(own) == n:
            continue
        ic = math.log2(n / len(own))
        for t, have in terms.items():
            both = own & have
            if not both:
                continue
            share = (math.log2((len(both) + len(own) / n) / (len(have) + 1)) + ic) / ic
            x = len({texts[i] for i in both})
            mean = len(own) * len(have) / n * (x / len(both)) ** 2
            bounds = [x - mean - x * math.log(x / mean) if x > mean else 0.0]
            if x <= 20:
                bounds.append(x * math.log(mean) - math.log(math.factorial(x)))
            if share >= pii.GENERALISE and min(bounds) <= math.log(pii.CHANCE / len(terms) / (1 if 0 <= c < len(pii.KINDS) else sum(not 0 <= k < len(pii.KINDS) for k in entities))):
                out[c, t] = (pytest.approx(share), "remove" if share >= pii.REMOVE else "generalise")
    return out


def secret_texts():
    rng = np.random.default_rng(33)
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    say = lambda k: " ".join(rng.choice(common, size=k))
    digits = lambda: "".join(rng.choice(list("0123456789abcdef"), size=32))
    texts = [say(20) for _ in range(150)]
    texts += [f'{say(6)} Token = "{digits()}" {say(6)}' for _ in range(12)]
    texts += [f"{say(4)} write to p{i % 4}@mail.com {say(4)}" + " Ombretta" * (i % 4 == 1) for i in range(24)]
    texts += [texts[150]] * 3 + [f"{say(5)} {digits()} alone", "token: notasecret " + say(3), "password: short1 " + say(3), None, ""]
    return texts


@pytest.mark.parametrize("part", [pii.PART, 1])
def test_rules_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(pii, "PART", part)
    texts = secret_texts()
    got = {(r.c, r.t): (r.disclosure, r.action) for r in pii.learn(frame(spark, texts)).collect()}
    assert got == brute_rules(texts)
    kind = pii.kind_entity("secret")
    assert got[kind, "<hex 32>"][1] == "remove" and any(c >= len(pii.KINDS) or c < 0 for c, _ in got)


def test_pairs_count_documents_not_contexts(spark):
    """A term of 68 of 128 documents says little of an entity of 8, however many different documents those are."""
    texts = [f"common unique{i} mail a@b.cd now{i}x" if i < 8 else f"common filler{i} text" if i < 68 else f"other filler{i} text" for i in range(128)]
    rules = {r.t: r.action for r in pii.learn(frame(spark, texts)).collect()}
    assert rules.get("common") != "remove" and rules["mail"] == "remove"


@pytest.mark.parametrize("part", [pii.PART, 1])
def test_terms_of_kinds_in_all_documents(spark, monkeypatch, part):
    texts = secret_texts()
    df = frame(spark, texts, found=["kept"] * len(texts))
    rules = pii.learn(df)
    monkeypatch.setattr(pii, "PART", part)
    for r in pii.with_spans(df, rules, name="hit").collect():
        said = [(k, r.text[a:b]) for k, a, b in zip(r.hit.kinds, r.hit.starts, r.hit.ends, strict=True)]
        for w in re.findall(r"\b[0-9a-f]{32}\b", r.text or ""):
            assert ("secret", w) in said or ("term", w) in said
        assert not any(k == "secret" for k, w in said if w in ("notasecret", "short1")) and r.found == "kept"
    assert pii.secret_spans('api_key: "abcdefgh" x token=abc12345 secret = justwords', []) == [(10, 18, "secret"), (28, 36, "secret")]
    assert pii.secret_spans("token = me@mail123.com", pii.base_spans("token = me@mail123.com")) == []
    assert pii.names("x" * 100) == pii.names("X" * 100) and pii.names("x" * 100) != pii.names("x" * 101)
    assert pii.names("12345") == () and pii.names("ab12") == ("ab12",) and pii.names("g" + "1" * 70)[1] == "<mixed 128>"


@pytest.mark.parametrize("part", [pii.PART, 1])
def test_one_span_for_a_term_of_two_entities(spark, monkeypatch, part):
    monkeypatch.setattr(pii, "PART", part)
    texts = [f"Ombretta a{i}@mail.com and b{i}@mail.com" for i in range(8)] + ["Ombretta", None]
    name = lambda i, k: pii.entity(texts[i], pii.base_spans(texts[i])[k])
    rules = [(name(i, k), "ombretta", 0.9 - 0.2 * k, ("remove", "generalise")[k]) for i in range(8) for k in (0, 1)]
    df = frame(spark, texts, _text_key=["kept"] * len(texts))
    got = pii.with_spans(df, spark.createDataFrame(rules, "c long, t string, disclosure double, action string")).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        terms = [(a, b, x) for k, a, b, x in zip(r.found.kinds, r.found.starts, r.found.ends, r.found.actions, strict=True) if k == "term"]
        assert terms == ([(0, 8, "remove")] if i < 8 else []) and r._text_key == "kept"


# ------------------------------------------------------------------ classifiers


def labelled(spark, n=400):
    rng = np.random.default_rng(12)
    vocab = [a + b for a in ("ba", "de", "ki", "lo", "mu") for b in ("rin", "sta", "ven", "tol", "mar")]
    texts, quality_, toxic = [], [], []
    for i in range(n):
        w = list(rng.choice(vocab, size=int(rng.integers(5, 80))))
        q, x = int(i % 4 != 0), int(i % 5 == 0)
        if not q:
            w = [v + "%%%" for v in w] if i % 8 else [v for v in w[:6] for _ in range(9)]
        if x:
            for k in rng.integers(0, len(w), size=3):
                w[int(k)] = str(rng.choice(["zagro" + v for v in ("n", "t", "x")]))
        texts.append(" ".join(w))
        quality_.append(q)
        toxic.append(x)
    labels = spark.createDataFrame([(i, q, x) for i, (q, x) in enumerate(zip(quality_, toxic, strict=True))], "doc_id long, quality int, toxic int")
    return texts, quality_, toxic, labels


def test_quality_on_rows_it_has_not_seen(spark):
    texts, y, _, labels = labelled(spark)
    odd = [*texts, *ODD]
    df = frame(spark, odd, score=["kept"] * len(odd))
    model = quality.train(df, labels.filter("doc_id % 3 <> 1"))
    got = {r.doc_id: r.p for r in df.withColumn("p", quality.score(df, model)).collect()}
    assert all(0 <= p <= 1 for p in got.values()) and len(got) == len(odd)
    unseen = [i for i in range(len(texts)) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == bool(y[i]) for i in unseen]) > 0.95
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(p >= 0.7 for p in got.values())


def test_quality_without_labels(spark):
    df = frame(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(df, none)
    assert [r.p for r in df.withColumn("p", quality.score(df, model)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert df.withColumn("p", quality.score(df, quality.train(df, one))).first().p == 1.0


def test_density_difference_is_the_gaussian_one():
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(200, 10)), rng.normal(size=(200, 10)) * 2 + 1])
    y = np.repeat([0.0, 1.0], 200)
    m = quality.fit(x, y, np.arange(400) % 5 == 0)
    z = (x[0] - m.centre) / m.scale
    d = []
    for k in (0, 1):
        s = m.factor[k] @ m.factor[k].T
        v = z - m.mean[k]
        d.append(-0.5 * (v @ np.linalg.inv(s) @ v + np.log(np.linalg.det(s))))
    assert m.margin(x[:1])[0] == pytest.approx(d[1] - d[0])


def test_toxicity_learns_stems_and_folds(spark):
    texts, _, y, labels = labelled(spark)
    odd = [*texts, *ODD, "you 1d10t and l0ser", "the trash can"]
    df = frame(spark, odd, found=["kept"] * len(odd))
    lex = toxicity.train(df, labels.filter("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.with_toxicity(df, lex, name="hit").collect()}
    assert all(0 <= r.hit.score <= 1 for r in got.values()) and len(got) == len(odd)
    unseen = [i for i in range(len(texts)) if i % 3 == 1]
    assert np.mean([(got[i].hit.score >= 0.7) == bool(y[i]) for i in unseen]) > 0.95
    r = got[len(odd) - 2]
    assert [r.text[a:b] for a, b in zip(r.hit.starts, r.hit.ends, strict=True)] == ["1d10t", "l0ser"]
    assert got[len(odd) - 1].hit.terms == [] and got[0].found == "kept"


def test_folding():
    lex = toxicity.Lexicon()
    find = lambda t: [t[a:b] for a, b, _, _ in sorted(lex.matches([t])[0][0])]
    assert find("іdiоt") == ["іdiоt"]
    assert find("i.d.i.o.t") == ["i.d.i.o.t"]
    assert find("stuuuupid $tupid st​upid") == ["stuuuupid", "$tupid", "st​upid"]
    assert find("1oser Loser! idiot!") == ["1oser", "Loser", "idiot"]
    assert find("pond scum, trash  can; scum") == ["scum"]
    assert find("classic scumble idiotic-looking") == []
    assert lex.matches([])[0] == [] and lex.matches(["", "a b"])[1].tolist() == [0, 2]


def slow_matches(lex, text):
    """Every entry at every place of the folded text by plain comparison; the best at each start, but for those inside exceptions."""
    f, place, _ = toxicity.folded([text])
    t = f.tobytes().decode("utf-32-le")
    entries = {**{form: e for form, e in lex.also.items()}, **{e: e for e in lex.entries}}
    found = lambda x: [a for a in range(len(t)) if t.startswith(x, a)]
    shield = [(a + 1, a + len(x) - 1) for x in lex.exceptions for a in found(x)]
    best = {}
    for x, e in entries.items():
        for a in found(x):
            s, b, w = a + 1, a + len(x) - (1 if x.endswith(" ") else 0), lex.entries[e]
            if not any(p <= s and b <= q for p, q in shield) and (s not in best or (w, b) > best[s][0]):
                best[s] = ((w, b), (int(place[s]), int(place[b - 1]) + 1, w))
    return sorted(v for _, v in best.values())


def test_matches_against_plain_search():
    rng = np.random.default_rng(15)
    lex = toxicity.Lexicon()
    lex.entries |= {" glorp ": 4.0, " zagr": 2.5, " glo": 1.0}
    lex.also[" giorp "] = " glorp "
    parts = ["idiot", "l0ser", "1oser", "trash can", "trash", "glorp", "g1orp", "zagrat", "glom", "pond scum", "scum", "i.d.i.o.t", "stuuupid", "and", "the", "ＩＤＩＯＴ", "іdiоt", "clown fish clown", "c1own!", "$tupid", "son of a bitch", "-", "\n", "x" * 60]
    for _ in range(300):
        text = "".join(str(rng.choice(parts)) + str(rng.choice([" ", " ", "  ", ", ", "", "\t"])) for _ in range(int(rng.integers(0, 14))))
        got = sorted((a, b, w) for a, b, _, w in lex.matches([text])[0][0])
        assert got == slow_matches(lex, text), text


def test_rare_words_are_learned_by_significance(spark):
    rng = np.random.default_rng(16)
    vocab = [a + b for a in ("ba", "de", "ki", "lo", "mu") for b in ("rin", "sta", "ven", "tol", "mar")]
    texts, y = [], []
    for i in range(2400):
        toxic = i % 4 == 0
        w = list(rng.choice(vocab, size=30))
        if toxic:
            w[3] = "glorp" if i % 160 == 0 else "zagrox" + "abcd"[i % 3]
        w[7] = f"w{i % 800}x"
        texts.append(" ".join(w))
        y.append(int(toxic))
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    lex = toxicity.train(frame(spark, texts), labels)
    assert any("glorp".startswith(e.strip()) for e in lex.entries) and any(e.startswith(" zagrox"[: len(e)]) for e in lex.entries)
    assert not any(e.strip() in vocab or e.startswith(" w") and e != " whore " and e != " worthiess " and e != " worthless " for e in lex.entries)
    if " glorp " in lex.entries:
        assert lex.also[" giorp "] == " glorp "


def test_toxicity_without_labels(spark):
    df = frame(spark, ["you idiot", None])
    lex = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    a, b = (r.found.score for r in toxicity.with_toxicity(df, lex).orderBy("doc_id").collect())
    assert a > b


def brute_kn(counts, langs_symbols, order, gram):
    """Interpolated Kneser-Ney by dictionaries; ``counts``: {tuple: n} at the highest order."""
    level = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        low = {}
        for g in level[n + 1]:
            low[g[1:]] = low.get(g[1:], 0) + 1
        level[n] = low
    p = 1.0 / (langs_symbols + 1)
    for n in range(1, order + 1):
        c = level[n]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        ctx = gram[-n:-1]
        total = sum(v for g, v in c.items() if g[:-1] == ctx)
        if total:
            kinds = sum(g[:-1] == ctx for g in c)
            v = c.get(gram[-n:], 0)
            p = max(v - d, 0) / total + d * kinds / total * p if v else d * kinds / total * p
    return p


def test_kneser_ney_against_dictionaries():
    words = ["abra", "abba", "cab", "bar", "carb", "ab", "a", "dab", "abra"]
    cp, h, s, e, _ = langid.read([" ".join(words)])
    g, _ = langid.grams(cp, s, e)
    u, c = np.unique(g, return_counts=True)
    m = langid.Models({"x": (u, c)})
    unpack = lambda v: tuple(int(v >> np.uint64(16 * k)) & 0xFFFF for k in (3, 2, 1, 0))
    counts = {unpack(v): int(k) for v, k in zip(u, c, strict=True)}
    symbols = len({k[-1] for k in counts})
    for probe in ("abra", "bad", "cc", "zab"):
        cp, _, s, e, _ = langid.read([probe])
        g, _ = langid.grams(cp, s, e)
        want = sum(np.log(brute_kn(counts, symbols, 4, unpack(v))) for v in g)
        assert m.words(cp, s, e)[0, 0] == pytest.approx(want, rel=1e-4)


def test_languages(spark):
    rng = np.random.default_rng(14)
    parts = {"xx": ["ba", "ko", "mi", "tu"], "yy": ["sch", "ung", "ein", "keit"], "zz": ["ção", "lho", "nha", "êm"]}
    texts, lang = [], []
    for i in range(300):
        k = ["xx", "yy", "zz"][i % 3]
        texts.append(" ".join("".join(rng.choice(parts[k], size=3)) for _ in range(30)))
        lang.append(k if i % 7 else None)
    odd = [*texts, None, "", "123 !?", "漢字" * 50, "\u0301\u0301"]
    df = frame(spark, odd, lang=[*lang, "xx", "yy", None, None, None])
    m = langid.train(df.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r.found for r in langid.with_language(df, m).collect()}
    assert all(got[i].lang == ["xx", "yy", "zz"][i % 3] and 0 <= got[i].score <= 1 and not got[i].rejected for i in range(300))
    assert [got[300 + k].lang for k in range(3)] == ["und"] * 3 and got[304].lang == "und" and got[303].rejected and got[303].lang in parts
    none = langid.train(df.limit(0))
    assert {r.found.lang for r in langid.with_language(df, none).collect()} == {"und"}


def test_sample_of_languages_leaves_none_out(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, "rare").when(F.col("id") % 3 == 0, "b").otherwise("a").alias("lang"))
    n = {r.lang: r["count"] for r in langid.sample(rows, "lang", "doc_id", 3000, 100).groupBy("lang").count().collect()}
    assert n["rare"] == 30 and 850 < n["b"] < 1150 and 1800 < n["a"] < 2200
    assert langid.sample(rows.limit(0), "lang", "doc_id").count() == 0


def test_hold_out_rule(spark):
    df = spark.range(50).select(C.held_out(F.col("id"), 3, 1).alias("h"), "id")
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in df.collect())
