"""MinHash near-duplicate groups: fast similarity sketching, banding, exact verification.

Words are what stands between blanks (space, \\t..\\r), A-Z lower-cased; a
document's set holds its distinct five-word shingles as 64-bit hashes (with
fewer words, the whole sequence as one). Two documents are linked when their
sets' Jaccard similarity is at least ``threshold``.

* Sketch: each round hashes every shingle to a bin and a value; a bin keeps
  its least value, earlier rounds first. After ``T`` rounds, round ``T + j``
  fills bin ``j``, so every coordinate is filled after ``2 T`` rounds at most.
* Classes: documents of equal sets become one node, so copies cost nothing.
* Banding: ``BANDS`` bands of ``ROWS`` coordinates of a byte. A pair at similarity 0.75
  meets in no band with probability (1 - 0.75**5)**40 = 2e-5.
* First pass: each bucket links its members to its least member, verified on
  the full sets: a large group of near copies costs one pair for each member.
* Further passes: in buckets that still hold several components, the strays
  (members outside the bucket's largest component) are compared with all
  members, in blocks of bounded size: a bucket of many near copies and few
  strays costs work in proportion to its size. Pairs of different components
  whose sketches put them at ``SCREEN`` or more are verified on the full sets:
  in one pass each stray with its nearest, which joins most of a group at one
  pair a stray, and in the last pass all that are still apart and that a
  sharper sketch of ``SHARP`` coordinates does not rule out (at 4.6 standard
  deviations).

No bucket is capped and no pair of different components is left out. Joins on
buckets, on the nodes of a star and on the documents of a pair deal hot keys
over several partitions (:func:`common.spread_join`).

Defined cases: null or blank text has an empty set and is linked with nothing;
rows that repeat a doc_id are one document, linked by any of its texts; an empty table gives
an empty result; other columns are kept by :func:`drop_near_duplicates` and
ignored by :func:`near_duplicates`. ``doc_id`` is an integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexeum.llm import common as C

WORDS, ROWS, BANDS, SCREEN = 5, 5, 40, 0.6
T = ROWS * BANDS
BLOCK = 500
#: Index pairs held at once; sizes of linked sets are at least in this ratio, in percent.
PAIRS, LENGTHS = 50_000, 75
#: Coordinates of the sharp sketch, and the bits in which a pair at 0.75 differs at most: 512 are expected, with a deviation of 25.
SHARP, SHARP_BITS = 2048, 628
_EMPTY = np.iinfo(np.uint64).max


def shingle_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in order, and where each row's begin."""
    data, off = C.utf8(texts)
    h, _, _, ptr = C.words(data, off, C.NOT_BLANK)
    grams = C.ngrams(h, n)
    out, sizes = [], np.zeros(len(off) - 1, np.int64)
    for k, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = C.ngrams(h[a:b], b - a)
        else:
            continue
        sizes[k] = len(s)
        out.append(s)
    return (np.concatenate(out) if out else np.empty(0, C.U)), np.concatenate(([0], np.cumsum(sizes)))


def sketch(elems: np.ndarray, ptr: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketches, one row of ``t`` coordinates for each set; empty sets stay unfilled."""
    n = len(ptr) - 1
    out = np.full(n * t, _EMPTY, C.U)
    row = np.repeat(np.arange(n), np.diff(ptr))
    e, live = elems, np.flatnonzero(np.diff(ptr) > 0)
    for i in range(2 * t):
        if not len(live):
            break
        x = C.mix(e + C.U(((i + 1) * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF))
        bins = ((x >> C.U(32)) * C.U(t) >> C.U(32)).astype(np.int64) if i < t else np.full(len(e), i - t)
        np.minimum.at(out, row * t + bins, (x & C.U(0xFFFFFFFF)) | C.U(i << 32))
        full = (out.reshape(n, t)[live] != _EMPTY).all(1)
        if full.any():
            live = live[~full]
            keep = np.zeros(n, bool)
            keep[live] = True
            keep = keep[row]
            e, row = e[keep], row[keep]
    return out.reshape(n, t)


FEATURES = "struct<n:bigint,key:binary,bands:array<bigint>,sketch:binary>"


def _features(texts: pa.Array) -> pa.Array:
    data, off = C.utf8(texts)
    parts = []
    texts = texts.fill_null("") if texts.null_count else texts
    for a, b in C.slices(off):
        elems, ptr = shingle_sets(texts.slice(a, b - a))
        n = np.diff(ptr)
        some = n > 0
        sk = sketch(elems, ptr)
        small = (C.mix(sk[some]) >> C.U(56)).astype(np.uint8)  # bands are of these bytes, so that equal bytes are an equal band
        coef = C.mix(np.arange(1, T + 1, dtype=C.U) * C.U(0xE7037ED1A0B428DB)) | C.U(1)
        bands = C.mix((C.mix(small.astype(C.U) + C.U(3)) * coef).reshape(len(small), BANDS, ROWS).sum(2, dtype=C.U) + np.arange(BANDS, dtype=C.U))
        heads = ptr[:-1][some]
        ids = np.stack([np.add.reduceat(C.mix(elems ^ C.U(s)), heads) if len(heads) else np.empty(0, C.U) for s in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5)], 1)
        where = np.cumsum(some) - 1
        keys = [ids[w].tobytes() if s else None for w, s in zip(where, some, strict=True)]
        sketches = [small[w].tobytes() if s else None for w, s in zip(where, some, strict=True)]
        lists = C.list_array(bands.view(np.int64).ravel(), np.concatenate(([0], np.cumsum(some * BANDS))), pa.int64())
        parts.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(sketches, pa.binary())], ["n", "key", "bands", "sketch"]))
    kind = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
    return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)


def _sets(texts: pa.Array) -> pa.Array:
    _, off = C.utf8(texts)
    parts = []
    texts = texts.fill_null("") if texts.null_count else texts
    for a, b in C.slices(off):
        elems, ptr = shingle_sets(texts.slice(a, b - a))
        parts.append(C.list_array(elems.view(np.int64), ptr, pa.int64()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


def _sharp(sets: pa.Array) -> pa.Array:
    """Two bits of each of ``SHARP`` coordinates of every set."""
    parts = []
    for a in range(0, len(sets), 256):
        some = sets.slice(a, 256)
        ptr = np.concatenate(([0], np.cumsum(pc.list_value_length(some).to_numpy())))
        sk = C.mix(sketch(some.flatten().to_numpy(zero_copy_only=False).view(C.U), ptr, SHARP))
        bits = np.unpackbits((sk >> C.U(56)).astype(np.uint8)[:, :, None], axis=2)[:, :, :2]
        parts += [r.tobytes() for r in np.packbits(bits.reshape(len(sk), -1), axis=1)]
    return pa.array(parts, pa.binary())


def _stars(edges: DataFrame) -> bool:
    """Is every node either the least of its component or on one edge, to that least?"""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("x"), one.alias("out"), none.alias("in")).union(edges.select("b", none, one))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR out = 1 AND in = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node on an edge (a, b); comp is the least node reachable.

    Alternating large-star and small-star rounds: each is one aggregation of
    the edge table, written to the shared folder; rounds are logarithmic in
    practice. The edges of a hot node are dealt over several partitions.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = C.stored(edges, "edges")
    while not _stars(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = C.stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
        # large star: every greater neighbour of a node goes to the node's least neighbour
        large = C.stored(C.spread_join(both.filter("b > a"), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: the node and its lesser neighbours go to the least of these
        lesser = C.stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lesser")
        small = C.spread_join(large, lesser, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lesser.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        last, edges = edges, C.stored(small, "edges")
        C.forget(last, least, large, lesser)
    return edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp").union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _within(sizes: list[tuple[int, int, int, bool]]):
    """Index pairs of groups (start, left members, end, same): inside one block, or between two; in pieces of bounded size."""
    p_out, q_out, held = [], [], 0
    for a, mid, b, same in sizes:
        if same:
            p, q = np.triu_indices(b - a, 1)
            p, q = p + a, q + a
        else:
            p = np.repeat(np.arange(a, mid), b - mid)
            q = np.tile(np.arange(mid, b), mid - a)
        for k in range(0, len(p), PAIRS):
            p_out.append(p[k : k + PAIRS])
            q_out.append(q[k : k + PAIRS])
            held += len(p_out[-1])
            if held >= PAIRS:
                yield np.concatenate(p_out), np.concatenate(q_out)
                p_out, q_out, held = [], [], 0
    if held:
        yield np.concatenate(p_out), np.concatenate(q_out)


def _screened(best_only: bool):
    """Pairs of different components in a block of a bucket whose sketches are near enough: all, or each stray's nearest.

    A block holds strays (side 0) and members (side 1), or a small bucket's
    members once (side 2). Rows come sorted by bucket, block and side; a block
    that a batch cuts waits for the next. A pair that shares several buckets is
    given by the first, and one of two strays by the block in which the lesser
    is the stray.
    """
    most = int((1 - SCREEN) * T * 4)  # bits that differ: half of a byte where coordinates differ

    def pairs(t: pa.Table, cuts: np.ndarray):
        rep, comp, n, side, pos = (t[c].to_numpy() for c in ("rep", "comp", "n", "side", "pos"))
        stray = t["stray"].to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(t), T)
        sk = raw.view(np.uint64)
        sharp = None if best_only else np.frombuffer(b"".join(t["sharp"].to_pylist()), np.uint64).reshape(len(t), -1)
        left = np.add.reduceat(side == 0, cuts[:-1])
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        found = []
        for p, q in _within([(a, a + m, b, bool(side[a] == 2)) for a, m, b in zip(cuts[:-1].tolist(), left.tolist(), cuts[1:].tolist(), strict=True)]):
            ok = (comp[p] != comp[q]) & (100 * np.minimum(n[p], n[q]) >= LENGTHS * np.maximum(n[p], n[q]))
            ok &= (side[p] == 2) | ~stray[q] | (rep[p] < rep[q])
            p, q = p[ok], q[ok]
            far = np.bitwise_count(sk[p] ^ sk[q]).sum(1, dtype=np.int32)
            ok = far <= most
            if not best_only:
                ok[ok] = np.bitwise_count(sharp[p[ok]] ^ sharp[q[ok]]).sum(1, dtype=np.int32) <= SHARP_BITS
            p, q, far = p[ok], q[ok], far[ok]
            if not best_only and len(p):
                meet = (raw[p] == raw[q]).reshape(len(p), BANDS, ROWS).all(2)
                ok = meet.argmax(1) == pos[p]
                p, q, far = p[ok], q[ok], far[ok]
            found.append((p, q, far))
        p, q, far = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        if best_only and len(p):
            back = stray[q]  # members of the largest component look for no one
            front = stray[p]
            node, other, far = np.concatenate([p[front], q[back]]), np.concatenate([q[front], p[back]]), np.concatenate([far[front], far[back]])
            order = np.lexsort((rep[other], far, rep[node], group[node]))
            node, other = node[order], other[order]
            head = np.append(True, node[1:] != node[:-1])
            p, q = node[head], other[head]
        both = np.unique(np.stack([np.minimum(rep[p], rep[q]), np.maximum(rep[p], rep[q])], 1), axis=0)
        return pa.record_batch([pa.array(both[:, 0].copy(), pa.int64()), pa.array(both[:, 1].copy(), pa.int64())], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            k = np.stack([t[c].to_numpy() for c in ("band", "i", "j")], 1)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            if len(cuts):
                yield pairs(t.slice(0, cuts[-1]), np.concatenate(([0], cuts)))
                t = t.slice(cuts[-1])
            held = t
        if held is not None and len(held):
            yield pairs(held, np.array([0, len(held)]))

    return run


def _grid(size: Column, strays: Column, stray: Column, h: Column) -> Column:
    """The blocks (i, j, side) of a bucket that a member goes to: i numbers blocks of strays, j blocks of all members."""
    rows, cols = F.ceil(strays / BLOCK).cast("int"), F.ceil(size / BLOCK).cast("int")
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    as_member = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: place(i, F.pmod(h, cols), 1))
    as_stray = F.transform(F.sequence(F.lit(0), cols - 1), lambda j: place(F.pmod(F.xxhash64(h), rows), j, 0))
    return F.when(size <= BLOCK, F.array(place(F.lit(0), F.lit(0), 2))).when(stray, F.concat(as_stray, as_member)).otherwise(as_member)


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``comp`` (node, comp) with further links (a, b) between nodes."""
    of = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    lifted = C.stored(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct(), "lifted")
    top = C.stored(components(lifted).withColumnRenamed("comp", "to"), "top")
    old = comp.join(top, comp["comp"] == top["node"], "left").select(comp["node"], F.coalesce("to", "comp").alias("comp"))
    new = top.select("node", F.col("to").alias("comp")).join(comp.select("node"), "node", "left_anti")
    out = C.stored(old.union(new), "comp")
    C.forget(lifted, top)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b), stored, whose full sets reach the threshold, stored. Only the sets of pairs move, and a document of many pairs is dealt over several partitions."""

    def with_sets(rows: DataFrame, side: str) -> DataFrame:
        n = C.stored(pairs.groupBy(side).agg(F.count("*").alias("_n")), "sides")
        some, _ = C.split_by(sets.select(F.col("rep").alias(side), F.col("set").alias(f"set_{side}")), side, C.bitmap(n, side))
        return C.spread_join(rows, n.join(some, side), side, "_n")

    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    met = with_sets(with_sets(pairs, "a"), "b").withColumn("both", both)
    out = C.stored(met.filter(F.col("both") * 100 >= percent * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b"), tag)
    C.forget(pairs)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold_percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    if threshold_percent < LENGTHS:
        raise ValueError("bands and screens are made for similarities of 0.75 and more")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    features = F.arrow_udf(_features, FEATURES).asNondeterministic()
    s = C.stored(base.select("doc_id", features("text").alias("f")).select("doc_id", "f.*"), "sketches")
    known = s.filter("n > 0 and doc_id is not null")
    classes = C.stored(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    repeated = not s.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    # the sketches of copies go, and all others stay where they are
    copies = C.stored(C.spread_join(known.select("key", "doc_id"), classes.filter("copies > 1"), "key", "copies").filter("doc_id <> rep").select("doc_id", "key"), "copies")
    maybe, rest = C.split_by(known, "doc_id", C.bitmap(copies, "doc_id"))
    first_of = rest.unionByName(maybe.join(copies, ["doc_id", "key"], "left_anti").select(*known.columns)).withColumnRenamed("doc_id", "rep")
    rows = first_of.select("rep", F.posexplode("bands").alias("pos", "band"))
    shared = C.stored(rows.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("size")).filter("size > 1"), "shared")
    met, _ = C.split_by(rows, "band", C.bitmap(shared, "band"))  # most bands are of one document and do not move
    members = C.stored(C.spread_join(met, shared.withColumn("_n", F.col("size")), "band", "_n"), "members")
    sets_of = F.arrow_udf(_sets, "array<bigint>").asNondeterministic()
    owners = C.stored(members.select("rep").distinct(), "owners")
    bits = C.bitmap(owners, "rep")
    some, _ = C.split_by(base, "doc_id", bits)  # their texts, and a few more that nothing asks for
    some = some.dropDuplicates(["doc_id", "text"]) if repeated else some
    sets = C.stored(some.select(F.col("doc_id").alias("rep"), sets_of("text").alias("set")), "sets")
    small = C.stored(C.split_by(first_of.select("rep", "n", "sketch"), "rep", bits)[0], "small")
    small = small.dropDuplicates() if repeated else small
    star = C.stored(members.filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    first = _verified(star, sets, threshold_percent, "links")
    comp = C.stored(components(first), "comp")
    C.forget(shared, owners, bits, copies, first)

    # what is still apart: buckets with several components, in blocks; first each stray's nearest, at last all
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for best_only in (True, False):
        known = C.stored(members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "known")
        each = known.groupBy("band", "comp").agg(F.count("*").alias("k"))
        mixed = each.groupBy("band").agg(F.sum("k").alias("_n"), F.max("k").alias("k"), F.max_by("comp", "k").alias("main"), F.count("*").alias("comps")).filter("comps > 1")
        mixed = C.stored(mixed.select("band", "_n", "main", (F.col("_n") - F.col("k")).alias("strays")), "strays")
        if mixed.isEmpty():  # all documents of a band are of one component: nothing is apart
            C.forget(known, mixed)
            break
        block = part = C.stored(C.spread_join(known, mixed, "band", "_n").join(small, "rep"), "mixed")
        cols = ["pos", "rep", "comp", "n", "sketch"]
        if not best_only:
            wanted = C.stored(part.select("rep").distinct(), "wanted")
            sharp = C.split_by(sets, "rep", C.bitmap(wanted, "rep"))[0].select("rep", F.arrow_udf(_sharp, "binary").asNondeterministic()("set").alias("sharp"))
            part = part.join(sharp, "rep")
            cols.append("sharp")
        part = part.withColumn("stray", F.col("comp") != F.col("main"))
        copies = _grid(F.col("size"), F.col("strays"), F.col("stray"), F.xxhash64("rep"))
        dealt = part.select("band", *cols, "stray", F.explode(copies).alias("at")).select("band", "at.*", *cols, "stray")
        dealt = dealt.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", "side")
        pairs = C.stored(dealt.mapInArrow(_screened(best_only), "a bigint, b bigint").distinct(), "pairs")
        links = _verified(pairs, sets, threshold_percent, "links")
        C.forget(block, known, mixed)
        if not links.isEmpty():
            last, comp = comp, _joined(comp, links)
            C.forget(last)
        C.forget(links)
    C.forget(members, sets)
    label = C.stored(classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "copies", F.coalesce("comp", "rep").alias("component_id")), "label")
    of = s.select("doc_id", "n", "key")
    named = C.spread_join(of.filter("n > 0 and doc_id is not null"), label, "key", "copies").select("doc_id", "n", "component_id")
    alone = of.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = C.stored(named.union(alone).withColumnRenamed("n", "n_shingles"), "found")
    C.forget(s, classes, comp, label)
    if not repeated:
        return found
    # an id whose rows have several texts joins the classes of these
    several = C.stored(found.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("c")).filter("a <> c").select("doc_id", "a"), "several")
    if several.isEmpty():
        return found
    top = C.stored(components(found.join(several, "doc_id").select("a", F.col("component_id").alias("b"))), "top")
    return found.join(top.withColumnRenamed("node", "component_id"), "component_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "component_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold_percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group: the one of the least doc_id. Columns stay as they are.

    Rows that repeat both doc_id and text count as copies: one of them stays.
    A row without doc_id stays. A document of several texts stays or goes with all of them.
    """
    found = C.stored(near_duplicates(docs, text, doc_id, threshold_percent), "groups")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    maybe, stay = C.split_by(docs, doc_id, C.bitmap(gone, doc_id))  # most texts stay where they are
    out = stay.unionByName(maybe.join(gone, doc_id, "left_anti").select(*C.columns(docs)))
    repeated = found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1")
    return out if repeated.isEmpty() else out.dropDuplicates([doc_id, text])
