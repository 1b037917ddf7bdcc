"""Shared kernels and session helpers of the training-data operators.

Text kernels work on the UTF-8 buffers of Arrow batches in pieces of bounded
size, so that a worker's memory follows the batch and never the corpus.
"""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
PIECE = 1 << 20
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))


# ---------------------------------------------------------------- session


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session makes one of its own where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexeum-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Arrow batches of 1,000 rows where the session has the default of 10,000: a batch of long texts stays small in both processes."""
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    return spark


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = ready(df.sparkSession)
    path = f"{scratch_dir(spark)}/lexeum/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; what was made of them is stored itself."""
    for df in frames:
        _remove(df.sparkSession, df._stored_at)


#: Bits of a bitmap for each key, its least and most bits (64 MB), and the bits in a row.
BITS_A_KEY, LEAST_BITS, MOST_BITS, ROW_BITS = 16, 1 << 20, 1 << 29, 1 << 15


def bitmap(ids: DataFrame, key: str) -> DataFrame:
    """(bucket, bits) of the hashed keys, stored: rows of 4 KB, in all 16 bits a key, 64 MB at most.

    Beyond 2**25 keys the bits are shared by more keys: more rows that are not
    among the keys go the same way as those that are, and results stay the same.
    """
    n = ids.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * n).bit_length()))
    h = F.pmod(F.xxhash64(key), F.lit(size))
    rows = ids.select(F.shiftright(h, 15).alias("bucket"), (h % ROW_BITS).alias("pos")).groupBy("bucket").agg(F.bitmap_construct_agg("pos").alias("bits"))
    out = stored(rows, "bits")
    out._size = size
    return out


def split_by(df: DataFrame, key: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose key may be among those of the bitmap, and rows whose key is not. ``bits`` is broadcast (64 MB at most)."""
    h = F.pmod(F.xxhash64(key), F.lit(bits._size))
    pos = F.coalesce((h % ROW_BITS).cast("int"), F.lit(0))  # a null key is in no bucket
    bucket, word = fresh(df, "_bucket"), fresh(df, "_bits")
    byte = F.conv(F.hex(F.substring(F.col(word), F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(byte, F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1), pos % 8)) != 0
    small = F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(word)))
    joined = df.join(small, F.shiftright(h, 15) == F.col(bucket), "left")
    return joined.filter(bit).select(*columns(df)), joined.filter(~bit).select(*columns(df))


HOT = 50_000


def spread_join(many: DataFrame, one: DataFrame, key: str, size: str, hot: int | None = None) -> DataFrame:
    """``many`` joined to ``one`` on ``key``; ``one`` has a row a key and in ``size`` how many rows of ``many`` have it, at least.

    Keys of more than ``hot`` rows are dealt over several partitions and their
    row of ``one`` goes to each. Only these keys are broadcast: at most one for
    each ``hot`` rows of ``many``, 16 bytes each.
    """
    hot = hot or HOT
    slices = F.greatest(F.lit(1), F.ceil(F.col(size) / hot).cast("int"))
    slices_, hot_ = fresh(many, "_slices"), fresh(many, "_hot")
    big = F.broadcast(one.filter(F.col(size) > hot).select(F.col(key).alias(hot_), slices.alias(slices_)))
    at = fresh(many, "_slice")
    mine = F.when(F.col(slices_).isNotNull(), F.pmod(F.xxhash64(*columns(many)), F.col(slices_)).cast("int")).otherwise(0)
    dealt = many.join(big, F.col(key) == F.col(hot_), "left").withColumn(at, mine).drop(hot_, slices_)
    copies = one.withColumn(at, F.explode(F.sequence(F.lit(0), slices - 1)))
    return dealt.join(copies, [key, at]).drop(at, size)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """The contract's hold-out rule: crc32 of doc_id as text, modulo."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, whatever signs are in it."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def bounded_sample(df: DataFrame, key: Column, bound: int, total: int | None = None) -> DataFrame:
    """Rows whose hashed key falls under ``bound / total``: about ``bound`` rows at most, the same on each run."""
    total = df.count() if total is None else total
    if total <= bound:
        return df
    cut = int(bound / total * (1 << 31))
    return df.filter(F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 31)) < cut)


# ---------------------------------------------------------------- arrays


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    if arr.null_count:  # a null slot may span bytes
        arr = arr.fill_null("")
        return utf8(arr)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = PIECE) -> list[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row stands alone."""
    out, a, n = [], 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        out.append((a, b))
        a = b
    return out


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INV):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


@functools.lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def byte_table(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes that stand in words: the flags, and each byte's hash value with A-Z as a-z."""
    is_word = np.zeros(256, bool)
    is_word[list(word)] = True
    low = np.arange(256)
    low[65:91] += 32
    return is_word, np.where(is_word, _byte_values()[low], U(0))


#: Words are what stands between space and \t..\r.
NOT_BLANK = byte_table(bytes(sorted(set(range(256)) - {32, *range(9, 14)})))
#: Words are ASCII letters, digits and all above ASCII.
ALNUM = byte_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def words(data: np.ndarray, off: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, their first and end bytes, and each row's place among them."""
    is_word, value = table
    total, at = len(data), 0
    hashes, starts, ends = [], [], []
    while at < total:
        to = min(total, at + PIECE)
        if to < total:  # cut where no word is cut
            k = to
            while k > at:
                back = np.flatnonzero(~is_word[data[max(at, k - 4096) : k]])
                if len(back):
                    break
                k -= 4096
            edge = int(off[np.searchsorted(off, to, "right") - 1])
            cut = max(edge, max(at, k - 4096) + int(back[-1]) + 1 if k > at else 0)
            if cut <= at:  # one word longer than a piece
                rest = is_word[data[to:]]
                nxt = int(off[np.searchsorted(off, to, "right")])
                gap = np.flatnonzero(~rest[: nxt - to])
                cut = to + int(gap[0]) if len(gap) else nxt
            to = cut
        part = data[at:to]
        w = is_word[part]
        before = np.empty_like(w)
        before[:1], before[1:] = False, w[:-1]
        heads = off[(off >= at) & (off < to)] - at
        before[heads] = False
        s = np.flatnonzero(w & ~before)
        after = np.empty_like(w)
        after[-1:], after[:-1] = False, w[1:]
        after[heads[heads > 0] - 1] = False
        e = np.flatnonzero(w & ~after) + 1
        size = 1 << max(20, int(len(part)).bit_length())
        power, inverse = _powers(size)
        total_hash = np.zeros(len(part) + 1, U)
        np.cumsum(value[part] * power[: len(part)], out=total_hash[1:], dtype=U)
        hashes.append(mix((total_hash[e] - total_hash[s]) * inverse[s] + U(1)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.empty(0, U)
    s = np.concatenate(starts) if starts else np.empty(0, np.int64)
    e = np.concatenate(ends) if ends else np.empty(0, np.int64)
    return h, s, e, np.searchsorted(s, off)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` hashes in a row (the caller leaves out those across rows)."""
    k = len(h) - n + 1
    if k <= 0:
        return np.empty(0, U)
    out = h[:k].copy()
    m = U(0xD6E8FEB86659FD93)
    for j in range(1, n):
        out *= m
        out += h[j : j + k]
    return mix(out + U(n))


def inside(ptr: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each start of an n-gram over all rows: does it stay inside its row?"""
    k = max(0, total - n + 1)
    ok = np.ones(k, bool)
    for j in range(1, n):
        cut = ptr[1:-1] - j
        ok[cut[(cut >= 0) & (cut < k)]] = False
    return ok


def list_array(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, kind))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
