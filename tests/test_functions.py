"""Column functions on the cases that differ between engines."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexeum.functions import labels as L
from lexeum.functions import text as T


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, f, values, kind="string"):
    return [r.o for r in column(spark, values, kind).withColumn("o", f(F.col("v"))).orderBy("i").collect()]


SPACES = [" a ", "　b", "c\x85", "\x1cd\x1f", " e \t", "​f", "", "   ", None]


def test_strip_is_unicode(spark):
    assert apply(spark, T.strip, SPACES) == [None if s is None else s.strip() for s in SPACES]


def test_word_count_is_unicode(spark):
    values = ["a b", " a  b ", "a b", "", "a\x1cb　c", None]
    assert apply(spark, T.word_count, values) == [None if v is None else len(v.split()) for v in values]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("<p>Hi</p> there", "Hi there"),
        ("see https://x.y/z now", "see [URL] now"),
        ("www.a.b", "[URL]"),
        ("<https://a.b>", ""),
        ("a < b > c", "a c"),
        ("a  b\n\nc", "a b c"),
        ("$1 \\ 😀 HeLLo!", "$1 \\ 😀 HeLLo!"),
        (None, ""),
        ("   ", ""),
    ],
)
def test_cleaned(spark, raw, want):
    assert apply(spark, T.cleaned, [raw]) == [want]


def test_hash_is_md5(spark):
    values = ["", "abc", "ä😀"]
    assert apply(spark, T.content_hash, values) == [hashlib.md5(v.encode()).hexdigest() for v in values]


def test_na_strings_and_placeholders(spark):
    assert apply(spark, T.na_to_null, ["NA", "null", "x", "", "Null"]) == [None, None, "x", None, "Null"]
    assert apply(spark, T.no_placeholder, ["None", " <NA> ", "nan", "none", None, " x "]) == ["", "", "", "none", "", "x"]
    assert apply(spark, T.blank_to_null, [" ", " ", "train", None]) == [None, None, "train", None]


def test_newlines_are_literal(spark):
    assert apply(spark, T.newlines, ["aNEWLINE_TOKENNEWLINE_TOKENb", None]) == ["a\n\nb", None]


def test_fallback_and_numeric(spark):
    df = spark.createDataFrame([("a", "t"), ("", "t"), ("", "")], "b string, t string")
    assert [r[0] for r in df.select(T.fallback(F.col("b"), F.col("t"))).collect()] == ["a", "t", ""]
    assert apply(spark, T.numeric, ["12", "1a", "", None]) == [True, False, False, None]


def test_majority_of_missing_is_zero(spark):
    assert apply(spark, L.majority, [0.5, 0.49, None, 1.0], "double") == [1.0, 0.0, 0.0, 1.0]


def test_flags_take_missing_for_true(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, None), (-1, 0)], "a int, b int")
    assert [r[0] for r in df.select(L.either_flag(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 1.0, 1.0]


def test_mapping_and_membership(spark):
    assert apply(spark, lambda c: L.mapped(c, {1: 0.0, -1: 1.0}), [1, -1, 0, 7, None], "int") == [0.0, 1.0, None, None, None]
    assert apply(spark, lambda c: L.member(c, ["a"]), ["a", "b", None]) == [True, False, False]
    assert apply(spark, lambda c: L.member(c, []), ["a"]) == [False]


def test_kappa_names(spark):
    values = [-0.1, 0.0, 0.2, 0.21, 0.4, 0.6, 0.8, 0.81, 1.0, None]
    want = ["poor", None, "slight", "fair", "fair", "moderate", "substantial", "almost perfect", "almost perfect", None]
    assert apply(spark, L.kappa_bucket, values, "double") == want


def test_four_classes(spark):
    four = ["Hatespeech (enough context)", "Hatespeech (not enough context)", "Not Hatespeech (not enough context)", "Not Hatespeech (enough context)", None]
    assert apply(spark, L.hate_or_not, four) == ["Hatespeech", "Hatespeech", "Not Hatespeech", "Not Hatespeech", "Not Hatespeech"]
    assert apply(spark, L.context, four) == ["Enough Context", "Not Enough Context", "Not Enough Context", "Enough Context", "Enough Context"]
    assert apply(spark, L.three_classes, four) == [four[0], "Not Enough Context", "Not Enough Context", four[3], None]


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, None)], "a double, b double")
    assert df.select(L.correlation(F.col("a"), F.col("b"))).first()[0] is None
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (9.0, None)], "a double, b double")
    assert df.select(L.correlation(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1.0)


def test_numbers_round_as_python_rounds(spark):
    import random
    import struct

    rng = random.Random(5)
    values = [0.0, -0.0, 6.25, 18.75, 0.125, 0.375, 0.15, 2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -2.5, -0.04, 0.05, 1e-7, 5e-324, 4.35, 99.995, 1e15, 4503599627370495.5, 1e16, 1e17 / 3, 123456789.0625, float("nan"), float("inf"), float("-inf"), None]
    values += [rng.uniform(-1000, 1000) for _ in range(300)] + [rng.randrange(10**6) / 2 ** rng.randrange(1, 12) for _ in range(300)] + [round(rng.uniform(0, 100), 3) for _ in range(300)]
    values += [v for v in (struct.unpack("<d", struct.pack("<Q", rng.getrandbits(62)))[0] for _ in range(300)) if v < 1e12]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for d in (0, 1, 2, 3, 4, 9):
        for r in df.select("x", T.fixed(F.col("x"), d).alias("s"), T.rounded(F.col("x"), d).alias("r"), T.rounded_scaled(F.col("x"), d).alias("n")).collect():
            if r.x is None:
                assert r.s is None and r.r is None
                continue
            if r.x == r.x and abs(r.x) * 10**d < 9e18 and abs(r.x) < 2**52 or r.x != r.x:
                assert r.s == f"{r.x:.{d}f}", (r, d)
            if r.x == r.x and abs(r.x) < 1e15 and abs(r.x) * 10**d < 2**53:
                assert r.r == round(r.x, d), (r, d)
    assert [r[0] for r in df.limit(5).select(T.percent(F.col("x"), 1, blank=False)).collect()] == ["0.0%", "-0.0%", "6.2%", "18.8%", "0.1%"]


def test_ordinary_numbers_are_rounded_in_doubles(spark, monkeypatch):
    """Halves, what is beside them and large numbers are exact without the slow decimals."""
    import math
    import random

    rng = random.Random(7)
    failing = lambda x, digits: F.raise_error(F.lit("decimals were used")).cast("long")
    monkeypatch.setattr(T, "_nearest_whole", failing)
    for d in range(8):
        halves = [(rng.randrange(10 ** rng.randrange(1, 14)) + 0.5) / 10**d for _ in range(200)] + [(2**50 - rng.randrange(1, 99) / 8) / 10**d for _ in range(50)]
        values = [s * v for h in halves for v in (h, math.nextafter(h, 0), math.nextafter(h, math.inf)) for s in (1, -1) if v * 10.0**d < 2**50] + [0.0, -0.0, 5e-324, 1e-300, None]
        for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", T.fixed(F.col("x"), d).alias("s"), T.rounded(F.col("x"), d).alias("r")).collect():
            assert r.s == (None if r.x is None else f"{r.x:.{d}f}"), (r, d)
            assert r.r == (None if r.x is None else round(r.x, d)), (r, d)
