"""Secret scans: base patterns, and strings that a character model finds random.

Base spans are of three kinds, each read leftmost without overlaps; matches
that fail their test are dropped and what they cover is not read again:

    assign  a name like password or token, = or :, and a value of 6 characters or more
    access  AKIA and capitals or digits, 20 characters or more
    hex     24 or more small hexadecimal digits

The method adds spans of kind ``random``: runs of letters, digits and + / _ = -
of ``LEAST`` characters or more, with a letter and a digit among them (else they
are numbers or names, however odd), in what base spans leave of the text, whose log-likelihood ratio between two Markov models of characters, of random strings
and of ordinary identifiers, reaches the threshold. Both models count which
character follows which (a string's beginning is a character of its own), with
``SMOOTH`` added to each count. The labelled samples come from about
``TRAIN_ROWS`` documents, chosen by hash (all, if there are fewer): ordinary are
the distinct runs of 6 characters or more outside base spans that are not to be
judged themselves (so ``LEAST`` and more only without digits or letters); random
are the values of base spans that hold a letter and a digit, and, lest all random
strings look hexadecimal, the SHA-256 of each text written in hexadecimal digits
of either case and in base 64.

A string of the ordinary model reaches a ratio of 2**t with a chance under
2**-t. The threshold is log2(runs / ``CHANCE``) bits, with all runs of all
documents counted, so that the chance of any false mark in the whole corpus, as
far as the model holds, is ``CHANCE``. Ratios are whole thousandths of a bit,
hence exact sums.

All of this is columns and aggregates: a document's spans come from its own row
and the model, an array of 68 * 67 numbers. Positions are running sums over the
pieces between matches, in blocks, so that a text of many matches costs its
length.

Defined cases: null text is empty and has no spans; offsets are code points,
ends exclusive; kinds are taken out one after another (assign, access, hex)
before runs are looked for; copies and repeated rows have the same spans;
without documents the table is empty; other columns stay, and the new one's name
gets underscores until it is free.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from math import ceil, log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeum.llm import common as C

#: The base patterns. A value is the first group, or the whole match.
NAMES = "password|passwd|secret|token|api_?key"
PATTERNS = {"assign": rf"""(?i:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}"}
#: What a text must hold to have any match, quicker to look for.
QUICK = {"assign": r"""(?i:[dtny])["']?\x20*[:=]""", "access": "AKIA", "hex": "[0-9a-f]{24}", "random": "[0-9]"}
LEAST_VALUE = {"assign": 6, "access": 20, "hex": 24}
KINDS = (*PATTERNS, "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
LEAST, LEAST_SAMPLE, TRAIN_ROWS, SMOOTH, CHANCE, BLOCK = 16, 6, 20_000, 0.5, 0.01, 256


#: Whole runs with a digit and a letter; the look behind only saves tries inside a run.
RUNS = f"(?<!{RUN})(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z]){RUN}{{{LEAST},}}"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def with_matches(df: DataFrame, text: str, pattern: str, quick: str, least: int, name: str, rest: str) -> DataFrame:
    """``df`` with an array of the matches whose value (its first group, or all of it) has ``least`` characters (start, end, value), and the text in which these are blanks.

    A match starts where the pieces and matches before it end. Sums run inside
    blocks of ``BLOCK`` matches, and over the blocks.
    """
    x, steps, blocks, sums, offsets, starts = (C.fresh(df, f"_{c}") for c in ("x", "steps", "blocks", "sums", "offsets", "starts"))
    t, said, col = F.col(text), F.lit(pattern), lambda *path: F.col(".".join(path))
    found = {"pieces": F.split(t, pattern, -1), "all": F.regexp_extract_all(t, said, F.lit(0))}
    values = "all"
    if re.compile(pattern).groups:
        found[values := "values"] = F.regexp_extract_all(t, said, F.lit(1))
    df = df.withColumn(x, F.when(t.rlike(quick) & t.rlike(pattern), F.struct(*(c.alias(k) for k, c in found.items()))))
    before = F.slice(col(x, "pieces"), F.lit(1), F.size(col(x, "all")))
    df = df.withColumn(steps, F.zip_with(before, col(x, "all"), lambda p, m: F.length(p) + F.length(m)))
    last = F.floor((F.size(col(steps)) - 1) / BLOCK).cast("int")
    df = df.withColumn(blocks, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(col(steps), b * BLOCK + 1, F.lit(BLOCK))))
    df = df.withColumn(sums, F.transform(col(blocks), _sum))
    df = df.withColumn(offsets, F.transform(col(sums), lambda _, i: _sum(F.slice(col(sums), F.lit(1), i))))
    df = df.withColumn(starts, F.flatten(F.zip_with(col(blocks), col(offsets), lambda block, at: F.transform(block, lambda _, j: at + _sum(F.slice(block, F.lit(1), j))))))
    each = F.filter(F.arrays_zip(col(starts).alias("s"), before.alias("p"), col(x, "all").alias("m"), col(x, values).alias("v")), lambda e: F.length(e["v"]) >= least)
    at = F.transform(each, lambda e: F.struct((e["s"] + F.length(e["p"])).alias("start"), (e["s"] + F.length(e["p"]) + F.length(e["m"])).alias("end"), e["v"].alias("value")))
    blank = lambda w: F.when(F.length(w["v"]) >= least, F.repeat(F.lit(" "), F.length(w["m"]))).otherwise(w["m"])
    left = F.zip_with(col(x, "pieces"), F.arrays_zip(col(x, "all").alias("m"), col(x, values).alias("v")), lambda p, w: F.concat(p, F.coalesce(blank(w), F.lit(""))))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    df = df.withColumn(name, F.coalesce(at, none)).withColumn(rest, F.coalesce(F.array_join(left, ""), t))
    return df.drop(x, steps, blocks, sums, offsets, starts)


class Spans(NamedTuple):
    """Column names: an array of matches for each base kind and for runs (start, end, value), and the text without base spans."""

    assign: str
    access: str
    hex: str
    runs: str
    rest: str


def with_parts(df: DataFrame, text: str) -> tuple[DataFrame, Spans]:
    """``df`` with the base spans and the runs of ``LEAST`` characters with a letter and a digit that they leave."""
    own = Spans(*(C.fresh(df, f"_{f}") for f in Spans._fields))
    whole, gone, both, rest, drop = (C.fresh(df, f"_{c}") for c in ("whole", "gone", "both", "left", "drop"))
    df = df.withColumn(whole, F.coalesce(F.col(text), F.lit(""))).withColumn(own.rest, F.col(whole))
    for i, (k, pattern) in enumerate(PATTERNS.items()):
        # a kind is read in the whole text; where other kinds were found too, it is taken out of what they have left
        df = with_matches(df, whole, pattern, QUICK[k], LEAST_VALUE[k], own[i], gone)
        here = F.size(own[i]) > 0
        if i:
            others = sum((F.size(o) for o in own[:i]), F.lit(0)) > 0
            df = df.withColumn(both, F.when(here & others, F.col(own.rest)))
            df = with_matches(df, both, pattern, QUICK[k], LEAST_VALUE[k], drop, rest)
            df = df.withColumn(gone, F.coalesce(F.col(rest), F.col(gone))).drop(both, rest, drop)
        df = df.withColumn(own.rest, F.when(here, F.col(gone)).otherwise(F.col(own.rest))).drop(gone)
    return with_matches(df, own.rest, RUNS, QUICK["random"], LEAST, own.runs, gone).drop(whole, gone), own


def _codes(value: Column) -> Column:
    """Each character's place in the alphabet, from 1; 0 for all others."""
    return F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def samples(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(random, value): the labelled strings of about ``train_rows`` documents, each once."""
    total, bits = docs.count(), 32
    cut = (1 << bits) if total <= train_rows else int(train_rows / total * (1 << bits))
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    some = docs.select(F.col(text).alias("text"), key.alias("h")).filter(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") < cut)
    parts, own = with_parts(some, "text")
    plain = parts.select(F.lit(False).alias("random"), F.explode(F.regexp_extract_all(own.rest, F.lit(f"{RUN}{{{LEAST_SAMPLE},}}"), F.lit(0))).alias("value"))
    plain = plain.filter((F.length("value") < LEAST) | ~F.col("value").rlike("[0-9]") | ~F.col("value").rlike("[A-Za-z]"))
    said = parts.select(F.lit(True).alias("random"), F.explode(F.transform(F.concat(*own[: len(PATTERNS)]), lambda m: m["value"])).alias("value"))
    said = said.filter(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    drawn = some.select(F.lit(True).alias("random"), F.explode(F.array(F.col("h"), F.upper("h"), F.replace(F.base64(F.unhex("h")), F.lit("="), F.lit("")))).alias("value"))
    return plain.unionAll(said).unionAll(drawn).distinct()


def weights(strings: DataFrame) -> list[int]:
    """For each character after each (none: 0), by place: thousandths of a bit of log-likelihood ratio."""
    n = len(ALPHABET)
    pairs = strings.select("random", _codes(F.col("value")).alias("c")).select("random", F.explode(F.arrays_zip(F.slice(F.concat(F.array(F.lit(0)), "c"), F.lit(1), F.size("c")).alias("a"), F.col("c").alias("b"))).alias("p")).select("random", "p.a", "p.b").filter("b > 0")
    seen = pairs.groupBy("a", "b").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    grid = strings.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(n))).alias("a")).select("a", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("b"))
    all_ = Window.partitionBy("a")
    share = lambda c: F.log2((F.coalesce(F.col(c), F.lit(0)) + SMOOTH) / (F.coalesce(F.sum(c).over(all_), F.lit(0)) + SMOOTH * n))
    rows = grid.join(seen, ["a", "b"], "left").select("a", "b", F.round(1000 * (share("r") - share("o"))).cast("int").alias("w"))
    return [r.w for r in rows.orderBy("a", "b").collect()]  # 68 * 67 rows


class Model(NamedTuple):
    """The models' ratio for each pair of characters, and the ratio from which a run is marked; thousandths of a bit."""

    weights: list[int]
    threshold: int

    def score(self, value: Column) -> Column:
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")  # folded to one constant
        start = F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("s"))
        step = lambda acc, b: F.struct(b.alias("a"), (acc["s"] + F.get(table, acc["a"] * len(ALPHABET) + b - 1)).alias("s"))
        return F.aggregate(_codes(value), start, step, lambda acc: acc["s"])


def learn(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS, chance: float = CHANCE) -> Model:
    """Both models from the labelled samples, and the threshold from the number of runs in all documents."""
    parts, own = with_parts(docs.select(F.col(text).alias("text")), "text")
    n = parts.agg(F.sum(F.size(own.runs))).first()[0] or 0
    return Model(weights(samples(docs, text, train_rows)), threshold(n, chance))


def threshold(n: int, chance: float = CHANCE) -> int:
    return ceil(1000 * log2(max(1, n) / chance))


def with_secrets(docs: DataFrame, model: Model, text: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with an array of start, end, kind and bits (of random spans), by start, then kind as listed."""
    name = C.fresh(docs, name)
    parts, own = with_parts(docs, text)

    def spans(kind: int, weight: Callable[[Column], Column]) -> Column:
        return F.transform(own[kind], lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("o"), m["end"].alias("end"), weight(m["value"]).alias("w")))

    known = [spans(k, lambda _: F.lit(None).cast("long")) for k in range(len(PATTERNS))]
    scored = spans(len(PATTERNS), model.score)
    all_ = F.array_sort(F.concat(*known, F.filter(scored, lambda m: m["w"] >= model.threshold)))
    kind = lambda o: F.element_at(F.array(*map(F.lit, KINDS)), o + 1)
    shown = F.transform(all_, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), kind(m["o"]).alias("kind"), (m["w"] / 1000.0).alias("bits")))
    return parts.withColumn(name, shown).select(*C.columns(docs), name)


def joined(found: Column, kinds: Sequence[str] = KINDS) -> Column:
    """Spans of the given kinds as kind:start:end, comma-joined."""
    some = F.filter(found, lambda m: m["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")
