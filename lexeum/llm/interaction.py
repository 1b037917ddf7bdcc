"""Filter interaction audit: what each of five filters removes, in every order.

Each document has five failure flags:

    A  under 100 words
    B  100 * distinct words < 80 * words
    C  100 * capital letters A-Z > 10 * code points
    D  holds any of # $ % & * |
    E  the text stands in a document of smaller doc_id, in the whole table

Flags, part, and whether the labels call a document good or toxic are counted
once; a SQL CUBE over the flags and the part then gives, for each set of
filters, the documents that fail none of them: the row of its grouping set in
which all flags are false. A step of an order is a pair of such sets, with and
without its filter, so that all 120 orders cost one join of 600 steps to at most
32 rows a part. Sums over orders (Shapley) are sums over the steps.

For E, texts are compared by their SHA-256, so only hashes and flags move: the
least doc_id of each hash comes from partial minima, and only hashes of several
rows are joined back, a plain join whose hot keys Spark's adaptive plan splits.
The labels are joined by doc_id. The cube runs over at most 32 rows a part, and
the rows of its sets are a table of at most 32 rows a part too.

Defined cases: null text is empty; null part is ''; rows that repeat a doc_id
and text are not copies of each other (E asks for a smaller doc_id), and null
doc_id is neither smaller nor greater than any; several label rows of a
document are one that holds what any of them says, and documents without
labels are neither good nor toxic; an empty table gives an empty result; other
columns of the documents play no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexeum.llm import common as C

FILTERS = "ABCDE"
#: Fixed values of the five conditions.
WORDS, DISTINCT, CAPITALS, SIGNS = 100, 80, 10, r"[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def flags(text: Column) -> dict[str, Column]:
    """The conditions A to D of a text, from one split of it into words."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < WORDS,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(DISTINCT).cast("long"),
        "C": capitals * F.lit(100).cast("long") > F.length(text) * F.lit(CAPITALS).cast("long"),
        "D": text.rlike(SIGNS),
    }


def flagged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """doc_id, part and the five flags of each document."""
    said = F.coalesce(F.col(text), F.lit(""))
    own = (F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = C.stored(docs.select(*own, F.unhex(F.sha2(said, 256)).alias("h"), *(c.alias(x) for x, c in flags(F.col(text)).items())), "flags")
    copies = rows.groupBy("h").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    late = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return rows.join(copies, "h", "left").select("doc_id", "part", *FILTERS[:4], late.alias("E"))


def cells(flags_: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, and how many documents, good and toxic ones there are of each."""
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("_good"), F.max((F.col("toxic") == 1).cast("long")).alias("_toxic"))
    sums = (F.count("*").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"))
    return flags_.join(said, "doc_id", "left").groupBy("part", *FILTERS).agg(*sums)


def survivors(cells_: DataFrame) -> DataFrame:
    """part (null: all parts), mask (bit i: filter i is in the set), n, good, toxic: the documents that fail none of the set, zeros included."""
    sets = cells_.sparkSession.sql(
        f"""SELECT part, grouping(part) = 1 AS whole, {", ".join(f"{x}, grouping({x}) AS no_{x}" for x in FILTERS)}, {", ".join(f"sum({c}) AS {c}" for c in COUNTS)}
        FROM {{cells}} GROUP BY CUBE (part, {", ".join(FILTERS)})""",
        cells=cells_,
    )
    clear = sets.filter(" AND ".join(f"(no_{x} = 1 OR NOT {x})" for x in FILTERS))
    mask = sum(((1 - F.col(f"no_{x}")) * (1 << i) for i, x in enumerate(FILTERS)), F.lit(0)).cast("int")
    found = clear.select(F.col("part").alias("_part"), F.col("whole").alias("_whole"), mask.alias("_mask"), *COUNTS)
    grid = sets.filter(" AND ".join(f"no_{x} = 1" for x in FILTERS)).select("part", "whole", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("mask"))
    both = grid.join(found, (F.col("mask") == F.col("_mask")) & (F.col("whole") == F.col("_whole")) & F.col("part").eqNullSafe(F.col("_part")), "left")
    return both.select("part", "whole", "mask", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS))


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, filter, and the sets of filters before and after the step: 600 rows."""
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    each = spark.range(1).select(F.explode(orders).alias("filter_order")).select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def mask(n: Column) -> Column:
        head = F.substring(F.col("filter_order"), F.lit(1), n)
        return sum((F.when(F.contains(head, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))

    return each.select("filter_order", "step", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)).alias("filter"), mask(F.col("step") - 1).alias("before"), mask(F.col("step")).alias("after"))


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; all parts together as null part."""
    sets = C.stored(survivors(cells(flagged(docs, **names), labels)), "sets")
    full = (1 << len(FILTERS)) - 1

    def at(mask: Column, tag: str) -> tuple[DataFrame, Column]:
        """The sets under other names, and the condition on which they join."""
        other = sets.select(*(F.col(c).alias(f"{c}_{tag}") for c in sets.columns))
        return other, (F.col(f"mask_{tag}") == mask) & (F.col("whole") == F.col(f"whole_{tag}")) & F.col("part").eqNullSafe(F.col(f"part_{tag}"))

    one = sum((F.when(F.col("filter") == x, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    out = sets.join(steps(docs.sparkSession), F.col("mask") == F.col("before")).drop("mask")
    for tag, mask in (("after", F.col("after")), ("none", F.lit(0)), ("own", one), ("all", F.lit(full)), ("others", F.lit(full) - one)):
        out = out.join(*at(mask, tag))
    removed = F.col("n") - F.col("n_after")
    out = out.select(
        "part", "whole", "filter_order", "step", "filter", F.col("n_after").alias("kept"), removed.alias("removed"),
        (F.col("n_none") - F.col("n_own") - removed).alias("redundant"), (F.col("n_others") - F.col("n_all")).alias("unique_fails"),
        (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("whole", "part", "filter")))
