"""One loader for each corpus, from its raw files to the unified schema, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeum import schema
from lexeum.functions import labels as L
from lexeum.functions import text as T
from lexeum.operators import votes
from lexeum.sources import readers as R

Loader = Callable[[SparkSession, str], DataFrame]

# Moderation reasons and the labels they stand for; reasons that stand for none.
REASON_LABELS = {
    "VolksverhetzungStGB130": ("hate_speech", "toxic"),
    "Nutzervorführung / Persönlicher Angriff": ("insult", "toxic"),
    "BeleidigungStGB185": ("insult", "toxic"),
    "Feindseligkeit gegenüber Dritten": ("toxic",),
}
UNMAPPED_REASONS = ("UebleNachredeStGB186", "VerleumdungStGB187")
POLITENESS = {1: 0.0, -1: 1.0}
JIGSAW_FLAGS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")


def reasons_for(label: str) -> list[str]:
    return sorted(r for r, names in REASON_LABELS.items() if label in names)


def gmhp7k(spark: SparkSession, root: str) -> DataFrame:
    """Votes of several phases, one file each; either kind of hate by majority makes hate speech."""
    types = {"hs": "double", "m_hs": "double"}
    files = R.list_files(spark, f"{root}/corpus-gmhp7k/datasets/misogynistic_hatespeech_phase*.csv")
    if not files:
        raise FileNotFoundError(f"no phase files under {root}")
    parts = None
    for rank, path in enumerate(files):
        part = R.read_csv(spark, path, types, order="place")
        keep = [c for c in ("tweet_id", "review_text", "hs", "m_hs", "split_hs") if c in part.columns]
        part = part.select(*keep, F.struct(F.lit(rank).alias("file"), F.col("place").alias("row")).alias("ord"))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    if "split_hs" not in parts.columns:
        parts = parts.withColumn("split_hs", F.lit(None).cast("string"))
    one = votes.collapse(parts, "tweet_id", means=("hs", "m_hs"), firsts=("review_text", "split_hs"), order="ord")
    return schema.unify(one, text=F.col("review_text"), source="gmhp7k", language="de", split=F.col("split_hs"), labels={"hate_speech": L.either_majority(F.col("hs"), F.col("m_hs"))})


def hocon34k(spark: SparkSession, root: str) -> DataFrame:
    raw = R.read_csv(spark, f"{root}/hocon34k/corpus-hocon34k/datasets/hatespeech_hocon34k.csv", {"label_hs": "double", "post_id": "long"}, order="ord")
    one = votes.collapse(raw, "post_id", means=("label_hs",), firsts=("text", "split_all"), order="ord")
    return schema.unify(one, text=F.col("text"), source="hocon34k", language="de", split=T.blank_to_null(F.col("split_all")), labels={"hate_speech": L.majority(F.col("label_hs"))})


def _comments(spark, comments: DataFrame, annotations: DataFrame, score: str, source: str, label: str) -> DataFrame:
    """Comments with the majority of their annotations; comments without any are left out."""
    voted = votes.mean_by(annotations, "rev_id", score).withColumn(label, L.majority(F.col("mean"))).drop("mean")
    joined = comments.withColumn("comment", T.newlines(F.col("comment"))).join(voted, "rev_id")
    split = F.col("split") if "split" in comments.columns else None
    return schema.unify(joined, text=F.col("comment"), source=source, language="en", split=split, labels={label: F.col(label)})


def detox(spark: SparkSession, root: str) -> DataFrame:
    """The two files may have changed names; the one with comments is found by its header."""
    types = {"rev_id": "double", "toxicity": "double"}
    one, two = (R.read_tsv(spark, f"{root}/detox/{n}.tsv", types).withColumn("rev_id", F.col("rev_id").cast("long")) for n in ("toxicity_comments", "toxicity_annotations"))
    comments, annotations = (one, two) if "comment" in one.columns else (two, one)
    return _comments(spark, comments, annotations, "toxicity", "detox", "toxic")


def wikipedia_attacks(spark: SparkSession, root: str) -> DataFrame:
    types = {"rev_id": "double", "attack": "double"}
    comments, annotations = (R.read_csv(spark, f"{root}/wikipedia_attacks/{n}.csv", types).withColumn("rev_id", F.col("rev_id").cast("long")) for n in ("attack_annotated_comments", "attack_annotations"))
    return _comments(spark, comments, annotations, "attack", "wikipedia_attacks", "insult")


def jigsaw(spark: SparkSession, root: str) -> DataFrame:
    """Flags, not votes; test rows marked -1 were not scored and go."""
    types = dict.fromkeys(JIGSAW_FLAGS, "double")
    cols = ["comment_text", "split", *JIGSAW_FLAGS]
    train = R.read_csv(spark, f"{root}/jigsaw/train.csv", types).withColumn("split", F.lit("train")).select(*cols)
    texts = R.read_csv(spark, f"{root}/jigsaw/test.csv").alias("t")
    marks = R.read_csv(spark, f"{root}/jigsaw/test_labels.csv", types).alias("m")
    test = texts.join(marks, F.col("t.id").eqNullSafe(F.col("m.id"))).filter(votes.not_sentinel(F.col("toxic"), -1)).withColumn("split", F.lit("test")).select(*cols)
    both = train.unionByName(test)
    return schema.unify(both, text=F.col("comment_text"), source="jigsaw", language="multilingual", split=F.col("split"), labels={"hate_speech": F.col("identity_hate"), "toxic": L.either_flag(F.col("toxic"), F.col("severe_toxic")), "threat": F.col("threat"), "insult": F.col("insult")})


def wikipedia_politeness(spark: SparkSession, root: str) -> DataFrame:
    raw = R.read_json_lines(spark, f"{root}/politeness/wikipedia-politeness-corpus/utterances.jsonl", "text string, meta struct<Binary:int>", ("text",))
    return schema.unify(raw, text=F.col("text"), source="wikipedia_politeness", language="en", labels={"impolite": L.mapped(F.col("meta.Binary"), POLITENESS)})


def moderated(raw: DataFrame) -> DataFrame:
    """Moderated rows as unified ones and three raw columns: body, or else title; reasons to labels."""
    text = T.fallback(T.no_placeholder(F.col("body")), T.no_placeholder(F.col("question_title")))
    facts = raw.select(text.alias("text"), *(T.reason(F.col(c)).alias(f"{c}_raw") for c in ("moderation_state", "deletion_reason", "notice_reason"))).filter("text <> ''")
    marks = {x: (L.member(F.col("deletion_reason_raw"), reasons_for(x)) | L.member(F.col("notice_reason_raw"), reasons_for(x))).cast("double") for x in schema.CORPUS_LABELS["gutefrage"]}
    extra = ["moderation_state_raw", "deletion_reason_raw", "notice_reason_raw"]
    cols = [F.col("text"), F.lit("gutefrage").alias("source"), F.lit("de").alias("language"), F.lit(None).cast("string").alias("split")]
    return facts.select(*cols, *(marks.get(x, F.lit(None)).cast("double").alias(x) for x in schema.LABELS), *extra)


def _moderated_path(spark: SparkSession, root: str) -> str:
    base = f"{root}/gutefrage.net/dataset/datensatz_moderiert"
    for kind in ("parquet", "csv", "tsv", "numbers"):
        if R.list_files(spark, f"{base}.{kind}"):
            return f"{base}.{kind}"
    raise FileNotFoundError(f"no {base} as parquet, csv, tsv or numbers")


def gutefrage_with_provenance(spark: SparkSession, root: str) -> DataFrame:
    """Twelve columns: wider than the unified schema, not for the union."""
    return moderated(R.sheet(spark, _moderated_path(spark, root)))


def gutefrage(spark: SparkSession, root: str) -> DataFrame:
    return gutefrage_with_provenance(spark, root).select(*schema.COLUMNS)


#: In load order.
REGISTRY: dict[str, Loader] = {f.__name__: f for f in (gmhp7k, hocon34k, detox, jigsaw, wikipedia_attacks, wikipedia_politeness, gutefrage)}


def register_corpus(name: str, loader: Loader, labels: tuple[str, ...]) -> None:
    """Add a corpus of one's own; it is loaded after those known before."""
    if unknown := set(labels) - set(schema.LABELS):
        raise ValueError(f"unknown labels: {sorted(unknown)}")
    REGISTRY[name] = loader
    schema.CORPUS_LABELS[name] = tuple(labels)
