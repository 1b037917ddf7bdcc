"""The named queries over the driver's tables, each with the SQL that says the same.

Documents with labels stand for a corpus (toxic as it is, impolite where
quality is 0), line items of an order for votes on it, event types for
moderation reasons. Floats are rounded here, not in the operators, so that two
engines can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.window import Window

from lexeum import schema
from lexeum.functions import labels as L
from lexeum.functions import text as T
from lexeum.operators import agreement, association, splits, statistics, translation, votes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
USED = ("toxic", "impolite")
#: Unicode white space as RE2 spells it.
WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SQL_LABELS = "NULL::DOUBLE AS hate_speech, l.toxic::DOUBLE AS toxic, NULL::DOUBLE AS threat, NULL::DOUBLE AS insult, (1 - l.quality)::DOUBLE AS impolite"
SQL_SPLIT = "CASE WHEN d.doc_id % 10 = 0 THEN 'test' WHEN d.doc_id % 10 = 1 THEN 'val' WHEN d.doc_id % 10 < 8 THEN 'train' END"
SQL_CORPUS = f"corpus AS (SELECT d.doc_id, d.text, d.source, d.lang AS language, {SQL_SPLIT} AS split, {SQL_LABELS} FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
SQL_LONG = " UNION ALL ".join(f"SELECT language, '{x}' AS label, {x} AS v FROM corpus" for x in schema.LABELS)
SQL_VOTES = "votes AS (SELECT l_orderkey AS item, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS rater, l_returnflag AS label FROM lineitem)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the unified columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("toxic"), (1 - F.col("quality")).cast("double").alias("impolite"))
    rest = F.col("doc_id") % 10
    split = F.when(rest == 0, "test").when(rest == 1, "val").when(rest < 8, "train")
    both = docs.join(marks, "doc_id", "left")
    none = lambda x: F.lit(None).cast("double").alias(x)
    return both.select("doc_id", "text", "source", F.col("lang").alias("language"), split.alias("split"), *(F.col(x) if x in USED else none(x) for x in schema.LABELS))


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).drop("doc_id")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, rater, label): orders, a line a vote; orders of one line are items of one vote."""
    w = Window.partitionBy("item").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("label"))
    return agreement.dealt(lines, "item", then=lambda x: x.select("item", F.row_number().over(w).alias("rater"), "label"))


def rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ------------------------------------------------------------------ schema, union, filters


@query(f"WITH {SQL_CORPUS} SELECT * EXCLUDE (doc_id) FROM corpus")
def unified_documents(spark, sf_dir):
    return unified(spark, sf_dir)


@query(
    f"""WITH {SQL_CORPUS} SELECT * EXCLUDE (doc_id) FROM corpus
    UNION ALL SELECT text, 'benchmark', 'en', NULL, NULL, NULL, NULL, NULL, NULL FROM benchmark
    UNION ALL SELECT text, 'conversations', 'en', role, NULL, NULL, NULL, NULL, NULL FROM conversations"""
)
def corpus_union(spark, sf_dir):
    one = schema.unify(table(spark, sf_dir, "benchmark"), text=F.col("text"), source="benchmark", language="en")
    two = schema.unify(table(spark, sf_dir, "conversations"), text=F.col("text"), source="conversations", language="en", split=F.col("role"))
    return unified(spark, sf_dir).unionByName(one).unionByName(two)


@query(f"WITH {SQL_CORPUS} SELECT * EXCLUDE (doc_id) FROM corpus WHERE split = 'val'")
def get_split(spark, sf_dir):
    return unified(spark, sf_dir).filter(F.col("split") == "val")


@query(f"WITH {SQL_CORPUS} SELECT * EXCLUDE (doc_id) FROM corpus WHERE source = 'src3'")
def get_corpus(spark, sf_dir):
    return unified(spark, sf_dir).filter(F.col("source") == "src3")


# ------------------------------------------------------------------ votes and label rules


@query("SELECT l_orderkey AS item, CASE WHEN avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM lineitem GROUP BY l_orderkey")
def majority_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_returnflag") == "R").cast("double").alias("score"))
    return votes.mean_by(rows, "item", "score").select("item", L.majority(F.col("mean")).alias("label"))


@query(
    """SELECT l_orderkey AS item, (CASE WHEN avg((l_returnflag = 'R')::INT) >= 0.5 OR avg((l_linestatus = 'O')::INT) >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS hate_speech
    FROM lineitem GROUP BY l_orderkey"""
)
def or_merge_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_returnflag") == "R").cast("double").alias("hs"), (F.col("l_linestatus") == "O").cast("double").alias("m_hs"))
    return votes.collapse(rows, "item", means=("hs", "m_hs")).select("item", L.either_majority(F.col("hs"), F.col("m_hs")).alias("hate_speech"))


@query(
    """SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'view') AS first_type, CAST(count(*) AS BIGINT) AS n
    FROM events GROUP BY user_id"""
)
def first_non_null(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("first_type"), F.struct("ts", "event_id").alias("ord"))
    return rows.groupBy("user_id").agg(votes.first_non_null("first_type", "ord").alias("first_type"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("ord"))
    return votes.keep_first(rows, "user_id", "ord").drop("ord")


@query(
    """SELECT o.o_orderkey, o.o_orderpriority AS comment, (CASE WHEN v.m >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS insult
    FROM orders o JOIN (SELECT l_orderkey, avg((l_returnflag = 'R')::INT) AS m FROM lineitem GROUP BY l_orderkey) v ON v.l_orderkey = o.o_orderkey"""
)
def comments_join_annotations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "R").cast("double").alias("attack"))
    voted = votes.mean_by(rows, "o_orderkey", "attack")
    comments = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("comment"))
    return comments.join(voted, "o_orderkey").select("o_orderkey", "comment", L.majority(F.col("mean")).alias("insult"))


@query(
    """SELECT d.doc_id, d.lang, l.toxic, 'test' AS split FROM documents d JOIN
    (SELECT doc_id, CASE WHEN quality = 0 THEN -1 WHEN doc_id % 5 = 0 THEN NULL ELSE toxic END AS toxic FROM labels) l ON l.doc_id = d.doc_id WHERE l.toxic IS DISTINCT FROM -1
    UNION ALL SELECT doc_id, lang, NULL, 'train' FROM documents"""
)
def sentinel_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, -1).when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("toxic")).alias("toxic"))
    test = docs.join(marks, "doc_id").filter(votes.not_sentinel(F.col("toxic"), -1)).withColumn("split", F.lit("test"))
    train = docs.withColumn("toxic", F.lit(None).cast("int")).withColumn("split", F.lit("train"))
    return test.unionByName(train)


@query(
    """SELECT doc_id, (coalesce(toxic <> 0, true) OR coalesce(nullif(quality, 1) <> 0, true))::INT::DOUBLE AS toxic, quality::DOUBLE AS hate_speech FROM labels"""
)
def flag_or_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    other = F.when(F.col("quality") != 1, F.col("quality"))
    return rows.select("doc_id", L.either_flag(F.col("toxic"), other).alias("toxic"), F.col("quality").cast("double").alias("hate_speech"))


@query("SELECT doc_id, CASE quality + 2 * toxic WHEN 1 THEN 0.0 WHEN 0 THEN 1.0 END::DOUBLE AS impolite FROM labels")
def value_map(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", L.mapped(F.col("quality") + 2 * F.col("toxic"), {1: 0.0, 0: 1.0}).alias("impolite"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0 THEN 1.0 WHEN TRY_CAST(json_extract_string(props, '$.k') AS INT) % 3 = 1 THEN 0.0 END::DOUBLE AS impolite FROM events")
def json_field_map(spark, sf_dir):
    k = F.from_json("props", Y.StructType([Y.StructField("k", Y.IntegerType())]))["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).withColumn("impolite", L.mapped(F.col("k") % 3, {0: 1.0, 1: 0.0}))


@query(
    """SELECT event_id, (event_type IN ('purchase', 'refund') OR coalesce(notice, '') IN ('purchase', 'refund'))::INT::DOUBLE AS hate_speech,
    (event_type = 'click' OR coalesce(notice, '') = 'click')::INT::DOUBLE AS insult FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'click' END AS notice FROM events)"""
)
def reason_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("notice", F.when(F.col("user_id") % 3 == 0, "click"))
    mark = lambda names: (L.member(F.col("event_type"), names) | L.member(F.col("notice"), names)).cast("double")
    return rows.select("event_id", mark(["purchase", "refund"]).alias("hate_speech"), mark(["click"]).alias("insult"))


@query(
    """SELECT page_id, text FROM (SELECT page_id, CASE WHEN body <> '' THEN body ELSE title END AS text FROM
    (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE url END AS body, CASE WHEN page_id % 8 = 0 THEN '' ELSE url END AS title FROM pages)) WHERE text <> ''"""
)
def text_fallback(spark, sf_dir):
    odd = F.when(F.col("page_id") % 4 == 0, F.lit(" None ")).when(F.col("page_id") % 4 == 1, None).otherwise(F.concat(F.lit(" "), "url", F.lit("\t")))
    title = F.when(F.col("page_id") % 8 == 0, F.lit("<NA>")).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", T.fallback(T.no_placeholder(odd), T.no_placeholder(title)).alias("text"))
    return rows.filter("text <> ''")


@query("SELECT doc_id, md5(replace(replace(text, chr(10), 'NEWLINE_TOKEN'), 'NEWLINE_TOKEN', chr(10))) AS hash, CAST(length(text) AS INT) AS n FROM documents")
def literal_replace(spark, sf_dir):
    there = F.replace("text", F.lit("\n"), F.lit(T.NEWLINE_TOKEN))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.newlines(there)).alias("hash"), F.length(T.newlines(there)).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS split FROM documents")
def split_normalised(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 6 == 0, F.lit("  \t")).when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.blank_to_null(raw).alias("split"))


@query(
    """SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN 'Hatespeech' ELSE 'Not Hatespeech' END AS binary, CASE WHEN k IN (1, 2) THEN 'Not Enough Context' ELSE 'Enough Context' END AS context,
    CASE WHEN k = 0 THEN 'Hatespeech (enough context)' WHEN k = 3 THEN 'Not Hatespeech (enough context)' ELSE 'Not Enough Context' END AS three FROM (SELECT o_orderkey, o_orderkey % 4 AS k FROM orders)"""
)
def class_encodings(spark, sf_dir):
    four = F.element_at(F.array(*map(F.lit, (*L.HATE, "Not Hatespeech (not enough context)", "Not Hatespeech (enough context)"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.hate_or_not(four).alias("binary"), L.context(four).alias("context"), L.three_classes(four).alias("three"))


# ------------------------------------------------------------------ statistics


@query(
    f"""WITH {SQL_CORPUS}, long AS ({SQL_LONG})
    SELECT label, CASE label WHEN 'hate_speech' THEN 'gmhp7k, hocon34k, jigsaw, gutefrage' WHEN 'toxic' THEN 'detox, jigsaw, gutefrage' WHEN 'threat' THEN 'jigsaw'
    WHEN 'insult' THEN 'jigsaw, wikipedia_attacks, gutefrage' ELSE 'wikipedia_politeness' END AS corpora, count(v) AS total, count(*) FILTER (WHERE v = 1) AS positive,
    count(*) FILTER (WHERE v = 0) AS negative, CASE WHEN count(v) > 0 THEN count(*) FILTER (WHERE v = 1) / count(v)::DOUBLE END AS pos_rate FROM long GROUP BY label"""
)
def label_stats(spark, sf_dir):
    return statistics.label_stats(unified(spark, sf_dir))


@query(f"WITH {SQL_CORPUS} SELECT source, split, count(*) AS count FROM corpus GROUP BY ALL")
def split_stats(spark, sf_dir):
    return statistics.split_stats(unified(spark, sf_dir))


@query("SELECT source, count(*) FILTER (WHERE doc_id % 7 = 0) AS null_texts, count(*) AS rows FROM documents GROUP BY source")
def null_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    return statistics.null_texts(docs)


@query(f"WITH {SQL_CORPUS} SELECT source, avg((hate_speech IS NULL)::INT) AS hate_speech, round(avg((toxic IS NULL)::INT), 9) AS toxic, avg((threat IS NULL)::INT) AS threat, avg((insult IS NULL)::INT) AS insult, round(avg((impolite IS NULL)::INT), 9) AS impolite FROM corpus GROUP BY source")
def coverage_matrix(spark, sf_dir):
    return rounded(statistics.missing_rates(unified(spark, sf_dir)), *USED)


@query(f"WITH {SQL_CORPUS} SELECT source, count(hate_speech) AS hate_speech, count(toxic) AS toxic, count(threat) AS threat, count(insult) AS insult, count(impolite) AS impolite FROM corpus GROUP BY source")
def annotated_matrix(spark, sf_dir):
    return statistics.annotated_counts(unified(spark, sf_dir))


@query(
    f"""WITH {SQL_CORPUS}, long AS (SELECT source, 'toxic' AS label, toxic AS v FROM corpus UNION ALL SELECT source, 'impolite', impolite FROM corpus)
    SELECT source, label, count(*) FILTER (WHERE v = 1) AS positive, count(*) FILTER (WHERE v = 0) AS negative, count(v) AS total FROM long GROUP BY source, label HAVING count(v) > 0"""
)
def pos_neg_counts(spark, sf_dir):
    return statistics.positive_negative(unified(spark, sf_dir))


@query(
    f"""WITH {SQL_CORPUS}, long AS ({SQL_LONG})
    SELECT language, label, round(CASE WHEN count(v) > 0 THEN count(*) FILTER (WHERE v = 1) * 100.0::DOUBLE / count(v) ELSE 0 END, 6) AS pos_percent FROM long GROUP BY language, label"""
)
def pos_rate_long(spark, sf_dir):
    return rounded(statistics.positive_rates(unified(spark, sf_dir), "language"), "pos_percent", digits=6)


@query(
    f"""WITH {SQL_CORPUS}, long AS (SELECT language, 'toxic' AS label, toxic AS v FROM corpus UNION ALL SELECT language, 'impolite', impolite FROM corpus),
    rates AS (SELECT language, label, CASE WHEN count(v) > 0 THEN count(*) FILTER (WHERE v = 1) * 100.0::DOUBLE / count(v) ELSE 0 END AS p FROM long GROUP BY ALL)
    SELECT label, {", ".join(f"round(coalesce(max(p) FILTER (WHERE language = '{x}'), 0), 6) AS {x}" for x in ("de", "en", "es", "fr"))} FROM rates GROUP BY label"""
)
def pos_rate_pivot(spark, sf_dir):
    langs = ("de", "en", "es", "fr")
    return rounded(statistics.pivot_rates(unified(spark, sf_dir), langs, "language", USED), *langs, digits=6)


@query(
    rf"""WITH w AS (SELECT source, len(regexp_extract_all(text, '[^{WS}]+')) AS wc FROM documents)
    SELECT source, count(*) AS texts, round(avg(wc), 6) AS mean, quantile_cont(wc, 0.5) AS median, round(quantile_cont(wc, 0.95), 6) AS p95, round(quantile_cont(wc, 0.99), 6) AS p99, min(wc)::INT AS min, max(wc)::INT AS max FROM w GROUP BY source"""
)
def word_count_stats(spark, sf_dir):
    return rounded(statistics.length_stats(table(spark, sf_dir, "documents")), "mean", "p95", "p99", digits=6)


@query(
    rf"""WITH w AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[^{WS}]+')) AS wc FROM documents), t AS (SELECT lang, quantile_cont(wc, 0.99) AS p FROM w GROUP BY lang)
    SELECT doc_id, w.lang, round(least(wc::DOUBLE, p), 6) AS clipped FROM w JOIN t ON t.lang = w.lang"""
)
def word_count_clipped(spark, sf_dir):
    return rounded(statistics.clipped_lengths(table(spark, sf_dir, "documents"), "lang", keep=["doc_id"]), "clipped", digits=6)


@query("SELECT lang, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75 FROM documents GROUP BY lang")
def box_stats(spark, sf_dir):
    return statistics.box_stats(table(spark, sf_dir, "documents"), "n_chars", "lang")


@query(
    f"""WITH {SQL_CORPUS}, c AS (SELECT corr(toxic, impolite) AS k, count(toxic) AS n FROM corpus)
    SELECT a AS label_a, b AS label_b, CASE WHEN a = b THEN 1.0 ELSE round(k, 9) END::DOUBLE AS corr FROM c, (VALUES ('toxic', 'toxic'), ('impolite', 'toxic'), ('impolite', 'impolite')) t(a, b)"""
)
def label_corr(spark, sf_dir):
    return rounded(statistics.correlations(unified(spark, sf_dir), USED, lower=True), "corr")


@query(
    f"""WITH {SQL_CORPUS}, long AS (SELECT doc_id, 'toxic' AS x, toxic AS v FROM corpus UNION ALL SELECT doc_id, 'impolite', impolite FROM corpus UNION ALL SELECT doc_id, 'threat', threat FROM corpus)
    SELECT a.x AS label_a, b.x AS label_b, count(*) FILTER (WHERE a.v IS NOT NULL AND b.v IS NOT NULL) AS rows FROM long a JOIN long b USING (doc_id) GROUP BY ALL"""
)
def label_overlap(spark, sf_dir):
    return statistics.overlaps(unified(spark, sf_dir), ("toxic", "impolite", "threat"))


@query(
    f"""WITH {SQL_CORPUS}, s AS (SELECT source, string_agg(split || ': ' || n, ', ' ORDER BY split) AS splits FROM (SELECT source, split, count(*) AS n FROM corpus WHERE split IS NOT NULL GROUP BY ALL) GROUP BY source)
    SELECT c.source, count(*) AS rows, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages, ((count(toxic) > 0)::INT + (count(impolite) > 0)::INT) AS n_labels, concat_ws(', ', CASE WHEN count(toxic) > 0 THEN 'toxic' END, CASE WHEN count(impolite) > 0 THEN 'impolite' END) AS labels,
    concat_ws(', ', CASE WHEN count(toxic) > 0 THEN printf('toxic: %.1f%%', count(*) FILTER (WHERE toxic = 1) * 100.0 / count(toxic)) END, CASE WHEN count(impolite) > 0 THEN printf('impolite: %.1f%%', count(*) FILTER (WHERE impolite = 1) * 100.0 / count(impolite)) END) AS rates,
    coalesce(any_value(s.splits), 'none') AS splits, count(*) FILTER (WHERE split IS NULL) AS no_split FROM corpus c LEFT JOIN s ON s.source = c.source GROUP BY c.source"""
)
def dataset_summary(spark, sf_dir):
    return statistics.summary(unified(spark, sf_dir))


def _sql_rate(x: str) -> str:
    return f"printf('{x}: %.1f%%', coalesce(count(*) FILTER (WHERE {x} = 1)::DOUBLE / nullif(count({x}), 0) * 100, 0.0))"


SHOWN_LABELS = {"src0": ("toxic", "threat"), "src1": ("impolite",)}


@query(
    f"""WITH {SQL_CORPUS}, s AS (SELECT source, string_agg(split || ': ' || format('{{:,}}', n), '  ' ORDER BY n DESC, split) AS splits FROM (SELECT source, split, count(*) AS n FROM corpus WHERE split IS NOT NULL GROUP BY ALL) GROUP BY source)
    SELECT c.source, format('{{:,}}', count(*)) AS rows, string_agg(DISTINCT language, ', ' ORDER BY language) AS language, CASE c.source WHEN 'src0' THEN '2' WHEN 'src1' THEN '1' ELSE '5' END AS n_labels,
    CASE c.source WHEN 'src0' THEN 'toxic, threat' WHEN 'src1' THEN 'impolite' ELSE '{", ".join(schema.LABELS)}' END AS labels,
    CASE c.source WHEN 'src0' THEN {_sql_rate("toxic")} || '  |  ' || {_sql_rate("threat")} WHEN 'src1' THEN {_sql_rate("impolite")} ELSE {" || '  |  ' || ".join(map(_sql_rate, schema.LABELS))} END AS positive_rates,
    coalesce(any_value(s.splits), 'none') AS splits, format('{{:,}}', count(*) FILTER (WHERE split IS NULL)) AS no_split_rows FROM corpus c LEFT JOIN s ON s.source = c.source GROUP BY c.source"""
)
def summary_table(spark, sf_dir):
    """The summary as it is shown; two sources have labels of their own in the catalog."""
    return statistics.summary_table(unified(spark, sf_dir), SHOWN_LABELS)


SQL_TIES = ("l_linenumber * 6.25::DOUBLE", "l_quantity::DOUBLE / 200", "l_linenumber + 0.675::DOUBLE", "(l_suppkey - 40) / 16::DOUBLE", "l_extendedprice::DOUBLE / 3")


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f"printf('%.{d}f', {x}) AS x{i}_{d}" for i, x in enumerate(SQL_TIES) for d in (1, 2))} FROM lineitem")
def rounded_numbers(spark, sf_dir):
    """Ties (6.25, 0.125), what only looks like one (0.15, 2.675), negative and other numbers, with several digits."""
    number = lambda c: F.col(c).cast("double")
    values = (number("l_linenumber") * 6.25, number("l_quantity") / 200, number("l_linenumber") + 0.675, (number("l_suppkey") - 40) / 16, number("l_extendedprice") / 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(T.fixed(x, d).alias(f"x{i}_{d}") for i, x in enumerate(values) for d in (1, 2)))


@query(f"WITH {SQL_CORPUS} SELECT ((count(hate_speech) > 0)::INT + (count(toxic) > 0)::INT + (count(threat) > 0)::INT + (count(insult) > 0)::INT + (count(impolite) > 0)::INT) AS labels_with_data FROM corpus")
def labels_with_data(spark, sf_dir):
    return statistics.labels_with_data(unified(spark, sf_dir))


@query(f"WITH {SQL_CORPUS} SELECT split, count(*) AS count FROM corpus GROUP BY split")
def value_counts(spark, sf_dir):
    return statistics.value_counts(unified(spark, sf_dir), "split")


@query("SELECT event_type, count(*) AS count, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 9) AS share FROM events GROUP BY event_type")
def value_share(spark, sf_dir):
    return rounded(statistics.value_shares(table(spark, sf_dir, "events"), "event_type"), "share")


@query("SELECT bucket, event_type, n AS count, round(n / (sum(n) OVER (PARTITION BY bucket))::DOUBLE, 9) AS share FROM (SELECT user_id % 10 AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL)")
def grouped_share(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("bucket"), "event_type")
    return rounded(statistics.grouped_shares(rows, "bucket", "event_type"), "share")


@query("SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max FROM orders")
def describe_numeric(spark, sf_dir):
    return rounded(statistics.describe(table(spark, sf_dir, "orders"), "o_totalprice"), "mean", "std", "q25", "q50", "q75", digits=4)


@query("SELECT count(doc_id) AS doc_id, count(text) AS text, count(source) AS source, count(language) AS language, count(split) AS split, count(hate_speech) AS hate_speech, count(toxic) AS toxic, count(threat) AS threat, count(insult) AS insult, count(impolite) AS impolite FROM (WITH " + SQL_CORPUS + " SELECT * FROM corpus)")
def non_null_counts(spark, sf_dir):
    return statistics.non_null_counts(corpus(spark, sf_dir))


@query("SELECT conv_id, arg_min(md5(text), turn) FILTER (WHERE role = 'user') AS user, arg_min(md5(text), turn) FILTER (WHERE role = 'assistant') AS assistant FROM conversations GROUP BY conv_id")
def pivot_first(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.md5("text"))
    return statistics.pivot_first(rows, "conv_id", "role", "text", ("user", "assistant"), "turn")


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user, count(*) FILTER (WHERE role = 'assistant') AS assistant FROM conversations GROUP BY conv_id")
def pivot_size(spark, sf_dir):
    return statistics.pivot_size(table(spark, sf_dir, "conversations"), "conv_id", "role", ("user", "assistant"))


@query("SELECT user_id, CAST(dense_rank() OVER (ORDER BY user_id) AS INT) AS rank FROM (SELECT DISTINCT user_id FROM events)")
def dense_rank_annotators(spark, sf_dir):
    return statistics.dense_ranks(table(spark, sf_dir, "events"), "user_id")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_full_match(c_name, '\\d+')")
def non_numeric_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(~T.numeric(F.col("c_name"))).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def top_k(spark, sf_dir):
    return statistics.top(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 20)


@query("SELECT doc_id, concat(substring(text, 1, 80), '…') AS preview FROM documents ORDER BY doc_id LIMIT 3")
def head(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(3).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(
    """SELECT label, value, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY label), 6) AS percent
    FROM (SELECT 'quality' AS label, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY label, value"""
)
def label_percents(spark, sf_dir):
    return rounded(statistics.label_percents(table(spark, sf_dir, "labels"), ("quality", "toxic")), "percent", digits=6)


@query(
    """SELECT lang, p::DOUBLE AS point, round(avg(exp(-0.5 * ((n_chars - p) / 400.0::DOUBLE) * ((n_chars - p) / 400.0::DOUBLE))) / (400 * sqrt(2 * pi())), 9) AS density
    FROM documents, (VALUES (0), (1000), (2000), (4000)) t(p) GROUP BY lang, p"""
)
def length_density(spark, sf_dir):
    return rounded(statistics.density(table(spark, sf_dir, "documents"), "n_chars", "lang", (0, 1000, 2000, 4000), 400.0), "density")


# ------------------------------------------------------------------ text and translation

SQL_CLEAN = rf"""trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://[^{WS}]+|www\.[^{WS}]+', '[URL]', 'g'), '[{WS}]+', ' ', 'g'), ' ')"""


@query(f"SELECT page_id, {SQL_CLEAN} AS cleaned FROM pages")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.cleaned(F.col("html")).alias("cleaned"))


@query(f"SELECT page_id, md5({SQL_CLEAN}) AS hash FROM pages")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.content_hash(T.cleaned(F.col("html"))).alias("hash"))


SQL_DOC_CLEAN = SQL_CLEAN.replace("(html,", "(text,")
SQL_EN = f"en AS (SELECT doc_id, lang, text, {SQL_DOC_CLEAN} AS c FROM documents)"


class _KnownTranslator(translation.Translator):
    """The cache holds the texts of even doc_ids."""

    known: DataFrame

    def cache(self, spark, hashes=None):
        return self.known


def _translator(spark, sf_dir, cached: bool = False) -> translation.Translator:
    if not cached:
        return translation.Translator(translation.tagging_backend())
    t = _KnownTranslator(translation.tagging_backend())
    even = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0 and lang = 'en'").select(T.cleaned(F.col("text")).alias("c"))
    t.known = even.select(T.content_hash(F.col("c")).alias("hash"), F.concat(F.lit("[kept] "), "c").alias("translated")).dropDuplicates(["hash"])
    return t


def _to_translate(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(" \t")).otherwise(F.col("text")).alias("text"), F.col("lang").alias("language"))


SQL_TR = f"t AS (SELECT doc_id, lang, text, {SQL_DOC_CLEAN} AS c FROM (SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(9) ELSE text END AS text FROM documents))"


@query(
    f"""WITH {SQL_TR}, k AS (SELECT DISTINCT {SQL_DOC_CLEAN} AS c FROM documents WHERE doc_id % 2 = 0 AND lang = 'en')
    SELECT count(*) AS eligible, count(*) FILTER (WHERE t.c = '') AS empty, count(*) FILTER (WHERE t.c <> '' AND k.c IS NOT NULL) AS hits, count(*) FILTER (WHERE t.c <> '' AND k.c IS NULL) AS misses
    FROM t LEFT JOIN k ON k.c = t.c WHERE lang = 'en'"""
)
def cache_hits_misses(spark, sf_dir):
    return _translator(spark, sf_dir, True).metrics(_to_translate(spark, sf_dir))


@query(
    f"""WITH {SQL_TR} SELECT doc_id, CASE WHEN lang = 'en' AND c <> '' THEN '[de] ' || c ELSE text END AS text, CASE WHEN lang = 'en' AND c <> '' THEN 'de' ELSE lang END AS language,
    CASE WHEN lang = 'en' THEN text END AS text_original, (lang = 'en' AND c <> '') AS is_translated, CASE WHEN lang <> 'en' THEN 'not_applicable' WHEN c = '' THEN 'empty' ELSE 'success' END AS translation_status FROM t"""
)
def translate_status(spark, sf_dir):
    return _translator(spark, sf_dir).translate(_to_translate(spark, sf_dir))


@query(
    f"""WITH {SQL_TR} SELECT count(*) FILTER (WHERE lang = 'en' AND c <> '') AS success, 0::BIGINT AS failed, count(*) FILTER (WHERE lang = 'en' AND c = '') AS empty, count(*) FILTER (WHERE lang <> 'en') AS not_applicable FROM t"""
)
def translate_counts(spark, sf_dir):
    return translation.status_counts(_translator(spark, sf_dir).translate(_to_translate(spark, sf_dir)))


@query(f"WITH {SQL_TR} SELECT count(*) FILTER (WHERE lang = 'de' OR (lang = 'en' AND c <> '')) AS total, count(*) FILTER (WHERE lang = 'en' AND c <> '') AS silver, count(*) FILTER (WHERE lang = 'de') AS gold FROM t")
def gold_silver(spark, sf_dir):
    return statistics.gold_silver(_translator(spark, sf_dir).translate(_to_translate(spark, sf_dir)))


# ------------------------------------------------------------------ splits


@query(
    """SELECT doc_id, lang, CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.75 THEN 'val' ELSE 'test' END AS split FROM
    (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || doc_id), doc_id) - 1) / (count(*) OVER (PARTITION BY lang))::DOUBLE AS p FROM documents)"""
)
def stratified_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


SQL_ASSIGNED = f"""WITH {SQL_CORPUS}, a AS (SELECT * EXCLUDE (split), (row_number() OVER (PARTITION BY source, toxic, impolite ORDER BY md5(concat_ws('|', '0', source, text)), text) - 1) / (count(*) OVER (PARTITION BY source, toxic, impolite))::DOUBLE AS p FROM corpus WHERE split IS NULL),
    u AS (SELECT text, source, language, split, hate_speech, toxic, threat, insult, impolite FROM corpus WHERE split IS NOT NULL
    UNION ALL SELECT text, source, language, CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.75 THEN 'val' ELSE 'test' END, hate_speech, toxic, threat, insult, impolite FROM a)"""


@query(SQL_ASSIGNED + " SELECT * FROM u")
def assign_missing_splits(spark, sf_dir):
    return splits.assign_missing_splits(unified(spark, sf_dir))


SQL_OPEN = " UNION ALL ".join(f"SELECT source, '{x}' AS label, {x} AS value FROM corpus WHERE split IS NULL" for x in schema.LABELS)


@query(
    f"""WITH {SQL_CORPUS}, o AS ({SQL_OPEN}), n AS (SELECT source, label, value, count(*) AS rows FROM o GROUP BY ALL)
    SELECT source, label, value, rows, s.split, TRUE AS within_one FROM n, (VALUES ('train'), ('val'), ('test')) s(split)"""
)
def balanced_split(spark, sf_dir):
    """Of each source, label and value: are its rows in each split within one of the fractions?"""
    df = unified(spark, sf_dir)
    open_ = df.filter("split IS NULL")
    rows = splits.balanced_splits(open_).select("source", "split", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("value")) for x in schema.LABELS))).alias("r")).select("source", "split", "r.*")
    counts = rows.groupBy("source", "label", "value").agg(F.count("*").alias("rows"), *(F.count_if(F.col("split") == s).alias(s) for s in splits.NAMES))
    each = F.array(*(F.struct(F.lit(s).alias("split"), (F.abs(F.col(s) - F.col("rows") * f) <= 1 + 1e-9).alias("within_one")) for s, f in zip(splits.NAMES, splits.FRACTIONS, strict=True)))
    return counts.select("source", "label", "value", "rows", F.explode(each).alias("e")).select("source", "label", "value", "rows", "e.*")


@query(SQL_ASSIGNED + ", c AS (SELECT split, toxic, count(*) AS n FROM u GROUP BY ALL) SELECT split, toxic, n AS count, round(n / (sum(n) OVER (PARTITION BY split))::DOUBLE, 9) AS share FROM c")
def split_share(spark, sf_dir):
    return rounded(splits.split_shares(splits.assign_missing_splits(unified(spark, sf_dir)), "toxic"), "share")


# ------------------------------------------------------------------ agreement


def _sql_kappa(by: str, votes_: str, p: str = "") -> str:
    """SQL for kappa by group, in a table ``{p}k``; by: comma-joined columns, or ''."""
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""{p}n AS (SELECT {g}item, label, count(*)::DOUBLE AS n FROM {votes_} GROUP BY {g}item, label),
    {p}o AS (SELECT {g}avg(s) AS po FROM (SELECT {g}item, (sum(n * n) - sum(n)) / (sum(n) * (sum(n) - 1)) AS s FROM {p}n GROUP BY {g}item HAVING sum(n) > 1) {group}),
    {p}e AS (SELECT {g}sum(c * c) / (sum(c) * sum(c)) AS pe FROM (SELECT {g}label, sum(n) AS c FROM {p}n GROUP BY {g}label) {group}),
    {p}k AS (SELECT {g}(po - pe) / nullif(1 - pe, 0) AS kappa FROM {p}o JOIN {p}e {on})"""


SQL_BUCKET = "CASE WHEN kappa < 0 THEN 'poor' WHEN kappa = 0 THEN NULL WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' WHEN kappa > 0.8 THEN 'almost perfect' END"


@query(f"WITH {SQL_VOTES}, {_sql_kappa('', 'votes')} SELECT round(kappa, 9) AS kappa FROM k")
def fleiss_kappa(spark, sf_dir):
    return rounded(agreement.fleiss_kappa(ratings(spark, sf_dir), "item", "label"), "kappa")


@query(f"SELECT kappa, {SQL_BUCKET} AS bucket FROM (SELECT (l_linenumber - 3) / 5.0::DOUBLE AS kappa FROM lineitem GROUP BY l_linenumber)")
def kappa_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(((F.col("l_linenumber") - 3) / 5.0).alias("kappa")).distinct()
    return rows.withColumn("bucket", L.kappa_bucket(F.col("kappa")))


@query(f"WITH {SQL_VOTES}, l AS (SELECT w.rater AS without, v.* FROM votes v JOIN (SELECT DISTINCT rater FROM votes) w ON w.rater <> v.rater), {_sql_kappa('without', 'l')} SELECT without, round(kappa, 9) AS kappa FROM k")
def kappa_leave_one_out(spark, sf_dir):
    return rounded(agreement.leave_one_out(ratings(spark, sf_dir), "item", "rater", "label"), "kappa")


SQL_EXPERT = f"""WITH {SQL_VOTES}, p AS (SELECT v.rater AS who, v.item, v.label FROM votes v WHERE v.rater <> 1 UNION ALL SELECT w.rater, v.item, v.label FROM votes v JOIN votes w ON w.item = v.item AND w.rater <> 1 WHERE v.rater = 1),
    {_sql_kappa('who', 'p')}, ea AS (SELECT who AS rater, kappa FROM k UNION ALL SELECT 1, 1.0)"""


@query(f"{SQL_EXPERT} SELECT rater, round(kappa, 9) AS kappa, {SQL_BUCKET} AS interpretation FROM ea")
def expert_agreement(spark, sf_dir):
    return rounded(agreement.expert_agreement(ratings(spark, sf_dir), "item", "rater", "label", 1), "kappa")


def _posts(split: int, label: str = "") -> str:
    return f"(SELECT count(*) FROM votes v JOIN r m ON m.rater = v.rater WHERE m.rank <= r.rank AND v.item % 3 = {split}{label})"


@query(
    f"""{SQL_EXPERT}, r AS (SELECT rater, kappa, row_number() OVER (ORDER BY kappa DESC, rater) AS rank, lead(kappa) OVER (ORDER BY kappa DESC, rater) AS nx FROM ea),
    g AS (SELECT h.rank, v.item, v.label FROM r h JOIN r m ON m.rank <= h.rank JOIN votes v ON v.rater = m.rater), {_sql_kappa('rank', 'g', 'p')}
    SELECT CAST(r.rank AS INT) AS rank, CAST(r.rank AS INT) AS n_raters, (SELECT string_agg(m.rater, ',' ORDER BY m.rank) FROM r m WHERE m.rank <= r.rank) AS members, round(CASE WHEN r.rank = 1 THEN 1.0 ELSE pk.kappa END, 9)::DOUBLE AS kappa,
    CASE WHEN nx IS NULL THEN printf('x ≥ %.4f', r.kappa) ELSE printf('%.4f < x ≤ %.4f', nx, r.kappa) END AS bound,
    {_posts(0)} + {_posts(1)} + {_posts(2)} AS posts_total, {", ".join(f"{_posts(i)} AS posts_{x}, round({_posts(i, " AND v.label = 'N'")} * 100.0 / {_posts(i)}, 6) AS share_{x}" for i, x in enumerate(("train", "val", "test")))}
    FROM r LEFT JOIN pk ON pk.rank = r.rank"""
)
def expert_prefix(spark, sf_dir):
    split = F.when(F.col("item") % 3 == 0, "train").when(F.col("item") % 3 == 1, "val").otherwise("test")
    votes_ = ratings(spark, sf_dir).withColumn("split", split)
    ranked = agreement.expert_agreement(votes_, "item", "rater", "label", 1)
    out = agreement.prefix_groups(ranked, votes_, "item", "rater", "label", "split", "N")
    out = out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))
    return rounded(rounded(out, "kappa"), *(f"share_{x}" for x in ("train", "val", "test")), digits=6)


@query(
    f"""WITH {SQL_VOTES} SELECT a.item, count(c.rater) AS groups, count(*) FILTER (WHERE (a.label = 'N')::INT + (b.label = 'N')::INT + (c.label = 'N')::INT >= 2) AS positive_groups
    FROM votes a LEFT JOIN votes b ON b.item = a.item AND b.rater > a.rater LEFT JOIN votes c ON c.item = a.item AND c.rater > b.rater GROUP BY a.item"""
)
def quorum_majority(spark, sf_dir):
    return agreement.quorum_majorities(ratings(spark, sf_dir), "item", "label", "N", 3)


@query(
    f"""WITH {SQL_VOTES} SELECT CAST(row_number() OVER (PARTITION BY a.item ORDER BY a.rater, b.rater, c.rater) AS INT) AS group_id, a.item,
    CASE WHEN (a.label = 'N')::INT + (b.label = 'N')::INT + (c.label = 'N')::INT >= 2 THEN 'N' ELSE 'Y' END AS label
    FROM votes a JOIN votes b ON b.item = a.item AND b.rater > a.rater JOIN votes c ON c.item = a.item AND c.rater > b.rater"""
)
def quorum_groups(spark, sf_dir):
    two = ratings(spark, sf_dir).withColumn("label", F.when(F.col("label") == "N", "N").otherwise("Y"))
    return agreement.quorums(two, "item", "rater", "label", 3)


@query(f"WITH {SQL_VOTES}, x AS (SELECT 'raw' AS encoding, item, label FROM votes UNION ALL SELECT 'binary', item, CASE WHEN label = 'N' THEN 'N' ELSE 'Y' END FROM votes), {_sql_kappa('encoding', 'x')} SELECT encoding, round(kappa, 9) AS kappa FROM k")
def kappa_encodings(spark, sf_dir):
    two = F.when(F.col("label") == "N", "N").otherwise("Y")
    return rounded(agreement.kappa_by_encoding(ratings(spark, sf_dir), "item", {"raw": F.col("label"), "binary": two}), "kappa")


@query(
    f"""{SQL_EXPERT}, b AS (SELECT rater, {SQL_BUCKET} AS bucket FROM ea UNION ALL SELECT rater, 'all' FROM ea), s AS (SELECT bucket, count(*) AS n_raters FROM b WHERE bucket IS NOT NULL GROUP BY bucket),
    g AS (SELECT bucket, item, label FROM votes JOIN b USING (rater)), {_sql_kappa('bucket', 'g', 'p')}
    SELECT bucket, n_raters, CASE WHEN n_raters > 1 THEN round(kappa, 9) END AS kappa FROM s LEFT JOIN pk USING (bucket)"""
)
def bucket_kappas(spark, sf_dir):
    votes_ = ratings(spark, sf_dir)
    ranked = agreement.expert_agreement(votes_, "item", "rater", "label", 1)
    return rounded(agreement.bucket_kappas(votes_, ranked, "item", "rater", "label", {"all": L.KAPPA_NAMES}), "kappa")


@query(
    f"""WITH {SQL_VOTES}, v2 AS (SELECT item % 2 AS phase, * FROM votes), l2 AS (SELECT w.rater AS without, v.* FROM v2 v JOIN (SELECT DISTINCT rater FROM votes) w ON w.rater <> v.rater),
    {_sql_kappa('phase', 'v2', 'a')}, {_sql_kappa('phase, without', 'l2', 'b')}
    SELECT 'All' AS without, phase, 'label' AS label, round(kappa, 9) AS kappa FROM ak UNION ALL SELECT without::VARCHAR, phase, 'label', round(kappa, 9) FROM bk"""
)
def kappa_matrix(spark, sf_dir):
    phased = ratings(spark, sf_dir).withColumn("phase", F.col("item") % 2)
    return rounded(agreement.result_matrix(phased, "item", "rater", ["label"], "phase"), "kappa")


# ------------------------------------------------------------------ words and classes

STOP = ("the", "and", "was", "that", "der", "die", "und", "les", "que", "los")
SQL_DROP = ", ".join(f"'{w}'" for w in (*STOP, *association.KEYWORDS))
SQL_TOKENS = f"tok AS (SELECT d.doc_id, d.source, list_filter(string_split(lower(replace(regexp_replace(d.text, '[^A-Za-zäÄöÖüÜß]+', ' ', 'g'), 'TwitterUser', ' ')), ' '), lambda w: length(w) > 2 AND w NOT IN ({SQL_DROP})) AS words FROM documents d)"


def _tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", association.clean_tokens(F.col("text"), stop_words=STOP).alias("words"))


@query(f"WITH {SQL_TOKENS} SELECT doc_id, array_to_string(words, ' ') AS cleaned FROM tok")
def token_cleaning(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.array_join("words", " ").alias("cleaned"))


def _raw_tokens(spark, sf_dir) -> DataFrame:
    docs = association.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", association.raw_tokens(F.col("text")).alias("words"))


def _counted(word):
    return association.counted(word, STOP)


@query(f"WITH {SQL_TOKENS}, w AS (SELECT doc_id, unnest(words) AS word FROM tok) SELECT word, count(*) AS count, count(DISTINCT doc_id) AS docs FROM w GROUP BY word HAVING count(DISTINCT doc_id) >= 2")
def term_frequency(spark, sf_dir):
    return association.term_frequency(_raw_tokens(spark, sf_dir), "words", keep=_counted)


SQL_LEMMA = "CASE WHEN word LIKE '%ing' THEN left(word, length(word) - 3) WHEN word LIKE '%en' THEN left(word, length(word) - 2) || 'e' WHEN word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END"


@query(
    f"""WITH {SQL_TOKENS}, x AS (SELECT doc_id, unnest(words) AS word FROM tok), w AS (SELECT word, count(*) AS n FROM x GROUP BY word),
    tb AS (SELECT DISTINCT word AS form, {SQL_LEMMA} AS lemma FROM x WHERE doc_id % 2 = 0 AND length(word) > 5), p AS (SELECT form, lemma, list_max(list_filter(range(0, length(form) + 1), lambda k: starts_with(lemma, left(form, k)))) AS p FROM tb),
    v AS (SELECT right(form, k) AS suffix, substring(form, p + 1) AS cut, substring(lemma, p + 1) AS add, count(*) AS n FROM p, unnest(range(1, 5)) t(k) WHERE k <= length(form) AND k >= length(form) - p GROUP BY ALL),
    r AS (SELECT suffix, cut, add FROM v QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, add) = 1),
    e AS (SELECT word, k, right(word, k) AS suffix FROM w, unnest(range(1, 5)) t(k) WHERE k < length(word)),
    u AS (SELECT word, arg_max(left(word, length(word) - length(cut)) || add, k) AS lemma FROM e JOIN r ON r.suffix = e.suffix GROUP BY word)
    SELECT coalesce(tb.lemma, u.lemma, w.word) AS lemma, sum(n)::BIGINT AS count, count(*) AS forms FROM w LEFT JOIN tb ON tb.form = w.word LEFT JOIN u ON u.word = w.word GROUP BY ALL"""
)
def lemma_counts(spark, sf_dir):
    """Words by lemma: forms of half of the documents are in a table, the others follow its suffix rules."""
    parted = _raw_tokens(spark, sf_dir).withColumn("even", F.col("doc_id") % 2 == 0)
    both = association.stored(association.word_counts(parted, "words", ["even"], _counted), "words")  # the documents are read once
    counts = both.groupBy("word").agg(F.sum("count").alias("count"))
    seen = both.filter(F.col("even") & (F.length("word") > 5)).select("word").distinct()
    table_ = seen.select(F.col("word").alias("form"), F.expr(SQL_LEMMA).alias("lemma"))
    return association.lemma_counts(counts, table_)


@query(f"WITH {SQL_TOKENS} SELECT sum(len(words))::BIGINT AS words FROM tok")
def corpus_words(spark, sf_dir):
    return association.corpus_words(_raw_tokens(spark, sf_dir), "words", _counted)


@query(
    f"""WITH {SQL_TOKENS}, d AS (SELECT t.doc_id, t.words, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS cls FROM tok t JOIN labels l ON l.doc_id = t.doc_id),
    w AS (SELECT doc_id, cls, unnest(words) AS word FROM d), xy AS (SELECT cls, word, count(*) AS n_xy, count(DISTINCT doc_id) AS docs FROM w GROUP BY ALL), y AS (SELECT word, sum(n_xy) AS n_y FROM xy GROUP BY word),
    x AS (SELECT cls, count(*) AS n_x FROM d GROUP BY cls), n AS (SELECT sum(len(words))::DOUBLE AS n FROM d),
    s AS (SELECT cls, word, n_xy, ln((n_xy / n) / ((n_x / n) * (n_y / n))) / -ln(n_xy / n) AS npmi FROM xy JOIN y USING (word) JOIN x USING (cls), n WHERE docs >= 2)
    SELECT cls, word, n_xy, npmi, rank FROM (SELECT cls, word, n_xy, round(npmi, 9) AS npmi, CAST(row_number() OVER (PARTITION BY cls ORDER BY round(npmi, 9) DESC, word) AS INT) AS rank FROM s) WHERE rank <= 20"""
)
def npmi_top20(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("cls"))
    scores = association.npmi(_raw_tokens(spark, sf_dir).join(marks, "doc_id"), "words", "cls", keep=_counted)
    return association.top_words(rounded(scores, "npmi"), "cls", 20)
