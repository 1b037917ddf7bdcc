"""Queries that go through files: the driver's tables are written as raw corpora, caches and reports, and read by the loaders and sinks.

Each query writes whole tables to a folder of its own in the session's shared
folder. Its SQL says from the tables alone what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexeum import job, schema
from lexeum.dataset import UnifiedDataset
from lexeum.functions import labels as L
from lexeum.functions import text as T
from lexeum.operators import agreement, association, splits, statistics, translation
from lexeum.plans import catalogue as K
from lexeum.session import scratch_path, with_conf
from lexeum.sources import corpora, readers, sinks

ORDERED_REASONS = tuple(sorted((*corpora.REASON_LABELS, *corpora.UNMAPPED_REASONS)))
#: A large table's files are read in ranges of its size by this.
RANGES = 256
NO_LABELS = {x: f"NULL::DOUBLE AS {x}" for x in schema.LABELS}


def _csv(df: DataFrame, path: str, sep: str = ",") -> None:
    opts = {"header": True, "sep": sep, "quoteAll": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "", "emptyValue": ""}
    df.write.options(**opts).csv(path)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, said (the whole text among signs that a reader must keep), lang, quality, toxic of all documents; those without labels have some by their id."""
    said = F.concat(F.lit('say "'), F.col("text"), F.lit('", and'), F.lit("\n"), F.col("lang"))
    docs = K.table(spark, sf_dir, "documents").select("doc_id", "lang", said.alias("said")).join(K.table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.withColumn("quality", F.coalesce("quality", (F.col("doc_id") % 2).cast("int"))).withColumn("toxic", F.coalesce("toxic", (F.col("doc_id") % 3 == 0).cast("int")))


SQL_SAID = """'say "' || d.text || '", and' || chr(10) || d.lang"""
SQL_LABELLED = f"x AS (SELECT d.doc_id, d.lang, {SQL_SAID} AS said, coalesce(l.quality, d.doc_id % 2) AS quality, coalesce(l.toxic, (d.doc_id % 3 = 0)::INT) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def _unified(text: str, source: str, language: str, split: str = "NULL::VARCHAR", **labels: str) -> str:
    cols = ", ".join(f"({labels[x]})::INT::DOUBLE AS {x}" if x in labels else NO_LABELS[x] for x in schema.LABELS)
    return f"SELECT {text} AS text, '{source}' AS source, '{language}' AS language, {split} AS split, {cols}"


# ------------------------------------------------------------------ loaders


def _write_gmhp7k(spark, sf_dir, root):
    x = _labelled(spark, sf_dir)
    base = f"{root}/corpus-gmhp7k/datasets/misogynistic_hatespeech_phase"
    one = x.select(F.col("doc_id").alias("tweet_id"), F.col("said").alias("review_text"), F.col("toxic").alias("hs"), F.lit(0).alias("m_hs"))
    three = x.select(F.col("doc_id").alias("tweet_id"), F.lit("late").alias("review_text"), F.col("quality").alias("hs"), F.col("toxic").alias("m_hs"), F.when(F.col("doc_id") % 3 == 0, "train").alias("split_hs"))
    _csv(one, f"{base}1.csv")
    _csv(three, f"{base}3.csv")


@K.query(f"WITH {SQL_LABELLED} {_unified('said', 'gmhp7k', 'de', "CASE WHEN doc_id % 3 = 0 THEN 'train' END", hate_speech='toxic = 1 OR quality = 1')} FROM x")
def load_gmhp7k(spark, sf_dir):
    """Two phases whose files differ in columns, texts with quotes and line breaks."""
    root = scratch_path(spark, "raw")
    _write_gmhp7k(spark, sf_dir, root)
    return corpora.gmhp7k(spark, root)


@K.query(f"WITH {SQL_LABELLED} {_unified('said', 'hocon34k', 'de', "CASE WHEN doc_id % 2 = 0 THEN 'test' END", hate_speech='toxic = 1 OR quality = 1')} FROM x")
def load_hocon34k(spark, sf_dir):
    """Two votes a post; texts missing in one of them, blank splits, votes for no post."""
    root, x = scratch_path(spark, "raw"), _labelled(spark, sf_dir)
    split = F.when(F.col("doc_id") % 2 == 0, "test").otherwise(F.lit("  "))
    one = x.select(F.col("doc_id").alias("post_id"), F.lit(48).alias("annotator_id"), F.when(F.col("doc_id") % 3 != 0, F.col("said")).alias("text"), F.col("toxic").alias("label_hs"), split.alias("split_all"))
    two = x.select("doc_id", F.lit(54), "said", "quality", split)
    none = x.select(F.lit(None).cast("long"), F.lit(54), F.lit("lost"), F.lit(1), F.lit("test"))
    _csv(one.union(two).union(none), f"{root}/hocon34k/corpus-hocon34k/datasets/hatespeech_hocon34k.csv")
    return corpora.hocon34k(spark, root)


def _write_detox(spark, sf_dir, root):
    x = _labelled(spark, sf_dir)
    comments = x.select(F.col("doc_id").cast("double").alias("rev_id"), F.replace("said", F.lit("\n"), F.lit(T.NEWLINE_TOKEN)).alias("comment"), F.col("lang").alias("split"))
    marks = x.select(F.col("doc_id").alias("rev_id"), F.explode(F.array("toxic", "quality", F.lit(0))).alias("toxicity"))
    _csv(marks, f"{root}/detox/toxicity_comments.tsv", "\t")  # the two have changed names
    _csv(comments, f"{root}/detox/toxicity_annotations.tsv", "\t")


SQL_DETOX = f"{_unified('said', 'detox', 'en', 'lang', toxic='toxic = 1 AND quality = 1')} FROM x"


@K.query(f"WITH {SQL_LABELLED} {SQL_DETOX}")
def load_detox(spark, sf_dir):
    """Tab-separated; comments found by their header, three votes each."""
    root = scratch_path(spark, "raw")
    _write_detox(spark, sf_dir, root)
    return corpora.detox(spark, root)


@K.query(
    f"""WITH {SQL_LABELLED}, j AS (SELECT *, 'train' AS split FROM x UNION ALL SELECT *, 'test' FROM x WHERE quality = 1)
    SELECT said AS text, 'jigsaw' AS source, 'multilingual' AS language, split, (doc_id % 2)::DOUBLE AS hate_speech, (toxic = 1 OR quality = 0)::INT::DOUBLE AS toxic, (doc_id % 3 = 0)::INT::DOUBLE AS threat, toxic::DOUBLE AS insult, NULL::DOUBLE AS impolite FROM j"""
)
def load_jigsaw(spark, sf_dir):
    """Flags; obscene is dropped, unscored test rows go, a missing id meets a missing id. Files of texts with line breaks, read in ranges: of 64 KB in small tables, of more in large ones, so that their number does not grow with the table."""
    size = sum(readers.sizes(spark, f"{sf_dir}/documents.parquet"))
    spark = with_conf(spark, {readers.WHOLE: 0, "spark.sql.files.maxPartitionBytes": min(max(1 << 16, size // RANGES), 128 << 20), "spark.sql.files.openCostInBytes": 0})
    root, x = scratch_path(spark, "raw"), _labelled(spark, sf_dir)
    flags = [F.col("toxic"), (1 - F.col("quality")).alias("severe_toxic"), F.lit(1).alias("obscene"), (F.col("doc_id") % 3 == 0).cast("int").alias("threat"), F.col("toxic").alias("insult"), (F.col("doc_id") % 2).alias("identity_hate")]
    _csv(x.select(F.col("said").alias("comment_text"), *flags), f"{root}/jigsaw/train.csv")
    test = x.withColumn("id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    _csv(test.select("id", F.col("said").alias("comment_text")), f"{root}/jigsaw/test.csv")
    unscored = F.when(F.col("quality") == 0, -1).otherwise(F.col("toxic")).alias("toxic")
    _csv(test.select("id", unscored, *flags[1:]), f"{root}/jigsaw/test_labels.csv")
    return corpora.jigsaw(spark, root)


def _write_attacks(spark, sf_dir, root):
    orders = K.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("double").alias("rev_id"), F.concat("o_orderpriority", F.lit(", \"x\" "), F.col("o_orderkey").cast("string")).alias("comment"))
    marks = K.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rev_id"), F.col("l_linenumber").alias("worker_id"), (F.col("l_returnflag") == "R").cast("int").alias("attack"))
    _csv(orders, f"{root}/wikipedia_attacks/attack_annotated_comments.csv")
    _csv(marks, f"{root}/wikipedia_attacks/attack_annotations.csv")


SQL_ATTACKS = f"""v AS (SELECT l_orderkey, avg((l_returnflag = 'R')::INT) AS m FROM lineitem GROUP BY l_orderkey),
    a AS ({_unified("o_orderpriority || ', \"x\" ' || o_orderkey", 'wikipedia_attacks', 'en', insult='m >= 0.5')} FROM orders JOIN v ON l_orderkey = o_orderkey)"""


@K.query(f"WITH {SQL_ATTACKS} SELECT * FROM a")
def load_attacks(spark, sf_dir):
    root = scratch_path(spark, "raw")
    _write_attacks(spark, sf_dir, root)
    return corpora.wikipedia_attacks(spark, root)


def _write_politeness(spark, sf_dir, root):
    rows = K.table(spark, sf_dir, "conversations")
    mark = F.when(F.col("turn") % 4 < 3, (F.col("turn") % 4 - 1).cast("int"))
    rows.select(F.to_json(F.struct("text", F.struct(mark.alias("Binary")).alias("meta")))).write.text(f"{root}/politeness/wikipedia-politeness-corpus/utterances.jsonl")


SQL_POLITE = f"{_unified('text', 'wikipedia_politeness', 'en', impolite='CASE turn % 4 WHEN 0 THEN 1 WHEN 2 THEN 0 END')} FROM conversations"


@K.query(SQL_POLITE)
def load_politeness(spark, sf_dir):
    root = scratch_path(spark, "raw")
    _write_politeness(spark, sf_dir, root)
    return corpora.wikipedia_politeness(spark, root)


SQL_STRIPPED = rf"regexp_replace(text, '^[{K.WS}]+|[{K.WS}]+$', '', 'g')"
_REASON = ", ".join(f"'{r}'" for r in ORDERED_REASONS)
SQL_MODERATED = f"""m AS (SELECT {SQL_STRIPPED} AS text, CASE WHEN doc_id % 2 = 0 THEN 'Rejected' ELSE 'Accepted' END AS moderation_state_raw, coalesce(([{_REASON}, NULL])[1 + (doc_id % 7)::INT], '') AS deletion_reason_raw,
    coalesce(([{_REASON}])[1 + (doc_id // 7 % 6)::INT], '') AS notice_reason_raw FROM documents WHERE doc_id % 4 <> 0 AND {SQL_STRIPPED} <> '')"""


def _sql_reason(label: str) -> str:
    names = ", ".join(f"'{r}'" for r in corpora.reasons_for(label))
    return f"(deletion_reason_raw IN ({names}) OR notice_reason_raw IN ({names}))::INT::DOUBLE AS {label}"


@K.query(
    f"""WITH {SQL_MODERATED} SELECT text, 'gutefrage' AS source, 'de' AS language, NULL::VARCHAR AS split, {_sql_reason('hate_speech')}, {_sql_reason('toxic')}, NULL::DOUBLE AS threat, {_sql_reason('insult')}, NULL::DOUBLE AS impolite,
    moderation_state_raw, deletion_reason_raw, notice_reason_raw FROM m"""
)
def load_gutefrage(spark, sf_dir):
    """A sheet's export: bodies that are placeholders fall back to titles, rows without either go; wider than the unified schema."""
    root = scratch_path(spark, "raw")
    said, k = F.col("text"), F.col("doc_id") % 4
    pick = lambda i: F.get(F.array(*map(F.lit, ORDERED_REASONS)), i.cast("int"))
    body = F.when(k == 0, F.lit(" <NA> ")).when(k == 1, F.lit("None")).when(k == 3, F.concat(F.lit("  "), said, F.lit("\t")))
    title = F.when(k == 0, F.lit("   ")).otherwise(said)
    state = F.when(F.col("doc_id") % 2 == 0, F.lit(" Rejected ")).otherwise(F.lit("Accepted"))
    raw = K.table(spark, sf_dir, "documents").select(state.alias("moderation_state"), title.alias("question_title"), body.alias("body"), pick(F.col("doc_id") % 7).alias("deletion_reason"), F.concat(pick(F.floor(F.col("doc_id") / 7) % 6), F.lit(" ")).alias("notice_reason"))
    raw.write.parquet(f"{root}/gutefrage.net/dataset/datensatz_moderiert.parquet")
    return corpora.gutefrage_with_provenance(spark, root)


@K.query(f"WITH {SQL_LABELLED}, u AS ({SQL_DETOX} UNION ALL {SQL_POLITE}) SELECT source, split, count(*) AS count FROM u GROUP BY ALL")
def selected_corpora(spark, sf_dir):
    """Two corpora by name, one of them named twice, as one dataset; its sorted split statistics."""
    root = scratch_path(spark, "raw")
    _write_detox(spark, sf_dir, root)
    _write_politeness(spark, sf_dir, root)
    return UnifiedDataset(spark, root).load(["detox", "wikipedia_politeness", "detox"]).split_stats()


@K.query("SELECT 'unknown corpora: [' || string_agg(chr(39) || source || chr(39), ', ' ORDER BY source) || ']' AS message FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def unknown_corpora(spark, sf_dir):
    """What is said of names that are no corpus: the sources of the documents (twenty)."""
    names = [r.source for r in K.table(spark, sf_dir, "documents").select("source").filter("source IS NOT NULL").distinct().collect()]
    try:
        UnifiedDataset(spark, sf_dir).load(["detox", *names])
    except ValueError as e:
        return spark.createDataFrame([(str(e).split(";")[0],)], "message string")
    raise AssertionError("unknown names were taken")


@K.query("SELECT DISTINCT trim(w) AS word FROM (SELECT lower(source) AS w FROM documents UNION ALL SELECT lang FROM documents UNION ALL SELECT p_brand FROM part) WHERE trim(w) <> ''")
def word_list(spark, sf_dir):
    """A list with repeated words, blanks around them and empty lines."""
    path, docs = scratch_path(spark, "words"), K.table(spark, sf_dir, "documents")
    words = docs.select(F.concat(F.lit(" "), F.lower("source"))).union(docs.select("lang")).union(K.table(spark, sf_dir, "part").select("p_brand")).union(docs.select(F.lit(" ")))
    words.toDF("value").write.text(path)
    return readers.read_words(spark, path)


@K.query("SELECT n_name AS text, 'nation' AS source, NULL::VARCHAR AS language, NULL::VARCHAR AS split, NULL::DOUBLE AS hate_speech, (n_regionkey % 2)::DOUBLE AS toxic, NULL::DOUBLE AS threat, NULL::DOUBLE AS insult, NULL::DOUBLE AS impolite FROM nation")
def rows_relation(spark, sf_dir):
    """A unified frame of row dictionaries (a table of 25 rows)."""
    return schema.from_rows(spark, [{"text": r.n_name, "source": "nation", "toxic": float(r.n_regionkey % 2)} for r in K.table(spark, sf_dir, "nation").collect()])


# ------------------------------------------------------------------ sinks, cache, job


@K.query(
    f"""WITH {K.SQL_TR} SELECT CASE WHEN lang = 'en' AND c <> '' THEN '[de] ' || c ELSE text END AS text, 'x' AS source, CASE WHEN lang = 'en' AND c <> '' THEN 'de' ELSE lang END AS language, NULL::VARCHAR AS split,
    {", ".join(NO_LABELS.values())}, 'unified_translated.parquet' AS file FROM t"""
)
def saved_dataset(spark, sf_dir):
    """The processed table, written without what translation added, and read again."""
    docs = K._to_translate(spark, sf_dir)
    frame = schema.unify(docs, text=F.col("text"), source="x", language=F.col("language"))
    path = sinks.save(translation.Translator(translation.tagging_backend()).translate(frame), scratch_path(spark, "out"), translate=True)
    return readers.read_parquet_or_empty(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.UNIFIED)).withColumn("file", F.lit(path.rsplit("/", 1)[1]))


@K.query(f"WITH {K.SQL_CORPUS} SELECT source, split, count(*) AS count FROM corpus GROUP BY ALL")
def saved_report(spark, sf_dir):
    """A report as CSV, read again."""
    path = sinks.save_report(statistics.split_stats(K.unified(spark, sf_dir)), scratch_path(spark, "report"))
    return readers.read_csv(spark, path, {"count": "long"})


def _never():
    def call(texts):
        raise RuntimeError("all texts are in the cache")

    return call


@K.query(K.ORACLES["translate_status"])
def cache_round_trip(spark, sf_dir):
    """Translated once, and again by a backend that fails on every text: all come from the cache, which is then made one table."""
    path, docs = scratch_path(spark, "cache"), K._to_translate(spark, sf_dir)
    first = translation.Translator(translation.tagging_backend(), path)
    first.translate(docs).write.format("noop").mode("overwrite").save()
    again = translation.Translator(_never, path)
    again.translate(docs.limit(0)).write.format("noop").mode("overwrite").save()
    again.compact(spark)
    return again.translate(docs)


def _odd_only():
    def call(texts):
        if any(len(t) % 2 == 0 for t in texts):
            raise RuntimeError("a text of even length")
        return ["[de] " + t for t in texts]

    return call


@K.query(
    f"""WITH {K.SQL_TR} SELECT doc_id, CASE WHEN lang <> 'en' THEN 'not_applicable' WHEN c = '' THEN 'empty' WHEN length(c) % 2 = 0 THEN 'failed' ELSE 'success' END AS translation_status,
    CASE WHEN lang = 'en' AND c <> '' AND length(c) % 2 = 1 THEN 'de' ELSE lang END AS language FROM t"""
)
def failed_texts(spark, sf_dir):
    """Batches that fail are tried text by text; texts that fail stay."""
    out = translation.Translator(_odd_only, batch_size=7).translate(K._to_translate(spark, sf_dir))
    return out.select("doc_id", "translation_status", "language")


@K.query("SELECT 'missing columns: [''language'', ''text'']' AS message")
def translator_columns(spark, sf_dir):
    try:
        translation.Translator(translation.tagging_backend()).translate(K.table(spark, sf_dir, "nation"))
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "message string")
    raise AssertionError("missing columns were not seen")


@K.query(f"WITH {SQL_ATTACKS} SELECT '[de] ' || text AS text, source, 'de' AS language, insult, TRUE AS has_split FROM a")
def job_end_to_end(spark, sf_dir):
    """Load, translate, assign splits, report and save, as on the command line."""
    root = scratch_path(spark, "raw")
    _write_attacks(spark, sf_dir, root)
    path = job.run(spark, root, scratch_path(spark, "out"), ["wikipedia_attacks"], translate=True, assign_splits=True, backend=translation.tagging_backend())
    return spark.read.parquet(path).select("text", "source", "language", "insult", F.col("split").isin(*splits.NAMES).alias("has_split"))


# ------------------------------------------------------------------ what only reports need


@K.query(f"WITH {K.SQL_CORPUS} SELECT count(*) FILTER (WHERE split IS NULL) AS before, 0::BIGINT AS after FROM corpus")
def splits_before_after(spark, sf_dir):
    df = K.unified(spark, sf_dir)
    before = statistics.without_split(df, "before")
    return before.crossJoin(statistics.without_split(splits.assign_missing_splits(df), "after"))  # one row each


@K.query(
    """WITH x AS (SELECT toxic::DOUBLE AS a, quality::DOUBLE AS b, CASE WHEN doc_id % 4 <> 0 THEN (toxic + doc_id % 3)::DOUBLE END AS c FROM labels), y AS (SELECT * FROM x WHERE c IS NOT NULL)
    SELECT p AS label_a, q AS label_b, round(CASE p || q WHEN 'ab' THEN ab WHEN 'ba' THEN ab WHEN 'ac' THEN ac WHEN 'ca' THEN ac WHEN 'bc' THEN bc WHEN 'cb' THEN bc ELSE 1.0 END, 9)::DOUBLE AS corr
    FROM (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM y), (VALUES ('a'), ('b'), ('c')) s(p), (VALUES ('a'), ('b'), ('c')) t(q)"""
)
def label_corr_listwise(spark, sf_dir):
    rows = K.table(spark, sf_dir, "labels").select(F.col("toxic").cast("double").alias("a"), F.col("quality").cast("double").alias("b"), F.when(F.col("doc_id") % 4 != 0, F.col("toxic") + F.col("doc_id") % 3).cast("double").alias("c"))
    return K.rounded(statistics.correlations(rows, ("a", "b", "c"), listwise=True), "corr")


@K.query(f"SELECT kappa, (SELECT count(*) > 0 FROM lineitem WHERE l_orderkey % 100 = 0) AS refused FROM ({K.ORACLES['fleiss_kappa']})")
def strict_kappa(spark, sf_dir):
    """Kappa over votes that are checked to be one a rater and item; the same votes with those of some items twice are refused."""
    votes_ = K.ratings(spark, sf_dir)
    twice = votes_.union(votes_.filter("item % 100 = 0"))
    try:
        agreement.fleiss_kappa(twice, "item", "label", rater="rater").collect()
        refused = False
    except Exception as e:  # noqa: BLE001  the message tells whether it is the check's
        refused = "a rater voted twice" in str(e)
    return K.rounded(agreement.fleiss_kappa(votes_, "item", "label", rater="rater"), "kappa").withColumn("refused", F.lit(refused))


@K.query(
    f"""WITH {K.SQL_VOTES}, g AS (SELECT a.item, row_number() OVER (PARTITION BY a.item ORDER BY a.rater, b.rater, c.rater) - 1 AS rank, CASE WHEN (a.label = 'N')::INT + (b.label = 'N')::INT + (c.label = 'N')::INT >= 2 THEN 'N' ELSE 'Y' END AS label
        FROM votes a JOIN votes b ON b.item = a.item AND b.rater > a.rater JOIN votes c ON c.item = a.item AND c.rater > b.rater),
    d AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY md5('42|' || item || '|' || rank), rank) AS place FROM g)
    SELECT CAST(row_number() OVER (PARTITION BY item ORDER BY rank) AS INT) AS group_id, item, label FROM d WHERE place <= 5"""
)
def quorum_sample(spark, sf_dir):
    """Five of all groups of three raters of each item, or all there are."""
    two = K.ratings(spark, sf_dir).withColumn("label", F.when(F.col("label") == "N", "N").otherwise("Y"))
    return agreement.quorums(two, "item", "rater", "label", 3, 5)


SQL_CLASS = "CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'misogynistic' WHEN l.toxic = 1 THEN 'hateful' ELSE 'neutral' END"


@K.query(
    f"""WITH {K.SQL_TOKENS}, d AS (SELECT t.doc_id, t.words, {SQL_CLASS} AS cls FROM tok t JOIN labels l ON l.doc_id = t.doc_id),
    w AS (SELECT doc_id, cls, unnest(words) AS word FROM d), xy AS (SELECT cls, word, count(*) AS n_xy, count(DISTINCT doc_id) AS docs FROM w GROUP BY ALL), y AS (SELECT word, sum(n_xy) AS n_y FROM xy GROUP BY word),
    x AS (SELECT cls, count(*) AS n_x FROM d GROUP BY cls), n AS (SELECT sum(len(words))::DOUBLE AS n FROM d),
    s AS (SELECT cls, word, n_xy, ln((n_xy / n) / ((n_x / n) * (n_y / n))) / -ln(n_xy / n) AS npmi FROM xy JOIN y USING (word) JOIN x USING (cls), n WHERE docs >= 2)
    SELECT cls, word, n_xy, round(npmi * 100, 7) AS npmi, rank FROM (SELECT cls, word, n_xy, round(npmi, 9) AS npmi, CAST(row_number() OVER (PARTITION BY cls ORDER BY round(npmi, 9) DESC, word) AS INT) AS rank FROM s) WHERE rank <= 20"""
)
def npmi_classes(spark, sf_dir):
    """Words of the misogynistic, hateful and neutral class, scaled by 100."""
    cls = association.class_of(F.col("toxic"), F.col("toxic") * (1 - F.col("quality"))).alias("cls")
    marks = K.table(spark, sf_dir, "labels").select("doc_id", cls)
    scores = association.npmi(K._raw_tokens(spark, sf_dir).join(marks, "doc_id"), "words", "cls", keep=K._counted)
    return K.rounded(association.top_words(K.rounded(scores, "npmi"), "cls", 20, 100.0), "npmi", digits=7)


@K.query("SELECT event_type, format('{:,}', sum(event_id)::BIGINT) AS total, printf('%.0f%%', (count(*) - count(*) % 2)::DOUBLE / 4) AS quarter, printf('%.2f %%', count(*) * 100.0 / (SELECT count(*) FROM events)) AS share, printf('%.1f%%', avg(user_id)::DOUBLE) AS mean FROM events GROUP BY event_type")
def number_formats(spark, sf_dir):
    events = K.table(spark, sf_dir, "events")
    shares = statistics.value_shares(events, "event_type").select("event_type", T.percent(F.col("share") * 100.0).alias("share"))
    sums = events.groupBy("event_type").agg(T.thousands(F.sum("event_id")).alias("total"), T.percent(F.avg("user_id"), 1, blank=False).alias("mean"), T.percent((F.count("*") - F.count("*") % 2) / 4, 0, blank=False).alias("quarter"))
    return shares.join(sums, "event_type")


@K.query(f"SELECT kappa, upper(left(b, 1)) || substring(b, 2) AS bucket FROM (SELECT kappa, {K.SQL_BUCKET} AS b FROM (SELECT (l_linenumber - 3) / 5.0::DOUBLE AS kappa FROM lineitem GROUP BY l_linenumber))")
def bucket_names(spark, sf_dir):
    rows = K.table(spark, sf_dir, "lineitem").select(((F.col("l_linenumber") - 3) / 5.0).alias("kappa")).distinct()
    return rows.withColumn("bucket", T.capitalised(L.kappa_bucket(F.col("kappa"))))


@K.query(
    rf"""WITH w AS (SELECT source, len(regexp_extract_all(text, '[^{K.WS}]+')) AS wc FROM documents)
    SELECT source, count(*) AS texts, min(wc)::INT AS min, trunc(quantile_cont(wc, 0.5))::INT AS median, round(avg(wc), 1) AS mean, trunc(quantile_cont(wc, 0.95))::INT AS p95, trunc(quantile_cont(wc, 0.99))::INT AS p99, max(wc)::INT AS max FROM w GROUP BY source"""
)
def length_table(spark, sf_dir):
    return statistics.length_table(K.table(spark, sf_dir, "documents"))


@K.query(f"WITH m AS ({K.ORACLES['kappa_matrix']}) SELECT without, phase, label, round(kappa, 4) AS kappa, CAST(row_number() OVER (ORDER BY without <> 'All', without, phase) AS INT) AS position FROM m")
def last_row_first(spark, sf_dir):
    """The result matrix with its last row, of all raters, in front."""
    phased = K.ratings(spark, sf_dir).withColumn("phase", F.col("item") % 2)
    out = agreement.result_matrix(phased, "item", "rater", ["label"], "phase")
    shown = statistics.last_first(out, "without", "All", "phase").withColumn("_at", F.monotonically_increasing_id())  # grows with the place in the order
    place = F.row_number().over(Window.orderBy("_at"))  # a row a rater and phase
    return K.rounded(shown.withColumn("position", place).drop("_at"), "kappa", digits=4)
