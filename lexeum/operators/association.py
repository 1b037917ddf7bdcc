"""How words go with classes: token cleaning, term frequencies and normalised pointwise mutual information."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeum.functions import text as T
from lexeum.session import scratch_path

# Words the data was gathered with, which say nothing about it.
KEYWORDS = ("dorfmatratze", "flittchen", "fotze", "hürchen", "hure", "schlampe", "bitch", "cunt", "hoe", "pussy", "slut", "whore")


def clean_tokens(c: Column, stop_words: Iterable[str] = (), for_transformer: bool = False, lemmatise=None) -> Column:
    """Lower-case tokens of letters; without those of one or two letters, stop words and keywords unless for a transformer.

    ``lemmatise`` may be a function from column to column, applied before.
    """
    text = T.letters_only(c)
    if for_transformer:
        return T.tokens(F.lower(text))
    words = T.tokens(F.lower(lemmatise(text) if lemmatise else text))
    drop = sorted({w.lower() for w in stop_words} | set(KEYWORDS))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*drop))


def cleaned_text(c: Column, **options) -> Column:
    return F.array_join(clean_tokens(c, **options), " ")


def raw_tokens(c: Column, lemmatise=None) -> Column:
    """All tokens in small letters, empty ones among them: filtered by :func:`counted` once they are rows."""
    return F.split(F.lower(lemmatise(T.letters_only(c))), " ") if lemmatise else T.small_words(c)


def counted(word: Column, stop_words: Iterable[str] = ()) -> Column:
    """Is the word one that :func:`clean_tokens` keeps?"""
    return (F.length(word) > 2) & ~word.isin(*sorted({w.lower() for w in stop_words} | set(KEYWORDS)))


def word_counts(df: DataFrame, tokens: str, by: Iterable[str] = (), keep=None, rows: bool = False) -> DataFrame:
    """(by..., word, count, docs): occurrences and documents (rows of ``df``) of each word; ``keep`` is a condition on the word.

    A row's tokens are sorted, so that a word's first place in its row is seen
    from the token before, and both counts come from one partial aggregation.
    With ``rows`` there is also a null word, whose count is the group's rows;
    tokens themselves are never null.
    """
    by = list(by)
    own = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    sorted_ = F.sort_array(F.array_append(own, F.lit(None).cast("string")) if rows else own)  # null is the first
    each = df.select(*by, sorted_.alias("_t")).select(*by, "_t", F.posexplode("_t").alias("_p", "word"))
    each = each.filter(F.col("word").isNull() | keep(F.col("word"))) if keep else each
    first = (F.col("_p") == 0) | ~F.get("_t", F.col("_p") - 1).eqNullSafe(F.col("word"))
    return each.groupBy(*by, "word").agg(F.count("*").alias("count"), F.count_if(first).alias("docs"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files have fewer parts than these (one small file is one part); larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def suffix_rules(table: DataFrame, longest: int = 4) -> DataFrame:
    """(suffix, cut, add): how words that end so are made to lemmas, from a table of (form, lemma).

    What a form and its lemma have in common at their beginning stays; each
    suffix of the form, from what is cut to ``longest`` letters, has a vote for
    that change, and the change of most votes wins, ties by cut and add.
    """
    shared = F.array_max(F.filter(F.sequence(F.lit(0), F.length("form")), lambda k: F.startswith(F.col("lemma"), F.substr("form", F.lit(1), k))))
    cut = F.substr("form", F.col("p") + 1)
    rows = table.select("form", "lemma", shared.alias("p")).select("form", cut.alias("cut"), F.substr("lemma", F.col("p") + 1).alias("add"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("form")))).alias("k")).filter(F.col("k") >= F.length("cut"))
    votes = rows.groupBy(F.right("form", F.col("k")).alias("suffix"), "cut", "add").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("suffix").orderBy(F.desc("n"), "cut", "add"))
    return votes.withColumn("_r", best).filter("_r = 1").select("suffix", "cut", "add")


def lemmas(words: DataFrame, table: DataFrame, longest: int = 4) -> DataFrame:
    """(word, lemma) of the distinct words of ``words``: as in ``table`` (form, lemma; one a form), else by the rule of the longest suffix, else the word.

    Everything is joined by word or suffix, a row a distinct word: the table and
    its rules may be of any size, and Spark broadcasts them where they are small.
    """
    known = words.select("word").distinct().join(table.select(F.col("form").alias("word"), "lemma"), "word", "left")
    ends = known.filter("lemma IS NULL").select("word", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.greatest(F.length("word") - 1, F.lit(1))))).alias("k")).filter(F.col("k") < F.length("word"))
    ends = ends.withColumn("suffix", F.right("word", F.col("k"))).join(suffix_rules(table, longest), "suffix")
    made = F.concat(F.substr("word", F.lit(1), F.length("word") - F.length("cut")), "add")
    ruled = ends.groupBy("word").agg(F.max_by(made, "k").alias("_ruled"))
    return known.join(ruled, "word", "left").select("word", F.coalesce("lemma", "_ruled", "word").alias("lemma"))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """A table that a plan reads several times, written to the shared folder by a job."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lemma_counts(counts: DataFrame, table: DataFrame) -> DataFrame:
    """(lemma, count, forms): word counts (word, count) by lemma.

    Both are read several times, so each is made once, by a job, and goes to the
    shared folder: a row a distinct word or form.
    """
    counts, table = stored(counts, "counts"), stored(table, "forms")
    return counts.join(lemmas(counts, table), "word").groupBy("lemma").agg(F.sum("count").alias("count"), F.count("*").alias("forms"))


def term_frequency(df: DataFrame, tokens: str, min_docs: int = 2, keep=None) -> DataFrame:
    """(word, count, docs) of words in at least ``min_docs`` documents."""
    return word_counts(df, tokens, keep=keep).filter(F.col("docs") >= min_docs)


def corpus_words(df: DataFrame, tokens: str, keep=None) -> DataFrame:
    rows = df.select(F.explode(tokens).alias("word"))
    return (rows.filter(keep(F.col("word"))) if keep else rows).agg(F.count("*").alias("words"))


def npmi(df: DataFrame, tokens: str, cls: str, min_count: int = 2, keep=None) -> DataFrame:
    """(cls, word, n_xy, npmi) for words in at least ``min_count`` documents of the class.

    p(class) is the class's documents, p(word) the word's occurrences and
    p(class, word) its occurrences in the class, each over the corpus's words;
    -inf where a word occurs fewer than ``min_count`` times there. The documents
    are read once, by a job: the counts by class and word, a row a class and word,
    go to the shared folder, and the rest follows from them.
    """
    path = scratch_path(df.sparkSession, "words")
    word_counts(df, tokens, [cls], keep, rows=True).write.parquet(path)
    seen = df.sparkSession.read.parquet(path)
    xy = seen.filter("word IS NOT NULL").withColumnRenamed("count", "n_xy")
    total = F.broadcast(xy.agg(F.sum("n_xy").alias("words")))  # one row
    x = F.broadcast(seen.filter("word IS NULL").select(cls, F.col("count").alias("n_x")))  # a row a class
    with_y = xy.withColumn("n_y", F.sum("n_xy").over(Window.partitionBy("word")))
    joined = with_y.filter(F.col("docs") >= min_count).join(x, cls).crossJoin(total)
    n = F.col("words").cast("double")
    p_xy, p_x, p_y = F.col("n_xy") / n, F.col("n_x") / n, F.col("n_y") / n
    score = F.try_divide(F.ln(p_xy / (p_x * p_y)), -F.ln(p_xy))
    return joined.select(cls, "word", "n_xy", F.when(F.col("n_xy") >= min_count, score).otherwise(float("-inf")).alias("npmi"))


def top_words(scores: DataFrame, cls: str, n: int = 20, scale: float = 1.0) -> DataFrame:
    """The ``n`` best words of each class; ties by word."""
    w = Window.partitionBy(cls).orderBy(F.desc("npmi"), "word")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("npmi", F.col("npmi") * scale)


def class_of(hs: Column, m_hs: Column) -> Column:
    """Misogynistic, otherwise hateful, neutral; null where the first vote is missing and the second does not decide."""
    return F.when(m_hs == 1, "misogynistic").when((hs == 1) & (m_hs == 0), "hateful").when(hs == 0, "neutral")
