"""The queries ``opN_<name>``: each operator on its whole table, with the digest its contract asks for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeum.llm import common as C
from lexeum.llm import decontam, divergence, interaction, langid, mixing, neardup, oracles, pii, quality, secret_scan, sharding, tokens, topk, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read_table(spark, sf_dir, "documents")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = C.read_table(spark, sf_dir, "labels").filter(~C.held_out(F.col("doc_id"), 3, 1))
    found = toxicity.with_toxicity(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return found.select("doc_id", C.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "found.score", (F.col("found.score") >= 0.7).cast("int").alias("predicted"), F.size("found.terms").alias("n_terms"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = pii.with_spans(docs, pii.learn(docs)).select("doc_id", "found", F.arrow_udf(pii.digest, "struct<base_sha256:string,spans:string>")("found").alias("d"))
    count = lambda kind: F.size(F.filter("found.kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii.BASE), "d.base_sha256", "d.spans", *(count(k) for k in pii.KINDS[4:]), F.size("found.kinds").cast("long").alias("n_spans"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", sharding.size_of("text").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "text")
    placed = sharding.sharded(docs, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    counted = tokens.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(C.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(_documents(spark, sf_dir).select("doc_id", "text", "source"), importance=mixing.by_length("text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = C.read_table(spark, sf_dir, "labels").filter(~C.held_out(F.col("doc_id"), 4, 2))
    scored = docs.select("doc_id", quality.score(docs, quality.train(docs, labels)).alias("score"))
    return scored.select("doc_id", C.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.with_language(docs.select("doc_id", "text"), langid.train(docs.filter(~C.held_out(F.col("doc_id"), 3, 1))))
    return found.select("doc_id", C.held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")


def _items_digest(items: pa.Array) -> pa.Array:
    return pa.array([decontam.digest(i or []) for i in items.to_pylist()], pa.string())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = decontam.with_contamination(docs, C.read_table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", "found", F.arrow_udf(_items_digest, "string")("found.items").alias("items_sha256"))
    hit = F.size("found.hits").cast("long")
    return found.select("doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), "items_sha256", (hit > 0).alias("contaminated"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir).select("text", "lang", "source"))


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interaction.audit(_documents(spark, sf_dir), C.read_table(spark, sf_dir, "labels"))
    return found.filter("NOT whole").drop("whole")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = secret_scan.with_secrets(docs, secret_scan.learn(docs))
    count = lambda kind: F.size(F.filter("found", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secret_scan.joined(F.col("found"), tuple(secret_scan.PATTERNS)), 256)
    return found.select("doc_id", *(count(k) for k in secret_scan.PATTERNS), base.alias("base_sha256"), secret_scan.joined(F.col("found")).alias("spans"), count("random"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_sharding, op4_token_counts, op5_minhash_neardup, op6_topk_search, op7_mixing, op8_quality, op9_langid, op10_decontamination, op11_divergence, op12_interaction, op13_secrets)}
ORACLES = {"op5_minhash_neardup": oracles.NEAR_DUPLICATES, "op6_topk_search": oracles.TOP_K, "op10_decontamination": oracles.DECONTAMINATION, "op11_divergence": oracles.DIVERGENCE, "op12_interaction": oracles.INTERACTION, "op13_secrets": oracles.SECRETS}
