"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, html_text, langid, language_model, licences, merkle, sharding, simhash, spelling, topk, toxicity
from .common import crc_fold, table

VOCABULARY = "byte_bpe_50k.json"
#: The chain's categories, as expressions over the table labels: low quality first, then toxic, which sees its probability.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
TOXIC_FROM = 0.5


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their label columns, for the fully labelled ids that have a document, those with the smallest hashes, as many as the classifier uses: few enough to broadcast."""
    categories = labels.select(F.col("doc_id").alias("_labelled"), *(F.expr(e).alias(c) for c, e in CATEGORIES.items())).dropna()
    there = categories.join(docs.select("doc_id"), F.col("_labelled") == F.col("doc_id"), "left_semi")
    used = there.orderBy(F.xxhash64("_labelled"), *CATEGORIES).limit(toxicity.LABELLED_UP_TO)
    return docs.select("doc_id", "text").join(F.broadcast(used), F.col("doc_id") == F.col("_labelled")).drop("_labelled")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(labelled(docs, table(spark, sf_dir, "labels")), tuple(CATEGORIES))
    return toxicity.predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= TOXIC_FROM)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.training_rows(docs)))
    return langid.predict(docs, model).select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_model.held_out(F.col("doc_id"))
    scored, totals = language_model.score_corpus(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("component_root")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).drop("n_blocks")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents")).drop("siblings")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_licences, op2_bpe, op3_decontaminate, op4_sharding, op5_toxicity, op6_html_text, op7_langid, op8_language_model, op9_simhash, op10_ann, op11_topk, op12_merkle, op13_spelling)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": licences.oracle_sql(), "op11_topk": topk.oracle_sql(), "op12_merkle": merkle.oracle_sql(), "op13_spelling": spelling.oracle_sql()}
