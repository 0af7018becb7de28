"""A corpus pipeline: language, toxicity, near-duplicates, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; the last returns token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import bpe, decontaminate, langid, simhash, toxicity
from lodestack.llm.common import cut, table
from lodestack.llm.queries import CATEGORIES, TOXIC_FROM, labelled, vocabulary_path

#: Texts whose language is less certain than this are rejected, besides those without a letter.
LEAST_CONFIDENCE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no known language."""
    model = langid.fit(docs.where(langid.training_rows(docs)))
    return langid.confident(docs, model, LEAST_CONFIDENCE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the classifier chain calls toxic."""
    chain = toxicity.fit(labelled(docs, table(spark, sf_dir, "labels")), tuple(CATEGORIES))
    return toxicity.without(docs, chain, "toxic", TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that overlap a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [("language ID", language), ("toxicity", toxic), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", leaks), ("BPE encoding and decoding", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
