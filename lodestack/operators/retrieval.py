"""Lexical and dense retrieval over whole corpora.

Lexical scores join query terms with postings: documents are tokenised once, only tokens of some query survive the join, and
counts are combined before the shuffle. Dense scores compare blocks of queries with blocks of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k


@dataclass(frozen=True)
class Bm25:
    """How a lexical score is put together; the three presets differ in each of these points and must not be mixed."""

    k1: float = 1.5
    b: float = 0.75
    query_power: int = 1  # the exponent of a term's count in the query; 0 ignores it
    numerator: bool = False  # multiply by k1 + 1
    min_df: int = 1


#: Documents of a term that are joined with its queries at one place.
DEALT = 1 << 20

PLAIN = Bm25()
SPARSE = Bm25(query_power=2, numerator=True, min_df=2)
DISTINCT = Bm25(k1=1.2, query_power=0, numerator=True)


def postings(docs: DataFrame, tokens: Column, id_col: str, terms: DataFrame | None = None) -> DataFrame:
    """(key, dl, term, tf), of ``terms`` only if given; dl is the document's whole length."""
    rows = docs.select(F.col(id_col).alias("key"), tokens.alias("_t")).select("key", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("key", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n_docs, avgdl (0 for an empty corpus)."""
    return docs.select(F.size(tokens).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, tokenise, model: Bm25 = PLAIN, id_col: str = "doc_id", qid_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(qid, key, score) of every document that shares a term with a query; queries without any signal have no rows.

    Documents are tokenised once for their postings (whose shuffle serves both the counts of terms and the scores) and once for the
    one row of their number and mean length. Postings meet queries in shares of about ``DEALT`` documents, so that a term that most
    documents hold is not one task's.
    """
    terms = queries.select(F.col(qid_col).alias("qid"), F.explode(tokenise(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))
    found = postings(docs, tokenise(F.col(text_col)), id_col, terms)
    # A sum over tf, not a count, so that this reads the same columns as the scores and shares their shuffle.
    df = found.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df")).where(F.col("df") >= model.min_df)
    stats = F.broadcast(corpus_stats(docs, tokenise(F.col(text_col))))  # one row
    shares = -(-docs.count() // DEALT) or 1
    wanted, by = terms.join(df, "term"), ["term"]
    if shares > 1:
        wanted, by = wanted.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), ["term", "_share"]
        found = found.withColumn("_share", F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int"))
    length = F.when(F.col("avgdl") > 0, 1 - model.b + model.b * F.col("dl") / F.col("avgdl"))
    below = F.when(F.col("avgdl") > 0, F.col("tf") + model.k1 * length).otherwise(F.lit(1.0))
    weight = idf(F.col("n_docs"), F.col("df")) * F.pow(F.col("qf"), F.lit(model.query_power)) * F.col("tf") * (model.k1 + 1 if model.numerator else 1.0) / below
    joined = found.join(wanted, by).join(stats)
    return joined.groupBy("qid", "key").agg(F.sum(weight).alias("score")).where("score > 0")


def _best(rows: np.ndarray, keys: np.ndarray, queries: np.ndarray, qids: np.ndarray, k: int, digits: int, drop_self: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, keys, scores) of each query's k best rows, ties to the smaller key; queries in portions, so that no whole product is held."""
    norm = np.maximum(np.linalg.norm(rows, axis=1), 1e-300)
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        s = np.round((q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)) @ rows.T / norm, digits)
        for qid, own in zip(qids[at : at + 64], s):
            if drop_self:
                own = np.where(keys == qid, -np.inf, own)
            top = np.arange(len(own)) if len(own) <= k else np.flatnonzero(own >= np.partition(own, -k)[-k])
            top = top[np.lexsort((keys[top], -own[top]))][:k]
            top = top[own[top] > -np.inf]
            if len(top):
                yield qid, keys[top], own[top]


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", rows_at_once: int = 32_768, queries_at_once: int = 4_096, digits: int = 6, drop_self: bool = True) -> DataFrame:
    """(qid, key, rank, score): exact cosine in double precision, ties to the smaller key.

    Both sides are dealt into blocks of bounded size by a hash of their ids; each pair of blocks is one task, which keeps its k best
    of each query, and the last merge is a window over those. Only two counts reach the driver.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vec_col).cast("array<double>").alias("vec")).where("qid is not null and vec is not null")
    rows = vectors.select(F.col(id_col).cast("long").alias("key"), F.col(vec_col).cast("array<double>").alias("vec")).where("key is not null and vec is not null")
    n_queries, n_rows = asked.count(), rows.count()
    dealt = max(-(-n_rows // rows_at_once), min(n_rows // 256, spark.sparkContext.defaultParallelism), 1)
    portions = max(1, -(-n_queries // queries_at_once))
    row_blocks = rows.withColumn("rb", F.pmod(F.xxhash64("key"), F.lit(dealt)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
    query_blocks = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(portions)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [*_best(np.stack(left["vec"]), left["key"].to_numpy(), np.stack(right["vec"]), right["qid"].to_numpy(), k, digits, drop_self)] if len(left) and len(right) else []
        sizes = [len(keys) for _, keys, _ in found]
        joined = lambda j, kind: np.concatenate([f[j] for f in found]) if found else np.zeros(0, kind)
        return pd.DataFrame({"qid": np.repeat(np.asarray([q for q, _, _ in found], np.int64), sizes), "key": joined(1, np.int64), "score": joined(2, np.float64)})

    met = row_blocks.groupBy("qb", "rb").cogroup(query_blocks.groupBy("qb", "rb")).applyInPandas(meet, "qid bigint, key bigint, score double")
    return top_k(met, k, by=("qid",))


def hash_embedding(docs: DataFrame, tokens: Column, id_col: str, dim: int = 256) -> DataFrame:
    """(key, bucket, weight): term counts in buckets md5(term) mod ``dim``, scaled to length one; a sparse vector a row a bucket."""
    bucket = (F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")
    tf = docs.select(F.col(id_col).alias("key"), F.explode(tokens).alias("term")).groupBy("key", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("tf"))
    norm = tf.groupBy("key").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return tf.join(norm, "key").select("key", "bucket", (F.col("tf") / F.col("norm")).alias("weight"))


def top_idf_words(docs: DataFrame, tokens: Column, id_col: str, n: int) -> DataFrame:
    """The n rarest words of each document, with their idf."""
    words = docs.select(F.col(id_col).alias("key"), F.explode(F.array_distinct(tokens)).alias("term"))
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n_docs")))  # one row
    scored = words.join(df, "term").join(total).select("key", "term", F.round(idf(F.col("n_docs"), F.col("df")), 6).alias("score"))
    return top_k(scored, n, by=("key",), order=(F.desc("score"), F.asc("term")))
