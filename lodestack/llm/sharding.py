"""Reproducible shuffle into shards: a keyed Feistel permutation over global row numbers.

Row numbers are positions in the order of md5(doc_id / crc32 / size of the text), then doc_id, crc32 and size, so they do not
depend on files or partitions, and rows of one id fall into different buckets unless their texts are equal too. The permutation sends row number r to p(r); the shard is p(r) mod shards and the slot
p(r) div shards: counts differ by at most one and slots are gapless.

Null ids sort as the empty text; null texts have size 8 and crc 0; rows that agree in id, crc and size are equal for
every output column but the slot, so their order is immaterial. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64

ROUNDS = 6
#: Rows numbered by one window, about; buckets are named by leading hex digits of md5.
BUCKET_ROWS = 100_000


def feistel(rows: np.ndarray, n: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1. Halves are numbers below a and b with a * b >= n; values of n or more walk on along their cycle."""
    x = np.asarray(rows, np.uint64).copy()
    if n <= 1:
        return x.astype(np.int64)
    a = int(np.ceil(np.sqrt(n)))
    while a * a < n:
        a += 1
    a64 = np.uint64(a)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // a64, v % a64
        for key in keys:
            left, right = right, (left + mix64(right ^ key) % a64) % a64
        return left * a64 + right

    x = once(x)
    while (outside := np.flatnonzero(x >= np.uint64(n))).size:
        x[outside] = once(x[outside])
    return x.astype(np.int64)


def bucket_digits(rows: int) -> int:
    """Hex digits that name buckets of about ``BUCKET_ROWS`` rows, 3 to 5 of them: at most 16 ** 5 counts."""
    return min(5, max(3, int(np.ceil(np.log2(max(1, rows / BUCKET_ROWS)) / 4))))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20250101, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard, row_number for every document.

    Two passes: one counts rows per bucket, one numbers rows inside buckets; only ids, sizes and checksums are shuffled,
    never texts.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size, crc = (F.octet_length(text) + 8).cast("long"), F.crc32(text)
    key = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), crc.cast("string"), size.cast("string")).cast("binary"))
    digits = bucket_digits(docs.count())
    slim = docs.select(F.col(id_col).alias("_id"), size.alias("size"), crc.alias("text_crc32"), key.alias("_key")).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = slim.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.orderBy("_bucket")
    offsets = counts.select("_bucket", (F.sum("_n").over(whole) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_bucket").orderBy("_key", F.col("_id").asc_nulls_first(), "text_crc32", "size")
    numbered = slim.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "_bucket")

    @F.pandas_udf("long")
    def permuted(row: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(feistel(row.to_numpy(), int(total.iloc[0]), seed) if len(row) else [], dtype="int64")

    placed = numbered.withColumn("row_number", F.col("_before") + F.col("_in")).withColumn("_p", permuted("row_number", "_total"))
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
