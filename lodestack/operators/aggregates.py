"""Grouped summaries: values are counted before they are ordered, and ordered by ranges, so that one group may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splitters import prefix_sums


def latest(rows: DataFrame, keys: tuple[str, ...], at: str, pos: str) -> DataFrame:
    """The row of each key with the greatest ``at`` (as text); of equal ones the later by ``pos``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, pos)).alias("_r")).select(*keys, "_r.*")


def keep_one(rows: DataFrame, keys: tuple[str, ...], pos: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``pos``."""
    rest = [c for c in rows.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), pos)
    return rows.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def nearest_rank(rows: DataFrame, by: tuple[str, ...], value: str, percents: tuple[int, ...]) -> DataFrame:
    """The element at place int(p / 100 * n) (clamped) of each group's ordered values, for each percent: no interpolation."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = prefix_sums(counts, by, value, ("_c",))
    asked = placed.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    place = F.least(F.floor(F.col("percent") * F.col("_c_all") / 100), F.col("_c_all") - 1)
    return asked.where((place >= F.col("_c_before")) & (place < F.col("_c_before") + F.col("_c"))).select(*by, "percent", F.col(value).alias("value"))


def histogram(rows: DataFrame, by: tuple[str, ...], value: Column, edges: list[float]) -> DataFrame:
    """Counts in [edge, next edge), the last bin closed; values outside are not counted."""
    v = value.cast("double")
    bin_of = F.lit(len(edges) - 2)
    for i in range(len(edges) - 3, -1, -1):
        bin_of = F.when(v < edges[i + 1], F.lit(i)).otherwise(bin_of)
    inside = rows.where((v >= edges[0]) & (v <= edges[-1]))
    return inside.groupBy(*by, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def auc(rows: DataFrame, by: tuple[str, ...], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by mid-ranks; null where a group lacks a class. Scores are counted first, so ties cost nothing."""
    counts = rows.groupBy(*by, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_q"))
    won = prefix_sums(counts, by, score, ("_q",)).withColumn("_won", F.col("_p") * (F.col("_q_before") + F.col("_q") / 2.0))
    p, q = F.sum("_p"), F.sum("_q")
    return won.groupBy(*by).agg(p.alias("n_pos"), q.alias("n_neg"), F.when((p > 0) & (q > 0), F.sum("_won") / (p * q)).alias("auc"))


def best_f1(rows: DataFrame, by: tuple[str, ...], score: str, positive: Column) -> DataFrame:
    """The threshold (a score; it and what is above counts as yes) with the best F1 of each group; ties to the higher threshold."""
    counts = rows.groupBy(*by, score).agg(F.count_if(positive).alias("_p"), F.count(F.lit(1)).alias("_c"))
    swept = prefix_sums(counts, by, score, ("_p", "_c"))
    hits, yes = F.col("_p_all") - F.col("_p_before"), F.col("_c_all") - F.col("_c_before")
    f1 = F.when(F.col("_p_all") > 0, 2.0 * hits / (yes + F.col("_p_all"))).otherwise(0.0)
    return swept.withColumn("f1", F.round(f1, 6)).groupBy(*by).agg(F.max_by(F.struct(F.col(score).alias("threshold"), "f1"), F.struct("f1", score)).alias("_r")).select(*by, "_r.*")
