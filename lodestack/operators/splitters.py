"""Sums up to a place in an order, where one group may hold most rows: ranges between splitters, then sums over the ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def ranged(rows: DataFrame, by: tuple[str, ...], order: str, parts: int | None = None) -> DataFrame:
    """The rows with ``_range``, a number that grows with (by, order); splitters come from a sample weighted by the size of partitions.

    A range holds about as many rows as any other, whatever the groups' sizes, while no pair (by, order) repeats often. The rows are
    written, so that a lost executor cannot change the ranges between two reads.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch.folder(spark, "ranges")
    rows.repartitionByRange(n, *by, order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(rows.withColumn("_range", F.lit(0)).schema).parquet(path)


def prefix_sums(rows: DataFrame, by: tuple[str, ...], order: str, sums: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """For each column of ``sums`` its total over the group's rows below this one (``<name>_before``) and over the whole group (``<name>_all``).

    Rows must differ in (by, order). Nulls are a group, and the lowest place, of their own; null addends count as nothing. No task gets
    more than one range, or one row a range of one group: the windows below run inside a range and over the ranges of a group.
    """
    kept = ranged(rows, by, order, parts)
    totals = kept.groupBy(*by, "_range").agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(f"_{s}") for s in sums))
    group, below = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_{s}").over(below), F.lit(0)).alias(f"_{s}_start") for s in sums), *(F.sum(f"_{s}").over(group).alias(f"{s}_all") for s in sums))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.select("*", *(F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_{s}_in") for s in sums))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_range") == F.col("_at"))
    return placed.join(starts, same).select(*rows.columns, *((F.col(f"_{s}_start") + F.col(f"_{s}_in")).alias(f"{s}_before") for s in sums), *(f"{s}_all" for s in sums))
