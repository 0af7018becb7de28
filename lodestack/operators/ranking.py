"""Operations on ranked lists.

A path table has one row per query, route and key: (qid, route, key, owner, score, rank), rank from 1. Every function takes
and returns such tables. Ties are broken by the smaller key. Rankings cut at k are planned as group limits, which keep k
rows a group in each task before anything is shuffled, so a query that holds most rows is no bottleneck.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY_SCORE = (F.desc, "score"), (F.asc, "key")


def _order(order) -> list[Column]:
    return list(order) if order else [f(c) for f, c in BY_SCORE]


def ranked(rows: DataFrame, by: tuple[str, ...], order=None, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*_order(order))))


def top_k(rows: DataFrame, k: int, by: tuple[str, ...] = ("qid",), order=None, name: str = "rank") -> DataFrame:
    return ranked(rows, by, order, name).where(F.col(name) <= k)


def position_of(paths: DataFrame, targets: DataFrame, by: tuple[str, ...] = ("qid", "route")) -> DataFrame:
    """The rank of the first target key of each list, 0 if none is in it."""
    found = paths.join(targets.select("key").distinct(), "key", "left_semi").groupBy(*by).agg(F.min("rank").alias("found"))
    return paths.select(*by).distinct().join(found, list(by), "left").select(*by, F.coalesce("found", F.lit(0)).alias("position"))


def competition_and_average_rank(rows: DataFrame, by: tuple[str, ...], score: str = "score") -> DataFrame:
    """rank_min (1 + number of better ones) and rank_avg (mean place of equals)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    low = F.rank().over(w)
    return rows.withColumn("rank_min", low).withColumn("rank_avg", low + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / 2)


def first_seen(rows: DataFrame, by: tuple[str, ...], key: str, order: tuple[str, ...]) -> DataFrame:
    """Each key once, where it stands first, ranked anew in that order."""
    first = rows.groupBy(*by, key).agg(F.min(F.struct(*order)).alias("_at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_at"))).select(*by, key, "rank", *(F.col(f"_at.{c}").alias(f"first_{c}") for c in order))


def capped(paths: DataFrame, group: str, cap: int, k: int | None = None, by: tuple[str, ...] = ("qid", "route")) -> DataFrame:
    """Walk a list and keep at most ``cap`` of each group, until k are kept (cap 0: the first k)."""
    kept = top_k(paths, cap, (*by, group), (F.asc("rank"),), "_in_group").drop("_in_group") if cap > 0 else paths
    out = ranked(kept.withColumnRenamed("rank", "rank_before"), by, (F.asc("rank_before"),))
    return out if k is None else out.where(F.col("rank") <= k)


def best_per_owner(paths: DataFrame, b: int, owners: int | None = None, by: tuple[str, ...] = ("qid", "route")) -> DataFrame:
    """The first b of each owner in the global order; of the ``owners`` whose best score is highest."""
    kept = top_k(paths, b, (*by, "owner"), (F.asc("rank"),), "in_owner")
    if owners is None:
        return kept
    best = top_k(paths.groupBy(*by, "owner").agg(F.max("score").alias("best"), F.min("rank").alias("_first")), owners, by, (F.desc("best"), F.asc("_first")), "owner_rank")
    return kept.join(best.select(*by, "owner", "owner_rank"), [*by, "owner"])


def with_external(paths: DataFrame, is_external: Column, k: int, quota: int, by: tuple[str, ...] = ("qid", "route")) -> DataFrame:
    """External keys have places of their own.

    quota > 0: the first k stay, and those of the first ``quota`` external keys that are not among them follow.
    quota < 0: the first k - m others, then the first m external keys, m = min(-quota, k - 1).
    """
    marked = paths.withColumn("_ext", is_external)
    w = Window.partitionBy(*by, "_ext").orderBy("rank")
    marked = marked.withColumn("_in_kind", F.row_number().over(w))
    if quota >= 0:
        kept = marked.where((F.col("rank") <= k) | (F.col("_ext") & (F.col("_in_kind") <= quota))).withColumn("_late", F.col("rank") > k)
    else:
        m = min(-quota, max(k - 1, 0))
        kept = marked.where((~F.col("_ext") & (F.col("_in_kind") <= k - m)) | (F.col("_ext") & (F.col("_in_kind") <= m))).withColumn("_late", F.col("_ext"))
    return kept.withColumnRenamed("rank", "rank_before").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_late", "rank_before"))).drop("_ext", "_in_kind", "_late")


def floor_fill(paths: DataFrame, owner_paths: DataFrame, k: int, floor: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first k, in which the last places go to owners' own first ``floor`` keys that are missing.

    ``owner_paths`` has each owner's own list (rank within the owner). Missing keys are taken by owner, then by rank, and each
    overwrites one place, from the last backwards; a place may be overwritten though it held its owner's only key.
    """
    top = paths.where(F.col("rank") <= k)
    own = owner_paths.where(F.col("rank") <= floor).select(*by, "owner", "key", F.col("rank").alias("_r"), F.col("score").alias("_s"))
    lacking = own.join(top.select(*by, "key"), [*by, "key"], "left_anti")
    queue = lacking.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("owner", "_r", "key")))
    size = top.groupBy(*by).agg(F.max("rank").alias("_size"))
    placed = queue.join(size, list(by)).withColumn("rank", F.col("_size") - F.col("_n") + 1).where("rank >= 1").select(*by, "rank", F.col("key").alias("_k"), F.col("owner").alias("_o"), "_s")
    got = top.join(placed, [*by, "rank"], "left")
    return got.select(*by, "rank", F.coalesce("_k", "key").alias("key"), F.coalesce("_o", "owner").alias("owner"), F.coalesce("_s", "score").alias("score"), F.col("_k").isNotNull().alias("filled"))


def layered(paths: DataFrame, mode: str, by: tuple[str, ...] = ("qid",), smooth: int = 60) -> DataFrame:
    """Merge owners' own lists: by 1 / (smooth + rank), by z-score within the owner, or by distance from the owner's mean."""
    if mode not in ("rrf", "znorm", "zmean"):
        raise ValueError(f"unknown mode: {mode}")
    w = Window.partitionBy(*by, "owner")
    mean, sd = F.avg("score").over(w), F.stddev_pop("score").over(w)
    fused = {"rrf": 1.0 / (smooth + F.col("rank")), "znorm": F.when(sd > 1e-9, (F.col("score") - mean) / sd).otherwise(0.0), "zmean": F.col("score") - mean}[mode]
    scored = paths.withColumn("fused", F.round(fused, 6)).withColumnRenamed("rank", "rank_in_owner")
    return ranked(scored, by, (F.desc("fused"), F.desc("score"), F.asc("key")))


def standardised(paths: DataFrame, by: tuple[str, ...] = ("qid", "route")) -> DataFrame:
    """z-score (population deviation) and min-max score of each list; constant lists get 0."""
    w = Window.partitionBy(*by)
    low, high, sd = F.min("score").over(w), F.max("score").over(w), F.stddev_pop("score").over(w)
    z = F.when(sd > 1e-9, (F.col("score") - F.avg("score").over(w)) / sd).otherwise(0.0)
    return paths.withColumn("z", F.round(z, 6)).withColumn("minmax", F.round(F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0), 6))


def greedy_budget(paths: DataFrame, size: str, budget: int, by: tuple[str, ...] = ("qid", "route")) -> DataFrame:
    """Walk a list and take what still fits, skipping what does not. Each choice depends on all before it, so a list is folded as an array."""
    items = F.array_sort(F.collect_list(F.struct("rank", "key", F.col(size).cast("long").alias("size"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,key:bigint,size:bigint>>").alias("kept"))

    def step(state: Column, item: Column) -> Column:
        fits = state["used"] + item["size"] <= budget
        return F.struct(F.when(fits, state["used"] + item["size"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(item))).otherwise(state["kept"]).alias("kept"))

    kept = paths.groupBy(*by).agg(items.alias("_items")).select(*by, F.explode(F.aggregate("_items", start, step)["kept"]).alias("i"))
    return kept.select(*by, "i.rank", "i.key", "i.size")


def within_budget(paths: DataFrame, size: str, budget: int, by: tuple[str, ...] = ("qid", "route")) -> DataFrame:
    """The shortest prefix whose sizes reach the budget (the last one may exceed it)."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return paths.withColumn("before", before).where(F.col("before") < budget)


def truncated_window(rows: DataFrame, text: str, room: int, by: tuple[str, ...], order) -> DataFrame:
    """Texts in order up to ``room`` characters, the last one cut."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("place", F.row_number().over(w)).withColumn("_before", before).where(F.col("_before") < room).withColumn(text, F.expr(f"substring({text}, 1, cast({room} - _before as int))")).drop("_before")


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.isNull() | (rank == 0), "none").when(rank == 1, "1").when(rank <= 5, "2-5").when(rank <= 20, "6-20").when(rank <= 100, "21-100").otherwise("none")


def first_nonempty_tier(rows: DataFrame, tier: Column, by: tuple[str, ...]) -> DataFrame:
    """Rows of the lowest tier that has any, for each group; a null tier does not count."""
    marked = rows.withColumn("tier", tier).where("tier is not null")
    return marked.join(marked.groupBy(*by).agg(F.min("tier").alias("tier")), [*by, "tier"])


def rrf(paths: DataFrame, weights: dict[str, float] | None = None, smooth: int = 60, depth: dict[str, int] | int | None = None, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Weighted reciprocal-rank fusion of routes; absent keys add nothing. ``depth`` cuts routes first (0 or less: whole)."""
    if isinstance(depth, int):
        paths = paths.where(F.col("rank") <= depth) if depth > 0 else paths
    elif depth:
        limit = F.coalesce(F.create_map(*[F.lit(x) for kv in depth.items() for x in kv])[F.col("route")], F.lit(0))
        paths = paths.where((limit <= 0) | (F.col("rank") <= limit))
    weight = F.lit(1.0) if weights is None else F.coalesce(F.create_map(*[F.lit(x) for r, w in weights.items() for x in (r, float(w))])[F.col("route")], F.lit(1.0))
    fused = paths.groupBy(*by, "key").agg(F.round(F.sum(weight / (smooth + F.col("rank"))), 9).alias("score"), F.first("owner").alias("owner"), F.count(F.lit(1)).alias("n_routes"))
    return ranked(fused, by)


def quota_union(paths: DataFrame, quotas: dict[str, int], by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first q of each route, route after route in the order of ``quotas``, each key where it stands first."""
    names = list(quotas)
    place = F.create_map(*[F.lit(x) for i, r in enumerate(names) for x in (r, i)])[F.col("route")]
    limit = F.create_map(*[F.lit(x) for r in names for x in (r, max(quotas[r], 0))])[F.col("route")]
    return first_seen(paths.withColumn("place", place).where(F.col("rank") <= limit), by, "key", ("place", "rank"))


def coverage_repair(fused: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first k, repaired so that owners without a key get their best one.

    Owners come by their best score; each takes the place of the last kept key whose owner holds more than one, until none
    is left. Input is a fused list of bounded depth (``rank``); each list is folded in one group.
    """
    columns = [*by, "key", "owner", "score"]
    kinds = {f.name: f.dataType.simpleString() for f in fused.schema.fields}

    def repair(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        kept = list(range(min(k, len(rows))))
        owner = rows["owner"].tolist()
        for i in rows.groupby("owner", sort=False).head(1).sort_values("rank").index:
            held = [owner[j] for j in kept]
            if owner[i] in held:
                continue
            out = next((j for j in reversed(kept) if held.count(owner[j]) > 1), None)
            if out is None:
                break
            kept.remove(out)
            kept.append(i)
        got = rows.loc[sorted(kept, key=lambda j: rows["rank"][j]), columns]
        return got.assign(rank=range(1, len(got) + 1))

    return fused.select(*columns, "rank").groupBy(*by).applyInPandas(repair, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "rank int"]))


def reranked(paths: DataFrame, scores: DataFrame, depth: int, by: tuple[str, ...] = ("qid",), missing: float = -1e9) -> DataFrame:
    """The first ``depth`` in the order of outside scores (absent: ``missing``), the rest behind them as they were."""
    joined = paths.join(scores.select(*by, "key", F.col("score").alias("_outside")), [*by, "key"], "left").withColumnRenamed("rank", "rank_before")
    deep = F.col("rank_before") > depth
    by_outside = F.when(~deep, F.coalesce("_outside", F.lit(missing)))
    return ranked(joined.withColumn("_deep", deep).withColumn("_by", by_outside), by, (F.asc("_deep"), F.desc("_by"), F.asc("rank_before"))).drop("_deep", "_by", "_outside")


def head_replaced(paths: DataFrame, picked: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Picked keys first, in their order; the others follow as they were."""
    joined = paths.join(picked.select(*by, "key", "pick"), [*by, "key"], "left").withColumnRenamed("rank", "rank_before")
    return ranked(joined, by, (F.asc_nulls_last("pick"), F.asc("rank_before")))


def cross_corpus(old: DataFrame, new: DataFrame, mode: str, quota_old: int, quota_new: int, weight: float = 0.5, outside: DataFrame | None = None, by: tuple[str, ...] = ("qid",), missing: float = -1e9) -> DataFrame:
    """Ranked lists of two corpora as one.

    rrf: by weighted ranks of whole lists (the new corpus weighs ``weight``); quota: the first of the old list, then of the new one;
    score: those by their own scores, which must be of one scale; ce: those by outside scores (absent: ``missing``).
    """
    both = old.withColumn("corpus", F.lit(0)).unionByName(new.withColumn("corpus", F.lit(1))).withColumnRenamed("rank", "rank_before")
    if mode == "rrf":
        share = F.when(F.col("corpus") == 0, 1 - weight).otherwise(weight)
        return ranked(both.withColumn("_s", F.round(share / (60 + F.col("rank_before")), 12)), by, (F.desc("_s"), F.asc("key"))).drop("_s")
    pool = both.where(F.col("rank_before") <= F.when(F.col("corpus") == 0, quota_old).otherwise(quota_new))
    if mode == "quota":
        return ranked(pool, by, (F.asc("corpus"), F.asc("rank_before")))
    if mode == "score":
        return ranked(pool, by, (F.desc("score"), F.asc("key")))
    if mode == "ce":
        scored = pool.join(outside.select(*by, "key", F.col("score").alias("_ce")), [*by, "key"], "left").withColumn("_ce", F.coalesce("_ce", F.lit(missing)))
        return ranked(scored, by, (F.desc("_ce"), F.asc("corpus"), F.asc("rank_before"))).drop("_ce")
    raise ValueError(f"unknown mode {mode}")


def z_added(rows: DataFrame, weights: dict[str, float], k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(by, key, fused, rank): weighted sum of the z-scores of columns within each list (0 where a column does not vary), the first k."""
    w = Window.partitionBy(*by)
    z = lambda c: F.when(F.stddev_pop(c).over(w) > 1e-9, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0)
    total = sum((z(c) * x for c, x in weights.items()), F.lit(0.0))
    return top_k(rows.select(*by, "key", F.round(total, 6).alias("fused")), k, by, (F.desc("fused"), F.asc("key")))


def gated(old: DataFrame, new: DataFrame, threshold: float, quota_old: int, quota_new: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Old list's quota; the new corpus' follows for queries where max(old) - max(new) < threshold, or where the old list is empty."""
    best_old = old.groupBy(*by).agg(F.max("score").alias("_old"))
    best_new = new.groupBy(*by).agg(F.max("score").alias("_new"))
    opened = best_new.join(best_old, list(by), "left").where((F.col("_old").isNull()) | (F.col("_old") - F.col("_new") < threshold)).select(*by)
    both = old.where(F.col("rank") <= quota_old).withColumn("corpus", F.lit(0)).unionByName(new.where(F.col("rank") <= quota_new).join(opened, list(by), "left_semi").withColumn("corpus", F.lit(1)))
    return both.withColumnRenamed("rank", "rank_before").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("corpus", "rank_before", "key")))
