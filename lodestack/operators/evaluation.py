"""Retrieval metrics, paired tests and regression gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import folder


def judged(paths: DataFrame, gold: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Ranked rows with ``hit`` (the key is among the query's gold keys)."""
    marks = gold.select(*by, "key").distinct().withColumn("_g", F.lit(True))
    return paths.join(marks, [*by, "key"], "left").withColumn("hit", F.coalesce("_g", F.lit(False))).drop("_g")


def list_metrics(paths: DataFrame, gold: DataFrame, ks: tuple[int, ...], by: tuple[str, ...] = ("qid",), route: str = "route", alpha: float = 0.9) -> DataFrame:
    """Per list and k: recall, reciprocal rank, all-or-k recall, set precision / recall / F1, alpha-nDCG.

    A query without gold has recall 0, but no all-or-k recall (null). The discount of alpha-nDCG is by earlier hits of any
    kind; the ideal list starts with min(k, gold) hits.
    """
    size = gold.select(*by, "key").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_gold"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.col("hit").cast("int")).over(Window.partitionBy(*by, route).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = judged(paths, gold, by).where(F.col("rank") <= max(ks)).withColumn("_b", before).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    gain = F.when(F.col("hit"), F.pow(F.lit(1 - alpha), F.col("_b")) / F.log2(F.col("rank") + 1.0))
    got = rows.groupBy(*by, route, "k").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("shown"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("_dcg")).join(size, list(by), "left")
    n = F.coalesce("n_gold", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.col("k")).cast("int"))), F.lit(0.0), lambda s, i: s + F.pow(F.lit(1 - alpha), i - 1) / F.log2(i + 1.0))
    p, r = F.col("hits") / F.col("shown"), F.when(n > 0, F.col("hits") / n).otherwise(0.0)
    return got.select(
        *by, route, "k", "hits", F.round(r, 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)), 6).alias("rr"),
        F.when(n > 0, F.col("hits") == F.least(n, F.col("k"))).alias("all_or_k"), F.round(p, 6).alias("precision"),
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), F.round(F.when(n > 0, F.col("_dcg") / ideal).otherwise(0.0), 6).alias("alpha_ndcg"),
    )


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts: twice the smaller binomial tail, at most 1."""

    @F.pandas_udf("double")
    def tail(b: pd.Series, c: pd.Series) -> pd.Series:
        def one(x: int, y: int) -> float:
            n, m = x + y, min(x, y)
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(m + 1)]
            return min(1.0, 2.0 * math.fsum(map(math.exp, logs))) if n else 1.0

        return pd.Series([one(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")

    return tail(b, c)


def paired_bootstrap(pairs: DataFrame, difference: Column, by: tuple[str, ...], id_col: str, replicates: int = 1_000, seed: int = 42) -> DataFrame:
    """Mean difference, its 95 % percentile interval and p = 2 min(P(<= 0), P(>= 0)), at most 1, of each group.

    Each row enters each replicate with a Poisson(1) weight drawn from a hash of its id: rows are seen once, tasks keep one
    sum and one weight a replicate and group, and the draw is the same however rows are dealt out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    rows = pairs.select(*by, F.xxhash64(F.lit(seed), id_col).alias("_h"), difference.cast("double").alias("_d")).where("_d is not null")
    steps = np.exp(-1.0) * np.cumsum([1.0 / math.factorial(i) for i in range(12)])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(list(by), sort=False, dropna=False):
                held = sums.setdefault(key, np.zeros((2, replicates)))
                for at in range(0, len(part), 256):
                    h, d = part["_h"].to_numpy()[at : at + 256], part["_d"].to_numpy()[at : at + 256]
                    x = h.view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    w = np.searchsorted(steps, (x ^ (x >> np.uint64(31))) / 2.0**64)
                    held += np.stack([d @ w, w.sum(axis=0)])
        for key, (total, weight) in sums.items():
            yield pd.DataFrame({**dict(zip(by, key)), "r": np.arange(replicates), "total": total, "weight": weight})

    drawn = rows.mapInPandas(draw, ", ".join([*(f"{c} {kinds[c]}" for c in by), "r int", "total double", "weight double"])).groupBy(*by, "r").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("m"))
    spread = drawn.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("int")), F.avg((F.col("m") >= 0).cast("int")))).alias("p"))
    return rows.groupBy(*by).agg(F.avg("_d").alias("mean"), F.count(F.lit(1)).alias("n")).join(spread, list(by))


def discordant_needed(ratio: float, alpha: float = 0.05, up_to: int = 10_000) -> int | None:
    """The fewest discordant pairs, split as ratio to one, whose exact test reaches alpha."""
    for n in range(1, up_to + 1):
        m = n - math.ceil(n * ratio / (1 + ratio))
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(m + 1)]
        if min(1.0, 2 * math.fsum(map(math.exp, logs))) < alpha:
            return n
    return None


def discordant_pairs_needed(ratio: Column, alpha: float = 0.05, up_to: int = 10_000) -> Column:
    """``discordant_needed`` of a column."""

    @F.pandas_udf("long")
    def needed(ratios: pd.Series) -> pd.Series:
        known = {r: discordant_needed(r, alpha, up_to) for r in ratios.dropna().unique()}
        return pd.Series([known.get(r) for r in ratios], dtype="Int64")

    return needed(ratio)


def single_bootstrap(rows: DataFrame, value: Column, id_col: str, by: tuple[str, ...] = (), replicates: int = 1_000, seed: int = 42) -> DataFrame:
    """(by, n, mean, low, high): the percentile interval of a mean, from the same draws as ``paired_bootstrap``."""
    keyed = rows if by else rows.withColumn("_all", F.lit(0))
    return paired_bootstrap(keyed, value, by or ("_all",), id_col, replicates=replicates, seed=seed).select(*by, "n", "mean", "low", "high")


def judgeable(budget: float, cost: float) -> int:
    """How many items a budget judges when two units of cost are spent besides."""
    return max(0, math.floor((budget - 2 * cost) / cost))


def judgeable_items(budget: Column, cost: Column) -> Column:
    """``judgeable`` as an expression."""
    return F.greatest(F.lit(0), F.floor((budget - 2 * cost) / cost)).cast("long")


def subtopic_recall(paths: DataFrame, topics: DataFrame, depths: tuple[int, ...], by: tuple[str, ...] = ("qid",), route: str = "route") -> DataFrame:
    """(by, route, k, n_topics, met, recall): how many of a question's subtopics the gold keys among the first k belong to.

    topics: (by, key, topic) of the gold keys. A key may have several topics; depths without a hit have recall 0.
    """
    n = topics.groupBy(*by).agg(F.countDistinct("topic").alias("n_topics"))
    swept = paths.select(*by, route, "key", "rank").withColumn("k", F.explode(F.array(*map(F.lit, depths))))
    lists = swept.select(*by, route, "k").distinct().join(n, list(by))
    met = swept.where(F.col("rank") <= F.col("k")).join(topics.select(*by, "key", "topic"), [*by, "key"]).groupBy(*by, route, "k").agg(F.countDistinct("topic").alias("met"))
    met_or_none = F.coalesce("met", F.lit(0))
    return lists.join(met, [*by, route, "k"], "left").select(*by, route, "k", "n_topics", met_or_none.alias("met"), F.round(met_or_none / F.col("n_topics"), 6).alias("recall"))


def confusion(rows: DataFrame, truth: Column, said: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, F1 and accuracy of a yes-or-no classification; a figure without a base is null."""
    of = lambda t, s: F.count_if((truth if t else ~truth) & (said if s else ~said))
    c = rows.groupBy(*by).agg(of(True, True).alias("tp"), of(False, True).alias("fp"), of(True, False).alias("fn"), of(False, False).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return c.select(*by, "tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def cross_validated(rows: DataFrame, features: tuple[str, ...], truth: str, id_col: str, folds: int = 5) -> DataFrame:
    """``confusion`` of each fold of a logistic regression that learned from the others; folds by a hash of the id."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    # Features are read twice for each fold, so they are written, not computed from the rows each time.
    path = folder(rows.sparkSession, "folds")
    rows.select(F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int").alias("fold"), *features, F.col(truth).cast("double").alias("_y")).write.parquet(path)
    dealt = VectorAssembler(inputCols=[*features], outputCol="_x").transform(rows.sparkSession.read.parquet(path)).select("fold", "_x", "_y")
    judged = None
    for k in range(folds):
        learn, test = dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k)
        said = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_said", maxIter=25, standardization=True).fit(learn).transform(test).select("fold", (F.col("_y") == 1).alias("truth"), (F.col("_said") == 1).alias("said"))
        judged = said if judged is None else judged.unionByName(said)
    return confusion(judged, F.col("truth"), F.col("said"), ("fold",))


def coverage(rows: DataFrame, anchors: Column, evidence: Column, by: tuple[str, ...]) -> DataFrame:
    """How many anchors of answers (an array each) stand in their evidence."""
    held = F.size(F.filter(anchors, lambda a: evidence.contains(a)))
    c = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("answers"), F.sum(F.size(anchors)).cast("long").alias("n"), F.sum(held).cast("long").alias("held"))
    return c.withColumn("coverage", F.round(F.col("held") / F.nullif(F.col("n"), F.lit(0)), 6))


def reachable(anchors: Column, views: dict[str, Column]) -> dict[str, Column]:
    """For each view of a document how many of the anchors can be met in it."""
    from ..functions.text import anchors_in

    return {name: F.size(anchors_in(anchors, view)) for name, view in views.items()}


def paired_decisions(pairs: DataFrame, by: str, id_col: str) -> DataFrame:
    """A row for each value of ``by`` (a depth): means of two 0/1 outcomes x and y, their difference, questions gained and lost, the exact p of
    that split, and the bootstrap interval of the difference."""
    gained, lost = F.count_if(F.col("y") > F.col("x")), F.count_if(F.col("x") > F.col("y"))
    mean = lambda c: F.round(F.avg(c), 6)
    rows = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), mean("x").alias("mean_x"), mean("y").alias("mean_y"), F.round(F.avg("y") - F.avg("x"), 6).alias("delta"), gained.alias("gained"), lost.alias("lost"))
    interval = paired_bootstrap(pairs, F.col("y") - F.col("x"), (by,), id_col).select(by, "low", "high")
    return rows.withColumn("p_exact", mcnemar_p(F.col("gained"), F.col("lost"))).join(interval, by)


def binomial_room(draws: Column, p: Column, room: Column, ties: Column) -> Column:
    """Of ``ties`` places that follow each other, the share expected to be left: place t counts if at most ``room - t`` of the draws succeed.

    That is the sum over i of P(exactly i of the draws) times min(ties, room - i + 1), up to i = room. Terms are made one from the other
    as logarithms, so neither many draws nor small p underflow; there are at most room + 1 of them.
    """
    last = F.least(room, draws).cast("int")
    first = F.struct((draws * F.log(1 - p)).cast("double").alias("t"), F.lit(0.0).alias("s"))
    odds = F.log(p / (1 - p))
    step = lambda acc, i: F.struct((acc["t"] + F.log((draws - i) / (i + 1.0)) + odds).cast("double").alias("t"), (acc["s"] + F.exp(acc["t"]) * F.least(ties, room - i + 1)).cast("double").alias("s"))
    between = F.aggregate(F.sequence(F.lit(0), last), first, step)["s"]
    every = lambda left: F.greatest(F.lit(0), F.least(ties, left + 1)).cast("double")
    return F.when(room < 0, 0.0).when((p <= 0) | (draws == 0), every(room)).when(p >= 1, every(room - draws)).otherwise(F.least(F.lit(1.0) * ties, between)) / ties


def expected_ceiling(scores: DataFrame, sizes: tuple[int, ...], k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """How much of the gold is expected among the first k if the corpus grew by D documents like the ones at hand.

    scores: (qid, score, gold). A new document stands above a gold row with probability p, the share of others that do (of those of equal
    score, half), so binomially many of D do. The row counts if they, the rows above it and those of equal score that happen to come
    first are fewer than k; each order of equals is as likely. D = 0 is what is measured, gold first among equals.
    """
    from pyspark.sql import Window

    counts = scores.groupBy(*by, "score").agg(F.count_if("gold").alias("_g"), F.count_if(~F.col("gold")).alias("_o"))
    w = Window.partitionBy(*by)
    above = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("_og", F.coalesce(F.sum("_g").over(above), F.lit(0))).withColumn("_oo", F.coalesce(F.sum("_o").over(above), F.lit(0)))
    rows = rows.withColumn("_n", F.sum("_o").over(w)).where("_g > 0").withColumn("added", F.explode(F.array(*map(F.lit, sizes))))
    measured = F.greatest(F.lit(0.0), F.least(F.col("_g").cast("double"), k - F.col("_oo") - F.col("_og").cast("double")))
    p = F.when(F.col("_n") > 0, (F.col("_oo") + F.col("_o") / 2) / F.col("_n")).otherwise(0.0)
    expected = F.col("_g") * binomial_room(F.col("added"), p, (k - 1 - F.col("_oo") - F.col("_og")).cast("int"), F.col("_g") + F.col("_o"))
    room = F.when(F.col("added") == 0, measured).otherwise(expected)
    return rows.groupBy(*by, "added").agg(F.round(F.sum(room) / F.sum("_g"), 6).alias("ceiling"))


def assignment(size: int, gain: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one pairing of rows and columns with the greatest total gain (shortest augmenting paths)."""
    n = size
    cost = -np.asarray(gain, float)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            row = match[j0]
            slack = np.where(used[1:], np.inf, cost[row - 1] - u[row] - v[1:])
            better = slack < least[1:]
            least[1:][better], way[1:][better] = slack[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(np.argmin(free)) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, n + 1)]


def multi_value_match(gold: DataFrame, predicted: DataFrame, by: str) -> DataFrame:
    """Gold and predicted values of a question paired one to one by containment: exact match, recall, precision, F1.

    Both tables: (by, value). A question's values are one group, which is as large as its two lists.
    """
    kind = gold.schema[by].dataType.simpleString()

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        g, p = (side["value"].tolist() if len(side) else [] for side in (left, right))  # a side without rows has no columns
        n = max(len(g), len(p))
        gain = np.zeros((n, n))
        for i, a in enumerate(g):
            for j, b in enumerate(p):
                gain[i, j] = float(a in b or b in a)
        met = int(sum(gain[i, j] for i, j in assignment(n, gain))) if n else 0
        r, q = met / len(g) if g else 0.0, met / len(p) if p else 0.0
        key = (left if len(left) else right)[by].iloc[0]
        return pd.DataFrame({by: [key], "matched": [met], "exact": [met == len(g) and bool(g)], "recall": [r], "precision": [q], "f1": [2 * r * q / (r + q) if r + q else 0.0]})

    said = predicted.select(F.col(by).alias(by), F.col("value").alias("value"))  # columns of its own, where both tables come from one
    return gold.select(by, "value").groupBy(by).cogroup(said.groupBy(by)).applyInPandas(match, f"{by} {kind}, matched int, exact boolean, recall double, precision double, f1 double")


def ratchet(baseline: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("layer", "name", "metric")) -> DataFrame:
    """verdict of each baseline row (value, note, tolerance, relative, direction up or down): missing, worse, noted, better or same.

    Worse is by strictly more than the tolerance (relative: of the baseline's size); a missing value is a notice, not a failure.
    """
    now = current.select(*keys, F.col("value").alias("now"), F.col("note").alias("note_now"))
    gain = F.when(F.col("direction") == "down", F.col("value") - F.col("now")).otherwise(F.col("now") - F.col("value"))
    slack = F.when(F.col("relative"), F.col("tolerance") * F.abs("value")).otherwise(F.col("tolerance"))
    verdict = F.when(F.col("now").isNull(), "missing").when(-gain > slack, "worse").when(~F.col("note").eqNullSafe(F.col("note_now")), "noted").when(gain > slack, "better").otherwise("same")
    return baseline.join(now, list(keys), "left").select(*keys, "value", "now", verdict.alias("verdict"))
