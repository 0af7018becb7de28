"""Exact top-k inner products by block-at-a-time pruning over document ranges.

Vectors are integer weights, and a component and its sign are a term. Rows are put in an order that keeps alike vectors together
(the leaves of a tree of median splits that is fitted on ``SAMPLE`` vectors; it decides about speed only) and cut into ranges:
blocks of ``BLOCK`` consecutive rows, regions of up to ``REGION_BLOCKS`` consecutive blocks. Of a block is kept the largest weight
of each term and its rows' weights (a block forward index); of a region the largest weight of each term. What a query can score in
a block is at most the sum over its terms of weight times largest weight.

A query goes first to the region with the highest bound, then to every other region whose bound is not below the score of its
k-th best so far. In a region it orders the blocks by their bounds and scores them one after the other, until the bounds are below
that score. Nothing is left out that could be among the k best, so results are exact. Queries are dealt to regions in groups of
``QUERIES`` at most, as many groups as the region is asked for by, and the largest weights of regions travel in pieces of
``PIECE`` regions: no task and no broadcast grows with the table.

Of equal vectors only those of the k + 1 smallest ids, k times each, can be among the k best (ties go to smaller ids), so the
others are left out of the index: a third of all rows being one vector costs nothing.

Results: components are floor(64 * x), those beyond a long are its ends, as are scores. Vectors that are null or hold null or
non-finite components take no part, nor do rows without an id, nor vectors of another length than the most common one (of equally
common lengths the shortest counts). Zero and empty vectors do. A repeated id is one query, with the smallest of its vectors; rows with the
query's id are never its candidates; a candidate row that occurs twice is found twice. Fewer than k candidates are all returned.
An empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 8_192
#: Rows of a block, blocks of a region, regions of a piece, and queries that meet in one group.
BLOCK, REGION_BLOCKS, PIECE, QUERIES = 64, 128, 1_024, 2_048
#: Levels of median splits that order the rows.
DEPTH = 9
_LONG = np.iinfo(np.int64)
_RESULT = "query_id bigint, vec_id bigint, score bigint, place int, scored bigint"


def _exact(peak: int, d: int) -> type:
    """Numbers that hold every inner product and bound: doubles up to 2 ** 53, else Python's own."""
    return np.float64 if peak * peak * max(1, d) < 1 << 53 else object


def _ints(blobs, kind: str, d: int, rows: int | None = None) -> np.ndarray:
    """The vectors of blobs, of one row each unless ``rows`` says how many there are in all."""
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs) if rows is None else rows, d) if d else np.zeros((len(blobs) if rows is None else rows, 0), kind)


def _array(blobs, kind: str, d: int, number: type, rows: int | None = None) -> np.ndarray:
    return _ints(blobs, kind, d, rows).astype(np.int64).astype(number)


def _long(x: np.ndarray) -> np.ndarray:
    """What is beyond a long is its end."""
    return x if x.dtype != object else np.minimum(np.maximum(x, _LONG.min), _LONG.max)


def split_tree(sample: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(directions, thresholds) of a full binary tree, node i above 2i + 1 and 2i + 2: medians along the first principal axis."""
    nodes = (1 << depth) - 1
    axes, at = np.zeros((nodes, sample.shape[1])), np.zeros(nodes)
    where = np.zeros(len(sample), np.int64)
    for node in range(nodes):
        inside = sample[where == node]
        if len(inside) > 1:
            axes[node] = np.linalg.eigh(np.cov(inside.T).reshape(sample.shape[1], -1))[1][:, -1] if sample.shape[1] else 0
            at[node] = np.median(inside @ axes[node])
        mine = np.flatnonzero(where == node)
        where[mine] = 2 * node + 1 + (sample[mine] @ axes[node] > at[node])
    return axes, at


def leaves(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf of each vector, from left to right."""
    axes, at = tree
    node = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(len(at) + 1))):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, axes[node]) > at[node])
    return node - len(at)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """queries x ranges: the sum over terms of the query's weight times the range's largest (``low`` for weights below zero)."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return _long(up @ high.T + down @ low.T)


class Best:
    """The k best (score, id) of one query so far; a score is worth a look while it is not below ``least``."""

    def __init__(self, k: int, least):
        self.k, self.least, self.scores, self.ids = k, least, None, None

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.scores is not None:
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else np.asarray(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k], int)
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(self.least, self.scores[-1])


def search_region(blocks: list[tuple[np.ndarray, np.ndarray]], qid: int, q: np.ndarray, bound: np.ndarray, least, k: int) -> tuple[Best, int]:
    """One query over one region's blocks (ids, weights), by falling bounds until these are below its k-th score; and how many blocks it scored."""
    best, seen = Best(k, least), 0
    for b in np.argsort(-bound, kind="stable"):
        if bound[b] < best.least:
            break
        ids, weights = blocks[b]
        scores, seen = _long(weights @ q), seen + 1
        worth = np.flatnonzero((scores >= best.least) & (ids != qid))
        if worth.size:
            best.take(scores[worth], ids[worth])
    return best, seen


def _usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, n_blocks): the ``k`` best inner products of floor(scale * x) for each row that ``is_query``
    holds for; n_blocks is how many blocks were scored for the query."""
    spark = vectors.sparkSession
    doubles = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & _usable(F.col("x")))
    valid = doubles.select("id", "q", F.transform("x", lambda x: F.floor(F.lit(scale) * x)).alias("v"))
    size = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0)).alias("peak")
    sizes = valid.select(F.size("v").alias("d"), "q", size).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("asked"), F.max("peak").alias("peak")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint, n_blocks bigint")
    d, asked, peak = sizes[0]["d"], sizes[0]["asked"], int(sizes[0]["peak"])
    number, kind = _exact(peak, d), next(f"<i{w}" for w in (2, 4, 8) if w == 8 or peak < 1 << (8 * w - 1))
    valid = valid.where(F.size("v") == d)

    sample = np.asarray(valid.select("v").orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow()["v"].to_pylist(), np.float64)
    tree = spark.sparkContext.broadcast(split_tree(sample.reshape(len(sample), d)))

    # As many of each vector as can be found: k of each of its k + 1 smallest ids. Counted first, then limited in each partition before they move.
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = valid.groupBy("v", "id").agg(F.count(F.lit(1)).alias("copies")).withColumn("_place", least).where(F.col("_place") <= k + 1)
    rows = kept.select("id", "v", F.explode(F.expr(f"sequence(1, least(copies, {k}))")).alias("copy"))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"]).reshape(len(batch), d)
                yield pd.DataFrame({"leaf": leaves(x.astype(np.float64), tree.value).astype(np.int32), "id": batch["id"], "w": [v.tobytes() for v in x.astype(kind)]})

    def block_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Consecutive rows, BLOCK at a time; a region is named by the partition and its place in it."""
        first, made = TaskContext.get().partitionId() << 32, 0

        def blocks(part: pd.DataFrame) -> Iterator[tuple]:
            nonlocal made
            for at in range(0, len(part), BLOCK):
                ids, w = part["id"].to_numpy()[at : at + BLOCK], b"".join(part["w"].iloc[at : at + BLOCK])
                weights = _ints(part["w"].iloc[at : at + BLOCK], kind, d)
                yield first + made // REGION_BLOCKS, made % REGION_BLOCKS, ids.tobytes(), w, weights.max(axis=0).tobytes(), weights.min(axis=0).tobytes()
                made += 1

        held = pd.DataFrame({"id": [], "w": []})
        for batch in batches:
            held = pd.concat([held, batch[["id", "w"]]]) if len(held) else batch[["id", "w"]]
            whole = len(held) - len(held) % BLOCK
            if whole:
                yield pd.DataFrame(list(blocks(held[:whole])), columns=["region", "block", "ids", "w", "high", "low"])
                held = held[whole:]
        if len(held):
            yield pd.DataFrame(list(blocks(held)), columns=["region", "block", "ids", "w", "high", "low"])

    ranged = rows.select("id", "v").mapInPandas(order, "leaf int, id bigint, w binary").repartitionByRange(F.col("leaf"), F.col("id"), F.xxhash64("w")).sortWithinPartitions("leaf", "id")
    index = cut(ranged.mapInPandas(block_up, "region bigint, block int, ids binary, w binary, high binary, low binary"), "blocks")

    def largest(region: pd.DataFrame) -> pd.DataFrame:
        high, low = (_ints(region[c], kind, d) for c in ("high", "low"))
        return pd.DataFrame({"region": region["region"].iloc[:1], "high": [high.max(axis=0).tobytes()], "low": [low.min(axis=0).tobytes()]})

    regions = cut(index.select("region", "high", "low").groupBy("region").applyInPandas(largest, "region bigint, high binary, low binary"), "regions")
    pieces, deals = max(1, -(-regions.count() // PIECE)), max(1, -(-asked // QUERIES))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "q": [np.asarray(v, np.int64).tobytes() for v in batch["v"]]})

    queries = cut(valid.where("q").groupBy("id").agg(F.min("v").alias("v")).mapInPandas(packed, "id bigint, q binary"), "queries").withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(deals)).cast("int"))
    piece = F.pmod(F.xxhash64("region"), F.lit(pieces)).cast("int")
    maxima = regions.withColumn("piece", piece).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def routed(asking: DataFrame, head: bool) -> DataFrame:
        """(region, id, q, least) of queries (id, q, deal, least, seen) and the regions they go to: the one with the highest bound of a piece, or every one not seen whose bound is not below least."""

        def route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                names = left["region"].to_numpy()
                high, low = (_array(left[c], kind, d, number) for c in ("high", "low"))
                for at in range(0, len(right), 256):
                    part = right.iloc[at : at + 256]
                    of = bounds(_array(part["q"], "<i8", d, number), high, low)
                    for i, (qid, q, floor, seen) in enumerate(zip(part["id"], part["q"], part["least"], part["seen"])):
                        go = [int(np.argmax(of[i]))] if head else np.flatnonzero((of[i] >= floor) & (names != seen))
                        out += [(int(names[r]), qid, q, floor, int(of[i, r])) for r in go]
            return pd.DataFrame(out, columns=["region", "id", "q", "least", "bound"]).astype({"region": "int64", "id": "int64", "least": "int64", "bound": "int64"})

        dealt = asking.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        out = maxima.groupBy("piece", "deal").cogroup(dealt.groupBy("piece", "deal")).applyInPandas(route, "region bigint, id bigint, q binary, least bigint, bound bigint")
        # One row a piece is left of each query.
        return out.groupBy("id").agg(F.max_by(F.struct("region", "q", "least"), F.struct("bound", -F.col("region"))).alias("m")).select("id", "m.*") if head else out.drop("bound")

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            blocks = [(np.frombuffer(i, np.int64), _array([w], kind, d, number, len(i) // 8)) for i, w in zip(left["ids"], left["w"])]
            high, low = (_array(left[c], kind, d, number) for c in ("high", "low"))
            for at in range(0, len(right), 256):
                part = right.iloc[at : at + 256]
                q = _array(part["q"], "<i8", d, number)
                of = bounds(q, high, low)
                for i, (qid, floor) in enumerate(zip(part["id"], part["least"])):
                    best, seen = search_region(blocks, qid, q[i], of[i], floor, k)
                    found = zip([], []) if best.scores is None else zip(best.ids.tolist(), map(int, best.scores))
                    out += [(qid, vec, score, place, 0) for place, (vec, score) in enumerate(found, 1)] + [(qid, 0, 0, 0, seen)]  # place 0: how many it scored
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "place", "scored"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "place": "int32", "scored": "int64"})

    def searched(asking: DataFrame, name: str) -> DataFrame:
        """A region's blocks are copied once for each QUERIES of the queries that it is asked by."""
        asking = cut(asking, f"{name}_asked")
        groups = asking.groupBy("region").agg(F.count(F.lit(1)).alias("_n")).select("region", F.ceil(F.col("_n") / QUERIES).cast("int").alias("_groups"))
        left = index.join(groups, "region").withColumn("group", F.explode(F.expr("sequence(0, _groups - 1)"))).drop("_groups")
        right = asking.join(groups, "region").withColumn("group", F.expr("cast(pmod(xxhash64(id), _groups) as int)")).drop("_groups")
        return cut(left.groupBy("region", "group").cogroup(right.groupBy("region", "group")).applyInPandas(look, _RESULT), name)

    lowest = F.lit(_LONG.min).cast("long")
    head_asked = cut(routed(queries.withColumns({"least": lowest, "seen": F.lit(-1).cast("long")}), head=True), "head")
    head = searched(head_asked, "first_region")
    floors = head.where(f"place = {k}").select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    rest = queries.join(head_asked.select("id", F.col("region").alias("seen")), "id").join(floors, "id", "left").withColumn("least", F.coalesce("least", lowest))
    found = head.unionByName(searched(routed(rest, head=False), "other_regions"))
    best = found.where("place > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    scored = found.groupBy("query_id").agg(F.sum("scored").alias("n_blocks"))
    return best.join(scored, "query_id").select("query_id", "rank", "vec_id", "score", "n_blocks")


def oracle_sql(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """The same in DuckDB, by brute force, for unique ids and vectors of one length."""
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS w FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q, v c WHERE q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= {k}"""
