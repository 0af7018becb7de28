"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` vectors, those with the smallest hash of their id); every
vector is indexed. A query looks into its nearest cells, as many as hold the share ``recall`` of the true neighbours, among the sample,
of up to ``TRIED`` queries (queries may lie elsewhere than the rows). Asymmetric distance tables rank the codes of all cells that it
looks into: its shortlist is what lies within one radius of it, the asymmetric distance of so many sample vectors that about ``rerank``
of all vectors are nearer (at least ``2 * (k + 1)`` of the sample, so that k are always found), and of as many more as it takes to hold
all but half of the share that the cells may miss: where codes tell little, as of evenly spread vectors of many dimensions, shortlists are
longer. Only the shortlist is measured, in double precision, on the original vectors.

Of equal vectors only the k + 1 with the smallest ids can ever be among k neighbours (ties go to smaller ids), so the
others need no place in a cell: a third of all rows being one vector costs nothing. Large cells are dealt into blocks, and so
are the queries that meet them, so that a task holds at most ``BLOCK`` vectors and about ``QUERIES`` queries.

Results: vectors that are null, all zero, or hold null or non-finite components take no part; nor do vectors of another
length than the most common one (of equally common lengths the shortest counts). A repeated id is one query, with the
smallest of its vectors; rows with the query's id are never its candidates. Fewer than k candidates are all returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 16_384
#: Rows of a cell that one task compares with its queries, and queries that it compares them with.
BLOCK = 8_192
QUERIES = 16_384
#: Queries that are searched for among the sample, to find how many cells to look into and how long shortlists are.
TRIED = 256
#: Dimensions that one code stands for, at most.
WIDE = 8


@dataclass
class Index:
    centroids: np.ndarray  # cells x d
    books: np.ndarray  # parts x codes x (d / parts)
    parts: int


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        size = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        if (empty := np.flatnonzero(size == 0)).size:
            c[empty] = x[rng.choice(len(x), empty.size)]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((c * c).sum(1) - 2.0 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


def fit(sample: np.ndarray, cells: int, parts: int, codes: int = 256, rounds: int = 10, seed: int = 7) -> Index:
    """Coarse centroids and one codebook for each group of dimensions of the residuals."""
    rng = np.random.default_rng(seed)
    centroids = _kmeans(sample, min(cells, len(sample)), rounds, rng)
    rest = sample - centroids[_nearest(sample, centroids)]
    books = np.stack([_kmeans(p, min(codes, len(sample)), rounds, rng) for p in np.split(rest, parts, axis=1)])
    return Index(centroids, books, parts)


def _codes(x: np.ndarray, cell: np.ndarray, index: Index) -> np.ndarray:
    rest = np.split(x - index.centroids[cell], index.parts, axis=1)
    return np.stack([_nearest(p, b) for p, b in zip(rest, index.books)], axis=1).astype(np.uint8)


def _usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)


def _tables(q: np.ndarray, centroid: np.ndarray, index: Index) -> list[np.ndarray]:
    """For each group of dimensions, squared distances of the queries' residuals to its codes."""
    return [((part[:, None, :] - book[None, :, :]) ** 2).sum(2) for part, book in zip(np.split(q - centroid, index.parts, axis=1), index.books)]


def _asymmetric(q: np.ndarray, codes: np.ndarray, centroid: np.ndarray, index: Index) -> np.ndarray:
    """Squared distances of queries to the vectors that codes of one cell stand for."""
    near = np.zeros((len(q), len(codes)))  # single precision would overflow beyond 1e19
    for m, table in enumerate(_tables(q, centroid, index)):
        near += table[:, codes[:, m]]
    return near


def _holding(places: list[np.ndarray], share: float) -> int:
    """The least place, counted from 0, up to which the share of all places lies; -1 where there are none."""
    ordered = np.sort(np.concatenate([np.zeros(0, int), *places]))
    return int(ordered[min(len(ordered) - 1, int(np.ceil(share * len(ordered))))]) if len(ordered) else -1


def effort(qids: np.ndarray, tried: np.ndarray, radius: Radius, sample: np.ndarray, index: Index, k: int, recall: float) -> tuple[int, int]:
    """(cells, shortlist): how many nearest cells hold the share ``recall`` of the k nearest sample vectors of the queries tried, and how
    many sample vectors of these cells have an asymmetric distance up to theirs, but for half of the share that may be missed."""
    orders, neighbours, places = [], [], []
    for qid, q in zip(qids, tried):
        others = np.flatnonzero(radius.ids != qid)
        distance = ((sample[others] - q) ** 2).sum(1)
        neighbours.append(others[np.argsort(distance, kind="stable")[:k]])
        order = np.argsort(((index.centroids - q) ** 2).sum(1), kind="stable")
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        orders.append(rank)
        places.append(rank[radius.cell[neighbours[-1]]])
    cells = _holding(places, recall) + 1 or len(index.centroids)
    places = []
    for qid, q, rank, nearest in zip(qids, tried, orders, neighbours):
        inside = np.flatnonzero((rank[radius.cell] < cells) & (radius.ids != qid))
        ordered = np.sort(radius.distances(q, inside))
        met = nearest[rank[radius.cell[nearest]] < cells]
        places.append(np.searchsorted(ordered, radius.distances(q, met) * (1 + 1e-9), side="right"))
    return cells, max(0, _holding(places, (1 + recall) / 2))


class Radius:
    """The asymmetric distance of the m-th nearest sample vector in the cells that a query looks into."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, index: Index, m: int):
        self.m, self.ids, self.cell, self.cells = m, ids, _nearest(sample, index.centroids), len(index.centroids)
        codes = _codes(sample, self.cell, index)
        # A code's asymmetric distance is that to the vector it stands for.
        self.decoded = index.centroids[self.cell] + np.concatenate([book[codes[:, k]] for k, book in enumerate(index.books)], axis=1)

    def distances(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared, from differences: products of vectors far from the origin would leave no digits of near ones."""
        return ((self.decoded[rows] - q) ** 2).sum(1)

    def of(self, qid: int, q: np.ndarray, cells: np.ndarray) -> float:
        inside = np.zeros(self.cells, bool)
        inside[cells] = True
        near = self.distances(q, np.flatnonzero(inside[self.cell] & (self.ids != qid)))
        return float(np.partition(near, self.m - 1)[self.m - 1]) * (1 + 1e-6) if len(near) >= self.m else float("inf")


def _search_block(rows: np.ndarray, ids: np.ndarray, codes: np.ndarray, qids: np.ndarray, queries: np.ndarray, radius: np.ndarray, centroid: np.ndarray, index: Index, k: int) -> list[tuple]:
    """(query id, row id, distance, measured) of the k best of one block for each query, of those within its radius; a query's first row says how many were measured."""
    out = []
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        near = _asymmetric(q, codes, centroid, index) <= radius[at : at + 64, None]
        for i in np.flatnonzero(near.any(axis=1)):
            short = np.flatnonzero(near[i] & (ids != qids[at + i]))
            exact = np.sqrt(((rows[short] - q[i]) ** 2).sum(axis=1))
            for place, j in enumerate(np.lexsort((ids[short], exact))[:k]):
                out.append((qids[at + i], ids[short[j]], float(exact[j]), 0 if place else len(short)))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.97, rerank: int = 256, parts: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, n_measured): the ``k`` nearest found for each row that ``is_query`` holds for.

    The number of cells is about the square root of the number of vectors. n_measured is the size of the query's shortlist.
    """
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("q")).where(F.col("id").isNotNull() & _usable(F.col("vec")))
    spark = vectors.sparkSession
    sizes = valid.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("n_queries")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, n_measured bigint")
    d, n, n_queries = sizes[0]
    valid = valid.where(F.size("vec") == d)
    drawn = valid.select("id", "vec", F.xxhash64("id").alias("h")).orderBy("h", "vec").limit(SAMPLE).select("id", "vec").toArrow()
    ids, sample = drawn["id"].to_numpy(), np.stack(drawn["vec"].to_numpy())
    # Of equal vectors as many as the index keeps, so that each sample vector stands for one that can be found.
    copies: Counter[bytes] = Counter()
    kept = np.zeros(len(ids), bool)
    for i, key in enumerate(x.tobytes() for x in sample):
        copies[key] += 1
        kept[i] = copies[key] <= k + 1
    ids, sample = ids[kept], sample[kept]
    wanted = max(parts, -(-d // WIDE))
    parts = next(p for p in range(min(wanted, d), 0, -1) if d % p == 0)
    index = fit(sample, cells=max(1, min(SAMPLE // 16, round(np.sqrt(n)))), parts=parts)
    radius = Radius(ids, sample, index, max(2 * (k + 1), int(np.ceil(rerank * len(sample) / n))))
    asked = valid.where("q").select("id", "vec", F.xxhash64("id").alias("h")).orderBy("h", "vec").limit(TRIED).select("id", "vec").toArrow()
    looked, short = effort(asked["id"].to_numpy(), np.stack(asked["vec"].to_numpy()), radius, sample, index, k, recall) if n_queries else (1, 0)
    radius.m = min(len(sample), max(radius.m, short))
    shared = spark.sparkContext.broadcast((index, radius))

    first = F.row_number().over(Window.partitionBy("h", "vec").orderBy("id"))
    distinct = valid.select("id", "vec", F.xxhash64("vec").alias("h")).withColumn("_copy", first).where(F.col("_copy") <= k + 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vec"])
                cell = _nearest(x, shared.value[0].centroids)
                yield pd.DataFrame({"id": batch["id"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in _codes(x, cell, shared.value[0])], "vec": batch["vec"]})

    indexed = cut(distinct.select("id", "vec").mapInPandas(place, "id bigint, cell int, code binary, vec array<double>"), "ivf")
    # One count for each cell, of which there are at most SAMPLE / 16.
    held = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}
    counts = np.asarray([held.get(c, 0) for c in range(len(index.centroids))])
    blocks = np.maximum(1, -(-counts // BLOCK))
    dealt = max(1, -(-n_queries // QUERIES))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, radius = shared.value[0].centroids, shared.value[1]
        for batch in batches:
            rows = []
            for qid, vec in zip(batch["id"], batch["vec"]):
                order = np.argsort(((c - np.asarray(vec)) ** 2).sum(1), kind="stable")
                enough = int(np.searchsorted(np.cumsum(counts[order]), 8 * (k + 1))) + 1
                cells = order[: max(looked, enough)]
                within = radius.of(qid, np.asarray(vec), cells)
                rows += [(qid, vec, within, int(cell), b, qid % dealt) for cell in cells if counts[cell] for b in range(blocks[cell])]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "vec", "radius", "cell", "block", "deal"]).astype({"cell": "int32", "block": "int32", "deal": "int32"})

    queries = valid.where("q").groupBy("id").agg(F.min("vec").alias("vec")).mapInPandas(route, "id bigint, vec array<double>, radius double, cell int, block int, deal int")
    spread = F.create_map(*[x for c in np.flatnonzero(blocks > 1) for x in (F.lit(int(c)), F.lit(int(blocks[c])))]) if (blocks > 1).any() else None
    block = F.lit(0) if spread is None else F.pmod(F.xxhash64("id"), F.coalesce(spread[F.col("cell")], F.lit(1)).cast("long"))
    rows = indexed.withColumn("block", block.cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
            index = shared.value[0]
            found = _search_block(np.stack(left["vec"]), left["id"].to_numpy(), codes, right["id"].to_numpy(), np.stack(right["vec"]), right["radius"].to_numpy(), index.centroids[int(left["cell"].iloc[0])], index, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "measured"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "measured": "int64"})

    by = ("cell", "block", "deal")
    found = cut(rows.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(look, "query_id bigint, vec_id bigint, score double, measured bigint"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k)
    measured = found.groupBy("query_id").agg(F.sum("measured").alias("n_measured"))
    return best.join(measured, "query_id").select("query_id", "rank", "vec_id", "score", "n_measured")
