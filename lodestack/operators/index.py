"""A kept inverted index: compressed postings in blocks with score bounds, searched by MaxScore.

Documents are indexed where they are read: a task turns up to ``SEGMENT`` of them (and ``TOKENS`` tokens) into a segment, whose
terms each have one row of postings, so building shuffles nothing. Ids are positions in the segment, stored as gaps; gaps and counts
are numbers of variable length. Every ``BLOCK`` postings are a block with its first id, where it starts, its largest count and its
shortest document, from which a bound of its scores follows for any parameters.

A search takes the terms of a query by falling bounds. While the terms left could still lift a new document among the k best, postings
are read whole; now and then the k best so far are scored in full, which bounds the k-th score from below. Afterwards only those blocks
are looked at that may hold a document still in the running, and the running list shrinks with every term. Nothing is left out that could be
among the k best. Of a segment a block is decoded once, however many queries ask for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import top_k
from .retrieval import PLAIN, Bm25, idf

#: Documents and tokens of a segment, postings of a block, (query, term) pairs that are sent to all segments at a time, segments of a task.
SEGMENT, TOKENS, BLOCK, PAIRS, BUNDLE = 2_048, 1 << 22, 16, 1 << 20, 8
#: Scores are compared as rounded to so many digits; bounds leave room for it.
DIGITS, _ROOM = 6, 2e-6
_SKIP = np.dtype([("first", "<u2"), ("ids", "<u4"), ("tfs", "<u4"), ("max_tf", "<u4"), ("min_dl", "<u4")])


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each): seven bits a byte, lowest first, the last below 128."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >= (1 << bits)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for i in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > i)
        more = (sizes[at] > i + 1).astype(np.uint64) << np.uint64(7)
        out[starts[at] + i] = ((values[at] >> np.uint64(7 * i)) & np.uint64(127) | more).astype(np.uint8)
    return out, sizes


def numbers(coded: np.ndarray) -> np.ndarray:
    """The numbers that ``varints`` coded."""
    if not len(coded):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(coded < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(coded)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((coded & 127).astype(np.int64) << (7 * place), starts)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def segment_rows(number: int, keys: pa.Array, tokens: pa.ListArray, names: list[str]) -> pa.RecordBatch:
    """One row a term, and one without a term for the documents themselves."""
    sizes = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    terms, n = coded.dictionary, max(1, len(sizes))
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    term, doc = pair // n, pair % n
    df = np.bincount(term, minlength=len(terms))
    first = np.cumsum(df) - df  # of each term
    place = np.arange(len(pair)) - np.repeat(first, df)
    head = place % BLOCK == 0
    gaps = np.where(head, 0, np.diff(doc, prepend=0))
    id_bytes, id_sizes = varints(gaps)
    tf_bytes, tf_sizes = varints(tf)
    at = np.flatnonzero(head)
    skips = np.zeros(len(at), _SKIP)
    term_of = term[at]
    for name, size in (("ids", id_sizes), ("tfs", tf_sizes)):
        before = np.cumsum(size) - size
        skips[name] = (before[at] - before[first[term_of]]) if len(at) else 0
    skips["first"] = doc[at]
    if len(at):
        skips["max_tf"], skips["min_dl"] = np.maximum.reduceat(tf, at), np.minimum.reduceat(sizes[doc], at)
    per_term = lambda sizes: np.add.reduceat(sizes, first) if len(first) else np.zeros(0, np.int64)
    ends = lambda sizes: np.cumsum(per_term(sizes))
    blocks = -(-df // BLOCK)
    count = len(terms)
    none = lambda kind, k: pa.nulls(k, kind)
    lengths = varints(sizes)[0].tobytes()
    columns = [
        pa.array(np.full(count + 1, number, np.int64)), pa.concat_arrays([terms.cast(pa.string()), none(pa.string(), 1)]), pa.array(np.append(df, len(sizes) - tokens.null_count).astype(np.int64)), pa.array(np.append(per_term(tf), int(sizes.sum())).astype(np.int64)),
        pa.concat_arrays([_binary(skips.view(np.uint8), np.cumsum(blocks) * _SKIP.itemsize), none(pa.binary(), 1)]), pa.concat_arrays([_binary(id_bytes, ends(id_sizes)), none(pa.binary(), 1)]),
        pa.concat_arrays([_binary(tf_bytes, ends(tf_sizes)), pa.array([lengths], pa.binary())]), pa.concat_arrays([none(pa.list_(keys.type), count), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def write(docs: DataFrame, tokens: Column, id_col: str, path: str) -> None:
    """The index of ``docs`` at a path: (segment, term, df, tf, skips, ids, tfs, keys) rows. Documents are read once; nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("key"), tokens.alias("tokens"))
    schema = f"segment bigint, term string, df bigint, tf bigint, skips binary, ids binary, tfs binary, keys array<{rows.schema['key'].dataType.simpleString()}>"
    names = ["segment", "term", "df", "tf", "skips", "ids", "tfs", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends, at = batch.column(1).offsets.to_numpy().astype(np.int64), 0
            while at < batch.num_rows:
                stop = max(at + 1, min(at + SEGMENT, batch.num_rows, int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1))
                part = batch.slice(at, stop - at)
                made = segment_rows(number, part.column(0), part.column(1), names)
                for first in range(0, made.num_rows, 8_192):
                    yield made.slice(first, 8_192)
                number, at = number + 1, stop

    rows.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Index:
    """A written index."""

    rows: DataFrame

    @property
    def terms(self) -> DataFrame:
        """(term, df, tf) over all documents."""
        return self.rows.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))

    @property
    def documents(self) -> DataFrame:
        """One row: n_docs, avgdl of those with a text (0 for an empty corpus), the number of segments, and of tasks that wrote them."""
        with_text = F.sum("df")
        return self.rows.where("term is null").agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n_docs"), F.when(with_text > 0, F.sum("tf") / with_text).otherwise(0.0).alias("avgdl"), F.count(F.lit(1)).alias("segments"), (F.coalesce(F.max(F.shiftright("segment", 32)), F.lit(0)) + 1).alias("writers"))


def read(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(path))


class Postings:
    """The postings of one term in one segment: blocks are decoded when they are first asked for, and kept for the next query.

    An impact is what a posting gives for a weight of one.
    """

    def __init__(self, df: int, skips: bytes, ids: bytes, tfs: bytes, factor: np.ndarray | None, least_factor: Callable[[np.ndarray], np.ndarray] | None):
        self.skips, self._coded, self._factor = np.frombuffer(skips, _SKIP), {"ids": np.frombuffer(ids, np.uint8), "tfs": np.frombuffer(tfs, np.uint8)}, factor
        most = self.skips["max_tf"].astype(float)
        self.bound = float((most if factor is None else most / (most + least_factor(self.skips["min_dl"]))).max())
        self.df, self.ids, self.impacts, self._ready, self._all = df, None, None, None, False

    def _room(self) -> None:
        """What is decoded takes ten bytes a posting, and none where no query asks."""
        self.ids, self.impacts, self._ready = np.zeros(self.df, _SKIP["first"]), np.zeros(self.df), np.zeros(len(self.skips), bool)

    def _decode(self, low: int, high: int) -> None:
        """Blocks low to high - 1. A block's first gap is 0 and stands for its first id."""
        if self.ids is None:
            self._room()
        gaps, tf = (numbers(data[self.skips[name][low] : self.skips[name][high] if high < len(self.skips) else len(data)]) for name, data in self._coded.items())
        at, run = np.arange(0, len(gaps), BLOCK), np.cumsum(gaps)
        ids = run + np.repeat(self.skips["first"][low:high].astype(np.int64) - run[at], np.diff(np.append(at, len(gaps))))
        place = slice(low * BLOCK, low * BLOCK + len(ids))
        self.ids[place], self.impacts[place] = ids, tf if self._factor is None else tf / (tf + self._factor[ids])
        self._ready[low:high] = True

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._all:
            self._decode(0, len(self.skips))
            self._all = True
        return self.ids, self.impacts

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, int]:
        """The impact on each of the wanted ids (ascending), 0 where there is none, and in how many blocks these were looked for."""
        if self._all or len(self.skips) <= 4 * len(wanted):  # then decoding runs of blocks costs more than decoding all
            self.whole()
            place = np.minimum(np.searchsorted(self.ids, wanted), len(self.ids) - 1)
            return np.where(self.ids[place] == wanted, self.impacts[place], 0.0), min(len(self.skips), len(wanted))
        touched = np.unique(np.maximum(np.searchsorted(self.skips["first"], wanted, "right") - 1, 0))
        if self.ids is None:
            self._room()
        lacking = touched[~self._ready[touched]]
        cuts = np.flatnonzero(np.diff(lacking, prepend=-2) != 1)
        for a, b in zip(cuts, np.append(cuts[1:], len(lacking))):
            self._decode(int(lacking[a]), int(lacking[b - 1]) + 1)
        # Only touched blocks are looked at: their ids, which ascend, with gaps where blocks were left out.
        at = (touched[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        at = at[at < len(self.ids)]
        place = at[np.minimum(np.searchsorted(self.ids[at], wanted), len(at) - 1)]
        return np.where(self.ids[place] == wanted, self.impacts[place], 0.0), len(touched)


def search_segment(postings: list[tuple[Postings, float]], n_docs: int, k: int, least: float = -1.0) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(ids, scores, blocks looked at, least) of the documents that may be among the k best of one query, given its terms' postings and
    weights; ``least`` is what the k-th best is known to reach, before and after."""
    bound = np.asarray([w * p.bound for p, w in postings])
    order = np.argsort(-bound, kind="stable")
    lists, left = [postings[j] for j in order], np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)
    score, looked = np.zeros(n_docs), [0] * len(lists)
    first, read, every, seeded = 0, 0, sum(p.df for p, _ in lists), False
    while first < len(lists) and not left[first] < least - _ROOM:  # a document without a score yet can still get among the best
        p, w = lists[first]
        ids, impacts = p.whole()
        score[ids] += w * impacts
        looked[first] = len(p.skips)
        first, read = first + 1, read + len(ids)
        if not seeded and 16 * read >= every and k <= n_docs:  # the k best so far are scored in full, which bounds the k-th score from below
            seeded = True
            seeds = np.sort(np.argpartition(score, n_docs - k)[n_docs - k :])
            full = score[seeds]
            for j in range(first, len(lists)):
                gain, touched = lists[j][0].of(seeds)
                full, looked[j] = full + lists[j][1] * gain, touched
            least = max(least, float(full.min()))
    running = np.flatnonzero(score > 0)
    for j in range(first, len(lists)):
        running = running[score[running] + left[j] >= least - _ROOM]
        if not len(running):
            break
        gain, touched = lists[j][0].of(running)
        score[running] += lists[j][1] * gain
        looked[j] = max(looked[j], touched)
        if len(running) >= k:
            least = max(least, float(np.partition(score[running], len(running) - k)[len(running) - k]))
    running = running[(score[running] >= least - _ROOM) & (score[running] > 0)]
    return running, score[running], sum(looked), least


class Segment:
    """The documents of a segment and the postings of the terms that are asked for."""

    def __init__(self, rows: pd.DataFrame, average: float, model: Bm25):
        own = rows["term"].isna()
        documents = rows[own].iloc[0]
        self.keys, lengths = documents["keys"], numbers(np.frombuffer(documents["tfs"], np.uint8)).astype(float)
        of_length = (lambda dl: model.k1 * (1 - model.b + model.b * dl / average)) if average > 0 else None
        factor = of_length(lengths) if of_length else None
        self.size = len(lengths)
        self.postings = {r.term: Postings(r.df, r.skips, r.ids, r.tfs, factor, of_length) for r in rows[~own].itertuples(index=False)}

    def lists(self, terms: list[str], weights: list[float]) -> list[tuple[Postings, float]]:
        return [(self.postings[t], w) for t, w in zip(terms, weights) if t in self.postings]


def _looker(shared, average: float, model: Bm25, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Searches a few segments for all queries of ``shared``, a broadcast table (qid, term, w) sorted by query; for each query first
    the segment that promises most, and none that promises less than the k-th best so far."""

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        segments = [Segment(part, average, model) for _, part in rows.groupby("segment")]
        qids, of, weights = shared.value["qid"].to_pylist(), shared.value["term"].to_pylist(), shared.value["w"].to_pylist()
        found, at = [], 0
        while at < len(qids):
            stop = at
            while stop < len(qids) and qids[stop] == qids[at]:
                stop += 1
            asked = [(s, s.lists(of[at:stop], weights[at:stop])) for s in segments]
            promised = [sum(w * p.bound for p, w in lists) for _, lists in asked]
            least, looked = -1.0, 0
            for n in np.argsort([-p for p in promised], kind="stable"):
                segment, lists = asked[n]
                if not lists or promised[n] < least - _ROOM:
                    break
                ids, scores, touched, least = search_segment(lists, segment.size, k, least)
                looked += touched
                rounded = np.round(scores, DIGITS)
                if len(ids) > k:  # with all that tie with the k-th, as keys decide
                    keep = rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k]
                    ids, rounded = ids[keep], rounded[keep]
                found += [(qids[at], segment.keys[i], s, 0, 0) for i, s in zip(ids.tolist(), rounded.tolist()) if s > 0]
            found.append((qids[at], None, 0.0, looked, sum(len(p.skips) for _, lists in asked for p, _ in lists)))
            at = stop
        return pd.DataFrame(found, columns=["qid", "key", "score", "decoded", "blocks"], dtype=object)

    return look


def search(index: Index, queries: DataFrame, tokenise: Callable[[Column], Column], k: int, model: Bm25 = PLAIN, qid_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(qid, key, score, rank): the ``k`` best documents of each query, scores rounded to ``DIGITS``, ties to the smaller key.

    Queries of at most about ``PAIRS`` (query, term) pairs are sent to all segments at a time.
    """
    return top_k(scored(index, queries, tokenise, k, model, qid_col, text_col).where("key is not null").drop("decoded", "blocks"), k)


def scored(index: Index, queries: DataFrame, tokenise: Callable[[Column], Column], k: int, model: Bm25 = PLAIN, qid_col: str = "item_id", text_col: str = "text", bundles: int | None = None) -> DataFrame:
    """(qid, key, score, decoded, blocks) of the best of each bundle of segments; rows without a key say how many blocks were looked at of how many.

    A bundle, of ``BUNDLE`` segments about, is one task's; few segments are dealt over all cores.
    """
    spark = queries.sparkSession
    terms = queries.select(F.col(qid_col).alias("qid"), F.explode(tokenise(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))
    n_docs, average, segments, writers = index.documents.first()
    bundles = bundles or max(-(-segments // BUNDLE), min(segments, spark.sparkContext.defaultParallelism), 1)
    # Segments of one task have consecutive numbers, and so have those of all tasks about: bundles get equally many, where a hash gives some twice the mean.
    number = F.shiftright("segment", 32) * max(1, round(segments / writers)) + F.col("segment").bitwiseAND(F.lit((1 << 32) - 1))
    known = index.rows.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") >= model.min_df)
    weight = idf(F.lit(n_docs), F.col("df")) * F.pow(F.col("qf"), F.lit(model.query_power)) * (model.k1 + 1 if model.numerator else 1.0)
    weighed = terms.join(known, "term").select("qid", "term", weight.alias("w"))
    deals = max(1, -(-terms.count() // PAIRS))
    qid, key = queries.schema[qid_col].dataType.simpleString(), index.rows.schema["keys"].dataType.elementType.simpleString()
    out = None
    for deal in range(deals):
        asked = weighed.where(F.pmod(F.xxhash64("qid"), F.lit(deals)) == deal).toArrow().sort_by([("qid", "ascending"), ("w", "descending"), ("term", "ascending")])
        shared = spark.sparkContext.broadcast(asked)
        wanted = F.broadcast(spark.createDataFrame(pa.table({"term": pa.chunked_array([asked["term"].combine_chunks().unique()], pa.string())})))  # about PAIRS at most

        relevant = index.rows.join(wanted, "term", "left_semi").unionByName(index.rows.where("term is null")).withColumn("bundle", F.pmod(number, F.lit(bundles)).cast("int")).repartition(bundles, "bundle")
        part = relevant.groupBy("bundle").applyInPandas(_looker(shared, average, model, k), f"qid {qid}, key {key}, score double, decoded bigint, blocks bigint")
        out = part if out is None else out.unionByName(part)
    return out
