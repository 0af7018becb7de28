"""Language model against plain counts; vector search against brute force."""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import ann, language_model as lm
from lodestack.llm.common import WORD, _ASCII_LOWER
from lodestack.llm.queries import op10_ann, op8_language_model

SCHEMA = "doc_id bigint, text string"
LEARN_DIR = os.environ.get("TEST_LEARN_DIR", "/root/testdata/sf0.1")


@pytest.mark.parametrize("low", [0, 1, 7, 30])
def test_elias_fano_access_decode_and_successor(low):
    rng = np.random.default_rng(low)
    values = np.sort(rng.integers(0, 1 << (low + 12), 5_000).astype(np.uint64)) + np.uint64(17)
    words, (n, bits, n_low, n_high, first) = lm.EliasFano.build(values)
    ef = lm.EliasFano(words, n, bits, n_low, n_high, first)
    at = rng.integers(0, n, 800)
    assert (ef.access(at) == values[at]).all()
    for a, b in ((0, n), (0, 1), (63, 65), (64, 128), (n - 1, n), (100, 4_321)):
        assert (ef.decode(a, b) == values[a:b]).all()
    ef.BLOCK = 256
    asked = rng.integers(0, 1 << (low + 12), 400).astype(np.uint64)
    whole = np.zeros(len(asked), np.int64)
    at, same = ef.successor(whole, whole + n, asked, np.zeros(400, np.uint64))
    assert (at == np.searchsorted(values, asked)).all() and (same == np.isin(asked, values)).all()
    assert (ef.gather(np.arange(n)) == values).all() and (ef.gather(np.asarray([3])) == values[3]).all()
    begin = rng.integers(0, n - 300, 400)
    end = begin + rng.integers(0, 300, 400)
    want = [a + np.searchsorted(values[a:b] - values[0], k) for a, b, k in zip(begin, end, asked)]
    assert (ef.successor(begin, end, asked, np.full(400, values[0]))[0] == want).all()


def test_elias_fano_of_few_values():
    for values in ([], [0], [5, 5, 5], [0, (1 << 63) + 5]):
        values = np.asarray(values, np.uint64)
        words, (n, bits, n_low, n_high, first) = lm.EliasFano.build(values)
        ef = lm.EliasFano(words, n, bits, n_low, n_high, first)
        if n:
            assert (ef.decode(0, n) == values).all() and (ef.access(np.arange(n)) == values).all()


def tokens(text):
    return WORD.findall((text or "").encode().translate(_ASCII_LOWER)) + [None]


def counted(docs, learned):
    """(N, V, counts of words, log10 p(w | u v)) from plain counts."""
    uni, two, three, one_before, two_before = (Counter() for _ in range(5))
    known = lm.WordHash()
    contexts = {w: int(lm.before(np.asarray([h], np.uint64))[0] & lm._CELL) for w, h in [(None, int(lm.END)), ("<s>", int(lm.BEGIN))]}
    for _, text in docs:
        for w in tokens(text)[:-1]:
            contexts[w] = int(lm.before(np.asarray([known[w]], np.uint64))[0] & lm._CELL)
    for i in learned:
        t = tokens(docs[i][1])
        uni.update(t)
        v = ["<s>"] + t[:-1]
        u = ["<s>"] + v[:-1]
        for x in zip(u, v, t):
            three[x] += 1
            two[x[1:]] += 1
            two_before[x[:2]] += 1
            one_before[x[1]] += 1
    n, distinct = sum(uni.values()), len(uni)
    cells = Counter()
    for w, c in [*uni.items(), ("<s>", uni[None])]:
        cells[contexts[w]] = max(cells[contexts[w]], c)
    once, twice = (sum(c == k for c in uni.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    p = lambda w: (uni[w] - discount if uni[w] else discount * distinct) / n

    def log_p(u, v, w):
        k = 2.0 ** round(math.log2(max(1, cells[contexts[v]])))
        a = lm.PRIOR * k**lm.GROWTH
        b, g = 1 / a, (k + a) / (a * lm.PRIOR_3)
        return math.log10((p(w) + b * two[v, w] + g * three[u, v, w]) / (1 + b * one_before[v] + g * two_before[u, v]))

    return n, distinct, uni, log_p


def expected(docs, learned):
    """(n_tokens, n_known, base, score) of each text, and N."""
    n, distinct, uni, log_p = counted(docs, learned)
    out = []
    for _, text in docs:
        t = tokens(text)
        v = ["<s>"] + t[:-1]
        base = sum(math.log10((uni[w] + 1) / (n + distinct + 1)) for w in t)
        out.append((len(t), sum(uni[w] > 0 for w in t), base, sum(map(log_p, ["<s>"] + v[:-1], v, t))))
    return out, n


def test_whole_table_against_plain_counts(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want, n = expected(docs, [k for k, d in enumerate(docs) if not held(d[0])])
    got = op8_language_model(spark, sf).orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for r, (i, _), (n_tokens, n_known, base, score) in zip(got, docs, want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), n_tokens, n_known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) <= 2 * lm.STEP * n_tokens / 2 + 1e-6  # two rounded values for each token
    out = [r for r in got if r.held_out]
    assert sum(r.score > r.base_score for r in out) >= 0.8 * len(out)


def test_held_out_documents_beat_the_base(spark):
    """At sf0.1, where the smallest table has too few documents to say much."""
    got = op8_language_model(spark, LEARN_DIR).where("held_out").select("score", "base_score").collect()
    assert sum(r.score > r.base_score for r in got) >= 0.95 * len(got)


def test_probabilities_add_up_to_one():
    """Over the known words, the end and one unknown word, after any context."""
    docs = [(1, "a b c a b"), (2, "b c a a"), (3, "c"), (4, None), (5, "zz q")]
    _, _, uni, log_p = counted(docs, range(4))
    for u, v in (("<s>", "<s>"), ("<s>", b"a"), (b"a", b"b"), (b"zz", b"a"), (b"a", b"zz"), (b"c", b"a")):
        assert math.isclose(sum(10 ** log_p(u, v, w) for w in [*uni, b"q"]), 1.0, rel_tol=1e-9)


def test_kept_model_scores_alike(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    tries, totals = lm.fit(docs)
    kept = {r.doc_id: r for r in lm.score(docs, tries, totals).collect()}
    at_once, again = lm.score_corpus(docs, F.lit(True))
    assert (totals.tokens, totals.distinct) == (again.tokens, again.distinct)
    for r in at_once.collect():
        assert math.isclose(r.score, kept[r.doc_id].score, abs_tol=1e-9) and r.n_known == r.n_tokens


def test_kept_model_of_shards_that_nothing_is_asked_of(spark, sf):
    tries, totals = lm.fit(spark.read.parquet(f"{sf}/documents.parquet").limit(60))
    got = lm.score(spark.createDataFrame([(7, "xyzzy")], SCHEMA), tries, totals).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known) for r in got] == [(7, 2, 1)]


def test_language_model_edge_cases(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "A b A b"), (3, "a B c"), (4, "new " * 5_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))
    scored, totals = lm.score_corpus(df, F.coalesce(F.col("doc_id"), F.lit(0)) != 4)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in scored.collect())
    assert got == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (2, 5, 5), (3, 3, 3), (4, 5_001, 1)]
    assert totals.tokens == 3 + 5 + 3
    nothing, none = lm.score_corpus(df, F.lit(False))
    assert (none.tokens, none.distinct) == (0, 0) and all(r.n_known == 0 for r in nothing.collect())
    assert lm.score_corpus(df.limit(0), F.lit(True))[0].count() == 0


def brute(vectors, queries, k):
    out = {}
    ids = np.asarray([v[0] for v in vectors])
    x = np.asarray([v[1] for v in vectors], float)
    for q in queries:
        mine = x[ids == q][0]
        d = np.sqrt(((x - mine) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_vector_search_recall_on_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want = brute(vectors, [v for v, _ in vectors if v % 100 == 0], 10)
    got = {}
    for r in op10_ann(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    exact = dict(vectors)
    hits = 0
    for q, found in got.items():
        assert len(found) == 10 and len({v for v, _ in found}) == 10 and [*found] == sorted(found, key=lambda x: (x[1], x[0]))
        for v, score in found:
            assert math.isclose(score, float(np.linalg.norm(np.asarray(exact[v]) - np.asarray(exact[q]))), rel_tol=1e-12)
        hits += len({v for v, _ in found} & {v for v, _ in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_vectors_that_take_no_part_ties_and_repeats(spark):
    same = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, same) for i in range(40)] + [(100, [0.0] * 4), (101, None), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 1.0]), (104, [float("inf"), 0.0, 0.0, 1.0]), (105, [1.0, 2.0]), (None, same), (200, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.search(df, F.col("vec_id") % 100 == 0, k=5).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [1, 2, 3, 4, 5], 200: [0, 1, 2, 3, 4]}
    assert ann.search(df.where("vec_id in (0, 200)"), F.col("vec_id") % 100 == 0).count() == 2
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id = 101"), F.col("vec_id") % 100 == 1).count() == 0


@pytest.mark.parametrize("spread", ["even", "clustered"])
def test_shortlists_where_codes_select(spark, spread):
    """20,000 vectors: recall of 0.9 or more with at most a twentieth of them measured exactly."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = rng.normal(size=(20_000, 32)) if spread == "even" else unit(rng.normal(size=(150, 32)))[rng.integers(0, 150, 20_000)] + 0.08 * rng.normal(size=(20_000, 32))
    x = unit(x).astype(np.float32).astype(float)
    df = spark.createDataFrame([*enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({*np.argsort(d)[:10].tolist()} & {*part["vec_id"]})
    assert hits / (200 * 10) >= 0.9 and got.groupby("query_id").size().eq(10).all()
    assert got["n_measured"].max() <= 0.05 * len(x)


def test_cells_and_queries_dealt_into_blocks_find_the_same(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    find = lambda: {(r.query_id, r.rank, r.vec_id, r.n_measured) for r in ann.search(table, F.col("vec_id") % 20 == 0).collect()}
    want = find()
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "QUERIES", 5)
    assert find() == want


@pytest.mark.parametrize("kind", ["wide", "huge", "queries apart"])
def test_neighbours_are_found_where_codes_tell_little_or_numbers_are_large(spark, kind):
    rng, n = np.random.default_rng(5), 4_000
    clustered = lambda d: rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.2 * rng.normal(size=(n, d))
    if kind == "wide":
        x = rng.normal(size=(n, 256))
    else:
        x = 1e25 * clustered(32) if kind == "huge" else np.where((np.arange(n) % 40 == 0)[:, None], 3 * rng.normal(size=(n, 32)), clustered(32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.search(table, F.col("vec_id") % 40 == 0).toPandas()
    met = 0
    for q in range(0, n, 40):
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        distance[q] = np.inf
        met += len(set(np.argsort(distance, kind="stable")[:10]) & set(got.loc[got["query_id"] == q, "vec_id"]))
    assert met >= 0.9 * 10 * (n // 40)
