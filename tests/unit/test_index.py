"""The kept index: coding, and the same ranks as scoring every document."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import index as X
from lodestack.operators import ranking as R
from lodestack.operators import retrieval as S


def test_numbers_of_any_length():
    values = np.asarray([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**28, 2**31])
    coded, sizes = X.varints(values)
    assert X.numbers(coded).tolist() == values.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 4, 5, 5]
    assert len(X.numbers(np.zeros(0, np.uint8))) == 0


def tables(spark, n=900, seed=0):
    rng = np.random.default_rng(seed)
    words = np.asarray([f"w{i}" for i in range(3_000)])
    share = 1 / np.arange(1, 3_001)
    draw = lambda k: " ".join(rng.choice(words, k, p=share / share.sum()))
    docs = [(i, draw(int(rng.integers(1, 120)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "w1 " * 200), (n + 3, "w7 w7 w8"), (n + 4, "w7 w7 w8")]
    asked = [(i, draw(int(rng.integers(1, 12)))) for i in range(40)] + [(90, "nothing known"), (91, None), (92, ""), (93, "w7 w8 w8"), (94, docs[5][1])]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(asked, "item_id bigint, text string")


@pytest.mark.parametrize("model", [S.PLAIN, S.SPARSE, S.DISTINCT], ids=["plain", "sparse", "distinct"])
@pytest.mark.parametrize("k", [1, 10, 2_000])
def test_same_ranks_as_scoring_all(spark, tmp_path, model, k):
    docs, asked = tables(spark)
    X.write(docs.repartition(3, "doc_id"), T.latin_tokens(F.col("text")), "doc_id", f"{tmp_path}/x")
    got = X.search(X.read(spark, f"{tmp_path}/x"), asked, T.latin_tokens, k, model)
    every = S.bm25(docs, asked, T.latin_tokens, model).withColumn("score", F.round("score", 6)).where("score > 0")
    rows = lambda df: sorted((r.qid, r["rank"], r.key, round(r.score, 6)) for r in df.collect())
    assert rows(got) == rows(R.top_k(every, k))


def test_many_segments_and_rounds_of_queries(spark, tmp_path, monkeypatch):
    docs, asked = tables(spark, seed=1)
    every = S.bm25(docs, asked, T.latin_tokens).withColumn("score", F.round("score", 6)).where("score > 0")
    monkeypatch.setattr(X, "SEGMENT", 50)
    monkeypatch.setattr(X, "TOKENS", 900)
    monkeypatch.setattr(X, "PAIRS", 30)
    X.write(docs, T.latin_tokens(F.col("text")), "doc_id", f"{tmp_path}/x")
    index = X.read(spark, f"{tmp_path}/x")
    assert index.rows.select("segment").distinct().count() > 18
    rows = lambda df: sorted((r.qid, r["rank"], r.key) for r in df.collect())
    assert rows(X.search(index, asked, T.latin_tokens, 5)) == rows(R.top_k(every, 5))
    terms = {r.term: (r.df, r.tf) for r in index.terms.collect()}
    assert terms == {r.term: (r.df, r.tf) for r in S.postings(docs, T.latin_tokens(F.col("text")), "doc_id").groupBy("term").agg(F.count("key").alias("df"), F.sum("tf").alias("tf")).collect()}


def test_blocks_are_passed_over(spark, tmp_path):
    """Queries of a rare word that few documents hold often, and common words: most blocks of the common words are never looked at."""
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"c{j}" for j in rng.integers(0, 40, 60)) + (f" rare{i % 50}" * 5 if i < 1_000 else "")) for i in range(4_000)]
    asked = spark.createDataFrame([(q, f"rare{q} c1 c2 c3") for q in range(20)], "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    X.write(df, T.latin_tokens(F.col("text")), "doc_id", f"{tmp_path}/x")
    index = X.read(spark, f"{tmp_path}/x")
    looked, blocks = X.scored(index, asked, T.latin_tokens, 10, bundles=1).where("key is null").agg(F.sum("decoded"), F.sum("blocks")).first()
    assert looked <= blocks / 3
    every = R.top_k(S.bm25(df, asked, T.latin_tokens).withColumn("score", F.round("score", 6)), 10)
    rows = lambda d: sorted((r.qid, r["rank"], r.key) for r in d.collect())
    assert rows(X.search(index, asked, T.latin_tokens, 10)) == rows(every)


def test_an_empty_corpus_and_no_queries(spark, tmp_path):
    docs, asked = tables(spark)
    X.write(docs.limit(0), T.latin_tokens(F.col("text")), "doc_id", f"{tmp_path}/x")
    assert X.search(X.read(spark, f"{tmp_path}/x"), asked, T.latin_tokens, 3).count() == 0
    X.write(docs, T.latin_tokens(F.col("text")), "doc_id", f"{tmp_path}/y")
    assert X.search(X.read(spark, f"{tmp_path}/y"), asked.limit(0), T.latin_tokens, 3).count() == 0


def test_bundles_hold_equally_many_segments(spark, tmp_path, monkeypatch):
    """A task's memory is that of its bundle: by a hash some bundles held far more segments than others."""
    docs = spark.range(0, 960, 1, 6).selectExpr("id as doc_id", "concat('w', id % 7, ' all') as text")
    monkeypatch.setattr(X, "SEGMENT", 10)
    X.write(docs, T.latin_tokens(F.col("text")), "doc_id", f"{tmp_path}/x")
    monkeypatch.setattr(X, "_looker", lambda *_: lambda rows: rows[rows["term"].isna()].head(1).assign(qid=0, key=0, score=0.0, decoded=rows["segment"].nunique(), blocks=0)[["qid", "key", "score", "decoded", "blocks"]])
    asked = spark.createDataFrame([(0, "all")], "item_id bigint, text string")
    held = [r.decoded for r in X.scored(X.read(spark, f"{tmp_path}/x"), asked, T.latin_tokens, 10, bundles=12).collect()]
    assert sum(held) == 96 and len(held) == 12 and max(held) <= 9


def test_postings_take_no_room_before_they_are_asked_for():
    of, tf = X.varints(np.asarray([0, 2, 5])), X.varints(np.asarray([1, 3, 2]))
    skips = np.zeros(1, X._SKIP)
    skips["first"], skips["max_tf"], skips["min_dl"] = 4, 3, 9
    p = X.Postings(3, skips.tobytes(), of[0].tobytes(), tf[0].tobytes(), None, None)
    assert p.ids is None and p.bound == 3.0
    assert p.of(np.asarray([5, 6, 11]))[0].tolist() == [0.0, 3.0, 2.0] and p.whole()[0].tolist() == [4, 6, 11]
    assert p.ids.nbytes + p.impacts.nbytes == 30
