from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import aggregates as A
from lodestack.operators import evaluation as M
from lodestack.operators import joins as J
from lodestack.operators import ranking as R
from lodestack.operators import reports as B
from lodestack.operators import retrieval as S
from lodestack.operators import structure as D
from lodestack.operators import verification as V
from lodestack.functions import text as T

PATH = "qid string, route string, key bigint, owner string, score double, rank int"


def test_ties_go_to_the_smaller_key(spark):
    d = spark.createDataFrame([("q", 3, 1.0), ("q", 1, 1.0), ("q", 2, 2.0)], "qid string, key bigint, score double")
    assert [r.key for r in R.top_k(d, 2).orderBy("rank").collect()] == [2, 1]


def test_no_signal_has_no_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "delta"), (2, "alpha alpha"), (3, "")], "item_id bigint, text string")
    got = {(r.qid, r.key) for r in S.bm25(docs, asked, T.mixed_tokens).collect()}
    assert got == {(2, 1)}
    assert S.bm25(docs.limit(0), asked, T.mixed_tokens).count() == 0


def test_repeated_query_terms_square_in_the_sparse_variant(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "d e")], "doc_id bigint, text string")
    score = lambda q, m: {r.key: r.score for r in S.bm25(docs, spark.createDataFrame([(1, q)], "item_id bigint, text string"), T.latin_tokens, m).collect()}
    assert score("a a", S.SPARSE)[1] == pytest.approx(4 * score("a", S.SPARSE)[1])
    assert score("a a", S.PLAIN)[1] == pytest.approx(2 * score("a", S.PLAIN)[1])
    assert score("a a", S.DISTINCT)[1] == pytest.approx(score("a", S.DISTINCT)[1])
    assert score("b", S.SPARSE) == {}  # in one document only


def test_cosine_in_blocks_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (16_384, 7):
        got = {}
        for r in S.cosine_topk(v, v.where("vec_id < 20"), 3, rows_at_once=block, queries_at_once=block).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.key)
        s = u[:20] @ u.T
        s[np.arange(20), np.arange(20)] = -9
        assert got == {i: np.argsort(-s[i])[:3].tolist() for i in range(20)}


def test_floor_fill_overwrites_from_the_tail(spark):
    top = spark.createDataFrame([("q", "r", i, "a", 10.0 - i, i + 1) for i in range(4)], PATH)
    own = spark.createDataFrame([("q", "r", 0, "a", 10.0, 1), ("q", "r", 7, "b", 1.0, 1), ("q", "r", 8, "c", 0.5, 1)], PATH)
    got = [r.key for r in R.floor_fill(top, own, 4, 1).orderBy("rank").collect()]
    assert got == [0, 1, 8, 7]


def test_coverage_repair(spark):
    rows = [("q", 1, "a", 5.0, 1), ("q", 2, "a", 4.0, 2), ("q", 3, "b", 3.0, 3), ("q", 4, "c", 2.0, 4), ("q", 5, "d", 1.0, 5)]
    fused = spark.createDataFrame(rows, "qid string, key bigint, owner string, score double, rank int")
    keys = lambda k: [r.key for r in R.coverage_repair(fused, k).orderBy("rank").collect()]
    assert keys(3) == [1, 3, 4]  # c takes a's second place; d finds no owner with two
    assert keys(2) == [1, 3]
    assert keys(9) == [1, 2, 3, 4, 5]


def test_external_quota(spark):
    p = spark.createDataFrame([("q", "r", i, "x" if i in (4, 5) else "t", 9.0 - i, i + 1) for i in range(6)], PATH)
    keys = lambda q: [r.key for r in R.with_external(p, F.col("owner") == "x", 3, q).orderBy("rank").collect()]
    assert keys(2) == [0, 1, 2, 4, 5] and keys(-1) == [0, 1, 4] and keys(-9) == [0, 4, 5] and keys(0) == [0, 1, 2]


def test_greedy_budget_skips_and_goes_on(spark):
    p = spark.createDataFrame([("q", "r", i, "o", 1.0, i + 1) for i in range(4)], PATH).join(spark.createDataFrame([(0, 5), (1, 9), (2, 4), (3, 1)], "key bigint, size bigint"), "key")
    assert sorted(r.key for r in R.greedy_budget(p, "size", 10).collect()) == [0, 2, 3]


def test_unknown_mode_raises(spark):
    with pytest.raises(ValueError):
        R.layered(spark.createDataFrame([], PATH), "sum")
    with pytest.raises(NotImplementedError):
        B.check_levels(("l3", "l1"))


def test_containing_finds_all_lengths(spark):
    texts = spark.createDataFrame([(1, "One two  three four five six seven."), (2, "zone two three"), (3, None), (4, "")], "t bigint, text string")
    quotes = spark.createDataFrame([(1, "two three FOUR five six"), (2, "one two"), (3, "e t"), (4, "wo three four fi"), (5, ""), (6, None), (7, "seven."), (8, "two three")], "q bigint, quote string")
    got = {(r.q, r.t) for r in J.containing(quotes, texts, "q", "quote", "t", "text").collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (7, 1), (8, 1), (8, 2)}


def test_numbered_in_blocks(spark):
    d = spark.createDataFrame([("a", i * 700) for i in range(9)] + [("b", 5)], "g string, o bigint")
    got = sorted((r.g, r.o, r.pos) for r in J.numbered(d, "g", "o").collect())
    assert got == [("a", i * 700, i + 1) for i in range(9)] + [("b", 5, 1)]


def test_latest_and_keep_one(spark):
    d = spark.createDataFrame([("k", "2024-01-02", 1, "x"), ("k", "2024-01-02", 2, "y"), ("k", "2024-01-01", 3, "z")], "k string, at string, pos int, v string")
    assert A.latest(d, ("k",), "at", "pos").first()["v"] == "y"
    assert A.keep_one(d, ("k",), "pos").first()["v"] == "x" and A.keep_one(d, ("k",), "pos", last=True).first()["v"] == "z"


def test_auc_with_ties(spark):
    d = spark.createDataFrame([("g", 1, True), ("g", 1, False), ("g", 2, True), ("g", 0, False), ("h", 1, True)], "g string, s int, y boolean")
    got = {r.g: r.auc for r in A.auc(d, ("g",), "s", F.col("y")).collect()}
    assert got == {"g": 0.875, "h": None}


def test_histogram_closes_the_last_bin(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.5,), (-1.0,)], "x double")
    assert {r.bin: r.n for r in A.histogram(d, (), F.col("x"), [0, 1, 2]).collect()} == {0: 1, 1: 2}


def test_mcnemar_and_power(spark):
    d = spark.createDataFrame([(10, 0), (5, 5), (0, 0), (2000, 1800)], "b int, c int").select(M.mcnemar_p(F.col("b"), F.col("c")).alias("p"))
    p = [r.p for r in d.collect()]
    assert p[0] == pytest.approx(2 / 1024) and p[1] == 1.0 and p[2] == 1.0 and 0 < p[3] < 0.01
    assert M.discordant_needed(1e9) == 6 and M.judgeable(1.0, 0.1) == 8


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    d = spark.createDataFrame([("g", i, float(i % 3 - 0.4)) for i in range(200)], "g string, id bigint, d double")
    a, b = (M.paired_bootstrap(d.repartition(n), F.col("d"), ("g",), "id", 200).first().asDict() for n in (1, 5))
    assert a["n"] == 200 and a["low"] < a["mean"] < a["high"]
    assert all(a[k] == pytest.approx(b[k]) for k in ("mean", "low", "high", "p"))


def test_assignment_beats_every_permutation():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n in range(1, 6):
        g = rng.random((n, n))
        assert sum(g[i, j] for i, j in M.assignment(n, g)) == pytest.approx(max(sum(g[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def test_multi_value_match(spark):
    gold = spark.createDataFrame([(1, "new york"), (1, "paris"), (2, "rome")], "q bigint, value string")
    said = spark.createDataFrame([(1, "york"), (1, "new york city"), (3, "x")], "q bigint, value string")
    got = {r.q: r for r in M.multi_value_match(gold, said, "q").collect()}
    assert (got[1].matched, got[1].exact) == (1, False) and got[2].recall == 0 and got[3].precision == 0


def test_ratchet_is_strict_and_missing_is_a_notice(spark):
    base = spark.createDataFrame([("l", n, "m", 1.0, "", 0.1, False, "up") for n in "abcd"], "layer string, name string, metric string, value double, note string, tolerance double, relative boolean, direction string")
    now = spark.createDataFrame([("l", "a", "m", 0.9, ""), ("l", "b", "m", 0.8, ""), ("l", "c", "m", 1.5, "")], "layer string, name string, metric string, value double, note string")
    assert {r.name: r.verdict for r in M.ratchet(base, now).collect()} == {"a": "same", "b": "worse", "c": "better", "d": "missing"}


def test_packed(spark):
    got = spark.createDataFrame([(["aa", "b" * 9, "c", "d"],), ([],), (None,)], "p array<string>").select(D.packed(F.col("p"), 6).alias("x")).collect()
    assert got[0].x == [["aa"], ["b" * 9], ["c", "d"]] and got[1].x == [] and got[2].x is None


def test_titled_chunks(spark):
    rows = [(1, 0, 0, "preface", False, None), (1, 1, 0, "1 Intro", True, 1.0), (1, 2, 0, "1.1 Why", True, 2.0), (1, 3, 1, "body", False, None), (1, 4, 1, "Abstract", True, None), (1, 5, 2, "more", False, None), (1, 6, 2, "2 End", True, 1.0)]
    d = spark.createDataFrame(rows, "doc_id bigint, pos int, page int, text string, is_heading boolean, level double")
    got = [(r.chunk_id, r.title_path, r.text) for r in D.titled_chunks(d).orderBy("pos").collect()]
    assert got == [("c1", ["(PREAMBLE)"], "preface"), ("c2", ["1 Intro", "1.1 Why"], "1 Intro\n1.1 Why\nbody"), ("c3", ["Abstract"], "Abstract\nmore"), ("c4", ["2 End"], "2 End")]


def test_headings(spark):
    h = [("1", "1 Introduction", 12.5, 0.0, 60.0), ("2", "Body text that goes on and on over the whole width of the page for long.", 10.0, 40.0, 400.0), ("3", "References", 12.5, 80.0, 60.0), ("4", "2 Too Late", 12.5, 120.0, 60.0), ("5", "A Proofs", 12.5, 160.0, 60.0)]
    d = spark.createDataFrame([(1, i, 0, 0.0, y, w, y + s, t) for i, t, s, y, w in h] + [(1, "9", 0, 0.0, 30.0, 400.0, 40.0, "more body text at usual height, long enough to be a line of its own.")], "doc_id bigint, block_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r.block_id: r.is_heading for r in D.scored_blocks(d).collect()}
    assert got["1"] and not got["2"] and got["3"] and not got["4"] and got["5"]


def test_number_support(spark):
    a = spark.createDataFrame([("q", "How many of 500?", "It is 45.5 and 154.5, of 500, not 777 nor 888.", "we saw 200 and 45.5")], "qid string, question string, answer string, evidence string")
    c = spark.createDataFrame([("q", "c1", "there are 777 here"), ("q", "c2", "none")], "qid string, chunk string, text string")
    got = V.number_support(a, c).first()
    assert [(s.value, s.chunks) for s in got.supplements] == [(777.0, ["c1"])]
    assert got.unverified == [154.5, 888.0]  # 200 is not in the answer, so 154.5 is no difference of shared numbers


def test_signed_delta(spark):
    d = spark.createDataFrame([("85.25", "84.5"), ("1,200", "1000"), ("x", "1"), ("3", "3"), ("0.5", "0.51234")], "v string, b string")
    assert [r[0] for r in d.select(V.signed_delta(F.col("v"), F.col("b"))).collect()] == ["+0.75", "+200", None, "+0", "-0.01234"]


def test_strict_verdict(spark):
    d = spark.createDataFrame([(True, "85.2", "80", "we get 85.2", False), (False, "85.2", "80", "row", True), (True, "85.2", "", "no number", True)], "located boolean, v string, b string, q string, t boolean")
    got = d.select(*(c.alias(n) for n, c in V.strict_verdict(F.col("located"), F.col("v"), F.col("b"), F.col("q"), F.col("t")).items())).collect()
    assert [(r.verify, r.baseline) for r in got] == [("exact", ""), ("values", "80"), ("none", "")] and got[1].delta == "+5.2"


def test_substantive(spark):
    d = spark.createDataFrame([("The model improves accuracy by far.",), ("Does it improve the accuracy at all?",), ("The paper does not mention such a thing.",), ("",)], "a string")
    assert [r[0] for r in d.select(V.substantive(F.col("a"))).collect()] == [True, False, False, False]


def test_permuted_rows_give_equal_results(spark, sf):
    from lodestack.plans import ranking as P

    docs = P.scored(spark, sf)
    a = sorted(map(tuple, R.rrf(R.top_k(docs, 50, ("qid", "route"))).select("qid", "key", "rank").collect()))
    b = sorted(map(tuple, R.rrf(R.top_k(docs.repartition(7, "score"), 50, ("qid", "route"))).select("qid", "key", "rank").collect()))
    assert a == b


def test_number_support_looks_at_other_documents_of_the_source(spark, tmp_path):
    from lodestack.plans import catalogue

    rows = [(1, "we found 4321 of them" + " " * 60, "s"), (2, "other text with 4321 in it" + " " * 60, "s"), (3, "alone with 8765 here" + " " * 60, "s"), (4, "elsewhere 8765 again" + " " * 60, "t")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.qid: (r.n_supplements, r.n_unverified) for r in catalogue.QUERIES["number_support"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (0, 1), 4: (0, 1)}


def test_every_figure_of_a_block_is_a_reference(spark, tmp_path):
    from lodestack.plans import catalogue

    text = "words that go on for longer than forty letters, see Figure 2 and Figure 2 and Figure 99999999999999999999"
    rows = [(1, text, "s"), (2, "short one with enough letters", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.num) for r in catalogue.QUERIES["figure_references"](spark, str(tmp_path)).collect())
    assert got == [(1, 1), (1, 2), (2, 2)]
