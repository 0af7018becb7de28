"""The followed log, references by path, grown corpora, nested tables and single-sample intervals against brute force."""

from __future__ import annotations

import math
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import tables as H
from lodestack.operators import evaluation as M
from lodestack.operators import reports as B
from lodestack.streaming import logs as L


def test_a_followed_log_writes_each_record_once_a_level(spark, tmp_path):
    """Twelve batches with a restart between each: equal to the latest record of each key, and few bytes a batch."""
    kind, rng, every = "k string, at string, pos bigint, v double", np.random.default_rng(0), []
    read = lambda: spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    rows_written = []
    for n in range(9):
        rows = [(f"k{int(rng.integers(0, 10**6))}" if i else "same", str(n), i, float(n)) for i in range(200)]
        every += rows
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        before = {p for p in Path(f"{tmp_path}/out").rglob("*.parquet")} if n else set()
        L.follow_latest(read(), ("k",), "at", "pos", f"{tmp_path}/out", f"{tmp_path}/cp", fan=2).awaitTermination(120)
        fresh = [str(p) for p in Path(f"{tmp_path}/out/runs").rglob("*.parquet") if p not in before]
        rows_written.append(spark.read.parquet(*fresh).count())
    newest = {}
    for k, at, pos, v in every:
        newest[k] = max(newest.get(k, ("", -1, 0.0)), (at, pos, v))
    got = {r.k: (r["at"], r.pos, r.v) for r in L.read_latest(spark, f"{tmp_path}/out").collect()}
    assert got == newest
    assert [r[0] for r in sorted(L.runs(spark, f"{tmp_path}/out"), reverse=True)] == [3, 0]
    assert rows_written[8] <= 200 and rows_written[6] <= 200  # no rewriting of all that is there


def test_references_by_path(spark):
    valid = ["a/b/one.pdf", "c/one.pdf", "two.pdf", "x/y/z.pdf", "y/z.pdf"]
    asked = {1: ["a/b/one.pdf", "one", "two", None, "nothing"], 2: ["q/two.PDF", "b\\one", "y/z.pdf", "w/x/y/z"], 3: [], 4: ["", "/", " two.pdf "]}
    df = spark.createDataFrame([(k, v) for k, v in asked.items()], "id int, refs array<string>")
    got = {r.id: (r.kept, r.dropped) for r in B.tolerant_cleanup(df, "refs", spark.createDataFrame([(v,) for v in valid], "v string"), "id").collect()}
    assert got == {1: (["a/b/one.pdf", "two.pdf"], 1), 2: (["two.pdf", "a/b/one.pdf", "y/z.pdf", "x/y/z.pdf"], 0), 3: ([], 0), 4: (["two.pdf"], 2)}


def test_grown_corpora_by_binomial_terms(spark):
    rng = np.random.default_rng(3)
    rows = [("q", float(rng.integers(0, 40)), bool(rng.random() < 0.2)) for _ in range(120)]
    k, sizes = 15, (0, 7, 60, 2_000)
    got = {r.added: r.ceiling for r in M.expected_ceiling(spark.createDataFrame(rows, "qid string, score double, gold boolean"), sizes, k).collect()}
    scores, gold = np.asarray([r[1] for r in rows]), np.asarray([r[2] for r in rows])
    others = scores[~gold]
    for added in sizes[1:]:
        total = 0.0
        for v in scores[gold]:
            above, ties = int((scores > v).sum()), int((scores == v).sum())
            p = ((others > v).sum() + 0.5 * (others == v).sum()) / len(others)
            for t in range(ties):
                total += sum(math.comb(added, i) * p**i * (1 - p) ** (added - i) for i in range(max(0, min(added, k - 1 - above - t) + 1))) / ties
        assert got[added] == pytest.approx(total / gold.sum(), abs=2e-6)
    order = sorted(rows, key=lambda r: (-r[1], not r[2]))
    assert got[0] == pytest.approx(sum(r[2] for r in order[:k]) / gold.sum(), abs=1e-6)


def test_tables_inside_tables_and_missing_ends():
    nested = "<table><tr><td>a<table><tr><td>x</td><td>y</td></tr></table></td><td>b</td></tr></table>"
    assert H.table_grid(nested)[0] == [["a x y", "b"]]
    assert H.table_grid("<table><thead><tr><th>h<th>i<tbody><tr><td>1<td>2<tr><td>3<td>4</table>") == ([["h", "i"], ["1", "2"], ["3", "4"]], 1)
    assert H.table_grid("<table><tr><td colspan=99999999999>a</td></tr></table>")[0] == [["a"] * 1_000]
    assert H.table_grid(None) == ([], 0) and H.table_grid("no table < here") == ([], 0)


@pytest.mark.parametrize("piece", ["<thead ", "<tr ", "<td ", "<table>", "<table><td>", "<"])
def test_tables_are_read_in_one_pass(piece):
    began = time.time()
    H.table_grid(piece * (500_000 // len(piece)))
    assert time.time() - began < 10


def test_single_sample_interval_draws_as_told(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(60)], "id bigint, v double")
    r = M.single_bootstrap(df, F.col("v"), "id", replicates=200).first()
    hashes = np.asarray([x[0] for x in df.select(F.xxhash64(F.lit(42), "id")).collect()], np.int64).view(np.uint64)
    steps = np.exp(-1.0) * np.cumsum([1.0 / math.factorial(i) for i in range(12)])
    x = hashes[:, None] + np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    w = np.searchsorted(steps, (x ^ (x >> np.uint64(31))) / 2.0**64)
    means = np.asarray([float(i % 3) for i in range(60)]) @ w / w.sum(axis=0)
    assert (r.n, r.mean) == (60, 1.0) and (r.low, r.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
