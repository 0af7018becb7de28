"""Many patterns at once, sums over ranges of a hot group, and numbers made of two operands, each against plain Python."""

from __future__ import annotations

import math
import random
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestack.functions import numbers as N
from lodestack.operators import aggregates as A
from lodestack.operators import joins as J
from lodestack.operators import patterns as M
from lodestack.operators import splitters as S
from lodestack.operators import structure as D


def places(pattern, text):
    found, at = [], text.find(pattern)
    while at >= 0:
        found.append(at + 1)
        at = text.find(pattern, at + 1)
    return found


def test_patterns_against_find(spark):
    rng = random.Random(5)
    letters = "ab𝒳é "
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(60)] + [(60, None), (61, ""), (62, "aaaa"), (62, "aaaa")]
    given = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 5)))) for i in range(80)] + [(80, "aa"), (81, "aa"), (82, ""), (83, None)]
    want = sorted((p, t, at[0], len(at)) for p, pattern in given if pattern for t, text in texts if text and (at := places(pattern, text)))
    p, t = spark.createDataFrame(given, "pid int, p string"), spark.createDataFrame(texts, "tid int, t string")
    for part in (M.PART, 300):  # one part, and four
        assert sorted(map(tuple, M.occurrences(p, t, "pid", "p", "tid", "t", part).collect())) == want
    assert M.occurrences(p.where("pid < 0"), t, "pid", "p", "tid", "t").count() == 0
    assert M.occurrences(p, t.where("tid < 0"), "pid", "p", "tid", "t").count() == 0


def test_a_hundred_thousand_patterns_cost_no_more_a_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text <> ''")
    runs = docs.select(F.explode(F.sequence(F.lit(1), F.lit(500))).alias("i"), "doc_id", "text").select(F.concat(F.substr("text", F.col("i"), F.lit(12)), F.col("i").cast("string")).alias("p"))
    many = runs.select(F.xxhash64("p").alias("pid"), "p").distinct().limit(100_000)
    own = docs.select((-F.col("doc_id") - 1).alias("pid"), F.substring("text", 1, 25).alias("p"))
    got = M.occurrences(many.unionByName(own), docs, "pid", "p", "doc_id", "text").where("pid < 0 and first = 1").select("pid", "doc_id").distinct()
    assert {(r.pid, r.doc_id) for r in got.collect()} >= {(-r.doc_id - 1, r.doc_id) for r in docs.collect()}
    words = [f"{i:07d}" for i in range(100_000)]
    few, all_ = M._automaton(words[:100]), M._automaton(words)
    text = "".join(random.Random(1).choice("0123456789 ") for _ in range(400_000))

    def seconds(a):
        begun = time.perf_counter()
        M._hits(text, a)
        return time.perf_counter() - begun

    assert seconds(all_) < 30 * seconds(few) + 0.5  # a thousand times as many patterns


def test_sums_over_ranges_of_one_group(spark):
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.05 else "big" if rng.random() < 0.9 else "small", i, rng.randrange(5)) for i in range(20_000)]
    rows += [("big", None, 3), (None, None, 4), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    sizes = [r["count"] for r in S.ranged(df, ("g",), "v", 16).groupBy("_range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 3 * len(rows) / 16  # though one group holds most rows
    want, groups = {}, defaultdict(list)
    for g, v, n in rows:
        groups[g].append((-1 if v is None else v, v, n or 0))
    for g, members in groups.items():
        total, upto = sum(m[2] for m in members), 0
        for _, v, n in sorted(members, key=lambda m: m[0]):
            want[g, v] = (upto, total)
            upto += n
    got = {(r.g, r.v): (r.n_before, r.n_all) for r in S.prefix_sums(df, ("g",), "v", ("n",), 16).collect()}
    assert got == want
    assert S.prefix_sums(df.where("v < 0"), ("g",), "v", ("n",)).count() == 0


def test_percentiles_and_thresholds_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [("one", float(x), bool(rng.random() < x / 60)) for x in rng.integers(0, 60, 3_000)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    values = sorted(r[1] for r in rows)
    got = {r.percent: r.value for r in A.nearest_rank(df, ("g",), "s", (0, 37, 100)).collect()}
    assert got == {p: values[min(int(p / 100 * len(values)), len(values) - 1)] for p in (0, 37, 100)}
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    won = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert math.isclose(A.auc(df, ("g",), "s", F.col("y")).first().auc, won / len(pos) / len(neg))
    f1 = lambda t: round(2 * sum(p >= t for p in pos) / (sum(r[1] >= t for r in rows) + len(pos)), 6)
    best = max(((f1(t), t) for t in set(values)))
    r = A.best_f1(df, ("g",), "s", F.col("y")).first()
    assert (r.f1, r.threshold) == best


def all_pairs(value, operands):
    near = lambda x: math.isfinite(x) and abs(x - value) <= max(0.05 * max(abs(x), abs(value)), 1e-6)
    for i, a in enumerate(operands):
        for b in operands[i + 1 :]:
            if near(abs(a - b)) or near(a + b) or (b and (near(a * b) or near(a / b))) or (a and near(b / a)):
                return True
    return False


def test_made_of_two_against_all_pairs():
    rng = random.Random(3)
    draw = lambda: rng.choice((0.0, float(rng.randrange(-20, 3_000)), round(rng.lognormvariate(0, 6), 4), -round(rng.lognormvariate(0, 3), 3)))
    yes = 0
    for _ in range(6_000):
        operands = list({draw() for _ in range(rng.randrange(6))})
        value = rng.choice((draw(), 0.0, rng.lognormvariate(3, 5)))
        want = all_pairs(value, operands)
        yes += want
        assert N.made_of_two(value, np.sort(np.asarray(operands))) is want, (value, operands)
    assert 600 < yes < 5_400


def test_ten_thousand_operands_under_a_second(spark):
    operands = np.sort(np.random.default_rng(1).uniform(1e3, 1e6, 10_000))
    begun = time.perf_counter()
    assert N.made_of_two(123_456.0, operands) and not N.made_of_two(1e-9 - 5e5, operands) and not N.made_of_two(1e15, operands)
    assert time.perf_counter() - begun < 1
    df = spark.createDataFrame([([5.0, 900.0, 7.0], [2.0, 3.0]), ([5.0], []), ([5.0], None), (None, [1.0, 2.0]), ([], [1.0, 4.0])], "v array<double>, o array<double>")
    assert [r[0] for r in df.select(N.underivable(F.col("v"), F.col("o"))).collect()] == [[900.0, 7.0], [5.0], [5.0], None, []]


def test_length_batches_against_one_key_at_a_time(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.choice((0, 1, 7, 7, 7, rng.randrange(400), 5_000))) for g in ("big", "small", None) for i in range(400 if g == "big" else 25)] + [("nulls", 1, None), ("nulls", 2, None), ("nulls", 2, None)]
    for most, budget in ((8, 900), (3, 10**9), (1, 1), (1_000, 50)):
        want, groups = [], defaultdict(list)
        for g, k, size in rows:
            groups[g].append((size or 0, k))
        for g, members in groups.items():
            batch, n = 1, 0
            for size, k in sorted(members):
                if n and (n >= most or size * (n + 1) > budget):
                    batch, n = batch + 1, 0
                n += 1
                want.append((g, k, size, batch))
        got = D.length_batches(spark.createDataFrame(rows, "g string, key int, size int"), most, budget, "g").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert D.length_batches(spark.createDataFrame([], "g string, key int, size int"), 8, 9, "g").count() == 0


def test_places_in_groups_with_nulls(spark):
    rows = [(g, i) for g in ("a", None) for i in range(3_000 if g else 50)]
    got = J.numbered(spark.createDataFrame(rows, "g string, i int"), "g", "i").collect()
    assert {(r.g, r.i): r.pos for r in got} == {(g, i): i + 1 for g, i in rows} and len(got) == len(rows)
