"""Exact top-k, the Merkle manifest and spelling variants against brute force and their SQL."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import merkle, queries, spelling, topk

LARGE = 9_007_199_254_740_993


@pytest.mark.parametrize("name", ["op11_topk", "op12_merkle", "op13_spelling"])
def test_whole_tables_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = getattr(queries, name)(spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert plain(got.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


# ---- top-k


def brute_topk(rows, every, k):
    """rows: (id, list of floats or None). Whole numbers, so sums are exact."""
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = Counter(len(v) for _, v in fine)
    common = min(lengths, key=lambda n: (-lengths[n], n)) if lengths else 0
    clip = lambda x: max(min(x, 2**63 - 1), -(2**63))
    whole = [(i, [clip(math.floor(64 * x) if math.isfinite(64 * x) else int(math.copysign(2**63, x))) for x in v]) for i, v in fine if len(v) == common]
    out = {}
    for q in {i for i, _ in whole if i % every == 0}:
        mine = min(v for i, v in whole if i == q)
        scored = sorted((-clip(sum(a * b for a, b in zip(mine, v))), i) for i, v in whole if i != q)
        for rank, (score, i) in enumerate(scored[:k], 1):
            out[q, rank] = (i, -score)
    return out


def topk_of(spark, rows, every=5, k=20, extra=False):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("id", "q", "v", "region", "score", "rank", "query_id", "copies")})
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % every == 0, k).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_topk_of_clusters_ties_and_copies(spark, monkeypatch, seed):
    """Small blocks and regions, so that queries meet many of them; clusters, equal vectors, ties and repeated ids."""
    for name, value in (("BLOCK", 4), ("REGION_BLOCKS", 4), ("PIECE", 3), ("QUERIES", 7), ("DEPTH", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.1).tolist()) for i in range(300)]
    rows += [(1_000 + i, [0.5] * 8) for i in range(60)] + [(2_000 + i, [float(i % 3), *[0.0] * 7]) for i in range(40)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (10, rows[3][1]), (10, rows[3][1]), (LARGE, rows[5][1]), (1_000, [0.5] * 8), (2_005, [-1.0] * 8)]
    assert topk_of(spark, rows, extra=True) == brute_topk(rows, 5, 20)


def test_topk_of_nulls_lengths_and_large_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [0.0, 0.0]), (6, None), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, [None, 1.0]), (None, [9.0, 9.0]), (15, [1.0, 2.0, 3.0]), (16, []), (17, [-0.01, 0.01]), (20, [1e300, -1e300]), (21, [1e18, 3.0]), (22, [-1e18, -1e18])]
    assert topk_of(spark, rows) == brute_topk(rows, 5, 20)
    empty = [(0, []), (5, []), (6, [])]
    assert topk_of(spark, empty) == {(0, 1): (5, 0), (0, 2): (6, 0), (5, 1): (0, 0), (5, 2): (6, 0)}
    assert topk_of(spark, []) == {} and topk_of(spark, [(0, [1.0])]) == {} and topk_of(spark, [(1, [1.0]), (2, [1.0])]) == {}


def test_blocks_are_left_out_where_bounds_are_low():
    rng = np.random.default_rng(2)
    blocks = [(np.arange(64) + 64 * b, rng.integers(0, 4, (64, 8)).astype(float) + (40 if b == 9 else 0)) for b in range(20)]
    q = np.ones(8)
    of = topk.bounds(q[None], np.stack([w.max(axis=0) for _, w in blocks]), np.stack([w.min(axis=0) for _, w in blocks]))[0]
    best, seen = topk.search_region(blocks, 3, q, of, -np.inf, 20)
    assert seen == 1 and set(best.ids // 64) == {9}


# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """All levels, and for each leaf its siblings with the side they stand on."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, at):
    out = []
    for level in levels[:-1]:
        beside = at ^ 1
        out.append((level[beside] if beside < len(level) else None, beside < at))
        at //= 2
    return out


def folded(x, path):
    for sibling, left in path:
        x = sha(x if sibling is None else sibling + x if left else x + sibling)
    return x


def brute_audit(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, (r[0], r[3], r[2], r[4], r[1]))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    upper = tree([trees[g][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = steps(trees[g], i) + steps(upper, j)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            start = leaf((*r[:4], r[4] + 1)) if tampered else leaf(r)
            end = folded(start, path)
            out.append((r[0], leaf(r), trees[g][-1][0], upper[-1][0], sha("".join(s or "" for s, _ in path)), end, end == upper[-1][0]))
    return sorted(out, key=repr)


def audited(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit("x") for c in extra.get("clash", ())})
    return sorted((tuple(r) for r in merkle.audit(df).drop("siblings").collect()), key=repr)


@pytest.mark.parametrize("step", [1, 2, 10])
def test_manifest_against_brute_force(spark, monkeypatch, step):
    """Trees of 0 to 9 and of 70 leaves, several steps high where steps are small; nulls everywhere, repeated rows and ids."""
    monkeypatch.setattr(merkle, "STEP", step)
    rows = [(i, f"text {i} é", f"l{size}", f"s{i % 3}", i) for size in range(1, 10) for i in range(size)]
    rows += [(100 + i, None if i % 9 == 0 else "x" * i, "en", None if i % 4 == 0 else "web", None if i % 5 == 0 else i) for i in range(70)]
    rows += [(None, "no id", "en", "s", 3), (None, None, None, None, None), (5, "", None, "s", 2**63 - 1), (101, "again", "en", "s", 0), (100, None, "en", None, None), (LARGE, "large", "é", "s", 1), (LARGE, "large", "", "s", 1)]
    assert audited(spark, rows, clash=("grp", "pos", "n", "level", "digest", "id", "run", "siblings", "leaf", "root")) == brute_audit(rows)


def test_manifest_of_little_and_nothing(spark):
    assert audited(spark, []) == []
    one = audited(spark, [(1, "a", "en", "s", 1)])
    assert one == brute_audit([(1, "a", "en", "s", 1)]) and one[0][1] == one[0][3] and one[0][4] == sha("")
    same = [(3, "a", "en", "s", 1)] * 20
    assert audited(spark, same) == brute_audit(same)


def test_proofs_are_the_siblings(spark):
    rows = [(i, str(i), "en", "s", i) for i in range(13)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in merkle.audit(df).collect()}
    levels = tree([got[i].leaf for i in range(13)])
    for i in range(13):
        assert got[i].siblings == "".join(s or "" for s, _ in steps(levels, i))


# ---- spelling variants


def brute_words(docs, least=3):
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(docs):
    n = brute_words(docs)
    beside = {w: [v for v in n if v != w and near(v, w)] for w in n}
    form = {}
    for w, vs in beside.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(beside[w]), n[form[w]] if form[w] else None) for w in n)


def variants_of(spark, docs, clash=(), **how):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in clash})
    return sorted(tuple(r) for r in spelling.variants(df, **how).collect())


@pytest.mark.parametrize("bits", [27, 18])
def test_variants_against_brute_force(spark, bits):
    """Edits of few stems over a few letters, so that words have many near words and forms of forms; a full bitmap lets everything pass."""
    rng = np.random.default_rng(4)
    letters = "abéÿ×"
    stems = ["abaabé", "ababab", "aaaaaa", "bÿbÿbÿb", "Gemeinde", "ÉCOLES"]
    docs = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = list(stems[int(rng.integers(0, len(stems)))])
            for _ in range(int(rng.integers(0, 3)) * int(rng.integers(0, 2))):
                at, kind, c = int(rng.integers(0, len(w))), int(rng.integers(0, 3)), letters[int(rng.integers(0, len(letters)))]
                w[at : at + 1] = [[], [c], [w[at], c]][kind]
            words.append("".join(w))
        docs.append((i if i % 7 else None, ", ".join(words) + ". a1b2 中文 İstanbul"))
    docs += [(900, None), (901, ""), (902, "12 34"), (903, docs[1][1]), (903, docs[1][1])]
    want = brute_variants(docs)
    assert any(r[2] != r[1] for r in want if r[1]) and len(want) > 100
    assert variants_of(spark, docs, clash=("word", "n", "near", "form", "root", "id"), filter_bits=bits) == want


def test_long_texts_are_cut_between_words():
    text = "Été été, naïve " * 50 + "x" * 300 + " über—all " * 20
    assert spelling._runs(text, 40) == spelling._runs(text)


def test_variants_of_long_words_and_nothing(spark):
    long = "abcdefghij" * 40
    docs = [(i, f"{long} {long[:200]}x{long[200:]} {long[:-1]} short words {'again and ' * 30}") for i in range(6)]
    docs += [(10 + i, long) for i in range(20)]
    assert variants_of(spark, docs) == brute_variants(docs)
    assert variants_of(spark, []) == [] and variants_of(spark, [(1, "one two"), (2, None)]) == []


@pytest.mark.parametrize("at_once", [1, 20, 1 << 19])
def test_every_neighbour_is_made(at_once):
    """All strings at one edit, for every word, when the bitmap lets everything pass."""
    words, alphabet = ["abcab", "aaaaa", "bacca"], "abc"
    made = {}
    for i, s in spelling.neighbours(words, alphabet, np.full(1 << 15, 255, np.uint8), at_once):
        assert s not in made.setdefault(i, set())
        made[i].add(s)
    for i, w in enumerate(words):
        want = {w[:k] + w[k + 1 :] for k in range(5)} | {w[:k] + c + w[k + 1 :] for k in range(5) for c in alphabet} | {w[:k] + c + w[k:] for k in range(6) for c in alphabet}
        assert made[i] == want - {w}
