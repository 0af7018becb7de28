"""Queries without SQL against plain Python over the whole tables."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pytest

from lodestack.functions import numbers as N
from lodestack.plans import catalogue


def run(spark, sf, name):
    return catalogue.QUERIES[name](spark, sf).collect()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return sorted((r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda r: r["doc_id"])


def test_numeric_scan(spark, sf, documents):
    got = {r.doc_id: r for r in run(spark, sf, "numeric_scan")}
    assert got.keys() == {d["doc_id"] for d in documents}
    for d in documents:
        found = N.scan(d["text"])
        r = got[d["doc_id"]]
        assert (r.n_numbers, r.n_percent, r.n_significant) == (len(found), sum(f[4] for f in found), len(N.significant(d["text"])))
        assert math.isclose(r.largest, max([0.0, *(f[3] for f in found)]))
        # Digits are found once each, in order, and none is left out.
        digits = [m.start() for m in re.finditer(r"\d", d["text"].translate(N._RAISE))]
        covered = [i for f in found if f[0][0].isdigit() for i in range(f[1], f[2])]
        assert set(digits) <= set(covered) and len(covered) == len(set(covered))


def test_number_support(spark, sf, documents):
    value_of = {d["doc_id"]: N.significant(d["text"]) for d in documents}
    holders = defaultdict(set)
    for d in documents:
        for v in value_of[d["doc_id"]]:
            holders[d["source"], v].add(d["doc_id"])

    def near(x, v):
        return abs(x - v) <= max(0.05 * max(abs(x), abs(v)), 1e-6)

    def derived(v, operands):
        for i, a in enumerate(operands):
            for b in operands[i + 1 :]:
                made = [abs(a - b), a + b, *([a * b, a / b] if b else []), *([b / a] if a else [])]
                if any(near(x, v) for x in made):
                    return True
        return False

    got = {r.qid: (r.n_supplements, r.n_unverified) for r in run(spark, sf, "number_support")}
    for d in documents:
        half = max(len(d["text"]) // 2, 1)
        said, evidence = N.significant(d["text"][:half]), N.significant(d["text"][half:])
        shared = [v for v in said if v in evidence]
        open_ = [v for v in said if v not in evidence and not derived(v, shared)]
        held = [v for v in open_ if holders[d["source"], v] - {d["doc_id"]}]
        assert got[d["doc_id"]] == (len(held), len(open_) - len(held)), d["doc_id"]


def chunked(blocks, most):
    """blocks: (text, page, is_heading, level) in order. Chunks as (path, [(page, text)])."""
    path, chunks, begun = [], [], None
    for text, page, heading, level in blocks:
        if heading:
            title = " ".join(text.split())
            path = [] if level is None else [(k, t) for k, t in path if k is not None and k < level]
            path = [*path, (level, title)]
            if begun is None or begun["body"]:
                begun = {"parts": [], "body": False}
                chunks.append(begun)
            begun["path"] = [t for _, t in path]
        elif begun is None:
            begun = {"parts": [], "body": True, "path": ["(PREAMBLE)"]}
            chunks.append(begun)
        begun["parts"].append((page, text))
        begun["body"] = begun["body"] or not heading
    out = []
    for i, c in enumerate(chunks, 1):
        pieces, size = [[]], 0
        for page, text in c["parts"]:
            if pieces[-1] and size + len(text) + 1 > most:
                pieces.append([])
                size = 0
            pieces[-1].append((page, text))
            size += len(text) + 1
        for k, p in enumerate(pieces, 1):
            out.append((f"c{i}" if len(pieces) == 1 else f"c{i}-p{k}", " · ".join(c["path"]), k, len(pieces), p[0][0], p[-1][0], len("\n".join(t for _, t in p))))
    return out


def rows_of(rows):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.pos)):
        got[r.doc_id].append((r.chunk_id, r.path, r.part, r.parts, r.first_page, r.last_page, r.n_chars))
    return got


def test_heading_chunks(spark, sf, documents):
    got = rows_of(run(spark, sf, "heading_chunks"))
    for d in documents:
        blocks = [(s, i // 20, len(s) < 30, 1 + len(s) % 3) for i, s in enumerate(d["text"].split("\n"))]
        assert got[d["doc_id"]] == chunked(blocks, 1_000), d["doc_id"]


def test_layout_sections(spark, sf, documents):
    special = {"References", "Conclusion"}
    got = rows_of(run(spark, sf, "layout_sections"))
    for d in documents:
        blocks = []
        for i, line in enumerate(d["text"].split("\n")):
            heading = i % 6 == 0
            text = line
            if i % 42 == 36:
                text = "References"
            elif i % 30 == 24:
                text = "Conclusion"
            elif heading:
                text = f"{1 + i // 18}" + (f".{i % 18 // 6}" if i % 18 else "") + " " + line[:20]
            if heading and text == "References":
                break
            if text.strip(" "):
                number = re.match(r"\s*(\d+(?:\.\d+)*)\.?\s", text)
                level = None if not heading or text in special else number[1].count(".") + 1 if number else 1
                blocks.append((text, i // 20, heading, level))
        assert got.get(d["doc_id"], []) == chunked(blocks, 1_000), d["doc_id"]


def test_coverage_repair(spark, sf):
    from lodestack.operators import ranking as R
    from lodestack.plans.ranking import paths

    fused = defaultdict(list)
    for r in R.rrf(paths(spark, sf)).collect():
        fused[r.qid].append((r.rank, r.key, r.owner))
    want = {}
    for qid, rows in fused.items():
        rows.sort()
        kept = rows[:16]
        best = {}
        for row in rows:
            best.setdefault(row[2], row)
        for owner, row in best.items():  # owners by their best rank
            if owner in {r[2] for r in kept}:
                continue
            spare = [r for r in kept if sum(x[2] == r[2] for x in kept) > 1]
            if not spare:
                break
            kept = sorted([r for r in kept if r != max(spare)] + [row])
        want[qid] = [r[1] for r in kept]
    got = defaultdict(list)
    for r in sorted(run(spark, sf, "coverage_repair"), key=lambda r: (r.qid, r.rank)):
        got[r.qid].append(r.key)
    assert dict(got) == want


def test_multi_value_match(spark, sf):
    items = {r.item_id: list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", r.text.lower()) if len(w) >= 8)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    gold, said = {k: v for k, v in items.items() if v}, {k + 2: v for k, v in items.items() if v}

    def largest(g, p):
        taken = {}

        def place(i, seen):
            for j, b in enumerate(p):
                if j not in seen and (g[i] in b or b in g[i]):
                    seen.add(j)
                    if j not in taken or place(taken[j], seen):
                        taken[j] = i
                        return True
            return False

        return sum(place(i, set()) for i in range(len(g)))

    got = {r.item_id: r for r in run(spark, sf, "multi_value_match")}
    assert got.keys() == gold.keys() | said.keys()
    for k, r in got.items():
        g, p = gold.get(k, []), said.get(k, [])
        met = largest(g, p)
        assert r.matched == met and r.exact == (bool(g) and met == len(g))
        assert math.isclose(r.recall, met / len(g) if g else 0.0) and math.isclose(r.precision, met / len(p) if p else 0.0)


def test_paired_decisions_have_their_test_and_interval(spark):
    from lodestack.operators import evaluation as M

    rows = [(5, q, int(q % 3 == 0), int(q % 2 == 0)) for q in range(120)]
    r = M.paired_decisions(spark.createDataFrame(rows, "k int, qid bigint, x int, y int"), "k", "qid").first()
    gained, lost = sum(y > x for _, _, x, y in rows), sum(x > y for _, _, x, y in rows)
    n, m = gained + lost, min(gained, lost)
    assert (r.gained, r.lost) == (gained, lost)
    assert math.isclose(r.p_exact, min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n), rel_tol=1e-9)
    assert r.low < r.delta < r.high


def test_cross_validated_classes(spark, sf):
    got = run(spark, sf, "cross_validated_classes")
    assert sorted(r.fold for r in got) == [0, 1, 2, 3, 4]
    labelled = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").count()
    assert sum(r.tp + r.fp + r.fn + r.tn for r in got) == labelled
