"""SimHash components and benchmark leaks against brute force."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from lodestack.llm import components, decontaminate, simhash
from lodestack.llm.common import WORD, _ASCII_LOWER, ascii_lower_words
from lodestack.llm.queries import op3_decontaminate, op9_simhash

SCHEMA = "doc_id bigint, text string"


def brute_fingerprint(text):
    words = WORD.findall((text or "").encode().translate(_ASCII_LOWER))
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points):
    """points: {id: fingerprint}; the smallest id reachable over links of two bits or fewer."""
    ids = sorted(points)
    fps = np.asarray([points[i] for i in ids], np.uint64)
    root = {}
    for i, start in enumerate(ids):
        if start in root:
            continue
        todo = [i]
        root[start] = start
        while todo:
            at = todo.pop()
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[at]) <= 2):
                if ids[j] not in root:
                    root[ids[j]] = start
                    todo.append(int(j))
    return root


def test_fingerprints_by_definition():
    for text in (None, "", "   ", "One", "one TWO", "a b c d e f g a b c", " x y", "é É é", "w " * 200):
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def test_whole_table_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: brute_fingerprint(t) for i, t in docs.items()}
    roots = brute_components(want)
    got = op9_simhash(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert int(r.fingerprint, 16) == want[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == roots[r.doc_id]


@pytest.mark.parametrize("seed", [0, 1])
def test_links_connect_all_that_is_close(spark, seed):
    """Dense clouds around few centres, so that some variants are shared by many fingerprints."""
    rng = np.random.default_rng(seed)
    points = set()
    for centre in rng.integers(0, 1 << 63, 6, dtype=np.uint64).tolist() + [0]:
        for _ in range(120):
            p = centre
            for bit in rng.integers(0, 64, int(rng.integers(0, 4))).tolist():
                p ^= 1 << bit
            points.add(p)
    signed = lambda p: p - (1 << 64) if p >= 1 << 63 else p
    ids = {i: p for i, p in enumerate(sorted(points, key=signed))}
    df = spark.createDataFrame([(signed(p), i) for i, p in ids.items()], "fp bigint, least bigint")
    got = {r.fp: r.root for r in simhash.classes(df).collect()}
    want = brute_components(ids)
    assert {ids[i]: ids[want[i]] for i in ids} == {p % (1 << 64): r % (1 << 64) for p, r in got.items()}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 301), (301, 300), (400, 400)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 200)} | {301: 300}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_of_nulls_repeats_clashes_and_nothing(spark):
    rows = [(3, None, "p"), (4, "", "q"), (None, "   ", "r"), (9, "one two three four", "s"), (8, "ONE two three four", "t"), (8, "ONE two three four", "t"), (None, "only here alone", "u")]
    df = spark.createDataFrame(rows, f"{SCHEMA}, fingerprint string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert by["0" * 16] == {3} and {8} in by.values() and {None} in by.values()
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in kept) == [(False, 3, "p"), (False, 8, "t"), (True, 0, "u")]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fingerprint"}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_leaks(docs, items, similarity=0.8):
    """All gapless overlays of every item on every document. Items longer than REACH are not used here."""
    tokens = lambda t: decontaminate.TOKEN.findall((t or "").lower())
    found = set()
    seen = {}
    for item, text in sorted(items, key=lambda x: (x[0] is None, x[0])):
        seen.setdefault(tuple(tokens(text)), item)
    for doc, text in docs:
        t = tokens(text)
        for words, item in seen.items():
            n = len(words)
            if n and any(sum(0 <= s + i < len(t) and t[s + i] == w for i, w in enumerate(words)) >= similarity * n for s in range(-n + 1, len(t))):
                found.add((doc, item))
    return found


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(500)]
    draw = lambda n: [vocab[i] for i in rng.integers(0, 500, n)]
    items = [(i, " ".join(draw(int(rng.integers(12, 40))))) for i in range(30)]
    items += [(100, "just three words"), (101, "Lone"), (102, None), (103, ""), (104, items[0][1].upper()), (None, items[1][1])]
    docs = []
    for i in range(150):
        body = draw(60)
        if i % 2:
            words = items[i % 30][1].split()
            for _ in range(i % 4):  # up to three substitutions, of at least twelve words
                words[int(rng.integers(0, len(words)))] = "other"
            body[20:20] = words
        docs.append((i, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "... just, THREE words!"), (903, "only just three"), (904, items[3][1]), (904, items[3][1]), (None, items[4][1])]
    got = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == brute_leaks(docs, items)
    assert {(902, 100), (904, 3), (None, 4)} <= found and not any(r.doc_id in (900, 901) for r in got)
    assert sum(r.doc_id == 904 for r in got) == 2


@pytest.mark.parametrize("small", [decontaminate.SMALL, 0])
def test_items_of_every_length_against_brute_force(spark, monkeypatch, small):
    """Lengths 1 to 40 with as many substitutions as 0.8 allows and one more, at the edges of documents and inside, by both ways; some blocks are shared by many items."""
    monkeypatch.setattr(decontaminate, "SMALL", small)
    rng = np.random.default_rng(11)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 3_000, n)]
    stock = "once more with feeling now".split()
    items, docs = [], []
    for n in range(1, 41):
        for _ in range(3):
            words = draw(n)
            if n >= 10:
                words[:5] = stock
            if n >= 25:
                words[10:15] = stock
            items.append((len(items), " ".join(words)))
            for extra in (0, 1):
                changed = list(words)
                for at in rng.choice(n, min(n, n // 5 + extra), replace=False).tolist():
                    changed[at] = f"z{at}"
                before, after = draw(int(rng.integers(0, 6))), draw(int(rng.integers(0, 6)))
                docs.append((len(docs), " ".join(before + changed + after)))
            if n > 5:
                docs += [(len(docs), " ".join(words[n // 5 :] + draw(3))), (len(docs) + 1, " ".join(draw(3) + words[: n - n // 5]))]
    docs += [(len(docs) + i, " ".join(draw(5) + stock + draw(5))) for i in range(20)]
    got = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items)
    clean = decontaminate.clean(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {r.doc_id for r in got}


def test_blocks_that_may_go_without_seeds():
    for n in (5, 9, 10, 14, 37, 128, 129, 500):
        q = n // 5
        for shared in ([1] * q, [9] * q, [9] + [1] * (q - 1), [*range(q, 0, -1)]):
            kept, needed = decontaminate.kept_blocks(n, shared)
            hit = -(-q // 2) if n <= decontaminate.RUN else 12
            lost = max(sum(b not in set(kept) for b in range(a, a + 24)) for a in range(max(1, q - 23))) if n > decontaminate.RUN else q - len(kept)
            assert 1 <= needed <= hit - lost
            assert not sum(s == 1 and b not in kept for b, s in enumerate(shared))


def test_clean_keeps_the_rest_as_it_came(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, f"x y {item} z", 7), (2, "nothing here", 8), (None, None, 9), (2, item, 10)], f"{SCHEMA}, item_id int")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert sorted(r.item_id for r in decontaminate.clean(docs, bench).collect()) == [8, 9]
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.clean(docs, nothing).count() == 4
    assert decontaminate.clean(docs.limit(0), bench).count() == 0


def test_long_items_are_compared_in_windows(spark):
    rng = np.random.default_rng(8)
    words = [f"t{i}" for i in rng.integers(0, 5_000, 2_000)]
    doc = " ".join(words[700:1_400])
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    got = decontaminate.leaks(spark.createDataFrame([(1, doc), (2, " ".join(words[:100]))], SCHEMA), bench).collect()
    assert [r.doc_id for r in got] == [1]


def test_whole_table_against_brute_force_on_leaks(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    short = [(i, t) for i, t in docs if len((t or "").split()) < 400]
    found = {(r.doc_id, r.item_id) for r in op3_decontaminate(spark, sf).collect()}
    want = brute_leaks(short, items)
    assert {x for x in found if x[0] in dict(short)} == want


def marks(text):
    words = ascii_lower_words(text)
    return [simhash.word_fingerprint(words, seed) for seed in simhash.NEAR_SEEDS]


def met(a, b):
    """At most one bit of a half of one of the fingerprints differs."""
    return any((h & (x ^ y)).bit_count() <= 1 for x, y in zip(marks(a), marks(b)) for h in HALVES)


HALVES = ((1 << 32) - 1, ((1 << 32) - 1) << 32)


def test_word_fingerprints_by_definition():
    hashes = [xxhash.xxh64_intdigest(w, 7) for w in (b"one", b"two", b"three")]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.word_fingerprint([b"one", b"two", b"one", b"three"], 7) == want and simhash.word_fingerprint([], 7) == 0


def test_keep_one_links_near_copies_and_checks_them(spark):
    """Copies with a changed word are linked where five-word shingles agree, and only there."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 9_000, 300)]
    other = [*words[:150], "changed", *words[151:]]
    near = (" ".join(words), " ".join(other))
    apart = (" ".join(words[::-1]), " ".join(sorted(words)))  # the same words in other orders
    assert met(*near) and simhash.similarity(*near) >= 0.8 and met(*apart) and simhash.similarity(*apart) < 0.8
    df = spark.createDataFrame([(1, near[0]), (2, near[1]), (3, apart[0]), (4, apart[1]), (5, None)], SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3, 4, 5]


def smallest_of_components(texts):
    """The smallest index of each component over pairs that meet in a fingerprint and are similar."""
    fps = np.asarray([marks(t) for t in texts], np.uint64)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in np.flatnonzero(np.any([(np.bitwise_count((fps[:i] ^ fps[i]) & np.uint64(h)) <= 1).any(axis=1) for h in HALVES], axis=0)):
            if find(i) != find(j) and simhash.similarity(texts[i], texts[j]) >= simhash.SIMILARITY:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [i for i in range(len(texts)) if root[i] == i]


def test_keep_one_of_a_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    texts = {" ".join(words)} | {" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(150)}
    rows = sorted(texts, key=lambda t: t != " ".join(words))
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == smallest_of_components(rows) and len(kept) <= 3


def test_keep_one_of_the_table_against_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    kept = simhash.keep_one(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(r.doc_id for r in kept) == [docs[i][0] for i in smallest_of_components([t for _, t in docs])]


def test_parts_of_long_items_are_leaks(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: [f"t{i}" for i in rng.integers(0, 50_000, n)]
    items = {1: draw(500), 2: draw(2_000), 3: draw(140)}
    worn = [w if i % 6 else "other" for i, w in enumerate(items[2][900:1_100])]
    docs = {1: items[1][:300], 2: draw(50) + items[1][100:400] + draw(50), 3: items[2][-150:], 4: worn, 5: items[3][:60] + draw(80), 6: draw(400), 7: items[3][:128]}
    table = lambda x, schema: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], schema)
    got = decontaminate.leaks(table(docs, SCHEMA), table(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (3, 2), (4, 2), (7, 3)]
    assert all(r.similarity >= 0.8 and r.similarity == r.n_matched / r.n_item for r in got)


def test_items_of_five_and_six_words_with_one_substitution(spark):
    items = [(5, "a5 b5 c5 d5 e5"), (6, "a6 b6 c6 d6 e6 f6")]
    docs = []
    for n, text in items:
        for at in range(n):
            words = text.split()
            words[at] = "other"
            docs += [(len(docs), " ".join(["x", "y", *words, "z"]), n), (len(docs) + 1, " ".join(words), n)]
        docs += [(len(docs), " ".join(text.split()[1:]), n), (len(docs) + 1, " ".join(text.split()[:-1]), n)]
    docs += [(900, "x a5 b5 c5 z z", 0), (901, "a6 other c6 other e6 f6", 0)]
    df = spark.createDataFrame(docs, f"{SCHEMA}, item int")
    got = decontaminate.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, n) for i, _, n in docs if n]


def brute_near(texts):
    """The indexes that stay if all pairs at 0.8 are linked, and those pairs, by shared five-word shingles."""
    sets = [simhash._shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(j, i) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for j, i in pairs:
        if find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in range(len(texts)) if root[i] == i}, pairs


def test_keep_one_of_a_large_group_with_edits_of_many_sizes(spark):
    """400 texts that are one component, in buckets larger than those compared pair by pair: nine tenths of what should go do, and more."""
    rng = np.random.default_rng(1)
    base, texts = [f"w{i}" for i in range(200)], set()
    while len(texts) < 400:
        n = int(rng.choice([1, 8, 14]))
        at = int(rng.integers(0, 200 - n))
        texts.add(" ".join([*base[:at], *(f"x{i}" for i in rng.integers(0, 10**6, n)), *base[at + n :]]))
    texts = sorted(texts)
    want, _ = brute_near(texts)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert want == {0} and want <= kept and len(kept) <= 8


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """With buckets of three compared pair by pair, the same texts stay as when all pairs of all buckets are."""
    rng = np.random.default_rng(6)
    base, texts = [f"w{i}" for i in range(120)], set()
    while len(texts) < 150:
        n = int(rng.integers(1, 9))
        at = int(rng.integers(0, 120 - n))
        texts.add(" ".join([*base[:at], *(f"x{i}" for i in rng.integers(0, 10**6, n)), *base[at + n :]]))
    df = spark.createDataFrame(list(enumerate(sorted(texts))), SCHEMA)
    kept = []
    for up_to in (3, 10_000):
        monkeypatch.setattr(simhash, "NEAR_PAIRS_UP_TO", up_to)
        kept.append(sorted(r.doc_id for r in simhash.keep_one(df).collect()))
    assert kept[0] == kept[1]


def _components_by_hand(texts):
    """Smallest index of each component: one bit at most apart in a half of one of the fingerprints, and similar."""
    words = [t.encode().split() for t in texts]
    prints = [[simhash.word_fingerprint(w, seed) for seed in simhash.NEAR_SEEDS] for w in words]
    shingles, root = [simhash._shingles_of(w) for w in words], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            half = any(((x ^ y) >> at & 0xFFFFFFFF).bit_count() <= 1 for x, y in zip(prints[i], prints[j]) for at in (0, 32))
            if half and len(shingles[i] & shingles[j]) >= simhash.SIMILARITY * len(shingles[i] | shingles[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in range(len(texts))}


def test_copies_outside_a_large_component_are_not_compared_with_all_of_it(spark, monkeypatch):
    """Copies of one text with 1 to 14 changed words: those too far from the rest met every one of it before."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(240):
        words = list(base)
        for at in rng.choice(200, 1 + k % 14, replace=False):
            words[at] = f"n{k}x{at}"
        texts.append(" ".join(words))
    texts += [texts[13].replace("w199", "other"), texts[27].replace("w198", "other")]  # copies of two far ones
    compared, kept_of = [], simhash.cut

    def counted(df, name):
        out = kept_of(df, name)
        if name == "candidates":
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert kept == _components_by_hand(texts) and 1 < len(kept) < 200
    assert len(compared) == 2 and compared[1] < 3 * len(texts)


def test_no_table_is_broadcast_by_keep_one(spark, monkeypatch):
    """Small tables are joined by sorted shuffles, too: a broadcast is collected and built in the driver."""
    rng = np.random.default_rng(7)
    texts = [" ".join([*(f"w{i}" for i in range(60)), *(f"x{i}" for i in rng.integers(0, 10**6, k % 5))]) for k in range(60)]
    plans, kept_of = [], simhash.cut

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept_of(df, name)

    monkeypatch.setattr(simhash, "cut", seen)
    monkeypatch.setattr(components, "cut", seen)
    found = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len({r.doc_id for r in found.collect()}) < 60
    assert sum("SortMergeJoin" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


def test_components_end_once_every_node_hangs_on_a_root(spark, monkeypatch):
    """Stars are left as they come; two that are joined take one round, which is not repeated to see that nothing changes."""
    written, write = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, name: written.append(name) or write(df, name))
    stars = [(1, i) for i in range(2, 9)] + [(20, i) for i in range(21, 25)]
    for edges, tables in ((stars, ["edges"]), ([*stars, (20, 1)], ["edges", "stars", "edges"]), ([], ["edges"])):
        written.clear()
        got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        want = {b: a for a, b in stars} if len(edges) == len(stars) else {i: 1 for i in [*range(2, 9), *range(20, 25)]} if edges else {}
        assert got == want and written == tables


def test_sketches_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(6)
    tell = lambda x, y: int(np.bitwise_count(simhash._odd(x).view(np.uint64) ^ simhash._odd(y).view(np.uint64)).sum())
    for n in (0, 1, 5, 60, 900, 5000):
        x = {b"%d" % i for i in rng.integers(0, 10**9, n)}
        for gone in (0, 1, n // 9, n // 2, n):
            y = set(sorted(x)[gone:]) | {b"n%d" % i for i in range(gone // 3)}
            assert tell(x, x) == 0 and (len(x ^ y) % 2 + tell(x, y)) % 2 == 0 and tell(x, y) <= len(x ^ y)
    assert len(simhash._odd(set())) * 64 == simhash.ODD_BITS and tell({b"a"}, set()) == 1


def test_pairs_that_share_words_but_no_shingles_are_told_apart_without_their_texts(spark, monkeypatch):
    """30 texts of the same words in other orders have one fingerprint: all 435 pairs were read before; three copies are still found."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.permutation(base).tolist()) for _ in range(28)]
    texts += [texts[3].replace("w7 ", "w8 ", 1), texts[5] + " w9", texts[5] + " w9 w9"]
    read, kept_of = [], simhash.cut

    def counted(df, name):
        out = kept_of(df, name)
        if name == "candidates":
            read.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert kept == set(range(28)) == _components_by_hand(texts)
    assert sum(read) <= 8
