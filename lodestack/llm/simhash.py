"""SimHash near-duplicates found with deletion-variant signatures.

Fingerprints at ``DISTANCE`` (2) or fewer differing bits are linked. A fingerprint is cut into two segments of 32 bits: of
two differing bits at most one falls into one of the segments. So each distinct fingerprint is indexed under the 2 * 32
variants that wipe one bit of one segment, an equality join finds those that share a variant, and the Hamming distance
is verified. Variants shared by more than ``PAIRS_UP_TO`` fingerprints would give pairs in square number; their members are
linked exactly through the points at distance one instead: two fingerprints differ in at most two bits just if they share
one of their 65 points, and a point needs only one link from each member to its smallest.

``keep_one`` removes near copies, whose shingles differ in more bits than that. Its fingerprints are of distinct words, three for a
text (``NEAR_SEEDS``): word lists that differ in at most one bit of a segment of any of the three (a fingerprint that differs in 3 bits
or fewer always has such a segment, one that differs in more often has) are linked where the Jaccard similarity of their five-word shingles
is at least ``SIMILARITY``. Texts of a pair are only read if its sketches of their shingles leave that open (``_may_be_alike``), which
loses no link. Variants that up to ``NEAR_PAIRS_UP_TO`` word lists share give all pairs. In a variant that more share, each
is first compared with the smallest and the next of them; then every one that these links leave outside the variant's largest component
is compared with those of other components that may be like it, told by their differences from a text of the largest (``_pairs_apart``). Any
two that are still apart have one of them outside the largest, so no link between components is lost, and near copies of one text are
not compared pair by pair. Of a second large family of near copies in one variant only that bound on whole texts is left, which is weaker.

Results: a null or wordless text has fingerprint zero and is linked like any other; equal texts share a fingerprint;
null ids take no part in finding the smallest id (a component of null ids only has a null id); repeated rows are
returned each. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower_words, computed, cut, cut_in_turn, merged
from .components import components

WORDS = 3
SEED = 42
DISTANCE = 2
#: Largest variant bucket whose pairs are compared one by one.
PAIRS_UP_TO = 4
#: Of keep_one: bits (which say how many segments a fingerprint has), seeds of its fingerprints, words of a shingle, Jaccard similarity, largest variant bucket whose pairs are compared at once.
NEAR = 3
NEAR_SEEDS = (42, 43, 44)
NEAR_WORDS = 5
SIMILARITY = 0.8
NEAR_PAIRS_UP_TO = 32
#: Bits of the sketch that tells from afar how many shingles of two texts differ at least.
ODD_BITS = 1024
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, each counted as often as it occurs."""
    words = ascii_lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return _majority(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), "<u8", len(starts)))


def word_fingerprint(words: list[bytes], seed: int) -> int:
    """SimHash of the distinct words, each counted once: a changed word touches one of them, where it touches several shingles."""
    distinct = set(words)
    return _majority(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in distinct), "<u8", len(distinct))) if distinct else 0


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every document. Narrow."""

    def work(texts: list) -> dict:
        return {"fp": np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)}

    return computed(docs, text_col, (id_col,), {"fp": "bigint"}, lambda: work)


def _variants(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The columns of ``fps`` and key, under each of the 64 signatures of a fingerprint: ceil((distance + 1) / 2) segments, one bit wiped."""
    n = distance // 2 + 1
    ends = [64 * k // n for k in range(n + 1)]
    segment = [next((a, b) for a, b in zip(ends, ends[1:]) if a <= i < b) for i in range(64)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.array(*[F.lit(signed((1 << b) - (1 << a) & ~(1 << i))).cast("bigint") for i, (a, b) in enumerate(segment)])
    offsets = F.array(*[F.lit(a) for a, _ in segment])
    at = fps.select("*", F.explode(F.expr("sequence(0, 63)")).alias("i")).withColumns({"_mask": masks[F.col("i")], "_from": offsets[F.col("i")]})
    return at.withColumn("key", F.expr("shiftrightunsigned(fp & _mask, _from) | shiftleft(cast(i as bigint), 32)")).drop("i", "_mask", "_from")


def _shared(*variants: DataFrame) -> DataFrame:
    """Variants with n, the number of rows that share their key, where that is more than one; of several tables one after the other, each by itself.

    Keys are counted before rows are looked up by them, so that a key of many rows is no single task's. Shared keys are a written
    table, whose size Spark knows when it chooses the join. What is returned is one written table, which plans read as one.
    """

    def of(table: DataFrame) -> DataFrame:
        return merged(table, cut(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counted"), "key")

    return cut_in_turn("shared", *map(of, variants))


def _close(a: str, b: str, distance: int = DISTANCE) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _points(fps: DataFrame) -> DataFrame:
    """The columns of ``fps`` and point: the fingerprint and its 64 neighbours at distance one."""
    return fps.select("*", F.explode(F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")).alias("point"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that differ in at most two bits: enough of them to connect all that are linked.

    ``fps`` (fp, distinct) is read more than once, so it should be a written table.
    """
    shared = _shared(_variants(fps))
    few = shared.where(F.col("n") <= PAIRS_UP_TO)
    of_few = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b")
    many = shared.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
    points = _points(many)
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    of_many = points.join(least, "point").select(F.col("fp").alias("a"), "b").where("a <> b")
    return of_few.unionByName(of_many).where(_close("a", "b"))


def classes(distinct: DataFrame) -> DataFrame:
    """(fp, least, root) of distinct fingerprints (fp, least): root is the smallest fingerprint of their component."""
    distinct = cut(distinct, "distinct")
    roots = components(links(distinct.select("fp")))
    return cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classed")


def _shingles(text: str | None) -> set[bytes]:
    return _shingles_of(ascii_lower_words(text))


def _shingles_of(words: list[bytes]) -> set[bytes]:
    width = min(NEAR_WORDS, len(words))
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def _odd(shingles: set[bytes]) -> np.ndarray:
    """Which of ``ODD_BITS`` groups, by a hash, hold an odd number of the shingles. Sketches of two sets differ in no more bits than the sets in shingles."""
    at = np.fromiter((xxhash.xxh64_intdigest(s) % ODD_BITS for s in shingles), np.int64, len(shingles))
    return np.packbits(np.bincount(at, minlength=ODD_BITS) % 2 == 1).view(np.int64)


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of the sets of five-word shingles; two wordless texts are equal."""
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def _may_be_alike(least: float) -> Column:
    """Whether the Jaccard similarity of a pair with of_a.* and of_b.* (size, odd) may be ``least``, by the numbers of shingles and by how many differ at least."""
    a, b = F.col("of_a.size"), F.col("of_b.size")
    differ = F.aggregate(F.zip_with("of_a.odd", "of_b.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    # A little more than the bound, so that rounding loses nothing.
    return (a >= least * b) & (b >= least * a) & (differ <= (1 - least) / (1 + least) * (a + b) + 1e-6)


def _first_pairs(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the small buckets of ``shared`` (key, n, node), of the large ones each with the smallest and the next."""
    few, many = shared.where(F.col("n") <= NEAR_PAIRS_UP_TO), shared.where(F.col("n") > NEAR_PAIRS_UP_TO)
    a, b = (few.select(F.col("key").alias(f"key_{x}"), F.col("node").alias(x)) for x in "ab")
    of_few = merged(a, b, (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b"))).select("a", "b")
    # Counted in parts of a bucket, which name their smallest to the whole.
    parts = many.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(64)))
    least = parts.groupBy("key", "part").agg(F.min("node").alias("other")).groupBy("key").agg(F.min("other").alias("other"))
    following = parts.withColumn("other", F.lead("node").over(Window.partitionBy("key", "part").orderBy("node"))).where("other is not null")
    met = following.select("node", "other").unionByName(merged(many, least, "key").select("node", "other"))
    of_many = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a < b")
    return of_few.unionByName(of_many).distinct()


def _differences(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The columns of ``nodes`` (pivot, node, size and more), pivot_size and differs: hashes of the shingles that only one of the texts of pivot and node has.

    texts: (node, text) of the pivots, too.
    """

    @F.pandas_udf("pivot_size bigint, differs array<bigint>")
    def apart(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = []
        for x, y in zip(a, b):
            x, y = _shingles(x), _shingles(y)
            found.append((len(y), [xxhash.xxh64_intdigest(s) - (1 << 63) for s in x ^ y]))
        return pd.DataFrame(found, columns=["pivot_size", "differs"])

    of_pivots = merged(texts, nodes.select(F.col("pivot").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    both = merged(merged(nodes, texts, "node"), of_pivots, "pivot")
    return both.withColumn("m", apart("text", "pivot_text")).select(*nodes.columns, "m.*")


def _pairs_apart(differing: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: every pair of nodes of one pivot and different roots, one of them not of the pivot's root, whose similarity may be ``least``.

    differing: pivot, node, root, size, pivot_size, differs. Texts of Jaccard similarity t or more differ in at most
    D = (1 - t) / (1 + t) * (sum of sizes) shingles, and so do their differences from a pivot, of e and f shingles: those have
    (e + f - D) / 2 in common, and sorted from rare to frequent they meet within the first (e - f + D) / 2 + 1 of the one and
    (f - e + D) / 2 + 1 of the other. What two near copies have both lost is frequent and comes late, what each has gained is its
    own: independent copies of one text don't meet, where whole texts would. For lack of the other's figures f is at least
    e - D and D at most (1 - t) / t * size; who asks is further from the pivot than D, which bounds what is asked by half its
    differences. Those that are nearer to the pivot, but not of its component, are compared with all of it.
    """
    spread = (1 - least) / (1 + least)
    # A little more than the bounds, so that rounding loses nothing.
    most, further = (1 - least) / least * F.col("size") + 1e-6, spread * F.greatest(F.lit(0), F.col("size") - F.col("pivot_size")) + 1e-6
    e = F.col("e")
    rows = cut(differing.withColumn("e", F.size("differs")).withColumns({
        "near": e <= spread * (F.col("size") + F.col("pivot_size")) + 1e-6,
        "asks": F.floor((F.least(e, most) + most) / 2) + 1,
        "asked": F.least(F.floor((e + further) / 2), F.floor(most)) + 1,
    }), "differing")
    spelled = rows.select("pivot", "node", F.explode("differs").alias("s"))
    ranked = merged(spelled, spelled.groupBy("pivot", "s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), ["pivot", "s"], "left")
    # Of shingles that no other has (df is null) only the number counts: they come first.
    own = Window.partitionBy("pivot", "node").orderBy(F.col("df").asc_nulls_first(), "s")
    placed = cut(merged(ranked.withColumn("at", F.row_number().over(own) - 1).where("df is not null"), rows.drop("differs"), ["pivot", "node"]).where("at < greatest(asks, asked)"), "placed")

    def renamed(df: DataFrame) -> DataFrame:
        return df.select("pivot", *(["s"] if "s" in df.columns else []), *(F.col(c).alias(f"x_{c}") for c in ("node", "root", "size", "e", "at") if c in df.columns))

    fits = (F.col("x_root") != F.col("root")) & (F.col("x_size") >= least * F.col("size") - 1e-6) & (F.col("size") >= least * F.col("x_size") - 1e-6)
    common = (F.col("x_e") + F.col("e") - spread * (F.col("x_size") + F.col("size"))) / 2 - 1e-6
    left = F.least(F.col("x_e") - F.col("x_at"), F.col("e") - F.col("at"))
    meet = merged(renamed(placed.where("root <> pivot and not near and at < asks")), placed.where("at < asked"), ["pivot", "s"]).where(fits & (left >= common))
    close = merged(renamed(rows.where("root <> pivot and near")), rows, "pivot").where(fits)
    pairs = meet.select("x_node", "node").unionByName(close.select("x_node", "node"))
    return pairs.select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b")).distinct()


def _apart(shared: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pivot, node, root, size): members of the large buckets of ``shared`` that hold several components; pivot is the root of a bucket's largest.

    roots: (node, root) of nodes that are not their own root; sizes: (node, size), the number of shingles.
    """
    many = merged(shared.where(F.col("n") > NEAR_PAIRS_UP_TO).select("key", "node"), sizes, "node")
    rooted = cut(merged(many, roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    held = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = held.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return cut(merged(rooted, largest, "key").select("pivot", "node", "root", "size").distinct(), "apart")


def _share_variant(names: list[str], distance: int) -> Column:
    """Whether the fingerprints of_a.* and of_b.* of a pair agree in all but one bit of a segment, as those of one bucket do."""
    n = distance // 2 + 1
    ends = [64 * k // n for k in range(n + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    within = [F.bit_count(F.col(f"of_a.{c}").bitwiseXOR(F.col(f"of_b.{c}")).bitwiseAND(F.lit(signed((1 << b) - (1 << a))).cast("bigint"))) <= 1 for c in names for a, b in zip(ends, ends[1:])]
    return reduce(Column.__or__, within)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = NEAR, least_similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component of near copies, with its columns as they came: the one with the smallest id (null ids last)."""

    names = [f"fp{i}" for i in range(len(NEAR_SEEDS))]

    @F.pandas_udf(", ".join([*(f"{n} bigint" for n in names), "node bigint", "size bigint", "odd array<bigint>"]))
    def marks(texts: pd.Series) -> pd.DataFrame:
        found, odd = np.zeros((len(texts), len(names) + 2), np.uint64), np.zeros((len(texts), ODD_BITS // 64), np.int64)
        for i, words in enumerate(map(ascii_lower_words, texts)):  # the words of one text at a time
            shingles = _shingles_of(words)
            found[i] = [*(word_fingerprint(words, seed) for seed in NEAR_SEEDS), xxhash.xxh64_intdigest(b" ".join(words)), len(shingles)]
            odd[i] = _odd(shingles)
        return pd.DataFrame(found.view(np.int64), columns=[*names, "node", "size"]).assign(odd=list(odd))

    marked = docs.select(F.struct("*").alias("row"), marks(F.col(text_col)).alias("m"), F.monotonically_increasing_id().alias("uid"))
    rows = cut(marked.select("row", "m.*", "uid"), "rows")
    order = F.struct(F.col(f"row.{id_col}").isNull().alias("null"), F.col(f"row.{id_col}").alias("id"), "uid")
    distinct = cut(rows.groupBy("node").agg(*(F.min(n).alias(n) for n in names), F.min("size").alias("size"), F.min("odd").alias("odd"), F.min(order).alias("least")), "distinct")
    # One kind of fingerprint after the other, so that no task holds the variants of all of them.
    shared = _shared(*(_variants(distinct.select("node", F.col(n).alias("fp")), distance).select("node", F.expr(f"key | shiftleft({i}L, 40)").alias("key")) for i, n in enumerate(names)))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype=float)

    def texts_of(nodes: DataFrame) -> DataFrame:
        asked = merged(nodes.distinct(), distinct, "node").select("node", F.col("least.uid").alias("uid"))
        return cut(merged(rows.select("uid", F.col(f"row.{text_col}").alias("text")), asked, "uid").select("node", "text"), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "candidates")
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        both = merged(merged(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return cut(both.where(alike("text_a", "text_b") >= least_similarity).select("a", "b"), "links")

    def marked_pairs(pairs: DataFrame, *columns: str) -> DataFrame:
        a, b = (distinct.select(F.col("node").alias(x), F.struct(*columns).alias(f"of_{x}")) for x in "ab")
        return merged(merged(pairs, a, "a"), b, "b")

    links = linked(marked_pairs(_first_pairs(shared), "size", "odd").where(_may_be_alike(least_similarity)).select("a", "b"))
    roots = components(links)
    apart = _apart(shared, roots, distinct.select("node", "size"))
    if not apart.isEmpty():
        differing = _differences(apart, texts_of(apart.select(F.explode(F.array("pivot", "node")).alias("node"))))
        pairs = marked_pairs(_pairs_apart(differing, least_similarity), *names, "size", "odd")
        between = linked(pairs.where(_share_variant(names, distance) & _may_be_alike(least_similarity)).select("a", "b"))
        if not between.isEmpty():
            roots = components(between.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = merged(distinct.select(F.col("node").alias("_node"), "least"), roots, F.col("_node") == F.col("node"), "left").select("least", F.coalesce("root", "_node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.uid").alias("uid"))
    return merged(rows, first, "uid", "left_semi").select("row.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id, component_root) of every document; component_root names the component even where ids are null."""
    rows = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    classed = classes(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    ids = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = classed.select("fp", "root").join(ids, "root")
    return rows.join(of_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("component_root"))
