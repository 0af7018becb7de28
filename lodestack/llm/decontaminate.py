"""Benchmark decontamination with spaced seeds.

Texts become lower-case word tokens. A mask such as 11011 selects four of five neighbouring tokens; the hash of the selected
ones is a seed, which survives a substitution at the position that the mask ignores. A benchmark item is cut into blocks of five
tokens, each with the seeds of all masks; documents have them at every position. Seeds are equality-joined, and around hits the two
texts are laid on each other without gaps: an overlap counts when at least ``SIMILARITY`` of the item's tokens agree in place.

No overlap is missed: of n tokens at most n / 5 differ, so of the item's q = n // 5 blocks at least half hold one difference or
none, and each of those hits. This also thins what is verified: an item and a shift need as many hit blocks (``needed``), and
the blocks whose seeds most items share need no seeds at all while enough others have them (``kept``). Items of fewer than
five tokens have one seed, of all their tokens.

Of an item longer than ``RUN`` tokens a part counts by itself: any overlap in which ``SIMILARITY`` of a window of ``RUN`` tokens agrees. Items
longer than ``REACH`` are not verified as a whole but over windows of that length.

Two ways to the same rows. A benchmark of up to ``SMALL`` seeds and tokens is broadcast whole and documents are judged where they
are read, without a shuffle. A larger one is joined: only a bitmap of 2 ** ``BITMAP`` bits is broadcast, which lets pass the
documents' seeds that the benchmark may have, and Spark joins those with its seeds.

Results: null and wordless documents and items match nothing; equal items are one item, under the smallest id (null ids
last); repeated documents are reported each. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64

TOKEN = re.compile(r"[^\W_]+")
BLOCK = 5
#: Together they ignore any one position of a block: 1111 stands for its first and for its last four.
MASKS = ("1111", "10111", "11011", "11101")
SIMILARITY = 0.8
REACH = 512
#: Tokens of a part of an item that counts by itself.
RUN = 128
BITMAP = 27
SMALL = 2_000_000
#: Tokens whose seeds are computed together, and joined seeds that are laid out together.
TOGETHER = 1 << 20
#: Token hashes remembered by a Python worker.
REMEMBER = 500_000
#: Odd multipliers, one for each position of each mask.
_MULTIPLIERS = mix64(np.arange(2_000, dtype=np.uint64)) | np.uint64(1)


class TokenHash(dict):
    """Token to 64-bit hash, remembered."""

    def __missing__(self, token: str) -> int:
        self[token] = found = xxhash.xxh64_intdigest(token)
        return found

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > REMEMBER:
            self.clear()
        tokens = TOKEN.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def seeds(tokens: np.ndarray, mask: str, serial: int) -> np.ndarray:
    """The seed at each position where the mask fits."""
    n = len(tokens) - len(mask) + 1
    total = np.full(max(n, 0), serial, np.uint64)
    for at, one in enumerate(mask):
        if one == "1" and n > 0:
            total += tokens[at : at + n] * _MULTIPLIERS[100 * serial + at]
    return mix64(total)


def masks_for(short: list[int]) -> list[tuple[int, str]]:
    """(serial, mask): those of blocks, and of all tokens of shorter items of the given lengths."""
    return [*enumerate(MASKS, 1), *((10 + n, "1" * n) for n in short)]


def item_seeds(tokens: np.ndarray) -> list[tuple[int, int, int]]:
    """(seed, position, block) of an item."""
    n = len(tokens)
    if 0 < n < BLOCK:
        return [(int(seeds(tokens, "1" * n, 10 + n)[0]), 0, 0)]
    found = []
    for serial, mask in enumerate(MASKS, 1):
        every = seeds(tokens, mask, serial).tolist()
        for block in range(n // BLOCK):
            for at in range(block * BLOCK, (block + 1) * BLOCK - len(mask) + 1):
                found.append((every[at], at, block))
    return found


def kept_blocks(n: int, shared: list[int]) -> tuple[list[int], int]:
    """(blocks that keep their seeds, how many of them must be hit), given the number of items that share each block's commonest seed.

    Up to ``RUN`` tokens half of the q blocks are hit, so all but that half less one may go without. Beyond, a window of ``RUN``
    tokens holds 24 whole blocks of which 12 are hit, and 3 of each 12 go: at most 9 of the 24.
    """
    q = len(shared)
    if n < 2 * BLOCK:
        return [*range(q)], 1
    if n <= RUN:
        hit = -(-q // 2)
        rare = sorted(range(q), key=lambda b: (shared[b], b))[: q - hit + 1]
        common = max(shared[b] for b in rare)
        kept = [b for b in range(q) if b in set(rare) or shared[b] <= max(common, 1)]
        return kept, hit - (q - len(kept))
    gone = [b for at in range(0, q, 12) for b in sorted(range(at, min(at + 12, q)), key=lambda b: (-shared[b], b))[:3] if shared[b] > 1]
    return [b for b in range(q) if b not in set(gone)], 3


def verified(doc: np.ndarray, item: np.ndarray, shift: int, similarity: float) -> tuple[float, int, int]:
    """(similarity, tokens compared, tokens that agree) of an item laid on a document; the widest window that is similar enough, else similarity 0."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = np.zeros(len(item), np.int64)
    same[a:b] = doc[shift + a : shift + b] == item[a:b]
    run = np.concatenate([[0], np.cumsum(same)])
    for width in dict.fromkeys(min(len(item), w) for w in (REACH, RUN)):
        best = int((run[width:] - run[:-width]).max())
        if best / width >= similarity:
            return best / width, width, best
    return 0.0, 0, 0


# ---- the benchmark ----


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, tokens binary, n, seeds array of (h, pos, block)) of each distinct item."""

    @F.pandas_udf("tokens binary, n int, seeds array<struct<h:bigint,pos:int,block:int>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = TokenHash()
        for batch in texts:
            out = []
            for text in batch:
                tokens = known.of(text)
                out.append((tokens.tobytes(), len(tokens), [{"h": h - (1 << 64) if h >> 63 else h, "pos": p, "block": b} for h, p, b in item_seeds(tokens)]))
            yield pd.DataFrame(out, columns=["tokens", "n", "seeds"])

    hashed = benchmark.select(F.col(id_col).alias("item_id"), run(F.col(text_col)).alias("m")).select("item_id", "m.*").where("n > 0")
    return hashed.groupBy("tokens").agg(F.min("item_id").alias("item_id"), F.first("n").alias("n"), F.first("seeds").alias("seeds"))


def _index(items: DataFrame) -> DataFrame:
    """(key, item_id, tokens, n, needed, seeds): items with the seeds of the blocks that keep them."""
    rows = items.select(F.xxhash64("tokens").alias("key"), F.explode("seeds").alias("s")).select("key", "s.h", "s.block")
    common = rows.groupBy("h").agg(F.countDistinct("key").alias("c"))
    shared = rows.join(common, "h").groupBy("key", "block").agg(F.max("c").alias("c")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("block", "c"))).alias("shared"))

    @F.pandas_udf("kept array<int>, needed int")
    def keep(n: pd.Series, counts: pd.Series) -> pd.DataFrame:
        got = [kept_blocks(k, [c[b] for b in range(len(c))]) for k, c in zip(n, map(dict, counts))]
        return pd.DataFrame({"kept": [g[0] for g in got], "needed": [g[1] for g in got]})

    joined = items.withColumn("key", F.xxhash64("tokens")).join(shared, "key").withColumn("m", keep("n", "shared"))
    return joined.select("key", "item_id", "tokens", "n", "m.needed", F.filter("seeds", lambda s: F.array_contains("m.kept", s["block"])).alias("seeds"))


class Benchmark:
    """A benchmark small enough to be broadcast: sorted seeds with their items, and the items' tokens."""

    def __init__(self, items: list, similarity: float):
        self.similarity, self.tokens = similarity, [np.frombuffer(r["tokens"], np.uint64) for r in items]
        self.needed = np.asarray([r["needed"] for r in items], np.int64)
        rows = np.asarray([(s["h"], i, s["pos"], s["block"]) for i, r in enumerate(items) for s in r["seeds"]], np.int64).reshape(-1, 4)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        self.h, self.item, self.pos, self.block = (np.ascontiguousarray(rows[:, k]) for k in range(4))
        self.low = np.uint64((1 << min(24, max(16, len(rows).bit_length() + 6))) - 1)
        self.marks = np.zeros(int(self.low) + 1, bool)
        self.marks[self.h & np.int64(self.low)] = True
        self.masks = masks_for(sorted({len(t) for t in self.tokens if len(t) < BLOCK}))

    def leaks(self, texts: list[np.ndarray]) -> dict[int, dict[int, tuple[float, int, int]]]:
        """{text: {item: (similarity, tokens compared, tokens that agree)}} of the texts that overlap items."""
        found: dict[int, dict[int, tuple[float, int, int]]] = {}
        if not len(self.h):
            return found
        begin = np.cumsum([0, *map(len, texts)])
        for d, at, h in _hits(texts, begin, self.masks, lambda x: self.marks[(x & self.low).astype(np.int64)]):
            low, high = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
            some = np.flatnonzero(high > low)
            laid = [np.zeros((0, 4), np.int64)]
            for a, b in _slices((high - low)[some]):
                part = some[a:b]
                times = (high - low)[part]
                row = np.repeat(low[part], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                laid.append(np.unique(np.column_stack([np.repeat(d[part], times), self.item[row], np.repeat(at[part], times) - self.pos[row], self.block[row]]), axis=0))
            rows = np.unique(np.concatenate(laid), axis=0)
            places, hit = np.unique(rows[:, :3], axis=0, return_counts=True)
            for doc, item, shift in places[hit >= self.needed[places[:, 1]]].tolist() if len(places) else []:
                best = verified(texts[doc], self.tokens[item], shift, self.similarity)
                if best[1]:
                    mine = found.setdefault(doc, {})
                    mine[item] = max(mine.get(item, best), best, key=lambda x: (x[1], x[0]))
        return found


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of elements whose sizes add up to about ``TOGETHER``."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        yield at, upto
        at = upto


def _hits(texts: list[np.ndarray], begin: np.ndarray, masks: list[tuple[int, str]], known: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, seed) of seeds that ``known`` lets pass, texts in groups that are hashed together; a text's come at once."""
    for a, b in _slices(np.diff(begin)):
        tokens = np.concatenate(texts[a:b]) if b - a > 1 else texts[a]
        ends, out = begin[a + 1 : b + 1] - begin[a], []
        for serial, mask in masks:
            h = seeds(tokens, mask, serial)
            at = np.flatnonzero(known(h))
            d = np.searchsorted(ends, at, "right")
            inside = at + len(mask) <= ends[np.minimum(d, len(ends) - 1)]
            at, d = at[inside], d[inside]
            out.append((a + d, at + begin[a] - begin[a + d], h[at].view(np.int64)))
        yield tuple(np.concatenate([o[k] for o in out]) for k in range(3))


# ---- documents ----

_FOUND = "array<struct<item:int,n_matched:int,n_item:int,similarity:double>>"


def _judge(shared, texts: Iterator[pd.Series]) -> Iterator[tuple[int, dict]]:
    known = TokenHash()
    for batch in texts:
        yield len(batch), shared.value.leaks([known.of(t) for t in batch])


def _small(items: DataFrame, similarity: float) -> tuple[Benchmark, list] | None:
    """The benchmark on the driver, if it is small enough."""
    seeds_held, tokens_held = items.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if max(seeds_held, tokens_held) > SMALL:
        return None
    rows = items.orderBy("key", "tokens").collect()
    return Benchmark(rows, similarity), [r["item_id"] for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, text_hash, item_id, n_matched, n_item, similarity) of each document and benchmark item that overlap; text_hash is xxhash64 of the text.

    ``similarity`` is ``SIMILARITY`` or more: what is less alike need not share a seed.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"overlaps below {SIMILARITY} may share no seed")
    items = cut(_index(_items(benchmark, item_col, item_text_col)), "items")
    text_hash = F.xxhash64(F.col(text_col)).alias("text_hash")
    if (small := _small(items, similarity)) is None:
        return _joined(docs, items, similarity, id_col, text_col, item_col)
    shared = docs.sparkSession.sparkContext.broadcast(small[0])
    kind = items.schema["item_id"].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame([*enumerate(small[1])], f"item int, item_id {kind}")

    @F.pandas_udf(_FOUND)
    def overlaps(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for n, found in _judge(shared, texts):
            yield pd.Series([[{"item": i, "n_matched": m, "n_item": w, "similarity": s} for i, (s, w, m) in found[d].items()] if d in found else [] for d in range(n)], dtype=object)

    rows = docs.select(F.col(id_col).alias("_id"), text_hash, F.explode(overlaps(F.col(text_col))).alias("m"))
    return rows.join(F.broadcast(ids), F.col("m.item") == ids["item"]).select(F.col("_id").alias(id_col), "text_hash", F.col("item_id").alias(item_col), "m.n_matched", "m.n_item", "m.similarity")


def _joined(docs: DataFrame, items: DataFrame, similarity: float, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """The same for a benchmark of any size."""
    index = items.select("key", "needed", F.explode("seeds").alias("s")).select("key", "needed", "s.h", "s.pos", "s.block")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(index, BITMAP))
    masks = masks_for([r[0] for r in items.where(F.col("n") < BLOCK).select("n").distinct().collect()])  # four lengths at most

    @F.pandas_udf("tokens binary, hits array<struct<h:bigint,at:int>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = TokenHash()
        low = np.uint64((1 << BITMAP) - 1)
        passes = lambda h: (shared.value[((h & low) >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
        for batch in texts:
            tokens = [known.of(t) for t in batch]
            hits: list[list] = [[] for _ in tokens]
            for d, at, h in _hits(tokens, np.cumsum([0, *map(len, tokens)]), masks, passes):
                for doc, place, seed in zip(d.tolist(), at.tolist(), h.tolist()):
                    hits[doc].append({"h": seed, "at": place})
            yield pd.DataFrame({"tokens": [t.tobytes() if h else None for t, h in zip(tokens, hits)], "hits": hits})

    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.monotonically_increasing_id().alias("uid"), scan(F.col(text_col)).alias("m"))
    scanned = cut(slim.select("_id", "text_hash", "uid", "m.*").where(F.size("hits") > 0), "hits")
    hits = scanned.select("uid", F.explode("hits").alias("s")).select("uid", "s.h", "s.at")
    blocks = hits.join(index, "h").select("uid", "key", "needed", (F.col("at") - F.col("pos")).alias("shift"), "block").distinct()
    laid = blocks.groupBy("uid", "key", "needed", "shift").agg(F.count(F.lit(1)).alias("n")).where("n >= needed")
    shifts = laid.groupBy("uid", "key").agg(F.collect_set("shift").alias("shifts"))  # of one document and one item: fewer than its tokens
    pairs = shifts.join(items.select("key", "item_id", F.col("tokens").alias("item_tokens")), "key").join(scanned.drop("hits"), "uid")

    @F.pandas_udf("similarity double, n_item int, n_matched int")
    def check(tokens: pd.Series, item_tokens: pd.Series, every: pd.Series) -> pd.DataFrame:
        out = []
        for t, i, s in zip(tokens, item_tokens, every):
            doc, item = np.frombuffer(t, np.uint64), np.frombuffer(i, np.uint64)
            out.append(max((verified(doc, item, int(shift), similarity) for shift in s), key=lambda x: (x[1], x[0])))
        return pd.DataFrame(out, columns=["similarity", "n_item", "n_matched"])

    checked = pairs.select("_id", "text_hash", "item_id", check("tokens", "item_tokens", "shifts").alias("m")).where("m.n_item > 0")
    return checked.select(F.col("_id").alias(id_col), "text_hash", F.col("item_id").alias(item_col), "m.n_matched", "m.n_item", "m.similarity")


def _bitmap(seed_rows: DataFrame, bits: int) -> np.ndarray:
    """Bit h mod 2 ** bits is set for each seed h; at most 2 ** (bits - 6) words reach the driver."""
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = seed_rows.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_pandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that overlap no benchmark item, with their columns as they came. A filter without a shuffle where the benchmark is small."""
    if similarity < SIMILARITY:
        raise ValueError(f"overlaps below {SIMILARITY} may share no seed")
    items = cut(_index(_items(benchmark, item_col, item_text_col)), "items")
    if small := _small(items, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(small[0])

        @F.pandas_udf("boolean")
        def passes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for n, found in _judge(shared, texts):
                yield pd.Series([d not in found for d in range(n)], dtype=bool)

        return docs.where(passes(F.col(text_col)))
    found = _joined(docs, items, similarity, id_col, text_col, item_col).select(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).alias("leak")).distinct()
    # The whole row travels as one column, so that none of its names can meet one of ours.
    rows = docs.select(F.struct("*").alias("row"))
    met = F.col(f"row.`{id_col}`").eqNullSafe(F.col("leak.id")) & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("leak.hash"))
    return rows.join(found, met, "left_anti").select("row.*")
