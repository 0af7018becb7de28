"""N-gram language model in Elias-Fano tries, fitted and queried shard by shard.

The model is a trigram mixture whose parts weigh as much as their evidence:

    p(w | u v) = (p(w) + b(v) c(v w) + g(v) c(u v w)) / (1 + b(v) c(v) + g(v) c(u v))

with p(w) = (c(w) - D) / N for known words and D V / N for an unknown one (absolute discounting, D from the numbers of words met
once and twice). With prior sizes A(v) = PRIOR * k(v) ** GROWTH and ``PRIOR_3`` it is b = 1 / A and g = (k + A) / (A * PRIOR_3), where k(v) is the
count of v to the nearest power of two, from a table of 2 ** ``CELLS`` cells that all words share: any k(v) gives probabilities that add up to one. In
logarithms numerator and denominator part: the former sits on the longest node w, v w or u v w, the latter on the longest
node of the context, v or u v. Both are met on the way from a word back through the two before it, so a text's score is a sum of
independent look-ups, one path for each token.

Tries are suffix tries of three levels: words, the words before them, and those before these. A shard holds the words of one
range of hashes; words too frequent for that (``HEAVY`` of them at most) are dealt over all shards by the word before. Each level is a row of bytes:
node keys, child pointers and cumulative counts as monotone Elias-Fano sequences, probabilities as 16-bit steps of one grid. A
look-up goes from level to level: the pointers of its node bound the range of its children, and the successor of the next
word is searched for inside of that range only, by keys relative to it. Tasks map a level into memory (an anonymous map, no
file) and decode only the blocks that such ranges touch.

Counting and querying shuffle packed arrays (one blob for each batch of texts and shard), pre-aggregated in the batch: a path
that a text holds often is sent once. Answers come back as one packed row for each blob. A model can be kept (``fit`` writes
the tries into the shared folder, ``score`` uses them) or built where it is asked (``score_corpus``), which shuffles every path once.
Words are 64-bit hashes, the words before them 40 bits.

Results: null and empty texts are one end token; repeated rows are learned from and scored each; without training texts
every word is unknown (N = V = 0) and has probability 1. Extra columns are ignored. Ids travel as text and come back as they
were, so a null changes no other id.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, crc_fold, cut, mix64

PRIOR, GROWTH, PRIOR_3 = 10.0, 0.7, 8.0
#: Tokens gathered before a batch is packed, training tokens in a shard, and the fewest shards.
BATCH_TOKENS = 1_000_000
SHARD_TOKENS = 1_000_000
LEAST_SHARDS = 16
#: Most words that are dealt over all shards.
HEAVY = 1 << 16
CELLS = 20
#: Paths that a task looks up together.
ANSWER_PATHS = 1_400_000
#: Bytes of packed paths that one task of ``score`` answers.
ASKED_BYTES = 256_000_000
#: Quantised values are multiples of STEP (log10) in 16 bits.
STEP = 1.0 / 1536
END, BEGIN = np.uint64(1), np.uint64(2)
_V_BITS = 40
_V_MASK = np.uint64((1 << _V_BITS) - 1)
_CELL = np.uint64((1 << CELLS) - 1)
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
REMEMBER = 250_000


def before(word: np.ndarray) -> np.ndarray:
    """The 40 bits under which a word stands as context."""
    return mix64(word) & _V_MASK


class WordHash(dict):
    """Word to 64-bit hash, remembered; 0 to 2 are kept for marks."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = max(3, xxhash.xxh64_intdigest(word, 1))
        return found

    def tokens(self, text: str | None) -> np.ndarray:
        if len(self) > REMEMBER:
            self.clear()
        words = ascii_lower_words(text)
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


# ---- packing -------------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their bytes of equal weight together, compressed."""
    head, body = [], []
    for a in arrays:
        head += [len(a), a.dtype.itemsize]
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    return zstandard.compress(np.asarray([len(arrays), *head], np.int64).tobytes() + b"".join(body), 1)


_KIND = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(-1, 2)
    at, out = 8 + 16 * count, []
    for n, width in head.tolist():
        part = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(_KIND[width]))
        at += n * width
    return out


def _least(a: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _v40(v: np.ndarray) -> list[np.ndarray]:
    return [(v & np.uint64(0xFFFFFFFF)).astype(np.uint32), (v >> np.uint64(32)).astype(np.uint8)]


def _from_v40(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


# ---- Elias-Fano ----------------------------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence: low bits packed at fixed width, high parts in unary. Read from (mapped) words without unpacking it all."""

    RATE = 64  # every so many ones, the place of a one is kept
    BLOCK = 1 << 15  # values decoded together in searches

    def __init__(self, words: np.ndarray, n: int, low: int, n_low: int, n_high: int, first: int):
        self.n, self.low, self.first = n, low, np.uint64(first)
        self.lows, self.highs = words[:n_low], words[n_low : n_low + n_high]
        self.places = words[n_low + n_high :]

    @staticmethod
    def build(values: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(words, parameters) of non-decreasing unsigned integers."""
        n = len(values)
        if not n:
            return np.zeros(0, np.uint64), [0, 0, 0, 0, 0]
        first = int(values[0])
        x = values - values[0]
        low = max(0, int(x[-1]) // n).bit_length()
        low = min(57, max(0, low - 1))
        bit = np.arange(n, dtype=np.uint64) * np.uint64(low)
        lows = np.zeros((n * low + 63) // 64 + 1, np.uint64)
        if low:
            part = x & np.uint64((1 << low) - 1)
            at, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(lows, at, part << off)
            over = off + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(lows, at[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        ones = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros(int(ones[-1]) // 64 + 2, np.uint64)
        np.bitwise_or.at(highs, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        places = ones[:: EliasFano.RATE].astype(np.uint64)
        return np.concatenate([lows, highs, places]), [n, low, len(lows), len(highs), first]

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions: the place of the i-th one by a kept place and a scan of words, then the low bits."""
        i = np.asarray(i, np.int64)
        place = self.places[i // self.RATE].astype(np.int64)
        left = (i % self.RATE).astype(np.int64)
        word = place >> 6
        rest = self.highs[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (place & 63).astype(np.uint64))
        live = np.arange(len(i))
        ones = np.bitwise_count(rest).astype(np.int64)
        while (go := live[left[live] >= ones[live]]).size:
            left[go] -= ones[go]
            word[go] += 1
            rest[go] = self.highs[word[go]]
            ones[go] = np.bitwise_count(rest[go])
            live = go
        # The (left)-th one of a word, by halves.
        at = np.zeros(len(i), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            part = (rest >> at) & np.uint64((1 << half) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            up = left >= c
            left = np.where(up, left - c, left)
            at = np.where(up, at + np.uint64(half), at)
        high = (word * 64 + at.astype(np.int64) - i).astype(np.uint64)
        if not self.low:
            return high + self.first
        bit = i.astype(np.uint64) * np.uint64(self.low)
        w, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        part = self.lows[w] >> off
        over = off + np.uint64(self.low) > np.uint64(64)
        part[over] |= self.lows[w[over] + 1] << (np.uint64(64) - off[over])
        return ((high << np.uint64(self.low)) | (part & np.uint64((1 << self.low) - 1))) + self.first

    def decode(self, begin: int, end: int) -> np.ndarray:
        """The values at positions begin to end - 1, one after another."""
        kept = begin // self.RATE
        place = int(self.places[kept])
        last = (end - 1) // self.RATE + 1
        stop = int(self.places[last]) // 64 + 1 if last < len(self.places) else len(self.highs)
        bits = np.unpackbits(np.ascontiguousarray(self.highs[place // 64 : stop]).view(np.uint8), bitorder="little")
        bits[: place % 64] = 0
        ones = np.flatnonzero(bits)[begin - kept * self.RATE :][: end - begin] + place // 64 * 64
        i = np.arange(begin, end)
        high = (ones - i).astype(np.uint64)
        if not self.low:
            return high + self.first
        bit = i.astype(np.uint64) * np.uint64(self.low)
        w, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        part = self.lows[w] >> off
        over = np.flatnonzero(off + np.uint64(self.low) > np.uint64(64))
        part[over] |= self.lows[w[over] + 1] << (np.uint64(64) - off[over])
        return ((high << np.uint64(self.low)) | (part & np.uint64((1 << self.low) - 1))) + self.first

    def gather(self, i: np.ndarray) -> np.ndarray:
        """Values at positions; decoded one after another where most are asked for."""
        return self.decode(0, self.n)[i] if 4 * len(i) > self.n else self.access(i)

    def successor(self, begin: np.ndarray, end: np.ndarray, key: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the first position in [begin, end) whose value less ``base`` is at least the key, else end; whether it is the key).

        Only blocks that a range touches are decoded; each query then halves its own range.
        """
        low, high = begin.astype(np.int64), end.astype(np.int64)
        live = np.flatnonzero(low < high)
        same = np.zeros(len(low), bool)
        if not live.size:
            return low, same
        inside = live
        touched = np.zeros(self.n // self.BLOCK + 2, np.int64)
        np.add.at(touched, low[live] // self.BLOCK, 1)
        np.add.at(touched, (high[live] - 1) // self.BLOCK + 1, -1)
        blocks = np.flatnonzero(np.cumsum(touched)[:-1] > 0)
        values = np.concatenate([self.decode(b * self.BLOCK, min((b + 1) * self.BLOCK, self.n)) for b in blocks.tolist()])
        moved = np.zeros(len(touched), np.int64)
        moved[blocks] = (blocks - np.arange(len(blocks))) * self.BLOCK
        while live.size:
            middle = (low[live] + high[live]) >> 1
            less = values[middle - moved[middle // self.BLOCK]] - base[live] < key[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
            live = live[low[live] < high[live]]
        inside = inside[low[inside] < end[inside]]
        at = low[inside]
        same[inside] = values[at - moved[at // self.BLOCK]] - base[inside] == key[inside]
        return low, same


def _steps(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x / STEP), -32767, 32767).astype(np.int16)


@dataclass
class Totals:
    tokens: int  # N
    distinct: int  # V
    documents: int
    shards: int
    discount: float  # D
    heavy: dict[int, int]  # counts of the words dealt over all shards
    classes: np.ndarray  # for each cell of contexts, the logarithm to base two of the largest count, rounded

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """The contract's base probability."""
        return (count + 1.0) / (self.tokens + self.distinct + 1.0)

    def smoothed(self, count: np.ndarray) -> np.ndarray:
        """p(w) of known words, and of an unknown one where the count is zero."""
        if not self.tokens:
            return np.ones(np.shape(count))
        return np.where(count > 0, count - self.discount, self.discount * self.distinct) / self.tokens

    def weights(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(b, g) of the 40 bits of contexts."""
        k = 2.0 ** self.classes[(context & _CELL).astype(np.int64)]
        a = PRIOR * k**GROWTH
        return 1.0 / a, (k + a) / (a * PRIOR_3)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Positions where a row of sorted columns differs from the one before."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


class Trie:
    """A shard's levels, over one buffer of 64-bit words."""

    SEQUENCES = 6  # keys, pointers, keys, pointers, keys, counts
    HEAD = 5 * SEQUENCES + 2

    def __init__(self, words: np.ndarray):
        at, parts = self.HEAD, []
        for k in range(self.SEQUENCES):
            n, low, n_low, n_high = words[5 * k : 5 * k + 4].astype(np.int64).tolist()
            size = n_low + n_high + (n + EliasFano.RATE - 1) // EliasFano.RATE
            parts.append(EliasFano(words[at : at + size], n, low, n_low, n_high, int(words[5 * k + 4])))
            at += size
        self.keys, self.pointers, self.seconds, self.more, self.thirds, self.sums = parts
        self.cut = words[self.HEAD - 2 : self.HEAD]  # bits of context keys that do not fit beside the parent's number
        values, self.values = words[at:].view(np.int16), []
        at = 0
        for n in (self.keys.n, self.keys.n, self.seconds.n, self.seconds.n, self.thirds.n):
            self.values.append(values[at : at + n])
            at += n

    @staticmethod
    def build(w: np.ndarray, v: np.ndarray, u: np.ndarray, count: np.ndarray, totals: Totals) -> bytes:
        """Of distinct paths, sorted by w, then v, then u."""
        at2 = _starts(w, v)
        w2, v2, c2 = w[at2], v[at2], np.add.reduceat(count, at2) if len(at2) else count
        at1 = _starts(w2)
        keys, c1 = w2[at1], np.add.reduceat(c2, at1) if len(at1) else c2
        if totals.heavy:
            c1 = np.asarray([totals.heavy.get(k, c) for k, c in zip(keys.tolist(), c1.tolist())], np.int64)
        owner2, owner3 = np.repeat(np.arange(len(at1)), _lengths(at1, len(w2))), np.repeat(np.arange(len(at2)), _lengths(at2, len(w)))
        p, (b_own, g_own), (b, g) = totals.smoothed(c1), totals.weights(before(keys)), totals.weights(v2)
        second = p[owner2] + b * c2
        numbers = [
            np.log10(p), np.log10(1.0 + b_own * c1), np.log10(second),
            np.log10(1.0 + (b_own * c1)[owner2] + g_own[owner2] * c2), np.log10(second[owner3] + g[owner3] * count),
        ]
        shifts = [max(0, len(at1).bit_length() + _V_BITS - 64), max(0, len(at2).bit_length() + _V_BITS - 64)]
        under = lambda owner, key, shift: (owner.astype(np.uint64) << np.uint64(_V_BITS - shift)) + (key >> np.uint64(shift))
        levels = [EliasFano.build(np.asarray(x, np.uint64)) for x in (
            keys, np.append(at1, len(w2)), under(owner2, v2, shifts[0]), np.append(at2, len(w)), under(owner3, u, shifts[1]), np.concatenate([[0], np.cumsum(c1)]))]
        values = np.concatenate([_steps(x) for x in numbers])
        values = np.concatenate([values, np.zeros(-len(values) % 4, np.int16)])
        head = np.asarray([x for _, parameters in levels for x in parameters] + shifts, np.uint64)
        return np.concatenate([head, *(words for words, _ in levels), values.view(np.uint64)]).tobytes()

    def look(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, known) of words."""
        zero = np.zeros(len(w), np.int64)
        at, known = self.keys.successor(zero, zero + self.keys.n, w, zero.astype(np.uint64))
        return np.where(known, at, 0), known

    def look_below(self, level: int, node: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, known) of context words among the children of nodes of a level (1 or 2)."""
        pointers, children, shift = (self.pointers, self.seconds, self.cut[0]) if level == 1 else (self.more, self.thirds, self.cut[1])
        if not len(node):
            return node, np.zeros(0, bool)
        begin, end = pointers.gather(node).astype(np.int64), pointers.gather(node + 1).astype(np.int64)
        at, known = children.successor(begin, end, context >> shift, node.astype(np.uint64) << (np.uint64(_V_BITS) - shift))
        return np.where(known, at, 0), known

    def counts(self, node: np.ndarray) -> np.ndarray:
        return (self.sums.gather(node + 1) - self.sums.gather(node)).astype(np.int64) if len(node) else np.zeros(0, np.int64)


# ---- counting ------------------------------------------------------------------------------------------------------


def _batches(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """(rows of the named columns, tokens of each) in batches of about BATCH_TOKENS tokens; few texts at a time leave Arrow."""
    known, rows, tokens, size = WordHash(), [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for *row, text in zip(*(part.column(c).to_pylist() for c in (*columns, "text"))):
                rows.append(row)
                tokens.append(known.tokens(text))
                size += len(tokens[-1])
                if size >= BATCH_TOKENS:
                    yield rows, tokens
                    rows, tokens, size = [], [], 0
    if rows:
        yield rows, tokens


def _totals(texts: DataFrame) -> Totals:
    """Counts of all training texts. To the driver come one row of sums, at most ``HEAVY`` words and one number for each of 2 ** ``CELLS`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens in _batches(batches, []):
            w, n = np.unique(np.concatenate(tokens), return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": w.view(np.int64), "cell": (before(w) & _CELL).astype(np.int32), "n": n.astype(np.int32)})

    words = cut(texts.mapInArrow(run, "word bigint, cell int, n int").groupBy("word", "cell").agg(F.sum("n").alias("n")), "words")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n, v, ends, once, twice = words.agg(total("n"), F.count(F.lit(1)), total(F.when(F.col("word") == int(END), F.col("n"))), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    shards = max(LEAST_SHARDS, -(-n // SHARD_TOKENS))
    frequent = words.where(F.col("n") * min(8 * shards, HEAVY) > n).select("word", "n").toArrow().to_pandas()
    cells = words.groupBy("cell").agg(F.round(F.log2(F.max("n"))).cast("tinyint").alias("k")).toArrow()
    classes = np.zeros(1 << CELLS, np.uint8)
    classes[cells["cell"].to_numpy()] = cells["k"].to_numpy()
    begin = int(before(np.asarray([BEGIN]))[0] & _CELL)
    classes[begin] = max(int(classes[begin]), round(np.log2(max(1, ends))))
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    return Totals(n, v, ends, shards, discount, dict(zip(frequent["word"].to_numpy(np.int64).view(np.uint64).tolist(), frequent["n"].tolist())), classes)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the number of each value among them, of which a task holds fewer than 2 ** 31."""
    values, number = np.unique(x, return_inverse=True)
    return values, number.astype(np.int32)


# ---- paths of texts, packed for shards -----------------------------------------------------------------------------


def _paths(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, number of the word, of the one before plus one, of the one before that plus one) at every position of texts laid end to end; 0 is their begin."""
    words, w = _numbered(np.concatenate(tokens))
    first = np.cumsum([0, *map(len, tokens[:-1])])
    v = np.empty_like(w)
    v[1:] = w[:-1] + 1
    v[first] = 0
    u = np.empty_like(w)
    u[1:] = v[:-1]
    u[first] = 0
    return words, w, v, u


def _shard_of(w: np.ndarray, v: np.ndarray, totals: Totals, heavy: np.ndarray) -> np.ndarray:
    """The shard of words after contexts; ``heavy`` holds the sorted words that are dealt by context."""
    shard = ((w >> _HALF) * np.uint64(totals.shards) >> _HALF).astype(np.int64)
    if len(heavy):
        dealt = heavy[np.minimum(np.searchsorted(heavy, w), len(heavy) - 1)] == w
        shard[dealt] = (v[dealt] % np.uint64(totals.shards)).astype(np.int64)
    return shard


def _ask(docs: DataFrame, shared) -> DataFrame:
    """(shard, batch, blob, ids): what every batch of (id, learn, text) asks of a shard.

    A blob has the paths of the batch that fall to the shard: words with the number of their paths, the contexts that
    occur, the two contexts of each path, and the texts that hold it, how often, and whether they are learned from. Where the
    end token of a text falls to the shard goes, once, the text's id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, totals = TaskContext.get().partitionId(), shared.value
        heavy = np.sort(np.fromiter(totals.heavy, np.uint64, len(totals.heavy)))
        for serial, (rows, tokens) in enumerate(_batches(batches, ["id", "learn"])):
            learn = np.asarray([bool(r[1]) for r in rows])
            words, w, v, u = _paths(tokens)
            contexts = np.concatenate([before(np.asarray([BEGIN])), before(words)])
            text = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])
            bits = np.uint64(len(contexts).bit_length())
            pair = (w.astype(np.uint64) << bits) | v.astype(np.uint64)
            if 3 * int(bits) > 64:
                pair = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
            path = (pair << bits) | u.astype(np.uint64)
            del pair
            order = np.argsort(path, kind="stable")
            path, text = path[order], text[order]
            entry = _starts(path, text)
            of_path = _starts(path[entry])  # in entries
            at = order[entry[of_path]]
            texts, times, held = text[entry], _lengths(entry, len(path)), _lengths(of_path, len(entry))
            w, v, u = w[at], v[at], u[at]
            shard = _shard_of(words[w], contexts[v], totals, heavy)
            shard = _least(shard)
            sorted_paths, sorted_entries = np.argsort(shard, kind="stable"), np.argsort(np.repeat(shard, held), kind="stable")
            w, v, u, held, shard, texts, times = (*(x[sorted_paths] for x in (w, v, u, held, shard)), texts[sorted_entries], times[sorted_entries])
            ends = np.concatenate([[0], np.cumsum(held)])
            starts, out = _starts(shard), []
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(w)).tolist()):
                heads = _starts(w[a:b])
                used, place = _dense(np.concatenate([v[a:b], u[a:b]]))
                i, j = ends[a], ends[b]
                mine = texts[i:j]
                last = np.unique(mine[np.repeat(words[w[a:b]] == END, held[a:b])])
                blob = _pack(
                    words[w[a:b][heads]], _least(_lengths(heads, b - a)), *_v40(contexts[used]), _least(place[: b - a]), _least(place[b - a :]), _least(held[a:b]),
                    _least(mine << 1 | learn[mine]), _least(times[i:j]), _least(last))
                out.append((int(shard[a]), (task << 32) | serial, blob, [rows[k][0] for k in last]))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["shard", "batch", "blob", "ids"])

    return docs.mapInArrow(run, "shard int, batch bigint, blob binary, ids array<string>")


class Asked:
    """The distinct words, pairs and paths of some blobs of one shard, and what each blob says of them."""

    def __init__(self, blobs: list[bytes]):
        got = [_unpack(b) for b in blobs]
        self.words, word_of = _numbered(np.concatenate([g[0] for g in got]))
        self.contexts, context_of = _numbered(np.concatenate([_from_v40(g[2], g[3]) for g in got]))
        sizes = [len(g[4]) for g in got]
        offset = np.repeat(np.cumsum([0, *(len(g[2]) for g in got[:-1])]).astype(np.int32), sizes)
        joined = lambda k: np.concatenate([g[k] for g in got]).astype(np.int32)
        pairs, pair_of = _numbered((np.repeat(word_of, joined(1)).astype(np.uint64) << _HALF) | context_of[joined(4) + offset].astype(np.uint64))
        self.pair_word, self.pair_context = (pairs >> _HALF).astype(np.int32), (pairs & _LOW).astype(np.int32)
        paths, self.path_of = _numbered((pair_of.astype(np.uint64) << _HALF) | context_of[joined(5) + offset].astype(np.uint64))
        self.path_pair, self.path_context = (paths >> _HALF).astype(np.int32), (paths & _LOW).astype(np.int32)
        self.blobs, self.begin = got, np.cumsum([0, *sizes])

    def learned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(w, v, u, count) of the distinct paths that texts to learn from hold, sorted."""
        every = []
        for g in self.blobs:
            n = np.where(g[7] & 1, g[8], 0).astype(np.int64)
            every.append(np.add.reduceat(n, np.cumsum(g[6].astype(np.int64)) - g[6]))
        count = np.bincount(self.path_of, np.concatenate(every), len(self.path_pair)).astype(np.int64)
        some = np.flatnonzero(count)
        pair = self.path_pair[some]
        return self.words[self.pair_word[pair]], self.contexts[self.pair_context[pair]], self.contexts[self.path_context[some]], count[some]

    def answers(self, trie: Trie | None, totals: Totals) -> list[bytes]:
        """For each blob the sums of its texts."""
        count, first, back = (np.zeros(len(self.words), kind) for kind in (np.int64, np.int32, np.int32))
        first[:] = _steps(np.log10(totals.smoothed(np.zeros(1))))[0]
        second, second_back, third = (np.zeros(n, np.int32) for n in (len(self.pair_word), len(self.pair_word), len(self.path_pair)))
        met2, met3 = np.zeros(len(second), bool), np.zeros(len(third), bool)
        if trie is not None:
            node, known = trie.look(self.words)
            at = node[known]
            count[known], first[known], back[known] = trie.counts(at), trie.values[0][at], trie.values[1][at]
            asked = np.flatnonzero(known[self.pair_word])
            at, seen = trie.look_below(1, node[self.pair_word[asked]], self.contexts[self.pair_context[asked]])
            node2 = np.zeros(len(second), np.int64)
            met2[asked], node2[asked] = seen, at
            second[met2], second_back[met2] = trie.values[2][node2[met2]], trie.values[3][node2[met2]]
            asked = np.flatnonzero(met2[self.path_pair])
            at, seen = trie.look_below(2, node2[self.path_pair[asked]], self.contexts[self.path_context[asked]])
            met3[asked] = seen
            third[asked[seen]] = trie.values[4][at[seen]]
        # A heavy word may be new in this shard though not in the model.
        heavy = np.fromiter(totals.heavy, np.uint64, len(totals.heavy))
        new = np.flatnonzero((count == 0) & np.isin(self.words, heavy))
        if new.size:
            c = np.asarray([totals.heavy[k] for k in self.words[new].tolist()], np.int64)
            b = totals.weights(before(self.words[new]))[0]
            count[new], first[new], back[new] = c, _steps(np.log10(totals.smoothed(c))), _steps(np.log10(1.0 + b * c))
        ends = self.words == END
        pair = np.where(met2, second, first[self.pair_word]) - np.where(ends[self.pair_word], 0, np.where(met2, second_back, back[self.pair_word]))
        value = np.where(met3, third - second[self.path_pair], 0) + pair[self.path_pair]
        word = self.pair_word[self.path_pair]
        known, base = (count > 0)[word], np.log10(totals.unigram(count))[word]
        out = []
        for k, g in enumerate(self.blobs):
            path = np.repeat(self.path_of[self.begin[k] : self.begin[k + 1]], g[6].astype(np.int64))
            here, text = _dense((g[7] >> 1).astype(np.int64))
            times = g[8].astype(np.int64)
            total = lambda x: np.bincount(text, x, len(here))
            whole = lambda x: np.rint(total(x)).astype(np.int64)
            out.append(_pack(g[9], _least(here), _least(whole(times)), _least(whole(known[path] * times)), whole(value[path] * times).view(np.uint64), total(base[path] * times).view(np.uint64)))
        return out


def _dense(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of small numbers, and each one's place among them."""
    there = np.bincount(text) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[text]


def _portions(blobs: pd.Series) -> list[list[bytes]]:
    """Blobs in portions of about ANSWER_PATHS paths."""
    out, size = [[]], 0
    for blob in blobs:
        raw = zstandard.get_frame_parameters(blob).content_size
        if size and size + raw > 14 * ANSWER_PATHS:
            out, size = [*out, []], 0
        out[-1].append(blob)
        size += raw
    return out


def _built(portions: list[list[bytes]], totals: Totals) -> tuple[bytes, Asked | None]:
    """The trie of what blobs let learn, and what they ask if they are one portion."""
    got = []
    for some in portions:
        asked = Asked(some)
        got.append(asked.learned())
    w, v, u, n = got[0] if len(got) == 1 else (np.concatenate([g[k] for g in got]) for k in range(4))
    if len(got) > 1:
        asked = None
        order = np.lexsort((u, v, w))
        w, v, u, n = w[order], v[order], u[order], n[order]
        at = _starts(w, v, u)
        w, v, u, n = w[at], v[at], u[at], np.add.reduceat(n, at) if len(at) else n
    return Trie.build(w, v, u, n, totals), asked


def _answered(portions: list[list[bytes]], asked: Asked | None, trie: Trie | None, totals: Totals) -> list[bytes]:
    return [x for some in portions for x in (asked or Asked(some)).answers(trie, totals)]


def _mapped(trie: bytes) -> Trie:
    """A trie over an anonymous memory map."""
    memory = mmap.mmap(-1, len(trie))
    memory.write(trie)
    return Trie(np.frombuffer(memory, np.uint64))


_ANSWER = "batch bigint, blob binary, ids array<string>"


def _rows(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))


def _add_up(parts: DataFrame, totals: Totals, id_col: str, id_kind: str) -> DataFrame:
    """Sums over the shards for each text of a batch."""
    b, g = (float(x[0]) for x in totals.weights(before(np.asarray([BEGIN]))))
    begin = -float(np.log10(1.0 + (b + g) * totals.documents))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(b) for b in part["blob"]]
        ends = np.concatenate([g[0].astype(np.int64) for g in got])
        n = int(ends.max()) + 1
        tokens, known, steps, base = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for _, here, t, k, s, b in got:
            here = here.astype(np.int64)
            tokens[here] += t.astype(np.int64)
            known[here] += k.astype(np.int64)
            steps[here] += s.view(np.int64)
            base[here] += b.view(np.float64)
        ids = pd.Series([x for some in part["ids"] for x in some], dtype=object)
        return pd.DataFrame({"id": ids, "n_tokens": tokens[ends], "n_known": known[ends], "base_score": base[ends], "score": steps[ends] * STEP + begin})

    summed = parts.groupBy("batch").applyInPandas(run, "id string, n_tokens bigint, n_known bigint, base_score double, score double")
    return summed.select(F.col("id").cast(id_kind).alias(id_col), "n_tokens", "n_known", "base_score", "score")


# ---- fitting and scoring -------------------------------------------------------------------------------------------


def fit(training: DataFrame, text_col: str = "text") -> tuple[DataFrame, Totals]:
    """A model to keep: (table of shard and trie in the shared folder, totals), from all rows of ``training``."""
    rows = training.select(F.lit(None).cast("string").alias("id"), F.lit(True).alias("learn"), F.col(text_col).alias("text"))
    totals = _totals(rows.select("text"))
    shared = training.sparkSession.sparkContext.broadcast(totals)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "trie": [_built(_portions(part["blob"]), shared.value)[0]]})

    return cut(_ask(rows, shared).groupBy("shard").applyInPandas(build, "shard int, trie binary"), "tries"), totals


def score(docs: DataFrame, tries: DataFrame, totals: Totals, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row of ``docs`` by a kept model.

    What is asked of a shard is dealt into parts of about ``ASKED_BYTES``, each with a copy of the shard's trie.
    """
    shared = docs.sparkSession.sparkContext.broadcast(totals)
    asked = cut(_ask(_rows(docs, F.lit(False), id_col, text_col), shared), "asked")
    parts = asked.groupBy("shard").agg(F.ceil(F.sum(F.length("blob")) / ASKED_BYTES).cast("int").alias("parts"))
    dealt = asked.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("batch"), F.col("parts")).cast("int")).drop("parts")
    copies = tries.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "trie")

    def run(model: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame({"batch": pd.Series(dtype="int64"), "blob": pd.Series(dtype=object), "ids": pd.Series(dtype=object)})
        trie = _mapped(model["trie"].iloc[0]) if len(model) else None
        return pd.DataFrame({"batch": some["batch"], "blob": _answered(_portions(some["blob"]), None, trie, shared.value), "ids": some["ids"]})

    by = ("shard", "part")
    answers = copies.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(run, _ANSWER)
    return _add_up(answers, totals, id_col, docs.schema[id_col].dataType.simpleString())


def held_out(column: Column) -> Column:
    """crc32 of an id as text, modulo 7, is 2."""
    return crc_fold(column, 7) == 2


def score_corpus(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Totals]:
    """Learn from the rows that ``learn`` holds for and score all of ``docs``, with one shuffle of their paths.

    What a batch asks of a shard also says what can be learned from it, so each shard builds its trie from the blobs that it
    is about to answer, and no trie is moved or kept. Scores are those of ``fit`` and ``score``.
    """
    rows = _rows(docs, learn, id_col, text_col)
    totals = _totals(rows.where("learn").select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(totals)

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        portions = _portions(asked["blob"])
        trie, whole = _built(portions, shared.value)
        return pd.DataFrame({"batch": asked["batch"], "blob": _answered(portions, whole, _mapped(trie), shared.value), "ids": asked["ids"]})

    return _add_up(_ask(rows, shared).groupBy("shard").applyInPandas(run, _ANSWER), totals, id_col, docs.schema[id_col].dataType.simpleString()), totals
