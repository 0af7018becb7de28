"""Toxicity by a classifier chain.

Each category has a linear model on the distinct words of a text (hashed, whole and as prefixes of 4, 5 and 6 letters) and on
a few shares of kinds of characters. The models stand in a chain: each one also sees the probabilities of the categories
before it. In training those are out-of-fold predictions (``FOLDS`` folds by a hash of the row), so that later models learn
from probabilities as good as those they will see.

The labelled rows used are at most ``LABELLED_UP_TO``, those with the smallest hash of their id (equal ids by their words). Fitting is
follow-the-regularised-leader with an L1 penalty that leaves few weights, which are all that is broadcast.

Results: null and wordless texts get the probability of a text without words; labels that are null are not learned from; a
category of which only one class is labelled is predicted as that class's share; repeated rows count each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
BITS = 20
LABELLED_UP_TO = 8_000
FOLDS = 5
ROUNDS = 4
#: The L1 penalty is for one row: it grows with the square root of the rows, as the sums of gradients of a useless word do.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.056, 0.1
REMEMBER = 300_000
_ASCII = np.zeros(256, np.int64)
_ASCII[65:91], _ASCII[48:58] = 1, 2
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _ASCII[_c] = 3


def word_features(word: str) -> tuple[int, ...]:
    shown = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
    return tuple(xxhash.xxh64_intdigest(s) & ((1 << BITS) - 1) for s in shown)


def surface(text: str, words: int, distinct: int) -> np.ndarray:
    """Shares in 0..1: capitals, digits, marks, distinct words, and the length."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_ASCII[raw], minlength=4) if len(raw) else np.zeros(4)
    n = max(1, len(raw))
    return np.asarray([kinds[1] / n, kinds[2] / n, kinds[3] / n, distinct / max(1, words), np.log1p(len(raw)) / 20.0])


N_SURFACE = 5


@dataclass
class Link:
    """One category: sparse word weights, dense weights (surface, earlier probabilities), bias."""

    name: str
    words: dict[int, float]
    dense: np.ndarray
    bias: float


@dataclass
class Chain:
    links: list[Link]
    known: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def _word(self, word: str) -> tuple[float, ...]:
        at = word_features(word)
        found = tuple(sum(link.words.get(i, 0.0) for i in at) for link in self.links)
        if len(self.known) >= REMEMBER:
            self.known.clear()
        self.known[word] = found
        return found

    def predict(self, text: str | None) -> list[float]:
        text = text or ""
        words = WORD.findall(text.lower())
        distinct = set(words)
        get = self.known.get
        total = np.zeros(len(self.links))
        heavy = [w for word in distinct if any(w := get(word) or self._word(word))]
        if heavy:
            total += np.sum(heavy, axis=0)
        dense, out = surface(text, len(words), len(distinct)), []
        for link, s in zip(self.links, total):
            z = s + link.bias + float(np.concatenate([dense, out]) @ link.dense)
            out.append(float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))))
        return out


def _fit_link(name: str, rows: list[np.ndarray], size: int, dense: np.ndarray, y: np.ndarray, seed: int) -> Link:
    """Logistic regression by the proximal update; features are ``size`` word columns (value 1 for each distinct word), then dense ones, then the bias."""
    width = dense.shape[1]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return Link(name, {}, np.zeros(width), float(np.log(share / (1 - share))))
    z, n = np.zeros(size + width + 1), np.zeros(size + width + 1)
    tail = np.arange(size, size + width + 1)
    penalty = np.full(size + width + 1, L1 * np.sqrt(len(y)))
    penalty[tail] = 0.0

    def solve(at: np.ndarray) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= penalty[at], 0.0, -(za - np.sign(za) * penalty[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        for i in rng.permutation(len(y)):
            at = np.concatenate([rows[i], tail])
            x = np.concatenate([np.ones(len(rows[i])), dense[i], [1.0]])
            w = solve(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40))) - y[i]) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z[:size]) > penalty[:size])  # all other weights are zero, and are not spelled out
    w = solve(tail)
    return Link(name, dict(zip(at.tolist(), solve(at).tolist())), w[:width], float(w[-1]))


def _scores(link: Link, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    get = link.words.get
    z = np.asarray([sum(get(i, 0.0) for i in r.tolist()) for r in rows]) + dense @ link.dense + link.bias
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _packed(at: np.ndarray) -> bytes:
    """Ascending bucket numbers, as they are sent to the driver: their steps, compressed, take little more than half the room."""
    return zlib.compress(np.diff(at, prepend=np.int32(0)).tobytes())


def _unpacked(at: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(at.as_buffer()), np.int32), dtype=np.int32)


def fit(labelled: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", up_to: int = LABELLED_UP_TO) -> Chain:
    """Fit a chain over 0/1 label columns, in their order."""
    known = labelled.select(F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"), *(F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)))
    for i in range(len(categories)):
        known = known.where(F.col(f"y{i}").isNotNull())
    # Which rows are in the sample is settled on hashes alone, so that no text is shuffled for it.
    last = known.select("h").orderBy("h").limit(up_to).agg(F.max("h")).first()[0]
    picked = known.where(F.col("h") <= F.lit(last).cast("long"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, dense = [], []
            for text in batch["text"]:
                words = WORD.findall((text or "").lower())
                distinct = set(words)
                at.append(_packed(np.unique(np.fromiter((i for w in distinct for i in word_features(w)), np.int32))))
                dense.append(surface(text or "", len(words), len(distinct)).tobytes())
            yield batch.drop(columns="text").assign(at=at, dense=dense)

    sample = picked.mapInPandas(features, ", ".join(["h bigint", *(f"y{i} double" for i in range(len(categories))), "at binary", "dense binary"])).orderBy("h", "at").limit(up_to).toArrow()
    order = pc.sort_indices(sample, sort_keys=[("h", "ascending"), ("at", "ascending")]).to_numpy()
    tally = np.zeros(1 << BITS, np.int32)
    for b in sample["at"]:  # one row at a time, a bucket once a row
        tally[_unpacked(b)] += 1
    # Rarer buckets could not pass the penalty; those that are left are numbered, in their order.
    buckets = np.flatnonzero(tally >= 3)
    place = np.zeros(1 << BITS, np.int32)
    place[buckets] = np.arange(len(buckets))
    rows = [place[r[tally[r] >= 3]] for r in (_unpacked(sample["at"][i]) for i in order.tolist())]
    dense = np.asarray([np.frombuffer(b.as_py()) for b in sample["dense"]]).reshape(-1, N_SURFACE)[order]
    folds = (sample["h"].to_numpy()[order].view(np.uint64) % np.uint64(FOLDS)).astype(int)
    labels = [sample[f"y{i}"].to_numpy()[order] for i in range(len(categories))]
    del sample
    links = []
    for i, name in enumerate(categories):
        y = labels[i]
        link = _fit_link(name, rows, len(buckets), dense, y, seed=i)
        links.append(replace(link, words={int(buckets[k]): w for k, w in link.words.items()}))
        if i + 1 < len(categories):
            ahead = np.zeros(len(y))
            for k in range(FOLDS):
                inside, outside = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
                part = _fit_link(name, [rows[j] for j in inside], len(buckets), dense[inside], y[inside], seed=100 * i + k)
                ahead[outside] = _scores(part, [rows[j] for j in outside], dense[outside])
            dense = np.column_stack([dense, ahead])
    return Chain(links)


def predict(docs: DataFrame, chain: Chain, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and p_<category> of every row. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{link.name}" for link in chain.links]

    def make():
        model = Chain(shared.value.links)
        return lambda texts: dict(zip(names, np.asarray([model.predict(t) for t in texts], float).reshape(-1, len(names)).T))

    return computed(docs, text_col, keep, dict.fromkeys(names, "double"), make)


def without(docs: DataFrame, chain: Chain, category: str, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows whose probability of a category is below a threshold, with their columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = [link.name for link in chain.links].index(category)

    @F.pandas_udf("boolean")
    def passes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Chain(shared.value.links)
        for batch in texts:
            yield pd.Series([model.predict(t)[at] < threshold for t in batch], dtype=bool)

    return docs.where(passes(F.col(text_col)))
