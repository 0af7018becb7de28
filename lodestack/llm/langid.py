"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes one space, and the 1- to 3-grams of the whole text are hashed into
2 ** ``BITS`` features, weighted (1 + log tf) * idf and scaled to length one. Document frequencies come from all training
documents. The classifier is fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample, at most
``PER_LANGUAGE`` documents of a language (those with the smallest hash of their id, of equal hashes one), and a temperature, fitted on a fifth of
that sample kept out of training, calibrates its probabilities.

Results: a null text, or one without a letter, is "und" with score 0; so is every text where nothing could be learned.
Repeated rows are predicted each; document frequencies count them each, the sample holds an id once. Ties between languages go to the first by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, crc_fold, mix64

BITS = 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1_500
ROUNDS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.2, 0.5
UNKNOWN = "und"
GAPS = re.compile(r"[\W\d_]+")


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, their counts) of a text; None without a letter."""
    if not text:
        return None
    letters = GAPS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, letters)):
        return None
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift, found = np.uint64(64 - BITS), []
    rolling = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        rolling = rolling[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if n in ORDERS and len(rolling):
            found.append((mix64(rolling + np.uint64(n << 58)) >> shift).astype(np.int64))
    every = np.concatenate(found)
    tally = np.bincount(every, minlength=1 << BITS)
    at = np.flatnonzero(tally)
    return at, tally[at]


def weigh(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(tf)) * idf[at]
    return x / np.sqrt((x * x).sum())


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        got = counts(text) if self.languages else None
        if got is None:
            return UNKNOWN, 0.0
        p = _softmax((weigh(*got, self.idf) @ self.weights[got[0]] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _weighed(row: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, their weights) of a row of the sample, which holds features and counts as they were collected: weights take nearly three times that room."""
    at = row[0].astype(np.int64)
    return at, weigh(at, row[1], idf)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, rounds: int, seed: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by the proximal update: z and n accumulate, and a weight is zero while its z stays within L1."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def solve(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, x = _weighed(rows[i], idf)
            at, x = np.append(at, size - 1), np.append(x, 0.3)
            w = solve(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = solve(np.arange(size))
    return w[:-1], 0.3 * w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _thresholds(known: DataFrame, per_language: int) -> DataFrame | None:
    """(lang, last): the hash up to which a language's documents are in the sample; None without languages.

    Settled on hashes alone, so that no text is shuffled for it. A language with n rows has about ``4 * per_language`` of them
    below the hash 4 * per_language / n of the way up, and only those are gathered, each hash once. Where ids repeat so often that they
    hold fewer different hashes than wanted, the range is widened and searched again.
    """
    rows = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not rows:
        return None
    share, last = {lang: min(1.0, 4.0 * per_language / n) for lang, n in rows.items()}, {}
    while share:
        reach = known.sparkSession.createDataFrame([(lang, min((1 << 63) - 1, int(f * 2.0**64) - (1 << 63))) for lang, f in share.items()], "lang string, reach bigint")
        below = known.select("lang", "h").join(F.broadcast(reach), "lang").where(F.col("h") <= F.col("reach")).select("lang", "h").distinct().toArrow().to_pandas()
        for lang, f in [*share.items()]:
            hashes = np.sort(below.loc[below["lang"] == lang, "h"].to_numpy(np.int64))
            if len(hashes) >= per_language or f >= 1.0:
                last[lang] = int(hashes[min(len(hashes), per_language) - 1])
                del share[lang]
            else:
                share[lang] = min(1.0, 16.0 * f)
    return known.sparkSession.createDataFrame([*last.items()], "lang string, last bigint")


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the text and non-null language of every row of ``training``."""
    known = training.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for got in map(counts, batch["text"]):
                if got is not None:
                    df[got[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": np.append(at, -1), "df": np.append(df[at], n)})

    # 2 ** BITS sums at most.
    sums = known.select("text").mapInPandas(tally, "feature int, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).toArrow().to_pandas()
    df, total = np.zeros(1 << BITS), 0
    for feature, n in zip(sums["feature"], sums["df"]):
        if feature < 0:
            total = n
        else:
            df[feature] = n
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    last = _thresholds(known, per_language)
    picked = known.join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last")) if last is not None else known.limit(0)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(lang, h, *c) for lang, h, c in zip(batch["lang"], batch["h"], map(counts, batch["text"])) if c is not None]
            if got:
                yield pd.DataFrame({"lang": [g[0] for g in got], "h": [g[1] for g in got], "at": [g[2].astype(np.uint16).tobytes() for g in got], "tf": [g[3].astype(np.uint32).tobytes() for g in got]})

    found = picked.select("lang", "h", "text").mapInPandas(features, "lang string, h bigint, at binary, tf binary")
    one = found.groupBy("lang", "h").agg(F.min(F.struct("at", "tf")).alias("m")).select("lang", "h", "m.at", "m.tf")
    sample = one.toArrow()
    order, langs = pc.sort_indices(sample, sort_keys=[("lang", "ascending"), ("h", "ascending")]).to_pylist(), sample["lang"].to_pylist()
    languages = sorted(set(langs))
    if not languages:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    # Views of what was collected, without a copy.
    rows = [(np.frombuffer(at.as_buffer(), np.uint16), np.frombuffer(tf.as_buffer(), np.uint32)) for at, tf in zip(sample["at"], sample["tf"])]
    rows, labels = [rows[i] for i in order], np.asarray([languages.index(langs[i]) for i in order])
    kept_out = np.arange(len(rows)) % 5 == 4
    fold = lambda mask: [r for r, m in zip(rows, mask) if m]
    w, b = _ftrl(fold(~kept_out), labels[~kept_out], len(languages), ROUNDS, 1, idf)
    logits = np.asarray([x @ w[at] + b for at, x in (_weighed(r, idf) for r in fold(kept_out))])
    temperature = _temperature(logits, labels[kept_out]) if kept_out.any() else 1.0
    return Model(languages, idf, w, b, temperature)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row. Narrow; the model (a fixed number of weights) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list) -> dict:
        got = [shared.value.predict(t) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return computed(docs, text_col, keep, {"lang_pred": "string", "score": "double"}, lambda: work)


def confident(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with a score of at least ``least``, with their columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        got = map(shared.value.predict, texts)
        return pd.Series([lang != UNKNOWN and score >= least for lang, score in got], dtype=bool)

    return docs.where(accepted(F.col(text_col)))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return crc_fold(F.col(id_col), 3) != 1
