"""Spelling variants of words: the full neighbourhood of every word, joined with the vocabulary.

Of each word all distinct strings at one deletion, replacement or insertion over the observed alphabet are made; those that are
words are its near words, without any distance being measured. Strings are made as 64-bit keys first: a key is a polynomial in the
code points, so that of a neighbour comes from the keys of what stands before and behind the edit, for many words and all edits at
once. A bitmap of the vocabulary's keys, ``2 ** FILTER`` bits however large the vocabulary, takes out nearly all that are no words; only what it
lets pass is spelled out and sent to the join, which decides. A fuller bitmap lets more pass and changes no result. A word's
neighbours are made a bounded number at a time, so long words cost time but no memory.

A word's form is its near word of largest count, if that is at least twice its own; so counts double along forms, which are
followed to the last by doubling the path in each round.

Tokens of documents are counted in the task that reads them (once for each document, as the edit that the id and the word decide is
one for all its occurrences), in tables of bounded size; only words and counts are shuffled.

Results: null and empty texts have no words; a null id counts as the empty text where an edit is decided. Repeated rows count each.
An empty table, or one without words, gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _ASCII_LOWER, cut

LEAST_LENGTH, LEAST_COUNT, MISSPELT = 5, 3, 97
#: Bits of the bitmap as a power of two, and bits of one of its parts.
FILTER, _PART = 27, 18
#: Words counted before a task gives them out; bytes of text cut into words at a time; neighbours made at a time.
_HELD, _SLICE, _MADE = 1 << 17, 1 << 20, 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_NO_LETTER = re.compile(rb"[^A-Za-z\x80-\xFF]")
#: Runs of letters and of U+00C0 to U+00FF, in UTF-8.
_RUN = re.compile(rb"[a-z]+(?:\xC3[\x80-\xBF][a-z]*)*|(?:\xC3[\x80-\xBF][a-z]*)+")


def _runs(text: str, size: int = _SLICE) -> Counter:
    """Lower-cased runs of a whole text and how often they occur; a long text is cut where no run is."""
    raw = text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER)
    if len(raw) <= size:
        return Counter(_RUN.findall(raw))
    found, at = Counter(), 0
    while at < len(raw):
        end = _NO_LETTER.search(raw, min(len(raw), at + size))
        stop = end.start() if end else len(raw)
        found.update(_RUN.findall(raw, at, stop))
        at = stop
    return found


def misspell(doc_id, run: bytes) -> bytes:
    """The run, or without one code point if the checksum of id and run says so."""
    h = zlib.crc32(run, zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    return _without(run, h) if h % MISSPELT == 0 else run


def _without(run: bytes, h: int) -> bytes:
    points = run.decode()
    at = h % len(points)
    return (points[:at] + points[at + 1 :]).encode()


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``LEAST_LENGTH`` code points, whatever their number of occurrences."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            words = [*held]
            for at in range(0, len(words), 8_192):
                part = words[at : at + 8_192]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([held[w] for w in part], pa.int64())], schema=schema)
            held.clear()

        crc, get = zlib.crc32, held.get
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, texts = (c.slice(at, 64).to_pylist() for c in batch.columns)
                for doc_id, text in zip(ids, texts):
                    start = crc(f"{'' if doc_id is None else doc_id}:".encode())
                    for run, n in _runs(text).items() if text else ():
                        if len(run) < LEAST_LENGTH:  # bytes, so code points too
                            continue
                        h = crc(run, start)
                        if not h % MISSPELT:
                            run = _without(run, h)
                        held[run] = get(run, 0) + n
                    if len(held) > _HELD:
                        yield from out()
        yield from out()

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n bigint")
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.char_length("word") >= LEAST_LENGTH)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)])


def _heads(codes: np.ndarray) -> np.ndarray:
    """Keys of the first 0, 1, … code points of each word (one a row, all of one length)."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * np.uint64(_BASE) + codes[:, i]
    return out


def _tails(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Keys of what follows the first 0, 1, … code points of each word."""
    length = codes.shape[1]
    out = np.zeros((len(codes), length + 1), np.uint64)
    for i in range(length - 1, -1, -1):
        out[:, i] = codes[:, i] * powers[length - 1 - i] + out[:, i + 1]
    return out


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length).astype(np.uint64)


def keys(words: list[str]) -> np.ndarray:
    """The key of each word."""
    lengths, out = np.fromiter(map(len, words), np.int64, len(words)), np.zeros(len(words), np.uint64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        out[at] = _heads(_codes([words[i] for i in at], int(length)))[:, -1]
    return out


def _bit(key: np.ndarray, second: bool, size: int) -> np.ndarray:
    """One of the two bits of a key, of 2 ** size."""
    return (key * np.uint64(0x94D049BB133111EB if second else 0xBF58476D1CE4E5B9)) >> np.uint64(64 - size)


def _lets_pass(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Positions (in the flattened array) of keys with both bits set."""
    size = len(bitmap).bit_length() + 2
    at = np.flatnonzero(_bits_set(bitmap, _bit(key, False, size)))
    return at[np.flatnonzero(_bits_set(bitmap, _bit(key.ravel()[at], True, size)))]


def _bits_set(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    bit = bit.ravel()
    return bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1


def neighbours(words: list[str], alphabet: str, bitmap: np.ndarray, at_once: int = _MADE) -> Iterator[tuple[int, str]]:
    """(index of a word, a string at one edit of it) for each distinct one that the bitmap lets pass; words of one length."""
    length, letters = len(words[0]), _codes([alphabet], len(alphabet))[0]
    powers = _powers(length + 1)
    rows = max(1, at_once // ((length + 1) * len(alphabet)))
    wide = max(1, at_once // (rows * len(alphabet)))  # positions of an edit at a time
    for first in range(0, len(words), rows):
        part = words[first : first + rows]
        codes = _codes(part, length)
        heads, tails = _heads(codes), _tails(codes, powers)
        seen: set[tuple[int, str]] = set()

        def told(found: Iterator[tuple[int, str]]) -> Iterator[tuple[int, str]]:
            for row, made in found:
                if (row, made) not in seen and made != part[row]:
                    seen.add((row, made))
                    yield first + row, made

        for start in range(0, length + 1, wide):
            at = np.arange(start, min(length + 1, start + wide))
            held = at[at < length]
            if len(held):
                gone = heads[:, held] * powers[length - 1 - held] + tails[:, held + 1]
                hits = ((int(x) // len(held), int(held[x % len(held)])) for x in _lets_pass(bitmap, gone))
                yield from told((r, part[r][:i] + part[r][i + 1 :]) for r, i in hits)
                swapped = (heads[:, held] * powers[length - held] + tails[:, held + 1])[:, :, None] + (powers[length - 1 - held][:, None] * letters)[None]
                hits = ((int(x) // (len(held) * len(letters)), int(held[x // len(letters) % len(held)]), alphabet[x % len(letters)]) for x in _lets_pass(bitmap, swapped))
                yield from told((r, part[r][:i] + c + part[r][i + 1 :]) for r, i, c in hits)
            added = (heads[:, at] * powers[length + 1 - at] + tails[:, at])[:, :, None] + (powers[length - at][:, None] * letters)[None]
            hits = ((int(x) // (len(at) * len(letters)), int(at[x // len(letters) % len(at)]), alphabet[x % len(letters)]) for x in _lets_pass(bitmap, added))
            yield from told((r, part[r][:i] + c + part[r][i:]) for r, i, c in hits)


def _bitmap(vocabulary: DataFrame, size: int) -> np.ndarray:
    """The vocabulary's keys as 2 ** size bits (16 MB for FILTER), which reach the driver in at most 2 ** (size - _PART) parts."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = keys(batch.column(0).to_pylist())
            every = np.unique(np.concatenate([_bit(key, False, size), _bit(key, True, size)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((every >> _PART).astype(np.int32)), pa.array((every & ((1 << _PART) - 1)).astype(np.int32))], names=["part", "bit"])

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << _PART, np.uint8)
        flags[group["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": group["part"].iloc[:1], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    parts = vocabulary.select("word").mapInArrow(bits, "part int, bit int").distinct().groupBy("part").applyInPandas(packed, "part int, flags binary").toArrow()
    out = np.zeros((1 << (size - _PART), 1 << (_PART - 3)), np.uint8)
    for part, flags in zip(parts["part"].to_pylist(), parts["flags"]):
        out[part] = np.frombuffer(flags.as_buffer(), np.uint8)
    return out.ravel()


def near_words(vocabulary: DataFrame, filter_bits: int = FILTER) -> DataFrame:
    """(word, n, near, near_n) of all words (word, n, a written table) at one edit, in both directions."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # at most 90: a to z and U+00C0 to U+00FF
    if not letters:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    alphabet = "".join(sorted(r["c"] for r in letters))
    shared = spark.sparkContext.broadcast(_bitmap(vocabulary, filter_bits))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string())])

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1)
            of = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(of):
                at = np.flatnonzero(of == length)
                rows, strings, size = [], [], 0
                for i, made in neighbours([words[j] for j in at], alphabet, shared.value):
                    rows.append(int(at[i]))
                    strings.append(made)
                    size += len(made)
                    if size > 1 << 20:
                        yield _batch(batch.column(0), n, rows, strings)
                        rows, strings, size = [], [], 0
                if rows:
                    yield _batch(batch.column(0), n, rows, strings)

    def _batch(words: pa.Array, n: pa.Array, rows: list[int], strings: list[str]) -> pa.RecordBatch:
        index = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([words.take(index), n.take(index), pa.array(strings, pa.string())], schema=schema)

    made = vocabulary.select("word", "n").mapInArrow(generate, "word string, n bigint, near string")
    return made.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): counts double along forms, so paths are short and have an end."""
    now = cut(forms.select("word", F.col("form").alias("root")), "paths")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "paths")
        now = longer.select("word", "root")
        if longer.where("moved").limit(1).count() == 0:
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, filter_bits: int = FILTER) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs at least ``least_count`` times."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    vocabulary = cut(counts(docs, id_col, text_col).where(F.col("n") >= least_count), "vocabulary")
    vocabulary = vocabulary.repartition(max(cores, 2 * vocabulary.rdd.getNumPartitions()), "word")
    ranked = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))
    best = near_words(vocabulary, filter_bits).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(ranked).alias("best"))
    known = vocabulary.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    taken = F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False))
    found = cut(known.select("word", F.when(taken, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n")), "forms")
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """The same in DuckDB: words are near if one without a code point is the other, or both are alike without the code point at one place."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return f"""
    WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i))),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
    per_doc AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
    coded AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM per_doc),
    hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x), 2), lambda i: (16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT)),
                lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT]))) AS h FROM coded, crc),
    tokens AS (SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM tokens WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    cuts AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
    formed AS (SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
    paths(word, met, steps) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT p.word, f.form, steps + 1 FROM paths p JOIN formed f ON f.word = p.met WHERE f.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(met, steps) AS root FROM paths GROUP BY word) USING (word)"""
