"""Byte-pair encoding and decoding with a contiguous rank array per word.

A word is cut into one part per byte. One list holds the parts, another the rank of each adjacent pair; the
smallest rank is searched again and again, its boundary deleted and the two neighbouring ranks refreshed. Words
longer than ``LONG`` bytes take the same merges from a heap, so that one endless word costs n log n.

Results: nulls and empty texts have no tokens; repeated rows are encoded each; every other column is kept out of the
result unless named in ``keep``. Ids and kept columns never leave Spark.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed

LONG = 192
#: How GPT-2 style byte-level vocabularies split text before merging (fixed pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by each Python worker; the memory starts anew when full.
REMEMBER = 200_000
NO_RANK = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """The parts of a tokenizers JSON file that encoding needs; at most a vocabulary, so small enough to broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_alphabet()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    raw = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in special}
    return {
        "merges": {(vocab[a] << 32) | vocab[b]: (rank << 32) | vocab[a + b] for rank, (a, b) in reversed([*enumerate(pairs)])},
        "bytes": [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])],
        "raw": raw | {i: t.encode() for t, i in special.items()},
        "special": special,
    }


class Codec:
    """Encodes and decodes texts with a loaded vocabulary."""

    def __init__(self, vocabulary: dict):
        self.merges, self.first, self.raw, self.special = (vocabulary[k] for k in ("merges", "bytes", "raw", "special"))
        self.split = regex.compile(PATTERN).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Rank array: parts[i] and the rank of (parts[i], parts[i+1]) side by side. A rank carries the merged id in its low bits."""
        get = self.merges.get
        ranks = [get((a << 32) | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = best & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i] << 32) | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = get((parts[i - 1] << 32) | parts[i], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, leftmost smallest rank first, from a heap over a linked list."""
        get, n = self.merges.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i] << 32) | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = r & 0xFFFFFFFF, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (q := get((parts[left] << 32) | parts[after[left]])) is not None:
                    heapq.heappush(heap, (q, left, parts[left], parts[after[left]]))
        return [p for p, ok in zip(parts, alive) if ok]

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.first[b] for b in raw]
        ids = np.asarray(self.merge(parts) if len(parts) <= LONG else self.merge_long(parts), "<u4").tobytes()
        if len(self.known) >= REMEMBER:
            self.known.clear()
        if len(parts) <= LONG:
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known, out = self.known.get, []
        for piece in self.apart.split(text) if self.apart and "<" in text else (text,):
            if piece in self.special:
                out.append(np.asarray([self.special[piece]], "<u4").tobytes())
            else:
                out += [known(w) or self.word(w) for w in self.split(piece)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text of ids, special tokens included."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").encode()


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, then (``with_ids``) token_ids, then ``keep``.

    Narrow: no shuffle, and memory is one Arrow batch plus the remembered words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    kept = tuple(c for c in keep if c != id_col)

    def make():
        codec = Codec(shared.value)

        def work(texts: list) -> dict:
            ids = [codec.encode(t) for t in texts]
            return {
                "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
                "token_ids": [np.frombuffer(x, "<u4").astype(np.int64) for x in ids] if with_ids else None,
            }

        return work

    fields = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"token_ids": "array<bigint>"} if with_ids else {})
    made = computed(docs, text_col, (id_col, *kept), fields, make)
    # Kept columns go behind the fields, by place, as they may be named like them.
    order = [0, *range(len(kept) + 1, len(made.columns)), *range(1, len(kept) + 1)]
    plain = made.toDF(*(f"_{i}" for i in range(len(made.columns))))
    return plain.select(*(F.col(f"_{i}").alias(made.columns[i]) for i in order))
