"""BPE against the tokenizers library; sharding against its definition."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestack.llm import bpe, sharding
from lodestack.llm.queries import op4_sharding, vocabulary_path

TEXTS = [
    "", "a", "Hello world", "  two  spaces ", "tabs\tand\nlines\r\n", "naïve café déjà-vu", "日本語 текст mixed", "🙂🙂 emoji 👩‍👩‍👧",
    "it's they've I'd we'll", "<|endoftext|>", "before <|endoftext|> after", "<|endoftext", "1234567890 3.14159", "a" * 500, "ab" * 3_000, " " * 300 + "x",
    "  wide", "null\x00byte", "x́ combining", "MiXeD CaSe" * 20,
]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_vocabulary(vocabulary_path()))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(vocabulary_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_ids_and_decoded_text_equal_the_library(codec, library):
    for text in TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert got == want, text[:40]
        assert codec.decode(codec.encode(text)).decode() == library.decode(want, skip_special_tokens=False), text[:40]


def test_heap_and_rank_array_merge_alike(codec):
    rng = np.random.default_rng(3)
    for size in (1, 2, 17, 150):
        letters = bytes(rng.integers(97, 101, size).tolist())
        parts = [codec.first[b] for b in letters]
        assert codec.merge(list(parts)) == codec.merge_long(list(parts))


def test_documents_with_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "one two", "z"), (3, "one two", "z"), (None, "no id", "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(bpe.encode_documents(df, vocabulary_path()).collect(), key=str)
    assert len(got) == 5
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1][0].n_tokens == 0 and by[1][0].ids_sha256 == empty and by[2][0].decoded_sha256 == empty
    assert by[3][0] == by[3][1]
    want = np.asarray(library.encode("one two", add_special_tokens=False).ids, "<u4").tobytes()
    assert by[3][0].ids_sha256 == hashlib.sha256(want).hexdigest()
    assert by[3][0].decoded_sha256 == hashlib.sha256(b"one two").hexdigest()


def test_ids_are_returned_on_request(spark, library):
    df = spark.createDataFrame([(1, "some text here")], "doc_id bigint, text string")
    got = bpe.encode_documents(df, vocabulary_path(), with_ids=True).first()
    assert list(got.token_ids) == library.encode("some text here", add_special_tokens=False).ids


def test_whole_table_equals_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, vocabulary_path()).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 100, 1_000, 4_097])
def test_feistel_is_a_permutation(n):
    p = sharding.feistel(np.arange(n), n, seed=9)
    assert sorted(p.tolist()) == list(range(n))


def test_feistel_depends_on_seed_only():
    a, b = sharding.feistel(np.arange(999), 999, 1), sharding.feistel(np.arange(999), 999, 2)
    assert a.tolist() == sharding.feistel(np.arange(999), 999, 1).tolist() and a.tolist() != b.tolist()


def _laws(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots.get(s, ())) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_whole_table_is_dealt_evenly(spark, sf):
    rows = op4_sharding(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    _laws(rows, 24)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None


def test_placement_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = sharding.shard_documents(docs).select("doc_id", "shard", "slot")
    b = sharding.shard_documents(docs.repartition(7)).select("doc_id", "shard", "slot")
    assert sorted(a.collect()) == sorted(b.collect())


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id bigint, text string, shard string"
    rows = [(None, None, "a"), (5, None, "b"), (5, None, "b"), (5, "é", "c"), (6, "", "d")]
    got = sharding.shard_documents(spark.createDataFrame(rows, schema), shards=2).collect()
    assert len(got) == 5
    _laws(got, 2)
    assert sorted(r.size for r in got) == [8, 8, 8, 8, 10]
    assert sharding.shard_documents(spark.createDataFrame([], schema)).count() == 0
