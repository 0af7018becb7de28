"""Ids beyond 2 ** 53 beside a null in one batch: none may change."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestack.llm import bpe, decontaminate, html_text, langid, language_model, simhash, toxicity
from lodestack.llm.queries import vocabulary_path

LARGE = 9_007_199_254_740_993
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
TEXTS = [ITEM, f"{ITEM} nu", "quite other words are here", None, ITEM]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(LARGE + 2 * k if k < 4 else None, t, "en" if k % 2 else "fr", k % 2) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, rude int").coalesce(1)


WANT = {LARGE + 2 * k for k in range(4)} | {None}


def operators(docs):
    chain = toxicity.fit(docs, ("rude",))
    return {
        "bpe": bpe.encode_documents(docs, vocabulary_path(), keep=("lang",), with_ids=True), "toxicity": toxicity.predict(docs, chain), "langid": langid.predict(docs, langid.fit(docs)),
        "language_model": language_model.score_corpus(docs, F.lit(True))[0], "simhash": simhash.near_duplicates(docs),
        "html": html_text.extract_pages(docs.withColumn("url", F.lit("u")), id_col="doc_id", html_col="text"),
    }


@pytest.mark.parametrize("name", ["bpe", "toxicity", "langid", "language_model", "simhash", "html"])
def test_ids_stay(docs, name):
    assert {r.doc_id for r in operators(docs)[name].select("doc_id").collect()} == WANT


def test_components_have_exact_ids(docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[None] == LARGE and got[LARGE] == LARGE and got[LARGE + 4] == LARGE + 4


@pytest.mark.parametrize("small", [decontaminate.SMALL, 0])
def test_leaks_have_exact_ids_and_go(spark, docs, monkeypatch, small):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    bench = spark.createDataFrame([(LARGE + 100, ITEM), (None, "never seen at all")], "item_id bigint, text string").coalesce(1)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(LARGE, LARGE + 100), (LARGE + 2, LARGE + 100), (None, LARGE + 100)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {LARGE + 4, LARGE + 6}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {LARGE, LARGE + 2, LARGE + 4, LARGE + 6}
