"""The corpus pipeline: each stage against its operator's own result, and the whole against its stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from lodestack.llm import decontaminate, langid, simhash, toxicity
from lodestack.llm.common import table
from lodestack.llm.queries import CATEGORIES, TOXIC_FROM, labelled


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_five_stages_in_order():
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]


def test_stages_keep_the_columns_of_documents(spark, sf, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_language_rejects_what_it_says(spark, sf, docs):
    model = langid.fit(docs.where(langid.training_rows(docs)))
    want = [r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_CONFIDENCE]
    assert ids(corpus_pipeline.language(spark, docs, sf)) == sorted(want)


def test_toxic_rejects_what_it_says(spark, sf, docs):
    chain = toxicity.fit(labelled(docs, table(spark, sf, "labels")), tuple(CATEGORIES))
    want = [r.doc_id for r in toxicity.predict(docs, chain).collect() if r.p_toxic < TOXIC_FROM]
    assert ids(corpus_pipeline.toxic(spark, docs, sf)) == sorted(want)


def test_one_of_each_component_stays(spark, sf, docs):
    kept = ids(corpus_pipeline.near_duplicates(spark, docs, sf))
    assert kept == ids(simhash.keep_one(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert set(kept) <= set(first.values())  # of exact copies no second one stays
    lost = [i for i in first.values() if i not in set(kept)]
    assert all(any(simhash.similarity(texts[i], texts[j]) >= 0.8 for j in texts if j != i) for i in lost)


def test_leaks_go(spark, sf, docs):
    bad = {r.doc_id for r in decontaminate.leaks(docs, table(spark, sf, "benchmark")).collect()}
    assert bad and ids(corpus_pipeline.leaks(spark, docs, sf)) == sorted({r.doc_id for r in docs.collect()} - bad)


def test_run_is_its_stages(spark, sf, docs):
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    want = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in now.collect())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and 0 < len(got) < docs.count()
