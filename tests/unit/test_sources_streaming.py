from __future__ import annotations

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.sources import readers as S
from lodestack.streaming import logs as L


def test_csv_mark_and_booleans(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,gold\n1,True\n2,false\n".encode())
    got = S.csv(spark, str(tmp_path / "a.csv"), "id int, gold boolean")
    assert got.columns == ["id", "gold"] and sorted(map(tuple, got.collect())) == [(1, True), (2, False)]
    S.write_csv(got, f"file://{tmp_path}/out")
    assert sorted(map(tuple, S.csv(spark, f"{tmp_path}/out", "id int, gold boolean").collect())) == [(1, True), (2, False)]


def test_json_documents_with_errors_are_absent(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": "a",\n "error": ""}')
    (tmp_path / "b.json").write_text('{"k": "b", "error": "boom"}')
    assert [r.k for r in S.json_documents(spark, str(tmp_path), "k string").collect()] == ["a"]


def test_metric_log(spark, tmp_path):
    rows = [("L1", "n", "m", 1.0, 5, "", "", "2024"), ("L9", "n", "m", 1.0, 5, "", "", "2024"), ("L1", "n", "m", float("nan"), 5, "", "", "2024"), ("L1", "n", "m", 1.0, 0, "", "", "2024")]
    records = spark.createDataFrame(rows, "layer string, name string, metric string, value double, n bigint, note string, evidence_path string, at string")
    assert S.append_metrics(records, f"{tmp_path}/log").count() == 3
    (tmp_path / "log" / "part-bad.json").write_text("not json\n")
    assert S.metrics(spark, f"{tmp_path}/log").count() == 1


def test_chunks(spark, tmp_path):
    spark.createDataFrame([("b", "c1", "x", 0), ("a", "c1", "y", 1), ("c", "c1", "z", 2)], "docid string, chunk_id string, text string, pos int").coalesce(1).write.parquet(f"{tmp_path}/c")
    order = lambda d: [r.docid for r in d.orderBy("doc_pos").collect()]
    assert order(S.chunks(spark, f"{tmp_path}/c", docids=("c", "a"))) == ["c", "a"]
    assert order(S.chunks(spark, f"{tmp_path}/c", n=2)) == ["b", "a"]
    with pytest.raises(ValueError, match="no chunks"):
        S.chunks(spark, f"{tmp_path}/c", docids=("zz",))
    with pytest.raises(ValueError, match="lacks"):
        S.chunks(spark, f"{tmp_path}/c", required=("title",))


def test_harvest(spark):
    xml = "<OAI><record><metadata><arXiv><id>2401.00001</id><created>2024-01-02</created><authors>" + "<author><keyname>K</keyname></author>" * 10 + "</authors><title>A\n  b</title><categories>cs.CL</categories></arXiv></metadata></record><resumptionToken x='1'>tok</resumptionToken></OAI>"
    d = spark.createDataFrame([(1, xml), (2, "junk")], "page int, xml string")
    got = S.harvested(d).collect()
    assert len(got) == 1 and got[0].title == "A b" and len(got[0].authors) == 8 and str(got[0].created) == "2024-01-02"
    assert [r[0] for r in d.select(S.resumption_token(F.col("xml"))).collect()] == ["tok", None]
    assert [str(r.month_start) for r in S.months_back(spark, "2024-02-10", 3).collect()] == ["2024-02-01", "2024-01-01", "2023-12-01"]


def test_files_and_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7" + b"x" * 2000)
    (tmp_path / "b.pdf").write_bytes(b"<html>" + b"x" * 2000)
    got = {r.p: (r.ok, r.up) for r in S.files(spark, str(tmp_path), "*.pdf").select(F.element_at(F.split("path", "/"), -1).alias("p"), S.is_pdf(F.col("content"), F.col("length")).alias("ok"), S.may_upload(F.col("path"), F.col("content"), F.col("length"), 5000).alias("up")).collect()}
    assert got == {"a.pdf": (True, "ok"), "b.pdf": (False, "not a PDF")}


def test_registry_takes_the_last_and_skips_the_faulty():
    s = S.Sources()
    s.register(lambda n: n.endswith("x"), lambda *_: "first")
    s.register(lambda n: n.endswith("x"), lambda *_: "second")
    s.register(lambda n: 1 / 0, lambda *_: "never")
    assert s.resolve("ax")(None, "") == "second"
    with pytest.raises(LookupError):
        s.resolve("y")


def test_gold_guard_and_markdown(spark):
    d = spark.createDataFrame([(1, ("x",))], "a int, s struct<gold:string>")
    with pytest.raises(ValueError, match="gold"):
        S.assert_no_gold(d, ("gold",))
    assert S.assert_no_gold(d, ("other",)) is d
    assert S.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double"), 2) == "| a | b |\n|---|---|\n| 1 | 0.50 |"


def test_qasper_and_index(spark, tmp_path):
    from lodestack.functions import text as T

    d = spark.createDataFrame([("d", [("Intro", ["one BIBREF3 two", "", "three"])])], "docid string, full_text array<struct<section_name:string,paragraphs:array<string>>>")
    got = S.qasper_chunks(d, 10).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text) for r in got] == [("s0-p0", "one  two"), ("s0-p1", "three")]
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id bigint, text string")
    S.write_index(docs, T.latin_tokens(F.col("text")), "doc_id", f"{tmp_path}/ix")
    assert {(r.term, r.df) for r in spark.read.parquet(f"{tmp_path}/ix/term_stats").collect()} == {("a", 1), ("b", 2)}
    S.write_vectors(docs.select("doc_id"), f"{tmp_path}/v", "doc_id", 1)
    assert spark.read.parquet(f"{tmp_path}/v").count() == 2


def test_gzipped_pages_read_as_text(spark, tmp_path):
    with gzip.open(tmp_path / "p.xml.gz", "wt") as f:
        f.write("<record><id>1</id></record>")
    assert S.harvested(spark.read.text(str(tmp_path / "p.xml.gz"), wholetext=True).withColumnRenamed("value", "xml")).count() == 1


def test_jobs(spark):
    log = spark.createDataFrame([("a", "queued", 1, 1), ("a", "running", 2, 2), ("b", "ready", 2, 3)], "job string, state string, ts int, seq int")
    states = L.recovered(L.job_states(log))
    assert {r.job: r.state for r in states.collect()} == {"a": "failed", "b": "ready"}
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "key string, n int")
    active = L.job_states(log)
    assert sorted(r.key for r in L.submitted_once(asked, "key", active).collect()) == ["c"]


def test_stream_of_metrics_keeps_the_latest(spark, tmp_path):
    kind = "k string, at string, pos bigint, v double"
    spark.createDataFrame([("a", "1", 1, 1.0), ("b", "1", 2, 2.0)], kind).write.parquet(f"{tmp_path}/in/one")
    read = lambda: spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for step in range(2):
        L.follow_latest(read(), ("k",), "at", "pos", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
        if not step:
            spark.createDataFrame([("a", "2", 1, 9.0), ("b", "0", 9, 7.0)], kind).write.parquet(f"{tmp_path}/in/two")
    assert {r.k: r.v for r in L.read_latest(spark, f"{tmp_path}/out").collect()} == {"a": 9.0, "b": 2.0}


def test_windows_are_the_same_in_batch_and_stream(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, m), 1.0) for m in (5, 50)] + [(1, datetime(2024, 1, 1, 1, 5), 2.0), (1, datetime(2024, 1, 2), 0.0)]
    kind = "user_id bigint, ts timestamp, value double"
    d = spark.createDataFrame(rows, kind)
    d.write.parquet(f"{tmp_path}/e")
    q = L.event_windows(spark.readStream.schema(kind).parquet(f"{tmp_path}/e"), "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, L.event_windows(d, "1 hour").collect()))
