"""The harvest by its source's name, in batch and as a stream, and the table functions against the array functions."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.functions import numbers as N
from lodestack.functions import tables as H
from lodestack.functions import tabular as TF
from lodestack.plans import catalogue
from lodestack.sources import harvest as V


def page(*ids, prefix="arXiv:", token="t"):
    one = "".join(f"<record><{prefix}id>{i}</{prefix}id><title>On\n {i} &amp; more</title><created>2024-01-05</created><keyname>A</keyname><keyname>B</keyname></record>" for i in ids)
    return f"<?xml version='1.0'?><OAI-PMH>{one}<resumptionToken>{token}</resumptionToken></OAI-PMH>"


def write(spark, path, rows):
    V.write_pages(spark.createDataFrame([(datetime.date.fromisoformat(m), p, x) for m, p, x in rows], "month date, page int, xml string"), path)


def test_records_of_a_page():
    assert [r["arxiv_id"] for r in V.records(page("a", "b"))] == ["a", "b"]
    assert V.records(page("a", prefix=""))[0] == {"arxiv_id": "a", "title": "On a & more", "abstract": None, "created": datetime.date(2024, 1, 5), "categories": None, "authors": ["A", "B"]}
    assert V.records("<html><p>Not found") == [] and V.records("") == [] and V.records("<r><record/></r>")[0]["arxiv_id"] is None
    many = "<r><record>" + "<keyname>N</keyname>" * 30 + "<created>no date</created></record></r>"
    assert V.records(many)[0]["authors"] == ["N"] * V.AUTHORS and V.records(many)[0]["created"] is None


def test_bounds_choose_months(tmp_path, spark):
    path = f"file://{tmp_path}/pages"
    assert V.months_at(path) == []
    write(spark, path, [(f"2024-0{m}-01", p, page(f"{m}-{p}")) for m in (1, 2, 3) for p in (0, 1)])
    assert [p.month for p in V._Batch(path, "2024-01-15", "2024-02-29").partitions()] == ["2024-02-01"]
    V.register(spark)
    read = lambda **o: spark.read.format(V.NAME).options(path=path, **o).load()
    assert sorted(r.arxiv_id for r in read(since="2024-02-01").where("page = 1").collect()) == ["2-1", "3-1"]
    df = read()
    late, early = df.where("month >= date '2024-02-01'"), df.where("month < date '2024-02-01'")
    assert (late.count(), early.count(), late.union(early).count(), df.count()) == (4, 2, 6, 6)
    assert read(since="2030-01-01").count() == 0 and read(until="2024-01-01").count() == 2
    with pytest.raises(Exception, match="path"):
        spark.read.format(V.NAME).load().count()


def test_a_restarted_stream_reads_no_page_again(tmp_path, spark):
    path = f"file://{tmp_path}/pages"
    V.register(spark)

    def step(rows):
        if rows:
            write(spark, path, rows)
        run = spark.readStream.format(V.NAME).option("path", path).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return sorted(r.arxiv_id for r in spark.read.schema(V.SCHEMA).parquet(f"{tmp_path}/out").collect())

    assert step([("2024-01-01", 0, page("a", "b")), ("2024-01-01", 2, page("d"))]) == ["a", "b"]  # a page behind a gap waits
    assert step([]) == ["a", "b"]
    assert step([("2024-01-01", 1, page("c")), ("2024-02-01", 0, page("e"))]) == ["a", "b", "c", "d", "e"]
    assert step([("2024-02-01", 1, "no page"), ("2024-02-01", 2, page("f", "a"))]) == ["a", "a", "b", "c", "d", "e", "f"]


def test_number_tokens_equal_the_array(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "3.5% of 10 million and 百分之五 from 2020")], "doc_id long, text string"))
    wanted = docs.select("doc_id", F.posexplode(N.numbers(F.col("text"))).alias("p", "n")).select("doc_id", (F.col("p") + 1).alias("pos"), "n.*")
    got = TF.with_numbers(docs, "text").drop("text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    arrays = {r.doc_id: (r.n_numbers, r.n_percent, r.largest) for r in catalogue.QUERIES["numeric_scan"](spark, sf).collect() if r.n_numbers}
    assert {r.doc_id: (r.n_numbers, r.n_percent, r.largest) for r in catalogue.QUERIES["number_token_rows"](spark, sf).collect()} == arrays


def test_table_cells_equal_the_grid(spark):
    html = ["<table><tr><th rowspan=2>a<th colspan=2>b<tr><th>c<th>d<tr><td>1<td>2<td>3</table>", "<table></table>", None, "<table><tr><td>x<table><tr><td>y</table></table>"]
    got = [tuple(r) for r in TF.with_cells(spark.createDataFrame(list(enumerate(html)), "id int, html string"), "html").select("id", "row", "col", "header", "text").collect()]
    grids = [H.table_grid(h) for h in html]
    assert sorted(got) == sorted((k, i, j, i < head, c) for k, (grid, head) in enumerate(grids) for i, line in enumerate(grid) for j, c in enumerate(line))
