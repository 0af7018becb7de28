"""Queries of readers and writers: tables that are written into the shared folder, in each format, and read again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import harvest as V
from ..sources import readers as I
from ..sources import scratch
from .registry import query, table

_MD5 = lambda c: F.md5(c.cast("binary"))
_join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("select doc_id, lang from documents")
def scanned_columns(spark, d):
    return I.parquet(spark, f"{d}/documents.parquet", ("doc_id", "lang"))


@query("""with p as (select unnest(['src3', 'src1', 'src11']) as docid, unnest([0, 1, 2]) as doc_pos) select p.docid, 'c' || doc_id as chunk_id, cast(doc_pos as integer) as doc_pos, length(text) as n_chars from p join documents on source = docid""")
def chosen_chunks(spark, d):
    """Chunks of the documents that are asked for, with the order in which they were asked for."""
    path = scratch.folder(spark, "chunks")
    table(spark, d, "documents").select(F.col("source").alias("docid"), _join("c", F.col("doc_id").cast("string")).alias("chunk_id"), "text", F.col("doc_id").alias("pos")).write.parquet(path)
    return I.chunks(spark, path, ("src3", "src1", "src11")).select("docid", "chunk_id", "doc_pos", F.length("text").cast("long").alias("n_chars"))


@query("""with f as (select source, min(doc_id) as f from documents group by 1), o as (select source, cast(row_number() over (order by f, source) - 1 as integer) as doc_pos from f) select source as docid, doc_pos, doc_id from o join documents using (source) where doc_pos < 4""")
def first_documents(spark, d):
    """Chunks of the first four documents by appearance."""
    path = scratch.folder(spark, "chunks")
    table(spark, d, "documents").select(F.col("source").alias("docid"), F.col("doc_id").alias("chunk_id"), F.lit("").alias("text"), F.col("doc_id").alias("pos")).write.parquet(path)
    return I.chunks(spark, path, n=4).select("docid", "doc_pos", F.col("chunk_id").alias("doc_id"))


@query("select doc_id, source || ', \"quoted\" é' as name, n_chars / 4.0e0 as size, doc_id % 3 = 0 as flag from documents")
def csv_round_trip(spark, d):
    """CSV with a byte-order mark, quotes, commas, accents, and booleans in several spellings."""
    path = scratch.folder(spark, "csv")
    i = F.col("doc_id")
    flag = F.when(i % 3 != 0, F.when(i % 2 == 0, "False").otherwise("FALSE")).when(i % 2 == 0, "True").otherwise(" true ")
    I.write_csv(table(spark, d, "documents").select("doc_id", _join(F.col("source"), ', "quoted" é').alias("name"), (F.col("n_chars") / 4).alias("size"), flag.alias("flag")), path)
    return I.csv(spark, path, "doc_id bigint, name string, size double, flag boolean")


@query("select item_id, md5(text) as digest from benchmark where item_id % 5 <> 2")
def json_documents(spark, d):
    """One JSON document a file; those that say what went wrong count as absent."""
    path = scratch.folder(spark, "json")
    error = F.when(F.col("item_id") % 5 == 2, "no such page").when(F.col("item_id") % 5 == 3, " ")
    table(spark, d, "benchmark").select("item_id", "text", error.alias("error")).write.option("maxRecordsPerFile", 1).json(path)
    return I.json_documents(spark, path, "item_id bigint, text string").select("item_id", _MD5(F.col("text")).alias("digest"))


@query("""select 'L' || (user_id % 7) as layer, event_type as name, count(*) as n, round(sum(value), 4) as total from events where user_id % 7 < 6 and event_id % 4 > 0 group by 1, 2""")
def metric_log(spark, d):
    """Records appended in two runs, only valid ones, and a log in which some lines are no records."""
    path, i = scratch.folder(spark, "log"), F.col("event_id")
    e = table(spark, d, "events").select(
        _join("L", (F.col("user_id") % 7).cast("string")).alias("layer"), F.col("event_type").alias("name"), F.lit("value").alias("metric"), "value", (i % 4).alias("n"), F.lit("").alias("note"), F.lit("").alias("evidence_path"), F.col("ts").cast("string").alias("at"), i,
    )
    for part in (0, 1):
        I.append_metrics(e.where(i % 2 == part).drop("event_id"), path)
    spark.createDataFrame([('{"layer": "L0", "name": "view", "value": ',), ("no record",)], "value string").write.mode("append").text(path)
    return I.metrics(spark, path).groupBy("layer", "name").agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""with p as (select doc_id, replace(text, ' the ', ' the  ') as t from documents) select cast(doc_id as varchar) as docid, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> ''), chr(10))) as text from p where len(list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '')) > 0""")
def paper_sections(spark, d):
    """Papers of sections and paragraphs with placeholders of references in them."""
    section = F.struct(F.col("lang").alias("section_name"), F.split(F.replace("text", F.lit(" the "), F.lit(" the BIBREF12 ")), "\n").alias("paragraphs"))
    papers = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), F.array(section).alias("full_text"))
    return I.qasper_chunks(papers, 10_000_000).select("docid", _MD5(F.col("text")).alias("text"))


@query("select case turn % 3 when 0 then 'table' when 1 then 'text' else 'equation' end as type, count(*) as n, sum(length(text))::bigint as n_chars, count(*) filter (turn % 3 = 0) as captions from conversations group by 1")
def layout_files(spark, d):
    """A converter's elements as JSON lines."""
    path, t = scratch.folder(spark, "elements"), F.col("turn")
    kind = F.when(t % 3 == 0, "table").when(t % 3 == 1, "text").otherwise("equation")
    table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), t.alias("pos"), kind.alias("type"), t.alias("page_idx"), "text", F.when(t % 3 == 0, F.array(F.lit("Table 1"))).alias("caption")).write.json(path)
    return I.elements(spark, path).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.coalesce(F.sum(F.when(F.col("caption").isNotNull(), F.size("caption"))), F.lit(0)).cast("long").alias("captions"))


def _pages(spark, d):
    """Pages of about fifty records, one in seven of which is met again on the next page."""
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 120).cast("int"))
    authors = F.array_join(F.transform(F.sequence(F.lit(1), (1 + i % 12).cast("int")), lambda k: _join("<author><keyname>N", k.cast("string"), "</keyname></author>")), "")
    record = _join(
        "<record><header/><metadata><arXiv:id>", i.cast("string"), "</arXiv:id><arXiv:created>", day.cast("string"), "</arXiv:created><authors>", authors, "</authors><arXiv:title lang='en'>On ", F.col("source"), "\n  and ", F.col("lang"), "</arXiv:title><categories>cs.",
        F.upper("lang"), "</categories><abstract> About\n it </abstract></metadata></record>")
    rows = table(spark, d, "documents").select(F.trunc(day, "MM").alias("month_start"), F.floor(i / 50).alias("page"), i.alias("i"), record.alias("r"))
    again = rows.where("i % 7 = 0").withColumn("page", F.col("page") + 1)
    paged = rows.unionByName(again).groupBy("month_start", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda s: s["r"]), "\n").alias("records"))
    return paged.select("month_start", "page", _join("<?xml version='1.0'?><OAI-PMH><ListRecords>", F.col("records"), "<resumptionToken cursor='0'> t", F.col("page").cast("string"), " </resumptionToken></ListRecords></OAI-PMH>").alias("xml"))


_RECORDS = "select doc_id, cast(doc_id as varchar) as arxiv_id, date '2024-01-01' + cast(doc_id % 120 as integer) as created, 'On ' || source || ' and ' || lang as title, 'cs.' || upper(lang) as categories, cast(least(8, 1 + doc_id % 12) as integer) as n_authors, floor(doc_id / 50) as page from documents"


@query(f"with r as ({_RECORDS}), m as (select * from r union all select doc_id, arxiv_id, created, title, categories, n_authors, page + 1 from r where doc_id % 7 = 0) select arxiv_id, cast(cast(created as date) as varchar) as created, title, categories, n_authors, 't' || cast(page as bigint) as token from m")
def harvested_records(spark, d):
    """Records cut out of XML pages, and where each page goes on."""
    pages = _pages(spark, d).withColumn("token", I.resumption_token(F.col("xml")))
    return I.harvested(pages).select("arxiv_id", F.col("created").cast("string").alias("created"), "title", "categories", F.size("authors").alias("n_authors"), "token")


@query(f"with r as ({_RECORDS}) select arxiv_id, cast(cast(created as date) as varchar) as created, title, cast(page + case when doc_id % 7 = 0 then 1 else 0 end as bigint) as page from r where created between date '2024-02-01' and date '2024-04-30' and date_trunc('month', created) <> date '2024-03-01'")
def harvested_months(spark, d):
    """The three months up to April, of which March is cached already; a record that is met again counts once."""
    months = I.months_back(spark, "2024-04-15", 3)
    cached = spark.sql("select date '2024-03-01' as month_start")
    return I.harvest_of_months(_pages(spark, d), I.missing_months(months, cached)).select("arxiv_id", F.col("created").cast("string").alias("created"), "title", "page")


def _laid_out(pages):
    """Pages of a month counted from 0, as the source reads them."""
    at = F.row_number().over(Window.partitionBy("month_start").orderBy("page")) - 1
    return pages.select(F.col("month_start").alias("month"), at.cast("int").alias("page"), "xml")


@query(f"""with r as ({_RECORDS}), m as (select * from r union all select doc_id, arxiv_id, created, title, categories, n_authors, page + 1 from r where doc_id % 7 = 0),
p as (select *, cast(dense_rank() over (partition by date_trunc('month', created) order by page) - 1 as integer) as nth from m)
select cast(cast(date_trunc('month', created) as date) as varchar) as month, nth as page, arxiv_id, cast(cast(created as date) as varchar) as created, title, categories, n_authors from p where created between date '2024-02-01' and date '2024-03-31'""")
def harvest_source(spark, d):
    """Two months of cached pages, read by the source's name; the others are not listed."""
    path = scratch.folder(spark, "harvest")
    V.register(spark)
    V.write_pages(_laid_out(_pages(spark, d)), path)
    asked = spark.read.format(V.NAME).option("path", path).option("since", "2024-02-01").option("until", "2024-03-31").load()
    return asked.select(F.col("month").cast("string").alias("month"), "page", "arxiv_id", F.col("created").cast("string").alias("created"), "title", "categories", F.size("authors").alias("n_authors"))


@query(f"""with r as ({_RECORDS}), m as (select * from r union all select doc_id, arxiv_id, created, title, categories, n_authors, page + 1 from r where doc_id % 7 = 0)
select arxiv_id, cast(cast(created as date) as varchar) as created, title, cast(count(*) as bigint) as times from m group by all""")
def harvest_stream(spark, d):
    """Pages followed as a stream that is stopped after the first half of them and goes on from its checkpoint: each is read once."""
    path, out, state = (scratch.folder(spark, n) for n in ("harvest", "harvested", "harvest-state"))
    V.register(spark)
    pages = _laid_out(_pages(spark, d))
    for part in (F.col("page") < 2, F.col("page") >= 2):
        V.write_pages(pages.where(part), path)
        run = spark.readStream.format(V.NAME).option("path", path).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(out).groupBy("arxiv_id", F.col("created").cast("string").alias("created"), "title").agg(F.count(F.lit(1)).alias("times"))


@query("select floor(vec_id / 100)::bigint as part, count(*) as n, sum(vec_id)::bigint as ids from embeddings group by 1")
def resumed_vectors(spark, d):
    """Vector shards of which a first run wrote every other one; the second writes the rest and none again."""
    path, v = scratch.folder(spark, "vectors"), table(spark, d, "embeddings").select("vec_id", "embedding")
    I.write_vectors(v.where(F.floor(F.col("vec_id") / 100) % 2 == 0), path, "vec_id", 100)
    I.write_vectors(v, path, "vec_id", 100)
    return I.parquet(spark, path).groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


@query("""with t as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark), p as (select item_id, term, count(*) as tf from t group by 1, 2), f as (select term, count(*) as df, sum(tf)::bigint as tf from p group by 1) select term, df, tf from f""")
def written_index(spark, d):
    """An inverted index, written and read again."""
    path = scratch.folder(spark, "index")
    I.write_index(table(spark, d, "benchmark"), T.latin_tokens(F.col("text")), "item_id", path)
    postings, terms, _ = I.read_index(spark, path)
    return terms.join(postings.groupBy("term").agg(F.sum("tf").alias("tf")), "term").select("term", "df", "tf")


@query("select event_type, max(event_id) as last, count(*) as n from events group by 1")
def replaced_state(spark, d):
    """A state that is written, replaced whole, and read while others may be replacing it."""
    path = scratch.folder(spark, "state")
    e = table(spark, d, "events")
    for rows in (e.where("event_id % 2 = 0"), e):
        scratch.replace(rows.groupBy("event_type").agg(F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n")), path)
    return scratch.read_state(spark, path)


@query("""with f as (select doc_id, case doc_id % 4 when 0 then '%PDF-1.7' || text when 1 then repeat(' ', 500) || '%PDF-1.4' || text when 2 then repeat(' ', 1500) || '%PDF-1.4' || text else text end as body, 'paper' || doc_id || case doc_id % 3 when 0 then '.pdf' when 1 then '.PDF' else '.txt' end as name from documents)
select doc_id, strlen(body) >= 1024 and starts_with(body, '%PDF-') as is_pdf, case when not ends_with(lower(name), '.pdf') then 'extension' when strlen(body) > 3000 then 'too large' when not contains(left(body, 600), '%PDF-') then 'not a PDF' else 'ok' end as verdict from f""")
def file_checks(spark, d):
    """Contents with the magic bytes in front, within the first kilobyte, later, or not at all."""
    i, t = F.col("doc_id"), F.col("text")
    body = F.when(i % 4 == 0, _join("%PDF-1.7", t)).when(i % 4 == 1, _join(F.repeat(F.lit(" "), F.lit(500)), "%PDF-1.4", t)).when(i % 4 == 2, _join(F.repeat(F.lit(" "), F.lit(1500)), "%PDF-1.4", t)).otherwise(t).cast("binary")
    name = _join("paper", i.cast("string"), F.when(i % 3 == 0, ".pdf").when(i % 3 == 1, ".PDF").otherwise(".txt"))
    n = F.octet_length(body)
    return table(spark, d, "documents").select("doc_id", I.is_pdf(body, n).alias("is_pdf"), I.may_upload(name, body, n, 3_000).alias("verdict"))


@query("select 'documents' as source, count(*) as n from documents union all select 'benchmark', count(*) from benchmark union all select 'pages', count(*) from pages")
def registered_sources(spark, d):
    """Readers by name: the last one that accepts a name reads it, and one that fails is passed over."""
    known = I.Sources()
    known.register(lambda name: True, lambda s, name: table(s, d, "documents"))
    known.register(lambda name: name.startswith(("bench", "pages")), lambda s, name: table(s, d, name))
    known.register(lambda name: 1 / 0 > 0, lambda s, name: s.range(0))
    every = [known.resolve(n)(spark, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("source"), "n") for n in ("documents", "benchmark", "pages")]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("select user_id, event_id, count(*) over w as calls, round(sum(value) over w, 4) as total from events window w as (partition by user_id order by event_id rows unbounded preceding)")
def running_usage(spark, d):
    """Counters of calls and amounts as they stood after each call."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("calls"), F.round(F.sum("value").over(w), 4).alias("total"))
