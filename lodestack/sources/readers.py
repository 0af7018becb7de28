"""Readers and writers of the tables that the engine works on. All of them are lazy DataFrames over Spark's own sources."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import ELEMENT, METRIC
from .scratch import resume

# Layers that metric records may belong to, and the first bytes of a PDF file.
LAYERS = ("L0", "L1", "L2", "L3", "L4", "L5")
PDF_MAGIC = "%PDF-"
AUTHORS = 8


def parquet(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A file, or a folder of shards, of which only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def chunks(spark: SparkSession, path: str, docids: tuple[str, ...] | None = None, n: int | None = None, required: tuple[str, ...] = ("docid", "chunk_id", "text")) -> DataFrame:
    """Chunk rows of named documents (their order is ``doc_pos``), else of the first n documents by appearance (column ``pos``, else
    reading order). Missing columns and an empty choice are errors."""
    df = spark.read.parquet(path)
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"chunk table lacks columns: {lacking}")
    if docids:
        order = spark.createDataFrame([(d, i) for i, d in enumerate(docids)], "docid string, doc_pos int")
        out = df.join(F.broadcast(order), "docid")
    else:
        rows = df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())
        first = rows.groupBy("docid").agg(F.min("pos").alias("_first"))
        if n is not None:
            first = first.orderBy("_first", "docid").limit(n)
            placed = first.withColumn("doc_pos", F.row_number().over(Window.orderBy("_first", "docid")) - 1)  # n rows
        else:
            placed = first.withColumn("doc_pos", F.col("_first"))  # all documents: their order, not numbered in one task
        out = rows.join(placed.drop("_first"), "docid")
    # Whether any is left is asked of the narrow column, not of the whole plan.
    if out.select("docid").isEmpty():
        raise ValueError("no chunks left")
    return out


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header that may begin with a byte-order mark; True/False in any case are booleans when the schema says so."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    if not schema:
        return df
    kinds = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    return df.select(*((F.lower(F.trim(F.col(f"`{n}`"))) == "true" if k == "boolean" else F.col(f"`{n}`").cast(k)).alias(n) for n, k in kinds))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose header begins with a byte-order mark, for spreadsheets."""
    df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]).write.mode("overwrite").csv(path, header=True)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; those with a non-empty ``error`` count as absent."""
    df = spark.read.schema(f"{schema}, error string").json(path, multiLine=True)
    return df.where(F.coalesce(F.trim("error"), F.lit("")) == "").drop("error")


def valid_metric(name: Column, value: Column, n: Column, layer: Column) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return layer.isin(*LAYERS) & (F.trim(name) != "") & finite & (n > 0)


def append_metrics(records: DataFrame, path: str) -> DataFrame:
    """Append the valid metric records to a log; returns the rejected ones."""
    ok = F.coalesce(valid_metric(F.col("metric"), F.col("value"), F.col("n"), F.col("layer")), F.lit(False))
    records.where(ok).write.mode("append").json(path)
    return records.where(~ok)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metric log; lines that do not parse are left out."""
    return spark.read.schema(METRIC).option("mode", "DROPMALFORMED").json(path)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Layout elements written by a converter, one JSON object a line."""
    return spark.read.schema(ELEMENT).json(path)


def qasper_chunks(papers: DataFrame, max_len: int = 4_000) -> DataFrame:
    """Papers as (docid, full_text array<struct<section_name, paragraphs>>) to chunks: placeholders of references go, paragraphs are packed."""
    from ..operators.structure import packed

    section = papers.select("docid", F.posexplode("full_text").alias("s", "x")).select("docid", "s", "x.section_name", "x.paragraphs")
    plain = F.filter(F.transform("paragraphs", lambda p: F.trim(F.regexp_replace(p, r"\b(?:BIBREF|INLINEFORM|FIGREF|TABREF|SECREF)\d+\b", ""))), lambda p: p != "")
    got = section.select("docid", "s", "section_name", F.posexplode(packed(plain, max_len)).alias("part", "paragraphs"))
    return got.select("docid", F.concat(F.lit("s"), "s", F.lit("-p"), "part").alias("chunk_id"), F.col("section_name").alias("title_path"), F.array_join("paragraphs", "\n").alias("text"))


def first_spans(annotations: Column, text: Column) -> Column:
    """Distinct spans of a text named by a JSON list of {start, end}, in order, joined by a space."""
    spans = F.array_sort(F.from_json(annotations, "array<struct<start:int,end:int>>"))
    return F.array_join(F.array_distinct(F.transform(spans, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"]))), " ")


def harvested(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Records of OAI-PMH pages: identifier, title, abstract, created, categories and the first eight authors; one row a record.

    A page that is no XML yields none. Names are cut out by element, which does not depend on name-space prefixes.
    """
    record = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<record>(.*?)</record>"), F.lit(1)))
    one = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("_r", rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>", 1), r"\s+", " ")), F.lit(""))
    authors = F.slice(F.regexp_extract_all("_r", F.lit(r"(?s)<keyname>(.*?)</keyname>"), F.lit(1)), 1, AUTHORS)
    kept = [c for c in pages.columns if c != xml]
    return pages.select(*kept, record.alias("_r")).select(*kept, one("id").alias("arxiv_id"), one("title").alias("title"), one("abstract").alias("abstract"), one("created").cast("date").alias("created"), one("categories").alias("categories"), authors.alias("authors"))


def resumption_token(xml: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(xml, r"(?s)<resumptionToken[^>]*>(.*?)</resumptionToken>", 1)), F.lit(""))


def missing_months(months: DataFrame, cached: DataFrame) -> DataFrame:
    """Months that no cached page is of, newest first: those still to be fetched. cached: (month_start)."""
    return months.join(cached.select("month_start").distinct(), "month_start", "left_anti").orderBy(F.desc("month_start"))


def harvest_of_months(pages: DataFrame, months: DataFrame) -> DataFrame:
    """Records of cached pages (month_start, page, xml) that were created in their page's month; of records met again the last page's."""
    rows = harvested(pages).join(months, "month_start").where(F.col("created").between(F.col("month_start"), F.col("month_end")))
    last = rows.groupBy("arxiv_id").agg(F.max(F.struct("month_start", "page", *(c for c in rows.columns if c not in ("month_start", "page", "arxiv_id", "month_end")))).alias("_r"))
    return last.select("arxiv_id", "_r.*")


def months_back(spark: SparkSession, last: str, n: int) -> DataFrame:
    """The n months that end with the one of ``last`` (a date), newest first: (month_start, month_end)."""
    return spark.sql(f"select explode(reverse(sequence(add_months(trunc(date '{last}', 'MM'), {1 - int(n)}), trunc(date '{last}', 'MM'), interval 1 month))) as month_start").withColumn("month_end", F.last_day("month_start"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files as (path, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def is_pdf(content: Column, length: Column, least: int = 1_024) -> Column:
    return (length >= least) & (F.substring(content, 1, 5) == F.lit(PDF_MAGIC).cast("binary"))


def may_upload(name: Column, content: Column, length: Column, largest: int) -> Column:
    """ok, or why not: extension, size, or no magic bytes in the first kilobyte."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.when(~F.lower(name).endswith(".pdf"), "extension").when(length > largest, "too large").when(F.instr(head, PDF_MAGIC) == 0, "not a PDF").otherwise("ok")


def pdf_name(arxiv: Column) -> Column:
    return F.concat(F.regexp_replace(arxiv, "[^0-9A-Za-z.-]+", "_"), F.lit(".pdf"))


def pdf_url(arxiv: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)


def write_vectors(vectors: DataFrame, path: str, id_col: str, per_file: int = 5_000) -> None:
    """Vector shards of ``per_file`` consecutive ids each, as folders part=0, 1, ...; shards that are there already are not written again."""
    parted = vectors.withColumn("part", F.floor(F.col(id_col) / per_file).cast("long"))
    resume(parted.repartition("part").sortWithinPartitions("part", id_col), path, "part")


def write_index(docs: DataFrame, tokens: Column, id_col: str, path: str) -> None:
    """An inverted index as three tables: postings (by term), term_stats and doc_stats."""
    from ..operators.retrieval import postings

    rows = postings(docs, tokens, id_col)
    rows.repartition("term").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{path}/postings")
    kept = docs.sparkSession.read.parquet(f"{path}/postings")
    kept.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/term_stats")
    docs.select(F.col(id_col).alias("key"), F.size(tokens).alias("dl")).write.mode("overwrite").parquet(f"{path}/doc_stats")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, term_stats, doc_stats) of a written index."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "term_stats", "doc_stats"))


def markdown(df: DataFrame, digits: int = 4, rows: int = 1_000) -> str:
    """A small result as a pipe table (at most ``rows`` rows; more are an error)."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows: not a report table")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in got)])


def assert_no_gold(df: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """The table as it is, unless a forbidden column occurs in it at any depth."""
    names = set(re.findall(r'"name":"([^"]+)"', df.schema.json()))
    if leaked := sorted(names & set(forbidden)):
        raise ValueError(f"gold columns in the input: {leaked}")
    return df


class Sources:
    """Readers chosen by what they are asked for: the last registered one whose matcher accepts; matchers that fail are passed over."""

    def __init__(self) -> None:
        self._known: list[tuple[Callable[[str], bool], Callable[[SparkSession, str], DataFrame]]] = []

    def register(self, matches: Callable[[str], bool], read: Callable[[SparkSession, str], DataFrame]) -> None:
        self._known.append((matches, read))

    def resolve(self, name: str) -> Callable[[SparkSession, str], DataFrame]:
        for matches, read in reversed(self._known):
            try:
                if matches(name):
                    return read
            except Exception:  # noqa: BLE001  a faulty matcher does not stand in the way of others
                continue
        raise LookupError(f"no source for {name}")
