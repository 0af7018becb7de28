"""Views of converted documents: external table chunks, captions, table targets, and how healthy a view is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as H
from ..functions import text as T
from .joins import donated

# The prefix of external chunks, their section, common English words, and signs of formulas.
EXTERNAL = "xtbl-"
EXTERNAL_PATH = "(External Tables)"
COMMON = ("the", "and", "with", "that", "for", "this", "from", "which", "are", "was", "have", "not", "its", "these")
FORMULA_SIGNS = "=<>≤≥∑∏∫√∈∀∃±×÷→∞^_{}\\"
#: Columns named where a table has neither a caption nor a twin with one.
NAMED_COLUMNS = 12


def caption_parts(text: Column) -> tuple[Column, Column]:
    """(Figure or Table, number) of a block that is a caption; null for running text.

    After the number comes nothing, a colon or a point, or a capital or a digit: "Table 6 lists" is no caption.
    """
    pattern = r"^(?i:(table|tab\.?|figure|fig\.?))\s+((?i:[a-z]{1,2}\.\d+|[a-z]?\d+(?:\.\d+)*[a-z]?))\s*(?:$|[:.]|[\p{Lu}\d])"
    t = F.trim(text)
    word = F.lower(F.regexp_extract(t, pattern, 1))
    return F.when(word.startswith("tab"), "Table").when(word != "", "Figure"), F.nullif(F.regexp_extract(t, pattern, 2), F.lit(""))


def external_chunks(elements: DataFrame, max_len: int = 4_000) -> DataFrame:
    """Tables and equations of a converter's element list as chunks of their own, behind the chunks of the text.

    elements: (doc_id, pos, type, page_idx, caption array, text), text being the element's whole text. Captions are cleaned; a
    table without one takes that of the first table with the same header cells, or else names its columns.
    """
    kept = elements.where(F.col("type").isin("table", "equation") & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    is_table = F.col("type") == "table"
    cells = F.when(is_table, H.header_cells(F.col("text"))).otherwise(F.array().cast("array<string>"))
    rows = kept.withColumns({"cells": cells, "own": F.when(is_table, F.array_join(H.clean_captions(F.col("caption")), " ")).otherwise("")})
    key = F.when(F.size("cells") > 0, F.array_join(F.sort_array("cells"), "|")).otherwise(F.concat(F.lit("#"), F.col("pos").cast("string")))
    given = donated(rows.withColumn("lent", F.col("own")), key, "lent", "pos", ("doc_id",))
    named = F.concat(F.lit("Table (columns: "), F.array_join(F.slice("cells", 1, NAMED_COLUMNS), ", "), F.lit(")"))
    head = F.when(~is_table | (F.col("own") != ""), None).when(F.coalesce("lent", F.lit("")) != "", F.col("lent")).when(F.size("cells") > 0, named)
    text = F.substring(F.concat_ws("\n", head, F.col("text")), 1, max_len)
    return given.select("doc_id", F.concat(F.lit(EXTERNAL), F.col("pos").cast("string")).alias("chunk_id"), F.array(F.lit(EXTERNAL_PATH)).alias("title_path"), (F.col("page_idx") + 1).alias("page"), text.alias("text"))


def table_numbers(text: Column) -> Column:
    """The distinct numbers of the tables that a text names."""
    return F.array_distinct(F.transform(T.matches(F.coalesce(text, F.lit("")), rf"(?i){T.EDGE}(?:table|tab\.?)\s*(?:~|#)?\s*(\d+|[IVX]+{T.EDGE})", 1), lambda n: F.upper(n)))


def table_targets(questions: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """(group, qid, chunk_id, by_number, by_content): external chunks that a question's gold evidence points at.

    questions: (group, qid, evidence, values array), chunks: (group, chunk_id, text). By number: a table number of the evidence stands in the
    chunk; by content: all values of the gold answer do (at least one). Numbers and values meet chunks by equality.
    """
    outside = chunks.where(F.col("chunk_id").startswith(EXTERNAL)).select(group, "chunk_id", table_numbers(F.col("text")).alias("_n"), F.array_distinct(T.mixed_tokens(F.col("text"))).alias("_w"))
    numbers = questions.select(group, "qid", F.explode(table_numbers(F.col("evidence"))).alias("_k"))
    by_number = numbers.join(outside.select(group, "chunk_id", F.explode("_n").alias("_k")), [group, "_k"]).select(group, "qid", "chunk_id", F.lit(True).alias("by_number"), F.lit(False).alias("by_content"))
    values = questions.select(group, "qid", F.array_distinct("values").alias("_v")).where(F.size("_v") > 0)
    each = values.select(group, "qid", F.size("_v").alias("_all"), F.explode("_v").alias("_k"))
    met = each.join(outside.select(group, "chunk_id", F.explode("_w").alias("_k")), [group, "_k"]).groupBy(group, "qid", "chunk_id", "_all").agg(F.count(F.lit(1)).alias("_met"))
    by_content = met.where("_met = _all").select(group, "qid", "chunk_id", F.lit(False).alias("by_number"), F.lit(True).alias("by_content"))
    return by_number.unionByName(by_content).groupBy(group, "qid", "chunk_id").agg(F.bool_or("by_number").alias("by_number"), F.bool_or("by_content").alias("by_content"))


def common_words(text: Column) -> Column:
    """How many common English words a text holds: text that was cut in the wrong places holds few."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{T.EDGE}(?:" + "|".join(COMMON) + f"){T.EDGE}"))


def retention(view: Column, whole: Column) -> Column:
    """The share of common words that a view keeps of an independent reading; null where that has none."""
    return F.round(common_words(view) / F.nullif(common_words(whole), F.lit(0)), 6)


def without_number(heading: Column) -> Column:
    """A heading without its number: 3.2, A, IV or 12a in front, with a point or dash behind."""
    return F.regexp_replace(F.trim(heading), r"^(?:[A-Za-z]?\d+(?:\.\d+)*[a-z]?|[IVX]+|[A-Za-z])(?:\s+|\s*[.-]\s*|$)", "")


def suspicious_heading(heading: Column, longest: int = 70) -> Column:
    """A heading that is hardly one: a whole sentence, or with signs of a formula."""
    bare = without_number(heading)
    return (F.length(bare) > longest) | (F.length(F.translate(bare, FORMULA_SIGNS, "")) < F.length(bare))


def degraded(text: Column, shortest: int = 40) -> Column:
    """Why an overview is no overview: empty, refusal (in its first sentence or two), short; null if it is one."""
    t = F.trim(F.coalesce(text, F.lit("")))
    refusal = F.lower(F.substring(t, 1, 80)).rlike(r"(?:i am|i'm|we are) (?:unable|sorry)|i cannot|can ?not (?:be )?(?:write|written|provide)|no (?:material|content|information) (?:is|was|has been) (?:given|provided|available)|抱歉|无法|没有.{0,6}材料|不足以")
    return F.when(t == "", "empty").when(refusal, "refusal").when(F.length(t) < shortest, "short")


def head_per_class(rows: DataFrame, cls: str, n: int, order: str) -> DataFrame:
    """The first n rows of each class, by ``order``."""
    from .ranking import top_k

    return top_k(rows, n, (cls,), (F.asc(order),))
