"""Document structure: headings, paragraphs, chunks.

Blocks are rows (doc_id, block_id, page, x0, y0, x1, y1, text). What depends on neighbours is a window over one document;
what depends on everything before it is a fold over the document's blocks as an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .splitters import prefix_sums

# Headings without a number, prefixes that rule a heading out, letters that begin an appendix.
SPECIAL = ("Abstract", "ABSTRACT", "Introduction", "Conclusion", "Conclusions", "References", "REFERENCES", "Acknowledgments", "Acknowledgements", "Limitations", "Related Work")
EXCLUDED = ("Figure ", "Fig. ", "Table ", "Algorithm ", "arXiv:", "http", "Equation ", "•", "- ")
REFERENCES = ("References", "REFERENCES", "Bibliography")
THRESHOLD = 7
L1_FLOOR = 6


def noise_block(text: Column, y0: Column, y1: Column, x0: Column, height: Column) -> Column:
    """Page numbers at the top or bottom tenth, and archive stamps at the left edge of the upper third."""
    t = F.trim(text)
    edge = (y1 < height * 0.1) | (y0 > height * 0.9)
    return (t.rlike(r"^\d{1,3}$") & edge) | (t.startswith("arXiv:") & (y0 < height * 0.3) & (x0 < 30))


def line_height(blocks: DataFrame) -> DataFrame:
    """(doc_id, text_h, page_w): the element at half of the ordered heights from 7 to 16 (10 if none), and the page's text width."""
    h = F.col("y1") - F.col("y0")
    fine = F.array_sort(F.collect_list(F.when(h.between(7.0, 16.0), h)))
    return blocks.groupBy("doc_id").agg(fine.alias("_h"), (F.max("x1") - F.min("x0")).alias("page_w")).select("doc_id", F.coalesce(F.try_element_at("_h", F.floor(F.size("_h") / 2).cast("int") + 1), F.lit(10.0)).alias("text_h"), "page_w")


def numbering(line: Column) -> dict[str, Column]:
    """kind (L1.. or APPENDIX), number and bonus of a line that begins with a section number followed by a title of 3 to 120 characters."""
    no = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\.?:?\s+(\S.{2,119})$", 1)
    letter = F.regexp_extract(line, r"^([A-Z])(?:\.|:)?\s+(\S.{2,119})$", 1)
    rest = F.regexp_extract(line, r"^(?:\d+(?:\.\d+)*|[A-Z])(?:\.|:)?:?\s+(\S.{2,119})$", 1)
    parts = F.split(no, r"\.")
    titled = rest.rlike(r"^\p{Lu}")
    numbered = (no != "") & titled & F.forall(parts, lambda p: F.coalesce(p.try_cast("int"), F.lit(0)).between(1, 20))
    appendix = (no == "") & (letter != "") & titled
    return {
        "kind": F.when(numbered, F.concat(F.lit("L"), F.size(parts))).when(appendix, "APPENDIX"), "no": F.when(numbered, no).when(appendix, letter),
        "bonus": F.when(numbered & (F.size(parts) >= 2), 3).when(numbered, 2).when(appendix, 3).otherwise(0), "title": F.when(numbered | appendix, rest).otherwise(F.regexp_replace(line, r"^\S+\s+", "")),
    }


def scored_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with six features of a heading, their total, and whether they are one."""
    order = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "block_id")
    on_page = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "block_id")
    b = blocks.join(line_height(blocks), "doc_id")
    clean = F.trim(F.regexp_replace(F.col("text"), r"\s+", " "))
    first = F.trim(F.split(F.trim("text"), "\n")[0])
    merged, alone = numbering(clean), numbering(first)
    pick = {k: F.when(merged["kind"].isNull() & alone["kind"].isNotNull(), alone[k]).otherwise(merged[k]) for k in merged}
    b = b.withColumns({"clean": clean, "multiline": F.trim("text").contains("\n"), **pick}).withColumn("special", F.col("clean").isin(*SPECIAL))
    is_refs = F.max(F.col("clean").isin(*REFERENCES)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ratio = (F.col("y1") - F.col("y0")) / F.col("text_h")
    after = F.coalesce(is_refs, F.lit(False))
    b = b.withColumns({"after_refs": after, "above": F.col("y0") - F.lag("y1").over(on_page), "below": F.lead("y0").over(on_page) - F.col("y1"), "ratio": ratio})
    number = F.when(F.col("after_refs") & ~F.col("kind").eqNullSafe("APPENDIX"), -8).otherwise(F.col("bonus"))
    b = b.withColumns({
        "f_font": F.when(F.col("ratio") < 0.95, -3).when(F.col("ratio") < 1.10, 0).when(F.col("ratio") < 1.30, 3).when(F.col("ratio") < 1.60, 1).otherwise(-4),
        "f_number": F.when(F.col("special"), F.greatest(number, F.lit(3))).when(F.col("kind").isNull(), -3).otherwise(number),
        "f_short": F.when((F.length("clean") <= 120) & ((F.col("page_w") < 1) | ((F.col("x1") - F.col("x0")) / F.col("page_w") < 0.7)), 2).otherwise(0),
        "f_white": F.when(F.col("above") > 2 * F.col("text_h"), 2).otherwise(0) + F.when(F.col("below") > 2 * F.col("text_h"), 2).otherwise(0),
        "f_end": F.when(F.col("clean").endswith("."), 0).when(F.col("clean").rlike("[:：]$"), -2).otherwise(2),
        "f_prefix": F.when(F.col("clean").rlike("^(?:" + "|".join(f"\\Q{p}\\E" for p in EXCLUDED) + ")"), -8).otherwise(0),
    })
    total = F.when(F.col("clean") == "", -99).otherwise(F.col("f_font") + F.col("f_number") + F.col("f_short") + F.col("f_white") + F.col("f_end") + F.col("f_prefix"))
    b = b.withColumn("total", total)
    shouted = F.col("title").rlike(r"\p{L}") & (F.upper("title") == F.col("title"))
    appendix = F.col("kind").eqNullSafe("APPENDIX")
    rejected = (F.col("after_refs") & ~appendix) | (appendix & (~F.col("after_refs") | (F.regexp_count("title", F.lit(",")) >= 2))) | (F.col("kind").eqNullSafe("L1") & ~shouted & (F.col("total") < L1_FLOOR))
    numbered = F.col("kind").isNotNull() & (F.col("multiline") | (F.col("f_font") >= 0))
    return b.withColumn("is_heading", ~rejected & (numbered | (F.col("total") >= THRESHOLD)))


def without_running_heads(scored: DataFrame, pages: int = 3) -> DataFrame:
    """A heading whose words stand on three or more pages of a document is a running head, not a heading."""
    heads = scored.where("is_heading").groupBy(F.col("doc_id").alias("_d"), F.trim("title").alias("_t")).agg(F.countDistinct("page").alias("_p")).where((F.col("_p") >= pages) & (F.col("_t") != ""))
    met = scored.join(heads.select("_d", "_t", F.lit(True).alias("_running")), (F.col("doc_id") == F.col("_d")) & (F.trim("title") == F.col("_t")), "left")
    return met.withColumn("is_heading", F.col("is_heading") & F.col("_running").isNull()).drop("_d", "_t", "_running")


def islands(lines: DataFrame, by: tuple[str, ...] = ("doc_id", "page"), factor: float = 2.5, least: float = 4.0, indent: float = 8.0, column_gap: float = 12.0) -> DataFrame:
    """Lines with their column and paragraph numbers.

    Columns: left edges ordered, a new column where the gap exceeds ``column_gap``. Paragraphs: a new one where the gap to the line
    above exceeds ``factor`` times the usual gap (element at half of those from 0.3 to 12; 2 if none), or the line is indented.
    """
    edge = Window.partitionBy(*by).orderBy("x0", "y0")
    new_column = F.coalesce((F.col("x0") - F.lag("x0").over(edge) > column_gap).cast("int"), F.lit(0))
    rows = lines.withColumn("_nc", new_column).withColumn("column", F.sum("_nc").over(edge.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*by, "column").orderBy("y0", "x0")
    whole = Window.partitionBy(*by, "column")
    rows = rows.withColumns({"_gap": F.col("y0") - F.lag("y1").over(w), "_left": F.min("x0").over(whole), "_prev": F.lag("x0").over(w)})
    usual = F.array_sort(F.collect_list(F.when(F.col("_gap").between(0.3, 12.0), F.col("_gap"))).over(whole))
    norm = F.coalesce(F.try_element_at(usual, F.floor(F.size(usual) / 2).cast("int") + 1), F.lit(2.0))
    rows = rows.withColumn("_limit", F.greatest(norm * factor, F.lit(least)))
    starts = (F.col("_gap") > F.col("_limit")) | ((F.col("x0") - F.col("_left") >= indent) & (F.col("_prev") < F.col("x0") - indent))
    return rows.withColumn("paragraph", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_nc", "_gap", "_left", "_prev", "_limit")


def packed(parts: Column, max_len: int) -> Column:
    """An array of texts packed in order into arrays whose texts, a line end each, have at most ``max_len`` characters; a longer text stands alone."""
    kind = "struct<done:array<array<string>>,cur:array<string>,n:int>"
    empty = F.lit(None).cast(kind)
    start = F.coalesce(empty, F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n")).cast(kind))

    def step(s: Column, p: Column) -> Column:
        over = (F.size(s["cur"]) > 0) & (s["n"] + F.length(p) + 1 > max_len)
        return F.struct(
            F.when(over, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"),
            F.when(over, F.array(p)).otherwise(F.concat(s["cur"], F.array(p))).alias("cur"), F.when(over, F.length(p) + 1).otherwise(s["n"] + F.length(p) + 1).alias("n"))

    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def windows(text: Column, size: int, step: int, least: int = 40) -> Column:
    """Pieces of ``size`` characters every ``step``; those shorter than ``least`` go."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    return F.filter(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))), lambda p: F.length(p) >= least)


def titled_chunks(blocks: DataFrame, max_len: int = 4_000) -> DataFrame:
    """Chunks of each document under their heading paths: (doc_id, chunk_id, pos, title_path, part, parts, first_page, last_page, text).

    blocks: (doc_id, pos, page, text, is_heading, level), level null for special headings. A heading closes those of its depth and
    below and all special ones; a special heading stands alone; headings without a body lend their text to the next. A
    document's blocks are one group, so memory is that of the longest document.
    """

    def chunked(doc_id: int | None, rows: list[tuple]) -> list[tuple]:
        path: list[tuple[int | None, str]] = []
        chunks: list[dict] = []
        for page, text, is_heading, level in rows:
            if is_heading:
                deep = None if level is None or level != level else int(level)
                path = [p for p in path if deep is not None and p[0] is not None and p[0] < deep] + [(deep, " ".join(text.split()))]
                if not chunks or chunks[-1]["body"]:
                    chunks.append({"blocks": [], "body": False})
                chunks[-1]["path"] = [t for _, t in path]
            elif not chunks:
                chunks.append({"path": ["(PREAMBLE)"], "blocks": [], "body": True})
            chunks[-1]["blocks"].append((int(page), text))
            chunks[-1]["body"] |= not is_heading
        out: list[tuple] = []
        for i, c in enumerate(chunks, 1):
            parts: list[list[tuple[int, str]]] = [[]]
            size = 0
            for page, text in c["blocks"]:
                if parts[-1] and size + len(text) + 1 > max_len:
                    parts.append([])
                    size = 0
                parts[-1].append((page, text))
                size += len(text) + 1
            for k, p in enumerate(parts, 1):
                out.append((doc_id, f"c{i}" if len(parts) == 1 else f"c{i}-p{k}", len(out) + 1, c["path"], k, len(parts), p[0][0], p[-1][0], "\n".join(t for _, t in p)))
        return out

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("chunk_id", pa.string()), ("pos", pa.int32()), ("title_path", pa.list_(pa.string())), *((n, pa.int32()) for n in ("part", "parts", "first_page", "last_page")), ("text", pa.string())])
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
        doc, held = None, []  # the document that is being read; it may go on in the next batch
        for batch in batches:
            out: list[tuple] = []
            for doc_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and doc_id != doc:
                    out += chunked(doc, held)
                    held = []
                doc = doc_id
                held.append(row)
            if out:
                yield made(out)
        if held:
            yield made(chunked(doc, held))

    # Documents follow each other in a partition, so that many share a batch: a group of its own costs each a frame.
    ordered = blocks.select(F.col("doc_id").cast("long").alias("doc_id"), "pos", "page", "text", "is_heading", "level").repartition("doc_id").sortWithinPartitions("doc_id", "pos").drop("pos")
    return ordered.mapInArrow(fold, "doc_id bigint, chunk_id string, pos int, title_path array<string>, part int, parts int, first_page int, last_page int, text string")


def length_batches(rows: DataFrame, most: int, budget: int, by: str) -> DataFrame:
    """(by, key, size, batch): keys of a group by size, in batches of at most ``most`` whose number times the largest size is at most ``budget``.

    For models that pad a batch to its longest text; a text beyond the budget stands alone. Where a batch ends depends only on how
    often each size occurs, so the fold sees one row for each size of a group, never its keys; a key's batch follows from its place among
    those of its size, which is found over ranges. A group, or a size, may therefore hold most rows. A null size counts as 0.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        batch, n, out = 1, 0, []
        for size, count in part.sort_values("_size")[["_size", "_n"]].itertuples(index=False):
            fits = max(1, min(most, int(budget // size) if size > 0 else most))
            room = max(0, fits - n)  # a size takes what room its batch has left, then whole batches
            out.append((size, batch, room, fits))
            beyond = count - room
            if beyond > 0:
                batch, n = batch + -(-beyond // fits), (beyond - 1) % fits + 1
            else:
                n += count
        ends = pd.DataFrame(out, columns=["_size", "_batch", "_room", "_fits"])
        ends.insert(0, "_by", [part["_by"].iloc[0]] * len(out))
        return ends

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    given = rows.select(by, "key", F.coalesce("size", F.lit(0)).cast(kinds["size"]).alias("size"))
    counts = given.groupBy(F.col(by).alias("_by"), F.col("size").alias("_size")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.groupBy("_by").applyInPandas(fold, f"_by {kinds[by]}, _size {kinds['size']}, _batch long, _room long, _fits long")
    placed = prefix_sums(given.withColumn("_one", F.lit(1)), (by, "size"), "key", ("_one",))
    past = F.col("_one_before") - F.col("_room")
    number = F.col("_batch") + F.when(past >= 0, F.floor(past / F.col("_fits")) + 1).otherwise(0)
    met = placed.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("size") == F.col("_size")))
    return met.select(by, "key", "size", number.cast("int").alias("batch"))


def element_text(kind: Column, text: Column, caption: Column, body: Column, footnote: Column) -> Column:
    """The searchable text of a layout element by its type; body is already plain."""
    joined = lambda *cs: F.array_join(F.filter(F.array(*(F.coalesce(c, F.lit("")) for c in cs)), lambda x: F.trim(x) != ""), "\n")
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    return F.when(kind == "table", joined(listed(caption), body, listed(footnote))).when(kind.isin("image", "chart"), joined(listed(caption), listed(footnote))).otherwise(joined(text))


def layout_chunks(elements: DataFrame, max_len: int = 4_000) -> DataFrame:
    """Chunks of a converter's element list; what follows the references goes.

    elements: (doc_id, pos, page, text, level), level 0 or null for body text. Depth comes from the number of a heading (2.1 is
    two deep), else from its level.
    """
    no = F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)\.?\s", 1)
    heading = F.coalesce(F.col("level") > 0, F.lit(False))
    depth = F.when(F.trim("text").isin(*SPECIAL), None).when(no != "", F.size(F.split(no, r"\."))).otherwise(F.col("level"))
    ended = F.max(heading & F.trim("text").isin(*REFERENCES)).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kept = elements.withColumn("_ended", F.coalesce(ended, F.lit(False))).where(~F.col("_ended") & (F.trim("text") != ""))
    return titled_chunks(kept.select("doc_id", "pos", "page", "text", heading.alias("is_heading"), F.when(heading, depth).cast("double").alias("level")), max_len)


def with_heading(heading: Column, text: Column, within: int = 400) -> Column:
    """The text, after its heading unless that already stands in its first characters."""
    return F.when(F.instr(F.lower(F.substring(text, 1, within)), F.lower(heading)) > 0, text).otherwise(F.concat(heading, F.lit("\n"), text))


def caption_kind(text: Column) -> Column:
    """figure or table where a text begins with a numbered caption that goes on with a capital, a digit, a colon or an end."""
    begins = lambda word: F.trim(text).rlike(rf"^(?i:{word})\s*\.?\s*(?:[IVXLC]+|\d+(?:\.\d+)*[A-Za-z]?)\s*(?:[:.|]|\s\p{{Lu}}|\s\d|$)")
    return F.when(begins("fig(?:ure)?"), "figure").when(begins("table"), "table")


def context(chunks: DataFrame, room: int, by: str = "qid") -> DataFrame:
    """All chunks of a question as one text with keys [P.S.C], its estimated size, and whether it exceeds the room (then no text)."""
    sized = chunks.groupBy(by).agg((F.sum(F.length("text") + 48) + 120 * F.countDistinct("paper")).alias("n_chars"))
    fits = sized.where(F.col("n_chars") <= room).select(by)
    line = F.concat(F.lit("[P"), F.col("paper"), F.lit("·§"), F.col("section"), F.lit("·¶"), F.col("chunk"), F.lit("]\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("paper", "pos", line.alias("line"))))
    texts = chunks.join(fits, by, "left_semi").groupBy(by).agg(ordered.alias("_l")).select(by, F.array_join(F.col("_l.line"), "\n\n").alias("context"))
    return sized.join(texts, by, "left").withColumn("refused", F.col("n_chars") > room)


def hyphen_variants(text: Column) -> Column:
    """A text as it is, with words broken at line ends joined, and with the hyphen kept."""
    return F.array(text, F.regexp_replace(text, r"-\s*\n\s*", ""), F.regexp_replace(text, r"-\s*\n\s*", "-"))


def divergence(quote: Column, source: Column) -> Column:
    """How many characters of a quote's beginning stand in the source (halving, since a prefix of what stands there stands there)."""

    @F.pandas_udf("int")
    def run(quotes: pd.Series, sources: pd.Series) -> pd.Series:
        def one(q: str, s: str) -> int:
            low, high = 0, len(q)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if q[:mid] in s else (low, mid - 1)
            return low

        return pd.Series([one(q or "", s or "") for q, s in zip(quotes, sources)], dtype="int32")

    return run(quote, source)
