"""Joins on places, contents and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import folder

#: Consecutive inner words of a quote by which it is looked up before it is compared.
PROBE = 3
#: Characters of the runs by which quotes of one or two words are looked up.
GRAM = 3


def numbered(rows: DataFrame, group: str, order: str, block: Column | None = None) -> DataFrame:
    """``pos`` from 1 in each group, by ``order`` (whole numbers), though a group may hold most rows.

    Rows are counted by blocks of 1024 consecutive values of ``order``; a row's place is that of its block plus its place in it.
    Null is a group, and the first place, of its own.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / 1024) if block is None else block)
    sizes = blocked.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(group).alias("_group"), F.col("_block").alias("_at"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(order))
    placed = blocked.withColumn("_in", inside).join(starts, F.col(group).eqNullSafe(F.col("_group")) & F.col("_block").eqNullSafe(F.col("_at")))
    return placed.withColumn("pos", (F.col("_before") + F.col("_in")).cast("long")).drop("_block", "_in", "_before", "_group", "_at")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a written table, for what is asked for more than once."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def containing(quotes: DataFrame, texts: DataFrame, quote_id: str, quote_col: str, text_id: str, text_col: str) -> DataFrame:
    """(quote_id, text_id) of each text that contains a quote once both are in the normal form of quotes.

    Instead of comparing every pair, the least frequent of a quote's inner runs of three words is looked up among the texts'
    runs, and only texts that have it are searched. Quotes of fewer than five words have no inner run that must be whole in a
    text; each is looked up by its longest inner word. Those of one or two words may stand inside other words and are looked up by
    the rarest of their runs of three characters, those of one or two characters by the characters.
    """
    q = quotes.select(F.col(quote_id).alias("_qid"), T.normal(F.col(quote_col)).alias("_q")).where("_q <> ''").withColumn("_w", _words(F.col("_q")))
    t = texts.select(F.col(text_id).alias("_tid"), T.normal(F.col(text_col)).alias("_t")).withColumn("_w", _words(F.col("_t")))
    inner = F.slice("_w", F.lit(2), F.size("_w") - 2)
    long = q.where(F.size("_w") >= PROBE + 2).select("_qid", "_q", F.explode(_runs(inner, PROBE)).alias("_run"))
    wanted = long.select("_run").distinct()
    runs = t.where(F.size("_w") >= PROBE).select("_tid", F.explode(F.array_distinct(_runs(F.col("_w"), PROBE))).alias("_run")).join(wanted, "_run", "left_semi")
    runs = _kept(runs, "runs")  # asked for twice
    often = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    rarest = long.join(often, "_run", "left").groupBy("_qid", "_q").agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)), F.col("_run"))).alias("_run"))
    by_run = rarest.join(runs, "_run").select("_qid", "_q", "_tid")
    middling = q.where((F.size("_w") < PROBE + 2) & (F.size("_w") >= 3)).select("_qid", "_q", F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(-F.length(w), w.alias("w")))), 1)["w"].alias("_word"))
    met = by_run
    if not middling.isEmpty():
        words = t.select("_tid", F.explode(F.array_distinct("_w")).alias("_word")).join(middling.select("_word").distinct(), "_word", "left_semi")
        met = met.unionByName(middling.join(words, "_word").select("_qid", "_q", "_tid"))
    near = met.distinct().join(t.select("_tid", "_t"), "_tid").where(F.col("_t").contains(F.col("_q")))
    # One or two words may stand inside other words, so they are looked up by characters.
    short = q.where(F.size("_w") < 3).select("_qid", "_q")
    grams = lambda text, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    found = near.select("_qid", "_tid")
    if short.isEmpty():
        return found.select(F.col("_qid").alias(quote_id), F.col("_tid").alias(text_id))
    size = F.least(F.length("_q"), F.lit(GRAM))
    asked = short.select("_qid", "_q", F.explode(F.array_distinct(grams(F.col("_q"), size))).alias("_run"))
    wanted_runs = asked.select("_run").distinct()
    pieces = F.flatten(F.array(*(grams(F.col("_t"), n) for n in range(1, GRAM + 1))))
    texts_of = t.select("_tid", F.explode(F.array_distinct(pieces)).alias("_run")).join(wanted_runs, "_run", "left_semi")
    texts_of = _kept(texts_of, "grams")
    count = texts_of.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    least = asked.join(count, "_run", "left").groupBy("_qid", "_q").agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)), F.col("_run"))).alias("_run"))
    by_gram = least.join(texts_of, "_run").select("_qid", "_q", "_tid").join(t.select("_tid", "_t"), "_tid").where(F.col("_t").contains(F.col("_q")))
    found = found.unionByName(by_gram.select("_qid", "_tid"))
    return found.select(F.col("_qid").alias(quote_id), F.col("_tid").alias(text_id))


def first_covering(points: DataFrame, ranges: DataFrame, point: str, first: str, last: str, pos: str, by: tuple[str, ...], width: int = 16) -> DataFrame:
    """Each point with the first range (by ``pos``) that covers it: an equality join on cells of ``width`` numbers, then a check."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    met = points.withColumn("_cell", F.floor(F.col(point) / width)).join(cells, [*by, "_cell"]).where(F.col(point).between(F.col(first), F.col(last))).drop("_cell")
    keep = [c for c in points.columns]
    first_of = met.groupBy(*keep).agg(F.min_by(F.struct(*[c for c in ranges.columns if c not in keep]), pos).alias("_r"))
    return first_of.select(*keep, "_r.*")


def bracket_citations(answers: DataFrame, entries: DataFrame, by: tuple[str, ...], text_col: str) -> DataFrame:
    """Each [n] of an answer, once, with the n-th entry of its list; numbers without an entry are ``found`` = false."""
    cited = answers.select(*by, F.explode(F.array_sort(F.array_distinct(F.transform(T.matches(F.col(text_col), r"\[(\d{1,6})\]", 1), lambda x: x.cast("int"))))).alias("n"))
    return cited.join(entries, [*by, "n"], "left")


def donated(rows: DataFrame, key: Column, value: str, pos: str, by: tuple[str, ...]) -> DataFrame:
    """Rows without a value take that of the first row (by ``pos``) with an equal key in their group."""
    keyed = rows.withColumn("_key", key)
    donors = keyed.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*by, "_key").agg(F.min_by(value, pos).alias("_given"))
    return keyed.join(donors, [*by, "_key"], "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.col("_given"))).drop("_key", "_given")
