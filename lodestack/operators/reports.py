"""Report assembly: which groups are shown, in which order, and what is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EDGE
from .ranking import top_k


def core_points(groups: DataFrame, by: str, n: int = 8, least: int = 5) -> DataFrame:
    """Groups of high importance by total, the first n of each paper."""
    return top_k(groups.where(F.col("importance") >= least), n, (by,), (F.desc("total"), F.asc("pos")))


def section_views(groups: DataFrame, by: str, shown_from: int = 4) -> DataFrame:
    """Groups with the place of their section in its paper (by first appearance) and whether they are shown or folded.

    One row a group, which is shown in the order importance, total (both falling), pos: no section is gathered in one place.
    """
    first = groups.groupBy(by, "section").agg(F.min("pos").alias("_first"))
    place = first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_first"))).drop("_first")
    return groups.join(place, [by, "section"]).withColumn("shown", F.col("importance") >= shown_from)


def remaining(candidates: DataFrame, yes: DataFrame, unclear: DataFrame, key: str) -> DataFrame:
    """The candidates that are neither yes nor unclear."""
    return candidates.join(yes.select(key), key, "left_anti").join(unclear.select(key), key, "left_anti")


def flagged_in_every_round(flags: DataFrame, key: str, round_col: str, rounds: int) -> DataFrame:
    return flags.groupBy(key).agg(F.countDistinct(round_col).alias("rounds")).where(F.col("rounds") == rounds)


def capped_with_backfill(paths: DataFrame, cap: int, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """At most max(cap, ceil(k / owners)) of each owner; what is missing to k comes from the rest in global order."""
    w = Window.partitionBy(*by)
    owners = paths.groupBy(*by).agg(F.countDistinct("owner").alias("_o"))
    rows = paths.join(owners, list(by)).withColumn("_limit", F.greatest(F.lit(cap), F.ceil(F.lit(k) / F.col("_o"))))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "owner").orderBy("rank"))).withColumn("_late", (F.col("_in") > F.col("_limit")).cast("int"))
    return rows.withColumnRenamed("rank", "rank_before").withColumn("rank", F.row_number().over(w.orderBy("_late", "rank_before"))).where(F.col("rank") <= k).withColumn("backfilled", F.col("_late") == 1).drop("_o", "_limit", "_in", "_late")


def referential_cleanup(rows: DataFrame, refs: str, valid: DataFrame, by: str, cap: int = 5) -> DataFrame:
    """Unknown references are dropped and counted, known ones kept in order, at most ``cap``."""
    each = rows.select(by, F.posexplode_outer(refs).alias("_at", "_ref"))
    known = valid.select(F.col(valid.columns[0]).alias("_ref")).distinct().withColumn("_ok", F.lit(True))
    met = each.join(known, "_ref", "left")
    kept = F.slice(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("_at", "_ref"))))["_ref"], 1, cap)
    return met.groupBy(by).agg(kept.alias("kept"), F.count_if(F.col("_ref").isNotNull() & F.col("_ok").isNull()).alias("dropped"))


def _parts(path: Column) -> Column:
    """The components of a path, its extension left out, spaces trimmed and either slash taken."""
    bare = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.filter(F.split(bare, "/"), lambda x: (x != "") & (x != "."))


def _suffixes(parts: Column) -> Column:
    """(n, key) of the last n components, for every n."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, -n, n), "/").alias("key")))


def tolerant_cleanup(rows: DataFrame, refs: str, valid: DataFrame, by: str, cap: int = 5) -> DataFrame:
    """``referential_cleanup`` of paths: (by, kept, dropped), where a reference may lack its extension or leading folders, or have some more.

    A reference means the path it equals; else one that ends with the whole of it; else the longest path that is the end of it; of several the
    smallest. Endings are keys of an equality join, and of each ending only its smallest path is kept, so a name that many paths share makes no pairs.
    Each path is kept once, where it is first meant; empty references count as unknown.
    """
    known = valid.select(F.col(valid.columns[0]).alias("_id")).where("_id is not null").distinct().withColumn("_p", _parts(F.col("_id"))).where(F.size("_p") > 0)
    ends = known.select("_id", F.size("_p").alias("_size"), F.explode(_suffixes(F.col("_p"))).alias("_s"))
    of_key = ends.groupBy(F.col("_s.key").alias("_key")).agg(F.min("_id").alias("_ending"), F.min(F.when(F.col("_s.n") == F.col("_size"), F.col("_id"))).alias("_whole"))
    each = rows.select(by, F.posexplode_outer(refs).alias("_at", "_ref")).withColumn("_p", _parts(F.col("_ref")))
    asked = each.select(by, "_at", "_ref", F.size("_p").alias("_size"), F.explode_outer(F.when(F.size("_p") > 0, _suffixes(F.col("_p")))).alias("_s"))
    met = asked.join(of_key, F.col("_s.key") == F.col("_key"), "left")
    same = valid.select(F.col(valid.columns[0]).alias("_same")).distinct()
    # 2: the whole reference is known or the ending of a path; 1: a path is the ending of the reference, the longest first.
    found = F.when((F.col("_s.n") == F.col("_size")) & F.col("_ending").isNotNull(), F.struct(F.lit(2).alias("how"), F.col("_s.n").alias("n"), F.coalesce("_whole", "_ending").alias("id"))).when(F.col("_whole").isNotNull(), F.struct(F.lit(1).alias("how"), F.col("_s.n").alias("n"), F.col("_whole").alias("id")))
    meant = met.groupBy(by, "_at", "_ref").agg(F.max(found)["id"].alias("_id")).join(same, F.col("_ref") == F.col("_same"), "left").withColumn("_id", F.coalesce("_same", "_id"))
    first = meant.groupBy(by, "_id").agg(F.min("_at").alias("_at"), F.count_if(F.col("_ref").isNotNull()).alias("_n"))
    kept = F.slice(F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_at", "_id"))))["_id"], 1, cap)
    return first.groupBy(by).agg(kept.alias("kept"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_n"))), F.lit(0)).alias("dropped"))


def dual_judgement(a: Column, b: Column, third: Column) -> Column:
    """Two judges who agree settle it; else the third does, and without one it is unclear."""
    return F.when(a == b, a).otherwise(F.coalesce(third, F.lit("unclear")))


def query_plan(original: Column, subqueries: Column, variants: Column, n: int) -> Column:
    """The queries to run: original, parts, variants; trimmed, each once, the first n."""
    every = F.concat(F.array(original), F.coalesce(subqueries, F.array().cast("array<string>")), F.coalesce(variants, F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(F.transform(every, lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))), 1, n)


#: Levels of query expansion that exist; asking for another is an error.
LEVELS = ("l3", "l5", "l6")


def check_levels(levels: tuple[str, ...]) -> tuple[str, ...]:
    unknown = [x for x in levels if x not in LEVELS]
    if unknown:
        raise NotImplementedError(f"query expansion levels not implemented: {unknown}")
    return levels


#: Flagged claims beyond this share cast doubt on the flagging.
ABNORMAL = 0.3


def too_noisy(flagged: Column, every: Column) -> Column:
    """Whether so many claims are flagged that a person should look at it before they go."""
    return (every > 0) & (flagged / every > ABNORMAL)


def material(rows: DataFrame, n: int, focus: DataFrame | None = None) -> DataFrame:
    """(paper, key, score, rank): the n best keys of each paper, of the papers in focus if any are named."""
    kept = rows if focus is None else rows.join(focus.select("paper"), "paper", "left_semi")
    return top_k(kept, n, ("paper",), (F.desc("score"), F.asc("key")))


def listing(rows: DataFrame, unclear: int = 5, by: str = "qid") -> DataFrame:
    """(by, key, verdict, place, unshown): accepted keys by rank, then the first ``unclear`` undecided ones with the number of those left out.

    Rejected keys are not listed, and undecided ones never count as rejected.
    """
    w = Window.partitionBy(by)
    of_kind = F.count(F.lit(1)).over(Window.partitionBy(by, "verdict"))
    numbered = rows.where(F.col("verdict") != "no").withColumns({"_n": F.row_number().over(Window.partitionBy(by, "verdict").orderBy("rank")), "_all": of_kind})
    kept = numbered.where((F.col("verdict") == "yes") | (F.col("_n") <= unclear))
    unshown = F.when(F.col("verdict") == "unclear", F.greatest(F.col("_all") - unclear, F.lit(0)))
    return kept.select(by, "key", "verdict", F.row_number().over(w.orderBy(F.col("verdict") == "unclear", "rank")).alias("place"), unshown.alias("unshown"))


# Ordinals in words, and the patterns that name a paper by its place in the corpus.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth")
PLACES = tuple(f"{EDGE}{p}{EDGE}" for p in (r"paper (\d{1,3})", r"(\d{1,3})(?:st|nd|rd|th) paper", r"paper ([a-z])", "(" + "|".join(ORDINALS) + ") paper"))


def focus(questions: DataFrame, papers: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, paper) of papers that a question names, by place or by name; a question that names none has no row.

    questions: (qid, question), papers: (paper, no), names: (paper, name), names of any number of words. A name inside a longer
    name of another paper that the question also holds does not count. Questions and names meet by equality of word runs,
    as long as the longest name (a number that the driver reads).
    """
    low = F.lower("question")
    number = F.coalesce(F.col("_m").try_cast("int"), F.when(F.length("_m") == 1, F.ascii("_m") - 96), F.nullif(F.array_position(F.array(*map(F.lit, ORDINALS)), F.col("_m")), F.lit(0)).cast("int"))
    said = questions.select("qid", F.explode(F.flatten(F.array(*(F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in PLACES)))).alias("_m")).select("qid", number.alias("no"))
    by_place = said.join(papers, "no").select("qid", "paper")
    tokens = F.regexp_extract_all(F.lower("name"), F.lit(r"[a-z0-9_-]+"), F.lit(0))
    called = names.select("paper", F.array_join(tokens, " ").alias("_name"), F.size(tokens).alias("_n"))
    longest = called.agg(F.max("_n")).first()[0] or 0
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9_-]+"), F.lit(0))
    runs = lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " ")))
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(runs(n), F.array().cast("array<string>")) for n in range(1, longest + 1))))) if longest else F.array().cast("array<string>")
    met = questions.select("qid", words.alias("_w")).select("qid", F.explode(every).alias("_name")).join(called, "_name").select("qid", "paper", "_name").distinct()
    held = met.groupBy("qid").agg(F.collect_set(F.struct("paper", "_name")).alias("_all"))
    inside = F.exists("_all", lambda o: (o["paper"] != F.col("paper")) & o["_name"].contains(F.col("_name")))
    return met.join(held, "qid").where(~inside).select("qid", "paper").unionByName(by_place).distinct()


def focused(questions: DataFrame, papers: DataFrame, qid: str = "qid", text: str = "question", paper: str = "paper", name: str = "name") -> DataFrame:
    """(qid, paper) of papers that a question names; a name inside a longer name that is also there does not count.

    Names are single tokens here: question and names meet by equality on tokens, so no question is compared with every paper.
    """
    words = questions.select(qid, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\w-]+"), F.lit(0)))).alias("_w"))
    met = words.join(papers.select(paper, F.lower(name).alias("_w")), "_w")
    held = met.groupBy(qid).agg(F.collect_set("_w").alias("_all"))
    inside = F.exists("_all", lambda o: (o != F.col("_w")) & o.contains(F.col("_w")))
    return met.join(held, qid).where(~inside).select(qid, paper)
