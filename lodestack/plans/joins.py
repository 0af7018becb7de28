"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import patterns as M
from ..operators import ranking as R
from .ranking import PATHS, paths
from .registry import query, table


@query("""select coalesce(d.doc_id, p.page_id) as id, coalesce(nullif(d.text, ''), p.html) = d.text as from_text,
  case when d.doc_id is not null and p.page_id is not null then 'both' when d.doc_id is not null then 'text' else 'page' end as origin, length(coalesce(nullif(d.text, ''), p.html, '')) as n_chars
from documents d full outer join pages p on p.page_id = d.doc_id""")
def corpus_merge(spark, d):
    docs, pages = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "pages").select("page_id", "html")
    both = docs.join(pages, docs.doc_id == pages.page_id, "full_outer")
    best = F.coalesce(F.nullif("text", F.lit("")), "html")
    origin = F.when(F.col("doc_id").isNotNull() & F.col("page_id").isNotNull(), "both").when(F.col("doc_id").isNotNull(), "text").otherwise("page")
    return both.select(F.coalesce("doc_id", "page_id").alias("id"), (best == F.col("text")).alias("from_text"), origin.alias("origin"), F.length(F.coalesce(best, F.lit(""))).cast("long").alias("n_chars"))


@query("select o_orderkey, o_custkey, c_nationkey, c_mktsegment from orders join customer on c_custkey = o_custkey")
def lookup_join(spark, d):
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).drop("c_custkey")


@query("""with g as (select conv_id as qid, unnest([conv_id * 3, conv_id * 7 + turn]) as gold from conversations),
f as (select qid, gold, doc_id is not null as found from (select distinct qid, gold from g) left join documents on doc_id = gold)
select qid, count(*) as n_gold, bool_and(found) as complete from f group by qid""")
def gold_foreign_keys(spark, d):
    gold = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.explode(F.array(F.col("conv_id") * 3, F.col("conv_id") * 7 + F.col("turn"))).alias("gold")).distinct()
    known = table(spark, d, "documents").select(F.col("doc_id").alias("gold"), F.lit(True).alias("found")).distinct()
    return gold.join(known, "gold", "left").groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"), F.bool_and(F.coalesce("found", F.lit(False))).alias("complete"))


_NORM = "trim(regexp_replace(lower({0}), '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g'))"
_ALNUM = "regexp_replace(" + _NORM + ", '[^a-z0-9]+', '', 'g')"


@query(f"""with c as (select doc_id, text, case doc_id % 4 when 0 then substr(text, 11, 60) when 1 then regexp_replace(substr(text, 11, 60), '[ ,.]', '-', 'g') when 2 then 'zzz' || substr(text, 11, 60) else substr(text, 3, 20) || ' ... ' || substr(text, 31, 20) end as quote from documents),
n as (select doc_id, {_NORM.format('quote')} as q, {_NORM.format('text')} as t, {_ALNUM.format('quote')} as qa, {_ALNUM.format('text')} as ta from c),
p as (select *, list_filter(list_transform(string_split_regex(q, '\\.{{3}}'), lambda s: trim(s)), lambda s: s <> '') as parts from n)
select doc_id, case when q = '' then 'miss' when contains(t, q) then 'hit' when qa <> '' and contains(ta, qa) then 'hit' when len(parts) > 1 and len(list_filter(parts, lambda s: not contains(t, s))) = 0 then 'loose' else 'miss' end as state from p""")
def evidence_state(spark, d):
    """Claims carry their chunk's key and a quote: verbatim, with other marks, altered, or in two parts."""
    part = lambda a, n: F.substring("text", a, n)
    kind = F.col("doc_id") % 4
    quote = F.when(kind == 0, part(11, 60)).when(kind == 1, F.regexp_replace(part(11, 60), "[ ,.]", "-")).when(kind == 2, F.concat(F.lit("zzz"), part(11, 60))).otherwise(F.concat(part(3, 20), F.lit(" ... "), part(31, 20)))
    docs = table(spark, d, "documents")
    claims = docs.select(F.col("doc_id").alias("chunk"), quote.alias("quote"))
    return claims.join(docs, claims.chunk == docs.doc_id).select("doc_id", T.evidence_state(F.col("quote"), F.col("text")).alias("state"))


@query(f"""select i.item_id, min(d.doc_id) as first_doc, count(*) as n_docs from (select item_id, {_NORM.format('text')} as q from benchmark) i join (select doc_id, {_NORM.format('text')} as t from documents) d on contains(d.t, i.q) where i.q <> '' group by 1""")
def locate_quote(spark, d):
    met = J.containing(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text")
    return met.groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))


@query(f"""with q as (select item_id, 1 as tier, text as quote from benchmark
  union all select item_id, 2, unnest(string_split(text, chr(10))) from benchmark
  union all select item_id, 3, substr(text, 1, 80) from benchmark),
n as (select item_id, tier, {_NORM.format('quote')} as q from q where tier <> 2 or length({_NORM.format('quote')}) >= 20),
m as (select n.item_id, n.tier, d.doc_id from n join (select doc_id, {_NORM.format('text')} as t from documents) d on contains(d.t, n.q) where n.q <> ''),
b as (select item_id, min(tier) as tier from m group by 1)
select distinct m.item_id, m.tier, m.doc_id from m join b on b.item_id = m.item_id and b.tier = m.tier""")
def tiered_location(spark, d):
    """Where a passage stands: whole, else by its longer lines, else by its first 80 characters."""
    b = table(spark, d, "benchmark")
    line = b.select("item_id", F.lit(2).alias("tier"), F.explode(F.split("text", "\n")).alias("quote"))
    quotes = b.select("item_id", F.lit(1).alias("tier"), F.col("text").alias("quote")).unionByName(line.where(F.length(T.normal(F.col("quote"))) >= 20)).unionByName(b.select("item_id", F.lit(3).alias("tier"), F.substring("text", 1, 80).alias("quote")))
    keyed = quotes.distinct().withColumn("quote_id", F.xxhash64("item_id", "tier", "quote"))
    met = J.containing(keyed, table(spark, d, "documents"), "quote_id", "quote", "doc_id", "text").join(keyed.select("quote_id", "item_id", "tier"), "quote_id")
    return R.first_nonempty_tier(met, F.col("tier"), ("item_id",)).select("item_id", "tier", "doc_id").distinct()


_VALUES = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 10))"


@query(f"""with v as (select item_id, {_VALUES} as vals from benchmark), t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as words from documents)
select v.item_id, t.doc_id, cast(len(vals) as bigint) as n_values from v join t on list_has_all(t.words, v.vals) where len(vals) > 0""")
def value_cooccurrence(spark, d):
    """Documents that hold all values of a fact: values and words meet by equality, and matches are counted."""
    vals = F.array_distinct(F.filter(T.latin_tokens(F.col("text")), lambda w: F.length(w) >= 10))
    facts = table(spark, d, "benchmark").select("item_id", vals.alias("vals")).where(F.size("vals") > 0)
    each = facts.select("item_id", F.size("vals").cast("long").alias("n_values"), F.explode("vals").alias("word"))
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.latin_tokens(F.col("text")))).alias("word")).join(each.select("word").distinct(), "word", "left_semi")
    return each.join(words, "word").groupBy("item_id", "doc_id", "n_values").agg(F.count(F.lit(1)).alias("n")).where("n = n_values").drop("n")


@query(PATHS + """, e as (select p.qid, p.key as seed, p.rank, l.l_partkey as cited, l.l_linenumber as pos from paths p join lineitem l on l.l_orderkey = p.key where p.route = 'length' and p.rank <= 20),
u as (select qid, seed as key, rank * 100 as spot from e union all select qid, cited, 1000000 + rank * 100 + pos from e),
f as (select qid, key, min(spot) as spot from u group by 1, 2)
select qid, key, cast(row_number() over (partition by qid order by spot, key) as integer) as rank from f""")
def citation_neighbours(spark, d):
    seeds = paths(spark, d).where("route = 'length' and rank <= 20").select("qid", F.col("key").alias("seed"), "rank")
    edges = seeds.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seed"), F.col("l_partkey").alias("cited"), "l_linenumber"), "seed")
    both = edges.select("qid", F.col("seed").alias("key"), (F.col("rank") * 100).cast("long").alias("spot")).unionByName(edges.select("qid", F.col("cited").alias("key"), (1_000_000 + F.col("rank") * 100 + F.col("l_linenumber")).cast("long").alias("spot")))
    first = both.groupBy("qid", "key").agg(F.min("spot").alias("spot"))
    return R.ranked(first, ("qid",), (F.asc("spot"), F.asc("key"))).select("qid", "key", "rank")


_ANSWERS = "select conv_id, turn, 'See [' || (turn + 1) || '], [' || (conv_id % 6 + 1) || '] and again [' || (turn + 1) || ']. ' || text as answer from conversations"


@query(f"""with a as ({_ANSWERS}), c as (select conv_id, turn, cast(unnest(list_distinct(regexp_extract_all(answer, '\\[(\\d{{1,6}})\\]', 1))) as integer) as n from a),
e as (select conv_id, cast(row_number() over (partition by conv_id order by turn, role, text) as integer) as n, length(text) as n_chars from conversations)
select c.conv_id, c.turn, c.n, e.n_chars, e.n is not null as found from c left join e on e.conv_id = c.conv_id and e.n = c.n""")
def bracket_citations(spark, d):
    conv = table(spark, d, "conversations")
    answer = F.concat(F.lit("See ["), F.col("turn") + 1, F.lit("], ["), F.col("conv_id") % 6 + 1, F.lit("] and again ["), F.col("turn") + 1, F.lit("]. "), F.col("text"))
    entries = R.ranked(conv, ("conv_id",), (F.asc("turn"), F.asc("role"), F.asc("text")), "n").select("conv_id", "n", F.length("text").cast("long").alias("n_chars"), F.lit(True).alias("found"))
    answers = conv.select("conv_id", "turn", answer.alias("answer"))
    cited = answers.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(T.matches(F.col("answer"), r"\[(\d{1,6})\]", 1), lambda x: x.cast("int")))).alias("n"))
    return cited.join(entries, ["conv_id", "n"], "left").select("conv_id", "turn", "n", "n_chars", F.coalesce("found", F.lit(False)).alias("found"))


@query("""with e as (select source as p, doc_id % 400 as cid, min(doc_id) as doc from documents group by 1, 2),
u as (select *, count(*) over (partition by cid) as owners from e),
a as (select doc_id as qid, case when doc_id % 2 = 0 then source end as p, (doc_id * 7) % 400 as cid from documents)
select a.qid, a.cid, min(coalesce(x.doc, y.doc)) as doc, coalesce(min(x.doc), min(y.doc)) is not null as resolved
from a left join u x on a.p is not null and x.p = a.p and x.cid = a.cid left join u y on a.p is null and y.cid = a.cid and y.owners = 1 group by 1, 2""")
def anchor_citations(spark, d):
    """Anchors name a chunk with or without its document; without, only a chunk id of one document resolves."""
    docs = table(spark, d, "documents")
    entries = docs.groupBy(F.col("source").alias("p"), (F.col("doc_id") % 400).alias("cid")).agg(F.min("doc_id").alias("doc"))
    alone = entries.groupBy("cid").agg(F.min("doc").alias("only"), F.count(F.lit(1)).alias("owners")).where("owners = 1").drop("owners")
    anchors = docs.select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("p"), (F.col("doc_id") * 7 % 400).alias("cid"))
    met = anchors.join(entries, ["p", "cid"], "left").join(alone, "cid", "left")
    doc = F.coalesce("doc", F.when(F.col("p").isNull(), F.col("only")))
    return met.select("qid", "cid", doc.alias("doc"), doc.isNotNull().alias("resolved"))


@query("""select r.r_name, n.n_name, count(distinct c.c_custkey) as customers, count(o.o_orderkey) as orders from region r left join nation n on n.n_regionkey = r.r_regionkey left join customer c on c.c_nationkey = n.n_nationkey left join orders o on o.o_custkey = c.c_custkey group by 1, 2""")
def index_join_chain(spark, d):
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    own = c.select("c_custkey", "c_nationkey").join(per, c.c_custkey == per.o_custkey, "left").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"))
    joined = r.join(n, r.r_regionkey == n.n_regionkey, "left").join(own, n.n_nationkey == own.c_nationkey, "left")
    return joined.select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""with c as (select source, doc_id % 9 as num, min(doc_id % 12) as page from documents group by 1, 2),
b as (select source, doc_id, (doc_id * 5) % 12 as page, case when doc_id % 10 = 0 then 'Figure ' || (doc_id % 9) || ' ' else 'As Figure ' || (doc_id % 9) || ' shows, ' end || text as text from documents),
n as (select source, doc_id, page, try_cast(unnest(regexp_extract_all(text, 'Figure (\\d+)', 1)) as bigint) as num from b where not starts_with(text, 'Figure') and length(text) > 15),
m as (select distinct source, doc_id, page, num from n)
select m.source, m.num, m.doc_id, m.page from m join c on c.source = m.source and c.num = m.num and m.page >= c.page - 1""")
def figure_references(spark, d):
    docs = table(spark, d, "documents")
    num = F.col("doc_id") % 9
    captions = docs.groupBy("source", num.alias("num")).agg(F.min(F.col("doc_id") % 12).alias("caption_page"))
    said = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Figure "), num, F.lit(" "))).otherwise(F.concat(F.lit("As Figure "), num, F.lit(" shows, ")))
    blocks = docs.select("source", "doc_id", (F.col("doc_id") * 5 % 12).alias("page"), F.concat(said, "text").alias("text"))
    mentions = F.array_distinct(F.transform(T.matches(F.col("text"), r"Figure (\d+)", 1), lambda n: n.try_cast("long")))
    body = blocks.where(~F.col("text").startswith("Figure") & (F.length("text") > 15)).withColumn("num", F.explode(mentions))
    return body.join(captions, ["source", "num"]).where("page >= caption_page - 1").select("source", "num", "doc_id", "page")


@query("""with t as (select conv_id, turn, role || '|' || (turn % 2) as k, case when turn % 3 = 0 then substr(text, 1, 20) else '' end as caption from conversations),
f as (select conv_id, k, arg_min(caption, turn) as given from t where caption <> '' group by 1, 2)
select t.conv_id, t.turn, coalesce(nullif(t.caption, ''), f.given) as caption from t left join f on f.conv_id = t.conv_id and f.k = t.k""")
def donor_caption(spark, d):
    """Tables without a caption take that of the first one with equal header cells in their document."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 20)).otherwise("").alias("caption"))
    return J.donated(t, F.concat_ws("|", "role", (F.col("turn") % 2).cast("string")), "caption", "turn", ("conv_id",)).select("conv_id", "turn", "caption")


@query("""with r as (select source, doc_id as pos, doc_id % 97 as a, doc_id % 97 + doc_id % 5 as b from documents), p as (select distinct d.source, (l.doc_id * 3) % 101 as page from labels l join documents d using (doc_id))
select p.source, p.page, min(r.pos) as chunk from p join r on r.source = p.source and p.page between r.a and r.b group by 1, 2""")
def page_to_chunk(spark, d):
    docs = table(spark, d, "documents")
    ranges = docs.select("source", F.col("doc_id").alias("pos"), (F.col("doc_id") % 97).alias("a"), (F.col("doc_id") % 97 + F.col("doc_id") % 5).alias("b"))
    points = table(spark, d, "labels").select("doc_id").join(docs.select("doc_id", "source"), "doc_id").select("source", (F.col("doc_id") * 3 % 101).alias("page")).distinct()
    return J.first_covering(points, ranges, "page", "a", "b", "pos", ("source",)).select("source", "page", F.col("pos").alias("chunk"))


@query(PATHS + " select a.qid, a.key, a.rank as rank_a, b.rank as rank_b from paths a join paths b using (qid, key) where a.route = 'length' and b.route = 'hash'")
def same_question_pairs(spark, d):
    a, b = (paths(spark, d).where(F.col("route") == r).select("qid", "key", F.col("rank").alias(n)) for r, n in (("length", "rank_a"), ("hash", "rank_b")))
    return a.join(b, ["qid", "key"])


@query("select doc_id, n_chars from documents where doc_id not in (select doc_id from labels)")
def unlabelled_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id, n_chars from documents where doc_id in (select doc_id from labels where quality = 1)")
def valid_semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("select 'doc' as corpus, doc_id as local_id, doc_id as id from documents union all select 'page', page_id, page_id + (select max(doc_id) + 1 from documents) from pages")
def concatenated_corpora(spark, d):
    docs, pages = table(spark, d, "documents").select("doc_id"), table(spark, d, "pages").select("page_id")
    offset = docs.agg((F.max("doc_id") + 1).alias("_o"))  # one row
    second = pages.join(F.broadcast(offset)).select(F.lit("page").alias("corpus"), F.col("page_id").alias("local_id"), (F.col("page_id") + F.col("_o")).alias("id"))
    return docs.select(F.lit("doc").alias("corpus"), F.col("doc_id").alias("local_id"), F.col("doc_id").alias("id")).unionByName(second)


@query("select doc_id as id from documents where lang = 'en' intersect select doc_id from labels where quality = 1")
def intersect_ids(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id")).intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("select source from documents except all select source from documents where lang = 'en'")
def except_all_sources(spark, d):
    s = table(spark, d, "documents")
    return s.select("source").exceptAll(s.where("lang = 'en'").select("source"))


@query("""with a as (select conv_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as w, turn, role, text from conversations), p as (select conv_id, turn, w, coalesce(lag(w) over (partition by conv_id order by turn, role, text), []) as v from a)
select conv_id, turn, cast(len(list_intersect(w, v)) as bigint) as n_both, cast(len(w) - len(list_intersect(w, v)) as bigint) as n_new, cast(len(w) + len(v) - len(list_intersect(w, v)) as bigint) as n_any from p""")
def array_set_algebra(spark, d):
    from pyspark.sql import Window

    w = F.array_distinct(T.latin_tokens(F.col("text")))
    rows = table(spark, d, "conversations").withColumn("w", w).withColumn("v", F.coalesce(F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")), F.array().cast("array<string>")))
    n = lambda c: F.size(c).cast("long")
    return rows.select("conv_id", "turn", n(F.array_intersect("w", "v")).alias("n_both"), n(F.array_except("w", "v")).alias("n_new"), n(F.array_union("w", "v")).alias("n_any"))


@query("select doc_id, source, cast(rn as integer) as rank from (select doc_id, source, row_number() over (partition by source order by md5('7|' || doc_id), doc_id) as rn from documents) where rn <= 5")
def seeded_sample(spark, d):
    """Five documents a source, without replacement: those with the smallest seeded hash, so the same in every run."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    return R.top_k(docs, 5, ("source",), (F.asc("h"), F.asc("doc_id"))).select("doc_id", "source", "rank")


@query("""with o as (select doc_id as pos, md5(text) as h from documents), n as (select doc_id as pos, md5(text) as h from documents where doc_id <> 5 union all select max(doc_id) + 1, 'new' from documents)
select count(*) filter (n.pos is null) as lost, count(*) filter (n.pos is not null and n.h <> o.h) as changed, (select count(*) from n) > (select count(*) from o) as longer from o left join n using (pos)""")
def append_safety(spark, d):
    """Before an index is appended to: each old row must still stand at its place, and there must be more rows."""
    old = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.md5(F.col("text").cast("binary")).alias("h"))
    new = old.where("pos <> 5").unionByName(old.agg((F.max("pos") + 1).alias("pos")).withColumn("h", F.lit("new"))).withColumnRenamed("h", "h_new").withColumn("there", F.lit(1))
    met = old.withColumn("was", F.lit(1)).join(new, "pos", "full_outer")
    return met.agg(F.count_if(F.col("was").isNotNull() & F.col("there").isNull()).alias("lost"), F.count_if(F.col("was").isNotNull() & F.col("there").isNotNull() & (F.col("h") != F.col("h_new"))).alias("changed"), (F.count("there") > F.count("was")).alias("longer"))


@query("""with w as (select item_id, string_split(lower(text), ' ') as w from benchmark), r as (select item_id, unnest(range(1, len(w) - 1, 3)) as pos, w from w),
p as (select item_id, pos, array_to_string(w[pos:pos + 2], ' ') as pattern from r)
select item_id, cast(pos as integer) as pos, doc_id, cast(instr(lower(text), pattern) as integer) as first from p, (select doc_id, text from documents) where contains(lower(text), pattern)""")
def pattern_hits(spark, d):
    """Every third run of three words of every benchmark item, looked for in all documents in one pass."""
    w = table(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w")).where(F.size("w") > 2)
    runs = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 2, F.lit(3))).alias("pos"))
    patterns = runs.select(F.struct("item_id", "pos").alias("at"), F.array_join(F.slice("w", F.col("pos"), 3), " ").alias("pattern"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return M.occurrences(patterns, docs, "at", "pattern", "doc_id", "text").select("at.item_id", "at.pos", "doc_id", "first")
