"""Queries over ranked lists.

The lists are of documents: a query for each language, two routes (by length, and by a hash of the id, which stands for
an unrelated signal), 100 deep; a document's source is its owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as R
from .registry import query, table

DEPTH = 100

PATHS = """
with scored as (
  select lang as qid, 'length' as route, doc_id as key, source as owner, cast(n_chars as double) as score from documents
  union all
  select lang, 'hash', doc_id, source, round(cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 6) as bigint) / 16777216.0, 6) from documents),
paths as (select * from (select *, cast(row_number() over (partition by qid, route order by score desc, key) as integer) as rank from scored) where rank <= 100)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    hashed = F.round(F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("double") / 16777216.0, 6)
    both = F.explode(F.array(F.struct(F.lit("length").alias("route"), F.col("n_chars").cast("double").alias("score")), F.struct(F.lit("hash").alias("route"), hashed.alias("score"))))
    return table(spark, d, "documents").select(F.col("lang").alias("qid"), F.col("doc_id").alias("key"), F.col("source").alias("owner"), both.alias("_r")).select("qid", "_r.route", "key", "owner", "_r.score")


def paths(spark: SparkSession, d: str, depth: int = DEPTH) -> DataFrame:
    return R.top_k(scored(spark, d), depth, ("qid", "route"))


def one(spark: SparkSession, d: str, route: str = "length") -> DataFrame:
    return paths(spark, d).where(F.col("route") == route)


@query(PATHS + " select qid, route, key, score, rank from paths where rank <= 10")
def topk_per_query(spark, d):
    return R.top_k(scored(spark, d), 10, ("qid", "route")).select("qid", "route", "key", "score", "rank")


@query(PATHS + """
select l.qid, l.route, cast(coalesce(min(p.rank), 0) as integer) as position
from (select distinct qid, route from paths) l
left join (select p.* from paths p where key in (select doc_id from labels where toxic = 1)) p on p.qid = l.qid and p.route = l.route
group by l.qid, l.route""")
def position_of_first_target(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("key"))
    return R.position_of(paths(spark, d), toxic)


@query(PATHS + """, b as (select qid, route, key, floor(score / 500) as band from paths)
select qid, route, key, cast(band as bigint) as band, rank() over (partition by qid, route order by band desc) as rank_min,
  rank() over (partition by qid, route order by band desc) + (count(*) over (partition by qid, route, band) - 1) / 2.0 as rank_avg from b""")
def competition_and_average_ranks(spark, d):
    banded = paths(spark, d).select("qid", "route", "key", F.floor(F.col("score") / 500).cast("long").alias("band"))
    return R.competition_and_average_rank(banded, ("qid", "route"), "band")


@query(PATHS + """, f as (select qid, key, min(case when route = 'length' then rank else 1000 + rank end) as first_at from paths group by 1, 2)
select qid, key, cast(row_number() over (partition by qid order by first_at) as integer) as rank from f""")
def ordered_union_distinct(spark, d):
    at = F.when(F.col("route") == "length", F.col("rank")).otherwise(1000 + F.col("rank"))
    return R.first_seen(paths(spark, d).withColumn("at", at), ("qid",), "key", ("at",)).select("qid", "key", "rank")


@query(PATHS + """, c as (select *, row_number() over (partition by qid, route, owner order by rank) as n from paths),
r as (select *, cast(row_number() over (partition by qid, route order by rank) as integer) as new_rank from c where n <= 2)
select qid, route, key, owner, rank as rank_before, new_rank as rank from r where new_rank <= 12""")
def section_cap(spark, d):
    return R.capped(paths(spark, d), "owner", 2, 12).select("qid", "route", "key", "owner", "rank_before", "rank")


@query(PATHS + """, c as (select *, row_number() over (partition by qid, route, owner order by rank) as n from paths)
select qid, route, key, owner, rank as rank_before, cast(row_number() over (partition by qid, route order by rank) as integer) as rank from c where n <= 3""")
def owner_hard_cap(spark, d):
    return R.capped(paths(spark, d), "owner", 3).select("qid", "route", "key", "owner", "rank_before", "rank")


@query(PATHS + """, c as (select *, cast(row_number() over (partition by qid, route, owner order by rank) as integer) as in_owner from paths),
o as (select qid, route, owner, row_number() over (partition by qid, route order by max(score) desc, min(rank)) as owner_rank from paths group by 1, 2, 3)
select c.qid, c.route, c.owner, c.key, c.in_owner, cast(o.owner_rank as integer) as owner_rank from c join o using (qid, route, owner) where in_owner <= 2 and owner_rank <= 5""")
def best_of_top_owners(spark, d):
    return R.best_per_owner(paths(spark, d), 2, 5).select("qid", "route", "owner", "key", "in_owner", "owner_rank")


_EXT = PATHS + ", m as (select *, owner in ('src0', 'src1') as ext, row_number() over (partition by qid, route, owner in ('src0', 'src1') order by rank) as kind_rank from paths)"


@query(_EXT + """
select qid, route, key, rank as rank_before, cast(row_number() over (partition by qid, route order by rank > 10, rank) as integer) as rank
from m where rank <= 10 or (ext and kind_rank <= 2)""")
def external_quota_append(spark, d):
    return R.with_external(paths(spark, d), F.col("owner").isin("src0", "src1"), 10, 2).select("qid", "route", "key", "rank_before", "rank")


@query(_EXT + """
select qid, route, key, rank as rank_before, cast(row_number() over (partition by qid, route order by ext, rank) as integer) as rank
from m where (not ext and kind_rank <= 7) or (ext and kind_rank <= 3)""")
def external_quota_replace(spark, d):
    return R.with_external(paths(spark, d), F.col("owner").isin("src0", "src1"), 10, -3).select("qid", "route", "key", "rank_before", "rank")


_OWN = """, own as (select qid, owner, key, score, row_number() over (partition by qid, owner order by score desc, key) as r from scored where route = 'length')"""


@query(PATHS + _OWN + """, top as (select * from paths where route = 'length' and rank <= 12),
lacking as (select * from own o where r <= 1 and not exists (select 1 from top t where t.qid = o.qid and t.key = o.key)),
q as (select *, row_number() over (partition by qid order by owner, r, key) as n from lacking),
size as (select qid, max(rank) as size from top group by 1),
placed as (select q.qid, s.size - q.n + 1 as rank, q.key, q.owner, q.score from q join size s using (qid) where s.size - q.n + 1 >= 1)
select t.qid, t.rank, coalesce(p.key, t.key) as key, coalesce(p.owner, t.owner) as owner, coalesce(p.score, t.score) as score, p.key is not null as filled
from top t left join placed p on p.qid = t.qid and p.rank = t.rank""")
def floor_and_fill(spark, d):
    own = R.top_k(scored(spark, d).where("route = 'length'"), 1, ("qid", "owner"))
    return R.floor_fill(one(spark, d), own, 12, 1).select("qid", "rank", "key", "owner", "score", "filled")


def _layered_sql(fused: str) -> str:
    return PATHS + f""", s as (select *, row_number() over (partition by qid, owner order by rank) as ro, avg(score) over (partition by qid, owner) as mu, stddev_pop(score) over (partition by qid, owner) as sd from paths where route = 'length'),
f as (select *, round({fused}, 6) as fused from s)
select qid, key, cast(ro as integer) as rank_in_owner, fused, cast(row_number() over (partition by qid order by fused desc, score desc, key) as integer) as rank from f"""


def _layered(spark, d, mode):
    in_owner = R.ranked(one(spark, d).drop("rank"), ("qid", "owner"))
    return R.layered(in_owner, mode).select("qid", "key", "rank_in_owner", "fused", "rank")


@query(_layered_sql("1.0 / (60 + ro)"))
def layered_rrf(spark, d):
    return _layered(spark, d, "rrf")


@query(_layered_sql("case when sd > 1e-9 then (score - mu) / sd else 0 end"))
def layered_znorm(spark, d):
    return _layered(spark, d, "znorm")


@query(_layered_sql("score - mu"))
def layered_zmean(spark, d):
    return _layered(spark, d, "zmean")


@query(PATHS + """
select qid, route, key, round(case when stddev_pop(score) over w > 1e-9 then (score - avg(score) over w) / stddev_pop(score) over w else 0 end, 6) as z,
  round(case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end, 6) as minmax
from paths window w as (partition by qid, route)""")
def zscore_and_minmax(spark, d):
    return R.standardised(paths(spark, d)).select("qid", "route", "key", "z", "minmax")


@query("with recursive " + PATHS.strip()[5:] + """, sized as (select p.qid, p.route, p.rank, p.key, d.n_chars as size from paths p join documents d on d.doc_id = p.key),
walk as (
  select qid, route, 0 as rank, cast(null as bigint) as key, cast(0 as bigint) as used, false as kept, cast(0 as bigint) as size from (select distinct qid, route from paths)
  union all
  select w.qid, w.route, w.rank + 1, s.key, w.used + case when w.used + s.size <= 20000 then s.size else 0 end, w.used + s.size <= 20000, s.size
  from walk w join sized s on s.qid = w.qid and s.route = w.route and s.rank = w.rank + 1)
select qid, route, cast(rank as integer) as rank, key, size from walk where kept""")
def greedy_char_budget(spark, d):
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    return R.greedy_budget(paths(spark, d).join(sizes, "key"), "n_chars", 20_000)


@query(PATHS + """, s as (select p.*, d.n_chars, coalesce(sum(d.n_chars) over (partition by qid, route order by rank rows between unbounded preceding and 1 preceding), 0) as before from paths p join documents d on d.doc_id = p.key)
select qid, route, rank, key, cast(before as bigint) as before from s where before < 15000""")
def equal_budget_prefix(spark, d):
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    return R.within_budget(paths(spark, d).join(sizes, "key"), "n_chars", 15_000).select("qid", "route", "rank", "key", "before")


@query(PATHS + """, j as (select p.qid, p.key, d.text, contains(lower(d.text), 'the') as anchor, case when p.rank > 90 then null else p.score end as q_sim, p.rank as pos
  from paths p join documents d on d.doc_id = p.key where p.route = 'hash'),
o as (select *, row_number() over (partition by qid order by anchor desc, q_sim desc nulls first, pos) as place,
  coalesce(sum(length(text)) over (partition by qid order by anchor desc, q_sim desc nulls first, pos rows between unbounded preceding and 1 preceding), 0) as before from j)
select qid, key, cast(place as integer) as place, length(substr(text, 1, cast(4200 - before as integer))) as n_chars, md5(substr(text, 1, cast(4200 - before as integer))) as digest from o where before < 4200""")
def anchor_first_window(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    rows = one(spark, d, "hash").join(texts, "key").withColumn("anchor", F.lower("text").contains("the")).withColumn("q_sim", F.when(F.col("rank") <= 90, F.col("score")))
    order = (F.desc("anchor"), F.desc_nulls_first("q_sim"), F.asc("rank"))
    got = R.truncated_window(rows, "text", 4_200, ("qid",), order)
    return got.select("qid", "key", "place", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(PATHS + """
select l.qid, l.route, case when r.rank is null then 'none' when r.rank = 1 then '1' when r.rank <= 5 then '2-5' when r.rank <= 20 then '6-20' else '21-100' end as bucket, count(*) as n
from (select d.doc_id, d.lang as qid, t.route from documents d cross join (values ('length'), ('hash')) t(route)) l
left join paths r on r.qid = l.qid and r.route = l.route and r.key = l.doc_id group by 1, 2, 3""")
def rank_buckets(spark, d):
    every = scored(spark, d).select("qid", "route", "key")
    got = every.join(paths(spark, d).select("qid", "route", "key", "rank"), ["qid", "route", "key"], "left")
    return got.groupBy("qid", "route", R.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""with g as (select doc_id, source, length(text) > 2000 as narrative, 1 + doc_id % 5 as importance, n_chars as total from documents)
select source, doc_id, cast(rn as integer) as rank from (select *, row_number() over (partition by source order by narrative desc, importance desc, total desc, doc_id) as rn from g where importance >= 3) where rn <= 4""")
def report_pick(spark, d):
    g = table(spark, d, "documents").select("doc_id", "source", (F.length("text") > 2000).alias("narrative"), (1 + F.col("doc_id") % 5).alias("importance"), F.col("n_chars").alias("total")).where("importance >= 3")
    return R.top_k(g, 4, ("source",), (F.desc("narrative"), F.desc("importance"), F.desc("total"), F.asc("doc_id"))).select("source", "doc_id", "rank")


@query("""with t as (select source, doc_id, case when n_chars > 15000 then 1 when n_chars > 6000 then 2 when n_chars > 3000 then 3 end as tier from documents)
select t.source, t.doc_id, t.tier from t join (select source, min(tier) as tier from t group by 1) m on m.source = t.source and m.tier = t.tier""")
def relaxation_ladder(spark, d):
    tier = F.when(F.col("n_chars") > 15000, 1).when(F.col("n_chars") > 6000, 2).when(F.col("n_chars") > 3000, 3)
    return R.first_nonempty_tier(table(spark, d, "documents"), tier, ("source",)).select("source", "doc_id", "tier")


# How many edges of a kind a hub shows.
RELATION_CAPS = {"click": 4, "purchase": 6, "view": 3, "signup": 3}


@query("""with e as (select user_id as hub, event_type as relation, cast(floor(value) as bigint) as source, min(event_id) as pos from events group by 1, 2, 3),
r as (select *, row_number() over (partition by hub, relation order by pos) as rn from e)
select hub, relation, source, cast(rn as integer) as rank from r where rn <= case relation when 'click' then 4 when 'purchase' then 6 when 'view' then 3 when 'signup' then 3 else 3 end""")
def relation_caps(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("hub"), F.col("event_type").alias("relation"), F.floor("value").cast("long").alias("source")).agg(F.min("event_id").alias("pos"))
    cap = F.coalesce(F.create_map(*[F.lit(x) for kv in RELATION_CAPS.items() for x in kv])[F.col("relation")], F.lit(3))
    return R.ranked(e, ("hub", "relation"), (F.asc("pos"),)).where(F.col("rank") <= cap).select("hub", "relation", "source", "rank")


# How many groups of a label enter a prompt.
LABEL_CAPS = {0: 8, 1: 12}


@query("""with g as (select d.source, l.quality as label, d.doc_id, d.n_chars as total from documents d join labels l using (doc_id)),
r as (select *, row_number() over (partition by source, label order by total desc, doc_id) as rn from g)
select source, label, doc_id, cast(rn as integer) as rank from r where rn <= case label when 0 then 8 else 12 end""")
def label_caps(spark, d):
    g = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("total")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    cap = F.coalesce(F.create_map(*[F.lit(x) for kv in LABEL_CAPS.items() for x in kv])[F.col("label").cast("int")], F.lit(12))
    top = R.top_k(g, max(LABEL_CAPS.values()), ("source", "label"), (F.desc("total"), F.asc("doc_id")))
    return top.where(F.col("rank") <= cap).select("source", "label", "doc_id", "rank")


@query(PATHS + """
select p.qid, p.route, n.n, count(*) filter (l.quality = 1) as n_yes, count(*) as n_delivered
from paths p join labels l on l.doc_id = p.key join (values (5), (10), (20), (50), (100)) n(n) on p.rank <= n.n group by 1, 2, 3""")
def delivery_sweep(spark, d):
    judged = paths(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("key"), "quality"), "key")
    swept = judged.withColumn("n", F.explode(F.array(*map(F.lit, (5, 10, 20, 50, 100))))).where(F.col("rank") <= F.col("n"))
    return swept.groupBy("qid", "route", "n").agg(F.count_if(F.col("quality") == 1).alias("n_yes"), F.count(F.lit(1)).alias("n_delivered"))


@query("""select conv_id, turn, length(text) - lag(length(text)) over w as gap_before, lead(length(text)) over w - length(text) as gap_after
from conversations window w as (partition by conv_id order by turn, role, text)""")
def neighbour_gaps(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.length("text").cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", (n - F.lag(n).over(w)).alias("gap_before"), (F.lead(n).over(w) - n).alias("gap_after"))


@query("""select conv_id, turn, coalesce(max(case when length(text) > 600 then 1 else 0 end) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0) = 1 as after_long,
  last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as last_user_turn from conversations""")
def running_section_state(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.when(F.length("text") > 600, 1).otherwise(0)).over(before), F.lit(0)) == 1
    last = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "conversations").select("conv_id", "turn", seen.alias("after_long"), last.alias("last_user_turn"))


def _rrf_sql(weight: str, where: str) -> str:
    return PATHS + f""", f as (select qid, key, count(*) as n_routes, round(sum({weight} / (60 + rank)), 9) as score from paths where {where} group by 1, 2)
select qid, key, n_routes, score, cast(row_number() over (partition by qid order by score desc, key) as integer) as rank from f"""


@query(_rrf_sql("case route when 'length' then 0.7 else 0.3 end", "rank <= 50"))
def rrf_truncated(spark, d):
    return R.rrf(paths(spark, d), {"length": 0.7, "hash": 0.3}, depth=50).select("qid", "key", "n_routes", "score", "rank")


@query(_rrf_sql("case route when 'length' then 1.0 else 4.0 end", "case route when 'length' then rank <= 100 else rank <= 50 end"))
def multiroute_rrf(spark, d):
    return R.rrf(paths(spark, d), {"length": 1.0, "hash": 4.0}, depth={"length": 100, "hash": 50}).select("qid", "key", "n_routes", "score", "rank")


@query(PATHS + """, f as (select qid, key, round(sum(case when owner = 'src0' then (case route when 'length' then 1.5 else 0.5 end) else 1.0 end / (60 + rank)), 9) as score from paths group by 1, 2)
select qid, key, score, cast(row_number() over (partition by qid order by score desc, key) as integer) as rank from f""")
def external_weighted_rrf(spark, d):
    # External keys weigh (2a, 2 - 2a) on the two routes with a = 0.75, others (1, 1).
    ext = F.col("owner") == "src0"
    w = F.when(ext & (F.col("route") == "length"), 1.5).when(ext, 0.5).otherwise(1.0)
    fused = paths(spark, d).groupBy("qid", "key").agg(F.round(F.sum(w / (60 + F.col("rank"))), 9).alias("score"))
    return R.ranked(fused, ("qid",))


@query(PATHS + """, f as (select qid, key, case when route = 'hash' then 0 else 1 end as place, rank from paths where rank <= case route when 'hash' then 8 else 5 end),
g as (select qid, key, min(place * 1000 + rank) as spot from f group by 1, 2)
select qid, key, cast((spot - spot % 1000) / 1000 as integer) as first_place, cast(spot % 1000 as integer) as first_rank, cast(row_number() over (partition by qid order by spot) as integer) as rank from g""")
def quota_union(spark, d):
    return R.quota_union(paths(spark, d), {"hash": 8, "length": 5}).select("qid", "key", "first_place", "first_rank", "rank")


@query()
def coverage_repair(spark, d):
    return R.coverage_repair(R.rrf(paths(spark, d)), 16)


@query(PATHS + """, a as (select * from paths where route = 'length' and owner <> 'src0'), old as (select qid, key, score, cast(row_number() over (partition by qid order by rank) as integer) as rank from a),
b as (select * from paths where route = 'length' and owner = 'src0'), new as (select qid, key, score, cast(row_number() over (partition by qid order by rank) as integer) as rank from b),
opened as (select n.qid from (select qid, max(score) as m from new group by 1) n left join (select qid, max(score) as m from old group by 1) o using (qid) where o.m is null or o.m - n.m < 3000),
u as (select qid, key, 0 as corpus, rank from old where rank <= 10 union all select qid, key, 1, rank from new where rank <= 10 and qid in (select qid from opened))
select qid, key, corpus, rank as rank_before, cast(row_number() over (partition by qid order by corpus, rank, key) as integer) as rank from u""")
def corpus_gate(spark, d):
    lists = one(spark, d).drop("rank", "route")
    old, new = (R.ranked(lists.where(c), ("qid",)) for c in ("owner <> 'src0'", "owner = 'src0'"))
    return R.gated(old, new, 3000.0, 10, 10).select("qid", "key", "corpus", "rank_before", "rank")


@query(PATHS + " select qid, route, k, count(*) filter (owner = 'src0') as intruders, count(*) filter (owner = 'src0') * 1.0 / k as rate from paths, (values (5), (10), (20)) t(k) where rank <= k group by 1, 2, 3")
def intrusion_rate(spark, d):
    swept = paths(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, (5, 10, 20))))).where(F.col("rank") <= F.col("k"))
    n = F.count_if(F.col("owner") == "src0")
    return swept.groupBy("qid", "route", "k").agg(n.alias("intruders"), (n * F.lit(1.0) / F.col("k")).alias("rate"))


_OUTSIDE = ", outside as (select qid, key, score from paths where route = 'hash'), base as (select * from paths where route = 'length')"


@query(PATHS + _OUTSIDE + """
select b.qid, b.key, b.rank as rank_before, cast(row_number() over (partition by b.qid order by b.rank > 30, case when b.rank <= 30 then coalesce(o.score, -1e9) end desc, b.rank) as integer) as rank
from base b left join outside o using (qid, key)""")
def pointwise_rerank(spark, d):
    return R.reranked(one(spark, d), one(spark, d, "hash"), 30).select("qid", "key", "rank_before", "rank")


@query(PATHS + _OUTSIDE + """, gold as (select doc_id from labels where quality = 1),
n as (select b.qid, c.c as depth, b.key, row_number() over (partition by b.qid, c.c order by case when b.rank <= c.c then 0 else 1 end, case when b.rank <= c.c then coalesce(o.score, -1e9) end desc, b.rank) as r, b.rank
  from base b cross join (values (10), (20), (50), (100)) c(c) left join outside o using (qid, key)),
m as (select qid, depth, count(*) filter (key in (select doc_id from gold) and rank <= depth) as in_pool, count(*) filter (key in (select doc_id from gold) and r <= 10) as hits10,
  coalesce(round(max(case when key in (select doc_id from gold) and r <= 10 then 1.0 / r end), 6), 0) as rr10 from n group by 1, 2)
select qid, depth, in_pool, hits10, rr10 from m""")
def rerank_depth_sweep(spark, d):
    from pyspark.sql import Window

    base = one(spark, d).select("qid", "key", "rank")
    outside = one(spark, d, "hash").select("qid", "key", F.col("score").alias("o"))
    gold = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key"), F.lit(True).alias("gold")).distinct()
    rows = base.join(outside, ["qid", "key"], "left").join(gold, "key", "left").withColumn("depth", F.explode(F.array(*map(F.lit, (10, 20, 50, 100)))))
    deep = F.col("rank") > F.col("depth")
    w = Window.partitionBy("qid", "depth").orderBy(deep, F.desc(F.when(~deep, F.coalesce("o", F.lit(-1e9)))), "rank")
    rows = rows.withColumn("r", F.row_number().over(w)).withColumn("gold", F.coalesce("gold", F.lit(False)))
    ten = F.col("gold") & (F.col("r") <= 10)
    return rows.groupBy("qid", "depth").agg(F.count_if(F.col("gold") & ~deep).alias("in_pool"), F.count_if(ten).alias("hits10"), F.coalesce(F.round(F.max(F.when(ten, 1.0 / F.col("r"))), 6), F.lit(0.0)).alias("rr10"))


@query(PATHS + """, pick as (select qid, key, rank as pick from paths where route = 'hash' and rank <= 5)
select b.qid, b.key, b.rank as rank_before, cast(row_number() over (partition by b.qid order by p.pick nulls last, b.rank) as integer) as rank
from paths b left join pick p using (qid, key) where b.route = 'length'""")
def head_replacement(spark, d):
    picked = one(spark, d, "hash").where("rank <= 5").select("qid", "key", F.col("rank").alias("pick"))
    return R.head_replaced(one(spark, d), picked).select("qid", "key", "rank_before", "rank")


@query(PATHS + """, e as (select p.qid, p.key as seed, p.rank, l.l_partkey % 500 as cited from paths p join lineitem l on l.l_orderkey = p.key where p.route = 'length' and p.rank <= 20),
v as (select qid, cited as key, round(sum(1.0 / rank), 6) as votes from (select distinct qid, seed, rank, cited from e) group by 1, 2)
select qid, key, votes, cast(row_number() over (partition by qid order by votes desc, key) as integer) as rank from v""")
def citation_votes(spark, d):
    seeds = one(spark, d).where("rank <= 20").select("qid", F.col("key").alias("seed"), "rank")
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seed"), (F.col("l_partkey") % 500).alias("key")).join(seeds, "seed").distinct()
    return R.ranked(edges.groupBy("qid", "key").agg(F.round(F.sum(1.0 / F.col("rank")), 6).alias("score")), ("qid",)).withColumnRenamed("score", "votes")


@query(PATHS + """, s as (select doc_id as key, source, lang, row_number() over (partition by source order by doc_id) as pos from documents),
w as (select key, source, pos, list(key) over (partition by source order by pos rows between 2 preceding and 2 following) as near from s)
select source, key, array_to_string(near, ',') as window_keys from w""")
def neighbour_window(spark, d):
    # A window of two documents to each side within a source: neighbours in the source's order are joined by place, so that no source is one group.
    from ..operators.joins import numbered

    docs = numbered(table(spark, d, "documents").select("source", F.col("doc_id").alias("key")), "source", "key")
    near = docs.withColumn("at", F.explode(F.expr("sequence(pos - 2, pos + 2)"))).select("source", F.col("at").alias("pos"), F.col("key").alias("near"))
    return docs.join(near, ["source", "pos"]).groupBy("source", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("near")), lambda x: x.cast("string")), ",").alias("window_keys"))


@query(PATHS + """, r as (select *, row_number() over (partition by qid, owner order by score desc, key) as n from paths where route = 'hash')
select qid, owner, key, score from r where n = 1""")
def window_centres(spark, d):
    return R.top_k(one(spark, d, "hash").drop("rank"), 1, ("qid", "owner")).select("qid", "owner", "key", "score")


def grow_windows(rows: DataFrame, max_radius: int, budget: int) -> DataFrame:
    """Centres of a list take turns: a window grows by one step a side while it adds keys and the budget of distinct keys holds.

    rows: (qid, section, pos, key, centre rank or null). One list of bounded depth is folded a group.
    """
    import pandas as pd

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        at = {(s, p): k for s, p, k in zip(part["section"], part["pos"], part["key"])}
        taken: dict[int, int] = {}
        for row in part.dropna(subset=["centre"]).sort_values("centre").itertuples():
            for radius in range(max_radius + 1):
                new = [k for p in range(int(row.pos) - radius, int(row.pos) + radius + 1) if (k := at.get((row.section, p))) is not None and k not in taken]
                if radius and not new or len(taken) + len(new) > budget:
                    break
                for k in new:
                    taken[k] = radius
        return pd.DataFrame({"qid": part["qid"].iloc[0], "key": list(taken), "radius": list(taken.values())})

    return rows.groupBy("qid").applyInPandas(fold, "qid string, key bigint, radius int")


@query()
def radius_growth(spark, d):
    top = one(spark, d, "hash").select("qid", F.col("owner").alias("section"), "key", F.when(F.col("rank") <= 8, F.col("rank")).alias("centre"))
    return grow_windows(R.ranked(top, ("qid", "section"), (F.asc("key"),), "pos"), 3, 24)
