"""Queries of evaluation metrics: rankings of documents against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evaluation as M
from .ranking import PATHS, paths
from .registry import query, table

GOLD = ", gold as (select distinct d.lang as qid, d.doc_id as key from documents d join labels l using (doc_id) where l.quality = 1)"


def gold(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("qid"), F.col("doc_id").alias("key"))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key"))
    return docs.join(good, "key", "left_semi").select("qid", "key").distinct()


@query(PATHS + GOLD + """, size as (select qid, count(*) as n_gold from gold group by 1),
j as (select p.*, g.key is not null as hit, coalesce(sum(cast(g.key is not null as integer)) over (partition by p.qid, p.route order by p.rank rows between unbounded preceding and 1 preceding), 0) as b from paths p left join gold g on g.qid = p.qid and g.key = p.key),
m as (select qid, route, k, count(*) filter (hit) as hits, count(*) as shown, min(rank) filter (hit) as first_hit, coalesce(sum(case when hit then pow(0.1, b) / log2(rank + 1) end), 0) as dcg from j, (values (5), (20), (50)) t(k) where rank <= k group by 1, 2, 3),
f as (select m.*, s.n_gold, hits * 1.0 / shown as p, hits * 1.0 / n_gold as r, (select sum(pow(0.1, i - 1) / log2(i + 1)) from range(1, cast(least(n_gold, k) as bigint) + 1) t(i)) as ideal from m join size s using (qid))
select qid, route, k, hits, round(r, 6) as recall, round(coalesce(1.0 / first_hit, 0), 6) as rr, hits = least(n_gold, k) as all_or_k, round(p, 6) as precision, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1, round(dcg / ideal, 6) as alpha_ndcg from f""")
def list_metrics(spark, d):
    return M.list_metrics(paths(spark, d), gold(spark, d), (5, 20, 50))


@query(PATHS + GOLD + """, f as (select p.route, p.qid, min(p.rank) as r from paths p join gold g on g.qid = p.qid and g.key = p.key group by 1, 2)
select l.route, c.c as depth, round(avg(case when r <= c.c then 1.0 else 0 end), 6) as within from (select distinct qid, route from paths) l left join f on f.qid = l.qid and f.route = l.route cross join (values (1), (2), (5), (10), (50)) c(c) group by 1, 2""")
def ceiling_curve(spark, d):
    p = paths(spark, d)
    first = M.judged(p, gold(spark, d)).groupBy("qid", "route").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("r"))
    swept = first.withColumn("depth", F.explode(F.array(*map(F.lit, (1, 2, 5, 10, 50)))))
    return swept.groupBy("route", "depth").agg(F.round(F.avg(F.when(F.col("r") <= F.col("depth"), 1.0).otherwise(0.0)), 6).alias("within"))


@query("""with s as (select d.lang as grp, d.n_chars as score, l.quality = 1 as pos from documents d join labels l using (doc_id)),
r as (select *, rank() over (partition by grp order by score) + (count(*) over (partition by grp, score) - 1) / 2.0 as ar from s)
select grp, count(*) filter (pos) as n_pos, count(*) filter (not pos) as n_neg, round((sum(ar) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0) / (count(*) filter (pos) * count(*) filter (not pos)), 6) as auc from r group by 1""")
def auc_by_language(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("grp"), F.col("n_chars").alias("score")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return A.auc(rows, ("grp",), "score", F.col("quality") == 1).select("grp", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("""with s as (select d.lang as grp, d.n_chars as score, l.quality = 1 as pos from documents d join labels l using (doc_id)),
c as (select grp, score, count(*) filter (pos) as p, count(*) as n from s group by 1, 2),
t as (select grp, score, sum(p) over w as tp, sum(n) over w as yes, sum(p) over (partition by grp) as al from c window w as (partition by grp order by score desc)),
f as (select grp, score, round(2.0 * tp / (yes + al), 6) as f1 from t)
select grp, arg_max(score, (f1, score)) as threshold, max(f1) as f1 from f group by 1""")
def best_f1_threshold(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("grp"), F.col("n_chars").alias("score")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return A.best_f1(rows, ("grp",), "score", F.col("quality") == 1)


@query("""with s as (select d.lang as grp, d.n_chars as x, l.quality = 1 as pos from documents d join labels l using (doc_id)),
m as (select grp, count(*) filter (pos) as n1, count(*) filter (not pos) as n2, avg(x) filter (pos) as m1, avg(x) filter (not pos) as m2, var_samp(x) filter (pos) as v1, var_samp(x) filter (not pos) as v2 from s group by 1)
select grp, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) as cohen_d from m""")
def effect_size(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("grp"), F.col("n_chars").alias("x")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    pos = F.col("quality") == 1
    part = lambda f, c: f(F.when(c, F.col("x")))
    m = rows.groupBy("grp").agg(F.count_if(pos).alias("n1"), F.count_if(~pos).alias("n2"), part(F.avg, pos).alias("m1"), part(F.avg, ~pos).alias("m2"), part(F.var_samp, pos).alias("v1"), part(F.var_samp, ~pos).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return m.select("grp", F.round((F.col("m1") - F.col("m2")) / pooled, 6).alias("cohen_d"))


_PAIRS = """with a as (select user_id % 20 as grp, user_id, event_type, max(value) > 90 as ok from events group by 1, 2, 3), p as (select grp, user_id, bool_or(ok) filter (event_type = 'click') as x, bool_or(ok) filter (event_type = 'view') as y from a group by 1, 2)"""


def _pairs(spark, d):
    ok = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("grp"), "user_id", "event_type").agg((F.max("value") > 90).alias("ok"))
    one = lambda t: F.bool_or(F.when(F.col("event_type") == t, F.col("ok")))
    return ok.groupBy("grp", "user_id").agg(one("click").alias("x"), one("view").alias("y"))


@query(_PAIRS + """, c as (select grp, count(*) filter (x and not y) as b, count(*) filter (y and not x) as c from p group by 1)
select grp, b, c, round(case when b + c = 0 then 1 else least(1.0, 2 * (select sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) from range(0, cast(least(b, c) as bigint) + 1) t(i))) end, 6) as p from c""")
def mcnemar_exact(spark, d):
    c = _pairs(spark, d).groupBy("grp").agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(F.col("y") & ~F.col("x")).alias("c"))
    return c.select("grp", "b", "c", F.round(M.mcnemar_p(F.col("b"), F.col("c")), 6).alias("p"))


@query()
def paired_bootstrap(spark, d):
    return M.paired_bootstrap(_pairs(spark, d), F.col("x").cast("int") - F.col("y").cast("int"), ("grp",), "user_id")


@query(_PAIRS + """, f as (select grp, user_id % 5 as fold, user_id, cast(x as integer) as x, cast(y as integer) as y from p where x is not null and y is not null),
m as (select a.fold, avg(b.x) as mx, avg(b.y) as my from (select distinct fold from f) a join f b on b.fold <> a.fold group by 1)
select f.fold, case when mx >= my then 'x' else 'y' end as chosen, round(avg(case when mx >= my then f.x else f.y end), 6) as routed, round(avg(greatest(f.x, f.y)), 6) as oracle from f join m using (fold) group by 1, 2""")
def routed_and_oracle(spark, d):
    """Each fold uses the system that is better on the other folds; the oracle takes the better one for each query."""
    f = _pairs(spark, d).where("x is not null and y is not null").select((F.col("user_id") % 5).alias("fold"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    sums = f.groupBy("fold").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    total = sums.agg(F.sum("sx").alias("tx"), F.sum("sy").alias("ty"))  # one row
    chosen = sums.join(F.broadcast(total)).select("fold", F.when(F.col("tx") - F.col("sx") >= F.col("ty") - F.col("sy"), "x").otherwise("y").alias("chosen"))
    return f.join(chosen, "fold").groupBy("fold", "chosen").agg(F.round(F.avg(F.when(F.col("chosen") == "x", F.col("x")).otherwise(F.col("y"))), 6).alias("routed"), F.round(F.avg(F.greatest("x", "y")), 6).alias("oracle"))


@query(PATHS + GOLD + """, j as (select p.qid, p.route, p.rank, g.key is not null as hit, case when length(p.qid) = 2 and p.qid in ('en', 'de') then 'broad' else 'specific' end as cls from paths p left join gold g on g.qid = p.qid and g.key = p.key),
h as (select qid, route, cls, max(cast(hit and rank <= case cls when 'broad' then 20 else 5 end as integer)) as hit from j group by 1, 2, 3) select route, cls, round(avg(hit), 6) as hit_rate from h group by 1, 2""")
def broad_and_specific(spark, d):
    cls = F.when(F.col("qid").isin("en", "de"), "broad").otherwise("specific")
    j = M.judged(paths(spark, d), gold(spark, d)).withColumn("cls", cls)
    h = j.groupBy("qid", "route", "cls").agg(F.max((F.col("hit") & (F.col("rank") <= F.when(F.col("cls") == "broad", 20).otherwise(5))).cast("int")).alias("hit"))
    return h.groupBy("route", "cls").agg(F.round(F.avg("hit"), 6).alias("hit_rate"))


@query("""with s as (select d.lang as qid, d.n_chars as score, l.quality = 1 as gold from documents d join labels l using (doc_id)),
c as (select qid, score, count(*) filter (gold) as g, count(*) filter (not gold) as o from s group by 1, 2),
w as (select *, coalesce(sum(g) over a, 0) as og, coalesce(sum(o) over a, 0) as oo, sum(o) over (partition by qid) as n from c window a as (partition by qid order by score desc rows between unbounded preceding and 1 preceding)),
r as (select w.*, t.added, 49 - oo - og as room, case when n > 0 then (oo + o / 2.0) / n else 0.0 end as p from w, (values (0), (100), (1000), (10000)) t(added) where g > 0),
b as (select r.*, case when room < 0 then 0.0 when p <= 0 then least(g + o, room + 1) when p >= 1 then greatest(0, least(g + o, room - added + 1)) else
  (select sum(exp(lgamma(added + 1) - lgamma(i + 1) - lgamma(added - i + 1) + i * ln(p) + (added - i) * ln(1 - p)) * least(g + o, room - i + 1)) from range(0, cast(least(room, added) as bigint) + 1) x(i)) end / cast(g + o as double) as share from r)
select qid, added, round(sum(case when added = 0 then greatest(0.0, least(cast(g as double), 50 - oo - og)) else g * share end) / sum(g), 6) as ceiling from b group by 1, 2""")
def corpus_growth_ceiling(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("qid"), F.col("n_chars").alias("score")).join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("gold")), "doc_id")
    return M.expected_ceiling(rows, (0, 100, 1000, 10000), 50)


@query("""with b as (select 'l' || (user_id % 3) as layer, event_type as name, 'mean' as metric, round(avg(value), 4) as value, 'n' as note from events where event_id % 2 = 0 group by 1, 2),
c as (select 'l' || (user_id % 3) as layer, event_type as name, 'mean' as metric, round(avg(value), 4) as now, case when event_type = 'view' then 'other' else 'n' end as note from events where event_id % 2 = 1 and event_type <> 'error' group by 1, 2)
select b.layer, b.name, b.metric, b.value, c.now, case when c.now is null then 'missing' when b.value - c.now > 0.5 then 'worse' when c.note <> b.note then 'noted' when c.now - b.value > 0.5 then 'better' else 'same' end as verdict from b left join c using (layer, name, metric)""")
def ratchet_compare(spark, d):
    e = table(spark, d, "events").withColumn("layer", F.concat(F.lit("l"), F.col("user_id") % 3))
    mean = lambda rows, note: rows.groupBy("layer", F.col("event_type").alias("name"), F.lit("mean").alias("metric")).agg(F.round(F.avg("value"), 4).alias("value")).withColumn("note", note)
    base = mean(e.where("event_id % 2 = 0"), F.lit("n")).withColumns({"tolerance": F.lit(0.5), "relative": F.lit(False), "direction": F.lit("up")})
    now = mean(e.where("event_id % 2 = 1 and event_type <> 'error'"), F.when(F.col("name") == "view", "other").otherwise("n"))
    return M.ratchet(base, now)


@query("""with g as (select conv_id, length(text) > 300 as ok, length(text) as s from conversations) select conv_id, count(*) as n, bool_and(ok) = bool_or(ok) as consistent, round(stddev_pop(s), 4) as spread from g group by 1""")
def group_consistency(spark, d):
    g = table(spark, d, "conversations").select("conv_id", (F.length("text") > 300).alias("ok"), F.length("text").alias("s"))
    return g.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), (F.bool_and("ok") == F.bool_or("ok")).alias("consistent"), F.round(F.stddev_pop("s"), 4).alias("spread"))


@query("""select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'only_exported' when b.doc_id is null then 'only_gold' when a.q is distinct from b.q then 'changed' else 'same' end as state
from (select doc_id, quality as q from labels) a full outer join (select doc_id, case when doc_id % 7 = 0 then null else cast(doc_id % 11 > 2 as integer) end as q from documents) b using (doc_id)""")
def export_sync(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.col("quality").alias("q_gold"), F.lit(True).alias("in_gold"))
    q = F.when(F.col("doc_id") % 7 == 0, None).otherwise((F.col("doc_id") % 11 > 2).cast("int"))
    b = table(spark, d, "documents").select("doc_id", q.alias("q_out"), F.lit(True).alias("in_out"))
    state = F.when(F.col("in_gold").isNull(), "only_exported").when(F.col("in_out").isNull(), "only_gold").when(~F.col("q_gold").eqNullSafe(F.col("q_out")), "changed").otherwise("same")
    return a.join(b, "doc_id", "full_outer").select("doc_id", state.alias("state"))


@query()
def multi_value_match(spark, d):
    """Words of a benchmark item against words of the item after next, paired one to one by containment."""
    from ..functions import text as T

    words = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.filter(T.latin_tokens(F.col("text")), lambda w: F.length(w) >= 8))).alias("value"))
    return M.multi_value_match(words, words.withColumn("item_id", F.col("item_id") + 2), "item_id")


@query("""with r as (select lang as grp, (1 + count(*) filter (l.quality = 1)) / cast(1 + count(*) filter (l.quality = 0) as double) as ratio from documents d join labels l using (doc_id) group by 1),
n as (select grp, ratio, n, cast(n - ceil(n * ratio / (1 + ratio)) as bigint) as m from r, range(1, 401) t(n)),
p as (select grp, ratio, n, least(1.0, 2 * (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) from range(0, m + 1) x(i))) as p from n)
select grp, round(any_value(ratio), 6) as ratio, min(n) filter (p < 0.05) as needed from p group by 1""")
def discordant_power(spark, d):
    """How many discordant pairs, split as each language's good to bad documents, an exact test needs to reach 0.05; null if over 400."""
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("grp")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    ratio = rows.groupBy("grp").agg(((1 + F.count_if(F.col("quality") == 1)) / (1 + F.count_if(F.col("quality") == 0))).alias("ratio"))
    return ratio.select("grp", F.round("ratio", 6).alias("ratio"), M.discordant_pairs_needed(F.col("ratio"), 0.05, 400).alias("needed"))


@query("""with j as (select quality, toxic from labels), c as (select count(*) filter (quality = 1) as good, count(*) as n from j)
select n, round(good / cast(n as double), 6) as mean from c""")
def single_sample_mean(spark, d):
    """The mean that ``single_sample_interval`` gives an interval of."""
    return M.single_bootstrap(table(spark, d, "labels"), (F.col("quality") == 1).cast("double"), "doc_id").select("n", F.round("mean", 6).alias("mean"))


@query()
def single_sample_interval(spark, d):
    """Percentile interval of a share, by language; draws are hashes of ids, so a test draws the same."""
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("grp")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return M.single_bootstrap(rows, (F.col("quality") == 1).cast("double"), "doc_id", ("grp",))
