"""Queries of aggregations and of the relational kernel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import ranking as R
from .ranking import PATHS, paths
from .registry import query, table


@query("select event_type as arm, count(*) as n, round(avg(value), 4) as mean, count(distinct user_id) as users from events group by 1")
def mean_by_arm(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("with m as (select event_type as arm, user_id, median(value) as m from events group by 1, 2) select arm, round(median(m), 6) as median_of_medians from m group by 1")
def median_of_medians(spark, d):
    per = table(spark, d, "events").groupBy(F.col("event_type").alias("arm"), "user_id").agg(F.median("value").alias("m"))
    return per.groupBy("arm").agg(F.round(F.median("m"), 6).alias("median_of_medians"))


@query("""select lang, count(n_chars) as n, round(avg(n_chars), 4) as mean, round(stddev_samp(n_chars), 4) as sd, min(n_chars) as low, round(quantile_cont(n_chars, 0.25), 4) as q1, round(quantile_cont(n_chars, 0.5), 4) as q2, round(quantile_cont(n_chars, 0.75), 4) as q3, max(n_chars) as high from documents group by 1""")
def describe_lengths(spark, d):
    c = F.col("n_chars")
    quart = [F.round(F.percentile(c, q), 4).alias(n) for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return table(spark, d, "documents").groupBy("lang").agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("sd"), F.min(c).alias("low"), *quart, F.max(c).alias("high"))


@query("select source, count(*) as n from documents group by 1 order by n desc, source")
def value_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("select w as word, count(*) as n from (select unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as w from documents) group by 1 order by n desc, word limit 50")
def exploded_top_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(T.latin_tokens(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query("""with r as (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as i, count(*) over (partition by lang) as n from documents)
select lang, p.p as percent, min(n_chars) as value from r, (values (50), (90), (95)) p(p) where i = least(cast(floor(p.p * n / 100) as bigint), n - 1) group by 1, 2""")
def nearest_rank_percentiles(spark, d):
    return A.nearest_rank(table(spark, d, "documents"), ("lang",), "n_chars", (50, 90, 95))


@query("""select lang, case when n_chars < 200 then 0 when n_chars < 500 then 1 when n_chars < 1500 then 2 when n_chars < 5000 then 3 else 4 end as bin, count(*) as n from documents where n_chars between 0 and 20000 group by 1, 2""")
def length_histogram(spark, d):
    return A.histogram(table(spark, d, "documents"), ("lang",), F.col("n_chars"), [0, 200, 500, 1500, 5000, 20000])


@query("""select user_id, coalesce(sum(value) filter (event_type = 'click'), 0) as click, coalesce(sum(value) filter (event_type = 'view'), 0) as view, coalesce(sum(value) filter (event_type = 'purchase'), 0) as purchase
from (select user_id, event_type, round(sum(value), 4) as value from events group by 1, 2) group by 1""")
def pivot_systems(spark, d):
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("value"))
    return per.groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.first("value")).na.fill(0.0)


@query(PATHS + """, m as (select qid, route, key, rank from paths where key in (select doc_id from labels where quality = 1))
select qid, route, round(avg(case when rank between 1 and 10 then 1.0 else 0 end), 6) as at_10, round(avg(case when rank between 1 and 50 then 1.0 else 0 end), 6) as at_50 from m group by 1, 2""")
def fraction_at_k(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key"))
    m = paths(spark, d).join(good, "key", "left_semi")
    at = lambda k: F.round(F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)), 6)
    return m.groupBy("qid", "route").agg(at(10).alias("at_10"), at(50).alias("at_50"))


@query("""with s as (select doc_id, n_chars, unnest(list_filter([case when regexp_matches(text, '(^|[^A-Za-z0-9_])[A-Z]{2,}([^A-Za-z0-9_]|$)') then 'acronym' end, case when regexp_matches(text, '[0-9]') then 'digit' end, 'lang_' || lang, 'all'], lambda x: x is not null)) as stratum from documents)
select stratum, count(*) as n, round(avg(n_chars), 4) as mean_chars from s group by 1""")
def strata_metrics(spark, d):
    strata = F.array_compact(F.array(F.when(F.col("text").rlike(r"(^|[^A-Za-z0-9_])[A-Z]{2,}([^A-Za-z0-9_]|$)"), "acronym"), F.when(F.col("text").rlike("[0-9]"), "digit"), F.concat(F.lit("lang_"), "lang"), F.lit("all")))
    return table(spark, d, "documents").select("n_chars", F.explode(strata).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("select md5(text) as digest, min(doc_id) as first_id, max(doc_id) as last_id, count(*) as copies from documents group by 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("copies"))


@query("""select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts from events group by 1, 2""")
def latest_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return A.latest(e, ("user_id", "event_type"), "ts", "event_id").select("user_id", "event_type", "event_id", "ts")


@query("""select conv_id, array_to_string(list_distinct_ordered, ',') as roles, n_turns, first_role from (
  select conv_id, (select list(r order by m) from (select role as r, min(turn) as m from conversations c2 where c2.conv_id = c.conv_id group by 1)) as list_distinct_ordered, count(distinct turn) as n_turns, arg_min(role, (turn, role)) as first_role from conversations c group by 1)""")
def group_rollup(spark, d):
    c = table(spark, d, "conversations")
    roles = c.groupBy("conv_id", "role").agg(F.min("turn").alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("m", "role"))).alias("r"))
    rest = c.groupBy("conv_id").agg(F.countDistinct("turn").alias("n_turns"), F.min_by("role", F.struct("turn", "role")).alias("first_role"))
    return roles.join(rest, "conv_id").select("conv_id", F.array_join(F.col("r.role"), ",").alias("roles"), "n_turns", "first_role")


@query("""with v as (select doc_id, quality as a, case when toxic = 1 then 0 else 1 end as b, cast(doc_id % 3 = 0 as integer) as c from labels)
select doc_id, cast(a + b + c as bigint) as votes, a + b + c >= 2 as gold, a + b + c in (0, 3) as unanimous from v""")
def majority_vote(spark, d):
    votes = (F.col("quality") + F.when(F.col("toxic") == 1, 0).otherwise(1) + (F.col("doc_id") % 3 == 0).cast("int")).cast("long")
    return table(spark, d, "labels").select("doc_id", votes.alias("votes"), (votes >= 2).alias("gold"), votes.isin(0, 3).alias("unanimous"))


@query("""with r as (select source, n_chars as s, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) select source, max(s) as best, round(avg(s) filter (rn <= 3), 4) as mean_top_3 from r group by 1""")
def owner_max_and_mean_top(spark, d):
    top = R.top_k(table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("s")), 3, ("source",), (F.desc("s"), F.asc("doc_id")))
    return top.groupBy("source").agg(F.max("s").alias("best"), F.round(F.avg("s"), 4).alias("mean_top_3"))


@query("""select count(*) as n, count(*) filter (coalesce(text, '') = '') as empty_text, round(avg(case when lang is null then 0.0 else 1.0 end), 6) as with_lang, count(distinct source) as sources, round(median(n_chars), 4) as median_chars, max(n_chars) as max_chars from documents""")
def coverage_report(spark, d):
    return table(spark, d, "documents").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty_text"), F.round(F.avg(F.when(F.col("lang").isNull(), 0.0).otherwise(1.0)), 6).alias("with_lang"),
        F.countDistinct("source").alias("sources"), F.round(F.median("n_chars"), 4).alias("median_chars"), F.max("n_chars").alias("max_chars"))


@query("""with g as (select conv_id, count(*) filter (role = 'user') as n_gold from conversations group by 1) select least(n_gold, 2) as class, count(*) as n, max(n_gold) as most from g group by 1""")
def qrels_audit(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_gold"))
    return g.groupBy(F.least(F.col("n_gold"), F.lit(2)).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max("n_gold").alias("most"))


@query("""select source, count(*) as n, count(*) filter (length(text) < 200) as short_ones, count(*) filter (length(text) > 4000) as long_ones, count(*) filter (regexp_matches(text, '^[A-Z][a-z]+ ')) as lead_word, round(avg(len(string_split(text, chr(10)))), 4) as mean_lines from documents group by 1""")
def chunk_audit(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(n < 200).alias("short_ones"), F.count_if(n > 4000).alias("long_ones"), F.count_if(F.col("text").rlike("^[A-Z][a-z]+ ")).alias("lead_word"), F.round(F.avg(F.size(F.split("text", "\n"))), 4).alias("mean_lines"))


@query("""with now as (select user_id as paper, event_type as module, max(value) > 50 as ok from events group by 1, 2), base as (select user_id as paper, event_type as module, min(value) > 5 as ok from events where event_id % 2 = 0 group by 1, 2)
select coalesce(n.paper, b.paper) as paper, coalesce(n.module, b.module) as module, case when b.ok and not n.ok then 'broken' when not b.ok and n.ok then 'fixed' when b.ok is null then 'new' when n.ok is null then 'gone' else 'same' end as change
from now n full outer join base b on n.paper = b.paper and n.module = b.module""")
def status_matrix_diff(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("paper"), F.col("event_type").alias("module"), "value", "event_id")
    now = e.groupBy("paper", "module").agg((F.max("value") > 50).alias("ok"))
    base = e.where("event_id % 2 = 0").groupBy("paper", "module").agg((F.min("value") > 5).alias("was"))
    change = F.when(F.col("was") & ~F.col("ok"), "broken").when(~F.col("was") & F.col("ok"), "fixed").when(F.col("was").isNull(), "new").when(F.col("ok").isNull(), "gone").otherwise("same")
    return now.join(base, ["paper", "module"], "full_outer").select("paper", "module", change.alias("change"))


@query("""select user_id, count(*) as calls, round(sum(case event_type when 'purchase' then value * 0.01 when 'click' then value * 0.002 else value * 0.001 end), 4) as cost from events group by 1""")
def token_cost(spark, d):
    price = F.when(F.col("event_type") == "purchase", 0.01).when(F.col("event_type") == "click", 0.002).otherwise(0.001)
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("value") * price), 4).alias("cost"))


@query("""select coalesce(lang, 'all') as lang, coalesce(source, 'all') as source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by rollup (lang, source)""")
def rollup_with_total(spark, d):
    got = table(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return got.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "chars")


@query("""select d.lang as cluster, d.source as facet, count(*) as n_docs, count(l.doc_id) as n_judged, cast(coalesce(sum(l.quality), 0) as bigint) as n_yes from documents d left join labels l using (doc_id) group by 1, 2""")
def cluster_facet_coverage(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("cluster"), F.col("source").alias("facet"))
    met = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return met.groupBy("cluster", "facet").agg(F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_judged"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("n_yes"))


@query("""select user_id, date_trunc('hour', ts) as window_start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def hourly_event_windows(spark, d):
    from ..streaming.logs import event_windows

    return event_windows(table(spark, d, "events"), "1 hour")


@query("""with j as (select user_id % 97 as job, event_type as stage, ts, event_id from events), s as (select job, stage, min(ts) as began, max(ts) as ended, count(*) as n from j group by 1, 2)
select job, stage, n, cast(floor(epoch(ended)) - floor(epoch(began)) as bigint) as seconds from s""")
def job_stage_durations(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 97).alias("job"), F.col("event_type").alias("stage"), "ts")
    s = e.groupBy("job", "stage").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    return s.select("job", "stage", "n", (F.unix_timestamp("ended") - F.unix_timestamp("began")).alias("seconds"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1""")
def star_join_revenue(spark, d):
    li, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    per = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    j = per.join(o.select("o_orderkey", "o_custkey"), per.l_orderkey == o.o_orderkey).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == c.c_custkey)
    j = j.groupBy("c_nationkey").agg(F.sum("rev").alias("rev")).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left_semi")
    return j.groupBy("n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"))
