"""Queries of lexical and dense retrieval: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as X
from ..operators import ranking as R
from ..operators import retrieval as S
from ..sources import scratch
from .registry import query, table

MIXED_SQL = "'[a-z0-9]+|[\\x{4e00}-\\x{9fff}]'"
LATIN_SQL = "'[a-z0-9]+'"


def _bm25_sql(pattern: str, k1: float, power: str, numerator: str, min_df: int, k: int) -> str:
    return f"""
with dt as (select doc_id as key, unnest(regexp_extract_all(lower(text), {pattern})) as term from documents),
dl as (select doc_id as key, len(regexp_extract_all(lower(text), {pattern})) as dl from documents),
st as (select count(*) as n_docs, avg(dl) as avgdl from dl),
tf as (select key, term, count(*) as tf from dt group by 1, 2),
df as (select term, count(*) as df from tf group by 1 having count(*) >= {min_df}),
qt as (select item_id as qid, unnest(regexp_extract_all(lower(text), {pattern})) as term from benchmark),
qf as (select qid, term, count(*) as qf from qt group by 1, 2),
s as (select qf.qid, tf.key, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * {power} * tf * {numerator} / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from qf join df using (term) join tf using (term) join dl using (key) cross join st group by 1, 2)
select qid, key, score, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by score desc, key) as rank from s where score > 0) where rank <= {k}"""


def _index(spark, d, tokenise):
    path = scratch.folder(spark, "blocks")
    X.write(spark.read.parquet(f"{d}/documents.parquet"), tokenise(F.col("text")), "doc_id", path)
    return X.read(spark, path)


def _top(spark, d, tokenise, model, k=10, index=None):
    """The k best documents of each benchmark item, from a kept index (written here unless one is given)."""
    found = X.search(_index(spark, d, tokenise) if index is None else index, table(spark, d, "benchmark"), tokenise, k, model)
    return found.select("qid", "key", "score", "rank")


@query(_bm25_sql(MIXED_SQL, 1.5, "qf", "1", 1, 10))
def bm25_topk(spark, d):
    return _top(spark, d, T.mixed_tokens, S.PLAIN)


@query(_bm25_sql(LATIN_SQL, 1.5, "qf * qf", "2.5", 2, 10))
def bm25_sparse_topk(spark, d):
    return _top(spark, d, T.latin_tokens, S.SPARSE)


@query(_bm25_sql(MIXED_SQL, 1.2, "1", "2.2", 1, 10))
def bm25_distinct_topk(spark, d):
    return _top(spark, d, T.mixed_tokens, S.DISTINCT)


_DENSE = """
with q as (select vec_id as qid, embedding::double[] as a from embeddings where vec_id % 50 = 0),
s as (select q.qid, e.vec_id as key, round(list_dot_product(q.a, e.embedding::double[]) / (sqrt(list_dot_product(q.a, q.a)) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6) as score from q join embeddings e on e.vec_id <> q.qid),
r as (select *, cast(row_number() over (partition by qid order by score desc, key) as integer) as rank from s)"""


def _dense(spark, d, k):
    vectors = table(spark, d, "embeddings")
    return S.cosine_topk(vectors, vectors.where("vec_id % 50 = 0"), k)


@query(_DENSE + " select qid, key, score, rank from r where rank <= 10")
def dense_topk(spark, d):
    """Exact search; the queries are the rows whose id is divisible by 50, against all rows."""
    return _dense(spark, d, 10)


@query(_DENSE + """, t as (select * from r where rank <= 100)
select qid, round(max(score), 6) as sim_at_1, round(avg(score) filter (rank <= 5), 6) as sim_at_5, round(avg(score) filter (rank <= 20), 6) as sim_at_20, round(avg(score), 6) as sim_at_100,
  round(max(score) - min(score) filter (rank <= 5), 6) as drop_5, count(*) filter (score > 0.3) as above, round(stddev_pop(score), 6) as spread from t group by qid""")
def similarity_profile(spark, d):
    t = _dense(spark, d, 100)
    mean = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, F.col("score"))), 6)
    return t.groupBy("qid").agg(
        F.round(F.max("score"), 6).alias("sim_at_1"), mean(5).alias("sim_at_5"), mean(20).alias("sim_at_20"), mean(100).alias("sim_at_100"),
        F.round(F.max("score") - F.min(F.when(F.col("rank") <= 5, F.col("score"))), 6).alias("drop_5"), F.count_if(F.col("score") > 0.3).alias("above"), F.round(F.stddev_pop("score"), 6).alias("spread"),
    )


_TWO_ROUTES = """
with a as (""" + _bm25_sql(MIXED_SQL, 1.5, "qf", "1", 1, 50) + """), b as (""" + _bm25_sql(MIXED_SQL, 1.2, "1", "2.2", 1, 50) + """),
u as (select qid, key, rank, score, 1.0 as w from a union all select qid, key, rank, score, 0.5 from b),"""


@query(_TWO_ROUTES + """
f as (select qid, key, count(*) as n_routes, round(avg(score), 4) as mean_score, round(sum(w / (60 + rank)), 9) as fused from u group by 1, 2)
select qid, key, n_routes, mean_score, fused, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by fused desc, key) as rank from f) where rank <= 10""")
def hybrid_topk(spark, d):
    """Two lexical rankings of different kinds fused by rank; the mean of their scores is carried along."""
    index = _index(spark, d, T.mixed_tokens)
    both = _top(spark, d, T.mixed_tokens, S.PLAIN, 50, index).withColumn("w", F.lit(1.0)).unionByName(_top(spark, d, T.mixed_tokens, S.DISTINCT, 50, index).withColumn("w", F.lit(0.5)))
    fused = both.groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n_routes"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.sum(F.col("w") / (60 + F.col("rank"))), 9).alias("fused"))
    return R.top_k(fused, 10, order=(F.desc("fused"), F.asc("key")))


@query(f"""
with t as (select doc_id as key, unnest(regexp_extract_all(lower(text), {MIXED_SQL})) as term from documents),
tf as (select key, cast(cast('0x' || substr(md5(term), 1, 8) as bigint) % 256 as integer) as bucket, count(*) as tf from t group by 1, 2),
n as (select key, sqrt(sum(tf * tf)) as norm from tf group by 1)
select key, count(*) as n_buckets, round(max(tf / norm), 6) as top_weight, round(sum(tf / norm * (bucket + 1)), 4) as checksum from tf join n using (key) group by key""")
def hash_embedding(spark, d):
    rows = S.hash_embedding(table(spark, d, "documents"), T.mixed_tokens(F.col("text")), "doc_id")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_buckets"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum(F.col("weight") * (F.col("bucket") + 1)), 4).alias("checksum"))


@query(f"""
with w as (select doc_id as key, unnest(list_distinct(regexp_extract_all(lower(text), {LATIN_SQL}))) as term from documents),
df as (select term, count(*) as df from w group by 1),
s as (select key, term, round(ln(1 + ((select count(*) from documents) - df + 0.5) / (df + 0.5)), 6) as score from w join df using (term))
select key, term, score, cast(rank as integer) as rank from (select *, row_number() over (partition by key order by score desc, term) as rank from s) where rank <= 12""")
def top_idf_keywords(spark, d):
    return S.top_idf_words(table(spark, d, "documents"), T.latin_tokens(F.col("text")), "doc_id", 12)


@query(f"""
with q as (select item_id, list_filter(list_distinct(regexp_extract_all(lower(text), {LATIN_SQL})), lambda w: length(w) >= 4) as qw from benchmark),
c as ({_bm25_sql(MIXED_SQL, 1.5, "qf", "1", 1, 10)})
select c.qid, c.key, len(list_intersect(q.qw, list_distinct(regexp_extract_all(lower(d.text), {LATIN_SQL})))) as n_shared,
  round(len(list_intersect(q.qw, list_distinct(regexp_extract_all(lower(d.text), {LATIN_SQL})))) / cast(len(q.qw) as double), 6) as ratio
from c join q on q.item_id = c.qid join documents d on d.doc_id = c.key where len(q.qw) > 0""")
def leak_ratio(spark, d):
    """The share of a query's long words that its best answers hold."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(F.filter(T.latin_tokens(F.col("text")), lambda w: F.length(w) >= 4)).alias("qw"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), T.latin_tokens(F.col("text")).alias("dw"))
    got = _top(spark, d, T.mixed_tokens, S.PLAIN).join(q, "qid").where(F.size("qw") > 0).join(docs, "key")
    shared = F.size(F.array_intersect("qw", "dw"))
    return got.select("qid", "key", shared.cast("long").alias("n_shared"), F.round(shared / F.size("qw").cast("double"), 6).alias("ratio"))


@query("""
select item_id, length(text) as n_chars, len(list_filter(string_split_regex(trim(text), '[ \\t\\r\\n]+'), lambda w: w <> '')) as n_words, len(regexp_extract_all(text, '\\b[A-Z]{2,}\\b')) as n_acronyms,
  regexp_matches(text, '[0-9]') as has_number, contains(text, ',') as has_comma, regexp_matches(text, '[A-Za-z]{3,}|[0-9]') as specific from benchmark""")
def query_features(spark, d):
    f = T.surface_features(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", *(f[c].cast("long").alias(c) for c in ("n_chars", "n_words", "n_acronyms")), f["has_number"].alias("has_number"), f["has_comma"].alias("has_comma"), T.is_specific(F.col("text")).alias("specific"))


@query(f"""
with b as ({_bm25_sql(MIXED_SQL, 1.5, "qf", "1", 1, 20)}),
gold as (select i.item_id as qid, d.doc_id as key from benchmark i join documents d on contains(regexp_replace(lower(d.text), '\\s+', ' ', 'g'), trim(regexp_replace(lower(i.text), '\\s+', ' ', 'g')))),
n as (select qid, count(*) as n_gold from gold group by 1)
select n.qid, n.n_gold, count(b.key) filter (b.rank <= 5 and g.key is not null) as hits5, round(count(b.key) filter (b.rank <= 5 and g.key is not null) / cast(n_gold as double), 6) as recall5,
  round(count(b.key) filter (b.rank <= 20 and g.key is not null) / cast(n_gold as double), 6) as recall20, coalesce(round(max(case when b.rank <= 10 and g.key is not null then 1.0 / b.rank end), 6), 0) as rr10
from n left join b using (qid) left join gold g on g.qid = b.qid and g.key = b.key group by n.qid, n.n_gold""")
def search_recall(spark, d):
    """How well lexical search finds the documents that hold the very passage."""
    from ..operators import joins as J

    gold = J.containing(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text").select(F.col("item_id").alias("qid"), F.col("doc_id").alias("key"))
    n = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    found = _top(spark, d, T.mixed_tokens, S.PLAIN, 20).join(gold, ["qid", "key"])
    per = n.join(found, "qid", "left").groupBy("qid", "n_gold")
    at = lambda k: F.count_if(F.col("rank") <= k)
    return per.agg(
        at(5).alias("hits5"), F.round(at(5) / F.col("n_gold"), 6).alias("recall5"), F.round(at(20) / F.col("n_gold"), 6).alias("recall20"),
        F.coalesce(F.round(F.max(F.when(F.col("rank") <= 10, 1.0 / F.col("rank"))), 6), F.lit(0.0)).alias("rr10"),
    )


_SUBQUERIES = """
with g as (select vec_id as qid, unnest([vec_id, vec_id + 1, vec_id + 7]) as sub from embeddings where vec_id % 100 = 0),
q as (select distinct sub, e.embedding::double[] as a from g join embeddings e on e.vec_id = g.sub),
s as (select q.sub, e.vec_id as key, round(list_dot_product(q.a, e.embedding::double[]) / (sqrt(list_dot_product(q.a, q.a)) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6) as score from q join embeddings e on e.vec_id <> q.sub),
r as (select * from (select *, row_number() over (partition by sub order by score desc, key) as rank from s) where rank <= 50)"""


@query(_SUBQUERIES + """, f as (select g.qid, r.key, count(*) as n_queries, round(avg(score), 6) as mean_cosine, round(sum(1.0 / (60 + rank)), 9) as fused from g join r using (sub) group by 1, 2)
select qid, key, n_queries, mean_cosine, fused, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by fused desc, key) as rank from f) where rank <= 10""")
def multi_query_rrf(spark, d):
    """A question asked in three ways: dense lists of each fused by rank; the mean cosine is carried along."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.explode(F.array("vec_id", F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("sub"))
    found = S.cosine_topk(v, v.join(asked.select(F.col("sub").alias("vec_id")).distinct(), "vec_id", "left_semi"), 50).withColumnRenamed("qid", "sub")
    per = asked.join(found, "sub").groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("score"), 6).alias("mean_cosine"), F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("fused"))
    return R.top_k(per, 10, order=(F.desc("fused"), F.asc("key")))


_BOTH = "with lexical as (" + _bm25_sql(MIXED_SQL, 1.5, "qf", "1", 1, 50) + """),
q as (select item_id as qid, e.embedding::double[] as a from benchmark join embeddings e on e.vec_id = item_id),
s as (select q.qid, e.vec_id as key, round(list_dot_product(q.a, e.embedding::double[]) / (sqrt(list_dot_product(q.a, q.a)) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6) as score from q join embeddings e on e.vec_id <> q.qid),
dense as (select * from (select *, row_number() over (partition by qid order by score desc, key) as rank from s) where rank <= 50),
u as (select qid, key, rank, score as cosine from dense union all select qid, key, rank, null from lexical),
f as (select qid, key, count(*) as n_routes, max(cosine) as cosine, round(sum(case when cosine is null then 0.5 else 1.5 end / (60 + rank)), 9) as fused from u group by 1, 2),
r as (select *, row_number() over (partition by qid order by fused desc, key) as rank from f)"""


def _lexical_and_dense(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    dense = S.cosine_topk(v, v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), 50).select("qid", "key", "rank", F.col("score").alias("cosine"))
    both = dense.unionByName(_top(spark, d, T.mixed_tokens, S.PLAIN, 50).select("qid", "key", "rank", F.lit(None).cast("double").alias("cosine")))
    weight = F.when(F.col("cosine").isNull(), 0.5).otherwise(1.5)
    return both.groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n_routes"), F.max("cosine").alias("cosine"), F.round(F.sum(weight / (60 + F.col("rank"))), 9).alias("fused"))


@query(_BOTH + " select qid, key, n_routes, cosine, fused, cast(rank as integer) as rank from r where rank <= 10")
def lexical_dense_hybrid(spark, d):
    """Lexical and dense lists of one question fused by weighted ranks; a question without a lexical signal has its dense list only."""
    return R.top_k(_lexical_and_dense(spark, d), 10, order=(F.desc("fused"), F.asc("key")))


@query(_BOTH + """, e as (select qid, key, row_number() over (partition by qid order by score desc, key) as n from dense where key % 3 = 0),
k as (select qid, key, 0 as late, rank from r where rank <= 8 union all select qid, key, 1, n from e where n <= 2)
select qid, key, cast(row_number() over (partition by qid order by late, rank) as integer) as rank from (select qid, key, min(late) as late, min(late * 1000 + rank) - min(late) * 1000 as rank from k group by 1, 2)""")
def hybrid_with_quota(spark, d):
    """A hybrid list, and behind it the best of outside blocks that are not in it."""
    base = R.top_k(_lexical_and_dense(spark, d), 8, order=(F.desc("fused"), F.asc("key"))).select("qid", "key", "rank", F.lit("base").alias("route"))
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    outside = S.cosine_topk(v, v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), 50).where("key % 3 = 0").drop("rank")
    every = base.unionByName(R.top_k(outside, 2).select("qid", "key", "rank", F.lit("outside").alias("route")))
    return R.quota_union(every, {"base": 8, "outside": 2}).select("qid", "key", "rank")


@query(_DENSE + " select qid, key, round(score, 4) as score, e.label, rank from r join embeddings e on e.vec_id = r.key where rank <= 8")
def claim_search(spark, d):
    """The best groups of an index with their own columns and scores to four places."""
    v = table(spark, d, "embeddings")
    found = _dense(spark, d, 8)
    return found.join(v.select(F.col("vec_id").alias("key"), "label"), "key").select("qid", "key", F.round("score", 4).alias("score"), "label", "rank")
