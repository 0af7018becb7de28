"""Queries of answer checks, question kinds, coverage and paired comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import evaluation as M
from ..operators import joins as J
from ..operators import ranking as R
from ..operators import reports as B
from ..operators import splitters as S
from ..operators import verification as V
from ..sources import readers as I
from ..streaming import logs as L
from .documents import _anchor_sql
from .evaluation import GOLD, gold
from .ranking import PATHS, paths
from ..sources import scratch
from .registry import query, table

_S = "[ \\t\\n\\x0B\\f\\r]"
_NORM = f"trim(regexp_replace(lower(translate(replace({{0}}, '…', '...'), '“”‘’–—', '\"\"''''--')), '{_S}+', ' ', 'g'))"
_ALNUM = "regexp_replace(" + _NORM + ", '[^a-z0-9]+', '', 'g')"
_MD5 = lambda c: F.md5(c.cast("binary"))
_join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query(f"""with p as (select doc_id, text, lead(text) over (order by doc_id) as nxt, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
q as (select doc_id, text, case doc_id % 5 when 0 then substr(text, 21, 80) when 1 then array_to_string(list_reverse(w[1:12]), ' ') when 2 then array_to_string(w[1:4], ' ') || ' zzz ' || array_to_string(w[5:9], ' ') || ' zzz' when 3 then left(text, 60) || ' zzz zzz' else 'nothing of all that is said here' end as quote, doc_id % 7 = 0 as others from p),
n as (select *, {_NORM.format('quote')} as qn, {_NORM.format('text')} as tn, {_ALNUM.format('quote')} as qa, {_ALNUM.format('text')} as ta, regexp_extract_all(lower(quote), '[a-z0-9]+') as qw, regexp_extract_all(lower(text), '[a-z0-9]+') as tw from q),
b as (select *, list_distinct(list_transform(range(1, greatest(len(qw) - 1, 1) + 1), lambda i: array_to_string(qw[i:i + 1], ' '))) as qb, list_distinct(list_transform(range(1, greatest(len(tw) - 1, 1) + 1), lambda i: array_to_string(tw[i:i + 1], ' '))) as tb,
  list_filter(list_transform(string_split_regex(qn, '\\.{{3}}'), lambda x: trim(x)), lambda x: x <> '') as parts from n)
select doc_id, case when qn <> '' and (contains(tn, qn) or qa <> '' and contains(ta, qa) or len(parts) > 1 and len(list_filter(parts, lambda x: not contains(tn, x))) = 0) then 'none' when others then 'drift' when length(qa) >= 30 and contains(ta, left(qa, 30)) then 'noise'
  when len(list_intersect(qb, tb)) / cast(greatest(len(qb), 1) as double) >= 0.4 then 'paraphrase' else 'none_found' end as cause from b""")
def miss_causes(spark, d):
    """Quotes that are verbatim, reversed, broken in the middle, broken at the end, or of nothing, some of which other chunks hold."""
    w, k, t = T.latin_tokens(F.col("text")), F.col("doc_id") % 5, F.col("text")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    quote = (
        F.when(k == 0, F.substring(t, 21, 80)).when(k == 1, F.array_join(F.reverse(F.slice(w, 1, 12)), " ")).when(k == 2, _join(part(1, 4), " zzz ", part(5, 5), " zzz")).when(k == 3, _join(F.left(t, F.lit(60)), " zzz zzz"))
        .otherwise("nothing of all that is said here")
    )
    return table(spark, d, "documents").select("doc_id", V.miss_cause(quote, t, F.col("doc_id") % 7 == 0).alias("cause"))


_STRICT = "{0} and ({1} or {2}) and not {3}"


@query(f"""with a as (select conv_id, turn, role, text as answer, coalesce(lead(text) over (partition by conv_id order by turn, role, text), '') as cited from conversations), r as (select *, answer || chr(10) || cited as relaxed from a),
j as (select conv_id, turn, role, {_STRICT.format(_anchor_sql('the', 'answer'), _anchor_sql('is', 'answer'), _anchor_sql('der', 'answer'), _anchor_sql('moron', "regexp_replace(answer, '\"[^\"]*\"|“[^”]*”', ' ', 'g')"))} as strict,
  {_STRICT.format(_anchor_sql('the', 'relaxed'), _anchor_sql('is', 'relaxed'), _anchor_sql('der', 'relaxed'), _anchor_sql('moron', "regexp_replace(relaxed, '\"[^\"]*\"|“[^”]*”', ' ', 'g')"))} as relaxed from r)
select role, count(*) as n, count(*) filter (strict) as ok_strict, count(*) filter (relaxed) as ok, round((count(*) filter (relaxed) - count(*) filter (strict)) / cast(count(*) as double), 6) as gap from j group by 1""")
def answer_score_gap(spark, d):
    """Answers judged alone, and together with what they cite (here: the next turn)."""
    from pyspark.sql import Window

    words = lambda *w: F.array(*map(F.lit, w))
    verdict = lambda c: T.keyword_verdict(c, words("the"), words("is", "der"), words("moron"))
    cited = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")), F.lit(""))
    rows = table(spark, d, "conversations").select("role", F.col("text").alias("answer"), cited.alias("cited")).select("role", verdict(F.col("answer")).alias("strict"), verdict(F.concat_ws("\n", "answer", "cited")).alias("relaxed"))
    ok, strict = F.count_if("relaxed"), F.count_if("strict")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), strict.alias("ok_strict"), ok.alias("ok"), F.round((ok - strict) / F.count(F.lit(1)), 6).alias("gap"))


@query("""with v as (select event_id, event_id % 8 as k, cast(event_id % 977 + 1 as bigint) as n from events)
select event_id, case k when 0 then n when 1 then n * 1000.0 when 2 then n * 1e6 when 3 then n / 10.0 when 4 then n * 1e4 when 5 then n + 0.25 when 6 then null else n * 1000 + 5 end::double as value from v""")
def parsed_values(spark, d):
    """Whole strings as numbers: plain, with units, with decimal commas, per cent signs and thousands, and such that are no number."""
    k, n = F.col("event_id") % 8, F.col("event_id") % 977 + 1
    s = n.cast("string")
    raw = (
        F.when(k == 0, s).when(k == 1, _join(s, "k")).when(k == 2, _join(" ", s, " million")).when(k == 3, _join(F.floor(n / 10).cast("string"), ",", (n % 10).cast("string"), " %")).when(k == 4, _join(s, "万"))
        .when(k == 5, _join(s, ".25%")).when(k == 6, _join(s, " or so")).otherwise(_join(s, ",005"))
    )
    return table(spark, d, "events").select("event_id", N.parsed(raw).alias("value"))


_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({{0}}, '([.!?。！？]){_S}*', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query(f"""with a as (select doc_id, case doc_id % 4 when 0 then 'Yes. No information was given! ' || text when 1 then 'Is it so? What do we know?' when 2 then 'Correct, as said. ' || text else 'It does not mention that. No.' end as answer from documents), s as (select doc_id, {_SENTENCES.format('answer')} as s from a)
select doc_id, len(list_filter(s, lambda x: length(x) >= 20 and not regexp_matches(x, '[?？]$') and not regexp_matches(lower(x), 'not (?:mention|report|state|provide|find|found)|no (?:information|evidence)|未(?:提及|找到|给出)|没有'))) > 0 as substantive,
  md5(array_to_string(list_filter(s, lambda x: not regexp_matches(lower(x), '^(?:yes|no|correct|incorrect|是|否|不是|对|错)\\b')), ' ')) as masked from s""")
def answer_sentences(spark, d):
    """Whether an answer claims anything, and what is left of it without its verdicts."""
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, _join("Yes. No information was given! ", F.col("text"))).when(k == 1, "Is it so? What do we know?").when(k == 2, _join("Correct, as said. ", F.col("text"))).otherwise("It does not mention that. No.")
    return table(spark, d, "documents").select("doc_id", V.substantive(answer).alias("substantive"), _MD5(V.masked_verdicts(answer)).alias("masked"))


@query("""with m as (select event_id, cast(event_id % 1000 as varchar) as value, case when event_id % 3 = 0 then cast(event_id % 700 as varchar) when event_id % 3 = 1 then '' end as baseline, 'from ' || case when event_id % 2 = 0 then cast(event_id % 700 as varchar) else 'less' end || ' to ' || case when event_id % 5 = 0 then 'more' else cast(event_id % 1000 as varchar) end as quote, event_id % 7 > 1 as located, event_id % 4 = 0 as together from events),
v as (select *, located and contains(replace(quote, ' ', ''), value) as exact from m)
select event_id, case when exact then 'exact' when not located and together then 'values' else 'none' end as verify, case when exact and coalesce(baseline, '') <> '' and not contains(replace(quote, ' ', ''), baseline) then '' else baseline end as baseline,
  case when (case when exact and coalesce(baseline, '') <> '' and not contains(replace(quote, ' ', ''), baseline) then '' else baseline end) <> '' then case when cast(value as bigint) - cast(baseline as bigint) >= 0 then '+' else '' end || (cast(value as bigint) - cast(baseline as bigint)) end as delta from v""")
def strict_verdicts(spark, d):
    i = F.col("event_id")
    value, baseline = (i % 1000).cast("string"), F.when(i % 3 == 0, (i % 700).cast("string")).when(i % 3 == 1, "")
    quote = _join("from ", F.when(i % 2 == 0, (i % 700).cast("string")).otherwise("less"), " to ", F.when(i % 5 == 0, "more").otherwise(value))
    got = V.strict_verdict(i % 7 > 1, value, baseline, quote, i % 4 == 0)
    return table(spark, d, "events").select("event_id", *(got[c].alias(c) for c in ("verify", "baseline", "delta")))


@query("""with s as (select doc_id, (doc_id % 9 + 1) || ' · ' || case doc_id % 6 when 0 then 'Abstract' when 1 then 'Introduction of ' || source when 2 then 'Discussion and Outlook' when 3 then 'Method' when 4 then 'Concluding Remarks' else lang end as mid, case when doc_id % 11 = 0 then 'Appendix B' when doc_id % 13 = 0 then 'C Proofs' end as ap from documents), n as (select doc_id, coalesce(ap, mid) as name from s)
select doc_id, case when regexp_matches(lower(name), 'abstract|conclusion|discussion|concluding|summary') then 2.0 when contains(lower(name), 'introduction') then 1.0 when starts_with(lower(name), 'appendix') or regexp_matches(name, '^[A-Za-z][ \\t]') then -1.0 else 0.0 end::double as weight from n""")
def section_weights(spark, d):
    i = F.col("doc_id")
    mid = F.when(i % 6 == 0, "Abstract").when(i % 6 == 1, _join("Introduction of ", F.col("source"))).when(i % 6 == 2, "Discussion and Outlook").when(i % 6 == 3, "Method").when(i % 6 == 4, "Concluding Remarks").otherwise(F.col("lang"))
    name = F.when(i % 11 == 0, "Appendix B").when(i % 13 == 0, "C Proofs").otherwise(_join((i % 9 + 1).cast("string"), " · ", mid))
    return table(spark, d, "documents").select("doc_id", V.position_weight(name).alias("weight"))


@query("""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents) select doc_id, cast(len(w) as integer) as n, md5(array_to_string(list_transform(w, lambda x: 'say "' || x || '"'), '|')) as facts from w""")
def salvaged_facts(spark, d):
    """Facts of a JSON answer that was cut off in the middle: its words, each quoted."""
    w = T.latin_tokens(F.col("text"))
    raw = _join('{"facts": [', F.array_join(F.transform(w, lambda x: _join('{"fact" : "say \\"', x, '\\"", "at": 1}')), ", "), ', {"fact": ""}, {"fact": "cut o')
    got = V.salvaged_facts(raw)
    return table(spark, d, "documents").select("doc_id", F.size(got).alias("n"), _MD5(F.array_join(got, "|")).alias("facts"))


@query("""select doc_id, case when doc_id % 5 = 4 then null else doc_id end as id, case when doc_id % 5 = 4 then null else source end as source from documents""")
def json_answers(spark, d):
    """JSON objects in fences, alone, inside prose, with other braces in strings; and broken ones."""
    i = F.col("doc_id")
    body = F.to_json(F.struct(i.alias("id"), F.col("source").alias("source"), F.lit("a } b").alias("note")))
    k = i % 5
    raw = F.when(k == 0, _join("Here:\n```json\n", body, "\n```\nDone.")).when(k == 1, body).when(k == 2, _join("I think ", body, " is right")).when(k == 3, _join("```\n", body, "\n```")).otherwise(F.left(body, F.length(body) - 9))
    got = T.json_object(raw)
    return table(spark, d, "documents").select("doc_id", F.get_json_object(got, "$.id").cast("bigint").alias("id"), F.get_json_object(got, "$.source").alias("source"))


@query(f"""with f as (select doc_id, regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}} \\t\\n\\x0B\\f\\r]', '', 'g') as t from documents)
select doc_id, md5(array_to_string(list_filter(string_split_regex(t, '{_S}+'), lambda w: w not in ('', 'a', 'an', 'the')), ' ')) as answer from f""")
def plain_answers(spark, d):
    return table(spark, d, "documents").select("doc_id", _MD5(V.plain_answer(F.col("text"))).alias("answer"))


@query("""with f as (select user_id, event_type, count(*) as n, bool_and(value > 20) as noisy from events group by 1, 2), c as (select event_type, count(*) as claims, count(*) filter (noisy) as noisy from f group by 1)
select event_type, claims, noisy, noisy * 10 > claims * 3 as abnormal from c""")
def noisy_claims(spark, d):
    """Claims that every round flags, and whether they are so many that the flagging itself is in doubt."""
    flags = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.bool_and(F.col("value") > 20).alias("noisy"))
    per = flags.groupBy("event_type").agg(F.count(F.lit(1)).alias("claims"), F.count_if("noisy").alias("noisy"))
    return per.withColumn("abnormal", B.too_noisy(F.col("noisy"), F.col("claims")))


@query("""with p as (select doc_id, greatest(cast(length(text) / 3 as integer), 1) as n, text from documents)
select doc_id, md5(array_to_string(list_filter([substr(text, 1, 3), substr(text, 4, 7), substr(text, n + 1, 20)], lambda x, i: list_position([substr(text, 1, 3), substr(text, 4, 7), substr(text, n + 1, 20)], x) = i), ' ')) as spans from (select doc_id, text, cast(floor(length(text) / 3) as bigint) + 12 as n from documents)""")
def annotated_spans(spark, d):
    """Spans of a text that a JSON list names out of order, one of them twice."""
    n = (F.floor(F.length("text") / 3) + 12).cast("int")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    notes = F.to_json(F.array(span(n, n + 20), span(F.lit(0), F.lit(3)), span(F.lit(3), F.lit(10)), span(F.lit(0), F.lit(3))))
    return table(spark, d, "documents").select("doc_id", _MD5(I.first_spans(notes, F.col("text"))).alias("spans"))


@query("""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]+'))) as w from documents) select doc_id, count(*) filter (regexp_matches(w, '[A-Za-z]') and not regexp_matches(w, '[0-9]') and not regexp_matches(w, '[A-Z]')) as fragile, count(*) as n from w group by 1""")
def fragile_anchors(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.matches(F.col("text"), "[A-Za-z0-9]+"))).alias("w"))
    return w.groupBy("doc_id").agg(F.count_if(T.fragile_anchor(F.col("w"))).alias("fragile"), F.count(F.lit(1)).alias("n"))


@query("select user_id % 7 as grp, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def inputs_without_gold(spark, d):
    """A table goes on only if no gold column hides in it at any depth."""
    rows = I.assert_no_gold(table(spark, d, "events").select("user_id", F.struct("value", F.array(F.struct("event_type")).alias("more")).alias("said")), ("gold", "answer", "label"))
    return rows.groupBy((F.col("user_id") % 7).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("said.value"), 6).alias("mean"))


@query("""with m as (select event_id, 'L' || (user_id % 7) as layer, case when event_id % 11 = 0 then '  ' else event_type end as name, case when event_id % 13 = 0 then 'nan'::double when event_id % 17 = 0 then 'inf'::double when event_id % 19 = 0 then null else value end as value, event_id % 5 as n from events)
select layer, count(*) filter (layer <> 'L6' and trim(name, ' ') <> '' and value is not null and isfinite(value) and n > 0) as valid, count(*) as n from m group by 1""")
def metric_validation(spark, d):
    i = F.col("event_id")
    value = F.when(i % 13 == 0, F.lit(float("nan"))).when(i % 17 == 0, F.lit(float("inf"))).when(i % 19 == 0, None).otherwise(F.col("value"))
    rows = table(spark, d, "events").select(_join("L", (F.col("user_id") % 7).cast("string")).alias("layer"), F.when(i % 11 == 0, "  ").otherwise(F.col("event_type")).alias("name"), value.alias("value"), (i % 5).alias("n"))
    ok = F.coalesce(I.valid_metric(F.col("name"), F.col("value"), F.col("n"), F.col("layer")), F.lit(False))
    return rows.groupBy("layer").agg(F.count_if(ok).alias("valid"), F.count(F.lit(1)).alias("n"))


@query("""with q as (select conv_id, turn, role, case turn % 6 when 0 then 'How many ' || text when 1 then ' Is ' || text when 2 then text || ' 多少' when 3 then text || '是吗？' when 4 then 'What score has ' || text else text end as q from conversations)
select conv_id, turn, role, regexp_matches(lower(q), 'how (many|much|large|long|often)|what (number|percentage|size|value|accuracy|score)|多少|几') as asks_number, regexp_matches(lower(trim(q, ' ')), '^(is|are|was|were|do|does|did|can|could|has|have|will|should)\\b|是否|吗[?？]?$') as asks_verdict from q""")
def question_kinds(spark, d):
    t, k = F.col("text"), F.col("turn") % 6
    q = F.when(k == 0, _join("How many ", t)).when(k == 1, _join(" Is ", t)).when(k == 2, _join(t, " 多少")).when(k == 3, _join(t, "是吗？")).when(k == 4, _join("What score has ", t)).otherwise(t)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", T.asks_number(q).alias("asks_number"), T.asks_verdict(q).alias("asks_verdict"))


@query(PATHS + GOLD + """, topics as (select distinct g.qid, d.source as topic from gold g join documents d on d.doc_id = g.key), n as (select qid, count(*) as n_topics from topics group by 1),
m as (select p.qid, p.route, k, count(distinct p.owner) as met from paths p join gold g on g.qid = p.qid and g.key = p.key cross join (values (5), (20), (100)) t(k) where p.rank <= k group by 1, 2, 3),
l as (select distinct p.qid, p.route, k from paths p cross join (values (5), (20), (100)) t(k))
select l.qid, l.route, l.k, n.n_topics, coalesce(met, 0) as met, round(coalesce(met, 0) / cast(n_topics as double), 6) as recall from l join n using (qid) left join m on m.qid = l.qid and m.route = l.route and m.k = l.k""")
def subtopic_recall(spark, d):
    """The share of a question's subtopics (sources with a gold document) that the first k gold hits belong to."""
    topics = gold(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("topic")), "key")
    return M.subtopic_recall(paths(spark, d), topics, (5, 20, 100))


@query("""with r as (select d.lang, l.quality = 1 as truth, d.n_chars > 1200 as said from documents d join labels l using (doc_id) where l.quality is not null),
c as (select lang, count(*) filter (truth and said) as tp, count(*) filter (not truth and said) as fp, count(*) filter (truth and not said) as fn, count(*) filter (not truth and not said) as tn from r group by 1)
select lang, tp, fp, fn, tn, round(tp / nullif(cast(tp + fp as double), 0), 6) as precision, round(tp / nullif(cast(tp + fn as double), 0), 6) as recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round((tp + tn) / cast(tp + fp + fn + tn as double), 6) as accuracy from c""")
def classification_report(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 1200).alias("said")).join(table(spark, d, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id")
    return M.confusion(rows, F.col("truth"), F.col("said"), ("lang",))


@query()
def cross_validated_classes(spark, d):
    """Toxic or not from five features of a text, by logistic regression over five folds; figures of each fold."""
    t = T.surface_features(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", *(t[c].cast("double").alias(c) for c in ("n_chars", "n_words", "n_acronyms", "n_camel", "n_proper"))).join(table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("truth")), "doc_id")
    return M.cross_validated(rows, ("n_chars", "n_words", "n_acronyms", "n_camel", "n_proper"), "truth", "doc_id", 5)


@query("""with a as (select doc_id, source, list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) as said, coalesce(lag(text) over (partition by source order by doc_id), '') as evidence from documents)
select source, count(*) as answers, sum(len(said))::bigint as n, sum(len(list_filter(said, lambda x: contains(evidence, x))))::bigint as held, round(sum(len(list_filter(said, lambda x: contains(evidence, x)))) / nullif(cast(sum(len(said)) as double), 0), 6) as coverage from a group by 1""")
def support_coverage(spark, d):
    """The share of the numbers of answers that stand in their evidence (here: the document before of the same source)."""
    said = F.array_distinct(T.matches(F.col("text"), r"[0-9]+(?:\.[0-9]+)?"))
    docs = table(spark, d, "documents")
    # Ids are numbered, not texts: the text before comes by its id, whatever share of all documents a source has.
    placed = J.numbered(docs.select("source", "doc_id"), "source", "doc_id")
    earlier = placed.select(F.col("source").alias("_source"), (F.col("pos") + 1).alias("_next"), F.col("doc_id").alias("before"))
    linked = placed.join(earlier, F.col("source").eqNullSafe(F.col("_source")) & (F.col("pos") == F.col("_next")), "left").select("doc_id", "before")
    texts = docs.select(F.col("doc_id").alias("before"), F.col("text").alias("evidence"))
    rows = docs.select("doc_id", "source", said.alias("said")).join(linked, "doc_id").join(texts, "before", "left").select("source", "said", F.coalesce("evidence", F.lit("")).alias("evidence"))
    return M.coverage(rows, F.col("said"), F.col("evidence"), ("source",))


@query(f"""with a as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 12)) as anchors, text, replace(replace(text, 'a', ''), chr(10), '') as l0 from documents)
select doc_id, cast(len(anchors) as integer) as n, cast(len(list_filter(anchors, lambda w: {_anchor_sql('@', 'l0').replace("'@'", 'w')})) as integer) as in_l0, cast(len(list_filter(anchors, lambda w: {_anchor_sql('@', 'text').replace("'@'", 'w')})) as integer) as in_l3 from a""")
def gold_reachability(spark, d):
    """How many anchors of a question can be met in two views of its document, the first of which has lost letters."""
    anchors = F.array_distinct(F.filter(T.matches(F.lower("text"), "[a-z]+"), lambda w: F.length(w) >= 12))
    l0 = F.replace(F.replace("text", F.lit("a"), F.lit("")), F.lit("\n"), F.lit(""))
    met = M.reachable(anchors, {"in_l0": l0, "in_l3": F.col("text")})
    return table(spark, d, "documents").select("doc_id", F.size(anchors).alias("n"), *(c.alias(k) for k, c in met.items()))


@query("""select o_orderkey, cast(greatest(0, floor((o_totalprice - 2 * (1 + o_custkey % 7)) / (1 + o_custkey % 7))) as bigint) as items from orders""")
def judgeable_items(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.judgeable_items(F.col("o_totalprice"), 1 + F.col("o_custkey") % 7).alias("items"))


@query(PATHS + GOLD + """, h as (select p.qid, p.route, k, max(cast(g.key is not null as integer)) as hit from paths p left join gold g on g.qid = p.qid and g.key = p.key cross join (values (1), (2), (5), (20)) t(k) where p.rank <= k group by 1, 2, 3),
p as (select a.k, a.qid, a.hit as x, b.hit as y from h a join h b on a.qid = b.qid and a.k = b.k and a.route = 'length' and b.route = 'hash')
select k, count(*) as n, round(avg(x), 6) as mean_x, round(avg(y), 6) as mean_y, round(avg(y) - avg(x), 6) as delta, count(*) filter (y > x) as gained, count(*) filter (x > y) as lost,
  round(least(1.0, 2 * (select sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))) from range(0, least(up, down) + 1) t(i))), 6) as p_exact
  from (select *, count(*) filter (y > x) over (partition by k) as up, count(*) filter (x > y) over (partition by k) as down, count(*) filter (x <> y) over (partition by k) as m from p) group by k, up, down, m""")
def paired_decisions(spark, d):
    """For each depth: both systems' hit rates, their difference, and how many questions changed sides, with the exact test and the interval of the mean."""
    swept = M.judged(paths(spark, d), gold(spark, d)).withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 5, 20))))).where(F.col("rank") <= F.col("k"))
    hits = swept.groupBy("qid", "route", "k").agg(F.max(F.col("hit").cast("int")).alias("hit"))
    x, y = (hits.where(F.col("route") == r).select("qid", "k", F.col("hit").alias(n)) for r, n in (("length", "x"), ("hash", "y")))
    return M.paired_decisions(x.join(y, ["qid", "k"]), "k", "qid").select("k", "n", "mean_x", "mean_y", "delta", "gained", "lost", F.round("p_exact", 6).alias("p_exact"))


def _fused_sql(mode: str, order: str, pool: str) -> str:
    return f"select '{mode}' as mode, qid, key, cast(row_number() over (partition by qid order by {order}) as integer) as rank from {pool}"


_SPLIT = """, lists as (select qid, key, score, case when owner = 'src0' then 1 else 0 end as corpus, cast(row_number() over (partition by qid, owner = 'src0' order by rank) as integer) as rank from paths where route = 'length'),
outside as (select qid, key, score as ce from paths where route = 'hash'), pool as (select b.*, coalesce(o.ce, -1e9) as ce from lists b left join outside o using (qid, key) where b.rank <= case corpus when 0 then 20 else 5 end),
rrf as (select *, round(case corpus when 0 then 0.7 else 0.3 end / (60 + rank), 12) as s from lists)"""


@query(PATHS + _SPLIT + ", u as (" + " union all ".join((_fused_sql("rrf", "s desc, key", "rrf"), _fused_sql("quota", "corpus, rank", "pool"), _fused_sql("score", "score desc, key", "pool"), _fused_sql("ce", "ce desc, corpus, rank", "pool"))) + ") select mode, qid, key, rank from u where rank <= 30")
def cross_corpus_modes(spark, d):
    """Two corpora merged by rank, by quota, by their own scores, and by outside scores."""
    rows = paths(spark, d).where("route = 'length'").drop("route", "rank")
    old, new = (R.ranked(rows.where(c), ("qid",)) for c in ("owner <> 'src0'", "owner = 'src0'"))
    outside = paths(spark, d).where("route = 'hash'").select("qid", "key", "score")
    modes = [R.cross_corpus(old, new, mode, 20, 5, weight=0.3, outside=outside).where("rank <= 30").select(F.lit(mode).alias("mode"), "qid", "key", "rank") for mode in ("rrf", "quota", "score", "ce")]
    every = modes[0]
    for m in modes[1:]:
        every = every.unionByName(m)
    return every


@query(PATHS + """, e as (select p.qid, p.key as seed, p.rank, l.l_partkey % 500 as cited from paths p join lineitem l on l.l_orderkey = p.key where p.route = 'length' and p.rank <= 20),
v as (select qid, cited as key, sum(1.0 / rank) as votes from (select distinct qid, seed, rank, cited from e) group by 1, 2),
j as (select b.qid, b.key, b.score, coalesce(v.votes, 0.0)::double as votes from paths b left join v using (qid, key) where b.route = 'hash'),
z as (select *, avg(score) over w as ms, stddev_pop(score) over w as ss, avg(votes) over w as mv, stddev_pop(votes) over w as sv from j window w as (partition by qid)),
f as (select qid, key, round(case when ss > 1e-9 then (score - ms) / ss else 0 end + 0.5 * case when sv > 1e-9 then (votes - mv) / sv else 0 end, 6) as fused from z)
select qid, key, fused, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by fused desc, key) as rank from f) where rank <= 20""")
def citation_fusion(spark, d):
    """Outside scores and citation votes, both as z-scores of their list, added up."""
    seeds = paths(spark, d).where("route = 'length' and rank <= 20").select("qid", F.col("key").alias("seed"), "rank")
    edges = seeds.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seed"), (F.col("l_partkey") % 500).alias("key")), "seed").distinct()
    votes = edges.groupBy("qid", "key").agg(F.sum(1.0 / F.col("rank")).alias("votes"))
    rows = paths(spark, d).where("route = 'hash'").select("qid", "key", "score").join(votes, ["qid", "key"], "left").fillna(0.0, ["votes"])
    return R.z_added(rows, {"score": 1.0, "votes": 0.5}, 20)


@query("""with q as (select doc_id as qid, case doc_id % 6 when 0 then 'What says paper ' || (doc_id % 9 + 1) || '?' when 1 then 'compare Paper A with the 2nd paper' when 2 then 'is the deep ' || source || ' net better than ' || 'src1 net?' when 3 then 'see the third paper' when 4 then lower(source) || ' and src1' else text end as question from documents),
p as (select source, cast(row_number() over (order by source) as integer) as no from (select distinct source from documents)), n as (select source, no, unnest(['deep ' || source || ' net', source]) as name from p),
o as (select qid, try_cast(unnest(regexp_extract_all(lower(question), '\\bpaper (\\d{1,3})\\b', 1)) as integer) as no from q union select qid, try_cast(unnest(regexp_extract_all(lower(question), '\\b(\\d{1,3})(?:st|nd|rd|th) paper\\b', 1)) as integer) from q union select qid, ascii(unnest(regexp_extract_all(lower(question), '\\bpaper ([a-z])\\b', 1))) - 96 from q
  union select qid, list_position(['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth'], unnest(regexp_extract_all(lower(question), '\\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth) paper\\b', 1))) from q),
w as (select qid, regexp_replace(' ' || array_to_string(regexp_extract_all(lower(question), '[a-z0-9_-]+'), ' ') || ' ', 'x^', '') as words from q), m as (select w.qid, n.source, n.name from w join n on contains(w.words, ' ' || lower(n.name) || ' ')),
k as (select distinct qid, source from m where not exists (select 1 from m o where o.qid = m.qid and o.source <> m.source and contains(lower(o.name), lower(m.name))))
select qid, source as paper from k union select qid, source from o join p using (no)""")
def focus_patterns(spark, d):
    """Papers that a question names by number, ordinal, letter, or a name of one or more words."""
    docs = table(spark, d, "documents")
    i, s = F.col("doc_id"), F.col("source")
    k = i % 6
    text = (
        F.when(k == 0, _join("What says paper ", (i % 9 + 1).cast("string"), "?")).when(k == 1, "compare Paper A with the 2nd paper").when(k == 2, _join("is the deep ", s, " net better than src1 net?")).when(k == 3, "see the third paper").when(k == 4, _join(F.lower(s), " and src1"))
        .otherwise(F.col("text"))
    )
    one = docs.select("source", F.lit(1).alias("n")).distinct()
    papers = S.prefix_sums(one, (), "source", ("n",)).select("source", (F.col("n_before") + 1).cast("int").alias("no"))
    names = papers.select(F.col("source").alias("paper"), F.explode(F.array(_join("deep ", s, " net"), s)).alias("name"))
    return B.focus(docs.select(i.alias("qid"), text.alias("question")), papers.select(F.col("source").alias("paper"), "no"), names)


@query(PATHS + """, m as (select owner as paper, key, max(score) as score from paths where owner in ('src0', 'src3', 'src7') group by 1, 2) select paper, key, score, cast(rank as integer) as rank from (select *, row_number() over (partition by paper order by score desc, key) as rank from m) where rank <= 6""")
def focused_material(spark, d):
    """The best keys of each paper in focus, for one report over several papers."""
    focus = spark.createDataFrame([("src0",), ("src3",), ("src7",)], "paper string")
    rows = paths(spark, d).groupBy(F.col("owner").alias("paper"), "key").agg(F.max("score").alias("score"))
    return B.material(rows, 6, focus)


@query(PATHS + """, v as (select p.qid, p.key, p.rank, case l.quality when 1 then 'yes' when 0 then 'no' else 'unclear' end as verdict from paths p left join labels l on l.doc_id = p.key where p.route = 'length'),
r as (select *, row_number() over (partition by qid, verdict order by rank) as n, count(*) over (partition by qid, verdict) as of_kind from v)
select qid, key, verdict, cast(row_number() over (partition by qid order by verdict = 'unclear', rank) as integer) as place, cast(case when verdict = 'unclear' then of_kind - 5 end as bigint) as unshown from (select *, case when verdict = 'unclear' and of_kind > 5 then 1 end as x from r) where verdict = 'yes' or verdict = 'unclear' and n <= 5""".replace("cast(case when verdict = 'unclear' then of_kind - 5 end as bigint)", "cast(case when verdict = 'unclear' then greatest(of_kind - 5, 0) end as bigint)"))
def answer_listing(spark, d):
    """What is shown for a question: what was accepted, in order, then five of what stayed unclear, with how many more there are."""
    verdict = F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").otherwise("unclear")
    rows = paths(spark, d).where("route = 'length'").join(table(spark, d, "labels").select(F.col("doc_id").alias("key"), "quality"), "key", "left").select("qid", "key", "rank", verdict.alias("verdict"))
    return B.listing(rows, 5)


@query("""with m as (select event_id, case event_type when 'click' then 'Acc' when 'view' then 'BLEU score' else 'LaSE' end as name, cast(event_id % 1000 as varchar) as value, 'we get ' || case when event_id % 2 = 0 then cast(event_id % 1000 as varchar) else 'more' end as quote, event_id % 7 > 1 as located from events)
select event_id, case name when 'Acc' then 'Accuracy' when 'BLEU score' then 'BLEU' else name end as metric, name <> 'LaSE' as comparable, value from m where located and contains(replace(quote, ' ', ''), value)""")
def verified_metrics(spark, d):
    """Only values that stand in their quote, which was found; with their plain names and whether those can be compared."""
    i = F.col("event_id")
    value = (i % 1000).cast("string")
    name = F.when(F.col("event_type") == "click", "Acc").when(F.col("event_type") == "view", "BLEU score").otherwise("LaSE")
    rows = table(spark, d, "events").select(i, name.alias("name"), value.alias("value"), _join("we get ", F.when(i % 2 == 0, value).otherwise("more")).alias("quote"), (i % 7 > 1).alias("located"))
    metric, comparable = V.canonical_metric(F.col("name"))
    kept = rows.where(V.strict_verdict(F.col("located"), F.col("value"), F.lit(""), F.col("quote"), F.lit(False))["verify"] == "exact")
    return kept.select("event_id", metric.alias("metric"), comparable.alias("comparable"), "value")


@query("""select lang, count(*) as n, count(*) filter (not contains(text, '|') and not regexp_matches(text, '[ ]{2,}|^[ \\n]|[ \\n]$')) as clean, round(count(*) filter (not contains(text, '|') and not regexp_matches(text, '[ ]{2,}|^[ \\n]|[ \\n]$')) / cast(count(*) as double), 6) as rate, median(n_chars) as median_size from documents group by 1""")
def format_clean_rate(spark, d):
    """How many answers hold to their format (here: no tables, no stray spaces), and the median size."""
    clean = ~F.col("text").contains("|") & ~F.col("text").rlike(r"[ ]{2,}|^[ \n]|[ \n]\z")
    n = F.count(F.lit(1))
    return table(spark, d, "documents").groupBy("lang").agg(n.alias("n"), F.count_if(clean).alias("clean"), F.round(F.count_if(clean) / n, 6).alias("rate"), F.median("n_chars").alias("median_size"))


@query("""with s as (select doc_id, case doc_id % 4 when 0 then md5(text) when 1 then md5(text || 'x') when 2 then null else md5(text) end as stored, case when doc_id % 9 = 0 then null else md5(text) end as now from documents)
select case when now is null then 'unknown' when stored is null then 'adopt' when stored = now then 'ok' else 'stale' end as state, count(*) as n from s group by 1""")
def content_identity(spark, d):
    i, h = F.col("doc_id"), F.md5(F.col("text").cast("binary"))
    stored = F.when(i % 4 == 0, h).when(i % 4 == 1, F.md5(F.concat("text", F.lit("x")).cast("binary"))).when(i % 4 == 3, h)
    return table(spark, d, "documents").select(V.identity(stored, F.when(i % 9 != 0, h)).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_JOBS = """with log as (select user_id as job, case event_type when 'click' then 'queued' when 'view' then 'running' when 'purchase' then 'ready' else 'failed' end as state, ts, event_id as seq from events),
states as (select job, arg_max(state, (ts, seq)) as state from log group by 1)"""


def _jobs(spark, d):
    state = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "ready").otherwise("failed")
    return L.job_states(table(spark, d, "events").select(F.col("user_id").alias("job"), state.alias("state"), "ts", F.col("event_id").alias("seq")))


@query(_JOBS + " select job, case when state = 'running' then 'failed' else state end as state from states")
def recovered_jobs(spark, d):
    """Job states after a crash: what was running has failed."""
    return L.recovered(_jobs(spark, d)).select("job", "state")


@query(_JOBS + ", asked as (select distinct (event_id * 3) % 700 as job from events where event_id % 5 = 0) select job from asked where job not in (select job from states where state in ('queued', 'running'))")
def single_flight(spark, d):
    """Requests for jobs, one a key, of which none is under way."""
    asked = table(spark, d, "events").where("event_id % 5 = 0").select((F.col("event_id") * 3 % 700).alias("job"))
    return L.submitted_once(asked, "job", _jobs(spark, d)).select("job")


@query("""with p as (select doc_id as key, floor(doc_id / 40)::bigint as block from documents), s as (select distinct doc_id as key from labels)
select block, count(*) as pairs, count(*) filter (s.key is null) as left_over from p left join s using (key) group by 1 having count(*) filter (s.key is null) > 0""")
def scoring_blocks(spark, d):
    """Blocks of pairs that still have something to score; a run that was cut short goes on with these."""
    pairs = table(spark, d, "documents").select(F.col("doc_id").alias("key"))
    return L.unscored_blocks(pairs, table(spark, d, "labels").select(F.col("doc_id").alias("key")), 40)


@query("""with recursive e as (select user_id % 50 as job, case event_type when 'click' then 'queued' when 'view' then 'running' when 'purchase' then 'ready' when 'error' then 'failed' else 'running' end as state, ts, event_id as seq from events),
o as (select *, epoch_us(ts) as us, row_number() over (partition by job order by ts, seq) as n from e),
m as (select job, n, seq, us, state as wanted, null::varchar as before, null::bigint as lost_at, case when state = 'queued' then 'queued' end as now, case when state = 'queued' then us + 900000000 else 0 end as until, state = 'queued' as taken from o where n = 1
union all select o.job, o.n, o.seq, o.us, o.state, b.before, b.lost_at, case when b.ok then o.state else b.before end, case when b.ok then o.us + 900000000 else m.until end, b.ok from m join o on o.job = m.job and o.n = m.n + 1,
  lateral (select case when m.now = 'running' and m.until < o.us then 'failed' else m.now end as before, case when m.now = 'running' and m.until < o.us then m.until end as lost_at) l,
  lateral (select l.before, l.lost_at, case when l.before is null then o.state = 'queued' when l.before = 'queued' then o.state in ('running', 'failed', 'cancelled') when l.before = 'running' then o.state <> 'queued' else o.state = 'queued' end as ok) b),
w as (select max(us) - 60000000 as mark from o), last as (select * from m qualify row_number() over (partition by job order by n desc) = 1),
a as (select job, now as state, case when taken then 'taken' else 'refused' end as verdict, us from m union all select job, 'failed', 'lost', lost_at from m where lost_at is not null union all select job, 'failed', 'lost', until from last, w where now = 'running' and until < mark)
select job, state, verdict, count(*) as n, max(us) as last from a group by 1, 2, 3""")
def job_machine(spark, d):
    """Events as a stream through the job state machine, in two runs with a restart between; what was told, by job, state and verdict."""
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "error", "failed").otherwise("running")
    rows = e.select((F.col("user_id") % 50).alias("job"), state.alias("state"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"))
    source, told, kept = (scratch.folder(spark, name) for name in ("job_events", "job_told", "job_state"))
    half = rows.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    for part in (rows.where(F.col("ts") < F.lit(half)), rows.where(F.col("ts") >= F.lit(half))):
        part.coalesce(4).write.mode("append").parquet(source)
        stream = L.job_machine(spark.readStream.schema(rows.schema).parquet(source), 900)
        stream.writeStream.format("parquet").option("path", told).option("checkpointLocation", kept).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(told).groupBy("job", "state", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ts")).alias("last"))
