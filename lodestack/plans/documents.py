"""Queries of text, structure, verification and report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import tables as H
from ..functions import tabular as TF
from ..functions import text as T
from ..operators import ranking as R
from ..operators import reports as B
from ..operators import structure as D
from ..operators import verification as V
from ..sources import readers as I
from .ranking import PATHS, one, paths
from .registry import query, table

_SPACE = "[ \\t\\r\\n\\x0B\\f]+"


@query(f"""select doc_id, md5(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) as squeezed, md5(regexp_replace(trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g')), '[^a-z0-9]+', '', 'g')) as alnum, regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') as cjk,
  regexp_matches(text, '[A-Za-z]{{3,}}|[0-9]') as specific, cast(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: length(w) >= 9)) as bigint) as long_words from documents""")
def text_projection(spark, d):
    t = F.col("text")
    md5 = lambda c: F.md5(c.cast("binary"))
    longer = F.size(F.filter(F.array_distinct(T.latin_tokens(t)), lambda w: F.length(w) >= 9)).cast("long")
    return table(spark, d, "documents").select("doc_id", md5(T.squeezed(t)).alias("squeezed"), md5(T.alnum(t)).alias("alnum"), T.has_cjk(t).alias("cjk"), T.is_specific(t).alias("specific"), longer.alias("long_words"))


@query("""with p as (select doc_id, case doc_id % 4 when 0 then [source || ' · Intro ', 'x'] when 1 then ['1 · Method', '2 · ' || lang] when 2 then ['(PREAMBLE)'] else ['References'] end as path, text from documents)
select doc_id, trim(case when instr(path[1], ' · ') > 0 then substr(path[1], instr(path[1], ' · ') + 3) else path[1] end) as top, case doc_id % 4 when 0 then 'Intro' when 1 then lang else path[-1] end as last_one,
  trim(text) <> '' and path <> ['(PREAMBLE)'] and path[1] <> 'References' as extractable from p join documents using (doc_id, text)""")
def section_projection(spark, d):
    k = F.col("doc_id") % 4
    path = F.when(k == 0, F.array(F.concat("source", F.lit(" · Intro ")), F.lit("x"))).when(k == 1, F.array(F.lit("1 · Method"), F.concat(F.lit("2 · "), "lang"))).when(k == 2, F.array(F.lit("(PREAMBLE)"))).otherwise(F.array(F.lit("References")))
    p = table(spark, d, "documents").withColumn("path", path)
    keep = (F.trim("text") != "") & (F.col("path") != F.array(F.lit("(PREAMBLE)"))) & (F.element_at("path", 1) != "References")
    return p.select("doc_id", T.top_section(F.element_at("path", 1)).alias("top"), T.last_section(F.col("path")).alias("last_one"), keep.alias("extractable"))


@query("""select o_orderpriority as qid, o_orderkey as key, cast(rn as integer) as rank from (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rn from orders where datediff('day', date '1970-01-01', cast(o_orderdate as date)) between datediff('day', date '1970-01-01', date '1995-01-01') and datediff('day', date '1970-01-01', date '1996-06-01')) where rn <= 10""")
def time_window_topk(spark, d):
    """The window is applied before ranking; a bound that is no date is an error."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    inside = table(spark, d, "orders").where(day.between(T.coarse_day(F.lit("1995")), T.coarse_day(F.lit("1996-06"))))
    return R.top_k(inside, 10, ("o_orderpriority",), (F.desc("o_totalprice"), F.asc("o_orderkey"))).select(F.col("o_orderpriority").alias("qid"), F.col("o_orderkey").alias("key"), "rank")


def _anchor_sql(a: str, text: str = "text") -> str:
    plain = f"lower(regexp_replace({text}, '[*_`#]+', '', 'g'))"
    return f"(contains({plain}, '{a}') or contains(regexp_replace({plain}, '{_SPACE}', '', 'g'), '{a}'))"


@query(f"""select doc_id, {_anchor_sql('the')} and {_anchor_sql('of')} as all_hit, {_anchor_sql('idiot')} or {_anchor_sql('que')} as any_hit,
  {_anchor_sql('the')} and ({_anchor_sql('is')} or {_anchor_sql('der')}) and not {_anchor_sql('moron', "regexp_replace(text, '\"[^\"]*\"|“[^”]*”', ' ', 'g')")} as verdict from documents""")
def anchor_verdict(spark, d):
    words = lambda *w: F.array(*map(F.lit, w))
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.hit_all(words("the", "of"), t).alias("all_hit"), T.hit_any(words("idiot", "que"), t).alias("any_hit"), T.keyword_verdict(t, words("the"), words("is", "der"), words("moron")).alias("verdict"))


@query("""select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?'))), ' ') as numbers from documents""")
def plain_number_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(F.array_distinct(T.matches(F.col("text"), r"[0-9][0-9,]*(?:\.[0-9]+)?"))), " ").alias("numbers"))


@query()
def numeric_scan(spark, d):
    n = table(spark, d, "documents").select("doc_id", N.numbers(F.col("text")).alias("n"), N.significant_numbers(F.col("text")).alias("s"))
    return n.select("doc_id", F.size("n").alias("n_numbers"), F.size(F.filter("n", lambda x: x["percent"])).alias("n_percent"), F.size("s").alias("n_significant"), F.aggregate("n", F.lit(0.0), lambda s, x: F.greatest(s, x["value"])).alias("largest"))


@query()
def number_support(spark, d):
    """Numbers of a document's first part against its second part, and against what other documents of its source hold."""
    docs = table(spark, d, "documents")
    half = F.greatest(F.floor(F.length("text") / 2).cast("int"), F.lit(1))
    answers = docs.select(F.col("doc_id").alias("qid"), "source", F.lit("").alias("question"), F.substr("text", F.lit(1), half).alias("answer"), F.substr("text", half + 1).alias("evidence"))
    chunks = docs.select(F.col("doc_id").alias("qid"), "source", F.concat(F.lit("c"), F.col("doc_id")).alias("chunk"), "text")
    return V.number_support(answers, chunks, group="source").select("qid", F.size("supplements").alias("n_supplements"), F.size("unverified").alias("n_unverified"))


@query("""with a as (select doc_id, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: substr(x, 1, 6)) as cited, n_chars % 40 as n from documents)
select doc_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(cited, lambda x: cast(x as integer))), lambda x: (x < 1 or x > n) and (doc_id % 2 = 0 or len(cited) = 0 or '[' || x || ']' <> '[' || cited[1] || ']'))), ',') as issues from a""")
def citation_bounds(spark, d):
    """The numbers of a document as citations into a list; in every other one the first of them stands in the evidence as it is."""
    cited = F.transform(T.matches(F.col("text"), "[0-9]+"), lambda x: F.concat(F.lit("["), F.substring(x, 1, 6), F.lit("]")))
    evidence = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("as "), F.try_element_at("cited", F.lit(1)), F.lit(" says")))
    rows = table(spark, d, "documents").select("doc_id", "n_chars", cited.alias("cited"))
    issues = V.citation_issues(F.concat(F.lit("Yes "), F.array_join("cited", " and ")), F.col("n_chars") % 40, evidence)
    return rows.select("doc_id", F.array_join(F.transform(issues, lambda x: x.cast("string")), ",").alias("issues"))


@query("""with g as (select d.doc_id, case d.doc_id % 4 when 0 then 'core_claim' when 1 then 'result_primary' when 2 then 'method' else 'detail' end as label, case when d.n_chars % 3 = 0 then 2.0e0 when d.n_chars % 3 = 1 then 1.0e0 else 0.0e0 end as pos, 1 + d.n_chars % 4 as sections,
  d.text as text, case when l.quality = 1 then 'hit' when l.quality = 0 then 'miss' else 'loose' end as ev from documents d left join labels l using (doc_id)),
s as (select doc_id, label, (case label when 'core_claim' then 4.0e0 when 'result_primary' then 4.0e0 when 'method' then 3.0e0 else 1.0e0 end + pos + least(greatest(sections - 1, 0), 2) * 0.3e0 + case when label = 'result_primary' then case when regexp_matches(lower(text), '%|percent|fold|outperform|improve|reduce|surpass|exceed|greater|higher') then 0.6e0 else -0.5e0 end else 0.0e0 end + case ev when 'hit' then 0.3e0 when 'loose' then 0.0e0 else -0.8e0 end)::double as total from g)
select doc_id, cast(greatest(1, least(case label when 'detail' then 3 else 5 end, round_even(total, 0))) as integer) as importance from s""")
def importance_score(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    k, m = F.col("doc_id") % 4, F.col("n_chars") % 3
    label = F.when(k == 0, "core_claim").when(k == 1, "result_primary").when(k == 2, "method").otherwise("detail")
    pos = F.when(m == 0, 2.0).when(m == 1, 1.0).otherwise(0.0)
    ev = F.when(F.col("quality") == 1, "hit").when(F.col("quality") == 0, "miss").otherwise("loose")
    return docs.select("doc_id", V.importance(label, pos, (1 + F.col("n_chars") % 4).cast("int"), F.col("text"), ev).alias("importance"))


@query("""with m as (select event_id, case event_type when 'click' then 'Acc' when 'view' then 'BLEU score' else 'LaSE' end as name, case when event_id % 3 = 0 then 'Test set' else 'CNN/DM (mT5)' end as dataset, cast(round(value, 2) as varchar) as value, 'we get ' || case when event_id % 2 = 0 then cast(round(value, 2) as varchar) else 'more' end as quote from events)
select event_id, case name when 'Acc' then 'Accuracy' when 'BLEU score' then 'BLEU' else name end as metric, name <> 'LaSE' as comparable, case when dataset = 'Test set' then '' else 'CNN/DM' end as dataset, case when dataset = 'Test set' then '' else 'mT5' end as model, contains(replace(replace(quote, ',', ''), ' ', ''), replace(value, ',', '')) as value_quoted from m""")
def metric_normalisation(spark, d):
    v = F.round("value", 2).cast("string")
    name = F.when(F.col("event_type") == "click", "Acc").when(F.col("event_type") == "view", "BLEU score").otherwise("LaSE")
    rows = table(spark, d, "events").select("event_id", name.alias("name"), F.when(F.col("event_id") % 3 == 0, "Test set").otherwise("CNN/DM (mT5)").alias("dataset"), v.alias("value"), F.concat(F.lit("we get "), F.when(F.col("event_id") % 2 == 0, v).otherwise("more")).alias("quote"))
    metric, comparable = V.canonical_metric(F.col("name"))
    dataset, model = V.split_model(F.col("dataset"))
    return rows.select("event_id", metric.alias("metric"), comparable.alias("comparable"), dataset.alias("dataset"), model.alias("model"), V.value_in(F.col("value"), F.col("quote")).alias("value_quoted"))


@query("""with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: try_cast(x as integer)), lambda x: x between 1 and 30) as n from documents),
u as (select doc_id, list_filter(n, lambda x, i: list_position(n, x) = i) as n from s)
select doc_id, array_to_string(n || list_filter(range(1, 31), lambda x: not list_contains(n, x)), ',') as full_order, array_to_string(n, ',') as partial from u""")
def parsed_rankings(spark, d):
    """The numbers of a document, of any size, as a model's ranking of thirty entries."""
    answer = F.concat(F.lit("I rank ["), F.array_join(T.matches(F.col("text"), "[0-9]+"), ", "), F.lit("] so, not [3]"))
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return table(spark, d, "documents").select("doc_id", show(T.ranking(answer, 30)).alias("full_order"), show(T.ranking(answer, 30, complete=False)).alias("partial"))


@query("""with n as (select doc_id, list_transform(regexp_extract_all(text, '[1-9][0-9]{0,8}'), lambda x: cast(x as bigint)) as n from documents)
select doc_id, cast(len(m) as bigint) as n_ids, coalesce(list_sum(m), 0)::bigint as total from (select doc_id, case when doc_id % 3 = 2 then list_slice(n, 1, 1) else n end as m from n)""")
def heterogeneous_lists(spark, d):
    """The numbers of a document as a JSON list, as a bare list, or the first of them alone."""
    n = T.matches(F.col("text"), "[1-9][0-9]{0,8}")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), F.array_join(n, ", "), F.lit("]"))).when(F.col("doc_id") % 3 == 1, F.array_join(n, ", ")).otherwise(F.coalesce(F.try_element_at(n, F.lit(1)), F.lit("")))
    ids = F.coalesce(T.as_list(raw), F.array().cast("array<bigint>"))
    return table(spark, d, "documents").select("doc_id", F.size(ids).cast("long").alias("n_ids"), F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""with n as (select doc_id, substr(cast(10000 + n_chars % 10000 as varchar), 2) as y, cast(doc_id * 7919 % 1000000 as varchar) as no, lower(substr(source, 1, 3)) as area from documents)
select doc_id, case when doc_id % 6 = 5 then case when length(no) = 6 then area || '/0' || no end when doc_id % 6 <> 4 and length(no) between 4 and 5 then y || '.' || no end as arxiv,
  case when doc_id % 6 = 5 then case when length(no) = 6 then area || '_0' || no || '.pdf' end when doc_id % 6 <> 4 and length(no) between 4 and 5 then y || '.' || no || '.pdf' end as file from n""")
def arxiv_identifiers(spark, d):
    """Numbers of one to six digits behind years, as addresses, with versions and file endings, and of the older kind: only those of the right length are identifiers."""
    no, y, k = (F.col("doc_id") * 7919 % 1_000_000).cast("string"), F.substring((10_000 + F.col("n_chars") % 10_000).cast("string"), 2, 4), F.col("doc_id") % 6
    bare = F.concat(y, F.lit("."), no)
    raw = (
        F.when(k == 0, F.concat(F.lit("https://arxiv.org/abs/"), bare, F.lit("v2"))).when(k == 1, F.concat(F.lit(" arXiv:"), bare)).when(k == 2, F.concat(F.lit("http://arxiv.org/pdf/"), bare, F.lit("v11.pdf")))
        .when(k == 3, bare).when(k == 4, F.concat(F.lit("x"), bare)).otherwise(F.concat(F.lower(F.substring("source", 1, 3)), F.lit("/0"), no))
    )
    return table(spark, d, "documents").select("doc_id", T.arxiv_id(raw).alias("arxiv"), I.pdf_name(T.arxiv_id(raw)).alias("file"))


@query("""with f as (select doc_id, regexp_matches(text, '[0-9]{4}') as long_number, contains(text, '|') as table_like, regexp_matches(text, '[A-Z]{4,}') as shouting, n_chars > 3000 as failed from documents),
u as (select failed, unnest(['long_number', 'table_like', 'shouting']) as signal, unnest([long_number, table_like, shouting]) as flag from f)
select signal, round(avg(cast(flag as integer)) filter (failed), 6) as rate_failed, round(avg(cast(flag as integer)) filter (not failed), 6) as rate_rest from u group by 1""")
def failure_signals(spark, d):
    flags = {"long_number": F.col("text").rlike("[0-9]{4}"), "table_like": F.col("text").contains("|"), "shouting": F.col("text").rlike("[A-Z]{4,}")}
    rows = table(spark, d, "documents").select((F.col("n_chars") > 3000).alias("failed"), F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), v.alias("flag")) for k, v in flags.items()))).alias("_s")).select("failed", "_s.*")
    rate = lambda c: F.round(F.avg(F.when(c, F.col("flag").cast("int"))), 6)
    return rows.groupBy("signal").agg(rate(F.col("failed")).alias("rate_failed"), rate(~F.col("failed")).alias("rate_rest"))


_LINES = """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
g as (select doc_id, i, i // 20 as page, line, cast(50 + case when length(line) % 7 = 0 then 10 else 0 end as double) as x0, cast((i % 20) * 14 + case when i % 5 = 0 then 6 else 0 end as double) as y0 from l)""".replace("i // 20", "(i - i % 20) / 20")


def lines(spark, d):
    """Lines of documents laid out on pages of twenty, some indented, some set apart."""
    i = F.col("i")
    x0 = (50 + F.when(F.length("line") % 7 == 0, 10).otherwise(0)).cast("double")
    y0 = ((i % 20) * 14 + F.when(i % 5 == 0, 6).otherwise(0)).cast("double")
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", i, F.floor(i / 20).cast("int").alias("page"), "line", x0.alias("x0"), y0.alias("y0"), (y0 + 10).alias("y1"), (x0 + F.length("line") * 5.0).alias("x1"))


@query(_LINES + """, e as (select *, y0 + 10 as y1, coalesce(cast(x0 - lag(x0) over (partition by doc_id, page order by x0, y0) > 12 as integer), 0) as nc from g),
c as (select *, sum(nc) over (partition by doc_id, page order by x0, y0 rows unbounded preceding) as col from e),
p as (select *, y0 - lag(y1) over w as gap, min(x0) over (partition by doc_id, page, col) as lft, lag(x0) over w as prv from c window w as (partition by doc_id, page, col order by y0, x0)),
n as (select *, list_sort(list(gap) filter (gap between 0.3 and 12) over (partition by doc_id, page, col)) as gs from p),
s as (select *, coalesce(gap > greatest(coalesce(gs[len(gs) // 2 + 1], 2.0) * 2.5, 4.0) or (x0 - lft >= 8 and prv < x0 - 8), false) as st from n)
select doc_id, cast(i as integer) as i, cast(col as bigint) as "column", cast(sum(cast(st as integer)) over (partition by doc_id, page, col order by y0, x0 rows unbounded preceding) as bigint) as paragraph from s""".replace("len(gs) // 2", "cast(floor(len(gs) / 2) as bigint)"))
def paragraph_islands(spark, d):
    return D.islands(lines(spark, d)).select("doc_id", "i", "column", "paragraph")


@query("with recursive " + """l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
w as (select doc_id, i, 1 as part, length(line) + 1 as n from l where i = 1
  union all select l.doc_id, l.i, case when w.n + length(l.line) + 1 > 600 then w.part + 1 else w.part end, case when w.n + length(l.line) + 1 > 600 then length(l.line) + 1 else w.n + length(l.line) + 1 end from w join l on l.doc_id = w.doc_id and l.i = w.i + 1)
select doc_id, cast(part as integer) as part, count(*) as n_lines, max(n) as n_chars from w group by 1, 2""")
def packed_chunks(spark, d):
    got = table(spark, d, "documents").select("doc_id", F.posexplode(D.packed(F.split("text", "\n"), 600)).alias("_i", "p"))
    return got.select("doc_id", (F.col("_i") + 1).alias("part"), F.size("p").cast("long").alias("n_lines"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.length(x) + 1).alias("n_chars"))


@query("""select doc_id, cast(i as bigint) as start, length(substr(text, i, 500)) as n_chars, md5(substr(text, i, 500)) as digest from documents, unnest(range(1, greatest(length(text), 1) + 1, 400)) t(i) where length(substr(text, i, 500)) >= 40""")
def overlapping_windows(spark, d):
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(D.windows(F.col("text"), 500, 400)).alias("_i", "p"))
    return pieces.select("doc_id", (F.col("_i") * 400 + 1).cast("long").alias("start"), F.length("p").cast("long").alias("n_chars"), F.md5(F.col("p").cast("binary")).alias("digest"))


_TITLED = "([^ \\t\\n\\x0B\\f\\r].{2,119})$'"


def _numbering_sql(line: str, name: str) -> str:
    """kind, number's bonus and title of a line, under names that begin with ``name``."""
    space = "[ \\t\\n\\x0B\\f\\r]"
    no, letter = f"regexp_extract({line}, '^(\\d+(?:\\.\\d+)*)\\.?:?{space}+{_TITLED}, 1)", f"regexp_extract({line}, '^([A-Z])(?:\\.|:)?{space}+{_TITLED}, 1)"
    rest = f"regexp_extract({line}, '^(?:\\d+(?:\\.\\d+)*|[A-Z])(?:\\.|:)?:?{space}+{_TITLED}, 1)"
    fine = f"len(list_filter(string_split({no}, '.'), lambda p: coalesce(try_cast(p as integer), 0) not between 1 and 20)) = 0"
    return (
        f"case when {no} <> '' and regexp_matches({rest}, '^\\p{{Lu}}') and {fine} then 'L' || len(string_split({no}, '.')) when {no} = '' and {letter} <> '' and regexp_matches({rest}, '^\\p{{Lu}}') then 'APPENDIX' end as {name}_kind, "
        f"{rest} as {name}_rest, regexp_replace({line}, '^[^ \\t\\n\\x0B\\f\\r]+{space}+', '') as {name}_bare"
    )


_HEADINGS = (
    _LINES + ", a as (select *, y0 + 10 as y1, x0 + length(line) * 5.0 as x1, 'b' || lpad(cast(i as varchar), 6, '0') as block_id, trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as clean, trim(line, ' ') as first from g), "
    "w as (select doc_id, max(x1) - min(x0) as page_w from a group by 1), "
    f"k as (select a.*, w.page_w, {_numbering_sql('clean', 'm')}, {_numbering_sql('first', 's')} from a join w using (doc_id)), "
    "n as (select *, m_kind is null and s_kind is not null as alone, coalesce(m_kind, s_kind) as kind from k), "
    "t as (select *, case when alone then s_rest when m_kind is not null then m_rest else m_bare end as title, case when kind = 'APPENDIX' then 3 when kind = 'L1' then 2 when kind is not null then 3 else 0 end as bonus, clean in ("
    + ", ".join(f"'{x}'" for x in D.SPECIAL) + ") as special, coalesce(bool_or(clean in (" + ", ".join(f"'{x}'" for x in D.REFERENCES)
    + ")) over (partition by doc_id order by page, y0, x0, block_id rows between unbounded preceding and 1 preceding), false) as after, y0 - lag(y1) over p as above, lead(y0) over p - y1 as below from n window p as (partition by doc_id, page order by y0, x0, block_id)), "
    "f as (select *, 0 as f_font, case when special then greatest(case when after and kind is distinct from 'APPENDIX' then -8 else bonus end, 3) when kind is null then -3 when after and kind <> 'APPENDIX' then -8 else bonus end as f_number, "
    "case when length(clean) <= 120 and (page_w < 1 or (x1 - x0) / page_w < 0.7) then 2 else 0 end as f_short, case when above > 20 then 2 else 0 end + case when below > 20 then 2 else 0 end as f_white, "
    "case when ends_with(clean, '.') then 0 when regexp_matches(clean, '[:：]$') then -2 else 2 end as f_end, case when " + " or ".join(f"starts_with(clean, '{x}')" for x in D.EXCLUDED) + " then -8 else 0 end as f_prefix from t), "
    "s as (select *, case when clean = '' then -99 else f_font + f_number + f_short + f_white + f_end + f_prefix end as total from f), "
    "r as (select *, not (after and kind is distinct from 'APPENDIX' or kind is not distinct from 'APPENDIX' and (not after or len(regexp_extract_all(title, ',')) >= 2) or kind is not distinct from 'L1' and not (regexp_matches(title, '\\p{L}') and upper(title) = title) and total < "
    + str(D.L1_FLOOR) + ") and (kind is not null or total >= " + str(D.THRESHOLD) + ") as heading from s), "
    "h as (select doc_id, trim(title, ' ') as title from r where heading and trim(title, ' ') <> '' group by 1, 2 having count(distinct page) >= 3) "
    "select r.doc_id, block_id, f_font, f_number, f_short, f_white, f_end, f_prefix, total, heading and h.title is null as is_heading from r left join h on h.doc_id = r.doc_id and h.title = trim(r.title, ' ')"
)


@query(_HEADINGS)
def heading_features(spark, d):
    blocks = lines(spark, d).select("doc_id", F.concat(F.lit("b"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("block_id"), "page", "x0", "y0", "x1", "y1", F.col("line").alias("text"))
    scored = D.without_running_heads(D.scored_blocks(blocks))
    return scored.select("doc_id", "block_id", "f_font", "f_number", "f_short", "f_white", "f_end", "f_prefix", "total", "is_heading")


@query()
def heading_chunks(spark, d):
    n = F.length("line")
    blocks = lines(spark, d).select("doc_id", F.col("i").alias("pos"), "page", F.col("line").alias("text"), (n < 30).alias("is_heading"), (1 + n % 3).cast("double").alias("level"))
    return D.titled_chunks(blocks, 1_000).select("doc_id", "chunk_id", "pos", F.array_join("title_path", " · ").alias("path"), "part", "parts", "first_page", "last_page", F.length("text").alias("n_chars"))


@query("""with r as (select conv_id, turn, role, case when turn % 3 = 0 then role || '\\|a' else role end as said, case when turn % 3 = 1 then role else cast(length(text) as varchar) end as size, turn % 2 = 0 as noted from conversations),
n as (select conv_id, bool_or(noted) as noted from r group by 1)
select r.conv_id, '| turn | said/role | said/size |' || case when n.noted then ' note |' else '' end || chr(10) || '|---|---|---|' || case when n.noted then '---|' else '' end || chr(10)
  || string_agg('| ' || turn || ' | ' || said || ' | ' || size || ' |' || case when not n.noted then '' when r.noted then ' a & b |' else '  |' end, chr(10) order by turn, role) as markdown from r join n using (conv_id) group by r.conv_id, n.noted""")
def table_markdown(spark, d):
    """Tables with two header rows, cells over several columns and rows, marks and signs in cells, and a column that may be empty; one for each conversation."""
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<b>"), "role", F.lit("</b>|a"))).otherwise(F.col("role"))
    cells = F.when(F.col("turn") % 3 == 1, F.concat(F.lit('<td colspan="2">'), "role", F.lit("</td>"))).otherwise(F.concat(F.lit("<td> "), said, F.lit("</td><td>"), F.length("text"), F.lit("</td>")))
    row = F.concat(F.lit("<tr><td>"), "turn", F.lit("</td>"), cells, F.when(F.col("turn") % 2 == 0, "<td>a &amp; <i>b</i></td>").otherwise("<td></td>"), F.lit("</tr>"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", row.alias("r"))))
    head = F.lit("<table><thead><tr><th rowspan=2>turn</th><th colspan=2>said</th><th rowspan=2>note</th></tr><tr><th>role</th><th>size</th></tr></thead>")
    named = F.when(F.exists("c", lambda x: x["turn"] % 2 == 0), head).otherwise(F.replace(head, F.lit(">note<"), F.lit("><")))
    html = F.concat(named, F.array_join(F.col("c.r"), ""), F.lit("</table>"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("c")).select("conv_id", H.markdown(html).alias("markdown"))


@query()
def number_token_rows(spark, d):
    """The numbers of all documents by the table function, in SQL text; summed as ``numeric_scan`` does by arrays."""
    TF.register(spark)
    return spark.sql("""with n as (select doc_id, raw, value, percent from {docs}, lateral number_tokens(text))
      select doc_id, count(raw) as n_numbers, count_if(percent) as n_percent, coalesce(max(value), 0.0) as largest, md5(array_join(array_sort(collect_list(raw)), ' ')) as digest from n group by doc_id""", docs=table(spark, d, "documents"))


@query("""with r as (select event_id, cast(user_id as varchar) as u, cast(cast(round(value, 2) as decimal(18, 2)) as varchar) as v from events)
select event_id, unnest([1, 2, 3]) as pos, unnest([u, v, '7k']) as raw, round(unnest([cast(u as double), cast(v as double), 7000.0e0]), 4) as value, unnest([false, true, false]) as percent from r""")
def number_lateral(spark, d):
    """A sentence with three numbers for each event, taken apart by a lateral join: a count, a share and thousands."""
    said = F.concat(F.lit("for "), F.col("user_id").cast("string"), F.lit(" users it is "), F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit("% with 7k more"))
    rows = TF.with_numbers(table(spark, d, "events").select("event_id", said.alias("said")), "said")
    return rows.select("event_id", "pos", "raw", F.round("value", 4).alias("value"), "percent")


@query("""with r as (select conv_id, turn, role, coalesce(length(text), 0) as n, row_number() over (partition by conv_id order by turn, role, coalesce(length(text), 0)) as i from conversations)
select conv_id, cast(i as integer) as row, unnest([0, 1, 2, 3]) as col, false as header, unnest([cast(turn as varchar), role, role, cast(n as varchar)]) as text from r
union all select conv_id, 0, unnest([0, 1, 2, 3]), true, unnest(['turn', 'said', 'said', 'size']) from (select distinct conv_id from conversations)""")
def table_cell_rows(spark, d):
    """Cells of one table a conversation by the table function, in SQL text; a cell over two columns stands in both."""
    TF.register(spark)
    n = F.coalesce(F.length("text"), F.lit(0))
    row = F.concat(F.lit("<tr><td>"), "turn", F.lit("</td><td colspan=2>"), "role", F.lit("</td><td>"), n, F.lit("</td></tr>"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", n.alias("n"), row.alias("r"))))
    html = F.concat(F.lit("<table><tr><th>turn</th><th colspan=2>said</th><th>size</th></tr>"), F.array_join(F.col("c.r"), ""), F.lit("</table>"))
    made = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("c")).select("conv_id", html.alias("html"))
    return spark.sql("select conv_id, row, col, header, text from {made}, lateral table_cells(html)", made=made)


@query("""with t as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as t from documents)
select doc_id, cast(len(t) as bigint) as n, md5(array_to_string(list_transform(t, lambda w, i: case i % 5 when 1 then upper(w) when 2 then 'alpha ' || w when 3 then w when 4 then w || ' 2' else case when length(w) >= 5 then upper(w[1]) || substr(w, 2) else array_to_string(list_transform(range(1, length(w) + 1), lambda k: substr(w, k, 1)), ' ') end end), ' ')) as words from t""")
def latex_words(spark, d):
    """A document's words as a formula: set apart in capitals, under commands, as scripts, in environments, and set apart in small letters."""
    apart = lambda w: F.array_join(F.split(w, ""), " ")
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    shown = lambda w, i: (
        F.when(i % 5 == 0, F.concat(F.lit(r"\mathrm { "), apart(F.upper(w)), F.lit(" } "))).when(i % 5 == 1, F.concat(F.lit(r"\alpha _ { "), w, F.lit(" } "))).when(i % 5 == 2, F.concat(F.lit("$"), w, F.lit("$")))
        .when(i % 5 == 3, F.concat(F.lit(r"\begin{array} {l}"), w, F.lit(r"\left ^ {2} \end {array}"))).otherwise(F.concat(F.lit(r"\operatorname { "), apart(F.when(F.length(w) >= 5, title(w)).otherwise(w)), F.lit(r" } \quad "))))
    words = T.matches(F.lower("text"), "[a-z]+")
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.md5(H.latex_words(F.array_join(F.transform(words, shown), " ")).cast("binary")).alias("words"))


@query("""with c as (select conv_id, 100 * turn + case role when 'user' then 0 else 1 end as pos, length(text) as n, 1 + turn % 3 as paper from conversations), s as (select conv_id, sum(n + 48) + 120 * count(distinct paper) as n_chars from c group by 1)
select conv_id, cast(n_chars as bigint) as n_chars, n_chars > 3000 as refused from s""")
def context_budget(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (100 * F.col("turn") + F.when(F.col("role") == "user", 0).otherwise(1)).alias("pos"), "text", (1 + F.col("turn") % 3).alias("paper"), F.col("role").alias("section"), F.col("turn").alias("chunk"))
    return D.context(c, 3_000, "conv_id").select("conv_id", "n_chars", "refused")


_GROUPS = "with g as (select source, doc_id as id, doc_id as pos, 1 + doc_id % 5 as importance, n_chars as total, lang as section from documents)"


def _groups(spark, d):
    return table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), (1 + F.col("doc_id") % 5).alias("importance"), F.col("n_chars").alias("total"), F.col("lang").alias("section"))


@query(_GROUPS + " select source, id, cast(rn as integer) as rank from (select *, row_number() over (partition by source order by total desc, pos) as rn from g where importance >= 5) where rn <= 8")
def core_points(spark, d):
    return B.core_points(_groups(spark, d), "source").select("source", "id", "rank")


@query(_GROUPS + """, f as (select source, section, row_number() over (partition by source order by min(pos)) as place from g group by 1, 2)
select g.source, g.section, cast(f.place as integer) as place, id, importance >= 4 as shown, importance, total, pos from g join f using (source, section)""")
def section_views(spark, d):
    return B.section_views(_groups(spark, d), "source").select("source", "section", "place", "id", "shown", "importance", "total", "pos")


@query(_GROUPS + " select source, count(*) as groups, count(distinct section) as sections, count(*) filter (importance >= 5) as must, sum(cast(importance = 3 as integer))::bigint as limitations from g group by 1")
def report_counters(spark, d):
    return _groups(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("groups"), F.countDistinct("section").alias("sections"), F.count_if(F.col("importance") >= 5).alias("must"), F.count_if(F.col("importance") == 3).alias("limitations"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1)")
def rejected_set(spark, d):
    labels = table(spark, d, "labels")
    return B.remaining(table(spark, d, "documents").select("doc_id"), labels.where("quality = 1"), labels.where("toxic = 1"), "doc_id")


@query("select user_id, count(distinct event_type) as rounds from events where value > 50 group by 1 having count(distinct event_type) = 5")
def consensus_flags(spark, d):
    return B.flagged_in_every_round(table(spark, d, "events").where("value > 50"), "user_id", "event_type", 5)


@query(PATHS + """, o as (select qid, route, count(distinct owner) as o from paths group by 1, 2), r as (select p.*, row_number() over (partition by p.qid, p.route, owner order by rank) > greatest(1, ceil(30.0 / o)) as late from paths p join o using (qid, route))
select qid, route, key, late as backfilled, rank as rank_before, cast(n as integer) as rank from (select *, row_number() over (partition by qid, route order by late, rank) as n from r) where n <= 30""")
def owner_cap_with_backfill(spark, d):
    return B.capped_with_backfill(paths(spark, d), 1, 30, ("qid", "route")).select("qid", "route", "key", "backfilled", "rank_before", "rank")


@query("""with r as (select conv_id, list_sort(list_distinct([conv_id, conv_id * 3, conv_id * 11 + 5, conv_id + 900, conv_id * 2, conv_id * 5, conv_id * 7])) as refs from (select distinct conv_id from conversations)), u as (select conv_id, unnest(refs) as ref from r)
select conv_id, array_to_string(list_slice(list(ref order by ref) filter (doc_id is not null), 1, 5), ',') as kept, count(*) filter (doc_id is null) as dropped from u left join (select doc_id from labels) l on l.doc_id = u.ref group by 1""")
def referential_cleanup(spark, d):
    c = F.col("conv_id")
    rows = table(spark, d, "conversations").select("conv_id").distinct().withColumn("refs", F.array_sort(F.array_distinct(F.array(c, c * 3, c * 11 + 5, c + 900, c * 2, c * 5, c * 7))))
    got = B.referential_cleanup(rows, "refs", table(spark, d, "labels").select("doc_id"), "conv_id")
    return got.select("conv_id", F.nullif(F.array_join(F.transform("kept", lambda x: x.cast("string")), ","), F.lit("")).alias("kept"), "dropped")


@query("""with v as (select id, regexp_replace(id, '\\.[A-Za-z0-9]{1,5}$', '') as stem from (select distinct lang || '/' || source || '/doc ' || doc_id || '.pdf' as id from documents)),
c as (select c.conv_id, c.conv_id % 400 as i, d.lang, d.source from (select distinct conv_id from conversations) c left join documents d on d.doc_id = c.conv_id % 400),
r as (select conv_id, unnest(range(5)) as nth, unnest([lang || '/' || source || '/doc ' || i || '.pdf', 'doc ' || (i + 1), 'x/' || lang || '/' || source || '\\doc ' || i, ' /data/' || 'doc ' || (i + 2) || '.PDF', source || '/doc ' || i || '.pdf']) as ref from c),
s as (select conv_id, nth, ref, regexp_replace(ltrim(replace(trim(ref), '\\', '/'), '/'), '\\.[A-Za-z0-9]{1,5}$', '') as stem from r),
m as (select s.*, v.id, case when ref = id then 3 when v.stem = s.stem or ends_with(v.stem, '/' || s.stem) then 2 when ends_with(s.stem, '/' || v.stem) then 1 end as how, length(v.stem) as n from s join v on v.stem = s.stem or ends_with(v.stem, '/' || s.stem) or ends_with(s.stem, '/' || v.stem)),
b as (select conv_id, nth, arg_max(id, (how, case when how = 1 then n else 0 end, case when v2 then 1 else 0 end)) as id from (select *, stem = regexp_replace(id, '\\.[A-Za-z0-9]{1,5}$', '') as v2 from m) group by 1, 2),
f as (select conv_id, id, min(nth) as nth from b group by 1, 2), k as (select conv_id, array_to_string(list_slice(list(id order by nth), 1, 5), ',') as kept from f group by 1)
select s.conv_id, k.kept, count(*) filter (s.ref is not null and b.id is null) as dropped from s left join b on b.conv_id = s.conv_id and b.nth = s.nth left join k on k.conv_id = s.conv_id group by 1, 2""")
def tolerant_references(spark, d):
    """References to documents by path: whole, by file name, with more folders and the other slash, with a folder that is not theirs, and by the end of the path."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    i = F.col("i")
    asked = table(spark, d, "conversations").select("conv_id").distinct().withColumn("i", F.col("conv_id") % 400).join(docs, F.col("doc_id") == i, "left")
    name = F.concat(F.lit("doc "), i)
    refs = F.array(
        F.concat("lang", F.lit("/"), "source", F.lit("/"), name, F.lit(".pdf")), F.concat(F.lit("doc "), i + 1), F.concat(F.lit("x/"), "lang", F.lit("/"), "source", F.lit("\\"), name),
        F.concat(F.lit(" /data/doc "), i + 2, F.lit(".PDF")), F.concat("source", F.lit("/"), name, F.lit(".pdf")),
    )
    valid = docs.select(F.concat("lang", F.lit("/"), "source", F.lit("/doc "), "doc_id", F.lit(".pdf")).alias("id"))
    got = B.tolerant_cleanup(asked.select("conv_id", refs.alias("refs")), "refs", valid, "conv_id")
    return got.select("conv_id", F.nullif(F.array_join("kept", ","), F.lit("")).alias("kept"), "dropped")


@query("""with j as (select doc_id, case when quality = 1 then 'yes' else 'no' end as a, case when doc_id % 4 = 0 then 'no' else 'yes' end as b, case doc_id % 3 when 0 then 'yes' when 1 then 'no' end as t from labels)
select doc_id, case when a = b then a else coalesce(t, 'unclear') end as verdict from j""")
def dual_judgement(spark, d):
    i = F.col("doc_id")
    third = F.when(i % 3 == 0, "yes").when(i % 3 == 1, "no")
    return table(spark, d, "labels").select("doc_id", B.dual_judgement(F.when(F.col("quality") == 1, "yes").otherwise("no"), F.when(i % 4 == 0, "no").otherwise("yes"), third).alias("verdict"))


@query(PATHS + """, v as (select p.*, case when l.quality = 1 then 'yes' when l.quality = 0 then 'no' else 'unclear' end as verdict from paths p left join labels l on l.doc_id = p.key),
s as (select qid, route, owner, max(score) as best, count(*) as n from v where verdict = 'yes' group by 1, 2, 3)
select qid, route, owner, best, n, cast(row_number() over (partition by qid, route order by best desc, owner) as integer) as rank from s""")
def set_judgement(spark, d):
    verdicts = table(spark, d, "labels").select(F.col("doc_id").alias("key"), "quality")
    yes = paths(spark, d).join(verdicts.where("quality = 1"), "key")
    per = yes.groupBy("qid", "route", "owner").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    return R.ranked(per, ("qid", "route"), (F.desc("best"), F.asc("owner")))


@query("""with q as (select conv_id, turn, role, [trim(text, ' '), role, trim(lower(text), ' '), role, 'x'] as q from conversations), n as (select conv_id, turn, role, list_filter(q, lambda s: s <> '') as q from q)
select conv_id, turn, role, cast(len(u) as bigint) as n, md5(array_to_string(list_slice(u, 1, 3), '|')) as plan from (select conv_id, turn, role, list_filter(q, lambda s, i: list_position(q, s) = i) as u from n)""")
def query_plan(spark, d):
    """The turn itself, its role and its small letters, and a variant: trimmed, each once, in order."""
    every = B.query_plan(F.col("text"), F.array("role", F.lower("text"), "role"), F.array(F.lit(" x ")), 99)
    first = B.query_plan(F.col("text"), F.array("role", F.lower("text"), "role"), F.array(F.lit(" x ")), 3)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.size(every).cast("long").alias("n"), F.md5(F.array_join(first, "|").cast("binary")).alias("plan"))


@query("""with q as (select doc_id as qid, 'compare ' || source || ' with ' || 'src1' as question from documents), w as (select qid, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z0-9_-]+'))) as w from q),
m as (select w.qid, s.source as paper from w join (select distinct source from documents) s on lower(s.source) = w.w),
k as (select *, exists (select 1 from m o where o.qid = m.qid and o.paper <> m.paper and contains(o.paper, m.paper)) as inside from m) select qid, paper from k where not inside""")
def focus_resolution(spark, d):
    docs = table(spark, d, "documents")
    questions = docs.select(F.col("doc_id").alias("qid"), F.concat(F.lit("compare "), "source", F.lit(" with src1")).alias("question"))
    papers = docs.select(F.col("source").alias("paper")).distinct().withColumn("name", F.col("paper"))
    return B.focused(questions, papers)


@query("""with s as (select conv_id, turn, role, text, list_distinct(regexp_extract_all(text, '[0-9]+|[A-Z]{2,}')) as sig from conversations), n as (select conv_id, turn, sig, lower(coalesce(lead(text) over (partition by conv_id order by turn, role, text), '')) as nxt, text from s)
select conv_id, turn, cast(len(sig) as bigint) as n_signals, len(list_filter(sig, lambda x: not contains(nxt, lower(x)))) = 0 as hard_ok from n""")
def signal_hard_check(spark, d):
    sig = F.array_distinct(T.matches(F.col("text"), "[0-9]+|[A-Z]{2,}"))
    after = F.lower(F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")), F.lit("")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", sig.alias("sig"), after.alias("nxt"))
    return rows.select("conv_id", "turn", F.size("sig").cast("long").alias("n_signals"), F.forall("sig", lambda x: F.contains(F.col("nxt"), F.lower(x))).alias("hard_ok"))


@query(PATHS + """, t as (select p.qid, p.key, p.rank, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) as w, list_distinct(regexp_extract_all(d.text, '[0-9]+')) as x from paths p join documents d on d.doc_id = p.key where p.route = 'hash'), n as (select *, coalesce(lag(w) over (partition by qid order by rank), []) as v, coalesce(lag(x) over (partition by qid order by rank), []) as y from t)
select qid, key, round(len(list_intersect(x, y)) / cast(greatest(len(y), 1) as double), 6) as number_overlap, round(len(list_intersect(w, v)) / cast(greatest(len(v), 1) as double), 6) as overlap from n""")
def failure_attribution(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.array_distinct(T.latin_tokens(F.col("text"))).alias("w"), F.array_distinct(T.matches(F.col("text"), "[0-9]+")).alias("x"))
    before = lambda c: F.coalesce(F.lag(c).over(Window.partitionBy("qid").orderBy("rank")), F.array().cast("array<string>"))
    rows = one(spark, d, "hash").join(texts, "key").withColumns({"v": before("w"), "y": before("x")})
    numbers = F.round(F.size(F.array_intersect("x", "y")) / F.greatest(F.size("y"), F.lit(1)), 6)
    return rows.select("qid", "key", numbers.alias("number_overlap"), F.round(F.size(F.array_intersect("w", "v")) / F.greatest(F.size("v"), F.lit(1)), 6).alias("overlap"))
