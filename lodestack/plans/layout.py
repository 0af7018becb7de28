"""Queries of layout elements, captions, tables, headings and views of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as H
from ..functions import text as T
from ..operators import layout as L
from ..operators import structure as D
from .documents import lines
from .registry import query, table

_MD5 = lambda c: F.md5(c.cast("binary"))
_CAPTION_SQL = "'^(?i:(table|tab\\.?|figure|fig\\.?))\\s+((?i:[a-z]{1,2}\\.\\d+|[a-z]?\\d+(?:\\.\\d+)*[a-z]?))\\s*(?:$|[:.]|[\\p{Lu}\\d])'"


@query(f"""with b as (select doc_id, case doc_id % 8 when 0 then 'Table ' || doc_id || ': ' || text when 1 then '  FIG. A.' || doc_id || ' ' || text when 2 then 'Tab 3.' || doc_id || 'b' when 3 then 'Table ' || doc_id || ' lists ' || text when 4 then 'See Table 1: ' || text
  when 5 then 'figure ' || doc_id || '. ' || text when 6 then 'Figure ' || doc_id || ' ' || upper(text) else text end as text from documents),
c as (select doc_id, lower(regexp_extract(trim(text, ' '), {_CAPTION_SQL}, 1)) as word, regexp_extract(trim(text, ' '), {_CAPTION_SQL}, 2) as number from b)
select doc_id, case when starts_with(word, 'tab') then 'Table' when word <> '' then 'Figure' end as kind, nullif(number, '') as number from c""")
def caption_kinds(spark, d):
    """Texts that begin like captions of several kinds, some of which are running text."""
    i, t = F.col("doc_id").cast("string"), F.col("text")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    k = F.col("doc_id") % 8
    begun = (
        F.when(k == 0, join("Table ", i, ": ", t)).when(k == 1, join("  FIG. A.", i, " ", t)).when(k == 2, join("Tab 3.", i, "b")).when(k == 3, join("Table ", i, " lists ", t)).when(k == 4, join("See Table 1: ", t))
        .when(k == 5, join("figure ", i, ". ", t)).when(k == 6, join("Figure ", i, " ", F.upper(t))).otherwise(t)
    )
    kind, number = L.caption_parts(begun)
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), number.alias("number"))


_ELEMENTS = """with c as (select distinct conv_id as doc_id, turn * 10 + length(role) as pos, turn, role from conversations),
e as (select doc_id, pos, case turn % 4 when 3 then 'text' when 2 then 'equation' else 'table' end as type, cast(turn as integer) as page_idx, case when turn % 3 = 0 then ['odds and ends', 'from Table ' || (turn + 1) || ' of ' || role] when turn % 3 = 1 then ['nothing numbered'] else null end as caption,
  case when turn % 5 = 4 then ' ' else '| ' || role || ' | size |' || chr(10) || '|---|---|' || chr(10) || '| ' || turn || ' | a\\|b |' end as text from c)"""


def _elements(spark, d):
    t, role = F.col("turn"), F.col("role")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (t * 10 + F.length("role")).alias("pos"), "turn", "role").distinct()
    kind = F.when(t % 4 == 3, "text").when(t % 4 == 2, "equation").otherwise("table")
    caption = F.when(t % 3 == 0, F.array(F.lit("odds and ends"), F.concat(F.lit("from Table "), t + 1, F.lit(" of "), role))).when(t % 3 == 1, F.array(F.lit("nothing numbered")))
    text = F.when(t % 5 == 4, " ").otherwise(F.concat(F.lit("| "), role, F.lit(" | size |\n|---|---|\n| "), t, F.lit(" | a\\|b |")))
    return c.select("doc_id", "pos", kind.alias("type"), t.cast("int").alias("page_idx"), caption.alias("caption"), text.alias("text"))


@query(_ELEMENTS + """, k as (select *, trim(split_part(split_part(text, chr(10), 1), '|', 2), ' ') as role, case when type = 'table' and len(caption) = 2 then 'Table' || split_part(caption[2], 'Table', 2) else '' end as own from e where type in ('table', 'equation') and trim(text, ' ') <> ''),
f as (select doc_id, role, arg_min(own, pos) as lent from k where type = 'table' and own <> '' group by 1, 2)
select k.doc_id, 'xtbl-' || pos as chunk_id, page_idx + 1 as page, case when type = 'equation' or own <> '' then '' when f.lent is not null then f.lent || chr(10) else 'Table (columns: ' || k.role || ', size)' || chr(10) end || text as text from k left join f on f.doc_id = k.doc_id and f.role = k.role""")
def external_table_chunks(spark, d):
    return L.external_chunks(_elements(spark, d)).select("doc_id", "chunk_id", "page", "text")


@query("""with c as (select conv_id, turn, role, case when turn % 4 = 3 then 'p-' else 'xtbl-' end || turn || role as chunk_id, 'Table ' || (turn + 1) || ' and tab. iv: ' || text as text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations),
q as (select conv_id, turn || role as qid, 'as table ' || (turn % 3 + 1) || ' says' as evidence, [cast(turn % 3 + 1 as varchar)] as keys, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 9)) as vals from conversations),
m as (select distinct q.conv_id, q.qid, c.chunk_id, list_has_any(['IV', cast(c.turn + 1 as varchar)], q.keys) or list_has_any(list_transform(regexp_extract_all(c.text, '(?i)\\b(?:table|tab\\.?)\\s*(?:~|#)?\\s*(\\d+|[IVX]+\\b)', 1), lambda x: upper(x)), q.keys) as by_number,
  len(q.vals) > 0 and list_has_all(list_distinct(regexp_extract_all(lower(c.text), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]')), q.vals) as by_content from q join c on c.conv_id = q.conv_id and starts_with(c.chunk_id, 'xtbl-'))
select conv_id, qid, chunk_id, bool_or(by_number) as by_number, bool_or(by_content) as by_content from m where by_number or by_content group by 1, 2, 3""")
def table_targets(spark, d):
    """Which table chunks of a conversation a turn's evidence points at, by the table's number or by all of its long words."""
    t = F.col("turn")
    c = table(spark, d, "conversations")
    chunks = c.select("conv_id", F.concat(F.when(t % 4 == 3, "p-").otherwise("xtbl-"), t.cast("string"), "role").alias("chunk_id"), F.concat(F.lit("Table "), t + 1, F.lit(" and tab. iv: "), "text").alias("text"))
    questions = c.select("conv_id", F.concat(t.cast("string"), "role").alias("qid"), F.concat(F.lit("as table "), t % 3 + 1, F.lit(" says")).alias("evidence"), F.filter(T.latin_tokens(F.col("text")), lambda w: F.length(w) >= 9).alias("values"))
    return L.table_targets(questions, chunks, "conv_id")


_COMMON_SQL = "len(regexp_extract_all(lower({0}), '\\b(?:" + "|".join(L.COMMON) + ")\\b'))"


@query(f"""with v as (select doc_id, text, case when doc_id % 2 = 0 then replace(text, 'the', 't he') else replace(text, ' and ', ' an d ') end as view from documents)
select doc_id, cast({_COMMON_SQL.format('view')} as integer) as kept, round(cast({_COMMON_SQL.format('view')} as double) / nullif({_COMMON_SQL.format('text')}, 0), 6) as retention from v""")
def view_health(spark, d):
    """How many common words a view keeps in which some words are broken."""
    view = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("the"), F.lit("t he"))).otherwise(F.replace("text", F.lit(" and "), F.lit(" an d ")))
    return table(spark, d, "documents").select("doc_id", L.common_words(view).alias("kept"), L.retention(view, F.col("text")).alias("retention"))


_BARE_SQL = "regexp_replace(trim(h, ' '), '^(?:[A-Za-z]?\\d+(?:\\.\\d+)*[a-z]?|[IVX]+|[A-Za-z])(?:[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]*[.-][ \\t\\n\\x0B\\f\\r]*|$)', '')"


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
n as (select doc_id, i, case i % 5 when 0 then (i + 1) || '.' || (i % 7) || ' ' || line when 1 then 'IV. ' || line when 2 then 'B ' || left(line, 40) when 3 then left(line, 30) || ' = x' else line end as h from l),
b as (select doc_id, i, {_BARE_SQL} as bare from n)
select doc_id, count(*) as n_lines, count(*) filter (length(bare) > 70 or regexp_matches(bare, '[=<>≤≥∑∏∫√∈∀∃±×÷→∞^_{{}}\\\\]')) as suspicious, sum(length(bare))::bigint as n_chars from b group by 1""")
def suspicious_headings(spark, d):
    """Lines with numbers of several kinds in front as headings: what is left of them, and how many are hardly headings."""
    i, line = F.col("i"), F.col("line")
    h = F.when(i % 5 == 0, F.concat((i + 1).cast("string"), F.lit("."), (i % 7).cast("string"), F.lit(" "), line)).when(i % 5 == 1, F.concat(F.lit("IV. "), line)).when(i % 5 == 2, F.concat(F.lit("B "), F.left(line, F.lit(40)))).when(i % 5 == 3, F.concat(F.left(line, F.lit(30)), F.lit(" = x"))).otherwise(line)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", h.alias("h"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(L.suspicious_heading(F.col("h"))).alias("suspicious"), F.sum(F.length(L.without_number(F.col("h")))).alias("n_chars"))


@query("""with o as (select doc_id, case doc_id % 6 when 0 then '   ' when 1 then 'I am sorry, but ' || text when 2 then left(text, 30) when 3 then null when 4 then 'No material was given. ' || text else text end as text from documents)
select doc_id, case when trim(coalesce(text, ''), ' ') = '' then 'empty' when regexp_matches(lower(left(trim(text, ' '), 80)), '(?:i am|i''m|we are) (?:unable|sorry)|i cannot|can ?not (?:be )?(?:write|written|provide)|no (?:material|content|information) (?:is|was|has been) (?:given|provided|available)|抱歉|无法|没有.{0,6}材料|不足以') then 'refusal' when length(trim(text, ' ')) < 40 then 'short' end as reason from o""")
def degraded_overviews(spark, d):
    k, t = F.col("doc_id") % 6, F.col("text")
    text = F.when(k == 0, "   ").when(k == 1, F.concat(F.lit("I am sorry, but "), t)).when(k == 2, F.left(t, F.lit(30))).when(k == 3, None).when(k == 4, F.concat(F.lit("No material was given. "), t)).otherwise(t)
    return table(spark, d, "documents").select("doc_id", L.degraded(text).alias("reason"))


@query("select lang, doc_id, cast(rn as integer) as rank from (select lang, doc_id, row_number() over (partition by lang order by doc_id) as rn from documents) where rn <= 7")
def stratified_head(spark, d):
    return L.head_per_class(table(spark, d, "documents").select("lang", "doc_id"), "lang", 7, "doc_id").select("lang", "doc_id", "rank")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
p as (select doc_id, i, (i % 20) * 14 as y, case when i % 20 = 19 then ' ' || cast((i - i % 20) / 20 + 1 as bigint) || ' ' when i % 20 = 2 then 'arXiv:' || line else line end as text, case when i % 40 = 2 then 10 else 60 end as x from l)
select doc_id, count(*) as n, count(*) filter (regexp_matches(trim(text, ' '), '^\\d{1,3}$') and (y + 10 < 30 or y > 270) or starts_with(trim(text, ' '), 'arXiv:') and y < 90 and x < 30) as noise from p group by 1""")
def noise_blocks(spark, d):
    """Page numbers and archive stamps among the lines of pages 300 high."""
    i, line = F.col("i"), F.col("line")
    text = F.when(i % 20 == 19, F.concat(F.lit(" "), (F.floor(i / 20) + 1).cast("string"), F.lit(" "))).when(i % 20 == 2, F.concat(F.lit("arXiv:"), line)).otherwise(line)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    y = (i % 20 * 14).cast("double")
    noise = D.noise_block(text, y, y + 10, F.when(i % 40 == 2, 10.0).otherwise(60.0), F.lit(300.0))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(noise).alias("noise"))


@query("""with r as (select conv_id, turn, role, case when turn % 3 = 1 then [cast(turn as varchar), role, role] else [cast(turn as varchar), role, cast(length(text) as varchar)] end as cells from conversations)
select conv_id, count(*) + 2 as n_rows, 4 as n_columns, md5('turn/said/said/note|turn/role/size/note|' || string_agg(array_to_string(cells, '/') || '/' || case when turn % 2 = 0 then 'a & b' else '' end, '|' order by turn, role)) as cells from r group by 1""")
def table_grids(spark, d):
    """The same cells at every place that spanning cells cover."""
    cells = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<td colspan='2'>"), "role", F.lit("</td>"))).otherwise(F.concat(F.lit("<td>"), "role", F.lit("<td>"), F.length("text"), F.lit("</td>")))
    row = F.concat(F.lit("<tr><td>"), "turn", F.lit("</td>"), cells, F.when(F.col("turn") % 2 == 0, "<td>a &amp; <i>b</i></td>").otherwise("<td></td>"), F.lit("</tr>"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", row.alias("r"))))
    html = F.concat(F.lit("<table><tr><th rowspan=2>turn</th><th colspan=2>said</th><th rowspan=2>note</th></tr><tr><th>role</th><th>size</th></tr>"), F.array_join(F.col("c.r"), ""), F.lit("</table>"))
    got = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("c")).select("conv_id", H.grid(html).alias("g"))
    return got.select("conv_id", F.size("g").cast("long").alias("n_rows"), F.size(F.col("g")[0]).alias("n_columns"), _MD5(F.array_join(F.transform("g", lambda r: F.array_join(r, "/")), "|")).alias("cells"))


@query("""with r as (select doc_id, regexp_replace(text, '<[^>]*>', '', 'g') as plain, regexp_replace(regexp_replace(text, '(?is)<sup\\b[^>]*>.*?</sup>|<sub\\b[^>]*>.*?</sub>', '', 'g'), '<[^>]*>', '', 'g') as bare from documents)
select doc_id, md5(replace(plain, ' the ', ' the12 ')) as kept, md5(bare) as dropped from r""")
def script_tags(spark, d):
    """Raised and lowered signs put behind a word of the text."""
    raw = F.replace("text", F.lit(" the "), F.lit(" the<sup>1</sup><SUB class='x'>2</SUB> "))
    return table(spark, d, "documents").select("doc_id", _MD5(H.without_scripts(raw)).alias("kept"), _MD5(H.without_scripts(raw, keep=False)).alias("dropped"))


@query("""with e as (select conv_id, turn, role, text, case turn % 4 when 0 then 'table' when 1 then 'image' when 2 then 'equation' else 'text' end as kind, case when turn % 3 = 0 then ['Table ' || turn, role] end as caption, case when turn % 2 = 0 then '| a |' end as body, case when turn % 5 = 0 then ['note'] else [] end as foot from conversations),
p as (select *, array_to_string(coalesce(caption, []), ' ') as c, array_to_string(foot, ' ') as f from e)
select conv_id, turn, role, md5(array_to_string(list_filter(case kind when 'table' then [c, coalesce(body, ''), f] when 'image' then [c, f] else [text] end, lambda x: trim(x, ' ') <> ''), chr(10))) as text from p""")
def element_texts(spark, d):
    t = F.col("turn")
    kind = F.when(t % 4 == 0, "table").when(t % 4 == 1, "image").when(t % 4 == 2, "equation").otherwise("text")
    caption = F.when(t % 3 == 0, F.array(F.concat(F.lit("Table "), t.cast("string")), "role"))
    foot = F.when(t % 5 == 0, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", _MD5(D.element_text(kind, F.col("text"), caption, F.when(t % 2 == 0, "| a |"), foot)).alias("text"))


@query("""with c as (select doc_id, ['Figure 6: x', 'junk Table ' || (doc_id % 50) || '.2a ' || lang, case when doc_id % 3 = 0 then 'table iv of it' else 'Age Race' end, text] as caps from documents)
select doc_id, cast(len(k) as integer) as n, md5(array_to_string(k, '|')) as captions from (select doc_id, list_filter(list_transform(caps, lambda x: trim(regexp_extract(x, '(?s)((?i)Table\\s+(?:[IVXLC]+|\\d+(?:\\.\\d+)*[A-Za-z]?).*)', 1), ' ')), lambda x: x <> '') as k from c)""")
def cleaned_captions(spark, d):
    caps = F.array(F.lit("Figure 6: x"), F.concat(F.lit("junk Table "), F.col("doc_id") % 50, F.lit(".2a "), "lang"), F.when(F.col("doc_id") % 3 == 0, "table iv of it").otherwise("Age Race"), F.col("text"))
    got = H.clean_captions(caps)
    return table(spark, d, "documents").select("doc_id", F.size(got).alias("n"), _MD5(F.array_join(got, "|")).alias("captions"))


@query("""with t as (select doc_id, lang, replace(text, '|', ' ') || chr(10) || '| ' || lang || ' | size | ' || lang || ' |' || chr(10) || '|---|---|---|' || chr(10) || ' | a | b | c |' as text, replace(text, '|', ' ') as plain from documents)
select doc_id, lang || ',size' as cells, md5(plain || chr(10) || chr(10) || chr(10)) as masked from t""")
def header_cells(spark, d):
    """Distinct header cells of a pipe table behind a text, and the text with the table's rows masked."""
    text = F.concat(F.replace("text", F.lit("|"), F.lit(" ")), F.lit("\n| "), "lang", F.lit(" | size | "), "lang", F.lit(" |\n|---|---|---|\n | a | b | c |"))
    return table(spark, d, "documents").select("doc_id", F.array_join(H.header_cells(text), ",").alias("cells"), _MD5(H.masked_rows(text)).alias("masked"))


@query("""with h as (select doc_id, text, case doc_id % 3 when 0 then lower(regexp_extract(text, '[^ ]+', 0)) when 1 then 'Of ' || source else right(text, 20) end as heading from documents)
select doc_id, md5(case when contains(lower(left(text, 400)), lower(heading)) then text else heading || chr(10) || text end) as text from h""")
def heading_prefix(spark, d):
    k = F.col("doc_id") % 3
    heading = F.when(k == 0, F.lower(F.regexp_extract("text", "[^ ]+", 0))).when(k == 1, F.concat(F.lit("Of "), "source")).otherwise(F.right("text", F.lit(20)))
    return table(spark, d, "documents").select("doc_id", _MD5(D.with_heading(heading, F.col("text"))).alias("text"))


@query("""with h as (select doc_id, replace(text, ' the ', ' th-' || chr(10) || ' e ') as t from documents)
select doc_id, md5(t) as as_is, md5(regexp_replace(t, '-[ \\t\\n\\x0B\\f\\r]*\\n[ \\t\\n\\x0B\\f\\r]*', '', 'g')) as joined, md5(regexp_replace(t, '-[ \\t\\n\\x0B\\f\\r]*\\n[ \\t\\n\\x0B\\f\\r]*', '-', 'g')) as hyphened from h""")
def hyphen_variants(spark, d):
    v = D.hyphen_variants(F.replace("text", F.lit(" the "), F.lit(" th-\n e ")))
    return table(spark, d, "documents").select("doc_id", *(_MD5(v[i]).alias(n) for i, n in enumerate(("as_is", "joined", "hyphened"))))


@query("""select doc_id, case when doc_id % 4 = 0 then 0 else cast(length(substr(text, 11, cast(10 + doc_id % 900 as bigint))) as integer) end as agreed from documents""")
def quote_divergence(spark, d):
    """How far quotes of many lengths agree with their text before a sign that it does not hold."""
    part = F.substr("text", F.lit(11), (10 + F.col("doc_id") % 900).cast("int"))
    quote = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\x01"), part)).otherwise(F.concat(part, F.lit("\x01"), part))
    return table(spark, d, "documents").select("doc_id", D.divergence(quote, F.col("text")).alias("agreed"))


@query("""with recursive s as (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars, doc_id) as i from documents),
w as (select source, i, 1 as batch, 1 as n, n_chars as longest from s where i = 1
  union all select s.source, s.i, case when w.n >= 8 or greatest(w.longest, s.n_chars) * (w.n + 1) > 20000 then w.batch + 1 else w.batch end, case when w.n >= 8 or greatest(w.longest, s.n_chars) * (w.n + 1) > 20000 then 1 else w.n + 1 end,
    case when w.n >= 8 or greatest(w.longest, s.n_chars) * (w.n + 1) > 20000 then s.n_chars else greatest(w.longest, s.n_chars) end from w join s on s.source = w.source and s.i = w.i + 1)
select source, batch, count(*) as n, max(longest) as longest from w group by 1, 2""")
def length_batches(spark, d):
    """Texts of a source by length, in batches of at most 8 whose number times longest is at most 20,000."""
    return D.length_batches(table(spark, d, "documents").select("source", F.col("doc_id").alias("key"), F.col("n_chars").alias("size")), 8, 20_000, "source").groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("longest"))


@query()
def layout_sections(spark, d):
    """Chunks of lines as a converter's elements: numbered headings, special ones, and references after which all goes."""
    i, line = F.col("i"), F.col("line")
    heading = i % 6 == 0
    text = F.when(i % 42 == 36, "References").when(i % 30 == 24, "Conclusion").when(heading, F.concat((1 + F.floor(i / 18)).cast("string"), F.when(i % 18 != 0, F.concat(F.lit("."), (i % 18 / 6).cast("int").cast("string"))).otherwise(""), F.lit(" "), F.left(line, F.lit(20)))).otherwise(line)
    rows = lines(spark, d).select("doc_id", i.alias("pos"), "page", text.alias("text"), F.when(heading, 1).alias("level"))
    return D.layout_chunks(rows, 1_000).select("doc_id", "chunk_id", "pos", F.array_join("title_path", " · ").alias("path"), "part", "parts", "first_page", "last_page", F.length("text").alias("n_chars"))
