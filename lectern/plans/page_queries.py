"""Queries of written pages, notes, selections and what is typed, made from the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import notes, pages, refs, reports

from .registry import query, table

_PARTS = "p as (select p_partkey k, cast(p_partkey as varchar) slug, p_name title, p_type subtitle, case when p_size <> 13 then p_brand end volume_id, case when p_size % 2 = 0 then p_size end ord from part)"
_SHELF = _PARTS + """, pages as (select 'chart' kind, k page_id, slug, title, subtitle, volume_id, 'charts/' || slug section, ord from p where k % 3 = 0
union all select 'evidence', k, slug, title, subtitle, volume_id, 'evidences/' || slug, ord from p where k % 3 = 1
union all select 'essay', k, slug, title, 'Essays — ' || subtitle, volume_id, 'evidences/' || slug, ord from p where k % 3 = 2)"""


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    volume, order = F.when(F.col("p_size") != 13, F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return p.select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("slug"), F.col("p_name").alias("title"), F.col("p_type").alias("subtitle"), volume.alias("volume_id"), order.alias("ord"))


def _shelf(spark, sf_dir):
    p = _parts(spark, sf_dir)
    essays = p.where("k % 3 = 2").withColumn("subtitle", F.concat(F.lit("Essays — "), "subtitle"))
    return pages.shelf({"chart:charts": p.where("k % 3 = 0"), "evidence:evidences": p.where("k % 3 = 1"), "essay:evidences": essays})


@query(f"with {_SHELF} select kind, slug, title, subtitle, volume_id, section from pages where volume_id is not null")
def page_shelf(spark, sf_dir):
    return _shelf(spark, sf_dir)


@query(f"with {_SHELF} select kind, slug, row_number() over (partition by kind order by coalesce(ord, 999), title, slug) nth from pages where volume_id is not null")
def shelf_order(spark, sf_dir):
    return pages.in_order(_shelf(spark, sf_dir).join(_parts(spark, sf_dir).select("slug", "ord"), "slug"), "ord").select("kind", "slug", "nth")


@query(f"""with {_SHELF}, s as (select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'charts/' || l_partkey when 1 then 'evidences/' || l_partkey else 'maps' end section from lineitem)
select l_orderkey, l_linenumber, s.section, pages.title from s left join pages on s.section = pages.section and pages.volume_id is not null""")
def page_titles(spark, sf_dir):
    """Titles of the pages that sections name; under one shelf evidences come before essays."""
    n = F.col("l_linenumber") % 3
    section = F.when(n == 0, F.concat(F.lit("charts/"), "l_partkey")).when(n == 1, F.concat(F.lit("evidences/"), "l_partkey")).otherwise("maps")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", section.alias("section"))
    return pages.page_titles(rows, _shelf(spark, sf_dir), {"charts": ["chart"], "evidences": ["evidence", "essay"]})


@query("with s as (select l_orderkey, l_linenumber, l_partkey page_id from lineitem) select l_orderkey, l_linenumber, page_id, 'part' kind, p_name title, 'parts/' || p_partkey section from s join part on page_id = p_partkey")
def cited_pages(spark, sf_dir):
    listed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("part").alias("kind"), F.col("p_name").alias("title"), F.concat(F.lit("parts/"), "p_partkey").alias("section"))
    return pages.cited_pages(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("page_id")), listed)


@query("select l_orderkey k, count(*) n from lineitem group by l_orderkey")
def chart_sizes(spark, sf_dir):
    """Lines of an order as the rows of a chart whose parts are the return flags."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_linenumber").alias("rows")).groupBy("l_orderkey").agg(F.collect_list(F.struct("rows")).alias("parts"))
    return parts.select(F.col("l_orderkey").alias("k"), pages.rows_of(F.col("parts")).cast("long").alias("n"))


_CONNECTED = """m as (select l_orderkey verse, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) pos, l_linenumber w1, l_partkey a, l_suppkey b from lineitem),
c as (select verse || chr(cast(96 + pos as int)) letter, verse, w1, pos, unnest([a, 1000000 + b]) id from m), e as (select letter, verse, w1, pos, id, case when p_type in ('SMALL', 'LARGE') then p_type else 'SMALL' end scope from c join part on id = p_partkey)"""


def _connected(spark, sf_dir):
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    marks = li.select(F.col("l_orderkey").alias("verse"), pos.alias("pos"), F.col("l_linenumber").alias("w1"), F.col("l_linenumber").alias("w2"), F.array("l_partkey", F.col("l_suppkey") + 1000000).alias("entries"))
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("scope"))
    return notes.connections(marks, entries, ["SMALL", "LARGE"])


@query(f"with {_CONNECTED} select letter, verse, w1, id, scope, row_number() over (order by verse, w1, pos, id) nth from e")
def connections_in_order(spark, sf_dir):
    """Entries that markers name, lettered within their verse; ids without an entry give nothing."""
    return notes.ordered(_connected(spark, sf_dir)).select("letter", "verse", "w1", "id", "scope", "nth")


@query(f"with {_CONNECTED} select scope, count(*) n, count(distinct verse) verses from e group by scope")
def connections_by_scope(spark, sf_dir):
    return notes.by_scope(_connected(spark, sf_dir))


@query(f"with {_CONNECTED} select verse, string_agg(distinct letter, ',' order by letter) letters from e group by verse")
def connections_by_verse(spark, sf_dir):
    return notes.by_verse(_connected(spark, sf_dir)).select("verse", F.array_join("letters", ",").alias("letters"))


@query("select l_orderkey verse, string_agg(l_linenumber || '-' || (l_linenumber + l_suppkey % 3), ',' order by l_linenumber, l_suppkey % 3) words from lineitem where l_returnflag = 'R' and l_linenumber % 2 = 1 group by l_orderkey")
def underlines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("level"), (F.col("l_linenumber") % 2).alias("chapter"), F.col("l_orderkey").alias("verse"), F.col("l_linenumber").alias("w1"), (F.col("l_linenumber") + F.col("l_suppkey") % 3).alias("w2"))
    pair = lambda w: F.concat_ws("-", w["w1"].cast("string"), w["w2"].cast("string"))
    return notes.underlines(rows, "R", 1).select("verse", F.array_join(F.transform("words", pair), ",").alias("words"))


@query("""with v as (select l_orderkey k, 'Alma ' || (l_orderkey % 60 + 1) ref, l_linenumber verse, l_shipdate from lineitem), g as (select k, ref, min(verse) lo, max(verse) hi, string_agg('v' || verse, ' ' order by verse) t from (select distinct k, ref, verse from v) q group by all)
select k, '“' || t || '” (' || ref || ':' || lo || case when lo = hi then '' else '–' || hi end || ')' quote from g""")
def quoted_selections(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("Alma "), F.col("l_orderkey") % 60 + 1).alias("ref"), F.col("l_linenumber").alias("verse"), F.concat(F.lit("v"), "l_linenumber").alias("text")).distinct()
    return notes.quoted(v, "k", "ref")


@query("""with c as (select o_orderkey k, 'Alma ' || (o_orderkey % 20 + 1) || ', ' || (o_custkey % 9 + 30) || '–' || (o_custkey % 9 + 32) s, o_orderkey % 20 + 1 a, o_custkey % 9 + 30 b from orders)
select k, 0 as "at", 'Alma' book, cast(a as int) chapter, 'Alma ' || a as label from c union all select k, i + 1, 'Alma', cast(b + i as int), 'Alma ' || (b + i) from c, generate_series(0, 2) t(i)""")
def chapter_refs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("alma "), F.col("o_orderkey") % 20 + 1, F.lit(", "), F.col("o_custkey") % 9 + 30, F.lit("–"), F.col("o_custkey") % 9 + 32).alias("spec"))
    return refs.chapter_refs(o, "k", "spec").withColumn("at", F.col("at").cast("long"))


@query("select distinct o_custkey page from orders where o_orderkey % 60 + 1 = 7 and o_orderkey % 3 = 0")
def treating_pages(spark, sf_dir):
    """Pages whose lines cite Alma 7, found in their prose."""
    book = F.when(F.col("o_orderkey") % 3 == 0, "Alma").otherwise("Ether")
    lines = table(spark, sf_dir, "orders").select(F.struct("o_orderkey", "o_custkey").alias("id"), F.concat(F.lit("see "), book, F.lit(" "), F.col("o_orderkey") % 60 + 1, F.lit(":3 on this")).alias("line"))
    found = refs.parse_citations(lines.select("id", F.regexp_extract("line", refs.citation_pattern(), 0).alias("cite")).where("cite <> ''"), "id", "cite")
    return notes.treats(found.withColumn("page", F.col("id.o_custkey")), "page", "alma", 7)


@query("""with v as (select distinct l_orderkey % 50 chapter, l_linenumber verse from lineitem where l_linenumber > 1), g as (select distinct o_orderkey % 50 chapter, o_custkey % 6 + 1 verse, o_custkey page, o_orderkey % 4 = 0 whole from orders)
select g.chapter, g.verse, page, whole from g join v using (chapter, verse) where not whole union all select chapter, f.verse, page, whole from g join (select chapter, min(verse) verse from v group by chapter) f using (chapter) where whole""")
def marks_at(spark, sf_dir):
    verses = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.lit("B").alias("book"), (F.col("l_orderkey") % 50).alias("chapter"), F.col("l_linenumber").cast("long").alias("verse")).distinct()
    margin = table(spark, sf_dir, "orders").select(F.lit("B").alias("book"), (F.col("o_orderkey") % 50).alias("chapter"), (F.col("o_custkey") % 6 + 1).alias("verse"), F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 4 == 0).alias("whole")).distinct()
    return notes.marks_at(margin, verses).drop("book")


@query("""with h as (select user_id, event_id k from events where event_type = 'error'), b as (select user_id, event_id k from events where event_type = 'click')
select h.user_id, h.k as "at", 'h' || h.k as head, 't' || min(b.k) as text from h join b on h.user_id = b.user_id and b.k >= h.k group by h.user_id, h.k""")
def following_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    heads = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("at"), F.concat(F.lit("h"), "event_id").alias("head"))
    blocks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("at"), F.concat(F.lit("t"), "event_id").alias("text"))
    return notes.following(heads, blocks, "user_id")


@query("""with r as (select user_id, event_id start, event_type t from events), n as (select *, start + length(t) as stop, lag(start + length(t)) over w before from r window w as (partition by user_id order by start)),
g as (select *, sum(case when before is null or start - before >= 60 then 1 else 0 end) over (partition by user_id order by start) n from n) select user_id, min(start) start, arg_max(stop, start) as "end", string_agg(t, ' ' order by start) as text from g group by user_id, n""")
def stitched_titles(spark, sf_dir):
    return notes.stitched(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), F.col("event_type").alias("text")), "user_id", 60)


@query("select l_returnflag volume_id, count(*) verses, round(avg(case when l_discount > 0 then 1 - l_discount end), 3) mean, count(*) filter (l_discount > 0 and 1 - l_discount < 0.95) below, count(*) filter (l_discount <= 0) missing from lineitem group by l_returnflag")
def agreement(spark, sf_dir):
    like = F.when(F.col("l_discount") > 0, 1 - F.col("l_discount"))
    return reports.agreement(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("volume_id"), like.alias("similarity")), "volume_id", 0.95)


@query("select o_orderpriority g, count(distinct o_custkey) sections from orders group by o_orderpriority")
def section_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.concat(F.lit("D "), "o_custkey", F.lit(":"), "o_orderkey").alias("ref"))
    return reports.sections(o, "g", "ref")


@query("select l_partkey as value, count(*) n from lineitem group by l_partkey order by n desc, value limit 10")
def most_frequent(spark, sf_dir):
    return reports.most_frequent(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("value")), "value")


@query("select c_custkey, 'customer' || c_nationkey file, c_nationkey nation, cast(c_custkey % 25 as int) stated_nation from customer where c_nationkey <> c_custkey % 25")
def misnamed_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    named = c.select("c_custkey", F.concat_ws("-", F.lit("customer"), "c_nationkey", "c_custkey").alias("file"), F.col("c_nationkey").alias("nation"))
    content = c.select(F.concat_ws("-", F.lit("customer"), "c_nationkey", "c_custkey").alias("file"), (F.col("c_custkey") % 25).cast("int").alias("nation"))
    return reports.misnamed(named, content, ["nation"]).withColumn("file", F.concat(F.lit("customer"), "nation"))


@query("""select p_partkey, split_part(p_name, ' ', 1) || '''s ' || p_name || ' of' q, case when position(' ' in p_name) > 0 then 'X' || substr(split_part(p_name, ' ', 1) || '''s ' || p_name || ' of', length(split_part(p_name, ' ', 1)) + 3) end replaced,
split_part(p_name, ' ', 1) || '''s ' || p_name || ' often' completed, cast(length(split_part(p_name, ' ', 1)) as int) shared from part""")
def typed_words(spark, sf_dir):
    """A word replaced by its folded form, the last one completed, the run shared with what is typed."""
    first = F.substring_index("p_name", " ", 1)
    q = F.concat(first, F.lit("'s "), "p_name", F.lit(" of"))
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("q"), T.replace_word(q, F.concat(first, F.lit("s")), F.lit("X")).alias("replaced"), T.complete_last(q, F.lit("often")).alias("completed"), T.shared_run(F.upper(first), q).alias("shared"))


@query("""with c as (select distinct p_name title from part where p_name like '%wid%'), w as (select word, row_number() over (order by word) nth from (select distinct split_part(p_name, ' ', 2) word from part where split_part(p_name, ' ', 2) like 'wid_%') q)
select 1 tier, 1 nth, 'ref' kind, 'Words of Mormon 1' label, cast(null as int) count union all select 3, 1, 'page', 'wid', 2 union all select 4, 1, 'search', 'wid', null
union all select 5, cast(row_number() over (order by title) as int), 'article', title, null from (select title from c order by title limit 3) q union all select 6, cast(nth as int), 'complete', word, null from w where nth <= 5""")
def typed_suggestions(spark, sf_dir):
    """What is offered for ``wid``: a reference, articles that hold it, the page's two hits, the search, completions."""
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    found = reports.articles(part.select(F.col("p_name").alias("title"), F.lit("").alias("subtitle")).distinct(), "title", "subtitle", "wid")
    ranked = found.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), "title")))  # three rows
    words = part.select(F.substring_index("p_name", " ", -1).alias("word")).where("word like 'wid_%'").distinct().orderBy("word").limit(5)
    words = words.withColumn("nth", F.row_number().over(Window.orderBy("word")))
    ref = spark.createDataFrame([("Words of Mormon 1", 1)], "label string, nth int")
    return pages.suggestions(" wid ", ref, ranked, words, on_page=2)
