"""Queries of nested records, the manifest, and the doors of notes, made from the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import manifest, notes, refs
from lectern.sources import records
from lectern.sources.stored import new_path

from .reference_queries import _CITED, _INDEX, _cited, _texts
from .registry import query, table


def _charts(spark, sf_dir):
    """A chart for each order, written as markdown: facts, an intro, a part for each flag with a row for each line."""
    li = table(spark, sf_dir, "lineitem")
    row = F.concat(F.lit("- "), "l_partkey", F.lit(" // s"), "l_suppkey", F.lit(" | line "), "l_linenumber", F.lit("|"))
    rows = li.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    part = F.struct("l_returnflag", F.concat(F.array(F.concat(F.lit("## "), "l_returnflag"), F.lit("Rows of"), F.lit("one flag."), F.lit("")), "rows").alias("lines"))
    parts = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    head = F.array(F.concat(F.lit("# Order "), "l_orderkey"), F.concat(F.lit("* order: "), F.col("l_orderkey") % 7), F.lit("* columns: Part | Line"), F.lit(""), F.lit("An intro"), F.lit("of two lines."))
    lines = F.concat(head, F.flatten(F.transform("parts", lambda p: p["lines"])))
    return parts.select(F.concat(F.lit("order-"), "l_orderkey", F.lit(".md")).alias("file"), F.posexplode(lines).alias("line_no", "line"))


@query("""with r as (select l_orderkey k, l_returnflag f, string_agg(l_partkey || '/s' || l_suppkey || '|line ' || l_linenumber || '|', ';' order by '- ' || l_partkey || ' // s' || l_suppkey || ' | line ' || l_linenumber || '|') s from lineitem group by 1, 2)
select 'order-' || k slug, 'Order ' || k title, cast(k % 7 as double) "order", 'Part,Line' columns, 'An intro of two lines.' intro, string_agg(f || ':Rows of one flag.:' || s, '#' order by f) parts from r group by k""")
def chart_records(spark, sf_dir):
    """Charts read back from their markdown."""
    cell = lambda c: F.array_join(c, "/")
    part = lambda p: F.concat_ws(":", p["name"], p["prose"], F.array_join(F.transform(p["rows"], lambda r: F.array_join(F.transform(r, cell), "|")), ";"))
    made = records.charts(_charts(spark, sf_dir))
    return made.select("slug", "title", "order", F.array_join("columns", ",").alias("columns"), "intro", F.array_join(F.transform("parts", part), "#").alias("parts"))


@query(_INDEX + " select lower(book) book, cast(chapter as int) chapter, 'charts/' || page section, 'Page ' || page title, array_to_string(vs, ',') verses from idx where page <> 7")
def manifest_roundtrip(spark, sf_dir):
    """The study index written with its table of pages and read again; a page without a volume is not in it."""
    texts = _texts(spark, sf_dir)
    section = F.concat(F.lit("charts/"), "page")
    pages = texts.select("page").distinct().select(section.alias("section"), F.lit("Chart").alias("kind"), F.concat(F.lit("Page "), "page").alias("title"), F.when(F.col("page") != 7, "bofm").alias("volume_id"))
    path = new_path(spark, "manifest")
    manifest.write_manifest(pages, texts.select(section.alias("section"), F.col("text").alias("line")), path)
    return manifest.read_study(spark, path).select("book", "chapter", "section", "title", F.array_join(F.transform("verses", lambda v: v.cast("string")), ",").alias("verses"))


_PIECES = """n as (select k, book, chapter, chapters, v, unnest(['as it says (', 'v. ' || v, ') and ', 'vv. ' || v || '–' || (v + 2), ' in ', 'ch. ' || (chapter + 1), ', like ', 'Alma 5:7', '; see ', 'Nobody 3']) as text, unnest(range(10)) nth from cited join books using (book)),
d as (select *, case nth when 1 then case when v <= 10 then 'Go to verse ' || v end when 3 then case when v <= 8 then 'Go to verses ' || v || '–' || (v + 2) when v = 9 then 'Go to verses 9–10' when v = 10 then 'Go to verse 10' end
when 5 then case when chapter < chapters then 'Open ' || book || ' ' || (chapter + 1) end when 7 then 'Open Alma 5:7' end title from n)"""


@query(f"with {_CITED}, {_PIECES} select k, cast(nth as int) nth, text, case when title is null then null when starts_with(title, 'Go') then 'verses' else 'cite' end door, title from d")
def note_doors(spark, sf_dir):
    """A note for each order, with marks of all kinds, some of which lead nowhere and one that lies within another."""
    c = _cited(spark, sf_dir)
    v, text = F.col("v").cast("int"), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    pieces = [text("as it says ("), text("v. ", v), text(") and "), text("vv. ", v, "–", v + 2), text(" in "), text("ch. ", F.col("chapter") + 1), text(", like "), text("Alma 5:7"), text("; see "), text("Nobody 3")]
    own = c.withColumn("pieces", F.array(*pieces))
    ends = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda n: F.aggregate(F.slice("pieces", F.lit(1), n), F.lit(0), lambda a, p: a + F.length(p)))
    none = F.lit(None).cast("int")
    at = lambda n, inner=0: (F.get("ends", F.lit(n)) + inner, F.get("ends", F.lit(n + 1)))
    mark = lambda kind, span, verse=none, low=none, high=none, ch=none: F.struct(F.lit(kind).alias("kind"), span[0].alias("start"), span[1].alias("end"), verse.alias("verse"), low.alias("verse_start"), high.alias("verse_end"), ch.alias("ch_start"))
    marks = F.array(mark("scripture", at(9)), mark("scripture", at(7)), mark("chapter", at(5), ch=(F.col("chapter") + 1).cast("int")), mark("cite", at(3, 1), verse=F.lit(1)), mark("verse", at(3), low=v, high=v + 2), mark("cite", at(1), verse=v))
    made = own.withColumn("ends", ends).select(F.col("k").alias("note"), "book", F.col("chapter").cast("int").alias("chapter"), F.array_join("pieces", "").alias("text"), marks.alias("marks"))
    verses = refs.books(spark).select("book", F.explode(F.sequence(F.lit(1), "chapters")).alias("chapter")).select("book", "chapter", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("verse"))
    return notes.doors(made, verses).select(F.col("note").alias("k"), "nth", "text", "door", "title")


@query("""with e as (select o_orderkey id, case when o_orderkey % 3 = 0 then o_custkey % 6 end chapter, case when o_orderkey % 3 = 0 then o_orderkey % 9 + 1 end verse, o_custkey % 6 c, o_orderkey % 20 + 1 v from orders),
s as (select id, cast(verse as int) verse from e where chapter = 3 union all select distinct id, cast(unnest(case when c = 3 then [v, v + 1, 4] else [4] end) as int) from e where verse is null)
select verse, count(*) n, sum(id) ids from s group by verse""")
def connections_at_targets(spark, sf_dir):
    """Connections at the verses of chapter 3: by their own verse, or at those their target names."""
    o = table(spark, sf_dir, "orders")
    anchored = F.col("o_orderkey") % 3 == 0
    v, c = F.col("o_orderkey") % 20 + 1, F.col("o_custkey") % 6
    target = F.concat(c, F.lit(":"), v, F.lit("–"), v + 1, F.lit("; 3:4"))
    entries = o.select(F.col("o_orderkey").alias("id"), F.when(anchored, c).cast("int").alias("chapter"), F.when(anchored, F.col("o_orderkey") % 9 + 1).cast("int").alias("verse"), target.alias("target"))
    return notes.by_target(entries, 3).select("verse", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("ids"))
