"""Queries of small extractors and of names that are looked up, made from parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import dims, reports, spans

from .registry import query, table

_P = "p as (select p_partkey k, p_name n, p_type t, p_size s from part)"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_type").alias("t"), F.col("p_size").alias("s"))


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query(f"""with {_P} select k, n || '|' || case when k % 3 = 0 then t || ' 1:2' else '' end title, case k % 3 when 0 then n || ' — ' || t || '|who ' || s when 1 then n || '|' else n || '—' || t || '|' end credit,
case k % 3 when 0 then n || '.|' || t when 1 then n || ' (' || t || ')|' else n || '!”|x ' || s end source, case k % 3 when 0 then n || '|' || t || ' 1:' || s || '|him' when 1 then n || '|' || s || '|-' else n || ' (' || t || ')|-|-' end ref,
case k % 3 when 0 then t || '|' || n when 1 then '-|x: ' || n else '-|' || n || ':' || t end lead, case when k % 3 = 0 then s end verse from p""")
def text_pieces(spark, sf_dir):
    """Titles with references, credits, sources, references with their speakers, leads, and verses named, with and without each."""
    n, t, s, k = (F.col(c) for c in "ntsk")
    pick = lambda *forms: F.element_at(F.array(*forms), (k % 3 + 1).cast("int"))
    bars = lambda st, *names: F.concat_ws("|", *[F.coalesce(st[c], F.lit("-")) for c in names])
    return _parts(spark, sf_dir).select(
        "k", bars(T.split_title(pick(_text(n, " (", t, " 1:2) "), n, n)), "label", "ref").alias("title"),
        bars(T.credited(pick(_text(n, " — ", t, "  —  who ", s), n, _text(n, "—", t))), "text", "who").alias("credit"),
        bars(T.source_note(pick(_text(n, ". (", t, ")"), _text(n, " (", t, ")"), _text(n, "!” (x ", s, ")"))), "text", "source").alias("source"),
        bars(T.split_ref(pick(_text(n, " (", t, " 1:", s, ") — him"), _text(n, "(", s, ") "), _text(n, " (", t, ")"))), "text", "ref", "said").alias("ref"),
        bars(T.split_lead(pick(_text(t, ": ", n), _text("x: ", n), _text(n, ":", t))), "lead", "rest").alias("lead"),
        T.entry_verse(pick(_text(n, " (vv. ", s, ", 4)"), _text(n, " verse ", s), n)).cast("long").alias("verse"),
    )


@query(f"""with {_P} select k, case k % 3 when 0 then n else n || ' (' || t || ') x' end speaker, case k % 3 when 0 then n || ';' || t else n end names, cast(case k % 3 when 0 then 3 when 1 then s % 4 + 1 else 0 end as int) facets,
case k % 3 when 0 then n || '. ' || t when 1 then n || '?” ' || t else t end description, case when k % 3 = 0 then 1000 + s end as year, case when k % 3 = 0 then n end as name,
case k % 4 when 0 then '' when 1 then 'v. ' || s else 'v. ' || s || ', ' || (s + 1) || ', ' || (s + 2) || case k % 4 when 2 then ', ' || (s + 3) else ' +2' end end label from p""")
def text_labels(spark, sf_dir):
    """Speakers, lists of names and how many they are, descriptions, headings with years, and labels of verses."""
    n, t, s, k = (F.col(c) for c in "ntsk")
    pick = lambda *forms: F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    verses = pick(F.array().cast("array<int>"), F.array(s), F.array(s, s + 1, s + 2, s + 3), F.array(s, s + 1, s + 2, s + 3, s + 4))
    items = pick(F.array().cast("array<int>"), F.sequence(F.lit(1), (s % 4 + 1).cast("int")), F.array().cast("array<int>"))
    heading = T.year_heading(pick(_text(1000 + s, " · ", n), n, _text("12 · ", n)))
    return _parts(spark, sf_dir).select(
        "k", T.speaker_name(pick(_text(n, " (quoting ", t, ")"), _text(n, " (", t, ") x"), _text(n, " (", t, ") x"))).alias("speaker"),
        F.array_join(T.names_in(pick(_text(n, " · ", t, " ;"), n, n)), ";").alias("names"), T.facet_count(items, pick(_text(n, " · ", t, " and x"), n, F.lit(None))).alias("facets"),
        T.description(pick(n, _text(n, "?”"), F.lit("")), t).alias("description"), heading["year"].cast("long").alias("year"), heading["name"].alias("name"), T.verses_label(verses).alias("label"),
    )


@query("""with p as (select replace(lower(p_name), ' ', '') f, arg_min(p_name, p_partkey) as name from part group by 1), s as (select o_orderkey k, (select p_name from part where p_partkey = 1 + o_custkey % 100) n from orders)
select k, case when k % 3 = 2 then null else p.name end prophet from s left join p on replace(lower(s.n), ' ', '') = p.f""")
def prophets_named(spark, sf_dir):
    """Speakers named with what they do, in other capitals, or as no one."""
    part = table(spark, sf_dir, "part")
    o = table(spark, sf_dir, "orders").withColumn("p_partkey", 1 + F.col("o_custkey") % 100)
    named = o.join(part.select("p_partkey", "p_name"), "p_partkey", "left")
    n = F.col("o_orderkey") % 3
    said = F.when(n == 0, F.concat("p_name", F.lit(" (quoting Isaiah)"))).when(n == 1, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(F.concat(F.lit("not "), "p_name"))
    rows = named.select(F.col("o_orderkey").alias("k"), said.alias("speaker"))
    return reports.prophet_named(rows, part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")), "speaker").select("k", "prophet")


@query("""with c as (select c_custkey id, 'n' || (c_custkey // 2) core, case when c_custkey % 2 = 0 then 'Land of N' || (c_custkey // 2) else 'The Hill of N' || (c_custkey // 2) end as name, case when c_custkey % 5 = 0 then 'Old ' || c_custkey end alt from customer),
a as (select core, min(id) one, count(*) n from c group by core)
select o_orderkey k, case o_orderkey % 4 when 0 then o_custkey when 1 then case when o_custkey % 5 = 0 then o_custkey end when 2 then case when n = 1 then one end end place
from orders join c on o_custkey = c.id join a using (core)""")
def places_named(spark, sf_dir):
    """Places by their whole name, their other name, by what is left without its kind, or not at all."""
    kind = F.when(F.col("c_custkey") % 2 == 0, "Land of N").otherwise("The Hill of N")
    core = F.floor(F.col("c_custkey") / 2).cast("string")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(kind, core).alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Old "), "c_custkey")).alias("alt_name"), F.col("c_custkey").alias("pos"), core.alias("core"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("id"))
    n = F.col("o_orderkey") % 4
    asked = F.when(n == 0, F.upper("name")).when(n == 1, F.concat(F.lit("old "), "o_custkey")).when(n == 2, F.concat(F.lit("the waters of n"), "core")).otherwise("")
    return reports.place_named(o.select(F.col("o_orderkey").alias("k"), asked.alias("asked")), c, "asked").select("k", "place")


@query("select user_id, event_id, year, year is distinct from lag(year) over (partition by user_id order by event_id) opens from (select user_id, event_id, 1800 + event_id % 3 as year from events) q")
def year_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (1800 + F.col("event_id") % 3).alias("year"))
    return dims.year_changes(e, "user_id", "event_id", "year")


@query("select user_id, (1800 + min(event_id) % 3) || '–' || (1800 + max(event_id) % 3) span from events group by user_id")
def year_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (1800 + F.col("event_id") % 3).alias("year"))
    return dims.year_span(e, "user_id", "event_id", "year")


@query("select event_type, min(event_id) pos from events group by event_type")
def first_seen(spark, sf_dir):
    return dims.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("select doc_id, case when doc_id % 3 = 0 then 'later' when doc_id % 2 = 0 or doc_id % 3 = 0 then 'first' end told from documents where doc_id % 2 = 0 or doc_id % 3 = 0")
def merged_maps(spark, sf_dir):
    """Two tables of labels for chapters; where both have one the later's."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return dims.merged(d.where("doc_id % 2 = 0").withColumn("told", F.lit("first")), d.where("doc_id % 3 = 0").withColumn("told", F.lit("later")), ["doc_id"])


@query("""with u as (select lang volume_id, doc_id chapter from documents where lang is not null)
select volume_id, chapter, case when chapter % 2 = 0 then 'mine ' || chapter when volume_id = 'en' and chapter % 5 <> 0 then 'theirs ' || chapter end as text from u""")
def chapter_summaries(spark, sf_dir):
    """One's own summaries of every other chapter, empty ones among them, and a volume's bundled ones."""
    d = table(spark, sf_dir, "documents").where("lang is not null").select(F.col("lang").alias("volume_id"), F.lit("b").alias("book"), F.col("doc_id").alias("chapter"))
    n = F.col("chapter")
    own = d.select("book", "chapter", F.when(n % 2 == 0, F.concat(F.lit("mine "), "chapter")).otherwise("").alias("text"))
    bundled = d.where(n % 5 != 0).select("book", "chapter", F.concat(F.lit("theirs "), "chapter").alias("text"))
    return dims.summary(d, own, bundled, "en").select("volume_id", "chapter", "text")


@query("select l_orderkey k, count(*) n, 4 verse_count from lineitem group by l_orderkey having count(*) <> 4")
def count_mismatches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    dim = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).alias("verse_count"))
    return reports.mismatches(li, dim, ["k"])


@query("select l_orderkey % 500 verse, l_linenumber w1, l_linenumber + 2 w2, count(*) n, min(l_partkey) least from lineitem where l_orderkey % 7 <> 0 group by 1, 2")
def marker_groups(spark, sf_dir):
    """Entries that share a span, as one marker; those without a place have none."""
    verse = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey") % 500)
    e = table(spark, sf_dir, "lineitem").select(verse.alias("verse"), F.col("l_linenumber").alias("w1"), (F.col("l_linenumber") + 2).alias("w2"), F.lit("q").alias("quote"), F.col("l_partkey").alias("id"))
    return spans.markers(e).select("verse", "w1", "w2", F.size("entries").cast("long").alias("n"), F.array_min("entries").alias("least"))


@query("select o_orderkey % 40 + 1 chapter, min(case o_orderkey % 3 when 0 then '0' || (o_orderkey % 9) || '-' else '' end || case when o_orderkey % 2 = 0 then '1-nephi-' else '1nephi-00' end || (o_orderkey % 40 + 1) || case when o_orderkey % 5 = 0 then '-notes' else '' end || '.json') file from orders group by 1")
def chapter_files(spark, sf_dir):
    """Files of chapters, named in all the ways there are."""
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 3 == 0, F.concat(F.lit("0"), k % 9, F.lit("-"))).otherwise(""), F.when(k % 2 == 0, "1-nephi-").otherwise("1nephi-00"), k % 40 + 1, F.when(k % 5 == 0, "-notes").otherwise(""), F.lit(".json"))
    o = table(spark, sf_dir, "orders")
    chapters = o.select(F.lit("1 Nephi").alias("book"), (k % 40 + 1).cast("int").alias("chapter")).distinct()
    return spans.chapter_files(o.select(name.alias("file")), chapters).select(F.col("chapter").cast("long").alias("chapter"), "file")
