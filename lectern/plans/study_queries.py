"""Queries of chapter dimensions, spans, alignment and reports.

Captions, sections and dates are made from the documents: a document's section is
its count of lines modulo five, missing for every third.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align, dims, reports, spans
from lectern.sources.corpus import document_verses

from .registry import query, table
from .search_queries import LINES

_UNITS = LINES + ", u as (select volume_id, book, unit chapter, count(*) n from verses group by all), c as (select *, cast(substr(book, 4) as int) book_pos, case when chapter % 3 <> 0 then 'S' || (n % 5) end section, 'c. ' || (600 - n) || '–' || (590 - n) || ' B.C.' date_label from u)"
_STOPS = _UNITS + """, s as (select *, section is not null and section is distinct from last_value(section ignore nulls) over (partition by volume_id order by book_pos, chapter rows between unbounded preceding and 1 preceding) opens_section,
row_number() over (partition by volume_id, book_pos order by chapter) = 1 opens_book from c)"""
_RUNS = _STOPS + ", n as (select *, sum(case when opens_section or opens_book then 1 else 0 end) over (partition by volume_id order by book_pos, chapter) run from s), r as (select volume_id, run, min(book) book, min(chapter) as first, max(chapter) as last, count(*) stops, arg_min(date_label, chapter) date_label from n group by volume_id, run)"


def _verses(spark, sf_dir):
    return document_verses(table(spark, sf_dir, "documents"))


def _dims(spark, sf_dir):
    """Units with their book's position; captions with sections; dates."""
    own = _verses(spark, sf_dir).groupBy("volume_id", "book", F.col("unit").alias("chapter")).agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("book_pos", F.substring("book", 4, 9).cast("int"))
    section = F.when(F.col("chapter") % 3 != 0, F.concat(F.lit("S"), F.col("n") % 5))
    captions = own.select("book", "chapter", section.alias("section"))
    dates = own.select("book", "chapter", F.format_string("c. %d–%d B.C.", 600 - F.col("n"), 590 - F.col("n")).alias("date_label"))
    return own, captions, dates


def _stops(spark, sf_dir):
    return dims.stops(*_dims(spark, sf_dir))


@query("with " + _STOPS + " select volume_id, book, chapter, section, date_label, opens_section, opens_book from s")
def stops(spark, sf_dir):
    return _stops(spark, sf_dir).select("volume_id", "book", "chapter", "section", "date_label", "opens_section", "opens_book")


@query("with " + _RUNS + " select volume_id, run, book, first, last, stops, date_label from r")
def runs(spark, sf_dir):
    return dims.runs(_stops(spark, sf_dir)).select("volume_id", "run", "book", "first", "last", "stops", "date_label")


@query("with recursive " + _UNITS + """, g as (select volume_id, book, count(*) n, row_number() over (partition by volume_id order by book_pos) i from c group by volume_id, book, book_pos),
r as (select volume_id, book, i, 0 band, case when n >= 3 then 3 else 1 end held from g where i = 1
union all select g.volume_id, g.book, g.i, r.band + case when n >= 3 or held >= 3 then 1 else 0 end, case when n >= 3 then 3 when held >= 3 then 1 else held + 1 end from r join g on g.volume_id is not distinct from r.volume_id and g.i = r.i + 1)
select volume_id, book, cast(band as int) band from r""")
def bands(spark, sf_dir):
    own, _, _ = _dims(spark, sf_dir)
    return dims.bands(own.groupBy("volume_id", "book_pos", "book").agg(F.count(F.lit(1)).cast("int").alias("n")))


@query("with " + _RUNS + ", e as (select volume_id, arg_min(date_label, run) a, arg_max(date_label, run) b from r group by volume_id) select volume_id, split_part(a, '–', 1) || '–' || split_part(b, '–', 2) span from e where a <> b union all select volume_id, a from e where a = b")
def band_spans(spark, sf_dir):
    r = dims.runs(_stops(spark, sf_dir)).groupBy("volume_id").agg(F.min_by("date_label", "run").alias("a"), F.max_by("date_label", "run").alias("b"))
    return r.select("volume_id", dims.span_label(F.col("a"), F.col("b")).alias("span"))


@query("with " + LINES + ", u as (select distinct volume_id, book, unit from verses) select *, lag(unit) over w previous, lead(unit) over w as next from u window w as (partition by volume_id order by book, unit)")
def neighbours(spark, sf_dir):
    return dims.neighbours(_verses(spark, sf_dir).select("volume_id", "book", "unit").distinct())


@query("select doc_id, lang, quality, toxic from documents join labels using (doc_id) where quality = 1 and toxic = 1")
def two_axis_overview(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return dims.matching(rows, quality=1, toxic=1, lang=[])


@query("select o_orderkey k, unnest(generate_series(1 + o_orderkey % 5, 1 + o_orderkey % 5 + o_custkey % 4)) chapter from orders")
def range_explode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 5).alias("a"), (F.col("o_custkey") % 4).alias("n"))
    return dims.range_explode(o.withColumn("spec", F.format_string("%d–%d", "a", F.col("a") + F.col("n"))), "spec").select("k", F.col("chapter").cast("long").alias("chapter"))


@query("select user_id, event_id, first_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) head from events")
def backfill_heads(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("head"))
    return dims.backfill(e, ["user_id"], "event_id", "head")


@query("select user_id, event_type folded, nth from (select user_id, event_type, row_number() over (partition by user_id order by max(ts) desc, event_type) nth from events group by user_id, event_type) q where nth <= 5")
def recent_searches(spark, sf_dir):
    return reports.recent(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("with " + LINES + ", t as (select volume_id, unit, verse from verses) select unit, verse, volume_id, verse || chr(cast(97 + (row_number() over (partition by unit, verse order by volume_id) - 1) as int)) letter from t")
def footnote_letters(spark, sf_dir):
    marks = _verses(spark, sf_dir).select("unit", "verse", "volume_id")
    return spans.letters(marks, "volume_id")


@query("with " + LINES + ", w as (select unit, verse, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') w from verses) select unit, verse, case when 20 - 7 > 1 then '… ' else '' end || array_to_string(w[13:29], ' ') || case when len(w) > 29 then ' …' else '' end excerpt from w where len(w) >= 22")
def excerpts(spark, sf_dir):
    v = _verses(spark, sf_dir).where(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")) >= 22)
    return v.select("unit", "verse", T.excerpt(F.col("text"), F.lit(20), F.lit(22)).alias("excerpt"))


@query("with " + LINES + " select unit, verse, md5(text) joined, cast(case when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 5 then 3 when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 3 then 2 else 1 end as bigint) n from verses where text <> ''")
def segments_roundtrip(spark, sf_dir):
    """Words 3 to 5 of every verse marked: the segments joined give the text again."""
    v = _verses(spark, sf_dir).where(F.col("text") != "")
    marks = v.select("unit", "verse", F.lit(3).alias("w1"), F.lit(5).alias("w2"), F.lit("a").alias("id"))
    cut = spans.segments(v, marks).groupBy("unit", "verse").agg(F.sort_array(F.collect_list(F.struct("seg", "text"))).alias("s"))
    return cut.select("unit", "verse", F.md5(F.array_join(F.col("s.text"), "")).alias("joined"), F.size("s").cast("long").alias("n"))


@query("""with q as (select lang volume_id, count(*) expected, count(l.doc_id) matched, cast(floor(100.0 * count(l.doc_id) / count(*) + 0.5) as int) percent from documents d left join (select distinct doc_id from labels) l using (doc_id) group by lang)
select *, rpad(repeat('█', cast(floor(percent / 5.0 + 0.5) as int)), 20, '·') bar from q""")
def coverage_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("volume_id"), "doc_id")
    return reports.coverage(docs, table(spark, sf_dir, "labels"), "volume_id", ["doc_id"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def gap_report(spark, sf_dir):
    return reports.gaps(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("select distinct props from events where props not in (select '{\"k\": ' || n_nationkey || '}' from nation)")
def unknown_keys(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.format_string('{"k": %d}', "n_nationkey").alias("props"))
    return reports.gaps(table(spark, sf_dir, "events").select("props").distinct(), known, ["props"])


@query("with k as (select n_name known from nation), n as (select distinct 'NAT' || substr(c_name, 10) || '_' || c_nationkey as name from customer), p as (select name, known, max(i) shared from n, k, unnest(generate_series(1, length(name))) t(i) where lower(substr(name, 1, i)) = lower(substr(known, 1, i)) and length(known) >= i group by all) select name, known, shared from p qualify row_number() over (partition by name order by shared desc, known) = 1")
def nearest_prefix_name(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("NAT"), F.expr("substr(c_name, 10)"), F.lit("_"), "c_nationkey").alias("name")).distinct()
    return reports.nearest_by_prefix(names, table(spark, sf_dir, "nation").select(F.col("n_name").alias("known"))).withColumn("shared", F.col("shared").cast("long"))


@query("with t as (select distinct 'The book of ' || p_name title from part), k as (select distinct split_part(p_name, ' ', 2) known from part) select title, arg_max(known, length(known)) known from t join k on suffix(upper(replace(title, ' ', '')), upper(known)) group by title")
def longest_suffix_name(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    titles = parts.select(F.concat(F.lit("The book of "), "p_name").alias("title")).distinct()
    return reports.longest_suffix(titles, parts.select(F.element_at(F.split("p_name", " "), 2).alias("known")).distinct())


@query("with r as (select distinct p_name || ' (' || p_type || ')' place from part), e as (select place, split_part(place, ' (', 1) core, count(*) over (partition by split_part(place, ' (', 1)) k from r), n as (select distinct p_name as name from part) select name, place from n left join (select * from e where k = 1) u on u.core = n.name")
def unique_core_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    places = parts.select(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("place")).distinct()
    return reports.unique_core(parts.select(F.col("p_name").alias("name")).distinct(), places, "name", "place").select("name", "place")


_TYPED = ["blue ring", "the blue r", "blue", "wid", "ing", "standard", "mall", "large bolt", "of"]
_PAGES = "with p as (select distinct case when p_type = 'LARGE' then 'The ' || p_name else p_name end title, p_type subtitle from part), n as (select *, lower(title) t, regexp_replace(lower(title), '^(the|a|an) ', '') b, lower(title || ' ' || subtitle) s from p, (select unnest([" + ", ".join(f"'{t}'" for t in _TYPED) + "]) typed) q where length(typed) > 2)"


@query(_PAGES + """, r as (select *, case when t = typed or b = typed then 100 when starts_with(t, typed) or starts_with(b, typed) then 80 when contains(t, ' ' || typed) then 60 when contains(t, typed) then 45
when starts_with(s, typed || ' ') or contains(s, ' ' || typed) then 30 when contains(s, typed) then 20 when contains(typed, ' ') and len(list_filter(string_split(typed, ' '), lambda w: not contains(s, w))) = 0 then 12 end score from n)
select typed, title, subtitle, score, score = 100 or (score = 80 and length(typed) >= 8) strong from r where score is not null qualify row_number() over (partition by typed order by score desc, title, subtitle) <= 3""")
def article_score(spark, sf_dir):
    """The three best pages for texts of every tier."""
    title = F.when(F.col("p_type") == "LARGE", F.concat(F.lit("The "), "p_name")).otherwise(F.col("p_name"))
    pages = table(spark, sf_dir, "part").select(title.alias("title"), F.col("p_type").alias("subtitle")).distinct()
    found = [reports.articles(pages, "title", "subtitle", t).withColumn("typed", F.lit(t)) for t in _TYPED]
    return reduce(lambda a, b: a.unionByName(b), found).select("typed", "title", "subtitle", "score", "strong")


@query("select s_name as name, r_name region from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where lower(r_name) like '%asia%' order by s_name limit 8")
def place_search(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("s_nationkey = n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    return reports.places(rows.select(F.col("s_name").alias("name"), F.col("r_name").alias("region")), "name", "region", "Asia")


#: A line of each kind and its class, by hand; %d is a number of one to four digits.
_SCANNED = [
    ("   ", "blank"), (" %d ", "head"), ("BOOK OF MOSIAH, %d.", "head"), ("4 Pearl of Great Price %d", "head"), ("II.] WRITINGS %d^", "head"), ("84 COVENANTS AND [SEC. V %d.", "head"),
    ("a, 1 Ne. 3: %d", "apparatus"), ("2a, see Alma %d", "apparatus"), ("see b, and %d", "apparatus"), ("w, compare verse %d", "apparatus"), ("Verses %d and on", "apparatus"), ("/, Near the close %d", "apparatus"),
    ("q. in verse 2 and verse %d", "apparatus"), ("BBTWIBN 0 ANO %d", "head"), ("About the year %d", "head"), ("about 592 b. c. it was", "head"),
    ("CHAPTER %d. see b, verse 2", None), (" section %d", None), ("And it came to pass that %d went forth", None), ("God, see that ye serve him", None), ("he spake [these] words unto the people of that land", None),
]
_KIND = "case o_orderkey % " + str(len(_SCANNED)) + " " + " ".join(f"when {n} then {'null' if kind is None else repr(kind)}" for n, (_, kind) in enumerate(_SCANNED)) + " end"


@query(f"select o_orderkey, {_KIND} kind from orders")
def classify_lines(spark, sf_dir):
    """Lines of every class, numbered by the orders."""
    form = F.element_at(F.array(*[F.lit(line) for line, _ in _SCANNED]), (F.col("o_orderkey") % len(_SCANNED) + 1).cast("int"))
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.replace(form, F.lit("%d"), (F.col("o_orderkey") % 9999 + 1).cast("string")).alias("line"))
    return lines.select("o_orderkey", align.classify(F.col("line")).alias("kind"))


@query()
def align_lines(spark, sf_dir):
    """Every document aligned with a disturbed copy: each seventh line lost, each fifth twice, a word changed in each third."""
    own = _verses(spark, sf_dir).select("unit", "verse", "text")
    text = F.when(F.col("verse") % 3 == 0, F.regexp_replace("text", r"^(\S+\s+)\S+", "$1smudge")).otherwise(F.col("text"))
    kept = own.where("verse % 7 <> 4").select("unit", text.alias("text"), F.explode(F.expr("if(verse % 5 = 2, array(2 * verse, 2 * verse + 1), array(2 * verse))")).alias("block"))
    return align.align_chapters(own, kept, ["unit"]).select("unit", "verse", "block", "similarity")


@query("select source, count(*) n, sum(n_chars) n_chars from documents group by source order by n desc, source limit 5")
def largest_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))
    return d.orderBy(F.desc("n"), "source").limit(5)
