"""Queries of tables in markdown, shelves of works and figures: pages are written from the tables at hand and read back.

Each order, or part, writes a few lines of its page; a page has all that headings
and rows can do: headings that come again, rows that are said twice, rows of no use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lectern.operators.joins import upto
from lectern.sources import markdown, records

from .registry import query, table


def _written(rows: DataFrame, file, at, *lines) -> DataFrame:
    """Pages (file, line_no, line) of rows that each give some lines, in the order of ``at``; a null line is left out.

    A page's lines are numbered by ranges of its rows: no row or task holds a page.
    """
    each = rows.select(file.alias("file"), at.alias("at"), F.filter(F.array(*lines), lambda x: x.isNotNull()).alias("lines"))
    ended = upto(each, "file", ["at"], sums={"end": F.size("lines")})
    return ended.select("file", (F.col("end") - F.size("lines")).alias("first"), F.posexplode("lines").alias("nth", "line")).select("file", (F.col("first") + F.col("nth")).cast("int").alias("line_no"), "line")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("b"), F.col("o_orderpriority").alias("p"))


_SECTIONS = "s as (select o_orderkey k, o_custkey b, o_orderkey % 3 f from orders)"


@query(f"""with {_SECTIONS}, l as (select b, f, max(k) k from s where k % 4 <> 0 group by 1, 2),
r as (select b, f, k % 5 + 1 chapter, 'first ' || k caption, case when k % 7 <> 0 then 'S' || k % 7 end section from l union all select b, f, k % 5 + 2, 'bare ' || k, null from l)
select 'book ' || b book, cast(chapter as int) chapter, caption, section from r qualify row_number() over (partition by b, chapter order by f desc) = 1""")
def caption_rows(spark, sf_dir):
    """Captions of three files: a book's last table counts in each, a heading without rows is none."""
    k, b = F.col("k"), F.col("b")
    has = lambda line: F.when(k % 4 != 0, line)
    pages = _written(
        _orders(spark, sf_dir), _text((k % 3).cast("string"), ".md"), k, _text("## Book ", b), F.lit("| Ch | Caption | Section |"), F.lit("|---|---|---|"),
        has(_text("| ", k % 5 + 1, " | said before | |")), has(_text("| ", k % 5 + 1, " | first ", k, " | ", F.when(k % 7 != 0, _text("S", k % 7)).otherwise(""), " |")), has(_text(k % 5 + 2, " | bare ", k)), F.lit("no row 5"),
    )
    return markdown.captions(pages).select("book", "chapter", "caption", "section")


@query(f"""with {_SECTIONS}, l as (select b, f, max(k) k from s group by 1, 2), r as (select *, k % 5 + 1 a, k % 3 n from l where k % 4 <> 0)
select f || '.md' file, 'book ' || b book, cast(chapter as int) chapter, case when chapter = a + n then 'd. ' || k else 'c. ' || k end date_label from (select *, unnest(generate_series(a, a + n)) chapter from r) q""")
def date_rows(spark, sf_dir):
    """Dates of runs of chapters, the last chapter dated again; a heading that comes again begins its book anew, be there rows or not."""
    k, b = F.col("k"), F.col("b")
    a, last = k % 5 + 1, k % 5 + 1 + k % 3
    has = lambda line: F.when(k % 4 != 0, line)
    dash = F.when(k % 2 == 0, "–").otherwise(" — ")
    pages = _written(
        _orders(spark, sf_dir), _text((k % 3).cast("string"), ".md"), k, _text("## Book ", b), has(_text("| ", a, dash, last, " | c. ", k, " |")), has(_text("| ", last, " | d. ", k)),
        F.lit("| 2 and 5 | no run |"), F.lit("| 9–7 | backwards |"), F.lit("| 8 | |"),
    )
    return markdown.dates(pages).select("file", "book", "chapter", "date_label")


_VOICES = "v as (select o_orderkey k, o_orderkey % 3 f, case when o_orderkey % 2 = 0 then 'group ' || o_custkey % 5 else 'omni' end book, o_orderkey % 50 chapter, o_orderpriority voice, row_number() over (partition by o_orderkey % 3 order by o_orderkey) nth from orders)"


def _voices(spark, sf_dir):
    k = F.col("k")
    left = F.when(k % 2 == 0, (k % 50).cast("string")).otherwise(_text("Omni ", k % 50))
    o = _orders(spark, sf_dir)
    rows = o.select("k", "b", "p").unionByName(spark.range(3).select((F.col("id") + 3 * (1 << 60)).alias("k"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("p")))
    end = F.col("p").isNull()
    return _written(
        rows, _text((k % 3).cast("string"), ".md"), k, F.when(end, "## Judgment calls").otherwise(_text("## Group ", F.col("b") % 5)), F.when(end, "| 1 | none |").otherwise(_text("| ", left, " | ", F.col("p"), " |")),
        _text("| Omni", k % 50, " | unparted |"), F.lit("| Chapter | Voice |"), F.lit("| 5 | |"),
    )


@query(f"with {_VOICES} select f || '.md' file, book, cast(chapter as int) chapter, voice from v qualify row_number() over (partition by f, book, chapter order by k desc) = 1")
def voice_rows(spark, sf_dir):
    """Voices by the heading's book or their own; the last row of a chapter counts, none after the judgment calls."""
    return markdown.voices(_voices(spark, sf_dir)).select("file", "book", "chapter", "voice")


@query(f"with {_VOICES} select f || '.md' file, voice, cast(5 * (min(nth) - 1) + 1 as int) pos from v group by 1, 2")
def voice_order(spark, sf_dir):
    return markdown.voices_in_order(_voices(spark, sf_dir)).select("file", "voice", "pos")


@query(f"""with {_SECTIONS}, l as (select b, f, max(k) k from s group by 1, 2), r as (select f, b, k, k % 9 chapter, k % 7 c from l union all select f, b, k, k % 9, (k + 1) % 7 from l)
select f || '.md' file, 'book ' || b book, cast(chapter as int) chapter, r_name as name, r_regionkey from r join region on r_regionkey = c""")
def category_rows(spark, sf_dir):
    """Two categories for each chapter, regions by their keys; some are unknown."""
    k, b = F.col("k"), F.col("b")
    known = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name"))
    spelled = known.select(F.col("r_regionkey").alias("__c"), F.regexp_replace(F.lower("name"), " ", " - ").alias("spelled"))
    o = _orders(spark, sf_dir)
    for into, c in (("one", k % 7), ("two", (k + 1) % 7)):
        o = o.join(F.broadcast(spelled.withColumnRenamed("spelled", into)), c == F.col("__c"), "left").drop("__c")
    row = lambda name: _text("| ", k % 9, " | ", F.coalesce(name, F.lit("Unknown")), " |")
    pages = _written(o, _text((k % 3).cast("string"), ".md"), k, _text("## Book ", b), F.lit("| Chapter | Category |"), row(F.col("one")), row(F.col("two")), F.lit("| Asia 3 | asia |"))
    return markdown.categories(pages, known).select("file", "book", "chapter", "name", "r_regionkey")


@query("""with r as (select o_orderkey k, o_orderkey % 3 f, case o_orderkey % 4 when 0 then 'alma' when 1 then 'doctrine and covenants' when 2 then '1 nephi' else 'nowhere ' || o_custkey % 7 end book, o_custkey % 90 + 1 a, o_orderkey % 3 n from orders)
select book, cast(chapter as int) chapter, 'Mark ' || k || '; x,Luke ' || a labels from (select *, unnest(generate_series(a, a + n)) chapter from r) q qualify row_number() over (partition by book, chapter order by f desc, k desc) = 1""")
def related_rows(spark, sf_dir):
    """Parallels of runs of chapters, books spelled in some ways or unknown; later rows and files win."""
    k, a = F.col("k"), F.col("b") % 90 + 1
    book = F.when(k % 4 == 0, "ALMA").when(k % 4 == 1, "D&C").when(k % 4 == 2, "1 Ne.").otherwise(_text("Nowhere ", F.col("b") % 7))
    pages = _written(
        _orders(spark, sf_dir), _text((k % 3).cast("string"), ".md"), k, _text("  | **", book, " ", a, F.when(k % 3 == 0, "").otherwise(_text("–", a + k % 3)), "** | Mark ", k, "; x ·· Luke ", a, " | "),
        _text("| ", book, " ", a, " | not bold |"), F.lit("| **Alma** | no chapter |"), F.lit("| **Alma 5** | · |"),
    )
    return markdown.related(pages).select("book", "chapter", F.array_join("labels", ",").alias("labels"))


@query("""with w as (select p_brand slug, p_type t, p_partkey k, p_name || ' ' || p_partkey || '/' || p_brand || '/' || p_size || '/' || case when p_partkey % 3 = 0 then 'c' || p_partkey || '.jpg' else '' end || '/' || 'Two>http2' || case when p_partkey % 2 = 0 then '+Shop>http' || p_partkey else '' end || '/' || 'A work of ' || p_size || ' pages. * hue: kept' work from part where p_size <> 1)
select slug, t title, string_agg(work, ';' order by k) works from w group by 1, 2""")
def resource_shelves(spark, sf_dir):
    """Parts as works: brands are files, types shelves; parts of size 1 stand before any work of an empty shelf."""
    k, n = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    work = lambda line: F.when(n != 1, line)
    first = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")) == 1
    shelved = part.where(n != 1).withColumn("opens", first).unionByName(part.where(n == 1).withColumn("opens", F.lit(True)).withColumn("p_type", F.lit("~ empty")))
    pages = _written(
        shelved, _text(F.col("p_brand"), ".md"), F.struct("p_type", "p_partkey"), F.when(F.col("opens"), _text("## ", F.col("p_type"))), F.when(n == 1, "lost words"), work(_text("### ", F.col("p_name"), " ", k)), work(F.lit("* author: nobody")),
        work(_text("* Author: ", F.col("p_brand"))), work(_text("* detail: ", n)), F.when(k % 3 == 0, _text("* cover: c", k, ".jpg")), work(F.lit("* link: Two | http2 | more")), work(F.lit("* link: broken |")),
        F.when(k % 2 == 0, _text("* link: Shop | http", k)), F.lit(""), work(F.lit("A work of")), work(_text(n, " pages.")), work(F.lit("* hue: kept")),
    )
    links = lambda w: F.array_join(F.transform(w["links"], lambda x: F.concat(x["label"], F.lit(">"), x["href"])), "+")
    told = lambda w: F.concat_ws("/", w["title"], w["author"], w["detail"], w["cover"], links(w), w["body"])
    return records.resources(pages).select("slug", F.inline("shelves")).select("slug", "title", F.array_join(F.transform("works", told), ";").alias("works"))


@query("""with f as (select o_orderkey k, o_custkey % 7 f, o_orderpriority p, row_number() over (partition by o_custkey % 7 order by o_orderkey) nth from orders)
select f || '.md' file, nth, cast(1800 + k % 90 as int) as year, p as name, (1700 + k % 90) || '–' as years, case when k % 2 = 0 then 'role ' || k else '' end as role, 'Came in ' || k || chr(10) || chr(10) || '## and went' body from f where k % 5 <> 0 and k % 7 <> 1""")
def figure_records(spark, sf_dir):
    """Orders as figures; every fifth heading has no year, and some figures no body."""
    k = F.col("k")
    body = lambda line: F.when(k % 7 != 1, line)
    pages = _written(
        _orders(spark, sf_dir), _text((F.col("b") % 7).cast("string"), ".md"), k, F.when(k % 5 == 0, "# Those who came").otherwise(_text("# ", 1800 + k % 90, F.when(k % 2 == 0, " · ").otherwise(" - "), F.col("p"))),
        _text("* Years: ", 1700 + k % 90, "–"), F.when(k % 2 == 0, _text("* role: role ", k)), F.lit(""), body(_text("Came in ", k)), body(F.lit("  ")), F.lit("---"), body(F.lit("## and went")), F.lit(""),
    )
    return records.figures(pages).select("file", F.col("nth").cast("long").alias("nth"), "year", "name", "years", "role", "body")
