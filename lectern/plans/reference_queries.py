"""Queries of references and citations.  Citations are made from ``orders``: book, chapter and verses follow from the keys."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lectern.operators import refs

from .registry import query, table

_BOOKS = "books(book_pos, book, volume_id, chapters) as (values " + ", ".join(f"({n}, '{b.replace(chr(39), chr(39) * 2)}', '{v}', {c})" for n, b, v, c, _ in refs.book_rows()) + ")"
#: Verses of a made chapter, so that citations can be valid or not.
_CITED = f"{_BOOKS}, o as (select o_orderkey k, o_custkey % 87 book_pos, o_orderkey % 20 page from orders), cited as (select k, page, book, volume_id, 1 + k % chapters chapter, 1 + k % 20 v from o join books using (book_pos))"


def _cited(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 87).cast("int").alias("book_pos"), (F.col("o_orderkey") % 20).alias("page"))
    return own.join(F.broadcast(refs.books(spark)), "book_pos").select("k", "page", "book", "volume_id", (1 + F.col("k") % F.col("chapters")).alias("chapter"), (1 + F.col("k") % 20).alias("v"))


def _texts(spark, sf_dir):
    """A reference string for each order: a run of verses, a single one, and a second chapter of the same book."""
    c = _cited(spark, sf_dir)
    return c.withColumn("text", F.format_string("%s %d:%d–%d, %d; 1:2", "book", "chapter", "v", F.col("v") + 2, F.col("v") + 9))


_PARSED = f"with {_CITED}, listed as (select k, page, 0 as nth, book, chapter, [v, v + 1, v + 2, v + 9] vs from cited union all select k, page, 1, book, 1, [2] from cited)"


@query(f"with {_CITED} select k, concat(v, ',', v + 1, ',', v + 2, ',', v + 9) verses from cited")
def expand_refs(spark, sf_dir):
    c = _cited(spark, sf_dir)
    spec = F.format_string("%d–%d, x, %d, 9–3", F.col("v"), F.col("v") + 2, F.col("v") + 9)
    return c.select("k", F.array_join(F.transform(refs.expand_verses(spec), lambda v: v.cast("string")), ",").alias("verses"))


def _flat(rows):
    return rows.withColumn("verses", F.array_join(F.transform("verses", lambda v: v.cast("string")), ",")).withColumn("chapter", F.col("chapter").cast("long")).withColumn("nth", F.col("at").cast("int")).drop("at")


@query(_PARSED + " select k, nth, book, chapter, array_to_string(vs, ',') verses from listed")
def parse_refs(spark, sf_dir):
    return _flat(refs.parse_citations(_texts(spark, sf_dir), "k", "text"))


@query(_PARSED + " select k, nth, book, chapter, array_to_string(vs, ',') verses from listed")
def scan_refs(spark, sf_dir):
    """The same citations found within prose."""
    prose = _texts(spark, sf_dir).withColumn("text", F.concat(F.lit("As the 12 say in ("), "text", F.lit("), 1830 edition.")))
    return _flat(refs.scan_citations(prose, "k", "text"))


_INDEX = _PARSED + ", idx as (select book, chapter, page, list(distinct v order by v) vs from (select book, chapter, page, unnest(vs) v from listed) q group by all)"


def _index(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    found = refs.scan_citations(texts, "k", "text").join(texts.select("k", "page"), "k")
    return refs.study_index(found, "page").withColumn("chapter", F.col("chapter").cast("long"))


@query(_INDEX + " select book, chapter, page, array_to_string(vs, ',') verses from idx")
def study_index(spark, sf_dir):
    return _index(spark, sf_dir).withColumn("verses", F.array_join(F.transform("verses", lambda v: v.cast("string")), ","))


@query(_INDEX + " select book, chapter, page, len(vs) n, row_number() over (partition by book, chapter order by len(vs) desc, page) rank from idx")
def mentions_ranked(spark, sf_dir):
    return refs.mentions(_index(spark, sf_dir), "page").select("book", "chapter", "page", F.size("verses").cast("long").alias("n"), "rank")


@query(_INDEX + " select book, chapter, page, vs[1] as verse, false as whole from idx")
def margin_marks(spark, sf_dir):
    return refs.margin(_index(spark, sf_dir), "page").withColumn("verse", F.col("verse").cast("long"))


@query(f"with {_CITED} select k, case k % 4 when 2 then null else book end book from cited")
def resolve_books(spark, sf_dir):
    """The book that each order spells: as it is, in capitals with a stop, not at all, with blanks about."""
    forms = F.array(F.col("book"), F.concat(F.upper("book"), F.lit(".")), F.concat(F.lit("No "), "book"), F.concat(F.lit("  "), F.replace("book", F.lit(" "), F.lit("  "))))
    raw = _cited(spark, sf_dir).select("k", F.element_at(forms, (F.col("k") % 4 + 1).cast("int")).alias("raw"))
    return refs.resolved(raw, "raw").select("k", "book")


_NAMED = "named(book_pos, book, n, aliases) as (values " + ", ".join(f"({p}, '{b.replace(chr(39), chr(39) * 2)}', '{re.sub(' +', ' ', re.sub('[&.’,]', '', re.sub('[—–-]', ' ', b.lower()))).strip().replace(chr(39), chr(39) * 2)}', [{', '.join(repr(a) for a in al)}]::varchar[])" for p, b, _, _, al in refs.book_rows()) + ")"


@query(f"""with {_CITED}, {_NAMED}, t as (select k, case k % 3 when 0 then lower(substr(book, 1, 3)) when 1 then substr(book, 1, 5) else replace(substr(book, 1, 6), ' ', '') end typed from cited),
q as (select k, typed, trim(regexp_replace(regexp_replace(regexp_replace(lower(typed), '[—–-]', ' ', 'g'), '[&.’,]', '', 'g'), ' +', ' ', 'g')) q from t),
m as (select k, book, book_pos from q, named where q <> '' and (starts_with(n, q) or starts_with(replace(n, ' ', ''), replace(q, ' ', '')) or len(list_filter(aliases, lambda a: starts_with(a, replace(q, ' ', '')))) > 0
or (contains(q, ' ') and len(string_split(q, ' ')) <= len(string_split(n, ' ')) and len(list_filter(range(1, len(string_split(q, ' ')) + 1), lambda i: not starts_with(string_split(n, ' ')[i], string_split(q, ' ')[i]))) = 0)))
select k, string_agg(book, ';' order by book_pos) books from m group by k""")
def match_books(spark, sf_dir):
    """The books that each order's first letters may mean."""
    n = F.col("k") % 3
    typed = F.when(n == 0, F.lower(F.substring("book", 1, 3))).when(n == 1, F.substring("book", 1, 5)).otherwise(F.replace(F.substring("book", 1, 6), F.lit(" "), F.lit("")))
    made = refs.meant_books(_cited(spark, sf_dir).select("k", typed.alias("typed")), "typed")
    return made.where(F.size("books") > 0).select("k", F.array_join("books", ";").alias("books"))


@query(f"with {_CITED} select k, case k % 5 when 0 then true when 1 then chapter < chapters else v + 9 <= 20 end as valid from cited join books using (book)")
def valid_refs(spark, sf_dir):
    """Whether there is the chapter, of 20 verses, and the last verse cited: chapters alone, ones past a book's last, verses."""
    k = F.col("k") % 5
    chapter = F.when(k == 1, F.col("chapter") + 1).otherwise(F.col("chapter")).cast("int")
    c = _cited(spark, sf_dir).select("k", "book", chapter.alias("chapter"), F.when(k > 1, F.col("v") + 9).alias("verse"))
    return refs.valid(c, _chapters(spark)).select("k", "valid")


def _chapters(spark):
    return refs.books(spark).select("book", F.explode(F.sequence(F.lit(1), "chapters")).alias("chapter")).withColumn("verse_count", F.lit(20))


@query(f"""with {_CITED}, d as (select book, chapter, least(count(*), 40) n from cited group by book, chapter), m as (select * from books where lower(book) like 'm%'),
c as (select book_pos, 0 as nth, book || ' 2:3' as label, book, 2 chapter, 3 verse from m where exists (select 1 from d where d.book = m.book and d.chapter = 2 and n >= 3) and chapters > 1
union all select book_pos, 1, book || ' 23', book, 23, null from m where chapters >= 23)
select label, book, chapter, verse from c order by book_pos, nth limit 8""")
def suggest_refs(spark, sf_dir):
    """What ``m 2 3`` may mean, where a chapter has as many verses as orders cite it."""
    counted = _cited(spark, sf_dir).groupBy("book", "chapter").agg(F.least(F.count(F.lit(1)), F.lit(40)).cast("int").alias("verse_count"))
    return refs.suggestions(refs.books(spark), counted, "m 2 3")


@query(_PARSED + ", w as (select k, nth, unnest(vs) verse from listed) select k, nth, verse from w where verse <= 20 qualify row_number() over (partition by k, nth order by verse) <= 2")
def passages(spark, sf_dir):
    """The first two of the verses that each citation names and its chapter has."""
    verses = _chapters(spark).select("book", "chapter", F.explode(F.sequence(F.lit(1), "verse_count")).alias("verse"))
    found = refs.parse_citations(_texts(spark, sf_dir), "k", "text")
    return refs.passages(found, F.broadcast(verses), ["k", "at"], 2).select("k", F.col("at").cast("int").alias("nth"), F.col("verse").cast("long").alias("verse"))
