"""Queries of the way from scanned pages to an edition.

Scans are made of the documents: a source is a volume, a document a chapter, a
line a verse of the guide.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import scan
from lectern.operators.joins import numbered
from lectern.sources.corpus import document_verses

from .registry import query, table
from .search_queries import LINES

_PAGE = LINES + ", x as (select unit, verse, 'and ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), '^ | $', '', 'g')) t from verses), y as (select unit, verse, trim(t) t from x)"


@query(f"with {_PAGE} select unit, cast(row_number() over (partition by unit order by verse) - 1 as int) block, cast(verse % 900 + 1 as int) number, md5(t) said from y")
def scan_blocks(spark, sf_dir):
    """Pages on which every verse is broken within a word, by a footnote of two lines and a page's turn, or by a running head."""
    verses = document_verses(table(spark, sf_dir, "documents"))
    plain = F.trim(F.concat(F.lit("and "), F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))))
    own = verses.select("unit", "verse", plain.alias("t")).withColumn("half", F.floor(F.length("t") / 2).cast("int"))
    head, tail = F.substr("t", F.lit(1), F.col("half")), F.substr("t", F.col("half") + 1)
    within = F.substr("t", F.col("half"), F.lit(2)).rlike("^[a-z]{2}$") & (F.col("half") > 0)
    number = (F.col("verse") % 900 + 1).cast("string")
    first = F.concat(number, F.when(F.col("verse") % 2 == 0, " . ").otherwise(". "))
    note = F.when(F.col("verse") % 3 == 0, F.array(F.lit("a, 1 Ne. 3: 7"), F.lit("among whom there is a mixture"), F.lit("  17 "))).otherwise(F.array(F.lit(""), F.lit("MOSIAH, 4.")))
    page = F.when(within, F.concat(F.array(F.concat(first, head, F.lit("-"))), note, F.array(F.concat(F.lit(" "), tail)))).otherwise(F.concat(F.array(F.concat(first, F.col("t"))), note))
    lines = own.select(F.col("unit").alias("file"), "verse", F.posexplode(page).alias("at", "line")).select("file", (F.col("verse") * 8 + F.col("at")).alias("line_no"), "line")
    return scan.scan_blocks(lines).select(F.col("file").alias("unit"), "block", "number", F.md5("text").alias("said"))


def _scanned(spark, sf_dir):
    """A guide of all documents, and blocks in which verses and whole chapters are lost, doubled, or spoiled."""
    verses = document_verses(table(spark, sf_dir, "documents")).where("book is not null and unit is not null")
    guide = verses.select(F.col("book").alias("volume"), F.col("unit").alias("chapter"), "verse", "text")
    spoiled = F.when(F.col("verse") % 3 == 0, F.regexp_replace("text", r"^(\S+\s+)\S+", "$1smudge")).when(F.col("verse") % 4 == 1, F.regexp_replace("text", r"^(\S+ )", "$1 2k, 1 Ne. 2. 88: b. ")).otherwise(F.col("text"))
    times = F.when((F.col("chapter") % 11 == 5) | (F.col("verse") % 7 == 4), 0).when(F.col("verse") % 5 == 2, 2).otherwise(1)
    kept = guide.select("volume", "chapter", "verse", spoiled.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("one"))
    flat = numbered(kept.drop("one"), ["volume", "chapter", "verse"], "nth")
    first = flat.groupBy("volume").agg(F.min("nth").alias("first"))
    return guide, flat.join(first, "volume").select("volume", (F.col("nth") - F.col("first")).alias("block"), "text")


@query()
def scan_places(spark, sf_dir):
    """The block at each verse of every source, by one cursor over each."""
    return scan.place(*_scanned(spark, sf_dir))


@query()
def scan_report(spark, sf_dir):
    """What the edition of each source holds, lacks, and how like its guide it is."""
    guide, blocks = _scanned(spark, sf_dir)
    return scan.edition_report(guide, scan.edition(guide, blocks, sections=True))
