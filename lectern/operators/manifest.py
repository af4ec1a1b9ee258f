"""The manifest of written pages: one table of pages, and for each chapter the numbers of the pages that treat it, with the verses each names.

A page that treats forty chapters is written once; chapters hold numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .joins import numbered
from .refs import scan_citations, study_index


def chart_lines(chart: DataFrame) -> DataFrame:
    """What a chart is indexed by: the lines of its cells, not its introduction.  slug, pos, line."""
    return _listed(chart, F.flatten(F.flatten(F.flatten("parts.rows"))))


def evidence_lines(evidence: DataFrame) -> DataFrame:
    """References of items, and titles and references of groups: slug, pos, line."""
    refs = lambda items: F.transform(items, lambda i: i["ref"])
    groups = lambda f: F.flatten(F.transform(f["groups"], lambda g: F.concat(F.array(g["title"]), refs(g["items"]))))
    return _listed(evidence, F.flatten(F.transform("forms", lambda f: F.concat(refs(f["items"]), groups(f)))))


def essay_lines(essay: DataFrame) -> DataFrame:
    """All prose: texts, quotes, and what they are made of with their sources.  slug, pos, line."""
    pieces = lambda b: F.flatten(F.transform(b["parts"], lambda q: F.filter(F.array(q["text"], q["source"]), lambda s: s != "")))
    return _listed(essay, F.flatten(F.transform("parts", lambda p: F.flatten(F.transform(p["blocks"], lambda b: F.concat(F.array(b["text"]), pieces(b)))))))


def _listed(pages: DataFrame, lines: Column) -> DataFrame:
    return pages.select("slug", F.posexplode(lines).alias("pos", "line"))


def write_manifest(pages: DataFrame, lines: DataFrame, path: str) -> None:
    """Write ``pages`` (section, kind, title, volume_id) and the chapters that their ``lines`` (section, line) cite.

    Pages without a volume are left out.  Verses of a page and chapter are
    distinct and in order; a chapter that is cited as a whole has none.  Pages
    are numbered by section; a chapter's entries are arrays of the page's number
    and the verses, in order of pages.
    """
    spark = pages.sparkSession
    numbered(pages.where("volume_id is not null").select("section", "kind", "title", "volume_id"), ["section"], "page").write.mode("overwrite").parquet(f"{path}/pages")
    table = spark.read.parquet(f"{path}/pages").select("section", F.col("page").cast("int").alias("page"))
    found = scan_citations(lines.groupBy("section", "line").agg(F.count(F.lit(1)).alias("n")).select(F.struct("section", "line").alias("id"), "line"), "id", "line").withColumn("section", F.col("id.section"))
    study = study_index(found, "section").join(table, "section")
    entry = F.concat(F.array("page"), F.col("verses"))
    key = F.concat_ws("|", F.lower("book"), F.col("chapter").cast("string"))
    study.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(entry)).alias("entries")).write.mode("overwrite").parquet(f"{path}/at")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/pages")


def read_study(spark: SparkSession, path: str, book: str | None = None, chapter: int | None = None) -> DataFrame:
    """Pages that treat each chapter, or the one that is named: book (lower case), chapter, page, verses, section, kind, title, volume_id."""
    at = spark.read.parquet(f"{path}/at")
    if book is not None:
        at = at.where(F.col("key") == f"{book.lower()}|{chapter}")
    each = at.select(F.substring_index("key", "|", 1).alias("book"), F.substring_index("key", "|", -1).cast("int").alias("chapter"), F.explode("entries").alias("e"))
    told = each.select("book", "chapter", F.col("e")[0].alias("page"), F.slice("e", F.lit(2), F.size("e")).alias("verses"))
    return told.join(read_pages(spark, path).withColumn("page", F.col("page").cast("int")), "page")
