"""Written pages: one list of several shelves, their titles and order, and the list of suggestions for what was typed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lectern.sources.stored import staged

from .joins import numbered

#: Place of a page that names none.
LAST = 999


def shelf(parts: dict[str, DataFrame]) -> DataFrame:
    """Pages (slug, title, subtitle, volume_id) of several kinds as one table with ``kind`` and ``section``, its shelf and slug.

    ``parts`` maps ``kind:shelf`` to pages; pages without a volume are left out.
    """
    made = []
    for name, pages in parts.items():
        kind, on = name.split(":")
        made.append(pages.select(F.lit(kind).alias("kind"), "slug", "title", "subtitle", "volume_id", F.concat(F.lit(f"{on}/"), "slug").alias("section")))
    return reduce(DataFrame.unionByName, made).where("volume_id is not null")


def in_order(pages: DataFrame, order: str = "order") -> DataFrame:
    """Pages with their place ``nth`` on their shelf: by ``order``, none last, then by title and slug."""
    own = staged(numbered(pages.withColumn("__order", F.coalesce(order, F.lit(LAST))), ["kind", "__order", "title", "slug"], "__n"), "shelves")
    first = own.groupBy("kind").agg(F.min("__n").alias("__first"))
    return own.join(F.broadcast(first), "kind").withColumn("nth", F.col("__n") - F.col("__first") + 1).select(*[F.col(f"`{c}`") for c in pages.columns], "nth")  # a kind is a shelf


def page_titles(sections: DataFrame, pages: DataFrame, shelves: dict[str, list[str]]) -> DataFrame:
    """``sections`` (section) with the title of the page they name: of the shelf's kinds the first that has the slug, else null."""
    named = sections.withColumn("__shelf", F.substring_index("section", "/", 1)).withColumn("__slug", F.expr("if(locate('/', section) > 0, substring(section, locate('/', section) + 1), null)"))
    title = F.lit(None).cast("string")
    for on, kinds in shelves.items():
        found = []
        for n, kind in enumerate(kinds):
            mine = pages.where(F.col("kind") == kind).groupBy(F.col("slug").alias("__slug")).agg(F.min("title").alias(f"__{on}{n}"))
            named = named.join(mine, "__slug", "left")
            found.append(F.col(f"__{on}{n}"))
        title = F.when(F.col("__shelf") == on, F.coalesce(*found)).otherwise(title)
    return named.select(*[F.col(f"`{c}`") for c in sections.columns], title.alias("title"))


def cited_pages(study: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of a study index with kind, title and section of their page (page_id)."""
    return study.join(pages.select("page_id", "kind", "title", "section"), "page_id")


def rows_of(parts: Column) -> Column:
    """Rows of a chart's parts (array of structs with ``rows``), all together; none without parts."""
    return F.coalesce(F.aggregate(parts, F.lit(0), lambda n, p: n + F.coalesce(F.size(p["rows"]), F.lit(0))), F.lit(0))


def suggestions(typed: str, refs: DataFrame, articles: DataFrame, completes: DataFrame, on_page: int = 0, recents: DataFrame | None = None) -> DataFrame:
    """What is offered for a typed text, in order: tier, nth, kind, label, count.

    References (label, nth), strong articles (title, strong, nth), the page's own
    hits if it has any, the search itself, weak articles, completions (word, nth).
    Nothing typed: the recent texts (label, nth) alone.
    """
    spark = refs.sparkSession
    typed = typed.strip()
    row = lambda df, tier, kind, label: df.select(F.lit(tier).alias("tier"), F.col("nth").cast("int").alias("nth"), F.lit(kind).alias("kind"), F.col(label).alias("label"), F.lit(None).cast("int").alias("count"))
    kinds = "tier int, nth int, kind string, label string, count int"
    if not typed:
        return row(recents, 0, "recent", "label") if recents is not None else spark.createDataFrame([], kinds)
    own = [(3, 1, "page", typed, on_page)] * (on_page > 0) + [(4, 1, "search", typed, None)]
    tiers = [row(refs, 1, "ref", "label"), row(articles.where("strong"), 2, "article", "title"), spark.createDataFrame(own, kinds), row(articles.where(~F.col("strong")), 5, "article", "title"), row(completes, 6, "complete", "word")]
    return reduce(DataFrame.unionByName, tiers)
