"""Chapter dimensions: captions, sections, dates, runs and bands in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.sources.stored import staged

from .joins import carried, numbered, running

#: Chapters that close a band, and books that may share one.
COLS, SHARED = 3, 3


def stops(units: DataFrame, captions: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Units (volume_id, book, book_pos, chapter) with caption, section and date, and what each opens.

    Books without any caption have no stops; chapters without one stay.  A section
    opens where it differs from the last one named, across books.
    """
    known = units.join(captions.select("book").distinct(), "book", "left_semi").join(captions, ["book", "chapter"], "left")
    if dates is not None:
        known = known.join(dates, ["book", "chapter"], "left")
    first = known.groupBy("volume_id", "book_pos").agg(F.min("chapter").alias("__first"))
    told = carried(known, "volume_id", ["book_pos", "chapter"], "section", "__last").alias("k").join(first.alias("f"), F.expr("k.volume_id <=> f.volume_id and k.book_pos <=> f.book_pos"))
    own = [F.col(f"k.`{c}`") for c in known.columns]
    return told.select(*own, (F.col("section").isNotNull() & ~F.col("section").eqNullSafe(F.col("__last"))).alias("opens_section"), (F.col("chapter") == F.col("__first")).alias("opens_book"))


def runs(stop_rows: DataFrame) -> DataFrame:
    """Runs of stops between openings: volume_id, book, run, first and last chapter, stops, section, head date."""
    told = running(stop_rows, "volume_id", ["book_pos", "chapter"], (F.col("opens_section") | F.col("opens_book")).cast("int"), "run")
    head = [F.min_by("date_label", "chapter").alias("date_label")] if "date_label" in stop_rows.columns else []
    return told.groupBy("volume_id", "run").agg(F.first("book").alias("book"), F.min("chapter").alias("first"), F.max("chapter").alias("last"), F.count(F.lit(1)).alias("stops"), F.min_by("section", "chapter").alias("section"), *head)


def bands(book_sizes: DataFrame) -> DataFrame:
    """Books (volume_id, book_pos, book, n) in bands: one of ``COLS`` chapters or more ends the band before it and stands alone, smaller ones share.

    A fold over the few books of a volume, inside an aggregate expression.
    """
    listed = book_sizes.groupBy("volume_id").agg(F.sort_array(F.collect_list(F.struct("book_pos", "book", "n"))).alias("b"))
    start = F.struct(F.lit(-1).alias("band"), F.lit(SHARED).alias("held"), F.array().cast("array<struct<book:string,band:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        alone = x["n"] >= COLS
        fresh = alone | (s["held"] >= SHARED)
        band = s["band"] + fresh.cast("int")
        held = F.when(alone, SHARED).when(fresh, 1).otherwise(s["held"] + 1)
        return F.struct(band.alias("band"), held.alias("held"), F.concat(s["out"], F.array(F.struct(x["book"].alias("book"), band.alias("band")))).alias("out"))

    return listed.select("volume_id", F.inline(F.aggregate("b", start, step)["out"]))


def span_label(first: Column, last: Column) -> Column:
    """Start of the first date to the end of the last: ``c. 600–592 B.C.`` and ``A.D. 1–4`` give ``c. 600–4``.

    Equal dates are given whole; what follows `` · `` in a date is left out; a
    date is cut at an en or em dash.
    """
    date = lambda c: F.split(c, " · ")[0]
    opens, closes = F.trim(F.split(date(first), "[–—]")[0]), F.trim(F.element_at(F.split(date(last), "[–—]"), -1))
    return F.when(date(first) == date(last), date(first)).otherwise(F.concat_ws("–", opens, closes))


def neighbours(units: DataFrame) -> DataFrame:
    """Each unit with the one before and after it in reading order; null at a volume's ends."""
    own = numbers = staged(numbered(units, ["volume_id", "book", "unit"], "__n"), "neighbours")
    for into, step in (("previous", 1), ("next", -1)):
        other = numbers.select(F.col("volume_id").alias("__v"), (F.col("__n") + step).alias("__m"), F.col("unit").alias(into))
        own = own.join(other, F.col("volume_id").eqNullSafe(F.col("__v")) & (F.col("__n") == F.col("__m")), "left").drop("__v", "__m")
    return own.drop("__n")


def range_explode(rows: DataFrame, spec: str, into: str = "chapter") -> DataFrame:
    """A row for each number of ``2–3``; what is no number or runs backwards gives none."""
    lo, hi = F.regexp_extract(spec, r"^\s*(\d+)", 1).try_cast("int"), F.regexp_extract(spec, r"(\d+)\s*$", 1).try_cast("int")
    return rows.where(lo <= hi).withColumn(into, F.explode(F.sequence(lo, hi)))


def backfill(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Nulls of ``value`` take the next one that follows."""
    ahead = Window.partitionBy(*key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(value, F.first(value, True).over(ahead))


def merged(first: DataFrame, later: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both tables; for equal keys the later table's."""
    return first.join(later.select(*key), key, "left_anti").unionByName(later)


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order they are first seen."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("pos")).orderBy("pos")


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that match every given value; None asks for nothing, an empty list likewise."""
    for c, v in wanted.items():
        if isinstance(v, (list, tuple, set)):
            rows = rows.where(F.col(c).isin(*v)) if v else rows
        elif v is not None:
            rows = rows.where(F.col(c) == v)
    return rows


def year_changes(rows: DataFrame, thread: str, order: str, year: str) -> DataFrame:
    """Figures of each thread in order, with ``opens``: whether the year is another than that of the figure before."""
    before = F.lag(year).over(Window.partitionBy(thread).orderBy(order))
    return rows.withColumn("opens", ~F.col(year).eqNullSafe(before))


def year_span(rows: DataFrame, thread: str, order: str, year: str) -> DataFrame:
    """First and last year of each thread, as its order has them: thread, span."""
    ends = rows.groupBy(thread).agg(F.min_by(year, order).cast("string").alias("a"), F.max_by(year, order).cast("string").alias("b"))
    return ends.select(thread, F.concat_ws("–", "a", "b").alias("span"))


def summary(units: DataFrame, own: DataFrame, bundled: DataFrame, volume: str) -> DataFrame:
    """Units (volume_id, book, chapter) with the summary (book, chapter, text) that is one's own, else in one volume the bundled one; empty texts are none."""
    some = lambda df, into: df.where("text <> ''").groupBy("book", "chapter").agg(F.min("text").alias(into))
    both = units.join(some(own, "mine"), ["book", "chapter"], "left").join(some(bundled, "theirs"), ["book", "chapter"], "left")
    return both.withColumn("text", F.coalesce("mine", F.when(F.col("volume_id") == volume, F.col("theirs")))).drop("mine", "theirs")
