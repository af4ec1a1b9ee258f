"""Word spans of verses: segments, footnote letters, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def segments(verses: DataFrame, marks: DataFrame) -> DataFrame:
    """Runs of words under the same marks: unit, verse, seg, text, ids.

    ``marks`` are (unit, verse, w1, w2, id), words counted from 1, both ends
    inclusive.  Blanks go with the word before them, so that a verse's segments
    joined give its text.
    """
    key = ["unit", "verse"]
    held = marks.where("w1 is not null").groupBy(*key).agg(F.collect_set(F.struct("w1", F.greatest("w1", "w2").alias("w2"), "id")).alias("marks"))
    # A verse is cut within its row: its words never stand in rows of their own.
    told = verses.select(*key, "text").join(held, key, "left").select(*key, F.regexp_extract_all("text", F.lit(r"^\s+|\S+\s*"), F.lit(0)).alias("pieces"), "marks")
    blank = F.coalesce(F.get("pieces", F.lit(0)).rlike(r"^\s"), F.lit(False)).cast("int")
    n = F.size("pieces")
    told = told.where(n > 0).withColumn("w", F.sequence(1 - blank, n - blank))
    over = lambda w: F.array_sort(F.array_distinct(F.array_compact(F.transform(F.filter("marks", lambda m: (m["w1"] <= w) & (m["w2"] >= w)), lambda m: m["id"]))))
    none = F.array().cast(f"array<{dict(marks.dtypes)['id']}>")
    told = told.withColumn("ids", F.transform("w", lambda w: F.coalesce(over(w), none)))
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("ids", i) != F.get("ids", i - 1)))
    told = told.withColumn("from", F.concat(first, F.array(n)))
    runs = told.select(*key, "pieces", "ids", "from", F.posexplode(F.slice("from", F.lit(1), F.size("from") - 1)).alias("at", "lo"))
    text = F.array_join(F.slice("pieces", F.col("lo") + 1, F.get("from", F.col("at") + 1) - F.col("lo")), "")
    return runs.select(*key, (F.col("at") + 1).cast("long").alias("seg"), text.alias("text"), F.get("ids", F.col("lo")).alias("ids"))


def letters(marks: DataFrame, order: str) -> DataFrame:
    """Marks with their letter: the verse and a, b, … in file order within it."""
    nth = F.row_number().over(Window.partitionBy("unit", "verse").orderBy(order))
    return marks.withColumn("letter", F.concat(F.col("verse").cast("string"), F.char(96 + nth)))


def by_scope(entries: DataFrame, scope: str) -> DataFrame:
    """Entries gathered by scope, in order of verse and first word."""
    return entries.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("verse", "w1", "id"))).alias("entries"))


def commentary(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and their targets of nested commentary documents (meta, entries)."""
    entries = docs.select(F.col("meta.book").alias("book"), F.col("meta.chapter").alias("chapter"), F.inline("entries"))
    flat = entries.select("book", "chapter", "id", "scope", "head", "reason", "anchor.*")
    targets = entries.select("id", F.inline("targets"))
    return flat, targets


def markers(entries: DataFrame) -> DataFrame:
    """One marker for each anchored span, with the ids that share it."""
    return entries.where("verse is not null").groupBy("verse", "w1", "w2").agg(F.first("quote").alias("quote"), F.sort_array(F.collect_list("id")).alias("entries")).orderBy("verse", "w1")


def chapter_files(files: DataFrame, chapters: DataFrame) -> DataFrame:
    """The file that holds each chapter (book, chapter), by its name: book, chapter, file, the first by name.

    A name is a book, a dash and a number (``alma-34.json``), perhaps after an
    order (``09-``, ``09_``), with leading zeros, and before a note that begins
    with a separator (``-notes``).  Dashes within a book's name count for nothing.
    A name is read in every way it can be; readings are joined to the chapters.
    """
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    names = F.array_distinct(F.array(stem, F.regexp_replace(stem, r"^\d+[-_]", "")))
    parts = files.select("file", F.explode(names).alias("name")).select("file", F.split("name", "-", -1).alias("p"))
    spots = parts.select("file", "p", F.posexplode("p").alias("at", "token")).where(F.col("at") > 0).where(F.col("token").rlike(r"^\d+(_.*)?$"))
    read = spots.select("file", F.array_join(F.slice("p", F.lit(1), F.col("at")), "").alias("key"), F.regexp_extract("token", r"^(\d+)", 1).try_cast("int").alias("chapter"))
    known = chapters.select("book", "chapter", F.regexp_replace(F.lower("book"), "[^a-z0-9]+", "").alias("key"))
    return known.join(read, ["key", "chapter"]).groupBy("book", "chapter").agg(F.min("file").alias("file"))
