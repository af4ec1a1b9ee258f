"""Readers that turn documents or volume files into the tables the operators take.

The canonical table is ``verses(volume_id, book, unit, verse, text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lectern.operators.joins import numbered

_VERSES = "array<struct<verse:int,reference:string,text:string>>"
BOOKS_LAYOUT = f"books array<struct<book:string,full_title:string,heading:string,chapters:array<struct<chapter:int,reference:string,verses:{_VERSES}>>>>, title string, subtitle string, sections array<struct<section:int,reference:string,verses:{_VERSES}>>"


def document_verses(docs: DataFrame) -> DataFrame:
    """Lines of documents as verses: volume is the language, book the source, unit the doc_id; null texts have none."""
    return docs.select(F.col("lang").alias("volume_id"), F.col("source").alias("book"), F.col("doc_id").alias("unit"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).select("volume_id", "book", "unit", (F.col("at") + 1).alias("verse"), "text")


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Volume JSON files of either layout as (file, book, chapter, verse, reference, text)."""
    raw = spark.read.schema(BOOKS_LAYOUT).option("multiLine", True).json(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.json$", 1))
    books = raw.select("file", F.inline("books")).select("file", "book", F.inline("chapters")).select("file", "book", "chapter", F.inline("verses"))
    sections = raw.select("file", F.inline("sections")).select("file", F.lit("Sections").alias("book"), F.col("section").alias("chapter"), F.inline("verses"))
    return books.unionByName(sections)


def write_volumes(verses: DataFrame, path: str) -> None:
    """Verses (book, chapter, verse, reference, text) as volume JSON of the books layout, one file per volume."""
    chapters = verses.groupBy("file", "book", "chapter").agg(F.sort_array(F.collect_list(F.struct("verse", "reference", "text"))).alias("verses"))
    books = chapters.groupBy("file", "book").agg(F.sort_array(F.collect_list(F.struct("chapter", F.concat_ws(" ", "book", F.col("chapter").cast("string")).alias("reference"), "verses"))).alias("chapters"))
    books.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("book", "chapters"))).alias("books")).write.mode("overwrite").partitionBy("file").json(path)


def verse_counts(books: DataFrame) -> DataFrame:
    """Books (book, counts as ``31,25,24``) as chapters: book, chapter, verse_count."""
    each = books.select("book", F.posexplode(F.split("counts", ",")).alias("at", "n"))
    return each.select("book", (F.col("at") + 1).alias("chapter"), F.trim("n").try_cast("int").alias("verse_count"))


_SUMMARIES = "label string, summaries map<string,map<string,string>>"


def write_summaries(summaries: DataFrame, path: str, label: str = "Chapter summary") -> None:
    """Summaries (book, chapter, text) as JSON documents of (label, summaries by book and chapter), one for each book."""
    chapters = summaries.groupBy("book").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("chapter").cast("string"), "text")))).alias("m"))
    chapters.select(F.lit(label).alias("label"), F.create_map("book", "m").alias("summaries")).write.mode("overwrite").json(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of JSON documents with any number of books: label, book, chapter (as text), text."""
    raw = spark.read.schema(_SUMMARIES).json(path)
    return raw.select("label", F.explode("summaries").alias("book", "m")).select("label", "book", F.explode("m").alias("chapter", "text"))


def write_gaps(gaps: DataFrame, path: str, note: str) -> None:
    """References (volume, reference, pos) that nothing was placed at, as JSON documents of (note, volume, verses), one for each volume, in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "reference"))), lambda g: g["reference"])
    gaps.groupBy("volume").agg(listed.alias("verses")).select(F.lit(note).alias("note"), "volume", "verses").write.mode("overwrite").json(path)


def read_places(places: DataFrame, width: float = 1000.0, height: float = 1000.0) -> DataFrame:
    """Places of nested JSON (id, name, altName, coords in percent, at, tier, lines, …) on a plate of some size.

    ``x`` and ``y`` have one decimal; a name stands at its mark (``c``) at tier 3
    on one line unless told otherwise; ``names`` are all that it is known by.
    """
    own = places.withColumns({
        "x": F.round(F.col("coords.x") / 100 * width, 1), "y": F.round(F.col("coords.y") / 100 * height, 1), "at": F.coalesce("at", F.lit("c")), "tier": F.coalesce("tier", F.lit(3)),
        "lines": F.coalesce("lines", F.array("name")), "names": F.filter(F.array("name", "altName"), lambda n: n != ""),
    })
    return own.drop("coords")


def depth_at(width: Column) -> Column:
    """How much of a plate of some width is named: 0 to 3."""
    return F.when(width < 300, 0).when(width < 620, 1).when(width < 1150, 2).otherwise(3)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table that may be absent: then no rows.  Any other failure is raised."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Lines of markdown files in order: file, line_no, line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "line"))
    return whole


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names of a folder's files in order (file, nth), none of them read; a folder that is absent has none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "file string, nth int")
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"))
    # The files of a folder that are listed here are few; their order is one window.
    return names.withColumn("nth", F.row_number().over(Window.orderBy("file")))


def units(verses: DataFrame) -> DataFrame:
    """One row per unit with its number in reading order (volume, book, unit) and verse count."""
    flat = verses.groupBy("volume_id", "book", "unit").agg(F.count(F.lit(1)).alias("verse_count"))
    return numbered(flat, ["volume_id", "book", "unit"], "unit_no").select("volume_id", "book", "unit", "unit_no", "verse_count")
