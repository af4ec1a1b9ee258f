"""References: the book dimension, verse lists, citations, their links and suggestions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lectern.functions.text import norm_book, norm_reference
from lectern.sources.stored import staged

from .joins import look_up

# Books in order with their volume, number of chapters and aliases.
BOOKS = [
    ("Genesis", "ot", 50, []),
    ("Exodus", "ot", 40, []),
    ("Leviticus", "ot", 27, []),
    ("Numbers", "ot", 36, []),
    ("Deuteronomy", "ot", 34, []),
    ("Joshua", "ot", 24, []),
    ("Judges", "ot", 21, []),
    ("Ruth", "ot", 4, []),
    ("1 Samuel", "ot", 31, []),
    ("2 Samuel", "ot", 24, []),
    ("1 Kings", "ot", 22, []),
    ("2 Kings", "ot", 25, []),
    ("1 Chronicles", "ot", 29, []),
    ("2 Chronicles", "ot", 36, []),
    ("Ezra", "ot", 10, []),
    ("Nehemiah", "ot", 13, []),
    ("Esther", "ot", 10, []),
    ("Job", "ot", 42, []),
    ("Psalms", "ot", 150, ["ps"]),
    ("Proverbs", "ot", 31, []),
    ("Ecclesiastes", "ot", 12, []),
    ("Solomon's Song", "ot", 8, ["songofsolomon", "sos"]),
    ("Isaiah", "ot", 66, []),
    ("Jeremiah", "ot", 52, []),
    ("Lamentations", "ot", 5, []),
    ("Ezekiel", "ot", 48, []),
    ("Daniel", "ot", 12, []),
    ("Hosea", "ot", 14, []),
    ("Joel", "ot", 3, []),
    ("Amos", "ot", 9, []),
    ("Obadiah", "ot", 1, []),
    ("Jonah", "ot", 4, []),
    ("Micah", "ot", 7, []),
    ("Nahum", "ot", 3, []),
    ("Habakkuk", "ot", 3, []),
    ("Zephaniah", "ot", 3, []),
    ("Haggai", "ot", 2, []),
    ("Zechariah", "ot", 14, []),
    ("Malachi", "ot", 4, []),
    ("Matthew", "nt", 28, ["mt"]),
    ("Mark", "nt", 16, ["mk"]),
    ("Luke", "nt", 24, ["lk"]),
    ("John", "nt", 21, ["jn"]),
    ("Acts", "nt", 28, []),
    ("Romans", "nt", 16, []),
    ("1 Corinthians", "nt", 16, []),
    ("2 Corinthians", "nt", 13, []),
    ("Galatians", "nt", 6, []),
    ("Ephesians", "nt", 6, []),
    ("Philippians", "nt", 4, []),
    ("Colossians", "nt", 4, []),
    ("1 Thessalonians", "nt", 5, []),
    ("2 Thessalonians", "nt", 3, []),
    ("1 Timothy", "nt", 6, []),
    ("2 Timothy", "nt", 4, []),
    ("Titus", "nt", 3, []),
    ("Philemon", "nt", 1, []),
    ("Hebrews", "nt", 13, []),
    ("James", "nt", 5, []),
    ("1 Peter", "nt", 5, []),
    ("2 Peter", "nt", 3, []),
    ("1 John", "nt", 5, []),
    ("2 John", "nt", 1, []),
    ("3 John", "nt", 1, []),
    ("Jude", "nt", 1, []),
    ("Revelation", "nt", 22, []),
    ("1 Nephi", "bofm", 22, []),
    ("2 Nephi", "bofm", 33, []),
    ("Jacob", "bofm", 7, []),
    ("Enos", "bofm", 1, []),
    ("Jarom", "bofm", 1, []),
    ("Omni", "bofm", 1, []),
    ("Words of Mormon", "bofm", 1, ["wom"]),
    ("Mosiah", "bofm", 29, []),
    ("Alma", "bofm", 63, []),
    ("Helaman", "bofm", 16, ["hel"]),
    ("3 Nephi", "bofm", 30, []),
    ("4 Nephi", "bofm", 1, []),
    ("Mormon", "bofm", 9, []),
    ("Ether", "bofm", 15, []),
    ("Moroni", "bofm", 10, []),
    ("Moses", "pgp", 8, []),
    ("Abraham", "pgp", 5, ["abr"]),
    ("Joseph Smith—Matthew", "pgp", 1, ["jsm"]),
    ("Joseph Smith—History", "pgp", 1, ["jsh"]),
    ("Articles of Faith", "pgp", 1, ["aof"]),
    ("Doctrine and Covenants", "dc", 138, ["dc", "dandc"]),
]

# Abbreviations and the books that they stand for.
ABBREVIATIONS = [
    ("gen.", "Genesis"),
    ("ex.", "Exodus"),
    ("lev.", "Leviticus"),
    ("num.", "Numbers"),
    ("deut.", "Deuteronomy"),
    ("josh.", "Joshua"),
    ("judg.", "Judges"),
    ("ps.", "Psalms"),
    ("prov.", "Proverbs"),
    ("eccl.", "Ecclesiastes"),
    ("isa.", "Isaiah"),
    ("jer.", "Jeremiah"),
    ("lam.", "Lamentations"),
    ("ezek.", "Ezekiel"),
    ("dan.", "Daniel"),
    ("obad.", "Obadiah"),
    ("mal.", "Malachi"),
    ("zech.", "Zechariah"),
    ("hos.", "Hosea"),
    ("matt.", "Matthew"),
    ("mt.", "Matthew"),
    ("mk.", "Mark"),
    ("lk.", "Luke"),
    ("jn.", "John"),
    ("rom.", "Romans"),
    ("1 cor.", "1 Corinthians"),
    ("2 cor.", "2 Corinthians"),
    ("gal.", "Galatians"),
    ("eph.", "Ephesians"),
    ("philip.", "Philippians"),
    ("phil.", "Philippians"),
    ("col.", "Colossians"),
    ("1 thes.", "1 Thessalonians"),
    ("2 thes.", "2 Thessalonians"),
    ("1 tim.", "1 Timothy"),
    ("2 tim.", "2 Timothy"),
    ("philem.", "Philemon"),
    ("heb.", "Hebrews"),
    ("1 pet.", "1 Peter"),
    ("2 pet.", "2 Peter"),
    ("1 jn.", "1 John"),
    ("2 jn.", "2 John"),
    ("3 jn.", "3 John"),
    ("rev.", "Revelation"),
    ("1 sam.", "1 Samuel"),
    ("2 sam.", "2 Samuel"),
    ("1 kgs.", "1 Kings"),
    ("2 kgs.", "2 Kings"),
    ("1 chr.", "1 Chronicles"),
    ("2 chr.", "2 Chronicles"),
    ("neh.", "Nehemiah"),
    ("esth.", "Esther"),
    ("song of sol.", "Solomon's Song"),
    ("hab.", "Habakkuk"),
    ("zeph.", "Zephaniah"),
    ("hag.", "Haggai"),
    ("1 ne.", "1 Nephi"),
    ("2 ne.", "2 Nephi"),
    ("w of m.", "Words of Mormon"),
    ("hel.", "Helaman"),
    ("3 ne.", "3 Nephi"),
    ("4 ne.", "4 Nephi"),
    ("morm.", "Mormon"),
    ("moro.", "Moroni"),
    ("d&c", "Doctrine and Covenants"),
    ("dc", "Doctrine and Covenants"),
    ("abr.", "Abraham"),
    ("js—m", "Joseph Smith—Matthew"),
    ("js—h", "Joseph Smith—History"),
    ("a of f.", "Articles of Faith"),
    ("psalm", "Psalms"),
    ("song of solomon", "Solomon's Song"),
]


def book_rows() -> list[tuple[int, str, str, int, list[str]]]:
    """Position, name, volume, chapters and aliases of each book."""
    return [(n, *book) for n, book in enumerate(BOOKS)]


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(book_rows(), "book_pos int, book string, volume_id string, chapters int, aliases array<string>")


def spellings() -> list[tuple[str, str]]:
    """Every spelling, lower case, with its book; names rank before abbreviations."""
    names = [(n.lower().replace("–", "—"), n) for _, n, *_ in book_rows()]
    return list(dict(reversed([*names, *ABBREVIATIONS, *[(s[:-1], b) for s, b in ABBREVIATIONS if s.endswith(".")]])).items())


def resolved(rows: DataFrame, raw: str, into: str = "book") -> DataFrame:
    """Rows with the book that ``raw`` spells (null: none); the spellings are few and broadcast."""
    known = rows.sparkSession.createDataFrame(spellings(), f"__s string, {into} string")
    return rows.withColumn("__s", F.regexp_replace(norm_book(F.col(raw)), r"(?<!^)\.$", "")).join(F.broadcast(known), "__s", "left").drop("__s")


def expand_verses(spec: Column) -> Column:
    """``4, 11–13`` as its numbers; what is no number or runs backwards gives none."""
    part = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    lo = lambda p: F.regexp_extract(p, r"^(\d{1,6})", 1).try_cast("int")
    hi = lambda p: F.coalesce(F.regexp_extract(p, r"^\d{1,6}\s*[–—-]\s*(\d{1,6})", 1).try_cast("int"), lo(p))
    none = F.array().cast("array<int>")
    return F.flatten(F.transform(part, lambda p: F.when(lo(p).isNull() | (lo(p) > hi(p)), none).otherwise(F.sequence(lo(p), F.greatest(hi(p), lo(p))))))


def target_verses(target: Column, chapter: int) -> Column:
    """Verses of a chapter that a target (``34:11–12; 35:2``) names, in order, each once."""
    form = F.lit(r"(\d+)\s*:\s*([\d\s,–—-]+)")
    groups = F.arrays_zip(F.regexp_extract_all(target, form, F.lit(1)).alias("c"), F.regexp_extract_all(target, form, F.lit(2)).alias("v"))
    mine = F.filter(groups, lambda g: g["c"].try_cast("int") == chapter)
    return F.array_distinct(F.flatten(F.transform(mine, lambda g: expand_verses(g["v"]))))


def parse_citations(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Citations of ``text``: key, at, book, chapter, verses.

    Chunks end at semicolons; one without a book has that of the last chunk that
    named one.  No verses mean the whole chapter; chunks without a chapter or a
    book go.
    """
    chunks = rows.select(key, F.posexplode(F.split(text, ";")).alias("at", "chunk")).withColumn("chunk", F.trim("chunk"))
    named = chunks.withColumn("raw", F.trim(F.regexp_extract("chunk", r"^((?:[1-4]\s+)?[^\d:]*?)\s*\d+", 1)))
    own = F.when(F.col("raw") != "", F.col("raw"))
    found = resolved(named.withColumn("raw", own), "raw", "own")
    carried = F.last("own", True).over(Window.partitionBy(key).orderBy("at"))
    body = F.when(F.col("raw").isNotNull(), F.expr("substring(chunk, length(raw) + 1)")).otherwise(F.col("chunk"))
    out = found.withColumn("book", F.when(F.col("raw").isNull(), carried).otherwise(F.col("own"))).withColumn("chapter", F.regexp_extract(body, r"(\d+)", 1).try_cast("int"))
    listed = F.regexp_extract(body, r"^\s*\d+\s*:\s*(.*)$", 1)
    verses = F.when(listed != "", expand_verses(listed)).otherwise(F.array().cast("array<int>"))
    return out.where("book is not null and chapter is not null").select(key, "at", "book", "chapter", verses.alias("verses"))


def valid(rows: DataFrame, chapters: DataFrame, into: str = "valid") -> DataFrame:
    """Rows (book, chapter, verse) and whether there is that verse; no verse asks for the chapter alone.  ``chapters`` are (book, chapter, verse_count)."""
    known = chapters.groupBy("book", "chapter").agg(F.max("verse_count").alias("__n"))
    told = look_up(rows, known, ["book", "chapter"], "left")
    return told.withColumn(into, F.col("__n").isNotNull() & (F.col("verse").isNull() | F.coalesce(F.col("verse").between(1, F.col("__n")), F.lit(False)))).drop("__n")


def chapter_refs(rows: DataFrame, key: str, spec: str) -> DataFrame:
    """A row for each chapter of ``Alma 5, 7, 12–13``: key, at, book, chapter, label; what names no book gives none."""
    form = r"^(.+?)\s+([\d\s,–—-]+)$"
    cut = rows.select(key, F.regexp_extract(spec, form, 1).alias("raw"), F.regexp_extract(spec, form, 2).alias("list"))
    each = resolved(cut.where("raw <> ''"), "raw").where("book is not null").select(key, "book", F.posexplode(expand_verses(F.col("list"))).alias("at", "chapter"))
    return each.withColumn("label", F.concat_ws(" ", "book", F.col("chapter").cast("string")))


def citation_pattern() -> str:
    """A citation with all it goes on to list: book, chapter, verses, further chapters and verses."""
    spelled = sorted((s for s, _ in spellings()), key=lambda s: (-len(s), s))
    names = "|".join(re.escape(s).replace("\\ ", r"\s+").replace("—", "[—–-]").replace("'", "['’]") + r"\.?" for s in (x.rstrip(".") for x in dict.fromkeys(spelled)))
    other = rf"(?!(?:{names})\s)"
    verse = rf"\d{{1,3}}(?:[–—-]\d{{1,3}})?(?!\d)(?:,\s*{other}\d{{1,3}}(?:[–—-]\d{{1,3}})?(?![\d:]))*"
    return rf"(?i)(?<![\p{{L}}\d])(?:{names})\s+\d{{1,3}}(?!\d)(?::{verse})?(?:\s*;\s*{other}\d{{1,3}}:{verse})*"


def scan_citations(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Citations that stand in prose: key, at, book, chapter, verses."""
    groups = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(citation_pattern()), F.lit(0))).alias("g", "cite"))
    one = groups.select(F.struct(key, "g").alias("id"), "cite")
    found = parse_citations(one, "id", "cite")
    order = F.row_number().over(Window.partitionBy("id." + key).orderBy("id.g", "at"))
    return found.withColumn("nth", order - 1).select(F.col("id." + key).alias(key), F.col("nth").alias("at"), "book", "chapter", "verses")


def study_index(citations: DataFrame, page: str) -> DataFrame:
    """book, chapter, page, verses: the distinct verses that a page cites, none for a chapter cited as a whole."""
    each = citations.select(page, "book", "chapter", F.explode_outer("verses").alias("v"))
    return each.groupBy("book", "chapter", page).agg(F.sort_array(F.collect_set("v")).alias("verses"))


def mentions(index: DataFrame, page: str) -> DataFrame:
    """The pages of each chapter in order: most verses first, then the page."""
    order = Window.partitionBy("book", "chapter").orderBy(F.desc(F.size("verses")), page)
    return index.withColumn("rank", F.row_number().over(order))


def margin(index: DataFrame, page: str) -> DataFrame:
    """Pages at the first verse they cite; those that cite the whole chapter stand at verse 1, marked ``whole``."""
    return index.select("book", "chapter", F.coalesce(F.try_element_at("verses", F.lit(1)), F.lit(1)).alias("verse"), page, (F.size("verses") == 0).alias("whole"))


def passages(citations: DataFrame, verses: DataFrame, key: list[str], size: int = 12) -> DataFrame:
    """The first ``size`` verses (book, chapter, verse, text) that each citation names; no verses name all."""
    both = citations.join(verses, ["book", "chapter"]).where((F.size("verses") == 0) | F.array_contains("verses", F.col("verse")))
    return both.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("verse"))).where(F.col("n") <= size).drop("n")


def match_books(dim: DataFrame, typed: str) -> DataFrame:
    """Books that a typed beginning may mean: by name, without blanks, by alias, or word by word."""
    asked = dim.withColumn("q", norm_reference(F.lit(typed)))
    return asked.where(_meant(F.struct(norm_reference(F.col("book")).alias("n"), "aliases"), F.col("q"))).select(*dim.columns)


def _meant(book: Column, q: Column) -> Column:
    """Whether a typed beginning may mean a book (n, aliases)."""
    tight, name = F.replace(q, F.lit(" "), F.lit("")), F.split(book["n"], " ")
    heads = F.arrays_zip(F.split(q, " ").alias("a"), F.slice(name, F.lit(1), F.size(F.split(q, " "))).alias("b"))
    by_word = (F.size(F.split(q, " ")) > 1) & (F.size(F.split(q, " ")) <= F.size(name)) & F.forall(heads, lambda z: z["b"].startswith(z["a"]))
    return (q != "") & (book["n"].startswith(q) | F.replace(book["n"], F.lit(" "), F.lit("")).startswith(tight) | F.exists(book["aliases"], lambda a: a.startswith(tight)) | by_word)


def meant_books(rows: DataFrame, typed: str) -> DataFrame:
    """Rows with ``books``, the names of the books that their typed beginning may mean, in order.

    The books are a list within the expression; each distinct text is asked once.
    """
    none = F.array().cast("array<string>")
    known = F.array(*[F.struct(F.lit(b).alias("book"), norm_reference(F.lit(b)).alias("n"), (F.array(*map(F.lit, a)) if a else none).alias("aliases")) for _, b, _, _, a in book_rows()])
    q = norm_reference(F.col(typed))
    asked = staged(rows.select(typed).where(F.col(typed).isNotNull()).distinct().withColumn("books", F.transform(F.filter(known, lambda b: _meant(b, q)), lambda b: b["book"])), "asked")
    return look_up(rows, asked, [typed], "left").withColumn("books", F.coalesce("books", none))


def suggestions(dim: DataFrame, chapters: DataFrame, typed: str, size: int = 8) -> DataFrame:
    """References that a typed text may mean, best first: label, book, chapter, verse.

    The text is cut into a head, the book, and up to two numbers.  One number is a
    chapter, or a verse where the book has one chapter, and without a colon its
    digits may be a chapter and verse too, the most even cut first; two numbers are
    chapter and verse, or without a colon one chapter.  Chapters (book, chapter,
    verse_count) say which exist.
    """
    spark = dim.sparkSession
    parts = re.findall(r"\d+|[^\d\s:.,;]+", typed)
    colon, tries = bool(re.search(r"\d\s*[:.]\s*\d", typed)), []
    for i in range(len(parts), 0, -1):
        tail = parts[i:]
        if len(tail) > 2 or not all(t.isdigit() for t in tail):
            continue
        read: list[tuple[int, int | None, int | None, bool | None]] = []
        if not tail:
            read = [(0, None, None, None)]
        elif len(tail) == 1:
            n, digits = int(tail[0]), tail[0]
            read = [(0, 1, n, True), (0, n, None, False)]
            cuts = sorted(range(1, len(digits)), key=lambda s: (abs(2 * s - len(digits)), int(digits[:s])))
            read += [] if colon else [(1 + k, int(digits[:s]), int(digits[s:]), None) for k, s in enumerate(cuts)]
        else:
            read = [(0, int(tail[0]), int(tail[1]), None)] + ([] if colon else [(1, int("".join(tail)), None, None)])
        for order, chapter, verse, single in read:
            tries.append((len(parts) - i, " ".join(parts[:i]), order, chapter, verse, single))
    if not tries:
        return spark.createDataFrame([], "label string, book string, chapter int, verse int")
    heads = None
    for head in {t[1] for t in tries}:
        some = match_books(dim, head).withColumn("head", F.lit(head))
        heads = some if heads is None else heads.unionByName(some)
    read = spark.createDataFrame(tries, "step int, head string, nth int, chapter int, verse int, single boolean")
    both = heads.join(F.broadcast(read), "head").join(chapters.select("book", "chapter", "verse_count"), ["book", "chapter"], "left")
    alone = (F.col("chapters") == 1) & (F.coalesce("verse", "chapter") > 1)
    fits = F.col("single").isNull() | F.when(F.col("single"), alone).otherwise(~alone)
    exists = F.col("chapter").isNull() | (F.col("chapter").between(1, F.col("chapters")) & (F.col("verse").isNull() | F.col("verse").between(1, F.coalesce("verse_count", F.lit(0)))))
    label = F.concat_ws(":", F.concat_ws(" ", "book", F.col("chapter").cast("string")), F.col("verse").cast("string"))
    order = F.struct("step", "book_pos", "nth")
    return both.where(fits & exists).groupBy(label.alias("label"), "book", "chapter", "verse").agg(F.min(order).alias("o")).orderBy("o").limit(size).select("label", "book", "chapter", "verse")
