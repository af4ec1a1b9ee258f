"""Chapter summaries from the pieces of printed pages: running heads, numbered headings with their blocks, titles, and what was put in by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .joins import upto
from .notes import stitched
from .refs import book_rows

# Other spellings of books, ordinals in titles, and books without summaries.
ALIASES = {
    "SONG OF SOLOMON": "Solomon's Song", "THE SONG OF SOLOMON": "Solomon's Song", "JOSEPH SMITH-MATTHEW": "Joseph Smith—Matthew", "JOSEPH SMITH-HISTORY": "Joseph Smith—History",
    "THE ARTICLES OF FAITH": "Articles of Faith", "ARTICLES OF FAITH": "Articles of Faith", "DOCTRINE AND COVENANTS": "Doctrine and Covenants", "THE DOCTRINE AND COVENANTS": "Doctrine and Covenants",
}
SINGULAR = {"PSALM": "Psalms"}
ORDINALS = [("FIRST", "1"), ("SECOND", "2"), ("THIRD", "3"), ("FOURTH", "4")]
NO_SUMMARY = ["Articles of Faith"]
# Characters of the shortest summary; how far from a block's end the next verse's drop cap may stand, and from a page's beginning.
SHORTEST, CAP_BEFORE, CAP_AFTER, CAP_OVERLEAF = 25, 2, 60, 80


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def _names() -> dict[str, str]:
    return {name.upper(): name for _, name, *_ in book_rows()}


def canonical(raw: Column) -> Column:
    """The book that a spelling names: by its name, an alias, or either with its blanks left out; else null."""
    spelled = _names() | {k: v for k, v in ALIASES.items() if k not in _names()}
    close = {k.replace(" ", ""): v for k, v in (_names() | ALIASES).items()} | SINGULAR
    key = F.upper(F.trim(F.regexp_replace(F.regexp_replace(raw, "[—–]", "-"), r"(?U)\s+", " ")))
    tight, dashed = F.regexp_replace(key, r"(?U)\s+", ""), lambda c: F.replace(c, F.lit("-"), F.lit("—"))
    names, others = _map(spelled), _map(close)
    return F.coalesce(F.try_element_at(names, key), F.try_element_at(names, dashed(key)), F.try_element_at(others, tight), F.try_element_at(others, dashed(tight)))


def _segment_book(segment: Column, numbered: bool) -> Column:
    """The book of one side of a running head; a page's number before it may run into the book's."""
    s = F.trim(F.regexp_replace(segment, r"(?U)\s+", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"\s*\d+\s*[:.]\s*\d+.*$", ""), r"\s*\d+\s*$", "")
    if not numbered:
        return canonical(s)
    digits, rest = F.regexp_extract(s, r"^(\d+)", 1), F.regexp_replace(s, r"^\d+\s*", "")
    split = F.coalesce(canonical(rest), F.when(F.length(digits) > 1, canonical(F.concat(F.right(digits, F.lit(1)), F.lit(" "), rest))))
    return F.when(digits == "", canonical(s)).otherwise(split)


def parse_heads(pages: DataFrame) -> DataFrame:
    """Pages (…, head) with ``first``, the book of their running head, ``second`` if a page straddles two, and the chapter at which that begins."""
    sides = F.split("head", "[–—]")
    left, right = F.get(sides, F.lit(0)), F.nullif(F.get(sides, F.lit(1)), F.lit(""))
    both = pages.withColumn("first", _segment_book(left, True)).withColumn("second", _segment_book(right, False))
    start = F.nullif(F.regexp_extract(right, r"(\d+)\s*[:.]\s*\d+", 1), F.lit("")).cast("int")
    return both.withColumn("second_start", start).withColumn("second", F.when(~F.col("second").eqNullSafe(F.col("first")), F.col("second")))


def book_of_title(title: Column) -> Column:
    """The book with whose name a printed title ends, the longest such; a spelled ordinal tells books of one name apart."""
    flat = F.regexp_replace(F.upper(title), "[^A-Z0-9]", "")
    bases: dict[str, list[str]] = {}
    for _, name, *_ in book_rows():
        base = name[2:] if name[0] in "1234" and name[1] == " " else name
        bases.setdefault("".join(c for c in base.upper() if c.isascii() and c.isalnum()), []).append(name)
    found = F.when(F.coalesce(flat, F.lit("")) == "", None)
    for base in sorted(bases, key=len, reverse=True):
        names = bases[base]
        plain = next((n for n in names if n[:2] not in ("1 ", "2 ", "3 ", "4 ")), names[0])
        put = F.lit(plain)
        if len(names) > 1:
            # The first ordinal that is spelled decides, if there is such a book.
            put = F.when(F.lit(False), plain)
            for word, digit in ORDINALS:
                put = put.when(flat.contains(word), next((n for n in names if n.startswith(f"{digit} ")), plain))
            put = put.otherwise(plain)
        found = found.when(flat.endswith(base), put)
    return found.otherwise(canonical(title))


def page_books(pages: DataFrame) -> DataFrame:
    """Pages (file, page, head) with the books of their heads, and ``book``: their own, else that of the next page that has one."""
    # Backwards, so that what is ahead of a page has come before it: a frame to the end of a file would be read anew for each page.
    back = parse_heads(pages).withColumn("__back", -F.col("page"))
    return upto(back, "file", ["__back"], {"book": F.col("first")}).drop("__back")


def unmatched_heads(pages: DataFrame, size: int = 8) -> DataFrame:
    """Heads with letters that name no book, on pages that none follows, most frequent first."""
    head = F.substring(F.trim(F.regexp_replace("head", r"(?U)\s+", " ")), 1, 40)
    bare = page_books(pages).where("book is null").where(F.col("head").rlike("[A-Za-z]{3}"))
    return bare.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "head").limit(size)


def _paired(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first block of each book's chapter: file, page, at, book, chapter, text."""
    both = pairs.where(F.length("text") >= SHORTEST).join(page_books(pages).where("book is not null"), ["file", "page"])
    later = F.col("second").isNotNull() & F.col("chapter").between(F.col("second_start"), F.col("second_start") + 1)
    told = both.withColumn("book", F.when(later, F.col("second")).otherwise(F.col("book")))
    return told.groupBy("book", "chapter").agg(F.min_by("text", F.struct("file", "page", "at")).alias("text"))


def _titled(titles: DataFrame, blocks: DataFrame, caps: DataFrame) -> DataFrame:
    """The block between a book's title and its first verse: book, chapter 1, text.

    A block counts that runs into a drop cap, or that is its page's last where
    the next page begins with one; of those the first after the title, else the
    first.  Of several titles of a book the first with a long enough block.
    """
    pages = caps.groupBy("file", "page").agg(F.collect_list("at").alias("caps"))
    overleaf = caps.where(F.col("at") < CAP_OVERLEAF).select("file", (F.col("page") - 1).alias("page")).distinct().withColumn("overleaf", F.lit(True))
    last = blocks.groupBy("file", "page").agg(F.max("start").alias("last"))
    seen = blocks.join(pages, ["file", "page"]).join(last, ["file", "page"]).join(overleaf, ["file", "page"], "left")
    abuts = F.exists("caps", lambda c: (c >= F.col("end") - CAP_BEFORE) & (c - F.col("end") < CAP_AFTER))
    fit = seen.where(abuts | ((F.col("start") == F.col("last")) & F.coalesce("overleaf", F.lit(False))))
    runs = stitched(titles.withColumn("on", F.struct("file", "page")), "on").select("on.file", "on.page", F.col("start").alias("t_start"), F.col("end").alias("t_end"), book_of_title(F.col("text")).alias("book"))
    both = runs.where(F.col("book").isNotNull() & ~F.col("book").isin(NO_SUMMARY)).join(fit, ["file", "page"])
    chosen = both.groupBy("file", "page", "t_start", "book").agg(F.min_by("text", F.struct(F.col("start") < F.col("t_end"), "start")).alias("text")).where(F.length("text") >= SHORTEST)
    return chosen.groupBy("book").agg(F.min_by("text", F.struct("file", "page", "t_start")).alias("text")).select("book", F.lit(1).alias("chapter"), "text")


def summaries(pages: DataFrame, pairs: DataFrame, titles: DataFrame, blocks: DataFrame, caps: DataFrame, by_hand: DataFrame) -> DataFrame:
    """book, chapter, text and origin (``heading``, ``title`` or ``hand``) of every summary found.

    ``pages`` are (file, page, head), pages numbered in a row; ``pairs`` (file,
    page, at, chapter, text) the numbered headings with their blocks, texts
    already mended; ``titles`` (file, page, start, text), ``blocks`` (file, page,
    start, end, text) and ``caps`` (file, page, at) the pieces of opening pages.
    Headings come first; a title gives its book's first chapter where no heading
    has, ``by_hand`` (book, chapter, text) what is still missing.
    """
    found = _paired(pages, pairs).withColumn("origin", F.lit("heading"))
    for origin, more in (("title", _titled(titles, blocks, caps)), ("hand", by_hand.select("book", "chapter", "text").dropDuplicates(["book", "chapter"]))):
        new = more.join(found.select("book", "chapter"), ["book", "chapter"], "left_anti").withColumn("origin", F.lit(origin))
        found = found.unionByName(new.select("book", F.col("chapter").cast("int").alias("chapter"), "text", "origin"))
    return found


def unpaired(pairs: DataFrame) -> DataFrame:
    """Headings whose block is too short to be a summary, by file."""
    return pairs.groupBy("file").agg(F.count_if(F.length("text") < SHORTEST).alias("unpaired"))
