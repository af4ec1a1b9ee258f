"""Notes to verses: connections and underlines, selections, headings and the blocks that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.sources.stored import staged

from .joins import look_up, numbered
from .refs import parse_citations, target_verses


def connections(markers: DataFrame, entries: DataFrame, scopes: list[str]) -> DataFrame:
    """The entries that each marker names, with the marker's letter: letter, verse, w1, w2, pos, id, scope and the entry's other columns.

    ``markers`` are (pos, verse, w1, w2, entries), ``pos`` their order in the
    file.  Every marker of a verse takes the next letter, whether its entries are
    found or not; an id without an entry gives nothing; an entry of an unknown
    scope has the first of ``scopes``.
    """
    nth = F.row_number().over(Window.partitionBy("verse").orderBy("pos"))
    lettered = markers.withColumn("letter", F.concat(F.col("verse").cast("string"), F.char(96 + nth)))
    each = lettered.select("letter", "verse", "w1", "w2", "pos", F.explode("entries").alias("id"))
    scope = F.when(F.col("scope").isin(scopes), F.col("scope")).otherwise(F.lit(scopes[0]))
    return each.join(entries, "id").withColumn("scope", scope)


def ordered(rows: DataFrame) -> DataFrame:
    """Connections in reading order (``nth``): by verse and first word, those of no verse left out."""
    return numbered(rows.where("verse is not null"), ["verse", "w1", "pos", "id"], "__n").withColumn("nth", F.col("__n") + 1).drop("__n")


def by_scope(rows: DataFrame) -> DataFrame:
    """How many connections each scope has, and of how many verses."""
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("verse").alias("verses"))


def by_verse(rows: DataFrame) -> DataFrame:
    """Letters of each verse's connections, in order."""
    return rows.where("verse is not null").groupBy("verse").agg(F.array_sort(F.collect_set("letter")).alias("letters"))


def underlines(notes: DataFrame, level: str, chapter: int) -> DataFrame:
    """Word ranges that the notes of one level underline in a chapter (level, chapter, verse, w1, w2), by verse."""
    mine = notes.where((F.col("level") == level) & (F.col("chapter") == chapter))
    return mine.groupBy("verse").agg(F.sort_array(F.collect_list(F.struct("w1", "w2"))).alias("words"))


def selection(reference: Column, low: Column, high: Column) -> Column:
    """Label of the verses of a selection: one, a range, or the reference alone where none is known."""
    name = lambda *c: F.concat(reference, F.lit(":"), *[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in c])
    return F.when(low.isNull(), reference).when(low == high, name(low)).otherwise(name(low, "–", high))


def quoted(verses: DataFrame, key: str, reference: str) -> DataFrame:
    """The text of each selection (key, reference, verse, text) in quotes with its label."""
    joined = verses.groupBy(key, reference).agg(F.min("verse").alias("lo"), F.max("verse").alias("hi"), F.sort_array(F.collect_list(F.struct("verse", "text"))).alias("v"))
    text = F.array_join(F.filter(F.col("v.text"), lambda t: t != ""), " ")
    return joined.select(key, F.concat(F.lit("“"), text, F.lit("” ("), selection(F.col(reference), F.col("lo"), F.col("hi")), F.lit(")")).alias("quote"))


def treats(citations: DataFrame, page: str, book: str, chapter: int | None = None) -> DataFrame:
    """Pages that cite a chapter, or anything of a book."""
    mine = citations.where(F.lower("book") == book.lower())
    return (mine if chapter is None else mine.where(F.col("chapter") == chapter)).select(page).distinct()


def marks_at(margin: DataFrame, verses: DataFrame) -> DataFrame:
    """Pages that stand at each verse (book, chapter, verse): those of its own, and at a chapter's first those of the whole.

    ``margin`` has book, chapter, verse, page and ``whole``; pages of the whole come first.
    """
    first = verses.groupBy("book", "chapter").agg(F.min("verse").alias("verse"))
    whole = margin.where("whole").drop("verse").join(first, ["book", "chapter"])
    return margin.where("not whole").join(verses.select("book", "chapter", "verse"), ["book", "chapter", "verse"]).unionByName(whole.select(*margin.columns))


def following(headings: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """Each heading (page, at, head) with the first block (page, at, text) at or after it on its page; a heading without one gives nothing."""
    both = headings.select(page, "at", F.lit(1).alias("order"), "head", F.lit(None).cast("string").alias("text")).unionByName(blocks.select(page, "at", F.lit(2).alias("order"), F.lit(None).cast("string").alias("head"), "text"))
    ahead = Window.partitionBy(page).orderBy("at", "order").rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("text", F.first("text", True).over(ahead)).where("order = 1 and text is not null").select(page, "at", "head", "text")


def stitched(runs: DataFrame, page: str, gap: int = 6) -> DataFrame:
    """Runs of text (page, start, text) joined where the next begins less than ``gap`` characters after the end: page, start, end, text."""
    order = Window.partitionBy(page).orderBy("start")
    ends = runs.withColumn("end", F.col("start") + F.length("text"))
    apart = F.lag("end").over(order).isNull() | (F.col("start") - F.lag("end").over(order) >= gap)
    groups = ends.withColumn("n", F.sum(apart.cast("int")).over(order))
    joined = groups.groupBy(page, "n").agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("t"))
    return joined.select(page, "start", "end", F.array_join(F.col("t.text"), " ").alias("text"))


def _label(verses: Column) -> Column:
    """``verse 3``, ``verses 1–3`` for a run, ``verses 1, 3`` for a list."""
    n, text = F.size(verses), F.transform(verses, lambda v: v.cast("string"))
    run = F.element_at(verses, -1) - F.element_at(verses, 1) == n - 1
    ends = F.concat_ws("–", F.element_at(text, 1), F.element_at(text, -1))
    return F.when(n == 1, F.concat(F.lit("verse "), F.element_at(text, 1))).otherwise(F.concat(F.lit("verses "), F.when(run, ends).otherwise(F.array_join(text, ", "))))


def note_runs(notes: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Notes (note, text, marks) cut into runs: note, nth, text, and the mark of each that has one.

    Marks are structs with ``start`` and ``end`` (code points from 0, the end
    outside).  They are taken by start, then in the order given; one that begins
    before the last one taken has ended, or is empty or outside the text, is
    passed over.  The runs of a note, one after the other, are its text.
    Columns named in ``also`` are kept.
    """
    size = F.length("text")
    listed = F.transform(F.coalesce("marks", F.array().cast(notes.schema["marks"].dataType)), lambda m, i: F.struct(m["start"].alias("s"), i.alias("i"), m.alias("mark")))
    mark = notes.schema["marks"].dataType.elementType.simpleString()
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<lo:int,hi:int,mark:{mark}>>").alias("out"))
    lo, hi = (lambda m: m["mark"]["start"].cast("int")), (lambda m: m["mark"]["end"].cast("int"))
    take = lambda a, m: (lo(m) >= a["at"]) & (hi(m) > lo(m)) & (hi(m) <= size)
    step = lambda a, m: F.when(take(a, m), F.struct(hi(m).alias("at"), F.concat(a["out"], F.array(F.struct(lo(m).alias("lo"), hi(m).alias("hi"), m["mark"].alias("mark")))).alias("out"))).otherwise(a)
    taken = notes.select("note", *also, "text", F.aggregate(F.array_sort(listed), begin, step)["out"].alias("taken")).where(size > 0)
    # Each mark, and the plain text before it and at the end.
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("taken", i - 1)["hi"])
    plain = F.lit(None).cast(mark)
    pieces = F.flatten(F.transform("taken", lambda m, i: F.array(F.struct(before(i).alias("lo"), m["lo"].alias("hi"), plain.alias("mark")), m)))
    rest = F.struct(F.coalesce(F.get("taken", F.size("taken") - 1)["hi"], F.lit(0)).alias("lo"), size.alias("hi"), plain.alias("mark"))
    runs = F.filter(F.concat(pieces, F.array(rest)), lambda p: p["hi"] > p["lo"])
    each = taken.select("note", *also, "text", F.posexplode(runs).alias("nth", "run"))
    return each.select("note", *also, "nth", F.substr("text", F.col("run.lo") + 1, F.col("run.hi") - F.col("run.lo")).alias("text"), F.col("run.mark").alias("mark"))


def doors(notes: DataFrame, verses: DataFrame) -> DataFrame:
    """The runs of notes, and the door that each opens: note, nth, text, door, verses, book, chapter, title.

    ``notes`` are (note, book, chapter, text, marks); a mark has ``kind``,
    ``start``, ``end``, ``verse``, ``verse_start``, ``verse_end`` and
    ``ch_start``.  ``verses`` (book, chapter, verse) are those there are.  A
    ``cite`` or ``verse`` mark opens the verses of the note's own chapter that
    exist; ``chapter`` that chapter of the note's book, if it exists;
    ``scripture`` the first citation that its text is read as.  Any other run
    and a mark whose target does not exist stay plain: no door.
    """
    own = notes.where("note is not null").select("note", "text", "marks", F.col("book").alias("own_book"), F.col("chapter").alias("own_chapter")).repartition("note")
    runs = staged(note_runs(own, ("own_book", "own_chapter")), "runs")
    low = F.when(F.col("mark.kind") == "cite", F.col("mark.verse")).when(F.col("mark.kind") == "verse", F.col("mark.verse_start"))
    high = F.when(F.col("mark.kind") == "cite", F.col("mark.verse")).when(F.col("mark.kind") == "verse", F.coalesce("mark.verse_end", "mark.verse_start"))
    # A chapter's verses are one row, so that a run needs no rows of its own to ask for them; equal texts are read once.
    chapters = staged(verses.groupBy("book", "chapter").agg(F.sort_array(F.collect_set("verse")).alias("there")), "chapters")
    here = look_up(runs, chapters.select(F.col("book").alias("own_book"), F.col("chapter").alias("own_chapter"), "there"), ["own_book", "own_chapter"], "left")
    asked = F.filter("there", lambda v: v.between(low, high))
    here = here.withColumn("verses", F.when(F.size(asked) > 0, asked)).drop("there").withColumn("to", F.when(F.col("mark.kind") == "chapter", F.col("mark.ch_start")))
    whole = look_up(here, chapters.select(F.col("book").alias("own_book"), F.col("chapter").alias("to"), F.lit(True).alias("is_chapter")), ["own_book", "to"], "left")
    texts = runs.where("mark.kind = 'scripture'").select("text").distinct()
    first = parse_citations(texts.select(F.col("text").alias("id"), "text"), "id", "text").groupBy("id").agg(F.min_by(F.struct("book", "chapter", "verses"), "at").alias("c"))
    read = whole.withColumn("id", F.when(F.col("mark.kind") == "scripture", F.col("text")))
    both = look_up(read, staged(first, "citations"), ["id"], "left").select(
        "note", "nth", "text", "own_book", "own_chapter", "verses", F.when(F.col("is_chapter"), F.col("own_book")).otherwise(F.col("c.book")).alias("c_book"),
        F.when(F.col("is_chapter"), F.col("to")).otherwise(F.col("c.chapter")).alias("c_chapter"), F.when(F.col("is_chapter"), F.array().cast("array<int>")).otherwise(F.col("c.verses")).alias("c_verses"),
    )
    door = F.when(F.col("verses").isNotNull(), "verses").when(F.col("c_book").isNotNull(), "cite")
    spelled = F.concat(F.col("c_book"), F.lit(" "), F.col("c_chapter"), F.when(F.size("c_verses") > 0, F.concat(F.lit(":"), F.array_join(F.transform("c_verses", lambda v: v.cast("string")), ","))).otherwise(""))
    title = F.when(door == "verses", F.concat(F.lit("Go to "), _label(F.col("verses")))).when(door == "cite", F.concat(F.lit("Open "), spelled))
    return both.select("note", "nth", "text", door.alias("door"), F.coalesce("verses", "c_verses").alias("verses"), F.when(door == "verses", F.col("own_book")).otherwise(F.col("c_book")).alias("book"), F.when(door == "verses", F.col("own_chapter")).otherwise(F.col("c_chapter")).alias("chapter"), title.alias("title"))


def by_target(entries: DataFrame, chapter: int) -> DataFrame:
    """Connections at the verses of a chapter: verse, ids.

    ``entries`` are (id, chapter, verse, target).  An entry with a verse stands
    there if that is of the chapter; one without stands once at each verse of the
    chapter that its target (``34:11–12, 14; 35:2``) names.
    """
    own = entries.where(F.col("verse").isNotNull() & (F.col("chapter") == chapter)).select("id", "verse")
    others = entries.where("verse is null").select("id", F.explode(target_verses(F.col("target"), chapter)).alias("verse"))
    return own.unionByName(others).groupBy("verse").agg(F.sort_array(F.collect_list("id")).alias("ids"))
