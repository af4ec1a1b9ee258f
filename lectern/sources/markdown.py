"""Markdown dialects as tables: lines in, typed rows out, by windows over each file's lines.

All functions take ``lines(file, line_no, line)`` as ``corpus.read_markdown`` gives
them.  A file is one window partition; files are pages of prose, so that bounds a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import norm, split_lead, split_title, year_heading
from lectern.operators.dims import range_explode
from lectern.operators.joins import look_up, upto
from lectern.operators.refs import resolved


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _order():
    return Window.partitionBy("file").orderBy("line_no")


def headed(lines: DataFrame, stop: str | None = None) -> DataFrame:
    """Lines with the last ``#`` title, ``##`` heading and ``###`` part above them; lines from ``stop`` on go."""
    level = lambda n: F.when(F.col("line").rlike(rf"^#{{{n}}}\s"), F.trim(F.regexp_replace("line", r"^#+\s+", "")))
    out = lines.withColumn("title", F.last(level(1), True).over(_order())).withColumn("heading", F.last(level(2), True).over(_order())).withColumn("part", F.last(level(3), True).over(_order()))
    if stop:
        out = out.withColumn("__past", F.max(F.col("line").rlike(stop)).over(_order())).where(~F.col("__past")).drop("__past")
    return out.where(~F.col("line").rlike(r"^#{1,3}\s"))


def _latest(rows: DataFrame, key: list[str], *values: str) -> DataFrame:
    """One row for each key: the values of its last line."""
    last = F.max_by(F.struct(*values), F.struct("file", "line_no"))
    return rows.groupBy(*key).agg(last.alias("__v")).select(*key, "__v.*")


def pipe_rows(lines: DataFrame, piped: bool = True) -> DataFrame:
    """Cells of the rows of tables under a ``##`` heading: file, line_no, heading, book, cells, begun, newest.

    A row begins with a pipe; ``piped=False`` takes any line with one.  ``book``
    is the heading's key, ``begun`` the line of the heading, ``newest`` that of
    the last heading in the file with the same key.
    """
    own = lines.select("file", "line_no", _trim(F.col("line")).alias("line"))
    head = F.when(F.col("line").rlike(r"^##\s+.+$"), _trim(F.regexp_extract("line", r"^##\s+(.+)$", 1)))
    own = own.withColumn("own", head)
    own = upto(own, "file", ["line_no"], {"heading": F.col("own"), "begun": F.when(F.col("own").isNotNull(), F.col("line_no"))})
    own = own.withColumn("book", norm(F.col("heading")))
    newest = own.where("own is not null").groupBy("file", "book").agg(F.max("begun").alias("newest"))
    cells = F.transform(F.split("line", r"\|", -1), _trim)
    cells = F.when(F.get(cells, F.lit(0)) == "", F.slice(cells, F.lit(2), F.size(cells))).otherwise(cells)
    rows = own.where(F.col("heading").isNotNull() & F.col("own").isNull() & (F.col("line").startswith("|") if piped else F.col("line").contains("|"))).withColumn("cells", cells)
    ended = F.when(F.try_element_at("cells", F.lit(-1)) == "", F.slice("cells", F.lit(1), F.greatest(F.size("cells") - 1, F.lit(0)))).otherwise(F.col("cells"))
    return rows.select("file", "line_no", "heading", "book", ended.alias("cells"), "begun").join(newest, ["file", "book"])


def _cell(n: int) -> Column:
    """A row's cell, null where it is empty or absent."""
    return F.nullif(F.get("cells", F.lit(n)), F.lit(""))


def _chapter(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{1,9}$"), text).try_cast("int")


def captions(lines: DataFrame) -> DataFrame:
    """``| Ch | Caption | Section |`` under a book's heading: book, chapter, caption (may be empty), section (null: none).

    Within a file the last table of a book counts, among files the last one that
    has the chapter.
    """
    rows = pipe_rows(lines, piped=False).select("*", _chapter(_cell(0)).alias("chapter"), F.coalesce(_cell(1), F.lit("")).alias("caption"), _cell(2).alias("section")).where("chapter is not null")
    last = rows.withColumn("newest", F.max("begun").over(Window.partitionBy("file", "book"))).where("begun = newest")
    return _latest(last, ["book", "chapter"], "caption", "section")


def dates(lines: DataFrame) -> DataFrame:
    """``| 2–3 | … |``: file, book, chapter, date_label for each chapter of the run; a book's last heading in a file, and of a chapter the last row, count."""
    rows = pipe_rows(lines).where("begun = newest").select("file", "line_no", "book", _cell(0).alias("spec"), _cell(1).alias("date_label"))
    runs = rows.where(F.col("spec").rlike(r"^\d{1,9}(\s*[–—-]\s*\d{1,9})?$") & F.col("date_label").isNotNull())
    return _latest(range_explode(runs, "spec"), ["file", "book", "chapter"], "date_label")


def _voiced(lines: DataFrame) -> DataFrame:
    end = lines.where(F.col("line").contains("## Judgment calls")).groupBy("file").agg(F.min("line_no").alias("__end"))
    told = lines.join(end, "file", "left")
    rows = pipe_rows(told.where(F.col("__end").isNull() | (F.col("line_no") < F.col("__end"))).drop("__end")).withColumn("at", _cell(0)).withColumn("voice", _cell(1)).where("voice is not null")
    form = r"^(.*?)\s+(\d{1,9})$"
    alone = F.col("at").rlike(r"^\d{1,9}$")
    return rows.where(alone | F.col("at").rlike(form)).select(
        "file", "line_no", F.when(alone, F.col("book")).otherwise(norm(F.regexp_extract("at", form, 1))).alias("book"), F.when(alone, _chapter(F.col("at"))).otherwise(F.regexp_extract("at", form, 2).try_cast("int")).alias("chapter"), "voice"
    )


def voices(lines: DataFrame) -> DataFrame:
    """``| 5 | Name |`` or ``| Book 1 | Name |``, up to the heading of judgment calls: file, book, chapter, voice, pos; of a chapter the last row counts."""
    return _latest(_voiced(lines).withColumn("pos", F.col("line_no")), ["file", "book", "chapter"], "voice", "pos")


def voices_in_order(lines: DataFrame) -> DataFrame:
    """The voices of each file where they are first named: file, voice, pos."""
    return _voiced(lines).groupBy("file", "voice").agg(F.min("line_no").alias("pos"))


def categories(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``| 8 | Category |``: file, line_no, book, chapter and the columns of ``known`` (name, …), whose names are met by their keys; others go.

    A book's last heading in a file counts, and there every row.
    """
    rows = pipe_rows(lines).where("begun = newest").select("file", "line_no", "book", _chapter(_cell(0)).alias("chapter"), norm(_cell(1)).alias("__key")).where("chapter is not null")
    return look_up(rows, known.withColumn("__key", norm(F.col("name"))), ["__key"]).drop("__key")


def related(lines: DataFrame) -> DataFrame:
    """``| **Book 12–14** | A · B |``: book, chapter, labels for each chapter of the run; of a chapter the last row of the last file counts.

    ``book`` is the key of the book that the spelling names, else of the spelling itself.
    """
    form, run = r"^\|\s*\*\*(.+?)\*\*\s*\|\s*(.+?)\s*\|$", r"^(.+?)\s+(\d{1,9}(?:\s*[–—-]\s*\d{1,9})?)$"
    own = lines.select("file", "line_no", _trim(F.col("line")).alias("line")).where(F.col("line").rlike(form))
    cut = own.select("file", "line_no", _trim(F.regexp_extract("line", form, 1)).alias("of"), F.filter(F.transform(F.split(F.regexp_extract("line", form, 2), "·", -1), _trim), lambda x: x != "").alias("labels"))
    named = cut.where(F.col("of").rlike(run) & (F.size("labels") > 0)).withColumn("raw", F.regexp_extract("of", run, 1)).withColumn("spec", F.regexp_extract("of", run, 2))
    keyed = resolved(named, "raw", "known").withColumn("book", norm(F.coalesce("known", "raw")))
    return _latest(range_explode(keyed, "spec"), ["book", "chapter"], "labels")


def facts(lines: DataFrame) -> DataFrame:
    """``* key: value`` lines: title, heading, part, key, value; keys may repeat."""
    pattern = r"^\*\s+(\w+):\s*(.*)$"
    return headed(lines).where(F.col("line").rlike(pattern)).select("file", "line_no", "title", "heading", "part", F.regexp_extract("line", pattern, 1).alias("key"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))


def bullets(lines: DataFrame) -> DataFrame:
    """``- a | b // c`` rows: cells of pieces, with their heading; also the row's lead and trailing reference."""
    body = F.regexp_replace("line", r"^-\s+", "")
    cells = F.transform(F.split(body, r"\s*\|\s*"), lambda c: F.split(c, r"\s*//\s*"))
    return headed(lines).where(F.col("line").rlike(r"^-\s+")).select("file", "line_no", "title", "heading", "part", cells.alias("cells"), split_title(body).alias("titled"), split_lead(body).alias("led"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs and quotes, broken at blank lines: title, heading, kind, text."""
    own = headed(lines).withColumn("blank", F.trim("line") == "").withColumn("quote", F.col("line").startswith(">"))
    plain = own.where(~F.col("line").rlike(r"^\s*(\||[-*]\s|</?(details|summary))"))
    para = F.sum(F.col("blank").cast("int")).over(_order())
    joined = plain.withColumn("para", para).where(~F.col("blank")).groupBy("file", "title", "heading", "para").agg(F.min("quote").alias("quote"), F.sort_array(F.collect_list(F.struct("line_no", F.regexp_replace("line", r"^>\s?", "").alias("t")))).alias("l"))
    return joined.select("file", "title", "heading", "para", F.when(F.col("quote"), "quote").otherwise("text").alias("kind"), F.array_join(F.col("l.t"), " ").alias("text"))


def figures(lines: DataFrame) -> DataFrame:
    """``# 1830 · Name`` pages: year, name, and the facts below as a map; of equal facts the last counts.  See ``records.figures`` for whole ones."""
    told = facts(lines).groupBy("file", "title", "key").agg(F.max_by("value", "line_no").alias("value"))
    mapped = told.groupBy("file", "title").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("facts"))
    return mapped.select("file", year_heading(F.col("title")).alias("h"), "facts").select("file", "h.year", "h.name", "facts")
