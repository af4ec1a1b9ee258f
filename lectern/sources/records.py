"""Written pages as nested records, one a page: charts, evidences, essays, prophets, shelves of works and figures.

Lines come as ``corpus.read_markdown`` gives them (file, line_no, line).  What a
line means depends on the lines above it; that state is carried by windows over a
file's lines, and the records are put together by grouping.  A file is a page of
prose, which bounds a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import credited, source_note, split_lead, split_ref, split_title, year_heading
from lectern.operators.joins import dealt, upto

#: Place of a page that names none.
LAST = 999
FACT = r"^\*\s*([A-Za-z]+)\s*:\s*(.+)$"


def _upto(*part: str):
    return Window.partitionBy("file", *part).orderBy("line_no")


def _before():
    return _upto().rowsBetween(Window.unboundedPreceding, -1)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines with their headings of three levels, if they are that; dealt by file, so that no task grows with the table."""
    own = dealt(lines.select("file", "line_no", "line"), "file").withColumn("line", _trim(F.col("line")))
    heads = {f"h{n}": F.when(F.col("line").rlike(rf"^#{{{n}}}\s+.+$"), _trim(F.regexp_extract("line", rf"^#{{{n}}}\s+(.+)$", 1))) for n in (1, 2)}
    heads["h3"] = F.when(F.col("line").rlike("^###"), _trim(F.regexp_extract("line", r"^###\s*(.*)$", 1)))
    return own.withColumns(heads).withColumn("slug", F.regexp_replace("file", r"\.md$", ""))


def _count(test: Column) -> Column:
    return F.sum(F.coalesce(test, F.lit(False)).cast("int"))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^-\s*", ""), r"\|", -1), _trim)


def _ordered(value: Column) -> Column:
    """The values of a group in the order of their lines, without nulls."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("line_no").alias("n"), value.alias("v"))))), lambda s: s["v"])


def _last(value: Column) -> Column:
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.col("line_no")))


def _fact(key: str) -> Column:
    return F.when(F.col("key") == key, F.col("value"))


def _with_facts(lines: DataFrame, keys: str = "") -> DataFrame:
    test = F.col("line").rlike(FACT)
    key = F.lower(F.regexp_extract("line", FACT, 1))
    if keys:
        test = test & key.isin(keys.split())
    return lines.withColumns({"key": F.when(test, key), "value": F.when(test, _trim(F.regexp_extract("line", FACT, 2)))})


def charts(lines: DataFrame) -> DataFrame:
    """Charts: slug, title, subtitle, volume, order, form, columns, widths, intro, parts of (name, prose, rows).

    A row is its cells, a cell its lines (``first // second``).  Rows before any
    ``##`` are one part without a name.  Blank lines end paragraphs.  The last of
    several equal facts counts; an order that is no number is null.
    """
    own = _with_facts(_lines(lines), "subtitle volume order form columns widths")
    row = F.col("key").isNull() & F.col("line").startswith("- ")
    own = own.withColumn("row", F.when(row, F.transform(_cells(F.col("line")), lambda c: F.filter(F.transform(F.split(c, "//", -1), _trim), lambda s: s != ""))))
    first = F.coalesce(_count(F.col("h2").isNotNull() | F.col("row").isNotNull()).over(_before()), F.lit(0)) == 0
    own = own.withColumn("part", _count(F.col("h2").isNotNull() | (F.col("row").isNotNull() & first)).over(_upto()))
    prose = F.col("h1").isNull() & F.col("h2").isNull() & F.col("key").isNull() & F.col("row").isNull()
    own = own.withColumn("prose", F.when(prose, F.col("line")))
    # One grouping reads the lines: of a part come its rows and prose, and the last of each fact with its line.
    facts = {"h1": F.col("h1")} | {k: _fact(k) for k in ("subtitle", "volume", "order", "form", "columns", "widths")}
    at = lambda v: F.max(F.when(v.isNotNull(), F.struct(F.col("line_no").alias("n"), v.alias("v"))))
    parts = own.groupBy("file", "slug", "part").agg(_last(F.col("h2")).alias("name"), _ordered(F.col("row")).alias("rows"), _ordered(F.col("prose")).alias("lines"), *[at(v).alias(f"f_{k}") for k, v in facts.items()])
    # A blank line is a break of two, other lines of a paragraph are one blank apart.
    text = F.array_join(F.filter(F.transform(F.split(F.array_join(F.transform("lines", lambda s: F.when(s == "", "\n\n").otherwise(s)), " "), "\n\n"), _trim), lambda p: p != ""), "\n\n")
    parts = parts.withColumn("text", text)
    fact = lambda k: F.max(f"f_{k}")["v"]
    listed = lambda k: F.coalesce(F.transform(F.split(fact(k), r"\|", -1), _trim), F.array().cast("array<string>"))
    order = fact("order")
    return parts.groupBy("file", "slug").agg(
        F.coalesce(fact("h1"), F.col("slug")).alias("title"), *[F.coalesce(fact(k), F.lit("")).alias(k) for k in ("subtitle", "volume")],
        F.when(order.isNull(), float(LAST)).otherwise(order.try_cast("double")).alias("order"), F.coalesce(fact("form"), F.lit("table")).alias("form"), listed("columns").alias("columns"), listed("widths").alias("widths"),
        F.coalesce(F.max(F.when(F.col("part") == 0, F.col("text"))), F.lit("")).alias("intro"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct("part", F.coalesce("name", F.lit("")).alias("name"), F.col("text").alias("prose"), "rows")))), lambda p: F.struct(p["name"].alias("name"), p["prose"].alias("prose"), p["rows"].alias("rows"))).alias("parts"),
    ).drop("file")


def evidences(lines: DataFrame) -> DataFrame:
    """Evidences: slug, title, subtitle, order, intro, forms of (name, form, gloss, note, items, groups of (title, root, lines, items)).

    An item is (label, text, ref, gloss): a ``tchart`` has labels, the other
    forms glosses, what an item lacks is null.  Facts and prose belong to the
    heading last seen; items to the group, or the form without one.
    """
    own = _with_facts(_lines(lines))
    own = own.withColumn("form", _count(F.col("h2").isNotNull()).over(_upto()))
    own = own.withColumn("h3", F.when(F.col("form") > 0, F.col("h3")))
    own = own.withColumn("group", F.coalesce(_count(F.col("h3").isNotNull()).over(_upto("form")), F.lit(0)))
    own = own.withColumn("target", F.coalesce(F.last(F.when(F.col("h1").isNotNull(), "page").when(F.col("h2").isNotNull(), "form").when(F.col("h3").isNotNull(), "group"), True).over(_upto()), F.lit("page")))
    head = F.col("h1").isNotNull() | F.col("h2").isNotNull() | F.col("h3").isNotNull()
    kind = F.when((F.col("target") == "form") & (F.col("key") == "form"), F.col("value"))
    own = own.withColumn("shape", F.coalesce(F.last(kind, True).over(_upto("form")), F.lit("phrases")))
    c = lambda n: F.coalesce(F.get(_cells(F.col("line")), F.lit(n)), F.lit(""))
    none = F.lit(None).cast("string")
    item = F.when(F.col("shape") == "tchart", F.struct(c(0).alias("label"), c(1).alias("text"), c(2).alias("ref"), none.alias("gloss"))).otherwise(F.struct(none.alias("label"), c(0).alias("text"), c(1).alias("ref"), c(2).alias("gloss")))
    is_item = ~head & F.col("key").isNull() & F.col("line").startswith("- ")
    own = own.withColumn("item", F.when(is_item & (F.col("form") > 0), item)).withColumn("prose", F.when(~head & F.col("key").isNull() & ~is_item & (F.col("line") != ""), F.col("line")))
    at = lambda where, value: F.when(F.col("target") == where, value)
    groups = own.where("form > 0").groupBy("file", "form", "group").agg(
        F.coalesce(_last(F.col("h3")), F.lit("")).alias("title"), F.coalesce(_last(at("group", _fact("root"))), F.lit("")).alias("root"), _ordered(at("group", F.col("prose"))).alias("lines"), _ordered(F.col("item")).alias("items")
    )
    no_items = F.array().cast(groups.schema["items"].dataType)
    in_forms = groups.groupBy("file", "form").agg(
        F.coalesce(F.max_by(F.when(F.col("group") == 0, F.col("items")), F.when(F.col("group") == 0, 1)), no_items).alias("items"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("group") > 0, F.struct("group", "title", "root", "lines", "items")))), lambda g: F.struct(g["title"].alias("title"), g["root"].alias("root"), g["lines"].alias("lines"), g["items"].alias("items"))).alias("groups"),
    )
    forms = own.where("form > 0").groupBy("file", "form").agg(
        _last(F.col("h2")).alias("name"), F.coalesce(_last(at("form", _fact("form"))), F.lit("phrases")).alias("kind"), F.coalesce(_last(at("form", _fact("gloss"))), F.lit("")).alias("gloss"), _trim(F.array_join(_ordered(at("form", F.col("prose"))), " ")).alias("note")
    )
    # Both have the same forms; joined by file, nothing is dealt anew.
    listed = lambda df, *fields: df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("form", *fields))).alias(fields[0]))
    field = lambda f, g: F.struct(f["name"].alias("name"), f["kind"].alias("form"), f["gloss"].alias("gloss"), f["note"].alias("note"), g["items"].alias("items"), g["groups"].alias("groups"))
    nested = listed(forms, "name", "kind", "gloss", "note").join(listed(in_forms, "items", "groups"), "file").select("file", F.zip_with("name", "items", field).alias("forms"))
    order = _last(at("page", _fact("order")))
    pages = own.groupBy("file", "slug").agg(
        F.coalesce(_last(F.col("h1")), F.col("slug")).alias("title"), F.coalesce(_last(at("page", _fact("subtitle"))), F.lit("")).alias("subtitle"),
        F.when(order.isNull(), float(LAST)).otherwise(order.try_cast("double")).alias("order"), _trim(F.array_join(_ordered(at("page", F.col("prose"))), " ")).alias("intro"),
    )
    return pages.join(nested, "file", "left").withColumn("forms", F.coalesce("forms", F.array().cast(nested.schema["forms"].dataType))).drop("file")


def essays(lines: DataFrame) -> DataFrame:
    """Essays: slug, order, title, subtitle, image, parts of (name, blocks of (kind, text, who, parts of (kind, text, source))).

    A block is a line of text, or a quote: what stands between ``<details>`` and
    ``</details>``, credited in its summary, said (``>``) or noted.  What comes
    before any ``##`` is a part without a name.  The file's name begins with its order.
    """
    own = _lines(lines).where("line <> ''").withColumn("h2", F.when(F.col("h1").isNull(), F.col("h2")))
    opens, closes = F.col("line") == "<details>", F.col("line") == "</details>"
    own = own.withColumn("quoting", F.coalesce(F.last(F.when(F.col("h2").isNotNull() | closes, False).when(opens, True), True).over(_upto()), F.lit(False)))
    head = F.col("h1").isNotNull() | F.col("h2").isNotNull()
    summary = F.col("line").rlike("^<summary>.*</summary>$") & F.col("quoting")
    image = F.col("line").rlike(r"(?i)^\*\s*image\s*:\s*.+$")
    block = ~head & ~closes & (opens | ~F.col("quoting"))
    begun = F.coalesce(_count(F.col("h2").isNotNull() | (block & ~image)).over(_before()), F.lit(0)) > 0
    own = own.withColumn("block_line", block & ~(image & ~begun)).withColumn("image", F.when(image & ~head & ~begun, _trim(F.regexp_extract("line", r"(?i)^\*\s*image\s*:\s*(.+)$", 1))))
    first = F.coalesce(_count(F.col("h2").isNotNull() | F.col("block_line")).over(_before()), F.lit(0)) == 0
    own = own.withColumn("part", _count(F.col("h2").isNotNull() | (F.col("block_line") & first)).over(_upto())).withColumn("nth", _count(F.col("block_line")).over(_upto()))
    shown = F.when(summary, _trim(F.regexp_replace(F.regexp_extract("line", "^<summary>(.*)</summary>$", 1), r"\s*<em>\(.*?\)</em>\s*$", "")))
    said = F.col("line").rlike("^>")
    words = _trim(F.regexp_replace("line", r"^>\s?", ""))
    none = F.lit(None).cast("string")
    piece = F.when(said, F.struct(F.lit("said").alias("kind"), source_note(words)["text"].alias("text"), source_note(words)["source"].alias("source"))).otherwise(F.struct(F.lit("note").alias("kind"), F.col("line").alias("text"), none.alias("source")))
    within = F.col("quoting") & ~opens & ~closes & ~head & ~summary
    own = own.withColumn("shown", shown).withColumn("piece", F.when(within, piece)).withColumn("plain", F.when(F.col("block_line") & ~opens, F.col("line"))).withColumn("opens", opens)
    blocks = own.where("part > 0").groupBy("file", "part", "nth").agg(F.max("opens").alias("quote"), F.max("block_line").alias("is_block"), _last(F.col("plain")).alias("plain"), _last(F.col("shown")).alias("shown"), _ordered(F.col("piece")).alias("pieces")).where("is_block")
    shown = credited(F.coalesce("shown", F.lit("")))
    text, who = F.when(F.col("quote"), shown["text"]).otherwise(F.col("plain")), F.when(F.col("quote"), shown["who"])
    block = F.struct(F.col("nth"), F.when(F.col("quote"), "quote").otherwise("text").alias("kind"), text.alias("text"), who.alias("who"), F.col("pieces").alias("parts"))
    strip = lambda b: F.struct(*[b[c].alias(c) for c in ("kind", "text", "who", "parts")])
    filled = blocks.groupBy("file", "part").agg(F.transform(F.array_sort(F.collect_list(block)), strip).alias("blocks"))
    named = own.where("part > 0").groupBy("file", "part").agg(F.coalesce(_last(F.col("h2")), F.lit("")).alias("name")).join(filled, ["file", "part"], "left")
    named = named.withColumn("blocks", F.coalesce("blocks", F.array().cast(filled.schema["blocks"].dataType)))
    nested = named.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "name", "blocks"))), lambda p: F.struct(p["name"].alias("name"), p["blocks"].alias("blocks"))).alias("parts"))
    h1, split = _last(F.col("h1")), r"^([^:]+):\s*(.+)$"
    title = F.when(h1.rlike(split), _trim(F.regexp_extract(h1, split, 1))).otherwise(h1)
    number = F.nullif(F.regexp_extract("slug", r"^(\d+)-", 1), F.lit(""))
    slug = F.concat(F.lit("translation-"), F.regexp_replace("slug", r"^\d+-", ""))
    pages = own.groupBy("file", "slug").agg(F.coalesce(title, slug).alias("title"), F.coalesce(_trim(F.regexp_extract(h1, split, 2)), F.lit("")).alias("subtitle"), F.coalesce(_last(F.col("image")), F.lit("")).alias("image"))
    whole = pages.join(nested, "file", "left").withColumn("parts", F.coalesce("parts", F.array().cast(nested.schema["parts"].dataType)))
    return whole.select(slug.alias("slug"), F.coalesce(number.cast("int"), F.lit(LAST)).alias("order"), "title", "subtitle", "image", "parts")


# The sections of a prophet's page, and the field that each fills.
SECTIONS = {"quotes": "quotes", "roles": "roles", "key teachings": "teachings", "key chapters": "chapters", "timeline": "timeline"}


def prophets(lines: DataFrame) -> DataFrame:
    """Prophets: file, nth, name, quotes of (text, ref, said), roles, teachings, chapters, timeline of (lead, rest).

    Bullets under sections that are not known go; so does a heading that has
    nothing under it, as a file's title.
    """
    own = _lines(lines).withColumn("nth", _count(F.col("h1").isNotNull()).over(_upto())).where("nth > 0")
    known = F.create_map(*[F.lit(x) for p in SECTIONS.items() for x in p])
    named = F.when(F.col("h2").isNotNull(), F.coalesce(F.try_element_at(known, F.lower("h2")), F.lit("")))
    own = own.withColumn("key", F.last(named, True).over(_upto("nth")))
    bullet = r"^[*-]\s+(.+)$"
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("line", bullet, 1), r"\*\*(.+?)\*\*", "$1"), "`([^`]+)`", "$1")
    held = own.where(F.col("h1").isNull() & F.col("h2").isNull() & F.col("line").rlike(bullet) & (F.col("key") != "")).withColumn("text", text)
    cited, led = split_ref(F.col("text")), split_lead(F.col("text"))
    unquoted = _trim(F.regexp_replace(cited["text"], '^["“]|["”]$', ""))
    at = lambda key, value: F.when(F.col("key") == key, value)
    rows = held.groupBy("file", "nth").agg(
        _ordered(at("quotes", F.struct(unquoted.alias("text"), cited["ref"].alias("ref"), cited["said"].alias("said")))).alias("quotes"),
        *[_ordered(at(k, F.col("text"))).alias(k) for k in ("roles", "teachings", "chapters")],
        _ordered(at("timeline", led)).alias("timeline"),
    )
    names = own.where("h1 is not null").select("file", "nth", F.col("h1").alias("name"))
    return names.join(rows, ["file", "nth"])


def resources(lines: DataFrame) -> DataFrame:
    """Shelves of works: slug, shelves of (title, works of (title, author, detail, cover, links of (label, href), body)).

    ``##`` opens a shelf, ``###`` a work on it; what stands outside a work goes, as
    do shelves without one and links that lead nowhere.  Links may repeat, of the
    other facts the last counts.  A file without a work gives no row.
    """
    own = _with_facts(_lines(lines), "author detail cover link")
    own = own.withColumn("shelf", _count(F.col("h2").isNotNull()).over(_upto()))
    title = F.when(F.col("line").rlike(r"^###\s+.+$") & (F.col("shelf") > 0), _trim(F.regexp_extract("line", r"^###\s+(.+)$", 1)))
    own = own.withColumn("title", title).withColumn("work", F.coalesce(_count(F.col("title").isNotNull()).over(_upto("shelf")), F.lit(0)))
    pieces = F.transform(F.split("value", r"\|", -1), _trim)
    link = F.when((F.col("key") == "link") & (F.get(pieces, F.lit(1)) != ""), F.struct(F.get(pieces, F.lit(0)).alias("label"), F.get(pieces, F.lit(1)).alias("href")))
    body = F.when(F.col("title").isNull() & F.col("key").isNull() & (F.col("line") != ""), F.col("line"))
    own = own.withColumns({"link": link, "body": body})
    works = own.where("shelf > 0 and work > 0").groupBy("file", "slug", "shelf", "work").agg(
        _last(F.col("title")).alias("title"), *[F.coalesce(_last(_fact(k)), F.lit("")).alias(k) for k in ("author", "detail", "cover")], _ordered(F.col("link")).alias("links"), F.array_join(_ordered(F.col("body")), " ").alias("body")
    )
    fields = ["title", "author", "detail", "cover", "links", "body"]
    shelved = works.groupBy("file", "slug", "shelf").agg(F.transform(F.array_sort(F.collect_list(F.struct("work", *fields))), lambda w: F.struct(*[w[c].alias(c) for c in fields])).alias("works"))
    named = own.where("h2 is not null").select("file", "shelf", F.col("h2").alias("title")).join(shelved, ["file", "shelf"])
    return named.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("shelf", "title", "works"))), lambda s: F.struct(s["title"].alias("title"), s["works"].alias("works"))).alias("shelves"))


def figures(lines: DataFrame) -> DataFrame:
    """Figures: file, nth, year, name, years, role, image, body.

    ``# 1830 · Name`` opens one, any other ``#`` heading ends it; rules go.  One
    without a body is none.  ``nth`` counts the file's headings.
    """
    own = upto(_with_facts(_lines(lines), "years role image"), "file", ["line_no"], sums={"nth": F.col("h1").isNotNull().cast("int")}).where("nth > 0")
    own = own.withColumn("h", year_heading(F.col("h1")))
    body = F.when(F.col("h1").isNull() & F.col("key").isNull() & (F.col("line") != "---"), F.col("line"))
    told = own.groupBy("file", "nth").agg(
        F.max("h.year").alias("year"), F.max("h.name").alias("name"), *[F.coalesce(_last(_fact(k)), F.lit("")).alias(k) for k in ("years", "role", "image")], _trim(F.array_join(_ordered(body), "\n")).alias("body")
    )
    return told.where("year is not null and name is not null and body <> ''")


def samples(evidence: DataFrame) -> DataFrame:
    """What stands for each form of evidences: slug, nth, form, lines (text, ref), ref, one_quote.

    A ladder shows four rungs of its first group with the reference of its
    title, a chart two items of its first group that has several, else of its
    first, a wordplay the first item of its first group, the others their first
    item.  A form without any gives nothing.
    """
    forms = evidence.select("slug", F.posexplode("forms").alias("nth", "f"))
    group, item = F.get("f.groups", F.lit(0)), lambda items: F.transform(items, lambda i: F.struct(i["text"].alias("text"), i["ref"].alias("ref")))
    several = F.coalesce(F.get(F.filter("f.groups", lambda g: F.size(g["items"]) > 1), F.lit(0)), group)
    none = F.lit(None).cast("string")
    lines = (
        F.when(F.col("f.form") == "ladder", F.transform(F.slice(group["lines"], 1, 4), lambda t: F.struct(t.alias("text"), none.alias("ref"))))
        .when(F.col("f.form") == "tchart", item(F.slice(several["items"], 1, 2)))
        .when(F.col("f.form") == "wordplay", item(F.slice(group["items"], 1, 1)))
        .otherwise(item(F.slice("f.items", 1, 1)))
    )
    ladder = F.col("f.form") == "ladder"
    shown = forms.where(group.isNotNull() | ~F.col("f.form").isin("ladder", "tchart")).select("slug", "nth", F.col("f.form").alias("form"), lines.alias("lines"), F.when(ladder, split_title(group["title"])["ref"]).alias("ref"), ladder.alias("one_quote"))
    return shown.where(F.col("form").isin("ladder", "tchart") | (F.size("lines") > 0))
