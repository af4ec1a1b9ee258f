"""Scanned pages made into an edition: verse blocks, cleaning, and their places in the chapters of a guide.

A guide is a text of which only the order and the words are used: it says where
a block belongs and what is a word, none of it is written out.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lectern.sources.stored import staged

from .align import GAP, align, bag_similarity, classify
from .joins import look_up, numbered

# What a line looks like that begins a chapter, a section or a book.
HEADINGS = [
    r"(?i)^CHAPT[A-Z0-9]{0,3}R?\s+([0-9]+|[IVXYL]{1,6})\.?[^a-z]*$",
    r"(?i)^THE\s+(FIRST|SECOND|THIRD|FOURTH)?\s*BOOK\s+O[FP]",
    r"(?i)^THE\s+WORDS\s+OF\s+MORMON",
    r"(?i)^(THIRD|FOURTH)\s+NEPHI",
    r"(?i)^WRITINGS\s+OF\s+JOSEPH\s+SMITH",
    r"(?i)^THE\s+ARTICLES\s+O[FP]\s+[EF]AITH",
    r"(?i)^SECTION\s+([0-9]+|[IVXLC]+)\.?[^a-z]*$",
]
# Fixed value: a verse's number and text.
VERSE = r"^([0-9]{1,3})\s*[.,;:]\s+(.*)$"
# Names that a running head prints, and words whose first letter is often read as a capital.
HEAD_NAMES = ["NEPHI", "JACOB", "ENOS", "JAROM", "OMNI", "MORMON", "MOSIAH", "ALMA", "HELAMAN", "ETHER", "MORONI", "MOSES", "ABRAHAM", "GENESIS", "MATTHEW", "THE BOOK OF"]
LOWERED = ["It", "In", "Is", "If", "Into", "Shalt", "Unto", "Shall"]
# Readings that are no words, with what the page has.
MISREADINGS = {
    "NephI": "Nephi", "LamanItes": "Lamanites", "Lamanltes": "Lamanites", "Jesns": "Jesus", "Ood": "God", "Gk": "God", "Grod": "God", "tbe": "the", "tlie": "the", "tho": "the", "aud": "and", "aiid": "and",
    "flUed": "filled", "bodIes": "bodies", "boW": "bow", "doWn": "down", "smaU": "small", "swaUowed": "swallowed", "behoM": "behold", "whicA": "which", "whItJh": "which", "tJhe": "the", "thJe": "the",
    "cTannot": "cannot", "inBomuch": "insomuch", "aflBictions": "afflictions", "justlfletB": "justifieth", "temptAtlon": "temptation", "sufCerIng": "suffering", "coD8istlng": "consisting",
    "engrayingB": "engravings", "dlBsensions": "dissensions", "increasB": "increase", "envyIngs": "envyings", "deBtruction": "destruction", "decFared": "declared", "difUcuIt": "difficult", "eplBtle": "epistle",
    "provislonR": "provisions", "unquencJhable": "unquenchable", "stuSied": "studied", "thBft": "theft", "IncluHlve": "inclusive", "judgmLcnts": "judgments", "suflSce": "suffice", "suflScient": "sufficient",
    "chain8": "chains", "record8": "records", "l3st": "last", "U8": "us", "An4": "And", "m7": "my", "sa5dng": "saying", "wTitten": "written", "2ofFend": "offend",
    "MantI": "Manti", "AbinadI": "Abinadi", "AmuIon": "Amulon", "CumenI": "Cumeni", "MoToni": "Moroni", "AmalekItes": "Amalekites", "AmulonItes": "Amulonites", "GospeP": "Gospel",
    "theLamanites": "the Lamanites", "theNephites": "the Nephites", "NowAmmon": "Now Ammon", "wereMulek": "were Mulek", "NewYork": "New York", "OliverCowdery": "Oliver Cowdery",
    "AndafterI": "And after I", "andalsoZarahemla": "and also Zarahemla", "yehavedonegreater": "ye have done greater",
}
# Short words that the apparatus is read as, and what stands for a verse that a scan or an edition lacks.
NOISE = "vers?|chap|see|sec|sea|lee|ice|noe|tee|aee|nee|bee|soo|mo|wo|we|me"
MISSING, ABSENT = "[not legible in the page scan]", "[not in this edition]"
# Blocks beyond a chapter's verses that are looked at; a run's least words and what its removal must gain.
SPARE, LEAST, GAIN = 6, 4, 0.02

#: Chapters that a cursor lets wait before it places them.  ``WARM`` is no longer read; tests set it.
SPLIT, WARM = 32, 2


def body(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Lines (file, line_no, line) from a file's first that matches ``start`` to before the first later one that matches ``end``, or to its end.

    A file without a start has none.
    """
    from_ = lines.where(F.col("line").rlike(start)).groupBy("file").agg(F.min("line_no").alias("from"))
    own = lines.join(from_, "file").where(F.col("line_no") >= F.col("from"))
    to = own.where((F.col("line_no") > F.col("from")) & F.col("line").rlike(end)).groupBy("file").agg(F.min("line_no").alias("to"))
    return own.join(to, "file", "left").where(F.col("to").isNull() | (F.col("line_no") < F.col("to"))).select(*lines.columns)


def without_running_heads(lines: DataFrame, least: int = 3, edge: int = 2) -> DataFrame:
    """Lines (file, page, line_no, line) without those that stand among the first or last ``edge`` of ``least`` pages of their file.

    Figures, case and punctuation aside; blank lines and bare figures are never heads.
    """
    form = F.trim(F.regexp_replace(F.upper("line"), r"[^\p{L}]+", " "))
    filled = lines.where(form != "").withColumn("form", form)
    page = Window.partitionBy("file", "page")
    at_edge = (F.row_number().over(page.orderBy("line_no")) <= edge) | (F.row_number().over(page.orderBy(F.desc("line_no"))) <= edge)
    edges = filled.withColumn("at_edge", at_edge).where("at_edge")
    heads = edges.groupBy("file", "form").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least)
    gone = edges.join(heads, ["file", "form"], "left_semi").select("file", "page", "line_no")
    return lines.join(gone, ["file", "page", "line_no"], "left_anti").select(*lines.columns)


def tidy(text: Column, heads: list[str] | None = None, misreadings: dict[str, str] | None = None) -> Column:
    """A scanned verse without stray glyphs, running heads, hanging hyphens and fused figures, with known misreadings mended."""
    end = "(?![A-Za-z0-9_])"
    text = F.regexp_replace(text, "[“”\"'‘’*^|■□•«»]+", "")
    text = F.regexp_replace(text, rf"(?U)\s\b(?:{'|'.join(HEAD_NAMES if heads is None else heads)})\.(?=\s)", "")
    text = F.regexp_replace(text, r"(?U)(^|\s)-(?=[a-z])", "$1")
    # Words within a sentence are marked in one pass, then lowered one by one.
    text = F.regexp_replace(text, rf"(?U)([^.!?:;]\s+)({'|'.join(LOWERED)}){end}", "$1\u0001$2")
    for word in LOWERED:
        text = F.regexp_replace(text, f"\u0001{word}{end}", word.lower())
    text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_])0{end}", "O")
    text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_])[0-9]([a-z]{{2,}}){end}", "$1")
    mended = F.create_map(*[F.lit(x) for pair in (MISREADINGS if misreadings is None else misreadings).items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    text = F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(mended, t), t)), "")
    text = F.regexp_replace(text, r"(?U)\s+([,.;:])", "$1")
    return _even(text)


def _even(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def scan_blocks(lines: DataFrame) -> DataFrame:
    """Verse blocks of scanned lines (file, line_no, line): file, block (from 0), number, text.

    What a line is is asked before its number.  A block opens at a numbered
    line and closes at the next or at a heading; from a line of apparatus on
    nothing is read until the page turns (a head), or a heading or a number
    comes.  A word that was divided at a line's end is joined.  One window a
    file, the unit of a scan.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    own = lines.select("file", "line_no", _even(F.col("line")).alias("line"), classify(F.col("line")).alias("kind"))
    is_text, heading = F.col("kind").isNull(), F.lit(False)
    for pattern in HEADINGS:
        heading = heading | F.col("line").rlike(pattern)
    own = own.withColumn("heading", is_text & heading)
    own = own.withColumn("opens", is_text & ~F.col("heading") & F.col("line").rlike(VERSE))
    turned = (F.col("kind") == "head") | F.col("heading") | F.col("opens")
    own = own.select(
        "file", "line_no", "line", "kind", "heading", "opens",
        F.last(F.when(F.col("kind") == "apparatus", True).when(turned, False), True).over(order).alias("apparatus"),
        F.last(F.when(F.col("heading"), False).when(F.col("opens"), True), True).over(order).alias("open"),
        F.sum(F.col("opens").cast("int")).over(order).alias("nth"),
    )
    kept = own.where(is_text & ~F.col("heading") & F.col("open") & ~F.coalesce("apparatus", F.lit(False)))
    text = F.when(F.col("opens"), F.regexp_extract("line", VERSE, 2)).otherwise(F.col("line"))
    joined = kept.groupBy("file", "nth").agg(F.sort_array(F.collect_list(F.struct("line_no", text.alias("text")))).alias("l"), F.first(F.when(F.col("opens"), F.regexp_extract("line", VERSE, 1).cast("int")), True).alias("number"))
    whole = F.aggregate(F.slice("l.text", 2, F.greatest(F.size("l") - 1, F.lit(1))), F.element_at("l.text", 1), lambda a, s: F.when(a.endswith("-"), F.concat(F.regexp_replace(a, "-$", ""), s)).otherwise(F.concat(a, F.lit(" "), s)))
    found = joined.withColumn("text", whole).where(_even(F.col("text")) != "")
    numbered = found.withColumn("block", F.row_number().over(Window.partitionBy("file").orderBy("nth")) - 1)
    return numbered.select("file", "block", "number", tidy(F.col("text")).alias("text"))


def vocabulary(guide: DataFrame) -> DataFrame:
    """Distinct words of a guide's texts."""
    return guide.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


def unfuse(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``text`` of (id, text) without the footnote keys that stick to words.

    A token that opens with a figure, or with a small letter before a capital,
    and is no word, gives up its one to three first characters: as few as leave
    a word.  Ordinals stay; a doubled ``wT`` or ``w7`` becomes ``w`` where that
    makes a word.  Distinct tokens and their rests are looked up, not texts.
    """
    parts = F.regexp_extract_all("text", F.lit("[0-9A-Za-z_]+|[^0-9A-Za-z_]+"), F.lit(0))
    keyed = lambda t: t.rlike("^[0-9A-Za-z]{3,}$") & t.rlike("^([0-9]|[a-z][A-Z]|w[T7][a-z])") & ~t.rlike("(?i)^[0-9]{1,4}(st|nd|rd|th)$")
    asked = staged(texts.select("id", F.explode(F.array_distinct(F.filter(parts, keyed))).alias("token")), "keyed")
    # The token itself first: if it is a word, it stays.
    doubled = F.col("token").rlike("^w[T7]")
    whole = F.struct(F.lit(0).alias("cut"), F.col("token").alias("rest"))
    cuts = F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("token") - 2)), lambda n: F.struct(n.alias("cut"), F.substr("token", n + 1).alias("rest")))
    w = F.array(F.struct(F.lit(1).alias("cut"), F.concat(F.lit("w"), F.substr("token", F.lit(3))).alias("rest")))
    options = asked.select("token").distinct().select("token", F.explode(F.concat(F.array(whole), F.when(doubled, w).otherwise(cuts))).alias("o")).select("token", "o.cut", "o.rest")
    options = options.where((F.col("cut") == 0) | doubled | F.col("rest").rlike("^[A-Za-z]{3,}$")).withColumn("word", F.lower("rest"))
    mended = look_up(options, vocab.select("word").distinct(), ["word"]).groupBy("token").agg(F.min_by("rest", "cut").alias("rest")).where("token <> rest")
    by_text = look_up(asked, mended, ["token"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "rest"))).alias("mended"))
    said = F.when(F.col("mended").isNull(), F.col("text")).otherwise(F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at("mended", t), t)), ""))
    return texts.join(by_text, "id", "left").select("id", said.alias("text"))


def furniture(token: Column) -> Column:
    """Whether a token of a scan looks like apparatus: figures, letters by ones to threes, the scan's own marks, names cut short."""
    bare = F.regexp_replace(token, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "")
    shapes = [r"^[0-9]*$", r"^[0-9]+[:.\-][0-9]*$", "^[A-Za-z]{1,3}$", "^[0-9]{0,2}[A-Za-z]{1,2}[0-9]{0,2}$", rf"(?i)^(?:{NOISE})\.?$"]
    out = token.rlike(r"[^\x20-\x7E]")
    for shape in shapes:
        out = out | bare.rlike(shape)
    return out | (bare.rlike(r"^(?:[0-9]\s*)?[A-Z][a-z]{0,4}$") & token.rlike("[.,]$"))


def strip_apparatus(pairs: DataFrame, vocab: DataFrame, least: int = LEAST, gain: float = GAIN) -> DataFrame:
    """``scan`` of (id, text, scan) without runs of apparatus whose removal brings it nearer to ``text``.

    A run of furniture gives back the words of the vocabulary at its two ends;
    ``least`` tokens that are left, with text after them, are taken out if the
    likeness gains over ``gain`` by it.  Of several runs that go the nearest is
    taken, until none goes.  A null text takes nothing out, nor a null scan.
    """
    tokens = F.split("scan", r"(?U)\s+", -1)
    # What is furniture is asked of each token once: the tests are many.
    split = staged(pairs.select("id", "text", "scan", F.transform(tokens, furniture).alias("noise")), "noise").withColumn("tokens", tokens)
    word = lambda t: F.lower(F.regexp_replace(t, "[^A-Za-z]", ""))
    noisy = F.transform(F.filter(F.arrays_zip("tokens", "noise"), lambda t: t["noise"]), lambda t: word(t["tokens"]))
    asked = split.select("id", F.explode(F.array_distinct(F.filter(noisy, lambda w: w != ""))).alias("word"))
    known = look_up(asked, vocab.select("word").distinct(), ["word"]).groupBy("id").agg(F.collect_list("word").alias("known"))
    told = split.join(known, "id", "left")
    real = F.transform("tokens", lambda t: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), word(t)))
    runs = told.select("id", "text", "scan", "tokens", "noise", real.alias("real"))

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scans = [s if t is None or s is None else stripped(t, s, list(w), list(n), list(r), least, gain) for t, s, w, n, r in zip(b["text"], b["scan"], b["tokens"], b["noise"], b["real"])]
            yield pd.DataFrame({"id": b["id"], "text": b["text"], "scan": scans})

    return runs.mapInPandas(strip, T.StructType([runs.schema["id"], runs.schema["text"], runs.schema["scan"]]))


def _words(text: str) -> list[str]:
    return "".join(c if "a" <= c <= "z" else " " for c in text.lower()).split()


def stripped(text: str, scan: str, tokens: list[str], noise: list[bool], real: list[bool], least: int, gain: float) -> str:
    """``scan`` without its apparatus: for each token whether it looks like that and whether it is a word."""
    want = Counter(_words(text))
    n_want = want.total()
    while True:
        have = Counter(w for t in tokens for w in _words(t))
        n_have, hits = have.total(), (want & have).total()
        like = lambda hits, n: 2 * hits / (n_want + n) if n and n_want else 0.0
        best, found, i = like(hits, n_have), None, 0
        while i < len(tokens):
            if not noise[i]:
                i += 1
                continue
            j = i
            while j < len(tokens) and noise[j]:
                j += 1
            a, b = i, j
            while a < b and real[a]:
                a += 1
            while b > a and real[b - 1]:
                b -= 1
            if b - a >= least and b < len(tokens):
                out = Counter(w for t in tokens[a:b] for w in _words(t))
                lost = sum(min(want[w], have[w]) - min(want[w], have[w] - k) for w, k in out.items())
                score = like(hits - lost, n_have - out.total())
                if score > best + gain:
                    best, found = score, (a, b)
            i = j
        if not found:
            return scan
        a, b = found
        tokens, noise, real = tokens[:a] + tokens[b:], noise[:a] + noise[b:], real[:a] + real[b:]
        scan = " ".join(tokens)


def _chapters(guide: DataFrame) -> DataFrame:
    """Chapters of (volume, chapter, verse, ...) with their place in the volume, verses, and the verses before them."""
    slots = numbered(guide.select("volume", "chapter", "verse"), ["volume", "chapter", "verse"], "slot")
    counted = slots.groupBy("volume", "chapter").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("slot"))
    places = staged(numbered(counted, ["volume", "chapter"], "place"), "places")
    first = places.groupBy("volume").agg(F.min("place").alias("first"), F.min("slot").alias("first_slot"))
    return look_up(places, first, ["volume"]).select("volume", "chapter", (F.col("place") - F.col("first")).alias("pos"), "n", (F.col("slot") - F.col("first_slot")).alias("before"))


def _cursor(batches: Iterator[pd.DataFrame], spare: int, gap: float) -> Iterator[pd.DataFrame]:
    """Slots with their blocks, from rows of both in the order of their volume: a chapter is placed as soon as all that it may see has come."""
    columns = ["volume", "chapter", "verse", "block"]
    volume, waiting, texts, at, seen, out = None, deque(), {}, 0, 0, []

    def placed(whole: bool) -> None:
        """Chapters that wait, without the last, which may have more verses to come, unless the volume is whole."""
        nonlocal at
        while waiting and (whole or (len(waiting) > 1 and at + len(waiting[0][1]) + spare <= seen)):
            chapter, verses = waiting.popleft()
            window = []
            while len(window) < len(verses) + spare and at + len(window) in texts:
                window.append(texts[at + len(window)])
            got = align([t for _, t in verses], window, gap)
            out.extend((volume, chapter, v, at + j if j >= 0 else None) for (v, _), j in zip(verses, got))
            for _ in range(max(got, default=-1) + 1):
                del texts[at]
                at += 1

    frame = lambda: pd.DataFrame(out, columns=columns).astype({"block": "Int64"})
    for b in batches:
        for of, chapter, verse, block, text in zip(b["volume"], b["chapter"], b["verse"], b["block"].astype("Int64"), b["text"]):
            if of != volume:
                placed(True)
                volume, waiting, texts, at, seen = of, deque(), {}, 0, 0
            if block is not pd.NA:
                if block >= at:
                    texts[block] = text or ""
                seen = block + 1
            elif waiting and waiting[-1][0] == chapter:
                waiting[-1][1].append((verse, text or ""))
            else:
                waiting.append((chapter, [(verse, text or "")]))
                if len(waiting) > SPLIT:
                    placed(False)
        placed(False)
        yield frame()
        out.clear()
    placed(True)
    yield frame()


def place(guide: DataFrame, blocks: DataFrame, spare: int = SPARE, gap: float = GAP) -> DataFrame:
    """The block at each slot of a guide: volume, chapter, verse, block (null where there is none).

    ``guide`` is (volume, chapter, verse, text), ``blocks`` (volume, block from
    0, text).  A cursor runs over a volume's blocks: each chapter is aligned with
    those from where the chapter before it ended, as many as its verses and
    ``spare`` more.  Where a chapter begins hangs on all before it, so a volume
    is read once, by one task, as a stream in which slots and blocks come in
    step: the task holds the blocks that came and that the cursor has not passed.
    """
    chapters = staged(_chapters(guide), "chapters")
    sizes = chapters.groupBy("volume").agg(F.sum("n").alias("slots")).join(blocks.groupBy("volume").agg((F.max("block") + 1).alias("blocks")), "volume", "left")
    volumes = sizes.count()
    if not volumes:
        return guide.select("volume", "chapter", "verse", F.lit(None).cast("long").alias("block"))
    types = {f.name: f.dataType for f in guide.schema}
    none = lambda name: F.lit(None).cast(types[name]).alias(name)
    slots = guide.join(chapters, ["volume", "chapter"]).select("volume", F.col("before").cast("double").alias("step"), "chapter", "verse", F.lit(None).cast("long").alias("block"), "text")
    step = F.col("block") * F.col("slots") / F.col("blocks")
    found = look_up(blocks, sizes, ["volume"]).select("volume", step.cast("double").alias("step"), none("chapter"), none("verse"), F.col("block").cast("long").alias("block"), "text")
    stream = slots.unionByName(found).repartitionByRange(volumes, "volume").sortWithinPartitions("volume", "step", F.col("block").isNull(), "verse", "block")
    schema = T.StructType([*(guide.schema[c] for c in ("volume", "chapter", "verse")), T.StructField("block", T.LongType())])
    return stream.mapInPandas(lambda batches: _cursor(batches, spare, gap), schema)


def edition(guide: DataFrame, blocks: DataFrame, sections: bool = False, spare: int = SPARE) -> DataFrame:
    """The scan's verses in the guide's order: volume, chapter, verse, block, status, text.

    Status is ``placed``, ``missing`` (a gap, with a placeholder for a text) or,
    for ``sections``, ``absent`` where a whole chapter has no block.  Texts lose
    the apparatus within them and the keys that stick to their words.
    """
    vocab = staged(vocabulary(guide), "vocabulary")
    placed = place(guide, blocks, spare).join(blocks.select("volume", F.col("block").cast("long").alias("block"), F.col("text").alias("scan")), ["volume", "block"], "left")
    placed = placed.join(guide.select("volume", "chapter", "verse", "text"), ["volume", "chapter", "verse"]).withColumn("id", F.struct("volume", "chapter", "verse"))
    placed = staged(placed, "edition")
    clean = strip_apparatus(placed.where("block is not null").select("id", "text", "scan"), vocab).select("id", F.col("scan").alias("text"))
    clean = unfuse(staged(clean, "stripped"), vocab).withColumnRenamed("text", "said")
    empty = placed.groupBy("volume", "chapter").agg((F.count("block") == 0).alias("empty"))
    whole = placed.join(clean, "id", "left").join(empty, ["volume", "chapter"])
    status = F.when(F.col("block").isNotNull(), "placed").when(F.col("empty") & F.lit(sections), "absent").otherwise("missing")
    text = F.when(status == "placed", F.col("said")).when(status == "absent", ABSENT).otherwise(MISSING)
    return whole.select("volume", "chapter", "verse", "block", status.alias("status"), text.alias("text"))


def edition_report(guide: DataFrame, made: DataFrame, least: float = 0.9) -> DataFrame:
    """By volume: verses expected, placed, missing and absent, the chapters that are absent, the mean likeness of what was placed, and how many are below ``least``."""
    key = ["volume", "chapter", "verse"]
    both = made.where("status = 'placed'").select(*key, F.col("text").alias("said")).join(guide.select(*key, "text"), key)
    like = bag_similarity(both, key, "text", "said")
    counted = made.join(like, key, "left").groupBy("volume").agg(
        F.count(F.lit(1)).alias("expected"), *[F.count_if(F.col("status") == s).alias(s) for s in ("placed", "missing", "absent")],
        F.countDistinct(F.when(F.col("status") == "absent", F.col("chapter"))).alias("absent_chapters"), F.round(F.avg("similarity"), 4).alias("likeness"), F.count_if(F.col("similarity") < least).alias("low"),
    )
    return counted
