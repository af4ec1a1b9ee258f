"""Coverage, gaps, unknown keys, and scored look-ups of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import flatten_title, norm, speaker_name

from .joins import look_up


def coverage(expected: DataFrame, present: DataFrame, group: str, key: list[str]) -> DataFrame:
    """Expected and matched keys of each group, percent to the nearest whole, and a bar of twenty cells, one for each five percent."""
    found = expected.join(present.select(*key).distinct().withColumn("__has", F.lit(1)), key, "left")
    counted = found.groupBy(group).agg(F.count(F.lit(1)).alias("expected"), F.count("__has").alias("matched"))
    percent = F.floor(100.0 * F.col("matched") / F.col("expected") + 0.5).cast("int")
    return counted.withColumn("percent", percent).withColumn("bar", F.rpad(F.repeat(F.lit("█"), F.floor(F.col("percent") / 5.0 + 0.5).cast("int")), 20, "·"))


def supplied(summaries: DataFrame, books: DataFrame) -> DataFrame:
    """Summaries (book, chapter as text, text) with what is wrong with each: ``unknown`` book, ``range``, ``empty``, or null; volume_id of known books.

    ``books`` are (book, volume_id, chapters).  A chapter that is no whole
    number of the book's is out of range; a text of blanks is empty.
    """
    number = F.when(F.col("chapter").rlike(r"^\s*[0-9]+\s*$"), F.trim("chapter").try_cast("int"))
    told = look_up(summaries, books.select("book", "volume_id", "chapters"), ["book"], "left")
    fits = F.coalesce(number.between(1, F.col("chapters")), F.lit(False))
    blank = ~F.coalesce("text", F.lit("")).rlike(r"(?U)\S")
    wrong = F.when(F.col("chapters").isNull(), "unknown").when(~fits, "range").when(blank, "empty")
    return told.withColumn("wrong", wrong).drop("chapters")


def gaps(expected: DataFrame, placed: DataFrame, key: list[str]) -> DataFrame:
    """Expected keys that nothing was placed at."""
    return expected.join(placed.select(*key), key, "left_anti")


def mismatches(counts: DataFrame, dim: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose count (n) is not the expected (verse_count)."""
    return counts.join(dim, key).where("n <> verse_count")


def nearest_by_prefix(names: DataFrame, known: DataFrame) -> DataFrame:
    """For each name the known name with the longest common beginning, then the first by name.

    Beginnings of every length are an equi-join, so no two tables meet pair by pair.
    """
    heads = lambda df, c: df.select(c, F.explode(F.expr(f"transform(sequence(1, length({c})), n -> substring(lower({c}), 1, n))")).alias("head"))
    best = heads(known, "known").groupBy("head").agg(F.min("known").alias("known"))
    both = heads(names.where("name <> ''"), "name").join(best, "head")
    return both.groupBy("name").agg(F.min_by("known", F.struct(-F.length("head"), "known")).alias("known"), F.max(F.length("head")).alias("shared"))


def longest_suffix(titles: DataFrame, known: DataFrame) -> DataFrame:
    """For each title the known name with which it ends, the longest if several; letters and digits alone count."""
    ends = titles.withColumn("f", flatten_title(F.col("title"))).select("title", F.explode(F.expr("transform(sequence(1, greatest(length(f), 1)), n -> right(f, n))")).alias("f"))
    both = ends.join(known.withColumn("f", flatten_title(F.col("known"))), "f")
    return both.groupBy("title").agg(F.max_by("known", F.struct(F.length("f"), "known")).alias("known"))


def unique_core(left: DataFrame, right: DataFrame, name: str, place: str) -> DataFrame:
    """``name`` matched to ``place`` exactly, or by core (before a parenthesis) if just one place has it."""
    core = lambda c: norm(F.regexp_replace(c, r"\s*\(.*$", ""))
    exact = right.select(norm(F.col(place)).alias("__n"), F.col(place).alias("__exact")).dropDuplicates(["__n"])
    alone = right.select(core(place).alias("__c"), F.col(place).alias("__core")).withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy("__c"))).where("__k = 1").drop("__k")
    both = left.withColumn("__n", norm(F.col(name))).withColumn("__c", core(name)).join(exact, "__n", "left").join(alone, "__c", "left")
    return both.withColumn(place, F.coalesce("__exact", "__core")).drop("__n", "__c", "__exact", "__core")


# Fixed value: what kind of place a name may say it is.
QUALIFIER = r"(?i)^(?:the\s+)?(?:(?:land|city|waters|valley|wilderness|plains|place|borders|hill|mount)\s+of\s+|(?:hill|mount)\s+)"


def _fold(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")


def prophet_named(rows: DataFrame, prophets: DataFrame, name: str, into: str = "prophet") -> DataFrame:
    """Rows with the prophet (name, pos) that ``name`` names: as it is, else without the parenthesis at its end; null if none.

    Case and punctuation aside; of two prophets of one name the first by ``pos``.
    """
    known = prophets.select(_fold(F.col("name")).alias("__fold"), "name", "pos").where("__fold <> ''").groupBy("__fold").agg(F.min_by("name", "pos").alias("__name"))
    told = rows.withColumns({"__whole": _fold(F.col(name)), "__bare": _fold(speaker_name(F.col(name)))})
    for key, found in (("__whole", "__first"), ("__bare", "__second")):
        told = look_up(told, known.select(F.col("__fold").alias(key), F.col("__name").alias(found)), [key], "left")
    return told.withColumn(into, F.coalesce("__first", "__second")).drop("__whole", "__bare", "__first", "__second")


def place_named(rows: DataFrame, places: DataFrame, name: str, into: str = "place") -> DataFrame:
    """Rows with the place (id, name, alt_name, pos) that ``name`` names, by either of its names; null if none.

    First by the whole name, of several the first by ``pos``; then by what is
    left without the kind of place, if that is one place's alone.
    """
    both = places.select("id", "pos", F.explode(F.array("name", "alt_name")).alias("n"))
    core = lambda c: _fold(F.regexp_replace(F.coalesce(c, F.lit("")), QUALIFIER, ""))
    exact = both.select(_fold(F.col("n")).alias("__whole"), "id", "pos").where("__whole <> ''").groupBy("__whole").agg(F.min_by("id", "pos").alias("__exact"))
    alone = both.select(core(F.col("n")).alias("__core"), "id").where("__core <> ''").distinct().groupBy("__core").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("__alone")).where("k = 1").drop("k")
    told = rows.withColumns({"__whole": _fold(F.col(name)), "__core": core(F.col(name))})
    told = look_up(look_up(told, exact, ["__whole"], "left"), alone, ["__core"], "left")
    return told.withColumn(into, F.coalesce("__exact", F.when(F.col("__whole") != "", F.col("__alone")))).drop("__whole", "__core", "__exact", "__alone")


def article_score(title: Column, subtitle: Column, typed: str) -> Column:
    """How well a page answers what was typed, punctuation and case aside; null if not, or for fewer than three characters.

    100 its title (with or without a leading the, a or an), 80 a beginning of it,
    60 a word of it begins so, 45 it stands within; 30 and 20 likewise for title
    and subtitle together; 12 if all of several words stand there.
    """
    q = norm(F.lit(typed))
    named, both = norm(title), norm(F.concat_ws(" ", title, subtitle))
    bare = F.regexp_replace(named, "^(the|a|an) ", "")
    at_word = lambda c: (c == q) | c.startswith(F.concat(q, F.lit(" "))) | c.contains(F.concat(F.lit(" "), q))
    each = F.forall(F.split(q, " "), lambda w: both.contains(w)) & q.contains(" ")
    tiers = [((named == q) | (bare == q), 100), (named.startswith(q) | bare.startswith(q), 80), (at_word(named), 60), (named.contains(q), 45), (at_word(both), 30), (both.contains(q), 20), (each, 12)]
    score = F.when(F.length(q) < 3, None)
    for test, worth in tiers:
        score = score.when(test, worth)
    return score


def articles(rows: DataFrame, title: str, subtitle: str, typed: str, size: int = 3) -> DataFrame:
    """Best pages, with ``strong`` for an exact title or a beginning of eight characters or more."""
    scored = rows.withColumn("score", article_score(F.col(title), F.col(subtitle), typed)).where("score is not null")
    strong = (F.col("score") == 100) | ((F.col("score") == 80) & (F.length(norm(F.lit(typed))) >= 8))
    return scored.withColumn("strong", strong).orderBy(F.desc("score"), title, subtitle).limit(size)


def places(rows: DataFrame, name: str, region: str, typed: str, size: int = 8) -> DataFrame:
    """Places whose name or region contains the text, beginnings first."""
    n, q = F.lower(name), typed.lower()
    return rows.where(n.contains(q) | F.lower(region).contains(q)).orderBy(F.desc(n.startswith(q)), name).limit(size)


def recent(events: DataFrame, user: str, what: str, when: str, size: int = 5) -> DataFrame:
    """The last ``size`` different values of each user, case folded, newest first."""
    last = events.groupBy(user, F.lower(what).alias("folded")).agg(F.max(F.struct(when, what)).alias("m"))
    order = Window.partitionBy(user).orderBy(F.desc(f"m.{when}"), "folded")
    return last.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size).select(user, "folded", "nth")


def agreement(placed: DataFrame, group: str, low: float = 0.9) -> DataFrame:
    """Rows of each group, mean similarity of the placed ones (three places), how many lie below ``low``, and how many are not placed."""
    return placed.groupBy(group).agg(
        F.count(F.lit(1)).alias("verses"), F.round(F.avg("similarity"), 3).alias("mean"), F.count(F.when(F.col("similarity") < low, 1)).alias("below"), F.count(F.when(F.col("similarity").isNull(), 1)).alias("missing"))


def sections(references: DataFrame, group: str, reference: str) -> DataFrame:
    """Different sections of each group: what stands before the colon of its references."""
    return references.groupBy(group).agg(F.count_distinct(F.substring_index(reference, ":", 1)).alias("sections"))


def most_frequent(rows: DataFrame, value: str, size: int = 10) -> DataFrame:
    """The ``size`` most frequent values with their count, ties by value; nulls are no value."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(size)


def misnamed(files: DataFrame, content: DataFrame, key: list[str]) -> DataFrame:
    """Files (file and the keys that its name states) whose content states other keys, with both; for a warning."""
    stated = content.select("file", *[F.col(k).alias(f"stated_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"stated_{k}")) for k in key]
    wrong = ~same[0]
    for test in same[1:]:
        wrong = wrong | ~test
    return files.join(stated, "file").where(wrong)
