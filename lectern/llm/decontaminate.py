"""Benchmark decontamination: a prefix-filtered set join of shingles.

An item's window is a set of word shingles that a document must contain whole.
With full containment the necessary prefix of the shingles, ordered by rarity in
the corpus, is the rarest one alone, so documents meet windows only there.  The
length and position bounds drop candidates that would not fit, and the words of
the rest are compared one by one.  All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import staging

WINDOW = 13
SHINGLE = 3
#: Rows of a benchmark table (shingles, windows, windows' items) that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def word_count() -> Column:
    """Number of words of the column ``text``."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")


def doc_key() -> Column:
    """Key of a document row; rows with equal id and text share it and get equal results."""
    return F.struct("doc_id", F.xxhash64("text").alias("text_hash"))


def positions(split: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per position and shingle length of the word array ``w``: key, n_words, gram, pos."""
    every = [F.expr(f"transform({shingle_hashes('w', k)}, (h, i) -> struct(h as gram, i as pos))") for k in lengths]
    return split.select("key", F.size("w").alias("n_words"), F.inline(F.concat(*every) if len(every) > 1 else every[0]))


def shingle_hashes(array: str, size: int) -> str:
    """SQL for the hashes of all runs of ``size`` words of an array column, in order."""
    rest = "".join(f", {array}[i + {n}]" for n in range(1, size))
    return f"transform(slice({array}, 1, greatest(size({array}) - {size - 1}, 0)), (x, i) -> xxhash64(x{rest}))"


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per window of an item: win (a hash of its words), w (its words) and item_id.

    An item of fewer words than ``size``, but not none, is a window of its own.
    """
    split = staging.only(items, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w"))
    starts = split.where("size(w) > 0").select("item_id", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {size}, 0))")).alias("at"))
    return starts.select("item_id", F.expr(f"slice(w, at + 1, {size})").alias("w")).select(F.xxhash64("w").alias("win"), "w", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: float = 0.05, with_key: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of any item window is hit; ``contaminated`` says
    that at least one word and ``share`` of the words are.  ``items_sha256`` is of
    the occurring item ids, sorted as strings and joined by commas (a null id
    counts as the empty string; no items: of the empty string).  A null or
    wordless text has no words and is clean, an item without words occurs
    nowhere, repeated rows each get the same result, and extra columns are
    ignored.  An empty benchmark leaves every document clean.
    """
    texts = staging.only(docs, "doc_id", "text").select(doc_key().alias("key"), "doc_id", "text")
    of_items = staging.stage(windows(items, size), "windows")
    hashes = F.expr("case " + " ".join(f"when size(w) = {n} then {shingle_hashes('w', n)}" for n in range(1, SHINGLE)) + f" else {shingle_hashes('w', SHINGLE)} end")
    wins = of_items.select("win", "w").dropDuplicates(["win"]).select("win", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), hashes.alias("hashes"))
    wins = staging.stage(wins, "distinct-windows")
    grams = wins.select("win", "n", "k", F.posexplode("hashes").alias("offset", "gram"))
    lengths = [r["k"] for r in grams.select("k").distinct().collect()]
    some = lambda df: df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = lambda df, few: F.broadcast(df) if few else df
    few_wins = some(wins)

    # All positions where a benchmark shingle stands; the rest of the corpus goes no further.
    split = texts.select("key", words(F.col("text")).alias("w"))
    seen = staging.stage(positions(split, lengths or [SHINGLE]).join(small(grams.select("gram").distinct(), some(grams)), "gram", "left_semi"), "postings")

    # Rarity order; the prefix of a window is its first shingle in that order.
    rarity = seen.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    ordered = grams.join(rarity, "gram", "left").withColumn("nth", F.row_number().over(Window.partitionBy("win").orderBy(F.coalesce("freq", F.lit(0)), "gram", "offset")))
    prefix = ordered.where("nth = 1 and freq is not null").select("gram", "win", "n", "offset")
    fits = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("n") <= F.col("n_words"))
    candidates = seen.join(small(prefix, few_wins), "gram").where(fits).select("key", "win", (F.col("pos") - F.col("offset")).alias("at")).distinct()

    # Exact check of the words, document by document.
    per_doc = staging.stage(candidates.groupBy("key").agg(F.collect_list(F.struct("win", "at")).alias("found")), "candidates")
    both = staging.join_found(texts.select("key", "text"), per_doc)
    slices = both.select("key", "found", words(F.col("text")).alias("w")).select("key", F.expr(f"inline(transform(found, f -> struct(f.win as win, f.at as at, slice(w, f.at + 1, {size}) as here)))"))
    known = wins.select("win", "n", F.col("w").alias("wanted"))
    hits = slices.join(small(known, few_wins), "win").where(F.expr("slice(here, 1, n) = wanted")).select("key", "win", "at", (F.col("at") + F.col("n")).alias("upto"))
    hits = staging.stage(hits, "hits")

    before = F.max("upto").over(Window.partitionBy("key").orderBy("at", "upto").rowsBetween(Window.unboundedPreceding, -1))
    covered = hits.withColumn("new", F.greatest(F.lit(0), F.col("upto") - F.greatest("at", F.coalesce(before, F.lit(0))))).groupBy("key").agg(F.sum("new").alias("n_hit"))
    owners = of_items.select("win", F.col("item_id").alias("item"))
    named = hits.select("key", "win").distinct().join(small(owners, some(owners)), "win").select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("item_list"))
    out = texts.select("key", "doc_id", word_count().alias("n_words")).join(covered.join(named, "key"), "key", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_list", F.array().cast("array<string>"))
    return out.select(
        *["key"] * with_key, "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * round(1 / share) >= F.col("n_words"))).alias("contaminated"),
    )
