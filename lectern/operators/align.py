"""Noisy scans against a canonical text: line classes, cleaners, similarity, alignment."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: cost of leaving a block or a slot alone.
GAP = -0.35

# What a trimmed line looks like that is no verse text, in the order in which it is tried.
# A pattern after "i" minds no case; a number bounds the line's length.
LINE_PATTERNS = [
    ("head", "", r"^[0-9]{1,4}$", None),
    ("head", "", r"^[0-9A-Z][A-Z0-9 .'’]*,\s*[0-9]+\.?$", None),
    ("head", "i", r"PEARL\s+OF\s+GREAT\s+PRICE", None),
    ("head", "", r"^[IVXY]{1,5}\.?\]", None),
    ("loud bracket", "", r"[\[\]]", 60),
    ("apparatus", "", r"\d\s*:\s*\d", None),
    ("apparatus", "", r"^[0-9a-z]{1,2}[,.]\s+(see\b|[0-9]?\s*[A-Z][a-z]{1,4}\.)", None),
    ("apparatus", "", r"^see\s+[0-9a-z]{1,2},", None),
    ("apparatus", "i", r"^[0-9a-z]{1,2}[,.]\s+(compare\s+)?verses?\b", None),
    ("apparatus", "i", r"^(compare\s+)?verses?\s+\d", None),
    ("apparatus", "", r"^[^A-Za-z0-9\s]{1,2},\s+\S", None),
    ("two verses", "", r"^[0-9a-z]{1,2}[,.]", None),
    ("loud number", "", r"\d", 70),
    ("dated", "i", r"^(About|Between)\b", 70),
    ("head", "i", r"\b[AB]\.\s*[DC]\.", 70),
]


def classify(line: Column) -> Column:
    """``blank``, ``head``, ``apparatus`` or null (text) of a scanned line; lines of chapters and sections are text."""
    # Within a lambda the trimmed line is made once, not for every pattern.
    return F.get(F.transform(F.array(F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), lambda s: _kind(line, s)), F.lit(0))


def _kind(line: Column, s: Column) -> Column:
    letters, upper = F.regexp_count(s, F.lit("[A-Za-z]")), F.regexp_count(s, F.lit("[A-Z]"))
    more = {
        "loud bracket": (letters > 0) & (upper > 0.7 * letters),
        "loud number": (letters > 0) & (upper > 0.55 * letters),
        "two verses": F.regexp_count(F.lower(s), F.lit(r"\bverses?\s+\d")) >= 2,
        "dated": s.rlike(r"\d"),
    }
    kind = F.when(line.rlike(r"(?i)CHAPT|^\s*SECTION\b"), None).when(s == "", "blank")
    for name, fold, pattern, below in LINE_PATTERNS:
        test = s.rlike("(?i)" * (fold == "i") + pattern)
        test = test & more[name] if name in more else test
        kind = kind.when((F.length(s) < below) & test if below else test, "apparatus" if name in ("apparatus", "two verses") else "head")
    return kind


#: Cells of the table of words and blocks that an alignment holds at once.
CELLS = 1 << 22
_WORD = re.compile("[a-z]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@F.pandas_udf(T.StructType().add("same", "long").add("every", "long"))
def _shared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Words that two texts share as bags, and all their words."""
    both = [(Counter(_words(x)), Counter(_words(y))) for x, y in zip(a, b)]
    return pd.DataFrame([((x & y).total(), x.total() + y.total()) for x, y in both], columns=["same", "every"])


def similarity_of(a: Column, b: Column) -> Column:
    """Twice the words two texts share (as bags) over all their words; 0 without any."""
    told = _shared(a, b)
    return F.round(F.coalesce(F.try_divide(2.0 * told["same"], told["every"]), F.lit(0.0)), 6)


def bag_similarity(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """``similarity`` of the two texts of each pair; both stand in one row, so that no word is shuffled."""
    return pairs.select(*key, similarity_of(F.col(a), F.col(b)).alias("similarity"))


def _likeness(slots: list[str], blocks: list[str]) -> np.ndarray:
    """Bag similarity of every slot to every block: the n-th use of a word is an item, so that shared words are a product of incidences."""
    items: dict[tuple[str, int], int] = {}
    bags = [[[items.setdefault((w, k), len(items)) for w, n in Counter(_words(t)).items() for k in range(n)] for t in x] for x in (slots, blocks)]
    sizes = [np.array([len(b) for b in x], float) for x in bags]
    same, some = np.zeros((len(slots), len(blocks))), max(1, CELLS // max(1, len(items)))
    for lo in range(0, len(blocks), some):
        right = np.zeros((len(items), min(some, len(blocks) - lo)), np.float32)
        for j, b in enumerate(bags[1][lo : lo + some]):
            right[b, j] = 1
        for i, b in enumerate(bags[0]):
            if b:
                same[i, lo : lo + some] = right[b].sum(0, dtype=np.float64)
    every = sizes[0][:, None] + sizes[1]
    return np.where(every > 0, 2 * same / np.maximum(every, 1), 0.0)


def align(slots: list[str], blocks: list[str], gap: float = GAP) -> list[int]:
    """For each slot the block that a global alignment puts there, or -1; ties go to a match, then to a block left out, then to a slot left empty.

    Cells are filled by anti-diagonals, each a few array operations.
    """
    n, m = len(slots), len(blocks)
    if not n or not m:
        return [-1] * n
    like = _likeness(slots, blocks)
    move = np.zeros((n + 1, m + 1), np.int8)
    move[:, 0], move[0] = 2, 1
    # Scores of the two anti-diagonals before, by slot.
    edge = np.r_[0.0, np.cumsum(np.full(max(n, m), gap))]
    older, old = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    older[0] = 0.0
    old[:2] = edge[1]
    for d in range(2, n + m + 1):
        new = np.full(n + 1, -np.inf)
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        options = np.stack([older[i - 1] + like[i - 1, d - i - 1], old[i] + gap, old[i - 1] + gap])
        move[i, d - i] = best = options.argmax(0)
        new[i] = options[best, np.arange(len(i))]
        if d <= m:
            new[0] = edge[d]
        if d <= n:
            new[d] = edge[d]
        older, old = old, new
    out, i, j = [-1] * n, n, m
    while i or j:
        if i and j and move[i, j] == 0:
            i, j = i - 1, j - 1
            out[i] = j
        elif move[i, j] == 1:
            j -= 1
        else:
            i -= 1
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _aligned(slots: pd.Series, blocks: pd.Series) -> pd.Series:
    return pd.Series([align(list(s), list(b)) for s, b in zip(slots, blocks)], dtype=object)


def align_chapters(slots: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """Slots (key, verse, text) with the block (key, block, text) each got: block, scan, similarity.

    A chapter's slots and blocks are one row, which bounds a task's work;
    chapters are independent and dealt over all tasks, however small their texts.
    """
    tasks = int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def whole(rows: DataFrame, at: str) -> DataFrame:
        named = rows.dropna(subset=[*key, at]).select(*key, F.struct(F.col(at).alias("at"), F.coalesce("text", F.lit("")).alias("text")).alias("piece"))
        return named.repartition(tasks, *key).groupBy(*key).agg(F.sort_array(F.collect_list("piece")).alias(at))

    both = whole(slots, "verse").join(whole(blocks, "block"), key, "left")
    got = both.withColumn("got", _aligned(F.col("verse.text"), F.coalesce("block.text", F.array().cast("array<string>"))))
    each = got.select(*key, "block", F.posexplode("verse").alias("nth", "slot"), "got").withColumn("to", F.get("got", F.col("nth")))
    scan = each.select(*key, "slot", F.when(F.col("to") >= 0, F.get("block", F.col("to"))).alias("b"))
    return scan.select(*key, F.col("slot.at").alias("verse"), F.col("b.at").cast("int").alias("block"), F.col("b.text").alias("scan"), similarity_of(F.col("slot.text"), F.col("b.text")).alias("similarity"))
