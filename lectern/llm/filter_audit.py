"""What filters remove in every order in which they can be applied.

The orders form a trie.  It is walked depth first: each node's survivors are a
persisted DataFrame made from its parent's by one filter, and the removals at all
edges that leave it are counted on these rows.  Nodes that the same filters lead
to hold the same rows, so a set of filters is visited once, whatever its order:
2**n states instead of all prefixes of n! orders.  Along one branch at most n
DataFrames are held; counts stay tables, by part.
"""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import staging

#: Characters of the last of the filters on characters, and fixed bounds of the others.
SYMBOLS, LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = r"[#$%&*|]", 100, 80, 10


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text alone: A few words, B repeated words, C capitals, D symbols."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good and toxic for every row of (doc_id, text, lang, ...), written once.

    E: the text is that of a row with a smaller doc_id, anywhere in the table.
    Null text counts as empty, null lang as an empty part.  A null doc_id is
    smaller than none and no smaller than any, and has no label; a document with
    several labels is good or toxic if one says so.  Repeated rows count each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[f.alias(c) for c, f in text_filters(text).items()])
    own = staging.stage(own, "flags")
    firsts = staging.stage(own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    told = staging.join_skewed(own, firsts.select("digest", "first"), ["digest"], staging.heavy_keys(firsts, ["digest"], "n"), "left")
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    both = staging.join_skewed(told, labels, ["doc_id"], staging.heavy_rows(own, ["doc_id"]), "left")
    no = F.lit(False)
    return staging.stage(both.select("part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")), "flagged")


def _edges(alive: DataFrame, state: str, ahead: list[str], lost: list[str]) -> DataFrame:
    """For each part and filter ahead: rows alive and rows removed, of each kind."""
    kinds = {"removed": F.lit(True)} | {f"{c}_lost": F.col(c) for c in lost}
    counts = [F.struct(F.lit(f).alias("filter"), *[F.count_if(F.col(f) & kind).alias(name) for name, kind in kinds.items()]) for f in ahead]
    by_part = alive.groupBy("part").agg(F.count(F.lit(1)).alias("alive"), F.array(*counts).alias("edges"))
    return by_part.select("part", F.lit(state).alias("state"), "alive", F.inline("edges"))


def walk(rows: DataFrame, filters: list[str], lost: list[str]) -> DataFrame:
    """Counts at every edge of the trie of orders, by part: part, state (filters applied), filter, alive, removed and what was lost."""
    path = staging.new_path(rows.sparkSession, "edges")
    seen = {frozenset()}

    def visit(applied: frozenset, alive: DataFrame) -> None:
        ahead = [f for f in filters if f not in applied]
        if not ahead:
            return
        _edges(alive, "".join(sorted(applied)), ahead, lost).write.mode("append").parquet(path)
        for f in ahead:
            state = applied | {f}
            if state not in seen:
                seen.add(state)
                survivors = alive.where(~F.col(f)).persist()
                visit(state, survivors)
                survivors.unpersist()

    visit(frozenset(), rows)
    counts = "".join(f", {c}_lost long" for c in lost)
    return rows.sparkSession.read.schema(f"part string, state string, alive long, filter string, removed long{counts}").parquet(path)


def _orders(spark: SparkSession, filters: list[str]) -> DataFrame:
    rows = [("".join(o), k + 1, "".join(sorted(o[:k])), o[k]) for o in itertools.permutations(filters) for k in range(len(filters))]
    return spark.createDataFrame(rows, "filter_order string, step int, state string, filter string")


def audit(rows: DataFrame, filters: list[str], lost: list[str]) -> DataFrame:
    """For every part, order of the filters and step: kept, removed, redundant, unique_fails, ``<lost>_lost`` and shapley.

    ``rows`` has a string ``part``, a boolean column for each filter (named by one
    letter; true: the row fails) and one for each kind of row whose loss is
    counted; it should be a written table, as it is read again.  All orders of
    all parts are returned, zeros included; a table without rows has no part.
    At most eight filters: their orders are one table of n * n! rows.
    """
    if len(filters) > 8:
        raise ValueError("over eight filters have too many orders")
    others = {f: F.lit(False) for f in filters}
    for f, g in itertools.permutations(filters, 2):
        others[f] = others[f] | F.col(g)
    fails = [F.struct(F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("fails"), F.count_if(F.col(f) & ~others[f]).alias("unique_fails")) for f in filters]
    totals = rows.groupBy("part").agg(F.array(*fails).alias("fails")).select("part", F.inline("fails"))
    counts = walk(rows, filters, lost)
    n = len(filters)
    share = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.length("state") + 1)
    shapley = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * share).alias("shapley"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    every = totals.join(shapley, ["part", "filter"], "left").join(F.broadcast(_orders(rows.sparkSession, filters)), "filter").join(counts, ["part", "state", "filter"], "left")
    removed, alive = F.coalesce("removed", F.lit(0)), F.coalesce("alive", F.lit(0))
    return every.select(
        "part", "filter_order", "step", (alive - removed).cast("long").alias("kept"), zero("removed"), (F.col("fails") - removed).cast("long").alias("redundant"),
        "unique_fails", *[zero(f"{c}_lost") for c in lost], zero("shapley"),
    )
