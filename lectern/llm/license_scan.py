"""License scans by diagonal voting.

Every run of k words of a text is hashed and joined to the positions of equal
runs in the license templates.  A match votes for the diagonal "text position
minus template position"; votes are added up by diagonal, neighbouring diagonals
(words put in or left out) are merged, and each span so found is checked word by
word, in order, against its template: whole license texts and notices.  All of it
is DataFrame work.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from . import staging
from .decontaminate import doc_key, positions, shingle_hashes, word_count, words
from .license_texts import TEMPLATES

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words of the rolling hash; a shorter phrase is hashed whole.
GRAM = 3
#: Diagonals this close are one placement with words put in or left out.
SLACK = 2
#: Share of a template's word runs that must vote, and of its words that must stand in the span, in their order.
VOTES, WORDS = 0.6, 0.75
#: Template words that a word of the span may pass over.
AHEAD = 8


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A base phrase counts wherever its words stand consecutively; ``first_word``
    and ``last_word`` are the smallest and largest such starts, null where there
    is none.  ``labels`` adds those of the templates; ``score`` is the highest
    share of a template's words that a span holds in order (a base phrase: 1), 0
    without any.  ``spans`` lists label, first and last word of each placement.  A null
    or wordless text has no words, no label and score 0; repeated rows get equal
    results; an empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = [(n, label, base, re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())) for n, (label, text, base) in enumerate([(v, k, True) for k, v in phrases.items()] + [(a, b, False) for a, b in templates])]
    known = spark.createDataFrame(rows, "template int, label string, base boolean, w array<string>")
    sizes = sorted({min(len(r[3]), GRAM) for r in rows})
    hashed = F.expr("case " + " ".join(f"when size(w) = {n} then {shingle_hashes('w', n)}" for n in range(1, GRAM)) + f" else {shingle_hashes('w', GRAM)} end")
    grams = known.select("template", "label", "base", "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(GRAM)).alias("k"), hashed.alias("h")).withColumn("grams", F.size("h"))
    texts = staging.only(docs, "doc_id", "text").select(doc_key().alias("key"), "doc_id", "text")

    places = grams.select("template", "k", "len", "base", "grams", F.posexplode("h").alias("tpos", "gram"))
    matches = positions(texts.select("key", words(F.col("text")).alias("w")), sizes).join(F.broadcast(places), "gram")
    votes = matches.groupBy("key", "template", "base", "k", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("tposs"), F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("k")).alias("hi"))
    votes = staging.stage(votes, "votes")

    by_place = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by_place) > F.when(F.col("base"), 0).otherwise(SLACK)) | F.lag("diagonal").over(by_place).isNull()
    runs = votes.withColumn("run", F.sum(apart.cast("int")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    # A run of the template counts once, however many of the diagonals have it.
    merged = runs.groupBy("key", "template", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("tposs")))).alias("votes"), F.first("grams").alias("grams"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    likely = merged.where(F.col("votes") >= F.ceil(F.col("grams") * VOTES))
    per_doc = staging.stage(likely.groupBy("key").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("found")), "likely")

    both = staging.join_found(texts.select("key", "text"), per_doc).select("key", "found", words(F.col("text")).alias("w"))
    slices = both.select("key", F.expr("inline(transform(found, f -> struct(f.template as template, f.lo as lo, f.hi as hi, slice(w, f.lo + 1, f.hi - f.lo) as here)))"))
    # Words of the span take the next equal template word within reach; what stands out of order finds none.
    step = f"(s, x) -> case when array_position(slice(w, s.p + 1, {AHEAD}), x) > 0 then struct(int(s.p + array_position(slice(w, s.p + 1, {AHEAD}), x)) as p, s.n + 1 as n) else s end"
    share = F.expr(f"aggregate(here, struct(0 as p, 0 as n), {step}, s -> s.n)") / F.size("w")
    checked = slices.join(F.broadcast(grams.select("template", "label", "base", "w")), "template").where(F.when(F.col("base"), F.col("here") == F.col("w")).otherwise(share >= WORDS))
    told = checked.select("key", "template", "label", "base", "lo", "hi", F.when(F.col("base"), 1.0).otherwise(share).alias("share"), F.size("w").alias("len"))
    # Of wordings that overlap, one of which is much of the other, that with the most words in place stands.
    in_order = Window.partitionBy("key", "base").orderBy("lo", "hi", "template")
    reach = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    islands = told.withColumn("new", F.when(F.col("base") | reach.isNull() | (F.col("lo") >= reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(in_order))
    merit = F.struct(F.round(F.col("share") * F.col("len")), "share")
    best = F.max(merit).over(Window.partitionBy("key", "base", "island"))
    spans = islands.withColumn("merit", merit).withColumn("best", best).where(F.col("base") | (F.col("merit") == F.col("best")))
    own = F.when(F.col("base"), F.col("lo"))
    told = spans.groupBy("key").agg(
        F.count_distinct(F.when(F.col("base"), F.struct("template", "lo"))).alias("n_base"), F.min(own).alias("first_word"), F.max(own).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
        F.sort_array(F.collect_set(F.struct("lo", "hi", "label"))).alias("spans"),
    )
    out = texts.select("key", "doc_id", word_count().alias("n_words")).join(told, "key", "left")
    none = F.lit("")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.to_json(F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int,label:string>>"))).alias("spans"),
    )
