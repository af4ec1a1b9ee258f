"""Steps that grew faster than their input, or ran in one task."""

import re

from pyspark.sql import Window, functions as F

from lectern.operators import align, index, joins, pairing, scan
from lectern.plans import dialect_queries
from lectern.sources import markdown, records


def test_one_cursor_reads_a_volume_once(spark, monkeypatch):
    """No split is placed again, also where no chapter says where it stands."""
    written = []
    staged = scan.staged
    monkeypatch.setattr(scan, "staged", lambda df, name: written.append(name) or staged(df, name))
    guide = spark.createDataFrame([("v", c, 1, "a b") for c in range(80)], "volume string, chapter int, verse int, text string")
    blocks = spark.createDataFrame([("v", n, "a b") for n in range(120)], "volume string, block int, text string")
    got = {r["chapter"]: r["block"] for r in scan.place(guide, blocks).collect()}
    # Of equal blocks the last that a chapter sees is its own, until none is left.
    assert sorted(b for b in got.values() if b is not None) == [got[c] for c in range(80) if got[c] is not None] and len(got) == 80
    assert written == ["places", "chapters"]


def test_similarity_shuffles_no_words(spark):
    pairs = spark.createDataFrame([(1, "A b b", "b c"), (2, None, "x"), (3, "", None)], "k int, a string, b string")
    like = align.bag_similarity(pairs, ["k"], "a", "b")
    assert "Exchange" not in like._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["similarity"] for r in like.collect()} == {1: 0.4, 2: 0.0, 3: 0.0}


def test_chapters_of_small_texts_are_dealt(spark):
    slots = spark.createDataFrame([(k, v, f"a{v} b c") for k in range(40) for v in (1, 2)] + [(None, 1, "x")], "unit int, verse int, text string")
    blocks = slots.where("verse = 2").select("unit", F.lit(7).alias("block"), "text")
    made = align.align_chapters(slots, blocks, ["unit"])
    assert made.where("block is not null").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert {(r["unit"], r["verse"]): (r["block"], r["similarity"]) for r in made.collect()} == {(k, v): (7, 1.0) if v == 2 else (None, 0.0) for k in range(40) for v in (1, 2)}


def test_likeness_by_parts(monkeypatch):
    sides = ["a b c", "", "c c d"], ["c", "a b", "d c c", "x"]
    whole = align._likeness(*sides).tolist()
    monkeypatch.setattr(align, "CELLS", 1)
    assert align._likeness(*sides).tolist() == whole


def test_values_up_to_a_row_as_windows(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 != 0, F.col("id") % 2).alias("h"), (F.col("id") * 37 % 200).alias("at"))
    rows = rows.withColumn("v", F.when(F.col("at") % 5 == 0, F.col("at").cast("string"))).withColumn("h", F.nullif("h", F.lit(1)))
    for group in ("g", "h"):
        w = Window.partitionBy(group).orderBy("at")
        want = rows.select("at", F.last("v", True).over(w), F.coalesce(F.sum(F.col("v").cast("long")).over(w), F.lit(0)))
        got = joins.upto(rows, group, ["at"], {"l": F.col("v")}, {"s": F.col("v")}).select("at", "l", "s")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_pages_are_held_by_no_row_or_task(spark):
    """One file of many rows: its lines are numbered, read and headed by several tasks (before: one row, one task)."""
    rows = spark.range(4000).select(F.col("id").alias("k"))
    made = dialect_queries._written(rows, F.lit("a.md"), F.col("k"), F.concat(F.lit("## Book "), F.col("k") % 50), F.when(F.col("k") % 3 > 0, F.concat(F.lit("| 1 | c"), "k", F.lit(" |"))))
    for df in (made, markdown.pipe_rows(made), records.figures(made)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"collect_list\(piece|windowspecdefinition\(file#\d+, (line_no|begun)", plan)
    want, n = [], 0
    for k in range(4000):
        n += 2 if k % 3 else 1
        want += [(n - 1, f"c{k}")] if k % 3 else []
    assert [(r["line_no"], r["cells"][1]) for r in markdown.pipe_rows(made).orderBy("line_no").collect()] == want


def test_postings_are_dealt_once(spark):
    """By stem and block, for units and for blocks alike (before: a shuffle each)."""
    rows = spark.createDataFrame([("a", u, [1]) for u in (1, 2, 5000)], "stem string, unit long, verses array<int>")
    post = index._by_block(rows).groupBy("stem", "block", "unit").agg(F.flatten(F.collect_list("verses")).alias("verses"))
    strings = index.encoded(post)
    assert strings._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    assert sorted((r["unit"], list(r["verses"])) for r in index.decoded(strings).collect()) == [(1, [1]), (2, [1]), (5000, [1])]


def test_books_ahead_without_a_frame_to_the_end(spark):
    """A frame from a page to its file's end is read anew for each page: the square of a file's pages."""
    pages = spark.createDataFrame([("f", n, "ALMA 1:3–9" if n == 4 else None) for n in range(7)] + [("g", 1, None)], "file string, page int, head string")
    made = pairing.page_books(pages)
    assert "unboundedfollowing" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["file"], r["page"]): r["book"] for r in made.collect()} == {("f", n): "Alma" if n <= 4 else None for n in range(7)} | {("g", 1): None}
