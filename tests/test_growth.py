"""Steps that grew faster than their input: what their plans no longer do, with the same results."""

import re

from conftest import SMALL
from pyspark.sql import functions as F

from lectern.operators import align, index, joins
from lectern.plans import record_queries, search_queries
from lectern.sources import records


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_trimmed_once(spark):
    lines = spark.createDataFrame([(" see 3, x ",), ("12",), ("some text",)], "line string")
    told = lines.select("line", align.classify(F.col("line")).alias("kind"))
    assert _plan(told).count("regexp_replace") == 1
    assert {r["line"]: r["kind"] for r in told.collect()} == {" see 3, x ": "apparatus", "12": "head", "some text": None}


def test_steps_over_blocks(spark):
    posts = spark.createDataFrame([("a", u, [1] * n) for u, n in ((1, 1), (3, 2), (9, 1), (10, 1), (21, 3))] + [("b", 8, [2])], "stem string, unit long, verses array<int>")
    got = sorted(tuple(r) for r in index.steps(index.encoded(posts, 4), 4).collect())
    assert got == [("a", 1, 1, 1), ("a", 3, 2, 2), ("a", 9, 6, 1), ("a", 10, 1, 1), ("a", 21, 11, 3), ("b", 8, 8, 1)]


def test_letters_are_no_task(spark):
    assert "partitionBy" not in _plan(search_queries.vocab_by_letter(spark, SMALL)) and "windowspecdefinition(letter" not in _plan(search_queries.vocab_by_letter(spark, SMALL))


def test_runs_of_notes_are_not_shuffled_again(spark):
    assert "Exchange hashpartitioning(note" not in record_queries.note_doors(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_pages_are_dealt_by_counted_tasks(spark, monkeypatch):
    """Tasks merged by written size held more of a larger table; lines are dealt by file over as many tasks as their number asks, once."""
    lines = spark.range(400).select(F.concat("id", F.lit(".md")).alias("file"), F.posexplode(F.array(*[F.lit(x) for x in ("## B", "* form: ladder", "### T (Alma 1:2)", "a rung", "## A", "- x | Alma 3:4")])).alias("line_no", "line"))
    monkeypatch.setattr(joins, "TASK_ROWS", 150)
    made = records.evidences(lines)
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(file" in plan and set(re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)) == {"16"}
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() == 16
    got = {r["slug"]: [(f["name"], f["form"], [g["lines"] for g in f["groups"]], [i["text"] for i in f["items"]]) for f in r["forms"]] for r in made.collect()}
    assert got == {str(k): [("B", "ladder", [["a rung"]], []), ("A", "phrases", [], ["x"])] for k in range(400)}
