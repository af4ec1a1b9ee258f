"""Runs and doors of notes, the manifest, and recent searches over a stream."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import manifest, notes, refs
from lectern.sources import corpus, records
from lectern.streaming import recent

MARK = "struct<kind:string,start:int,end:int,verse:int,verse_start:int,verse_end:int,ch_start:int>"
NOTE = f"note int, book string, chapter int, text string, marks array<{MARK}>"


def _mark(kind, start, end, verse=None, low=None, high=None, ch=None):
    return (kind, start, end, verse, low, high, ch)


def test_runs_join_to_the_note(spark):
    """Random marks, overlapping, empty, outside and tied: the runs are the text, the marks taken greedily by start."""
    rng = random.Random(3)
    rows = [(n, "Alma", 1, "".join(rng.choice("ab é“") for _ in range(rng.randrange(30))), [_mark(str(i), s := rng.randrange(-2, 30), s + rng.randrange(-1, 9)) for i in range(rng.randrange(6))]) for n in range(60)]
    rows += [(100, "Alma", 1, "text", None), (101, "Alma", 1, "", [_mark("x", 0, 0)]), (102, "Alma", 1, None, None)]
    got = {}
    for r in notes.note_runs(spark.createDataFrame(rows, NOTE)).orderBy("note", "nth").collect():
        got.setdefault(r["note"], []).append((r["text"], r["mark"] and r["mark"]["kind"]))
    for n, _, _, text, marks in rows:
        want, at = [], 0
        for k, lo, hi, *_ in sorted(marks or [], key=lambda m: m[1]):
            if lo >= at and hi > lo and hi <= len(text):
                want += [(text[at:lo], None)] * (lo > at) + [(text[lo:hi], k)]
                at = hi
        want += [(text[at:], None)] if text and at < len(text) else []
        assert got.get(n, []) == want and "".join(t for t, _ in want) == (text or "")


def test_doors(spark):
    text = "see v. 2, vv. 1, 9, ch. 2, ch. 7, Alma 5:21, 27 and Nobody 4"
    span = lambda s: (text.index(s), text.index(s) + len(s))
    marks = [_mark("scripture", *span("Nobody 4")), _mark("cite", *span("v. 2"), verse=2), _mark("verse", *span("vv. 1, 9"), low=1, high=9), _mark("chapter", *span("ch. 2"), ch=2), _mark("chapter", *span("ch. 7"), ch=7), _mark("scripture", *span("Alma 5:21, 27"))]
    verses = spark.createDataFrame([("Alma", 1, 1), ("Alma", 1, 2), ("Alma", 1, 4), ("Alma", 2, 1)], "book string, chapter int, verse int")
    rows = notes.doors(spark.createDataFrame([(1, "Alma", 1, text, marks), (2, "Alma", 1, "plain", [])], NOTE), verses).orderBy("note", "nth").collect()
    assert "".join(r["text"] for r in rows if r["note"] == 1) == text
    assert {r["text"]: (r["door"], r["title"]) for r in rows if r["door"]} == {"v. 2": ("verses", "Go to verse 2"), "vv. 1, 9": ("verses", "Go to verses 1, 2, 4"), "ch. 2": ("cite", "Open Alma 2"), "Alma 5:21, 27": ("cite", "Open Alma 5:21,27")}
    assert [r["text"] for r in rows if r["note"] == 2] == ["plain"]


def test_targets(spark):
    one = spark.range(1)
    assert one.select(refs.target_verses(F.lit("34:11–12, 14; 35:2; 34 : 12, 9-8"), 34)).first()[0] == [11, 12, 14]
    entries = spark.createDataFrame([("a", 3, 5, "3:9"), ("b", 4, 5, "3:9"), ("c", None, None, "3:5–6; 3:5"), ("d", None, None, None)], "id string, chapter int, verse int, target string")
    assert {r["verse"]: r["ids"] for r in notes.by_target(entries, 3).collect()} == {5: ["a", "c"], 6: ["c"]}


def test_manifest_of_records(spark, tmp_path):
    """Pages of three dialects, indexed by the lines that count: a chart's intro does not, an essay's prose does."""
    for name, text in {
        "charts/war.md": "# Wars\n* volume: bofm\nsee Alma 1:1\n## One\n- Alma 2:3 // Alma 2:4 | x\n", "evidences/names.md": "# Names\n## F\n- text Alma 9:9 | Alma 3:1 | Alma 9:8\n### of Ether 1:2\n- g | Ether 1\n",
        "essays/1-way.md": "# Way\n<details>\n<summary>Said Moroni 1:1 — him</summary>\n> It was. (Moroni 2:2)\n</details>\nAlma 2:3\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    read = lambda kind: corpus.read_markdown(spark, str(tmp_path / kind))
    made = {"charts": (records.charts, manifest.chart_lines), "evidences": (records.evidences, manifest.evidence_lines), "essays": (records.essays, manifest.essay_lines)}
    pages = lines = None
    for kind, (parse, listed) in made.items():
        parsed = parse(read(kind)).cache()
        section = F.concat(F.lit(f"{kind}/"), "slug")
        p = parsed.select(section.alias("section"), F.lit(kind).alias("kind"), "title", F.lit("bofm").alias("volume_id"))
        own = listed(parsed).select(section.alias("section"), "line")
        pages, lines = (p, own) if pages is None else (pages.unionByName(p), lines.unionByName(own))
    path = str(tmp_path / "manifest")
    manifest.write_manifest(pages, lines, path)
    got = {(r["book"], r["chapter"], r["section"]): list(r["verses"]) for r in manifest.read_study(spark, path).collect()}
    way, war, names = "essays/translation-way", "charts/war", "evidences/names"
    assert got == {("alma", 2, war): [3, 4], ("alma", 2, way): [3], ("alma", 3, names): [1], ("ether", 1, names): [2], ("moroni", 1, way): [1], ("moroni", 2, way): [2]}
    assert [r["title"] for r in manifest.read_study(spark, path, "Alma", 2).orderBy("page").collect()] == ["Wars", "Way"]
    assert manifest.read_pages(spark, path).count() == 3 and spark.read.parquet(f"{path}/at").where("key = 'alma|2'").first()["entries"] == [[0, 3, 4], [1, 3]]


@pytest.mark.parametrize("order", [1, -1])
def test_remembered_searches(order):
    events = [(1, "Faith"), (5, " hope "), (3, "faith"), (4, ""), (9, "a"), (9, "b"), (2, "old")]
    assert recent.remembered([], events[::order], 4) == [(9, "a"), (9, "b"), (5, "hope"), (3, "faith")]
    assert recent.remembered(recent.remembered([], events[:3]), events[3:]) == recent.remembered([], events)


def test_recent_searches_over_a_stream(spark, tmp_path):
    """Batches out of order, folded case, a stop and a restart from the checkpoint, late searches and users who are forgotten."""
    schema = "user int, q string, at timestamp"
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))

    def batch(*rows):
        spark.createDataFrame([(u, q, f"2024-{t}") for u, q, t in rows], "user int, q string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(source)

    def run():
        events = spark.readStream.schema(schema).parquet(source)
        told = recent.recent_searches(events, "user", "q", "at", keep="30 days")
        stream = told.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert stream.awaitTermination(120)
        last = {}
        for r in spark.read.parquet(out).orderBy("batch").collect():
            last[r["user"]] = r["searches"]
        return last

    batch((1, "b", "01-01 02:00:00"), (1, "Alma", "01-01 01:00:00"), (2, "x", "01-01 01:30:00"), (None, "n", "01-01 01:00:00"), (1, None, "01-01 03:00:00"))
    assert run() == {1: ["b", "Alma"], 2: ["x"]}
    batch((1, "ALMA", "01-01 02:30:00"), (1, "early", "01-01 01:40:00"), *((3, f"s{n}", f"01-01 02:0{n}:00") for n in range(7)))
    assert run() == {1: ["ALMA", "b", "early"], 2: ["x"], 3: ["s6", "s5", "s4", "s3", "s2"]}
    batch((1, "new", "03-01 00:00:00"))
    run()
    batch((1, "too late", "01-02 00:00:00"), (1, "newer", "03-01 00:10:00"))
    got = run()
    assert got[1] == ["newer", "new", "ALMA", "b", "early"] and got[2] == [] and got[3] == []
