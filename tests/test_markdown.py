from pyspark.sql import functions as F

from lectern.sources import corpus, markdown
from lectern.streaming.recent import last_seen


def test_dialects(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 1830 · Ann\n* role: scribe\n## Alma\n| Ch | Date |\n|--|--|\n| 2–3 | c. 80 |\n| 5 | c. 70 |\n- one | two // three\n\nsome\nprose\n\n> said\n## Judgment calls\n| 9 | none |\n")
    lines = corpus.read_markdown(spark, str(tmp_path))
    assert [(r["book"], r["chapter"], r["date_label"]) for r in markdown.dates(lines).orderBy("chapter").collect()][:3] == [("alma", 2, "c. 80"), ("alma", 3, "c. 80"), ("alma", 5, "c. 70")]
    # A run of chapters has no voice.
    assert [(r["chapter"], r["voice"]) for r in markdown.voices(lines).orderBy("pos").collect()] == [(5, "c. 70")]
    figure = markdown.figures(lines).first()
    assert (figure["year"], figure["name"], figure["facts"]) == (1830, "Ann", {"role": "scribe"})
    assert markdown.bullets(lines).first()["cells"] == [["one"], ["two", "three"]]
    assert sorted((r["kind"], r["text"]) for r in markdown.paragraphs(lines).collect()) == [("quote", "said"), ("text", "some prose")]


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def _read(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.md").write_text(text)
    return corpus.read_markdown(spark, str(tmp_path))


def test_captions_by_hand(spark, tmp_path):
    lines = _read(
        spark, tmp_path,
        a="| 1 | above any book |\n## 1 Nephi\n| Ch | Caption | Section |\n|---|---|---|\n| 1 | gone |\n## Jacob\n2 | bare | S\n| 3 | |\n| iv | x |\n## 1 Nephi\n| 2 | kept | |\n| 2 | kept last |  S2 |\n## 1 nephi\nprose\n",
        b="##  1-NEPHI \n| 2 | later file | |\n| 5 | five | a | b |\n",
    )
    got = sorted(_rows(markdown.captions(lines), "book", "chapter", "caption"))
    assert got == [("1 nephi", 2, "later file"), ("1 nephi", 5, "five"), ("jacob", 2, "bare"), ("jacob", 3, "")]
    assert {(r["chapter"], r["section"]) for r in markdown.captions(lines).where("book = '1 nephi'").collect()} == {(2, None), (5, "a")}


def test_dates_by_hand(spark, tmp_path):
    lines = _read(spark, tmp_path, a="## Alma\n| 1 | gone |\n## Alma\n| 1–3 | run |\n| 2 | again |\n| 4 — 5 | dashed |\n| 9-7 | back |\n| 6 and 7 | no |\n| 8 | |\n6 | no pipe |\n## Omni\n| 1 | o |\n## Omni\n")
    assert _rows(markdown.dates(lines), "book", "chapter", "date_label") == [("alma", 1, "run"), ("alma", 2, "again"), ("alma", 3, "run"), ("alma", 4, "dashed"), ("alma", 5, "dashed")]


def test_voices_by_hand(spark, tmp_path):
    lines = _read(spark, tmp_path, a="| 1 | none |\n## Small Books\n| Chapter | Voice |\n|---|---|\n| Omni 1 | Omni |\n| 3 | Jacob |\n| Omni1 | no |\n| 3 | Enos |\n| Omni 2 | Jacob |\n### Judgment calls\n| 4 | late |\n")
    assert _rows(markdown.voices(lines), "book", "chapter", "voice") == [("omni", 1, "Omni"), ("omni", 2, "Jacob"), ("small books", 3, "Enos")]
    # Order is that of the first naming, be it of a row that a later one replaces.
    assert [r["voice"] for r in markdown.voices_in_order(lines).orderBy("pos").collect()] == ["Omni", "Jacob", "Enos"]


def test_categories_and_related_by_hand(spark, tmp_path):
    known = spark.createDataFrame([("Inflection Point", 0.33), ("War", 0.22)], "name string, weight double")
    lines = _read(spark, tmp_path, a="## Alma\n| 1 | war |\n## Alma\n| 2 | inflection-point |\n| 2 | WAR |\n| 3 | Peace |\n| x | War |\n", b="| **3 Ne. 12–13** | Matthew 5 · Luke 6; 11 · |\n| **D&C 76** | a |\n| **D&C 76** | b | c |\n| Alma 5 | plain |\n| **Alma** | x |\n", c="| **3 Nephi 13** | Matthew 6 |\n")
    assert _rows(markdown.categories(lines, known), "chapter", "name", "weight") == [(2, "Inflection Point", 0.33), (2, "War", 0.22)]
    assert _rows(markdown.related(lines), "book", "chapter", "labels") == [("3 nephi", 12, ["Matthew 5", "Luke 6; 11"]), ("3 nephi", 13, ["Matthew 6"]), ("doctrine and covenants", 76, ["b | c"])]


def test_empty_pages(spark):
    lines = spark.createDataFrame([], "file string, line_no int, line string")
    known = spark.createDataFrame([("War",)], "name string")
    for made in (markdown.captions(lines), markdown.dates(lines), markdown.voices(lines), markdown.voices_in_order(lines), markdown.categories(lines, known), markdown.related(lines), markdown.figures(lines)):
        assert made.count() == 0


def test_repeated_facts(spark, tmp_path):
    lines = _read(spark, tmp_path, a="# 1830 · Ann\n* role: scribe\n* role: printer\n")
    assert markdown.figures(lines).first()["facts"] == {"role": "printer"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "A", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 01:00:00")], "u int, q string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("u int, q string, t timestamp").parquet(str(tmp_path / "in"))
    run = last_seen(events, "u", "q", "t").writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("seen").count() == 1
