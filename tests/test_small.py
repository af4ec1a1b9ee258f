"""Names of files and places by hand; volumes as JSON there and back."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import reports, spans
from lectern.sources import corpus


def test_files_of_chapters(spark):
    names = ["09-alma-34-notes.json", "alma-3.json", "04_enos-01.json", "01-1nephi-20-notes.json", "1-nephi-2.json", "alma-34-2.json", "2-nephi.json", "notes/07-words-of-mormon-1_x.json"]
    chapters = [("Alma", 34), ("Alma", 3), ("Alma", 2), ("Enos", 1), ("1 Nephi", 20), ("1 Nephi", 2), ("Nephi", 2), ("Words of Mormon", 1), ("2 Nephi", 2)]
    got = spans.chapter_files(spark.createDataFrame([(n,) for n in names], "file string"), spark.createDataFrame(chapters, "book string, chapter int")).collect()
    assert {(r["book"], r["chapter"]): r["file"] for r in got} == {("Alma", 34): names[0], ("Alma", 3): names[1], ("Enos", 1): names[2], ("1 Nephi", 20): names[3], ("1 Nephi", 2): names[4], ("Nephi", 2): names[4], ("Words of Mormon", 1): names[7]}


def test_places_and_prophets(spark):
    places = spark.createDataFrame([("a", "Manti", None, 1), ("b", "Hill Manti", None, 2), ("c", "Land of Nephi", "Lehi-Nephi", 3), ("d", "Waters of Mormon", None, 4)], "id string, name string, alt_name string, pos int")
    asked = {"manti": "a", "hill MANTI": "b", "the land of Manti": None, "Nephi": "c", "city of Lehi Nephi": "c", "the land of Mormon": "d", "": None, None: None, "Hill of": None}
    rows = spark.createDataFrame([(n,) for n in asked], "n string")
    assert {r["n"]: r["place"] for r in reports.place_named(rows, places, "n").collect()} == asked
    prophets = spark.createDataFrame([("Mormon", 1), ("Nephi (son of Helaman)", 2), ("Nephi", 3)], "name string, pos int")
    said = {"Mormon (narrator)": "Mormon", "Nephi (son of Helaman)": "Nephi (son of Helaman)", "NEPHI (quoting Isaiah)": "Nephi", "Zenos": None, "(x)": None, None: None}
    rows = spark.createDataFrame([(n,) for n in said], "n string")
    assert {r["n"]: r["prophet"] for r in reports.prophet_named(rows, prophets, "n").collect()} == said


def test_volumes_there_and_back(spark, tmp_path):
    verses = spark.createDataFrame([(f, b, c, v, f"{b} {c}:{v}", f"text {v} “x”") for f in ("one", "two") for b in ("B", "A") for c in (1, 2) for v in range(1, 4)], "file string, book string, chapter int, verse int, reference string, text string")
    corpus.write_volumes(verses, str(tmp_path / "v"))
    # A folder for each volume, as the writer has them; the reader names volumes by files.
    back = spark.read.schema(corpus.BOOKS_LAYOUT + ", file string").json(str(tmp_path / "v")).select("file", F.inline("books")).select("file", "book", F.inline("chapters")).select("file", "book", "chapter", F.inline("verses"))
    assert sorted(map(tuple, back.select(*verses.columns).collect())) == sorted(map(tuple, verses.collect()))


def test_markup(spark):
    runs = spark.range(1).select(T.markup_runs(F.lit("a *b* **c** [d](e) * [f")).alias("r")).first()["r"]
    assert [(r["kind"], r["text"], r["link"]) for r in runs] == [("text", "a ", None), ("italic", "b", None), ("text", " ", None), ("bold", "c", None), ("text", " ", None), ("link", "d", "e"), ("text", " ", None), ("text", "*", None), ("text", " ", None), ("text", "[", None), ("text", "f", None)]


def test_windows_over_ranges(spark):
    """The last value before and the running sum of each group, as windows over whole groups have them; nulls in group and value."""
    from pyspark.sql import Window

    from lectern.operators.joins import carried, running

    rows = [(None if k % 5 == 4 else k % 3, (k * 7919) % 500, k if k % 4 == 0 else None) for k in range(500)]
    table = spark.createDataFrame(rows, "g int, o int, v int").repartition(6)
    whole = Window.partitionBy("g").orderBy("o")
    want = table.withColumn("last", F.last("v", True).over(whole.rowsBetween(Window.unboundedPreceding, -1))).withColumn("sum", F.sum(F.coalesce("v", F.lit(0))).over(whole))
    got = running(carried(table, "g", ["o"], "v", "last"), "g", ["o"], F.coalesce("v", F.lit(0)), "sum")
    assert sorted(map(str, got.select("g", "o", "v", "last", "sum").collect())) == sorted(map(str, want.collect()))


def test_a_long_table_is_looked_up_without_a_broadcast_or_copies(spark):
    """Beyond the bound the table is merged as it is: its files may look small enough to broadcast, and copies of it would not be."""
    from pyspark.sql import functions as F

    from lectern.operators.joins import look_up

    asking = spark.range(60).select("id", F.concat(F.lit("w"), F.col("id") % 7).alias("word"))
    table = spark.range(5).select(F.concat(F.lit("w"), "id").alias("word"), F.col("id").alias("nth"))
    for how in ("inner", "left"):
        few, many = (look_up(asking, table, ["word"], how, bound) for bound in (5, 4))
        assert sorted(map(str, few.select("id", "word", "nth").collect())) == sorted(map(str, many.select("id", "word", "nth").collect()))
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Generate" not in plan


def test_segments_leave_words_in_their_verse(spark):
    """Marks that overlap, repeat, lie outside or end before they begin; blanks at both ends; no row a word is shuffled or sorted."""
    verses = spark.createDataFrame([(1, 1, "  a b c  d e f "), (1, 2, "one"), (1, 3, ""), (1, 4, None), (1, 5, " "), (2, 1, "x y z")], "unit long, verse int, text string")
    marks = spark.createDataFrame([(1, 1, 2, 4, "m"), (1, 1, 4, 5, "k"), (1, 1, 2, 4, "m"), (1, 1, 9, 12, "out"), (1, 1, 5, 3, "back"), (1, 2, None, 2, "none"), (1, 2, 0, 0, None), (1, 5, 0, 3, "blank"), (7, 7, 1, 1, "lost")], "unit long, verse int, w1 int, w2 int, id string")
    made = spans.segments(verses, marks)
    assert sorted((r["unit"], r["verse"], r["seg"], r["text"], r["ids"]) for r in made.collect()) == [
        (1, 1, 1, "  a ", []), (1, 1, 2, "b c  ", ["m"]), (1, 1, 3, "d ", ["k", "m"]), (1, 1, 4, "e ", ["back", "k"]), (1, 1, 5, "f ", []), (1, 2, 1, "one", []), (1, 5, 1, " ", ["blank"]), (2, 1, 1, "x y z", []),
    ]
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
