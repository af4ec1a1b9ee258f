"""Broken words, and summaries paired from the pieces of pages: by hand."""

import pytest

from pyspark.sql import functions as F

from lectern.operators import joins, pairing, repair

WORDS = "children through under heaven go back man smith smithin reports false report held paid verse verses hin tot the an and ponder reach prophesy miraculous lamb latter day amulet beheld hand".split()


@pytest.mark.parametrize("bound", [200_000, 0])
def test_repair(spark, monkeypatch, bound):
    cases = {
        "the chil dren go": "the children go",
        "thr ough it": "through it",
        "be held under heaven go back": "be held under heaven go back",
        "false r eports h and": "false reports h and",
        "Smit h in the": "Smith in the",
        "an d verses": "and verses",
        "t he man": "the man",
        "miracu-lously Latter-day Amu-lek qwer-tyui": "miraculously Latter-day Amulek qwertyui",
        "chil-\ndren and rea- ch, pro­ phesy t he": "children and reach, prophesy the",
        "chil, dren chil dren.": "chil, dren children.",
        "About 600– 592b.c. and a.d. 30 –33, 80 B.C.": "About 600–592 B.C. and A.D. 30–33, 80 B.C.",
        "verses ponders r eporting": "verses ponders reporting",
        "": "", "  ": "",
    }
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    texts = spark.createDataFrame([*enumerate(cases), (99, None)], "id int, text string")
    got = {r["id"]: r for r in repair.repair(texts, spark.createDataFrame([(w,) for w in WORDS], "word string")).collect()}
    assert {k: r["text"] for k, r in got.items()} == dict(enumerate([*cases.values()])) | {99: ""}
    assert got[0]["merges"] == ["chil dren -> children"] and got[3]["merges"] == ["r eports -> reports"] and got[2]["merges"] == []


def test_repair_undoes_planted_breaks(spark):
    """The query: breaks within words whose halves are no words are undone, whole documents stay whole."""
    from conftest import SMALL
    from lectern.plans.repair_queries import _broken, repaired_texts

    texts, dictionary, whole = _broken(spark, SMALL)
    known = {r["word"] for r in dictionary.collect()}
    want = {r["id"]: r["text"] for r in whole.collect()}
    broken = {r["id"]: r["text"] for r in texts.collect()}
    got = {r["doc_id"]: r for r in repaired_texts(spark, SMALL).collect()}
    assert got.keys() == want.keys() and sum(r["n_merges"] for r in got.values()) > 100
    import hashlib

    for i, t in broken.items():
        text, merges = repair.rejoined(t, known)
        assert (got[i]["text_md5"], got[i]["n_merges"]) == (hashlib.md5(text.encode()).hexdigest(), len(merges))
    exact = [i for i in want if got[i]["text_md5"] == hashlib.md5(want[i].encode()).hexdigest()]
    assert len(exact) > 0.1 * len(want)


def test_running_heads(spark):
    heads = {
        "391 1 SAMUEL 7:11–8:13": ("1 Samuel", None, 8), "3841 SAMUEL 2:5–21": ("1 Samuel", None, None), "343 JOSHuA 24:28–JuDGES 1:7": ("Joshua", "Judges", 1),
        "CO VENANTS": (None, None, None), "DOCTRINE AND CO VENANTS 4:2": ("Doctrine and Covenants", None, None), "12 HAGG AI 1:1 – 2:3": ("Haggai", None, 2), "PSALM 149:5–PROVERBS 1:11": ("Psalms", "Proverbs", 1),
        "7 JOSEPH SMITH—MATTHEW 1:3": (None, "Matthew", 1), "": (None, None, None), None: (None, None, None),
    }
    got = pairing.parse_heads(spark.createDataFrame([(h,) for h in heads], "head string")).collect()
    assert {r["head"]: (r["first"], r["second"], r["second_start"]) for r in got} == heads


def test_titles(spark):
    titles = {"THE FIRST BOOK OF SAMUEL": "1 Samuel", "The Sec ond Epistle of Paul to the Corin thians": "2 Corinthians", "THE GENERAL EPISTLE OF JUDE": "Jude", "The Gospel According to St John": "John", "THE THIRD EPISTLE OF JOHN": "3 John", "THE BOOK OF ENOS": "Enos", "SOLOMON’S SONG": "Solomon's Song", "NOTHING": None, "": None}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", pairing.book_of_title(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["b"] for r in got} == titles


def test_summaries(spark):
    """Headings first, then titles, then what was put in by hand; a page that straddles two books; pages that wait for a head."""
    text = lambda s: f"{s} is told here at some length"
    pages = spark.createDataFrame([("f", 1, None), ("f", 2, "5 EXODUS 1:1–2:3"), ("f", 3, "6 EXODUS 39:1–LEVITICUS 1:4"), ("f", 4, "Some Thing"), ("f", 5, "Some  Thing")], "file string, page int, head string")
    pairs = spark.createDataFrame([("f", 1, 1, 1, text("exodus one")), ("f", 2, 1, 1, text("again")), ("f", 2, 2, 2, "short"), ("f", 3, 1, 40, text("exodus forty")), ("f", 3, 2, 2, text("leviticus two")), ("f", 3, 3, 3, text("exodus three")), ("f", 4, 1, 9, text("nowhere"))], "file string, page int, at int, chapter int, text string")
    titles = spark.createDataFrame([("f", 1, 0, "THE SECOND BOOK OF MOSES CALLED"), ("f", 1, 33, "EXODUS"), ("f", 3, 500, "THE THIRD BOOK CALLED LEVITICUS"), ("f", 4, 0, "THE BOOK OF RUTH"), ("f", 5, 0, "ARTICLES OF FAITH"), ("f", 5, 90, "JOEL")], "file string, page int, start int, text string")
    blocks = spark.createDataFrame([("f", 3, 100, 140, text("not it")), ("f", 3, 540, 600, text("leviticus one")), ("f", 4, 50, 90, text("ruth overleaf")), ("f", 4, 20, 40, text("no cap near")), ("f", 5, 100, 130, "short")], "file string, page int, start int, end int, text string")
    caps = spark.createDataFrame([("f", 3, 620), ("f", 3, 141), ("f", 4, 400), ("f", 5, 30), ("f", 5, 131)], "file string, page int, at int")
    by_hand = spark.createDataFrame([("Ruth", 1, text("by hand")), ("Ruth", 2, text("by hand"))], "book string, chapter int, text string")
    got = {(r["book"], r["chapter"]): (r["text"], r["origin"]) for r in pairing.summaries(pages, pairs, titles, blocks, caps, by_hand).collect()}
    assert got == {
        ("Exodus", 1): (text("exodus one"), "heading"), ("Exodus", 40): (text("exodus forty"), "heading"), ("Leviticus", 2): (text("leviticus two"), "heading"), ("Exodus", 3): (text("exodus three"), "heading"),
        ("Leviticus", 1): (text("leviticus one"), "title"), ("Ruth", 1): (text("ruth overleaf"), "title"), ("Ruth", 2): (text("by hand"), "hand"),
    }
    assert [tuple(r) for r in pairing.unmatched_heads(pages).collect()] == [("Some Thing", 2)]
    assert pairing.unpaired(pairs).first()["unpaired"] == 1


@pytest.mark.parametrize("bits", [6, 24])
def test_filter_of_fixed_size(spark, monkeypatch, bits):
    """The dictionary is never broadcast, a filter is; a full one changes nothing.  Words after letters that are no ASCII are asked for too."""
    monkeypatch.setattr(repair, "FILTER", bits)
    cases = {"the chil dren b held t he an d verses": "the children b held the and verses", "éunder-qwer a-b chil- dren xqw-tyu": "éunder-qwer a-b children xqwtyu", "smi thin qw er": "smithin qw er"}
    got = {r["id"]: r["text"] for r in repair.repair(spark.createDataFrame([*enumerate(cases)], "id int, text string"), spark.createDataFrame([(w,) for w in WORDS], "word string")).collect()}
    assert got == dict(enumerate(cases.values()))
