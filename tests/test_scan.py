"""Scanned pages: blocks, cleaning and places, against plain loops and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import align, scan

LINES = "file string, page int, line_no int, line string"


def _lines(spark, *lines, page=1):
    return spark.createDataFrame([("f", page, n, t) for n, t in enumerate(lines)], LINES)


def _blocks(spark, *lines):
    return [(r["number"], r["text"]) for r in scan.scan_blocks(_lines(spark, *lines)).orderBy("block").collect()]


def test_blocks_of_a_scan(spark):
    assert _blocks(spark, "CHAPTER 1", "1. In the begin-", "ning it was.", "42", "2. And so on.") == [(1, "In the beginning it was."), (2, "And so on.")]
    # What follows a line of apparatus is passed over until the page turns, a heading or a verse comes.
    assert _blocks(spark, "1. And they", "a, 1 Ne. 3:7", "among whom there is a mixture", "17", "went forth", "e, see b, Alma 3:4", "of them", "2 . And it", "e, see c, Alma 3:5", "CHAPTER 2", "a note on it", "3, Now") == [(1, "And they went forth"), (2, "And it"), (3, "Now")]
    # A line is asked what it is before its number: apparatus opens no verse.
    assert _blocks(spark, "11. He said", "12. See b Gen. 1:2", "lost", "13; they went") == [(11, "He said"), (13, "they went")]
    assert _blocks(spark, "no verse is open", "1. ", "  ", "2. one  two") == [(2, "one two")]
    two = _lines(spark, "1. a b").union(_lines(spark, "c d").withColumn("file", F.lit("g")))
    assert [(r["file"], r["block"]) for r in scan.scan_blocks(two).collect()] == [("f", 0)]


def test_body_between_markers(spark):
    lines = _lines(spark, "INDEX", "CHAPTER 1.", "1. a", "INDEX", "2. b").union(_lines(spark, "CHAPTER 1.", "1. c").withColumn("file", F.lit("g"))).union(_lines(spark, "1. d").withColumn("file", F.lit("h")))
    got = scan.body(lines, r"^\s*CHAPTER\s+1\.\s*$", r"^\s*(INDEX|CONCORDANCE)\b").orderBy("file", "line_no").collect()
    assert [(r["file"], r["line"]) for r in got] == [("f", "CHAPTER 1."), ("f", "1. a"), ("g", "CHAPTER 1."), ("g", "1. c")]


def test_running_heads_go_and_text_stays(spark):
    """Heads that repeat at the edges of pages go, whatever their figures; a verse that repeats within pages stays."""
    rows = [("f", p, n, t) for p in range(4) for n, t in enumerate([f"THE BOOK. {p}", "", "and so it was", f"{p}. verse of {'abcd'[p]}", "and so it was", f"line {'wxyz'[p]}", f"{p + 4} Chap. I"])]
    lines = spark.createDataFrame(rows, LINES)
    got = sorted((r["page"], r["line_no"]) for r in scan.without_running_heads(lines, edge=1).collect())
    assert got == [(p, n) for p in range(4) for n in range(1, 6)]
    assert scan.without_running_heads(lines, least=5).count() == len(rows)


@pytest.mark.parametrize(
    "dirty, clean",
    [
        ("knew that God ENOS. could not lie", "knew that God could not lie"),
        ("my -firstborn  son", "my firstborn son"),
        ("go forth Into the wilderness. In it In Israel", "go forth into the wilderness. In it in Israel"),
        ("x In Is y", "x in Is y"),
        ("Hearken, 0 ye people 10", "Hearken, O ye people 10"),
        ("unto 6all men 11th 6ALL", "unto all men 11th 6ALL"),
        ("tbe LamanItes saw U8 and theNephites tbex", "the Lamanites saw us and the Nephites tbex"),
        ("he said “ it ” , and • ! went ;", "he said it, and ! went;"),
        ("", ""),
    ],
)
def test_tidy(spark, dirty, clean):
    assert spark.createDataFrame([(dirty,)], "t string").select(scan.tidy(F.col("t"))).first()[0] == clean


def test_unfuse(spark, monkeypatch):
    from lectern.operators import joins

    vocab = spark.createDataFrame([(w,) for w in ("michael", "heavenly", "ordain", "zion", "with", "the", "thing", "ne")], "word string")
    cases = {
        "called him 26Michael, and to 2Aordain": "called him Michael, and to ordain",
        "the 11th day of 52nd 2Mheavenly": "the 11th day of 52nd heavenly",
        "in dZion sacred wTith wTitten w7ith": "in Zion sacred with wTitten with",
        "2ne 1234michael aThe_thing Thing 3xyz": "2ne 1234michael aThe_thing Thing 3xyz",
        "": "",
    }
    texts = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    for bound in (200_000, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
        assert {r["id"]: r["text"] for r in scan.unfuse(texts, vocab).collect()} == dict(enumerate(cases.values()))


def _loop_strip(text, scanned, vocab):
    """Runs tried one by one, each by its own likeness."""
    import re

    def noise(t):
        s = re.sub(r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "", t)
        tests = [r"[0-9]*", r"[0-9]+[:.\-][0-9]*", "[A-Za-z]{1,3}", "[0-9]{0,2}[A-Za-z]{1,2}[0-9]{0,2}"]
        return any(re.fullmatch(p, s) for p in tests) or bool(re.search(r"[^\x20-\x7E]", t)) or bool(re.fullmatch(rf"(?i)(?:{scan.NOISE})\.?", s)) or bool(re.fullmatch(r"(?:[0-9]\s*)?[A-Z][a-z]{0,4}", s) and re.search("[.,]$", t))

    def like(a, b):
        a, b = scan.Counter(scan._words(a)), scan.Counter(scan._words(b))
        return 2 * (a & b).total() / (a.total() + b.total()) if a and b else 0.0

    while True:
        w, best, score, i = re.split(r"\s+", scanned), scanned, like(scanned, text), 0
        while i < len(w):
            j = i
            while j < len(w) and noise(w[j]):
                j += 1
            a, b = i, j
            while a < b and re.sub("[^A-Za-z]", "", w[a]).lower() in vocab:
                a += 1
            while b > a and re.sub("[^A-Za-z]", "", w[b - 1]).lower() in vocab:
                b -= 1
            if b - a >= 4 and b < len(w) and like(" ".join(w[:a] + w[b:]), text) > score + 0.02:
                best, score = " ".join(w[:a] + w[b:]), like(" ".join(w[:a] + w[b:]), text)
            i = max(j, i + 1)
        if best == scanned:
            return scanned
        scanned = best


def test_strip_apparatus(spark):
    """By hand: runs within go, words at their edges and runs at the end stay; then against the loop on disturbed verses."""
    text = "that ye may learn of me that there is no other way"
    pairs = [
        (1, text, "that ye may learn of me 2k, aei a, 1 Ne. 2. Chap. 88: a. we, 2 No. 1 that there is no other way"),
        (2, "and it came to pass", "and it came to pass see gen x note here"),
        (3, "and it came to pass", "and it came to pass a, 1 Ne. 2. 3:4 b."),
        (4, "in the beginning god made heaven", "in the beginning 1 2 3 god made heaven"),
        (5, None, "1 2 3 4 5 a"), (6, "a b", None), (7, "a b c", ""), (8, "", "1 2 3 4 word"),
    ]
    rng = random.Random(5)
    words = "and it came to pass that he went forth unto the people of me we see land which was".split()
    for k in range(9, 120):
        plain = [rng.choice(words) for _ in range(rng.randrange(5, 25))]
        noisy = list(plain)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(noisy) + 1)
            noisy[at:at] = [rng.choice(["2k,", "1", "Ne.", "88:", "a.", "we,", "see", "•x", "Morm.", "of", "zz"]) for _ in range(rng.randrange(1, 10))]
        pairs.append((k, " ".join(plain), " ".join(noisy)))
    vocab = {w for k, t, _ in pairs if k not in (5, 6, 7) for w in t.split()}
    table = spark.createDataFrame(pairs, "id int, text string, scan string")
    got = {r["id"]: r["scan"] for r in scan.strip_apparatus(table, spark.createDataFrame([(w,) for w in vocab], "word string")).collect()}
    assert got[1] == text and got[2] == pairs[1][2] and got[3] == pairs[2][2] and got[4] == pairs[3][2]
    assert got == {k: s if t is None or s is None else _loop_strip(t, s, vocab) for k, t, s in pairs}
    assert sum(got[k] != s for k, _, s in pairs) > 20


def _cursor(guide, blocks, spare):
    """One cursor over all chapters: {(chapter, verse): block}."""
    at, out = 0, {}
    for chapter in sorted({c for c, _, _ in guide}):
        verses = sorted((v, t) for c, v, t in guide if c == chapter)
        got = align.align([t for _, t in verses], blocks[at : at + len(verses) + spare])
        out |= {(chapter, v): at + j if j >= 0 else None for (v, _), j in zip(verses, got)}
        at += max(got, default=-1) + 1
    return out


@pytest.mark.parametrize("split", [32, 3, 1])
def test_place_as_one_cursor(spark, monkeypatch, split):
    """Splits of any size give what one cursor gives: lost, doubled and changed blocks, chapters that are absent, and no anchors at all."""
    monkeypatch.setattr(scan, "SPLIT", split)
    monkeypatch.setattr(scan, "WARM", min(2, split))
    rng = random.Random(split)
    slots, found, want = [], [], {}
    for volume in ("clear", "muddled", "empty"):
        pool = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(600 if volume == "clear" else 12)]
        guide = [(c, v, " ".join(rng.choice(pool) for _ in range(8))) for c in range(1, 20) for v in range(1, rng.randrange(2, 9))]
        blocks = []
        for c, v, t in guide:
            if c in (7, 8) or rng.random() < 0.15 or volume == "empty":
                continue
            blocks += [t if rng.random() < 0.7 else t.replace("a", "o")] * rng.choice([1, 1, 1, 1, 2])
        slots += [(volume, *g) for g in guide]
        found += [(volume, n, t) for n, t in enumerate(blocks)]
        want |= {(volume, *k): j for k, j in _cursor(guide, blocks, scan.SPARE).items()}
    guide, blocks = spark.createDataFrame(slots, "volume string, chapter int, verse int, text string"), spark.createDataFrame(found, "volume string, block int, text string")
    got = {(r["volume"], r["chapter"], r["verse"]): r["block"] for r in scan.place(guide, blocks).collect()}
    assert got == want


def test_edition_and_its_report(spark):
    """Gaps and absent sections get their placeholders; texts lose apparatus and keys; the counts add up."""
    verse = lambda c, v: " ".join(f"{'klmnpqrst'[n]}{'bcdfg'[c]}{'hjvwz'[v]}or" for n in range(9))
    guide = spark.createDataFrame([("v", c, v, verse(c, v)) for c in range(4) for v in range(4)], "volume string, chapter int, verse int, text string")
    kept = [(c, v) for c in range(3) for v in range(4) if (c, v) != (1, 2)]
    texts = [verse(c, v).replace(" p", " 2p") if (c, v) == (0, 1) else verse(c, v).replace(" p", " 2k, 1 Ne. 2. 88: b. p") if v == 3 else verse(c, v) for c, v in kept]
    blocks = spark.createDataFrame([("v", n, t) for n, t in enumerate(texts)], "volume string, block int, text string")
    for sections in (True, False):
        made = scan.edition(guide, blocks, sections).cache()
        got = {(r["chapter"], r["verse"]): (r["status"], r["text"]) for r in made.collect()}
        assert got[1, 2] == ("missing", scan.MISSING)
        assert got[3, 0] == (("absent", scan.ABSENT) if sections else ("missing", scan.MISSING))
        assert all(got[c, v] == ("placed", verse(c, v)) for c, v in kept)
        r = scan.edition_report(guide, made).first()
        assert (r["expected"], r["placed"], r["missing"], r["absent"], r["absent_chapters"], r["likeness"], r["low"]) == (16, 11, 1 if sections else 5, 4 if sections else 0, 1 if sections else 0, 1.0, 0)


def test_scan_places_of_whole_documents(spark, monkeypatch):
    """The query as one cursor over each source, whatever the splits."""
    from conftest import SMALL
    from lectern.plans.scan_queries import _scanned, scan_places

    monkeypatch.setattr(scan, "SPLIT", 4)
    guide, blocks = (df.collect() for df in _scanned(spark, SMALL))
    want = {}
    for volume in {r["volume"] for r in guide}:
        texts = {r["block"]: r["text"] for r in blocks if r["volume"] == volume}
        own = _cursor([(r["chapter"], r["verse"], r["text"]) for r in guide if r["volume"] == volume], [texts[n] for n in range(len(texts))], scan.SPARE)
        want |= {(volume, *k): j for k, j in own.items()}
    assert {(r["volume"], r["chapter"], r["verse"]): r["block"] for r in scan_places(spark, SMALL).collect()} == want


def test_numbers_in_order(spark):
    from lectern.operators.joins import numbered

    rows = [(k % 3 or None, (k * 7919) % 1000) for k in range(1000)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "n").orderBy("n").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (r[0] or 0, r[1])) and [r["n"] for r in got] == list(range(1000))
