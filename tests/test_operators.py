from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align, index, refs, search, spans
from lectern.sources import corpus


def _stem(spark, *given):
    out = T.with_stem(spark.createDataFrame([(w,) for w in given], "word string")).collect()
    return {r["word"]: r["stem"] for r in out}


def test_stems(spark):
    got = _stem(spark, "atonement", "atone", "atoneth", "mercy", "merciful", "righteous", "righteousness", "come", "cometh", "teeth", "west", "doeth", "agreement", "as")
    assert got == {"atonement": "aton", "atone": "aton", "atoneth": "aton", "mercy": "merci", "merciful": "merci", "righteous": "righteous", "righteousness": "righteous", "come": "come", "cometh": "come", "teeth": "teeth", "west": "west", "doeth": "doeth", "agreement": "agreem", "as": "as"}


def test_codec_and_shards(spark):
    post = spark.createDataFrame([("a", 46, [3, 5]), ("a", 48, [1])], "stem string, unit int, verses array<int>")
    assert index.encoded(post).collect()[0]["encoded"] == "1a:3.5,2:1"
    assert sorted(map(tuple, index.decoded(index.encoded(post)).collect())) == [("a", 46, [3, 5]), ("a", 48, [1])]
    assert post.select(T.shard_key(F.col("stem"), F.lit(2))).first()[0] == "a_"


def test_postings_in_blocks(spark):
    rows = [("a", u, [u % 7 + 1, 9]) for u in (0, 1, 4095, 4096, 4097, 9000, 1 << 20)]
    post = spark.createDataFrame(rows, "stem string, unit int, verses array<int>")
    strings = index.encoded(post)
    assert {(r["block"], r["encoded"].count(":")) for r in strings.collect()} == {(0, 3), (1, 2), (2, 1), (256, 1)}
    assert sorted((r["stem"], r["unit"], r["verses"]) for r in index.decoded(strings).collect()) == rows


def test_search_on_the_stored_index(spark, tmp_path):
    text = [("ot", "b", 1, 1, "Faith and works"), ("ot", "b", 1, 2, "the works of faith, faith!"), ("ot", "b", 2, 1, "faithful"), ("nt", "c", 3, 1, "works"), ("nt", "c", 3, 2, "faith"), ("nt", "c", 4, 1, "hope of hopes of hope")]
    verses = spark.createDataFrame(text, "volume_id string, book string, unit int, verse int, text string")
    path = str(tmp_path / "index")
    index.write_index(verses, path)

    def found(*args, **more):
        return [(r["unit"], r["hits"], r["shared"], r["verses"], r["first_verse"], r["score"]) for r in search.ranked(search.search(spark, path, *args, **more)).collect()]

    both = [(1, 5, 2, [1, 2], 1, round(5 / 2**0.5 * 3, 6)), (3, 2, 0, [1, 2], 1, round(2 / 2**0.5, 6))]
    assert found("faith works") == both == found("works, FAITH faith")
    assert found("faith works", ("nt",)) == both[1:] and found("faith zzz") == [] == found("")
    assert found("works of faith", phrase=True) == [(1, 1, 1, [2], 2, round(6 / 2**0.5 * 2, 6))]
    assert found("hope of hope", phrase=True) == [(4, 1, 1, [1], 1, round(5 * 2, 6))] and found("faith hope", phrase=True) == []
    assert [(r["word"], r["stem"]) for r in search.missing(spark, path, "faith zzz").collect()] == [("zzz", "zzz")]
    assert [(w, [(r["word"], r["distance"]) for r in f.collect()]) for w, f in search.did_you_mean(spark, path, "fiath wokrs hopes")] == [("fiath", [("faith", 1)]), ("wokrs", [("works", 1)])]
    cut = search.snippets(verses.where("unit = 1 and verse = 2"), path, "faith").first()["runs"]
    assert [(r["text"], r["hit"]) for r in cut] == [("the works of ", False), ("faith", True), (", ", False), ("faith", True), ("!", False)]
    assert search.ranked(search.search(spark, path, "faith works"), size=1, page=1).first()["unit"] == 3


def test_snippets_of_any_text():
    """A window of the width around the first hit, cut where it ends; joined it is the text."""
    import random
    import re

    rng = random.Random(11)
    for _ in range(300):
        text = " ".join(rng.choice(["faith", "works", "FAITH's", "a", "and", "unfaithful"]) for _ in range(rng.randrange(30)))
        runs = [(r["text"], r["hit"]) for r in search._marked(re, text, {"faith", "faiths"}, 40, 15)]
        hits = [m.start() for m in re.finditer(r"(?i)\bfaith('s)?(?![a-z'])", text)]
        begin = max(0, hits[0] - 15) if hits else 0
        assert "".join(t for t, _ in runs) == "…" * (begin > 0) + text[begin : begin + 40] + "…" * (begin + 40 < len(text))
        assert sum(h for _, h in runs) == sum(begin - 1 < h < begin + 40 for h in hits)


def test_osa_is_restricted():
    assert search.osa("atnoement", "atonement") == 1
    assert search.osa("ca", "abc") == 3


def test_find_and_markup(spark):
    one = spark.range(1)
    assert one.select(T.find_count(F.lit("The lathe, the"), "THE")).first()[0] == 3
    runs = one.select(T.find_runs(F.lit("a The b"), "the").alias("r")).first()["r"]
    assert [(r["text"], r["hit"]) for r in runs] == [("a ", False), ("The", True), (" b", False)]
    marked = one.select(T.markup_runs(F.lit("x *i* **b** [t](u)")).alias("m")).first()["m"]
    assert [(r["kind"], r["text"]) for r in marked] == [("text", "x "), ("italic", "i"), ("text", " "), ("bold", "b"), ("text", " "), ("link", "t")]


def test_citations(spark):
    text = spark.createDataFrame([(1, "Alma 1:13–14, 18; Alma 10–11"), (2, "Alma 5:21, 27; 13:11–12"), (3, "Ether 5:4; 2 Nephi 27:12–13"), (4, "from 1830, the 12 apostles"), (5, None)], "k int, t string")
    parsed = [(r["k"], r["book"], r["chapter"], r["verses"]) for r in refs.parse_citations(text, "k", "t").orderBy("k", "at").collect()]
    assert parsed[:4] == [(1, "Alma", 1, [13, 14, 18]), (1, "Alma", 10, []), (2, "Alma", 5, [21, 27]), (2, "Alma", 13, [11, 12])]
    scanned = [(r["k"], r["book"], r["chapter"]) for r in refs.scan_citations(text.where("k > 2"), "k", "t").orderBy("k", "at").collect()]
    assert scanned == [(3, "Ether", 5), (3, "2 Nephi", 27)]


def test_alignment(spark):
    assert align.align(["a b c", "d e f", "g h i"], ["a b x", "g h i"]) == [0, -1, 1]


def test_segments_join_to_the_text(spark):
    verses = spark.createDataFrame([(1, 1, " one  two three four ")], "unit int, verse int, text string")
    marks = spark.createDataFrame([(1, 1, 2, 3, "x"), (1, 1, 3, 3, "y")], "unit int, verse int, w1 int, w2 int, id string")
    got = spans.segments(verses, marks).orderBy("seg").collect()
    assert "".join(r["text"] for r in got) == " one  two three four "
    assert [r["ids"] for r in got] == [[], ["x"], ["x", "y"], []]


def test_volume_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"books": [{"book": "B", "chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "x"}]}]}]}')
    (tmp_path / "d.json").write_text('{"sections": [{"section": 3, "verses": [{"verse": 2, "text": "y"}]}]}')
    got = sorted((r["file"], r["book"], r["chapter"], r["verse"], r["text"]) for r in corpus.read_volumes(spark, str(tmp_path)).collect())
    assert got == [("a", "B", 1, 1, "x"), ("d", "Sections", 3, 2, "y")]
    assert corpus.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0


def _plain_alignment(slots, blocks, gap=-0.35):
    """The table filled cell by cell: a match, else a block left out, else a slot left empty."""
    bag = lambda t: sorted("".join(c if c.isalpha() else " " for c in t.lower()).split())

    def like(a, b):
        a, b, n = bag(a), bag(b), 0
        for w in list(a):
            if w in b:
                b.remove(w)
                n += 1
        every = len(a) + len(b) + n
        return 2 * n / every if every else 0.0

    n, m = len(slots), len(blocks)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        best[i][0] = best[i - 1][0] + gap
    for j in range(1, m + 1):
        best[0][j] = best[0][j - 1] + gap
    came = {}
    for j in range(1, m + 1):
        for i in range(1, n + 1):
            ways = [(best[i - 1][j - 1] + like(slots[i - 1], blocks[j - 1]), "match"), (best[i][j - 1] + gap, "block"), (best[i - 1][j] + gap, "slot")]
            best[i][j], came[i, j] = max(ways, key=lambda w: w[0])
    out, i, j = [-1] * n, n, m
    while i or j:
        way = came.get((i, j), "block" if j else "slot")
        i, j = i - (way != "block"), j - (way != "slot")
        if way == "match":
            out[i] = j
    return out


def test_alignment_ties_and_disturbed_lines(spark):
    import random

    assert align.align(["d", "e", "e f e", "b c d"], ["c f", "d e", "c b", "e e"]) == [0, 1, -1, 2]
    rng = random.Random(2)
    for _ in range(60):
        sides = [[" ".join(rng.choices("abcdef", k=rng.randint(0, 4))) for _ in range(rng.randint(0, 7))] for _ in (0, 1)]
        assert align.align(*sides) == _plain_alignment(*sides)
    own = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(300)]
    lines = [f"line of words w{w} x{w} y{w}" for w in own]
    scan = [t.replace("words", "w0rds") for i, t in enumerate(lines) if i % 7 != 3]
    assert align.align(lines, scan) == [-1 if i % 7 == 3 else scan.index(t.replace("words", "w0rds")) for i, t in enumerate(lines)]
    from lectern.plans import study_queries

    got = study_queries.align_lines(spark, "/root/testdata/sf0.001").collect()
    put = [r for r in got if r["block"] is not None]
    assert len(put) > 0.6 * len(got) and sum(r["block"] // 2 == r["verse"] for r in put) > 0.8 * len(put)


def test_article_tiers(spark):
    from lectern.operators import reports

    rows = spark.createDataFrame([("The War Chapters", "Battles of Alma"), ("Miracles & Signs", "by place"), ("Psalms", None)], "title string, subtitle string")

    def score(typed):
        return {r["title"]: (r["score"], r["strong"]) for r in reports.articles(rows, "title", "subtitle", typed).collect()}

    assert score("war chapters") == {"The War Chapters": (100, True)} and score("the war") == {"The War Chapters": (80, False)}
    assert score("war chap") == {"The War Chapters": (80, True)} and score("sig") == {"Miracles & Signs": (60, False)}
    assert score("acles") == {"Miracles & Signs": (45, False)} and score("alm") == {"Psalms": (45, False), "The War Chapters": (30, False)}
    assert score("attles") == {"The War Chapters": (20, False)} and score("alma war") == {"The War Chapters": (12, False)}
    assert score("wa") == {} and score("nothing") == {}


def test_span_labels(spark):
    from lectern.operators import dims

    rows = spark.createDataFrame([("c. 600–592 B.C.", "A.D. 1—4"), ("A.D. 34", "A.D. 34"), ("A.D. 34 · Zion", "A.D. 34"), ("10-12", "12–14 · x"), ("5–6", "7–5")], "a string, b string")
    assert [r[0] for r in rows.select(dims.span_label(rows["a"], rows["b"])).collect()] == ["c. 600–4", "A.D. 34", "A.D. 34", "10-12–14", "5–5"]


def _porter(w, kept):
    """The stemmer by its definition: classes of letters, measures, and steps, without patterns."""
    if len(w) < 3:
        return w

    def classes(x):
        out = ""
        for i, c in enumerate(x):
            out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
        return out

    def measure(x):
        runs = "".join(c for i, c in enumerate(classes(x)) if not i or classes(x)[i - 1] != c)
        return runs.count("vc")

    short = lambda x: classes(x)[-3:] == "cvc" and len(classes(x).lstrip("c")) == 2 and x[-1] not in "wxy"
    double = lambda x: len(x) > 1 and x[-1] == x[-2] and x[-1] not in "aeiouylsz"

    def restored(x):
        if x.endswith(("at", "bl", "iz")):
            return x + "e"
        if double(x):
            return x[:-1]
        return x + "e" if measure(x) == 1 and short(x) else x

    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith(("ss", "us")):
        w = w[:-1]
    if w not in kept:
        for end in ("edst", "eth", "est"):
            if w.endswith(end) and measure(w[: -len(end)]) > 0:
                w = restored(w[: -len(end)])
                break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                w = restored(w[: -len(end)]) if "v" in classes(w[: -len(end)]) else w
                break
    if w.endswith("y") and "v" in classes(w[:-1]):
        w = w[:-1] + "i"
    for table in (T.STEP2, T.STEP3):
        for end, to in table.items():
            if w.endswith(end) and measure(w[: -len(end)]) > 0:
                w = w[: -len(end)] + to
                break
    for end in T.STEP4:
        if w.endswith(end) and measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4] in "st"):
            w = w[: -len(end)]
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def test_stems_by_definition(spark):
    """Every word of the small documents, and words of each ending."""
    made = [a + b for a in ("relat", "condit", "sit", "hop", "fall", "tri", "agr", "b", "oper", "vietnam", "con", "adjust", "rat", "sky", "happ") for b in ("", "e", "ed", "edst", "eth", "est", "ing", "y", "ies", "sses", "ational", "tional", "ization", "fulness", "iveness", "icate", "ative", "ement", "ion", "able", "ll", "ous", "eed")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = {r["word"] for r in index.tokens(corpus.document_verses(docs)).select("word").distinct().collect()} | set(made) | set(T.NOT_A_VERB)
    got = _stem(spark, *sorted(words))
    assert {w: s for w, s in got.items() if s != _porter(w, T.NOT_A_VERB)} == {}


def test_bands_by_hand(spark):
    from lectern.operators import dims

    sizes = [("v", 1, "a", 1), ("v", 2, "b", 2), ("v", 3, "c", 5), ("v", 4, "d", 1), ("v", 5, "e", 1), ("v", 6, "f", 2), ("v", 7, "g", 1), ("w", 1, "h", 3), ("w", 2, "i", 3)]
    rows = spark.createDataFrame(sizes, "volume_id string, book_pos int, book string, n int")
    got = sorted((r["volume_id"], r["book"], r["band"]) for r in dims.bands(rows).collect())
    # a and b share, c ends their band and stands alone, d to f fill one of three, g opens the next; large books stand alone.
    want = [("v", "a", 0), ("v", "b", 0), ("v", "c", 1), ("v", "d", 2), ("v", "e", 2), ("v", "f", 2), ("v", "g", 3), ("w", "h", 0), ("w", "i", 1)]
    assert got == want


def test_files_of_a_folder(spark, tmp_path):
    for name in ("b.md", "a.md", "c.json"):
        (tmp_path / name).write_text("x")
    assert [(r["file"], r["nth"]) for r in corpus.list_files(spark, str(tmp_path), "*.md").orderBy("nth").collect()] == [("a.md", 1), ("b.md", 2)]
    assert corpus.list_files(spark, str(tmp_path / "none")).count() == 0
