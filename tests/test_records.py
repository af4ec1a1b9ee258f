"""Pages of six dialects as nested records, traced by hand."""

from lectern.sources import corpus, records


def _read(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.md").write_text(text)
    return corpus.read_markdown(spark, str(tmp_path))


def _plain(value):
    """Rows as dictionaries."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _by_slug(df):
    return {r["slug"]: _plain(r) for r in df.collect()}


def test_charts(spark, tmp_path):
    lines = _read(
        spark, tmp_path,
        miracles="# Miracles\n* subtitle: signs\n* Volume: new-testament\n* order: 3\n* columns: What | Who\n* widths: 2 | 1\n\nThe intro\ngoes on.\n\nSecond.\n\n## Healings\nRestorations\nof the body.\n- A leper // note | The leper | | Matt 8:2\n\nmore\n## Essay\n\n\nProse only\n",
        bare="- one | two\n- three\n## Later\n* form: timeline\n- four // \n",
        odd="* order: soon\n* hue: red\n\n  words  \n",
        none="\n",
    )
    got = _by_slug(records.charts(lines))
    assert got["miracles"] == {
        "slug": "miracles", "title": "Miracles", "subtitle": "signs", "volume": "new-testament", "order": 3.0, "form": "table", "columns": ["What", "Who"], "widths": ["2", "1"], "intro": "The intro goes on.\n\nSecond.",
        "parts": [{"name": "Healings", "prose": "Restorations of the body.\n\nmore", "rows": [[["A leper", "note"], ["The leper"], [], ["Matt 8:2"]]]}, {"name": "Essay", "prose": "Prose only", "rows": []}],
    }
    assert got["bare"]["parts"] == [{"name": "", "prose": "", "rows": [[["one"], ["two"]], [["three"]]]}, {"name": "Later", "prose": "", "rows": [[["four"]]]}]
    assert (got["bare"]["title"], got["bare"]["form"], got["bare"]["order"], got["bare"]["columns"]) == ("bare", "timeline", 999.0, [])
    assert (got["odd"]["order"], got["odd"]["intro"], got["odd"]["parts"]) == (None, "* hue: red\n\nwords", [])
    assert (got["none"]["intro"], got["none"]["parts"], got["none"]["title"]) == ("", [], "none")


def test_evidences(spark, tmp_path):
    lines = _read(
        spark, tmp_path,
        names="# Names\n* subtitle: of old\n* order: 2\nAn intro\nof two lines.\n## Phrases\n* gloss: short\nA note\nin two.\n- a phrase | Alma 1:2 | a gloss\n- bare\n## Pairs\n* form: tchart\n###\n* root: yarad\n- Source | text | Gen 1:1\na rung\n### Second\n- Turn | other\n# Names again\n* order: 7\n- late | Alma 2:3\nback to the page\n",
        empty="### no form\n- lost | item\n",
    )
    got = _by_slug(records.evidences(lines))
    item = lambda label, text, ref, gloss: {"label": label, "text": text, "ref": ref, "gloss": gloss}
    assert got["names"] == {
        "slug": "names", "title": "Names again", "subtitle": "of old", "order": 7.0, "intro": "An intro of two lines. back to the page",
        "forms": [
            {"name": "Phrases", "form": "phrases", "gloss": "short", "note": "A note in two.", "items": [item(None, "a phrase", "Alma 1:2", "a gloss"), item(None, "bare", "", "")], "groups": []},
            {"name": "Pairs", "form": "tchart", "gloss": "", "note": "", "items": [], "groups": [
                {"title": "", "root": "yarad", "lines": ["a rung"], "items": [item("Source", "text", "Gen 1:1", None)]},
                {"title": "Second", "root": "", "lines": [], "items": [item("Turn", "other", "", None), item("late", "Alma 2:3", "", None)]},
            ]},
        ],
    }
    assert (got["empty"]["forms"], got["empty"]["intro"], got["empty"]["order"]) == ([], "### no form", 999.0)


def test_essays(spark, tmp_path):
    files = {
        "1-the-way": "# The Way: A Start\n* image: plate.jpg\nBefore any part.\n* image: late.jpg\n## First\nA line.\n<details>\n<summary>He said — so — Joseph, 1830 <em>(expand for full statement)</em></summary>\n> “It was so.” (History, 1:2)\n> unsourced\na note\n</details>\nAfter.\n## Empty\n## Last\n<details>\n> no summary\n## Cut\nend\n",
        "plain": "# Plain\n<details>\n<summary>Only a claim</summary>\n</details>\n<summary>loose</summary>\n",
    }
    got = _by_slug(records.essays(_read(spark, tmp_path, **files)))
    text = lambda t: {"kind": "text", "text": t, "who": None, "parts": []}
    quote = lambda t, who, *parts: {"kind": "quote", "text": t, "who": who, "parts": [{"kind": k, "text": x, "source": s} for k, x, s in parts]}
    assert got["translation-the-way"] == {
        "slug": "translation-the-way", "order": 1, "title": "The Way", "subtitle": "A Start", "image": "plate.jpg",
        "parts": [
            {"name": "", "blocks": [text("Before any part."), text("* image: late.jpg")]},
            {"name": "First", "blocks": [text("A line."), quote("He said — so", "Joseph, 1830", ("said", "“It was so.”", "History, 1:2"), ("said", "unsourced", ""), ("note", "a note", None)), text("After.")]},
            {"name": "Empty", "blocks": []},
            {"name": "Last", "blocks": [quote("", "", ("said", "no summary", ""))]},
            {"name": "Cut", "blocks": [text("end")]},
        ],
    }
    assert (got["translation-plain"]["order"], got["translation-plain"]["subtitle"]) == (999, "")
    assert got["translation-plain"]["parts"] == [{"name": "", "blocks": [quote("Only a claim", ""), text("<summary>loose</summary>")]}]


def test_prophets(spark, tmp_path):
    md = "# Prophets of Old\n# Abinadi\n## Quotes\n- \"**Now** I say\" (Mosiah 13:3–4) — the Lord\n- plain words\n## Roles\n* a `prophet`\n## Hobbies\n- none\n## Timeline\n- In the land: he came (Mosiah 11:20)\n- went\n# Alma\n- no section\n## Key Chapters\n- Alma 5\n## Key Teachings\n- faith\n"
    got = {r["name"]: _plain(r) for r in records.prophets(_read(spark, tmp_path, old=md)).collect()}
    assert got == {
        "Abinadi": {"file": "old.md", "nth": 2, "name": "Abinadi", "quotes": [{"text": "Now I say", "ref": "Mosiah 13:3–4", "said": "the Lord"}, {"text": "plain words", "ref": None, "said": None}], "roles": ["a prophet"], "teachings": [], "chapters": [], "timeline": [{"lead": "In the land", "rest": "he came (Mosiah 11:20)"}, {"lead": None, "rest": "went"}]},
        "Alma": {"file": "old.md", "nth": 3, "name": "Alma", "quotes": [], "roles": [], "teachings": ["faith"], "chapters": ["Alma 5"], "timeline": []},
    }


def test_resources(spark, tmp_path):
    md = "# File\nintro\n### No shelf yet\n## Empty\nlost\n## Books\nlost too\n### A Guide\n* Author: Ann\n* author: Bea\n* cover: a.jpg\n* link: Shop | http://a | more\n* link: Nowhere |\n* link: None\n* LINK: Two|http://b\n\nThe first\n  line.\n* hue: red\n#### deep\n###none\n### Bare\n## Books\n### Third\n"
    got = {r["slug"]: _plain(r["shelves"]) for r in records.resources(_read(spark, tmp_path, nt=md, none="## Shelf\n")).collect()}
    bare = lambda title: {"title": title, "author": "", "detail": "", "cover": "", "links": [], "body": ""}
    guide = bare("A Guide") | {"author": "Bea", "cover": "a.jpg", "links": [{"label": "Shop", "href": "http://a"}, {"label": "Two", "href": "http://b"}], "body": "The first line. * hue: red #### deep ###none"}
    assert got == {"nt": [{"title": "Books", "works": [guide, bare("Bare")]}, {"title": "Books", "works": [bare("Third")]}]}


def test_figures(spark, tmp_path):
    md = "lost\n# Those who came\nlost\n# 1830 · Ann Lee\n* Years: 1802–1895\n* role: scribe\n* role: printer\n* hue: red\n\nShe came.\n---\n## and\n\nwent.\n\n# 1831 - Bea\n* image: bea\n\n# 31 · Cy\nbody\n# 1830 | Di\nx\n"
    got = [_plain(r) for r in records.figures(_read(spark, tmp_path, nt=md)).orderBy("nth").collect()]
    assert got == [
        {"file": "nt.md", "nth": 2, "year": 1830, "name": "Ann Lee", "years": "1802–1895", "role": "printer", "image": "", "body": "* hue: red\n\nShe came.\n## and\n\nwent."},
        {"file": "nt.md", "nth": 5, "year": 1830, "name": "Di", "years": "", "role": "", "image": "", "body": "x"},
    ]


def test_charts_read_their_lines_once(spark):
    """Facts and parts come of one grouping of the lines: they are not made twice to be joined."""
    from lectern.sources import records

    lines = spark.createDataFrame([("a.md", n, s) for n, s in enumerate(["# One", "* order: 2", "* order: 3", "* columns: A | B", "", "Some", "text.", "## P", "- x // y | z", "* form: grid", "## Q", "# Two"])], "file string, line_no int, line string")
    made = records.charts(lines)
    assert [(r["slug"], r["title"], r["order"], r["form"], r["columns"], r["intro"], [(p["name"], p["rows"]) for p in r["parts"]]) for r in made.collect()] == [("a", "Two", 3.0, "grid", ["A", "B"], "Some text.", [("P", [[["x", "y"], ["z"]]]), ("Q", [])])]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
