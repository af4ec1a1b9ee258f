"""The stored index: files, ids of any kind, versions, and updates against full builds."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import index, search

SCHEMA = "volume_id string, book string, unit int, verse int, text string"


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names}


def _found(spark, path, *queries):
    return [sorted((r["volume_id"], r["unit"], r["hits"], r["verses"], r["score"]) for r in search.search(spark, path, q).collect()) for q in queries]


def _words(spark, path):
    return sorted((r["word"], r["cnt"], r["stem"], r["letter"]) for r in index.read_vocabulary(spark, path).collect())


def test_index_files(spark, tmp_path):
    verses = spark.createDataFrame([("v", "b", 1, 1, "Hearken'd and hearkened"), ("v", "b", 2, 1, "and atoned")], SCHEMA)
    path = str(tmp_path / "index")
    index.write_index(verses, path)
    assert [(r["stem"], r["unit"]) for r in index.read_postings(spark, path, ["aton", "absent"]).collect()] == [("aton", 1)]
    assert _words(spark, path) == [("and", 2, "and", "a"), ("atoned", 1, "aton", "a"), ("hearkend", 1, "hearkend", "h"), ("hearkened", 1, "hearken", "h")]
    assert sorted(tuple(r)[:5] for r in index.read_units(spark, path).collect()) == [(0, "v", "b", 1, 1), (1, "v", "b", 2, 1)]
    index.write_index(verses, path, limit=10)  # every prefix with more than ten characters is split
    assert [(r["stem"], r["unit"], list(r["verses"])) for r in index.read_postings(spark, path, ["hearken", "and"]).orderBy("stem", "unit").collect()] == [("and", 0, [1]), ("and", 1, [1]), ("hearken", 0, [1])]
    deep = spark.read.parquet(f"{path}/segments/{index.segments(spark, path)[0]}/deep")
    assert "he" in {r["prefix"] for r in deep.collect()} and os.path.isdir(f"{path}/segments/{index.segments(spark, path)[0]}/postings/shard=hea")


@pytest.mark.parametrize("kind, ids", [("long", [5_000_000_000, 1 << 60, -3]), ("string", ["doc/a", "doc/b", ""])])
def test_units_of_any_id(spark, tmp_path, kind, ids):
    """Ids beyond 2**31 and ids that are strings: units are numbered, results carry the ids."""
    verses = spark.createDataFrame([("v", "b", i, n, t) for i, texts in zip(ids, (["faith and works", "works"], ["works"], ["faith"])) for n, t in enumerate(texts, 1)], SCHEMA.replace("unit int", f"unit {kind}"))
    path = str(tmp_path / "index")
    index.write_index(verses, path)
    got = {r["unit"]: (r["hits"], r["verses"]) for r in search.search(spark, path, "works").collect()}
    assert got == {ids[0]: (2, [1, 2]), ids[1]: (1, [1])}
    assert {r["unit"] for r in search.search(spark, path, "faith works", phrase=True).collect()} == set()
    assert {r["unit"] for r in search.search(spark, path, "faith and", phrase=True).collect()} == {ids[0]}
    wide = spark.createDataFrame([("a", 5_000_000_000, [1]), ("a", 5_000_000_002, [2, 2])], "stem string, unit long, verses array<int>")
    assert sorted(map(tuple, index.decoded(index.encoded(wide)).collect())) == [("a", 5_000_000_000, [1]), ("a", 5_000_000_002, [2, 2])]


def test_update_as_a_full_build(spark, tmp_path, monkeypatch):
    """New, changed and lost units: one more segment with their words alone, old files as they were, results of a full build; then all in one."""
    base = {u: ["faith and works", f"word{'abcdefghij'[u]} of faith"] for u in range(8)}
    table = lambda units: spark.createDataFrame([("v" if u % 2 else None, "b", u, n, t) for u, texts in units.items() for n, t in enumerate(texts, 1)], SCHEMA)
    path = str(tmp_path / "index")
    assert index.update_index(table(base), path) == {"new": 8, "changed": 0, "gone": 0}
    before = _files(f"{path}/segments")
    assert index.update_index(table(base), path) == {"new": 0, "changed": 0, "gone": 0} and _files(f"{path}/segments") == before
    steps = [
        {**base, 3: ["faith, only hope"], 9: ["hope of works", "hope"]},
        {u: t for u, t in {**base, 9: ["hope of works"]}.items() if u not in (1, 2)},
        {9: ["nothing of that"]},
        base,
    ]
    told = [{"new": 1, "changed": 1, "gone": 0}, {"new": 0, "changed": 2, "gone": 2}, {"new": 0, "changed": 1, "gone": 7 - 1}, {"new": 8, "changed": 0, "gone": 1}]
    monkeypatch.setattr(index, "SEGMENTS", 4)
    for n, (units, want) in enumerate(zip(steps, told)):
        files = _files(f"{path}/segments")
        was = index.segments(spark, path)
        assert index.update_index(table(units), path) == want
        names = index.segments(spark, path)
        if n < 3:
            assert names[:-1] == was and files <= _files(f"{path}/segments")
            told_units = spark.read.parquet(f"{path}/segments/{names[-1]}/forward").select("unit_no").distinct().count()
            assert told_units == want["new"] + want["changed"]
        else:
            assert len(names) == 1
        if n in (0, 2):  # a full build takes its time
            continue
        full = str(tmp_path / f"full{n}")
        index.write_index(table(units), full)
        asked = ("faith works", "hope", "worda", "faith", "nothing", "of")
        assert _found(spark, path, *asked) == _found(spark, full, *asked)
        assert _words(spark, path) == _words(spark, full)
        key = lambda p: sorted(map(str, index.read_units(spark, p).select("volume_id", "book", "unit", "verse_count", "digest").collect()))
        assert key(path) == key(full)
        assert [r["unit"] for r in search.search(spark, path, "faith and", phrase=True).orderBy("unit").collect()] == [r["unit"] for r in search.search(spark, full, "faith and", phrase=True).orderBy("unit").collect()]


def test_publishing_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A build that fails leaves the index as it was; a reader's version outlives one publication; a second writer fails."""
    one = spark.createDataFrame([("v", "b", 1, 1, "faith")], SCHEMA)
    two = spark.createDataFrame([("v", "b", 1, 1, "works")], SCHEMA)
    path = str(tmp_path / "index")
    index.write_index(one, path)
    first = index.segments(spark, path)
    with monkeypatch.context() as m:
        m.setattr(index, "deep_prefixes", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.write_index(two, path)
        with pytest.raises(ZeroDivisionError):
            index.update_index(two, path)
    assert index.segments(spark, path) == first and len(_found(spark, path, "faith")[0]) == 1
    reading = search.search(spark, path, "faith")
    index.write_index(two, path)
    assert reading.count() == 1 and _found(spark, path, "faith", "works")[0] == [] and len(_found(spark, path, "works")[0]) == 1
    index.write_index(one, path)
    assert not os.path.exists(f"{path}/segments/{first[0]}")
    with monkeypatch.context() as m:
        m.setattr(index, "_versions", lambda s, p: [1])  # what a writer saw that began before the others
        with pytest.raises(RuntimeError):
            index.publish(spark, path, first)


def test_an_empty_corpus(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    path = str(tmp_path / "index")
    index.write_index(none, path)
    assert _found(spark, path, "faith") == [[]] and _words(spark, path) == []
    assert index.update_index(spark.createDataFrame([("v", "b", 1, 1, "faith")], SCHEMA), path) == {"new": 1, "changed": 0, "gone": 0}
    assert len(_found(spark, path, "faith")[0]) == 1


@pytest.mark.parametrize("bound", [200_000, 0])
def test_stems_of_frequent_and_rare_words(spark, monkeypatch, bound):
    monkeypatch.setattr(index, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(index, "FREQUENT", 4)
    verses = spark.createDataFrame([("v", "b", u, 1, "the the the hopes and fears of the years") for u in range(5)], SCHEMA)
    got = {(r["stem"], r["unit"]): r["verses"] for r in index.postings(verses).collect()}
    assert got["the", 3] == [1] * 4 and got["hope", 0] == [1] and len(got) == 30


def test_a_stored_index_follows_its_documents(spark, tmp_path):
    from lectern.sources.stored import once

    source, built = str(tmp_path / "docs"), []
    spark.range(3).write.parquet(source)
    build = lambda path: (built.append(path), spark.range(1).write.parquet(path))
    first = once(spark, "test index", source, build)
    assert once(spark, "test index", source, build) == first and len(built) == 1
    spark.range(4).write.mode("overwrite").parquet(source)
    assert once(spark, "test index", source, build) != first and len(built) == 2 and not os.path.exists(first)


def test_completions_need_two_letters(spark):
    vocab = spark.createDataFrame([("the", 9, "t"), ("then", 3, "t"), ("thus", 5, "t")], "word string, cnt long, letter string")
    assert search.completions(vocab, "t").count() == 0
    assert [r["word"] for r in search.completions(vocab, "TH").collect()] == ["the", "thus", "then"]
    assert [r["word"] for r in search.completions(vocab, "The").collect()] == ["then"]


def test_a_phrase_shuffles_no_texts(spark, tmp_path):
    """Texts are asked where they stand: no verse is joined, only the numbers of units."""
    from lectern.operators import search as S

    verses = spark.createDataFrame([("en", "b", 1, 1, "of the first"), ("en", "b", 1, 2, "the last of all"), ("en", "b", 2, 1, "of it, and of the rest"), ("en", "b", 2, 2, "Of the end"), ("en", "b", 3, 1, "the of")], "volume_id string, book string, unit long, verse int, text string")
    index.write_index(verses, str(tmp_path / "phrases"))
    made = S.search(spark, str(tmp_path / "phrases"), "of the", phrase=True)
    assert sorted((r["unit"], r["hits"], r["verses"]) for r in made.select("unit", "hits", "verses").collect()) == [(1, 1, [1]), (2, 2, [1, 2])]
    joins = [x for x in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not [x for x in joins if "verse#" in x]
