"""The pipeline and each of its stages: planted cases, nulls, empty tables, clashing columns, repeated rows."""

import os

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n_removed", "n_bytes", "n_spans", "kept_text", "kept_sha256", "__key", "node", "class_id", "score", "lang_pred", "key", "size", "taken", "c0", "_0"]


def _words(seed, n, letters):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(300)]
    return " ".join(rng.choice(vocabulary, n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Folder of a small corpus and its rows."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage, item = _words(900, 60, "abcdef"), _words(901, 20, "abcdef")
    texts = [(_words(i, 80, "abcdefg" if i % 2 else "nopqrst"), "aa" if i % 2 else "bb") for i in range(60)]
    texts[3] = (texts[3][0] + " " + item, "aa")  # benchmark words
    texts[5], texts[7] = (texts[5][0] + passage, "aa"), (texts[7][0] + passage, "aa")  # a shared passage
    texts[10] = (texts[8][0], "bb")  # an exact copy
    texts[12] = (texts[14][0] + " odd", "bb")  # a near copy
    rows = [(i, t, g, f"s{i % 3}", len(t)) for i, (t, g) in enumerate(texts)]
    rows += [(60, None, "aa", "s0", 0), (61, "", None, None, 0), (62, "12 34 !", None, "s1", 7), rows[20], (None, texts[22][0], "bb", "s2", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("q", item), ("none", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, passage


def test_stages_take_effect(spark, corpus):
    import corpus_pipeline as P

    folder, rows, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "mixing"]
    first = stages["language_id"](spark, docs, folder)
    assert sorted(map(tuple, first.collect()), key=str) == sorted([r for r in rows if r[0] not in (60, 61, 62)], key=str)
    near = stages["near_dedup"](spark, docs, folder).collect()
    ids = [r["doc_id"] for r in near]
    # The larger id of each pair of copies goes, repeated rows are one, a row without id is the last of its copies.
    assert sorted(i for i in ids if i is not None) == sorted({r[0] for r in rows if r[0] is not None} - {10, 14}) and None not in ids
    cut = {r["doc_id"]: r for r in stages["suffix_dedup"](spark, docs.where("doc_id in (5, 7, 9, 60)"), folder).collect()}
    assert passage not in cut[5]["text"] and passage not in cut[7]["text"] and cut[9]["text"] == rows[9][1] and cut[60]["text"] is None
    assert cut[5]["n_chars"] == len(cut[5]["text"]) and len(cut[5]["text"]) == len(rows[5][1]) - len(passage)
    clean = stages["decontamination"](spark, docs, folder)
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {3} and clean.count() == len(rows) - 1
    for stage in list(stages.values())[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert stages["mixing"](spark, docs.limit(0), folder).count() == 0


def test_run_is_its_stages(spark, corpus):
    import corpus_pipeline as P

    folder, rows, _ = corpus
    got = {r["doc_id"]: r for r in P.run(spark, folder).collect()}
    assert set(got) == {r[0] for r in rows if r[0] is not None} - {3, 10, 14, 60, 61, 62}
    assert sum(r["taken"] for r in got.values()) > 0
    assert not [f for f in os.listdir(folder) if "pipeline" in f]


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "suffix_dedup", "decontamination", "mixing"])
def test_columns_with_clashing_names_pass(spark, corpus, name):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 12 or doc_id = 20")
    for c in CLASH:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    long = docs.where("doc_id = 1").withColumn("text", F.repeat(F.lit("long text of many words "), 40_000))
    got = dict(P.STAGES)[name](spark, docs.unionByName(long.withColumn("doc_id", F.lit(99).cast("long"))), folder)
    if name == "mixing":
        assert got.count() == 15
    else:
        assert got.columns == docs.columns
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in got.where("doc_id < 99").collect() for c in CLASH)
