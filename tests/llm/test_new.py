"""Piece ids, fill-in-the-middle and the filter audit against the library, plain loops and their SQL."""

import hashlib
import itertools
import re

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, block long, h1 string, part string, good string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "clash", 7, "clash", "clash", "clash") for i, t, lang in rows], SCHEMA)


TEXTS = [
    None, "", " ", "   ", "a", "a ", " a", "  a   b  ", "▁", "a▁▁b▁", "\t\n a\x0b\x0c\r b\r\n", "<s> </s> <unk> <0x41> <P>", "é é ﬁ ½ \xa0   ﻿ 　x", "日本語のテキスト です", "😀 👩‍👩‍👧 \U0010ffff",
    "\x00 a\x00b", "word " * 400, "x" * 5000, "the quick brown fox " * 3, "the quick brown fox " * 3, " " * 70, "naïve café déjà vu — “quoted”… end", "ABC DEF GHI", "a # b",
]


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_pieces_as_the_library(spark, monkeypatch, block):
    """Ids and decoded texts of the library, in one block and in blocks of a text or two; nulls, repeated rows, clashing columns."""
    import sentencepiece
    from lectern.llm import pieces

    monkeypatch.setattr(pieces, "BLOCK", block)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, "no id", None)]
    got = pieces.encode(_docs(spark, rows), MODEL, ("doc_id", "text", "ids")).toDF("doc_id", "text", "clash", "found", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = model.encode(r["text"] or "", add_eos=True)
        assert (r["found"], r["decoded"], r["clash"]) == (ids, model.decode(ids), "clash")
    assert pieces.encode(_docs(spark, rows).limit(0), MODEL).count() == 0


def test_pieces_of_whole_documents(spark):
    """The query on the whole table, digest by digest."""
    import sentencepiece
    from lectern.llm import queries, staging

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op11_sentencepiece(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = model.encode(t, add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
    staging.release()


def test_tables_that_begin_anew_and_long_texts_by_parts(spark, monkeypatch):
    """A table of two words, decoding by few ids at a time: the same ids and texts."""
    import sentencepiece
    from lectern.llm import pieces

    monkeypatch.setattr(pieces, "HELD", 2)
    monkeypatch.setattr(pieces, "PART", 3)
    model, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Table(MODEL)
    texts = [t or "" for t in TEXTS]
    flat, offsets, decoded = table.encode(texts)
    for n, t in enumerate(texts):
        ids = model.encode(t, add_eos=True)
        assert flat[offsets[n] : offsets[n + 1]].tolist() == ids and decoded[n] == model.decode(ids)


def test_each_distinct_word_is_segmented_once(monkeypatch):
    from lectern.llm import pieces

    asked, segment = [], pieces.segment
    monkeypatch.setattr(pieces, "segment", lambda words, file: asked.extend(words) or segment(words, file))
    table = pieces.Table(MODEL)
    table.encode(["the same words", "and the same words again"])
    table.encode(["again the same"])
    assert sorted(asked) == sorted({f"▁{w}" for w in "the same words and again".split()})


def test_pieces_that_cross_words_are_refused(monkeypatch):
    import sentencepiece
    from lectern.llm import pieces

    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "of▁the"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        pieces.load.__wrapped__(MODEL)


def test_units_by_windows(monkeypatch):
    """Windows of any length give the offsets of the pattern over the whole text."""
    from lectern.llm import middle

    for text in [t or "" for t in TEXTS] + ["a  b\n\nc " * 50 + "  "]:
        for window in (1, 3, 10, 1 << 17):
            monkeypatch.setattr(middle, "WINDOW", window)
            assert middle.ends(text).tolist() == [m.end() for m in re.finditer(middle.UNIT, text)]


def _middle(doc_id, text):
    """The contract, step by step."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest, n = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_by_the_contract(spark):
    """Every kind of text under many ids, repeated rows, a null id, texts that end like a marker; all are restored."""
    from lectern.llm import middle

    texts = TEXTS + ["<", "a <", "<S", "a> b <P c <M", "x<S y<P z<", "a<P>b"]
    rows = [(i, texts[i % len(texts)], "en") for i in range(12 * len(texts))] + [(5, texts[5], "en"), (None, "no id at all", "en")]
    got = middle.rearrange(_docs(spark, rows), ("doc_id", "text", "h1")).withColumn("again", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == _middle(r["doc_id"], r["text"] or "")
        assert r["again"] == (r["text"] or "")
    assert middle.rearrange(_docs(spark, rows).limit(0)).count() == 0


def _audit(rows, labels):
    """Every order applied to every row."""
    fails, least = [], {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((part or "", {k for k, v in own.items() if v}, *labels.get(i, (False, False))))
    out, total = [], {}
    for part in {f[0] for f in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = [f for f in fails if f[0] == part]
            for k, name in enumerate(order):
                gone = [f for f in alive if name in f[1]]
                alive = [f for f in alive if name not in f[1]]
                failing = [f for f in fails if f[0] == part and name in f[1]]
                total[part, name] = total.get((part, name), 0) + len(gone)
                out.append((part, order, k + 1, len(alive), len(gone), len(failing) - len(gone), sum(len(f[1]) == 1 for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("light", [1000, 1])
def test_filter_audit_by_all_orders(spark, monkeypatch, light):
    """Nulls, empty and long texts, copies with equal, larger and no ids, several labels, clashing columns, hot texts dealt out."""
    from lectern.llm import staging
    from lectern.llm.filter_audit import audit, flags

    monkeypatch.setattr(staging, "LIGHT", light)
    monkeypatch.setattr(staging, "FEW", 0)
    long = " ".join(f"w{k}" for k in range(120))
    rows = [(i, t, ["en", None, "de"][i % 3]) for i, t in enumerate(TEXTS + [long, long, long.upper(), long + " #", long + " &", "w " * 150])]
    rows += [(3, TEXTS[3], "de"), (None, long, "en"), (None, None, None), (90, long, "en"), (90, long, "en")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 30, 2)] + [(4, 1, None), (25, 1, 0), (25, 0, 1), (None, 1, 1)]
    said = {}
    for i, q, t in labels:
        if i is not None:
            old = said.get(i, (False, False))
            said[i] = (old[0] or q == 1, old[1] or t == 1)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = audit(flags(_docs(spark, rows), table), list("ABCDE"), ["good", "toxic"]).collect()
    assert sorted(map(tuple, got)) == _audit(rows, said)
    assert audit(flags(_docs(spark, rows).limit(0), table), list("ABCDE"), ["good", "toxic"]).count() == 0


def test_audit_of_other_filters(spark):
    """Two filters have two orders; each state is counted once; over eight are refused."""
    from lectern.llm import filter_audit

    rows = spark.createDataFrame([("p", True, True, True), ("p", True, False, False), ("p", False, False, True)], "part string, X boolean, Y boolean, rare boolean")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["rare_lost"], r["shapley"]) for r in filter_audit.audit(rows, ["X", "Y"], ["rare"]).collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (1, 0, 1, 0, 1), ("YX", 1): (2, 1, 0, 1, 1), ("YX", 2): (1, 1, 1, 0, 3)}
    assert filter_audit.walk(rows, ["X", "Y"], []).count() == 4
    with pytest.raises(ValueError):
        filter_audit.audit(rows, list("ABCDEFGHI"), [])


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_filter_audit"])
def test_new_queries_by_sql(spark, duck, name):
    from lectern.llm import queries

    ours, theirs = getattr(queries, name)(spark, SMALL).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_pages_of_one_payload_are_dealt(spark, tmp_path, monkeypatch):
    """Most pages with one payload, dealt over tasks on both ways, as well as repeated rows and a null id."""
    from lectern.llm import staging, warc

    rows = [(i, f"http://h/{i}", "the same page" if i % 4 else f"page {i}") for i in range(60)] + [(7, "http://h/7", "the same page"), (None, "http://h/x", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, warc.round_trip(table, str(tmp_path / "a")).collect()))
    monkeypatch.setattr(staging, "LIGHT", 2)
    monkeypatch.setattr(staging, "FEW", 0)
    assert sorted(map(str, warc.round_trip(table, str(tmp_path / "b")).collect())) == want and len(want) == len(rows)


@pytest.mark.parametrize("rows, entries", [(100_000, 1_000_000), (100_000, 5), (2, 1_000_000)])
def test_found_is_broadcast_only_if_short(spark, monkeypatch, rows, entries):
    from lectern.llm import staging

    monkeypatch.setattr(staging, "FOUND_ROWS", rows)
    monkeypatch.setattr(staging, "FOUND_ENTRIES", entries)
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(9)], "key long, text string")
    found = staging.stage(spark.createDataFrame([(k, [1] * k) for k in range(4)], "key long, found array<int>"), "found")
    both = staging.join_found(texts, found)
    assert sorted((r["key"], len(r["found"])) for r in both.collect()) == [(k, k) for k in range(4)]
    assert ("BroadcastHashJoin" in both._jdf.queryExecution().optimizedPlan().toString() or "strategy=broadcast" in both._jdf.queryExecution().optimizedPlan().toString()) == (rows > 3 and entries > 6)


def test_join_beyond_the_bound_of_a_broadcast(spark):
    """A table too long to broadcast is repeated and merged: the same rows, and no broadcast however small its files look."""
    from pyspark.sql import functions as F

    from lectern.llm import staging

    left = spark.range(100).select((F.col("id") % 7).alias("k"), "id", F.array("id").alias("l"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        got = [staging.join_bounded(left, right, "k", 5, bound, how=how) for bound in (5, 4)]
        a, b = (sorted(map(str, x.select("k", "id", "l", "w").collect())) for x in got)
        assert a == b and len(a) == (72 if how == "inner" else 100)
        assert "Broadcast" not in got[1]._jdf.queryExecution().executedPlan().toString()


def test_a_large_group_of_copies_is_linked_as_a_small_one(spark):
    """Copies with one edit each: what they share weighs enough beside the edits, however many they are."""
    from lectern.llm.neardup import near_duplicates

    texts = []
    for g, size in enumerate((6, 300)):
        core = [f"g{g}w{i}" for i in range(150)]
        for i in range(size):
            at = 10 + 7 * (i % 19)
            texts.append(" ".join([*core[:at], f"g{g}own{i}", *core[at + 1 :]]))
    texts += [" ".join(f"t{j}n{i}" for i in range(20)) for j in range(200)]
    got = {r["doc_id"]: r for r in near_duplicates(_docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert [got[i]["class_size"] for i in (0, 5, 6, 305, 306)] == [6, 6, 300, 300, 1]
    assert {got[i]["class_id"] for i in range(6, 306)} == {6}
