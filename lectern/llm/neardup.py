"""Near-duplicate documents by improved consistent weighted sampling.

A text is the weighted set of its five-word shingles, weight tf times idf, where
idf counts every shingle of every different text, up to a size of group beyond
which weights stay the same.  Consistent weighted samples
agree with the probability of the weighted Jaccard similarity; bands of them
bring similar texts into common buckets.  In a bucket texts are compared with its
most central member first; where that leaves several classes, an exact join finds
the pairs across them that can be similar.  Every link is verified by the exact
weighted Jaccard similarity, and classes are the components of the links.

A text whose shingles found nowhere else hold more than ``1 - threshold`` of its
weight cannot be similar to any other, so only the rest is sampled and banded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import staging
from .components import components
from .textkit import chunks, mix, shingles, text_buffers, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Texts beyond which a shingle weighs no less, however many have it.
GROUP = 16
#: Bytes of text that stand in one row while shingles are counted, and that one counting group sees the shingles of.
PACK, COUNTED = 2 << 20, 24 << 20
#: Pairs across classes that a text offers at once; the rest waits for the classes that these join.
OFFERED = 4
_rng = np.random.default_rng(1103)
_GAMMA = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_GAMMA = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_SEEDS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_SLACK = 1e-6  # weights are single precision


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of the distinct shingles of each text, by row and shingle."""
    hashes, rows = shingles(*word_hashes(*text_buffers(texts)), WORDS)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], hashes[first], np.diff(np.r_[first, len(rows)])


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Smoothed and damped: one more for each factor of ten that a shingle is rarer, and the same for all that more than ``GROUP`` texts have.

    Else what a large group of copies shares would weigh little beside each
    edit, and copies that a small group links would be lost in a large one.
    """
    return (1 + np.log10((1 + n_docs) / (1 + np.minimum(df, GROUP)))).astype(np.float32)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``PACK`` bytes of texts, named by their first node."""
    for batch in batches:
        _, offsets = text_buffers(batch.column("text"))
        edge = np.array([lo for lo, _ in chunks(offsets, PACK)] + [len(batch)], np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edge), batch.column(c)) for c in ("node", "text")]
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(edge[:-1])), *lists, pa.array(np.diff(offsets[edge]))], ["chunk", "nodes", "texts", "size"])


def _edges(distinct: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` ranges of hashes begins among sorted ones."""
    return np.searchsorted(((distinct >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24), np.arange(parts + 1, dtype=np.uint64))


def _spread(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each chunk by range: their low 40 bits and, for each, the chunk's texts that have it."""
    for batch in batches:
        for chunk, texts in zip(batch.column("chunk"), batch.column("texts"), strict=True):
            distinct, n = np.unique(shingle_sets(texts.values)[1], return_counts=True)
            edge = _edges(distinct, parts)
            low = np.ascontiguousarray(distinct.view(np.uint8).reshape(-1, 8)[:, :5])
            some = np.flatnonzero(np.diff(edge))
            blob = lambda data, width: pa.Array.from_buffers(pa.binary(), parts, [None, pa.py_buffer((edge * width).astype(np.int32)), pa.py_buffer(data)]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([chunk.as_py()] * len(some), pa.string()), blob(low, 5), blob(n.astype(np.int32), 4)], ["part", "chunk", "low", "n"])


def _frequencies(table: pa.Table) -> pa.Table:
    """Places of a range's shingles that several texts have, and how many have them."""
    low, edge = text_buffers(table.column("low").combine_chunks())
    n = text_buffers(table.column("n").combine_chunks())[0].view(np.int32)
    wide = np.zeros((len(n), 8), np.uint8)
    wide[:, :5] = low.reshape(-1, 5)
    wide = wide.view(np.uint64).ravel()
    order = np.argsort(wide)
    first = np.flatnonzero(np.r_[True, wide[order[1:]] != wide[order[:-1]]]) if len(order) else order
    df = np.empty(len(n), np.int32)
    df[order] = np.repeat(np.add.reduceat(n[order], first) if len(first) else first, np.diff(np.r_[first, len(order)]))
    edge, many = edge // 5, np.flatnonzero(df > 1)
    cut = np.searchsorted(many, edge)
    at = (many - np.repeat(edge[:-1], np.diff(cut))).astype(np.int32)
    blob = lambda data: pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(data)])
    return pa.table([table.column("chunk"), table.column("part"), blob(at), blob(df[many])], ["chunk", "part", "at", "df"])


def samples(rows: np.ndarray, hashes: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and for each the low 32 bits of its consistent weighted samples (rows x BANDS * ROWS)."""
    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    out = np.empty((len(heads), len(_SEEDS)), np.uint64)
    low16 = np.uint64(0xFFFF)
    for j, seed in enumerate(_SEEDS):
        u = mix(hashes ^ seed)
        r = _GAMMA[(u & low16).astype(np.int32)]
        beta = ((u >> np.uint64(32)) & low16).astype(np.float32) / np.float32(65536)
        t = np.floor(log_weight / r + beta)
        # ln a = ln c - ln y - r with ln y = r (t - beta); the least a wins.
        a = _LOG_GAMMA[((u >> np.uint64(16)) & low16).astype(np.int32)] - r * (t - beta) - r
        bits = a.view(np.uint32)
        bits = np.where(bits >> 31 != 0, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        name = (u ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)
        out[:, j] = np.minimum.reduceat((bits << np.uint64(32)) | name, heads)
    return rows[heads], out & np.uint64(0xFFFFFFFF)


def signatures(rows: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a shingle, and the keys of their bands."""
    which, found = samples(rows, hashes, np.log(weight))
    keys = np.zeros((len(which), BANDS), np.uint64)
    for j in range(ROWS):
        keys = mix(keys ^ found[:, j::ROWS][:, :BANDS]) + np.uint64(j + 1)
    return which, keys


_SETS = "node string, bands array<bigint>, alone double, total double, hashes binary, weights binary"


def _sample(batches: Iterator[pa.RecordBatch], parts: int, n_docs: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Weighted sets and bands of the texts that can be similar to another."""
    for batch in batches:
        for nodes, texts, found in zip(batch.column("nodes"), batch.column("texts"), batch.column("found"), strict=True):
            rows, hashes, counts = shingle_sets(texts.values)
            distinct, which = np.unique(hashes, return_inverse=True)
            edge, df = _edges(distinct, parts), np.ones(len(distinct), np.int32)
            for f in found.as_py() or ():
                df[edge[f["part"]] + np.frombuffer(f["at"], np.int32)] = np.frombuffer(f["df"], np.int32)
            df = df[which]
            weight, n = counts.astype(np.float32) * idf(df, n_docs), len(texts.values)
            total = np.bincount(rows, weight, n)
            alone = np.bincount(rows, weight * (df == 1), n) / np.maximum(total, 1e-9)
            can = (total > 0) & (alone <= 1 - threshold + _SLACK)
            if not can.any():
                continue
            of = can[rows]
            rows, hashes, weight = rows[of], hashes[of], weight[of]
            which, keys = signatures(rows, hashes, weight)
            edge = np.searchsorted(rows, np.r_[which, n])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            blob = lambda data, width: pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer((edge * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([nodes.values.take(pa.array(which)), lists, pa.array(alone[which]), pa.array(total[which]), blob(hashes, 8), blob(weight, 4)], ["node", "bands", "alone", "total", "hashes", "weights"])


def weighted_sets(texts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The weighted shingle set of each text (node, text; nodes differ) that can reach ``threshold`` with another.

    Document frequencies of all shingles are counted by ranges of hashes: a chunk
    of texts sends each range its shingles once, and gets back the counts above one.
    A range covers about ``COUNTED`` bytes of text, so that groups don't grow with the corpus.
    """
    packed = staging.stage(texts.mapInArrow(_pack, "chunk string, nodes array<string>, texts array<string>, size bigint"), "texts")
    n_docs, size = packed.agg(F.sum(F.size("nodes")), F.sum("size")).first()
    parts = min(1 << 24, 1 + (size or 0) // COUNTED)
    spread = packed.select("chunk", "texts").mapInArrow(lambda it: _spread(it, parts), "part int, chunk string, low binary, n binary")
    # As many tasks as ranges: what a task reads stays the same however large the corpus.
    counted = spread.repartition(parts, "part").groupBy("part").applyInArrow(_frequencies, "chunk string, part int, at binary, df binary")
    found = counted.repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", "at", "df")).alias("found"))
    both = packed.select("chunk", "nodes", "texts").repartition(parts, "chunk").join(found, "chunk", "left").select("nodes", "texts", "found")
    sets = staging.stage(both.mapInArrow(lambda it: _sample(it, parts, n_docs or 0, threshold), _SETS), "sets")
    staging.drop(packed)
    return sets


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, ea: np.ndarray, hb: np.ndarray, wb: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """Similarity of each pair of weighted sets, given as hashes, weights and the edges of the pairs; 0 if both are empty."""
    n = len(ea) - 1
    ra, rb = np.repeat(np.arange(n), np.diff(ea)), np.repeat(np.arange(n), np.diff(eb))
    rows, weight = np.r_[ra, rb], np.r_[wa, wb].astype(float)
    keys = np.r_[ha, hb] ^ mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    i, j = order[same], order[same + 1]
    both = np.bincount(rows[i], np.minimum(weight[i], weight[j]), n)
    return both / np.maximum(np.bincount(rows, weight, n) - both, 1e-12)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (ha, ea), (hb, eb) = (text_buffers(batch.column(c)) for c in ("ha", "hb"))
        wa, wb = (text_buffers(batch.column(c))[0].view(np.float32) for c in ("wa", "wb"))
        ha, hb, ea, eb = ha.view(np.uint64), hb.view(np.uint64), ea // 8, eb // 8
        out = np.zeros(len(batch))
        for lo, hi in chunks(8 * (ea + eb), 8 << 20):
            a, b = slice(ea[lo], ea[hi]), slice(eb[lo], eb[hi])
            out[lo:hi] = weighted_jaccard(ha[a], wa[a], ea[lo : hi + 1] - ea[lo], hb[b], wb[b], eb[lo : hi + 1] - eb[lo])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("rank"), pa.array(out)], ["a", "b", "rank", "similarity"])


def _linked(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b, rank) with a similarity of ``threshold`` or more."""
    for side in ("a", "b"):
        of = sets.select(F.col("node").alias(side), F.col("total").alias(f"t{side}"), F.col("hashes").alias(f"h{side}"), F.col("weights").alias(f"w{side}"))
        heavy = staging.heavy_rows(pairs, [side]) if side == "b" else []
        pairs = staging.join_skewed(pairs, of, [side], heavy)
    can = pairs.where(F.least("ta", "tb") >= (threshold - _SLACK) * F.greatest("ta", "tb"))
    checked = can.select("a", "b", "rank", "ha", "wa", "hb", "wb").mapInArrow(_compare, "a string, b string, rank double, similarity double")
    return staging.stage(checked.where(F.col("similarity") >= threshold), "linked")


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, edge = text_buffers(batch.column("hashes"))
        weight = text_buffers(batch.column("weights"))[0].view(np.float32)
        row = pa.array(np.repeat(np.arange(len(batch)), np.diff(edge) // 8))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("node", "root", "total")), pa.array(hashes.view(np.int64)), pa.array(weight.astype(float))], ["node", "root", "total", "shingle", "weight"])


def _apart(sets: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``members`` (node, root) of different roots that can reach ``threshold``: a, b, bound; none that does is missing.

    A weighted prefix filter: shingles stand rarest first, and a prefix ends where
    the weight left cannot reach the threshold.  Similar texts share a shingle of
    both prefixes, and from the first such on enough weight is left in each.
    """
    some = sets.join(members, "node").select("node", "root", "total", "hashes", "weights")
    each = staging.stage(some.mapInArrow(_weights, "node string, root string, total double, shingle bigint, weight double"), "weights")
    counted = each.join(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "shingle")
    order = Window.partitionBy("node").orderBy(F.desc("df"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slack = 1 - _SLACK
    prefix = counted.withColumn("rest", F.sum("weight").over(order)).where((F.col("df") > 1) & (F.col("rest") >= threshold * slack * F.col("total")))
    prefix = staging.stage(prefix.select("shingle", "root", "node", "rest", "total"), "prefixes")
    staging.drop(each)
    # Roots meet before their members, so that members of one root never do.
    share = threshold / (1 + threshold) * slack
    can = lambda a, b: F.least(f"rest{a}", f"rest{b}") >= share * (F.col(f"total{a}") + F.col(f"total{b}"))
    side = lambda df, s: df.select("shingle", *[F.col(c).alias(c + s) for c in df.columns if c != "shingle"])
    groups = staging.stage(prefix.groupBy("shingle", "root").agg(F.max("rest").alias("rest"), F.min("total").alias("total"), F.count(F.lit(1)).alias("n")), "prefix-roots")
    heavy = staging.heavy_rows(groups, ["shingle"])
    meet = staging.join_skewed(side(groups, "_a"), side(groups, "_b"), ["shingle"], heavy).where((F.col("root_a") < F.col("root_b")) & can("_a", "_b"))
    meet = staging.stage(meet.select("shingle", "root_a", "root_b"), "prefix-meetings")
    heavy = staging.heavy_keys(groups, ["shingle", "root"], "n")
    first = staging.join_skewed(side(prefix, "_a"), meet, ["shingle", "root_a"], heavy)
    pairs = staging.join_skewed(side(prefix, "_b"), first, ["shingle", "root_b"], heavy).where(can("_a", "_b"))
    bound = F.least("rest_a", "rest_b") / (F.col("total_a") + F.col("total_b"))
    return pairs.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(F.max(bound).alias("bound"))


def _rooted(rows: DataFrame, roots: DataFrame, column: str, root: str) -> DataFrame:
    """``rows`` with the class (``root``) of the text in ``column``; a text without links is its own."""
    found = roots.select(F.col("node").alias(column), F.col("root").alias(root))
    return rows.join(found, column, "left").withColumn(root, F.coalesce(root, column))


def links(texts: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links between ``texts`` (node, text; nodes differ): a, b, similarity; and their components: node, root.

    Each text meets the most central text of each of its buckets, the one with the
    least weight that no other text has.  Members of buckets that then hold several
    classes are compared across them wherever they can be similar (see
    :func:`_apart`), so that each pair of a bucket is compared, is of one class, or
    is known to be less similar.
    """
    sets = weighted_sets(texts, threshold)
    every = sets.select("node", "alone", F.explode("bands").alias("bucket"))
    crowded = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("alone", "node")).alias("pivot")).where("n > 1")
    crowded = staging.stage(crowded, "pivots")
    heavy = staging.heavy_keys(crowded, ["bucket"], "n")
    buckets = staging.stage(staging.join_skewed(every, crowded.select("bucket", "pivot"), ["bucket"], heavy).select("bucket", "node", "pivot"), "buckets")

    pairs = staging.stage(buckets.where("node <> pivot.node").select(F.col("node").alias("a"), F.col("pivot.node").alias("b"), F.col("pivot.alone").alias("rank")).distinct(), "pairs")
    linked = _linked(sets, pairs, threshold)

    # Here the most central of the texts that a text is linked to names its class; components follow when all links are known.
    joined = linked.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("rank", "b")).alias("first")).select("node", F.col("first.b").alias("root"))
    named = staging.stage(_rooted(buckets.select("bucket", "node"), joined, "node", "root"), "named")
    mixed = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    members = staging.stage(staging.join_skewed(named, mixed, ["bucket"], heavy).select("node", "root").distinct(), "mixed")
    n_members = members.count()
    if not n_members:
        return linked, components(linked)
    compared = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = staging.stage(_apart(sets, members, threshold).join(compared, ["a", "b"], "left_anti"), "apart")
    # Where the pairs are many, the likeliest come first: a link joins two classes and spares the rest of their pairs.
    n_apart, most = apart.count(), OFFERED
    while n_apart > OFFERED * n_members:
        roots = components(linked)
        rooted = _rooted(_rooted(apart, roots, "a", "ra"), roots, "b", "rb").where("ra <> rb")
        nth = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("bound"), "a", "b"))
        ranked = rooted.withColumns({"na": nth("a", "rb"), "nb": nth("b", "ra")})
        pairs = staging.stage(ranked.where(F.least("na", "nb") <= most).select("a", "b", F.lit(1.0).alias("rank")), "pairs")
        if not pairs.take(1):
            return linked, roots
        linked = staging.stage(linked.unionByName(_linked(sets, pairs, threshold)), "linked")
        apart, most = staging.stage(rooted.select("a", "b", "bound").join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "apart"), 16 * most
        n_apart = apart.count()
    if n_apart:
        linked = staging.stage(linked.unionByName(_linked(sets, apart.select("a", "b", F.lit(1.0).alias("rank")), threshold)), "linked")
    return linked, components(linked)


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, class_id, class_size, n_links, kept.

    Texts with equal bytes are copies; different texts are linked at a weighted
    Jaccard similarity of ``threshold`` or more over their five-word shingles (a
    text of one to four words is one shingle).  ``class_id`` is the smallest
    doc_id of the component, ``kept`` marks that document alone (rows that repeat
    both id and text are one document), ``n_links`` counts the verified links of
    the text.  A null text is in no class but its own, as are equal texts without
    a word beside their own copies; a null doc_id counts as largest.  An empty
    table gives an empty result; extra columns are ignored.
    """
    own = staging.only(docs, "doc_id", "text")
    name = F.coalesce(F.md5("text"), F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ids = own.select("doc_id", name.alias("node"))
    texts = own.where("text is not null").select(F.md5("text").alias("node"), "text").dropDuplicates(["node"])
    linked, roots = links(texts, threshold)
    degree = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    counted = ids.groupBy("node").agg(F.count(F.lit(1)).alias("n"), first)
    counted = staging.stage(_rooted(counted, roots, "node", "root").join(degree, "node", "left"), "nodes")
    classes = counted.groupBy("root").agg(F.sum("n").alias("class_size"), F.min("first").alias("first")).where("class_size > 1")
    shared = staging.stage(counted.join(classes.withColumnRenamed("first", "least"), "root").select("node", "n", "class_size", "n_links", F.col("least.doc_id").alias("class_id"), F.col("least.node").alias("least")), "shared")
    told = staging.join_skewed(ids, shared, ["node"], staging.heavy_keys(shared, ["node"], "n"), "left")
    alone = F.col("class_size").isNull()
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("class_id"))
    kept = alone | F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("least"))
    links_ = F.coalesce("n_links", F.lit(0)).cast("long")
    return told.select("doc_id", "node", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), links_.alias("n_links"), kept.alias("kept"))
