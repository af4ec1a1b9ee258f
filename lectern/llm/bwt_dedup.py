"""Removal of repeated passages by merging shard Burrows-Wheeler transforms.

A byte goes if some ``LENGTH``-byte string that covers it also starts anywhere
else.  Three steps find exactly those bytes:

1. Blocking.  Every string of ``LENGTH`` bytes picks its anchor, the ``GRAM``-byte
   run in it with the least hash (leftmost of equals).  Equal strings pick equal
   anchors, so repeats lie within the runs of strings that share an anchor.
   Runs with an anchor of their own, nearly all of a clean corpus, stop here;
   runs that are equal as a whole need no closer look either.
2. Merging.  The remaining runs, each of less than ``2 * LENGTH`` bytes, are dealt
   to buckets by anchor.  Slices of runs whose common core stands in one run only
   hold no repeat and are put aside.  The others' shards are suffix-sorted one by
   one into Burrows-Wheeler transforms of ``q``-byte symbols; these are merged by
   interleave refinement: the interleave for ``h`` bytes and its block boundaries
   give, by one stable pass over the merged transform, those for ``h + q``.  After
   ``LENGTH`` bytes a block is a repeated interval: the suffixes that share a
   prefix of ``LENGTH``.  Suffixes are not sorted again across shards.
3. An anchor with more than ``HOT`` different runs is not put in one task: the
   hashes of its strings are counted by a distributed aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import staging
from .decontaminate import doc_key
from .textkit import mix, prefix_hash, span_hash, text_buffers

LENGTH = 200
GRAM = 32
#: Different runs of one anchor that are merged in one task at most.
HOT = 2000
#: Runs that a bucket holds on average, and bytes of a shard within it.
BUCKET, SHARD = 2000, 1 << 16
#: String starts of a run that are judged together by the core their strings share.
SLOT = 20
_END = 255  # ends each string of a collection; no byte of UTF-8 text
_PIECE = 1 << 20


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first and last string start (within the text), anchor offset in the run, anchor and content hash of each run."""
    out = []
    for lo in range(0, len(data), _PIECE):
        piece = data[lo : lo + _PIECE + length - 1]
        if len(piece) < length:
            break
        starts = len(piece) - length + 1
        running = prefix_hash(piece)
        grams = np.arange(len(piece) - gram + 1)
        hashes = span_hash(running, grams, grams + gram)
        least = (hashes & ~np.uint64((1 << 24) - 1)) | grams.astype(np.uint64)
        width, reach = 1, length - gram + 1
        while width * 2 <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if reach > width:
            least = np.minimum(least[: starts], least[reach - width : reach - width + starts])
        anchor = (least[:starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(lo, lo + starts), "right") - 1
        valid = lo + np.arange(starts) + length <= offsets[row + 1]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]] & valid
        first = np.flatnonzero(new)
        if not len(first):
            continue
        last = np.r_[first[1:], starts] - 1
        # A run ends with the last whole string of its text.
        last = np.minimum(last, offsets[row[first] + 1] - length - lo)
        content = mix(span_hash(running, first, last + length) + (anchor[first] - first).astype(np.uint64))
        begin = lo - offsets[row[first]]
        out.append((row[first], first + begin, last + begin, anchor[first] - first, hashes[anchor[first]], content))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def transform_shard(codes: np.ndarray, back: np.ndarray, ahead, depth: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of one shard sorted by ``depth`` bytes at least, and its Burrows-Wheeler transform."""
    rank, done = codes.astype(np.int64), q
    while done < depth:
        _, rank = np.unique(rank * (len(rank) + 65536) + rank[ahead(done)], return_inverse=True)
        done *= 2
    order = np.argsort(rank, kind="stable")
    return order, codes[back[order]]


def merge_transforms(transforms: list[np.ndarray], length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first ``length`` bytes, and block numbers.

    Refinement: suffixes that stand in the order of ``h`` bytes pass, stably by
    the symbol before them, into the order of ``h + q`` bytes of those ``q``
    further left; two neighbours share ``h + q`` bytes if they have the same
    symbol and came from one block.
    """
    source = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    block = np.zeros(len(source), np.int32)
    merged = np.empty(len(source), np.uint16)
    for _ in range(length // q):
        for n, t in enumerate(transforms):
            merged[source == n] = t
        order = np.argsort(merged, kind="stable")
        symbol, before = merged[order], block[order]
        block = np.zeros(len(source), np.int32)
        np.cumsum((symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1]), out=block[1:])
        source = source[order]
    return source, block


def repeated_starts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """For every byte of a collection of strings: whether its ``length`` bytes also start elsewhere in it.

    Bytes whose ``length`` bytes would cross the end of their string get False.
    """
    n_strings, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros(len(data), bool)
    if not len(data):
        return out
    # One rotation per string, closed by an end byte.
    starts = offsets[:-1] + np.arange(n_strings)
    owner = np.repeat(np.arange(n_strings), sizes + 1)
    place = np.arange(len(owner)) - starts[owner]
    text = np.full(len(owner), _END, np.uint8)
    inner = place < sizes[owner]
    text[inner] = data

    def turned(by: int, at: np.ndarray = np.arange(len(owner))) -> np.ndarray:
        return starts[owner[at]] + (place[at] + by) % (sizes[owner[at]] + 1)

    for q in (8, 4, 2, 1):
        if length % q:
            continue
        wide = np.zeros(len(text), np.uint64)
        for i in range(q):
            wide |= text[turned(i)].astype(np.uint64) << np.uint64(8 * i)
        codes = np.unique(wide, return_inverse=True)[1]
        if codes.max() < 65536:
            break
    codes = codes.astype(np.uint16)
    back = turned(-q)
    bounds = [0]
    while bounds[-1] < len(text):  # whole strings to each shard
        cut = min(np.searchsorted(starts, bounds[-1] + shard, "left"), n_strings)
        bounds.append(int(starts[cut]) if cut < n_strings else len(text))
    suffixes, transforms = [], []
    for lo, hi in zip(bounds, bounds[1:]):
        at = np.arange(lo, hi)
        order, transform = transform_shard(codes[lo:hi], back[lo:hi] - lo, lambda by, at=at, lo=lo: turned(by, at) - lo, length, q)
        suffixes.append(order + lo)
        transforms.append(transform)
    source, block = merge_transforms(transforms, length, q)
    position = np.empty(len(text), np.int64)
    for n, s in enumerate(suffixes):
        position[source == n] = s
    valid = place + length <= sizes[owner]
    many = np.bincount(block)[block] > 1
    hit = position[many & valid[position]]
    out[hit - owner[hit]] = True
    return out


def repeated_in_bucket(data: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, at: np.ndarray, times: np.ndarray, length: int = LENGTH, slot: int = SLOT, shard: int = SHARD) -> np.ndarray:
    """For every byte of a bucket's runs: whether the string that starts there is repeated."""
    sizes = np.diff(offsets)
    run = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    start = np.arange(len(run)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
    turn = (at[run] - start) // slot
    heads = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (turn[1:] != turn[:-1])])
    run_, turn_, lo = run[heads], turn[heads], start[heads]
    hi = start[np.r_[heads[1:], len(start)] - 1]
    running = prefix_hash(data)
    base = offsets[run_]
    core_lo = base + at[run_] - turn_ * slot
    core_hi = base + at[run_] - turn_ * slot - slot + 1 + length
    seed = mix(anchors[run_] + turn_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    core = mix(span_hash(running, core_lo, core_hi) ^ seed)
    whole = mix(span_hash(running, base + lo, base + hi + length) ^ seed ^ (at[run_] - lo).astype(np.uint64))
    _, core, n_core = np.unique(core, return_inverse=True, return_counts=True)
    _, first, whole, n_whole = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    settled = (n_whole[whole] > 1) | (times[run_] > 1)
    # Of a core that several different slices share, each different slice is compared once.
    n_different = np.bincount(core[first], minlength=len(n_core))
    chosen = first[n_different[core[first]] > 1]
    out = np.zeros(len(data), bool)
    if len(chosen):
        begin, end = (base + lo)[chosen], (base + hi + length)[chosen]
        span = end - begin
        edge = np.r_[0, np.cumsum(span)]
        found = repeated_starts(data[np.repeat(begin - edge[:-1], span) + np.arange(edge[-1])], edge, length, shard)
        where = np.full(len(first), -1)
        where[whole[chosen]] = edge[:-1]
        mine = where[whole]  # each slice reads what its equal has found
        counts = hi - lo + 1
        take = np.repeat(mine >= 0, counts)
        inside = np.arange(len(run)) - np.repeat(heads, counts)
        out[(np.repeat(base + lo, counts) + inside)[take]] = found[(np.repeat(mine, counts) + inside)[take]]
    all_of = np.repeat(settled, hi - lo + 1)
    out[(offsets[run] + start)[all_of]] = True
    return out


_RUN = "key struct<doc_id:{id},text_hash:bigint>, first int, last int, at int, anchor bigint, content bigint"


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        step = max(1, 1 + int(np.searchsorted(offsets, 4 * _PIECE)))
        for lo in range(0, len(batch), step):
            hi = min(lo + step, len(batch))
            row, first, last, at, anchor, content = anchored_runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, gram)
            keys = batch.column("key").take(pa.array(row + lo))
            ints = [pa.array(x.astype(np.int32)) for x in (first, last, at)]
            yield pa.RecordBatch.from_arrays([keys, *ints, pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], ["key", "first", "last", "at", "anchor", "content"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs listed with each text."""
    names = ["anchor", "content", "times", "different", "at", "bytes"]
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        found = batch.column("found")
        parts = found.flatten()
        row = found.value_parent_indices().to_numpy(zero_copy_only=False)
        get = lambda name: parts.field(name)
        first, last = (np.asarray(get(x), np.int64) for x in ("first", "last"))
        begin, span = offsets[row] + first, last - first + length
        edge = np.r_[0, np.cumsum(span)]
        out = data[np.repeat(begin - edge[:-1], span) + np.arange(edge[-1])]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(span), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*(get(x) for x in names[:-1]), pieces], names)


def _intervals(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, first and last start of each stretch of flagged starts; stretches end with their run."""
    row = np.searchsorted(offsets, np.arange(len(flags)), "right") - 1
    step = flags[1:] & flags[:-1] & (row[1:] == row[:-1])
    first, last = np.flatnonzero(flags & np.r_[True, ~step]), np.flatnonzero(flags & np.r_[~step, True])
    return row[first], first - offsets[row[first]], last - offsets[row[first]]


def _merge_bucket(table: pa.Table, length: int) -> pa.Table:
    table = table.combine_chunks()
    data, offsets = text_buffers(table.column("bytes").combine_chunks())
    anchor, at, times = (table.column(x).to_numpy() for x in ("anchor", "at", "times"))
    row, lo, hi = _intervals(repeated_in_bucket(data, offsets, anchor.view(np.uint64), at.astype(np.int64), times, length), offsets)
    return pa.table({"anchor": table.column("anchor").take(pa.array(row)), "content": table.column("content").take(pa.array(row)), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))})


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row per string of the runs of hot anchors: run, start, 128 bits of hash."""
    for batch in batches:
        for lo in range(0, len(batch), 2000):
            part = batch.slice(lo, 2000)
            data, offsets = text_buffers(part.column("bytes"))
            sizes = np.diff(offsets) - length + 1
            run = np.repeat(np.arange(len(sizes)), sizes)
            start = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            running = prefix_hash(data)
            begin = offsets[run] + start
            one, two = span_hash(running, begin, begin + length), span_hash(prefix_hash(data ^ np.uint8(85)), begin, begin + length)
            take = lambda name: part.column(name).take(pa.array(run))  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([take("anchor"), take("content"), take("times"), pa.array(start.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["anchor", "content", "times", "lo", "one", "two"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document with repeats: key (see ``doc_key``) and spans, an ordered array of (lo, hi) bytes to remove."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]
    texts = staging.only(docs, "doc_id", "text").select(doc_key().alias("key"), "text")
    runs = staging.stage(texts.mapInArrow(lambda it: _runs(it, length, gram), _RUN.format(id=id_type)), "runs")
    shared = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("a"), F.max("content").alias("b")).where("n > 1")
    shared = staging.stage(shared, "shared-anchors")
    same = shared.select("anchor", (F.col("a") == F.col("b")).alias("same"))
    again = staging.stage(staging.join_skewed(runs, same, ["anchor"], staging.heavy_keys(shared, ["anchor"], "n")), "shared-runs")
    staging.drop(runs)

    kinds = again.where("not same").groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "first", "last", "at")).alias("r"))
    kinds = staging.stage(kinds, "kinds")
    different = staging.stage(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")), "different")
    counted = staging.join_skewed(kinds, different, ["anchor"], staging.heavy_keys(different, ["anchor"], "different"))
    listed = F.collect_list(F.struct("anchor", "content", "times", "different", F.col("r.first").alias("first"), F.col("r.last").alias("last"), F.col("r.at").alias("at")))
    per_doc = staging.stage(counted.groupBy(F.col("r.key").alias("key")).agg(listed.alias("found")), "per-doc")
    # Most texts share something with another: a join by shuffle at any size.
    one_each = texts.join(per_doc, "key").select("text", "found")
    pieces = staging.stage(one_each.mapInArrow(lambda it: _cut(it, length), "anchor bigint, content bigint, times bigint, different bigint, at int, bytes binary"), "pieces").dropDuplicates(["anchor", "content"])

    buckets = max(1, kinds.count() // BUCKET)
    cool = pieces.where(F.col("different") <= hot).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    merged = cool.groupBy("bucket").applyInArrow(lambda t: _merge_bucket(t, length), "anchor bigint, content bigint, lo int, hi int")
    strings = pieces.where(F.col("different") > hot).mapInArrow(lambda it: _strings(it, length), "anchor bigint, content bigint, times bigint, lo int, one bigint, two bigint")
    often = strings.groupBy("anchor", "one", "two").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1")
    often = staging.stage(often, "often")
    string = ["anchor", "one", "two"]
    hits = staging.join_skewed(strings, often.select(*string), string, staging.heavy_keys(often, string, "rows"))
    # Neighbouring starts of a run become one interval.
    step = F.col("lo") - F.row_number().over(Window.partitionBy("anchor", "content").orderBy("lo"))
    counted_out = hits.select("anchor", "content", "lo", step.alias("step")).groupBy("anchor", "content", "step").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi")).drop("step")
    found = staging.stage(merged.unionByName(counted_out), "intervals")

    whole = again.where("same").select("key", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
    run = ["anchor", "content"]
    partly = staging.join_skewed(again.where("not same"), found, run, staging.heavy_keys(kinds, run, "times")).select("key", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + length).alias("hi"))
    # Repeated rows have one key; their equal runs are one before a window sees them.
    cover = whole.unionByName(partly).groupBy("key", "lo").agg(F.max("hi").alias("hi"))
    order = Window.partitionBy("key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("hi").over(order)
    islands = cover.withColumn("new", (before.isNull() | (F.col("lo") > before)).cast("int")).withColumn("island", F.sum("new").over(Window.partitionBy("key").orderBy("lo", "hi")))
    joined = islands.groupBy("key", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return joined.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch], names: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
        for text, spans in zip(texts, batch.column("spans"), strict=True):
            raw, spans = text.as_py() or b"", spans.as_py() or []
            rest, at = [], 0
            for s in spans:
                rest.append(raw[at : s["lo"]])
                at = s["hi"]
            left = b"".join([*rest, raw[at:]]) if spans else raw
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(left))
            n_spans.append(len(spans))
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(None if text.as_py() is None else left.decode("utf-8", "ignore"))
        more = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
        columns = [*(batch.column(n) for n in names), *more, *([pa.array(kept, pa.string())] if with_text else [])]
        yield pa.RecordBatch.from_arrays(columns, [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT, columns: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: the named columns, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    Texts are UTF-8 bytes, null counts as empty; matches never cross texts.  All
    bytes covered by a string of ``length`` bytes that starts at two places or more,
    in one text or several, are removed, judged on the input.  Repeated rows are
    copies of each other and lose all such bytes.  ``kept_text`` drops the
    broken rest of a character that was cut (null stays null).  A text shorter
    than ``length`` loses nothing; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, length, hot=hot)
    types = dict(docs.dtypes)
    names = [c for c in columns]
    both = docs.select(doc_key().alias("key"), "text", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]).join(spans, "key", "left").drop("key")
    kind = ", ".join([f"_{i} {types[c]}" for i, c in enumerate(names)] + ["n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"] + ["kept_text string"] * with_text)
    out = both.mapInArrow(lambda it: _kept(it, [f"_{i}" for i in range(len(names))], with_text), kind)
    return out.withColumnsRenamed({f"_{i}": c for i, c in enumerate(names)})
