"""Language-model scores from a lattice of subword segmentations.

The pieces of an existing vocabulary, never retrained, span each token in many
ways.  A token's probability is the sum over all its segmentations of the
products of their pieces' probabilities, by a forward recursion in log space; a
text's is the product over its tokens and an end.  The scores of a unigram
vocabulary are log probabilities and weigh the pieces as they are.  Those of a
merge vocabulary are ranks: there a Zipf law over the ranks is the prior.  Either
is adapted by rounds of expected counts over the training tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import staging
from .langid import training_part
from .textkit import LOWER, TOKEN, chunks, prefix_hash, span_hash, spans, text_buffers

SPACE = "▁".encode()
#: Weight of the prior in tokens, and rounds of adaptation.
PRIOR, ROUNDS = 5000.0, 2
#: Most frequent tokens whose scores every worker holds; the others are joined.
HELD = 1 << 18
#: Bytes of tokens in one lattice; a longer token is walked in windows of as many.
BYTES = 1 << 16
#: Arcs of a step below which plain numbers beat arrays.
FEW = 48


def load_pieces(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model as bytes (last the 256 byte pieces) and their prior probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    plain = [i for i in plain if "▁" not in model.id_to_piece(i)[1:]]
    order = sorted(plain, key=lambda i: (-model.get_score(i), i))
    pieces = [model.id_to_piece(i).encode() for i in order] + [bytes([b]) for b in range(256)]
    scores = np.array([model.get_score(i) for i in order])
    if (scores == scores.round()).all():  # ranks of merges
        weight = np.r_[1 / (np.arange(len(order)) + 2.7), np.full(256, 1 / (len(order) + 2.7))]
    else:
        weight = np.exp(np.r_[scores, np.full(256, scores.min(initial=0.0) - math.log(256))])
    return pieces, weight / weight.sum()


class Lattice:
    """Arcs of pieces over a collection of byte strings; the last 256 pieces are single bytes."""

    def __init__(self, pieces: list[bytes]) -> None:
        sizes = np.array([len(p) for p in pieces[:-256]])
        edge = np.r_[0, np.cumsum(sizes)]
        data = np.frombuffer(b"".join(pieces[:-256]), np.uint8)
        hashes = span_hash(prefix_hash(data), edge[:-1], edge[1:])
        self.n, self.longest = len(pieces), int(sizes.max(initial=1))
        self.by_size = {}
        for m in np.unique(sizes):
            at = np.flatnonzero(sizes == m)
            at = at[np.argsort(hashes[at])]
            self.by_size[int(m)] = hashes[at], at.astype(np.int32)

    def arcs(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin node, end node, piece and end's depth of every arc, by depth and end; a string of n bytes has n + 1 nodes."""
        size = np.diff(edge)
        owner = np.repeat(np.arange(len(size)), size)
        here = np.arange(len(data))
        left = edge[1:][owner] - here
        running = prefix_hash(data)
        begin, length, piece = [here], [np.ones(len(data), np.int64)], [self.n - 256 + data.astype(np.int32)]
        for m, (hashes, ids) in self.by_size.items():
            at = here[left >= m]
            if not len(at):
                continue
            h = span_hash(running, at, at + m)
            i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[i] == h
            begin.append(at[hit])
            length.append(np.full(hit.sum(), m))
            piece.append(ids[i[hit]])
        begin, length, piece = np.concatenate(begin), np.concatenate(length), np.concatenate(piece)
        node = begin + owner[begin]
        depth = begin - edge[owner[begin]] + length
        order = np.lexsort((node + length, depth))
        return node[order], (node + length)[order], piece[order], depth[order]

    def forward(self, arcs, edge: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways to each node."""
        begin, end, piece, depth = arcs
        out = np.full(edge[-1] + len(edge) - 1, -np.inf)
        out[edge[:-1] + np.arange(len(edge) - 1)] = 0
        _spread(out, begin, end, logp[piece], depth)
        return out

    def walk(self, data: np.ndarray, logp: np.ndarray, window: int = BYTES) -> float:
        """Log probability of one string however long: windows follow each other, and only the nodes that the next can reach are kept."""
        ahead = [0.0] + [-math.inf] * self.longest  # of the nodes from ``lo`` on
        for lo in range(0, len(data), window):
            size = min(window, len(data) - lo)
            part = data[lo : lo + size + self.longest]
            begin, end, piece, _ = self.arcs(part, np.array([0, len(part)]))
            mine = np.flatnonzero(begin < size)
            mine = mine[np.argsort(begin[mine], kind="stable")]
            value = ahead + [-math.inf] * size
            for i, j, w in zip(begin[mine].tolist(), end[mine].tolist(), logp[piece[mine]].tolist(), strict=True):
                a, b = value[i] + w, value[j]
                value[j] = a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))
            ahead = value[size : size + self.longest + 1]
        return ahead[0]

    def expected(self, data: np.ndarray, edge: np.ndarray, logp: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, by forward and backward recursion."""
        arcs = self.arcs(data, edge)
        begin, end, piece, depth = arcs
        ahead = self.forward(arcs, edge, logp)
        size = np.diff(edge)
        last = edge[1:] + np.arange(len(size))
        owner = np.repeat(np.arange(len(size)), size + 1)
        behind = np.full(len(ahead), -np.inf)
        behind[last] = 0
        left = size[owner[begin]] - (begin - (edge[:-1] + np.arange(len(size)))[owner[begin]])
        order = np.lexsort((begin, left))
        _spread(behind, end[order], begin[order], logp[piece[order]], left[order])
        use = np.exp(ahead[begin] + logp[piece] + behind[end] - ahead[last][owner[begin]]) * times[owner[begin]]
        return np.bincount(piece, use, self.n)


def _spread(value: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
    """value[target] = log sum exp(value[source] + weight), step by step; arcs are sorted by step and target."""
    cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True]) if len(step) else np.zeros(1, int)
    many = np.flatnonzero(np.diff(cuts) > FEW)
    wide = int(many[-1]) + 1 if len(many) else 0
    for lo, hi in zip(cuts[:wide], cuts[1 : wide + 1]):
        w, t = value[source[lo:hi]] + weight[lo:hi], target[lo:hi]
        heads = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        top = np.maximum.reduceat(w, heads)
        total = np.add.reduceat(np.exp(w - np.repeat(top, np.diff(np.r_[heads, len(t)]))), heads)
        value[t[heads]] = top + np.log(total)
    # What is left are few strings, long ones: a step has few arcs.
    rest = int(cuts[wide])
    if rest == len(step):
        return
    known, at, terms = value.tolist(), int(target[rest]), []
    for a, t, w in zip(source[rest:].tolist(), target[rest:].tolist(), weight[rest:].tolist(), strict=True):
        if t != at:
            known[at], at, terms = _log_sum(terms), t, []
        terms.append(known[a] + w)
    known[at] = _log_sum(terms)
    value[:] = known


def _log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    return top if top == -math.inf else top + math.log(sum([math.exp(x - top) for x in terms]))


def _tokens(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    starts, ends, rows = spans(low, offsets, TOKEN)
    return low, starts, ends, rows, span_hash(prefix_hash(low), starts, ends)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of each chunk with their counts in training texts and in all."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in chunks(offsets, 4 << 20):
            low, starts, ends, rows, hashes = _tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if not len(starts):
                continue
            distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            begin, size = starts[first], (ends - starts)[first]
            edge = np.r_[0, np.cumsum(size)]
            text = low[np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])]
            tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(text)]).cast(pa.binary())
            in_train = np.bincount(which, train[lo:hi][rows], len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), tokens, pa.array(in_train), pa.array(np.bincount(which, minlength=len(distinct)))], ["h", "token", "c", "all_"])


def _marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with the word-begin mark before each."""
    edge = np.r_[0, np.cumsum(np.diff(offsets) + len(SPACE))]
    out = np.empty(edge[-1], np.uint8)
    mark = np.zeros(edge[-1], bool)
    for i, b in enumerate(SPACE):
        out[edge[:-1] + i] = b
        mark[edge[:-1] + i] = True
    out[~mark] = data
    return out, edge


def _lattices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and edges of about ``BYTES`` bytes of tokens at a time."""
    data, offsets = text_buffers(batch.column("token"))
    for lo, hi in chunks(offsets, BYTES):
        yield lo, hi, *_marked(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _expected(batches: Iterator[pa.RecordBatch], pieces: list[bytes], logp: np.ndarray) -> Iterator[pa.RecordBatch]:
    lattice, total = Lattice(pieces), np.zeros(len(pieces))
    for batch in batches:
        times = batch.column("c").to_numpy().astype(float)
        for lo, hi, data, edge in _lattices(batch):
            if hi - lo == 1 and len(data) > 2 * BYTES:  # its windows count as strings of their own
                for at in range(0, len(data), BYTES):
                    part = data[at : at + BYTES]
                    total += lattice.expected(part, np.array([0, len(part)]), logp, times[lo:hi])
            else:
                total += lattice.expected(data, edge, logp, times[lo:hi])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array(total)], ["piece", "uses"])


def _marginals(batches: Iterator[pa.RecordBatch], pieces: list[bytes], logp: np.ndarray) -> Iterator[pa.RecordBatch]:
    lattice = Lattice(pieces)
    for batch in batches:
        out = np.zeros(len(batch))
        for lo, hi, data, edge in _lattices(batch):
            if hi - lo == 1 and len(data) > 2 * BYTES:
                out[lo] = lattice.walk(data, logp)
            else:
                out[lo:hi] = lattice.forward(lattice.arcs(data, edge), edge, logp)[edge[1:] + np.arange(hi - lo)]
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), batch.column("all_"), pa.array(out / np.log(10))], ["h", "c", "all_", "model"])


def adapt(tokens: DataFrame, pieces: list[bytes], prior: np.ndarray, ends: int, rounds: int = ROUNDS, weight: float = PRIOR) -> tuple[np.ndarray, float]:
    """Piece probabilities after ``rounds`` of expected counts, and that of the end; they add up to 1."""
    p, end = prior * (1 - 1e-3), 1e-3
    for _ in range(rounds):
        logp = np.log(p)
        rows = tokens.where("c > 0").mapInArrow(lambda it, logp=logp: _expected(it, pieces, logp), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(len(p))
        for r in rows:
            uses[r["piece"]] = r["uses"]
        total = uses.sum() + ends + weight
        p, end = (uses + weight * (1 - 1e-3) * prior) / total, (ends + weight * 1e-3) / total
    return p, end


def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """A row with the sums over held tokens for each text, and a row for each other distinct token of it."""
    known, values = held.value
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for lo, hi in chunks(offsets, 2 << 20):
            _, _, _, rows, hashes = _tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            have = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            sums = [np.bincount(rows[have], values[k][at[have]], hi - lo) for k in range(3)]
            n = np.bincount(rows, minlength=hi - lo)
            other, of = hashes[~have], rows[~have]
            order = np.lexsort((other, of))
            other, of = other[order], of[order]
            first = np.flatnonzero(np.r_[True, (other[1:] != other[:-1]) | (of[1:] != of[:-1])]) if len(other) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(other)])
            uid = batch.column("uid").slice(lo, hi - lo)
            doc = pa.StructArray.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(n), *(pa.array(s) for s in sums)], ["doc_id", "held_out", "n", "known", "base", "model"])
            count = pa.array(np.r_[np.zeros(hi - lo, np.int32), times.astype(np.int32)])
            # A text's own row has a key that is spread over all tasks and, with a count of 0, adds nothing when joined.
            spread = (uid.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([uid, uid.take(pa.array(of[first]))]), pa.array(np.r_[spread, other[first].view(np.int64)]), count, pa.concat_arrays([doc, pa.nulls(len(first), doc.type)])], ["uid", "h", "times", "doc"]
            )


def score(docs: DataFrame, model_file: str, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of non-space bytes, A-Z lower-cased, and an end for each text;
    a null or empty text has the end alone.  Rows whose crc32 of doc_id (null:
    of the empty string) is divisible by ten are held out of all that is learnt.
    ``base_score`` adds up log10 of the smoothed token frequencies, ``score`` is
    log10 of the text's probability in the lattice, both over whole texts.
    Tokens are told apart by 64-bit hashes.  Repeated rows each get their score,
    an empty table gives an empty result, extra columns are ignored.  With nothing
    to train on the prior alone scores and every count is 0.
    """
    spark: SparkSession = docs.sparkSession
    own = staging.only(docs, "doc_id", "text").withColumn("held_out", training_part(0, 10))
    counted = own.select("text", "held_out").mapInArrow(_counts, "h bigint, token binary, c bigint, all_ bigint")
    tokens = staging.stage(counted.groupBy("h").agg(F.min("token").alias("token"), F.sum("c").alias("c"), F.sum("all_").alias("all_")), "tokens")
    n_docs = own.where(~F.col("held_out")).count()
    r = tokens.where("c > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    distinct, total = r[0] + (n_docs > 0), r[1] + n_docs

    pieces, prior = load_pieces(model_file)
    p, end = adapt(tokens, pieces, prior, n_docs, rounds)
    logp = np.log(p)
    scored = staging.stage(tokens.mapInArrow(lambda it: _marginals(it, pieces, logp), "h bigint, c bigint, all_ bigint, model double"), "scored")
    base = lambda c: F.log10((c + 0.1) / (F.lit(total) + 0.1 * (F.lit(distinct) + 1)))
    table = scored.select("h", F.col("all_"), (F.col("c") > 0).cast("int").alias("known"), base(F.col("c")).alias("base"), "model")

    held = _most_frequent(table)
    shipped = spark.sparkContext.broadcast(held)
    kind = dict(own.dtypes)["doc_id"]
    parts = own.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
        lambda it: _score(it, shipped), f"uid bigint, h bigint, times int, doc struct<doc_id:{kind},held_out:boolean,n:bigint,known:double,base:double,model:double>")
    joined = parts.join(table.select("h", "known", "base", "model"), "h", "left")
    more = lambda c: F.sum(F.coalesce(F.col("times") * F.col(c), F.lit(0.0)))
    by_text = joined.groupBy("uid").agg(F.max("doc").alias("d"), more("known").alias("known"), more("base").alias("base"), more("model").alias("model"))
    return by_text.select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.held_out").alias("held_out"), (F.col("d.n") + 1).cast("long").alias("n_tokens"),
        (F.col("d.known") + F.col("known") + int(n_docs > 0)).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("d.base") + F.col("base") + base(F.lit(n_docs))).alias("base_score"), (F.col("d.model") + F.col("model") + float(np.log10(end))).alias("score"),
    )


def _most_frequent(table: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes and values of at most ``HELD`` tokens, all those beyond some frequency."""
    sizes = sorted(((r["size"], r["count"]) for r in table.groupBy(F.floor(F.log2("all_")).alias("size")).count().collect()), reverse=True)
    least, room = 64, HELD
    for size, count in sizes:
        if count > room:
            break
        least, room = size, room - count
    rows = table.where(F.floor(F.log2("all_")) >= least).drop("all_").toPandas()
    order = np.argsort(rows["h"].to_numpy(np.int64).view(np.uint64))
    return rows["h"].to_numpy(np.int64).view(np.uint64)[order], [rows[c].to_numpy(float)[order] for c in ("known", "base", "model")]
