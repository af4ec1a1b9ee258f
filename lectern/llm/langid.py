"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word forwards and backwards and labels every
byte with language probabilities; a document's probabilities are the mean over
all its letter bytes.  A word (a run of ASCII letters and bytes beyond ASCII,
A-Z lower-cased) is one sequence, so equal words of a batch share one run of the
network and whole texts stay cheap.  A run of more than ``MAX_BYTES``, as in
scripts without spaces, is read in windows: of each the middle ``STRIDE`` bytes are
labelled, with ``CONTEXT`` bytes before and after them for the states to settle.
Training is back-propagation through time, in numpy, on a bounded sample of
labelled words and windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import staging
from .textkit import LETTERS, LOWER, chunks, prefix_hash, span_hash, spans, text_buffers

HIDDEN = 12
STRIDE, CONTEXT = 32, 8
MAX_BYTES = STRIDE + 2 * CONTEXT
#: Bounds of the training sample: documents of each language (expected) and distinct words in all.
SAMPLE_DOCS, SAMPLE_WORDS = 500, 40_000
#: Below this pooled probability a filter rejects the document along with those without letters.
REJECT = 0.3
_KNOWN = 400_000  # words whose sums a worker remembers
_memory: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights; direction 0 reads forwards, 1 backwards.

    ``table`` holds what each byte adds to the update, reset and candidate gates.
    """

    langs: list[str]
    table: np.ndarray  # 2 x 256 x 3H
    gates: np.ndarray  # 2 x H x 2H
    cand: np.ndarray  # 2 x H x H
    out: np.ndarray  # 2H x K
    bias: np.ndarray  # K

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng, k = np.random.default_rng(seed), len(langs)
        f = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(langs, f(2, 256, 3 * hidden), f(2, hidden, 2 * hidden), f(2, hidden, hidden), f(2 * hidden, k), np.zeros(k, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.cand, self.out, self.bias]

    def name(self) -> bytes:
        """A digest of the languages and all weights: what is remembered of one network is never taken for another's."""
        return hashlib.sha256("\0".join(self.langs).encode() + b"".join(w.tobytes() for w in self.weights())).digest()

    def run(self, words: np.ndarray) -> tuple[np.ndarray, list]:
        """Probabilities at each byte of equally long words (n x L x K), and what back-propagation needs."""
        n, length = words.shape
        h_size = self.cand.shape[1]
        states = np.zeros((n, length, 2 * h_size), np.float32)
        tape = []
        for d in (0, 1):
            h = np.zeros((n, h_size), np.float32)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                x = self.table[d][words[:, t]]
                g = _sigmoid(x[:, : 2 * h_size] + h @ self.gates[d])
                z, r = g[:, :h_size], g[:, h_size:]
                c = np.tanh(x[:, 2 * h_size :] + (r * h) @ self.cand[d])
                tape.append((d, t, h, z, r, c))
                h = (1 - z) * h + z * c
                states[:, t, d * h_size : (d + 1) * h_size] = h
        logits = states @ self.out + self.bias
        e = np.exp(logits - logits.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True), [states, tape]

    def gradients(self, words: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all positions, by back-propagation through time."""
        p, (states, tape) = self.run(words)
        n, length, _ = p.shape
        h_size = self.cand.shape[1]
        p[np.arange(n)[:, None], np.arange(length), labels[:, None]] -= 1
        p /= n * length
        grads = [np.zeros_like(w) for w in self.weights()]
        grads[3] += states.reshape(-1, 2 * h_size).T @ p.reshape(-1, p.shape[2])
        grads[4] += p.sum((0, 1))
        into = p @ self.out.T
        carry = np.zeros((2, n, h_size), np.float32)
        for d, t, h, z, r, c in reversed(tape):
            dh = into[:, t, d * h_size : (d + 1) * h_size] + carry[d]
            dc = dh * z * (1 - c * c)
            drh = dc @ self.cand[d].T
            dg = np.concatenate([dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)], 1)
            carry[d] = dh * (1 - z) + drh * r + dg @ self.gates[d].T
            np.add.at(grads[0][d], words[:, t], np.concatenate([dg, dc], 1))
            grads[1][d] += h.T @ dg
            grads[2][d] += (r * h).T @ dc
        return grads


def fit(words: list[bytes], labels: np.ndarray, counts: np.ndarray, langs: list[str], steps: int = 900, batch: int = 256, seed: int = 11) -> Network:
    """Train on words drawn by count ** 0.75, each batch of one length, with Adam."""
    rng, net = np.random.default_rng(seed), Network.fresh(langs)
    sizes = np.array([len(w) for w in words])
    weight = counts.astype(float) ** 0.75
    for k in range(len(langs)):  # every language weighs the same
        weight[labels == k] /= max(weight[labels == k].sum(), 1e-9)
    lengths = np.unique(sizes)
    groups = {}
    for n in lengths:
        at = np.flatnonzero(sizes == n)
        groups[n] = np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, n), labels[at], weight[at] / weight[at].sum()
    mass = np.array([weight[sizes == n].sum() * n for n in lengths])
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(1, steps + 1):
        grid, label, p = groups[rng.choice(lengths, p=mass / mass.sum())]
        at = rng.choice(len(grid), batch, p=p)
        rate = 0.02 * (1 - step / (steps + 1)) + 0.001
        for w, g, a, b in zip(net.weights(), net.gradients(grid[at], label[at]), first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def training_part(remainder: int = 2, modulus: int = 4) -> F.Column:
    """Whether a row is held out of training: crc32 of doc_id as text (null: empty)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def train(docs: DataFrame, seed: int = 3) -> Network | None:
    """Fit to the rows of ``docs`` that have a language and aren't held out; None without any.

    The sample: about ``SAMPLE_DOCS`` documents of each language, chosen by a hash
    of doc_id, and ``SAMPLE_WORDS`` of their distinct words, longer ones as windows
    of ``MAX_BYTES``: the most frequent of each language in turn, so that each
    language with a word is learnt.
    """
    own = staging.only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~training_part())
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / n)))])
    drawn = own.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = drawn.select("lang", F.explode(F.regexp_extract_all(low, F.lit("[^\\x00-\\x60\\x7B-\\x7F]+"), F.lit(0))).alias("word")).groupBy("lang", "word").count()
    pieces = F.expr(f"transform(sequence(0, greatest(octet_length(word) - {MAX_BYTES - STRIDE} - 1, 0), if(octet_length(word) > {MAX_BYTES}, {STRIDE}, {1 << 30})), i -> substring(cast(word AS binary), i + 1, {MAX_BYTES}))")
    found = words.select("lang", F.explode(pieces).alias("word"), "count").groupBy("lang", "word").agg(F.sum("count").alias("count"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    rows = found.withColumn("nth", nth).orderBy("nth", "lang").limit(max(SAMPLE_WORDS, len(sizes))).collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    index = {k: n for n, k in enumerate(langs)}
    return fit([bytes(r["word"]) for r in rows], np.array([index[r["lang"]] for r in rows]), np.array([r["count"] for r in rows]), langs)


def _word_sums(net: Network, name: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Probabilities of each given word summed over its bytes."""
    known, sums = _memory.get(name, (np.zeros(0, np.uint64), np.zeros((0, len(net.langs)), np.float32)))
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    have = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
    out = np.zeros((len(hashes), len(net.langs)), np.float32)
    out[have] = sums[at[have]]
    new = np.flatnonzero(~have)
    size = ends[new] - starts[new]
    counts = np.where(size <= MAX_BYTES, 1, -(-size // STRIDE))
    owner = np.repeat(new, counts)
    part, many = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), np.repeat(counts > 1, counts)
    # Labelled bytes [lo, hi) of each sequence, and the sequence with its context.
    lo = starts[owner] + part * STRIDE
    hi = np.where(many, np.minimum(lo + STRIDE, ends[owner]), ends[owner])
    begin = np.where(many, np.maximum(lo - CONTEXT, starts[owner]), lo)
    end = np.where(many, np.minimum(hi + CONTEXT, ends[owner]), hi)
    shapes, which = np.unique(np.stack([end - begin, lo - begin, hi - begin]), axis=1, return_inverse=True)
    for k, (n, left, right) in enumerate(shapes.T):
        at = np.flatnonzero(which.ravel() == k)
        for first in range(0, len(at), 4096):
            some = at[first : first + 4096]
            p, _ = net.run(data[begin[some, None] + np.arange(n)])
            np.add.at(out, owner[some], p[:, left:right].sum(1))
    if len(known) + len(new) > _KNOWN:
        known, sums = known[:0], sums[:0]
    known, sums = np.concatenate([known, hashes[new]]), np.concatenate([sums, out[new]])
    order = np.argsort(known)
    _memory.clear()
    _memory[name] = known[order][: 2 * _KNOWN], sums[order][: 2 * _KNOWN]
    return out


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean language probabilities over all letter bytes of each text; rows of zeros without any."""
    name = net.name()
    total = np.zeros((len(offsets) - 1, len(net.langs)))
    for lo, hi in chunks(offsets, 4 << 20):
        low = LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, rows = spans(low, offsets[lo : hi + 1] - offsets[lo], LETTERS)
        if not len(starts):
            continue
        hashes = span_hash(prefix_hash(low), starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        sums = _word_sums(net, name, low, starts[first], ends[first], distinct)
        for k in range(len(net.langs)):
            total[lo:hi, k] += np.bincount(rows, sums[which, k], hi - lo)
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def _label(batches: Iterator[pa.RecordBatch], net: Network | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lettered = batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
        if net is None:
            lang, score = np.full(len(batch), "und", object), np.zeros(len(batch))
        else:
            p = document_probabilities(net, *text_buffers(batch.column("__text")))
            lang = np.where(lettered, np.array(net.langs, object)[p.argmax(1)], "und")
            score = np.where(lettered, np.clip(p.max(1), 0, 1), 0.0)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])


def identify(docs: DataFrame, net: Network | None, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (the named columns, or all) with lang_pred and score.

    ``lang_pred`` is the language with the highest pooled probability, ``score``
    that probability.  A text that is null or has no letter gets ``und`` and 0,
    as does every text when there was nothing to learn from.  Columns of ``docs``
    named lang_pred or score are replaced.  Order and repeated rows don't matter.
    """
    names = [c for c in columns or docs.columns if c not in ("lang_pred", "score")]
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("__letters")
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("__text"), letters)
    kept = docs.select(*[F.col(f"`{c}`") for c in names]).schema
    kind = kept.add("lang_pred", "string").add("score", "double")
    return given.mapInArrow(lambda it: _label(it, net, names), kind)
