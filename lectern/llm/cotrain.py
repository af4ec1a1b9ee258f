"""Quality classification by co-training of a text and a metadata view.

Two logistic classifiers see different sides of a document: its content (hashed
words and shape statistics) and its metadata (source, language, stated length).
Round by round each labels the unlabelled documents it is sure of for the other.
Both are then calibrated on labelled rows that trained neither, and a logistic
combination of their calibrated log-odds scores every document.

Only a bounded hash sample of ``LABELLED`` labelled documents is fitted on.  The
exchange is over all unlabelled documents: their features are written once, every
round scores them all by both views, and each view passes on those that it is
surest of in the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import staging
from .langid import training_part
from .textkit import LOWER, WORD, chunks, mix, prefix_hash, span_hash, spans, text_buffers

#: Expected size of the sample of labelled documents.
LABELLED = 6000
#: Rounds, documents that a view passes on in each, and how sure it must be of them.
ROUNDS, PASSED, SURE = 4, 400, 0.95
#: Deals of each view's and label's surest rows, so that no task ranks those of all tasks.
DEALS = 64
#: Buckets of the hashed words, sources, languages and lengths.
WORDS, SOURCES, LANGS, LENGTHS = 256, 64, 16, 24
#: Byte classes: upper case, lower case, digit, blank, line feed, sentence mark, other mark, beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[32, 9, 13]], _CLASS[10] = 0, 1, 2, 3, 4
_CLASS[[33, 44, 46, 58, 59, 63]], _CLASS[128:] = 5, 7
_LINE = np.ones(256, bool)
_LINE[10] = False
SHAPE = 8 + 5


def content_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text view of each text of a chunk: unit-length hashed words, byte-class shares, word and line statistics.  Length is left to the other view."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, WORDS + SHAPE), np.float32)
    low = LOWER[data]
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8) / np.maximum(size, 1)[:, None]
    starts, ends, of = spans(low, offsets, WORD)
    running = prefix_hash(low)
    words = span_hash(running, starts, ends)
    n_words = np.bincount(of, minlength=n)
    bag = np.sqrt(np.bincount(of * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS))
    out[:, :WORDS] = bag / np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1e-9)
    l_start, l_end, l_of = spans(data, offsets, _LINE)
    lines = span_hash(running, l_start, l_end)
    n_lines = np.bincount(l_of, minlength=n)
    stats = [
        np.bincount(of, ends - starts, n) / np.maximum(n_words, 1) / 8,
        _distinct(words, of, n) / np.maximum(n_words, 1),
        np.log1p(size / np.maximum(n_lines, 1)) / 5,
        _distinct(lines, l_of, n) / np.maximum(n_lines, 1),
        (size == 0).astype(float),
    ]
    out[:, WORDS:] = np.c_[share, np.stack(stats, 1)]
    return out


def _distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    keys = np.unique(mix(hashes ^ mix(rows.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    return np.bincount(rows[keys], minlength=n)


def _metadata() -> F.Column:
    """Metadata view: one-hot positions of source, language and length, nulls being values of their own."""
    at = lambda c, n, base: F.pmod(F.xxhash64(F.lit(c), F.col(c)), F.lit(n)).cast("int") + base
    length = F.least(F.floor(F.log2(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)), F.lit(LENGTHS - 1)).cast("int")
    return F.array(at("source", SOURCES, 0), at("lang", LANGS, SOURCES), length + SOURCES + LANGS)


def _one_hot(meta: pa.Array) -> np.ndarray:
    at = np.asarray(meta.flatten()).reshape(-1, 3)
    out = np.zeros((len(at), SOURCES + LANGS + LENGTHS), np.float32)
    out[np.arange(len(at))[:, None], at] = 1
    return out


@dataclass
class Logistic:
    """A logistic classifier over standardised features."""

    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> Logistic:
        """Newton's method on the penalised likelihood."""
        wide = np.c_[x, np.ones(len(x))].astype(float)
        w, ridge = np.zeros(wide.shape[1]), np.r_[np.full(x.shape[1], penalty), 1e-6]
        for _ in range(rounds):
            p = _sigmoid(wide @ w)
            grad = wide.T @ (p - y) + ridge * w
            hess = (wide * (p * (1 - p) + 1e-9)[:, None]).T @ wide
            w -= np.linalg.solve(hess + np.diag(ridge), grad)
        return cls(w[:-1], float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Both views, their calibrations, and the combination of the calibrated log-odds."""

    views: list[Logistic]
    scales: list[Logistic]
    both: Logistic

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of high quality by the text, by the metadata, and by both."""
        logits = [s.logit(v.logit(x)[:, None]) for x, v, s in zip(views, self.views, self.scales, strict=True)]
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(self.both.logit(np.stack(logits, 1)))


#: Finds the surest rows: models and scales of both views, keys already passed on, how many of label 1 and 0;
#: gives (view, label, features of the other view) lists and the keys.
Surest = Callable[[list[Logistic], list[Logistic], np.ndarray, tuple[int, int]], tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]


def cotrain(views: list[np.ndarray], y: np.ndarray, calibrate: np.ndarray, surest: Surest, rounds: int = ROUNDS, passed: int = PASSED) -> Model:
    """Fit on labelled rows (those of ``calibrate`` kept apart), exchanging pseudo-labels over the rows that ``surest`` knows."""
    own = [(x[~calibrate], y[~calibrate].astype(float)) for x in views]
    taken = np.zeros(0, np.int64)
    scales = lambda m: [Logistic.fit(v.logit(x[calibrate])[:, None], y[calibrate], 1e-3) for v, x in zip(m, views, strict=True)]
    models = [Logistic.fit(*o) for o in own]
    # As many of each class as its share asks for.
    wanted = max(1, round(passed * y.mean())), max(1, round(passed * (1 - y.mean())))
    for _ in range(rounds):
        view, label, features, keys = surest(models, scales(models), taken, wanted)
        if not len(keys):
            break
        for to in (0, 1):
            at = view == 1 - to
            own[to] = np.concatenate([own[to][0], features[to][at]]), np.r_[own[to][1], label[at].astype(float)]
        taken = np.r_[taken, keys]
        models = [Logistic.fit(*o) for o in own]
    found = scales(models)
    logits = np.stack([s.logit(v.logit(x[calibrate])[:, None]) for x, v, s in zip(views, models, found, strict=True)], 1)
    return Model(models, found, Logistic.fit(logits, y[calibrate], 1e-2))


def _matrices(table: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """Both views of staged rows."""
    content, meta = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("content"), table.column("meta")))
    return [np.asarray(content.flatten(), np.float32).reshape(len(content), WORDS + SHAPE), _one_hot(meta)]


def _confident(batches: Iterator[pa.RecordBatch], models: list[Logistic], scales: list[Logistic], taken: np.ndarray, wanted: tuple[int, int], sure: float) -> Iterator[pa.RecordBatch]:
    """The task's surest rows of each view and label: those of all rows are among them."""
    best = {(v, label): (np.zeros(0), np.zeros(0, np.int64)) for v in (0, 1) for label in (1, 0)}
    for batch in batches:
        keys = batch.column("key").to_numpy()
        free = ~np.isin(keys, taken)
        for v, x in enumerate(_matrices(batch)):
            p = _sigmoid(scales[v].logit(models[v].logit(x)[:, None]))
            for label, certain in ((1, p), (0, 1 - p)):
                at = np.flatnonzero(free & (certain >= sure))
                c, k = np.r_[best[v, label][0], certain[at]], np.r_[best[v, label][1], keys[at]]
                k, first = np.unique(k, return_index=True)
                order = np.lexsort((k, -c[first]))[: wanted[1 - label]]
                best[v, label] = c[first][order], k[order]
    parts = [(np.full(len(k), v), np.full(len(k), label), c, k) for (v, label), (c, k) in best.items()]
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["view", "label", "certain", "key"])


def _exchange(rows: DataFrame, sure: float) -> Surest:
    """The surest of all ``rows`` (key, content, meta) by a distributed top-k; a key that both views want goes to the surer."""

    def surest(models, scales, taken, wanted):
        told = rows.mapInArrow(lambda it: _confident(it, models, scales, taken, wanted, sure), "view bigint, label bigint, certain double, key bigint")
        nth = lambda *by: F.row_number().over(Window.partitionBy("view", "label", *by).orderBy(F.desc("certain"), "key"))
        # Every task gives its surest; first the surest of each deal are kept, then those of all deals, few by then.
        dealt = told.distinct().withColumn("deal", F.pmod("key", F.lit(DEALS))).withColumn("nth", nth("deal")).where(F.col("nth") <= max(wanted)).drop("deal", "nth")
        best = dealt.withColumn("nth", nth()).where(F.col("nth") <= F.when(F.col("label") == 1, wanted[0]).otherwise(wanted[1]))
        picked = best.groupBy("key").agg(F.max(F.struct("certain", "view", "label")).alias("p")).select("key", "p.view", "p.label")
        picked = staging.stage(picked, "picked")  # at most 2 * PASSED rows and two
        found = rows.join(F.broadcast(picked), "key").groupBy("key").agg(F.first("view").alias("view"), F.first("label").alias("label"), F.min_by("content", "meta").alias("content"), F.min("meta").alias("meta")).orderBy("key").toArrow()
        return found.column("view").to_numpy(), found.column("label").to_numpy(), _matrices(found) if len(found) else [np.zeros((0, 0))] * 2, found.column("key").to_numpy()

    return surest


def _drawn(rows: int, bound: int, seed: int) -> F.Column:
    share = min(1.0, bound / max(rows, 1))
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) < int(share * 1_000_003)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for lo, hi in chunks(offsets):
            x = content_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("key", "doc_id", "meta")), lists], ["key", "doc_id", "meta", "content"])


def train(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model | None:
    """Fit to the labelled rows that aren't held out; None without both classes among them.

    A doc_id with several labels has their mean, rounded up from a half; of
    several rows with a sampled doc_id one counts.  Rows that repeat id, text and
    metadata are one unlabelled document.
    """
    known = staging.only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = staging.stage(known, "labels")
    n_known = known.count()
    own = staging.only(docs, "doc_id", "text", "lang", "source", "n_chars").select("doc_id", "text", _metadata().alias("meta"), F.xxhash64("doc_id", "text", "lang", "source", "n_chars").alias("key"))
    kind = dict(docs.dtypes)["doc_id"]
    # Labels come to the features, which are shorter than texts: past the bound of a broadcast the rows are shuffled.
    made = own.mapInArrow(_features, f"key bigint, doc_id {kind}, meta array<int>, content array<float>")
    table = staging.stage(staging.join_bounded(made, known, "doc_id", n_known, how="left"), "features")
    drawn = table.where(F.col("label").isNotNull() & _drawn(n_known, LABELLED, seed) & ~training_part())
    fit_on = drawn.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by(F.struct("content", "meta"), "key").alias("d")).select("doc_id", "label", "d.content", "d.meta").orderBy("doc_id").toArrow()
    if not len(fit_on):
        return None
    views, y = _matrices(fit_on), fit_on.column("label").to_numpy().astype(float)
    calibrate = np.zeros(len(y), bool)
    for v in (0, 1):  # a quarter of each class, spread over the ids
        calibrate[np.flatnonzero(y == v)[1::4]] = True
    if len(np.unique(y[calibrate])) < 2 or len(np.unique(y[~calibrate])) < 2:
        return None
    return cotrain(views, y, calibrate, _exchange(table.where("label is null").select("key", "content", "meta"), SURE))


def _score(batches: Iterator[pa.RecordBatch], model: Model | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [[np.full(len(batch), 0.5)] for _ in range(3)]
        if model is not None:
            parts = [[], [], []]
            data, offsets = text_buffers(batch.column("__text"))
            meta = batch.column("__meta")
            for lo, hi in chunks(offsets):
                x = content_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for part, p in zip(parts, model.score([x, _one_hot(meta.slice(lo, hi - lo))]), strict=True):
                    part.append(p)
        text, metadata, both = (pa.array(np.concatenate(p) if p else np.zeros(0)) for p in parts)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), text, metadata, both], [*names, "text_score", "meta_score", "score"])


def classify(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (the named columns, or all) with text_score, meta_score, score and high_quality.

    Scores are calibrated probabilities of high quality, by the text, by the
    metadata and by both; ``high_quality`` is a score of one half or more.  A null
    or empty text is an empty one, null metadata is a value of its own.  Without
    a model (no labels of both classes) every score is one half.  Columns of
    ``docs`` with these names are replaced; an empty table gives an empty result.
    """
    ours = ("text_score", "meta_score", "score", "high_quality")
    names = [c for c in columns or docs.columns if c not in ours]
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("__text"), _metadata().alias("__meta"))
    kind = docs.select(*[F.col(f"`{c}`") for c in names]).schema
    for c in ours[:3]:
        kind = kind.add(c, "double")
    return given.mapInArrow(lambda it: _score(it, model, names), kind).withColumn("high_quality", F.col("score") >= 0.5)
