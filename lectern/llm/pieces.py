"""SentencePiece ids through a table of distinct marked words.

Where no piece of a vocabulary has a white space marker after other characters,
a segmentation never crosses from a word into the markers of the next one.  So a
marked word (its markers and the run up to the next marker) has the same ids
wherever it stands: each distinct one is segmented once, and the ids are joined
back by position.

A text's words become numbers of the table's words, and all its ids are gathered
by these numbers at once.  Each task keeps a table of its own: in natural text
most distinct words are rare and stand in one task alone, so that a table of the
whole corpus would shuffle nearly every word of it, there and back, to save the
few that tasks share (see the README for what that took).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: White space marker, and a word with the markers before it.
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of the texts whose words are told together, and words that a task's table holds at most before it begins anew.
BLOCK, HELD = 1 << 22, 1 << 18
#: Ids that the library decodes at once.
PART = 1 << 20
#: A word before each segmented one, so that the library does not take that for a text's beginning.
LEAD = "a"


@lru_cache(maxsize=2)
def load(model_file: str):
    """The library's processor; an error where a piece crosses into the next word's markers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing or model.normalize("a a") != f"{MARK}a{MARK}a":
        raise ValueError(f"words of {model_file} cannot be segmented one by one: {crossing[:3]}")
    return model


def segment(words: list[str], model_file: str) -> list[list[int]]:
    """Ids of marked words."""
    model = load(model_file)
    skip = len(model.encode(LEAD))
    return [ids[skip:] for ids in model.encode([LEAD + w for w in words], num_threads=1)]


def _ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > BLOCK:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Table:
    """Ids of distinct marked words, each segmented when it is first asked for."""

    def __init__(self, model_file: str) -> None:
        self.model, self.file, self.ids = load(model_file), model_file, {}

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words in a row, and how many each has."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > HELD:
            self.ids, new = {}, words
        self.ids.update(zip(new, segment(new, self.file)))
        lists = [self.ids[w] for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, the offsets of each, and what the library decodes them to."""
        known: dict[str, int] = {}
        told = [np.fromiter((known.setdefault(m[0], len(known)) for m in WORD.finditer(self.model.normalize(t))), np.int64) for t in texts]
        ids, sizes = self.look_up(list(known))
        # The end id is a word more, the last of each text.
        numbers = np.concatenate([x for one in told for x in (one, [len(known)])])
        ids, sizes = np.append(ids, self.model.eos_id()), np.append(sizes, 1)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[numbers]
        edge = np.r_[0, np.cumsum(lengths)]
        flat = ids[np.repeat(starts[numbers] - edge[:-1], lengths) + np.arange(edge[-1])]
        ends = np.r_[0, np.cumsum([len(one) + 1 for one in told])]
        return flat, edge[ends], [self.decode(flat, edge[a : b + 1]) for a, b in zip(ends[:-1], ends[1:])]

    def decode(self, flat: np.ndarray, edge: np.ndarray) -> str:
        """The library's decode of one text's ids, given where its words end; long ones by parts that end with a word."""
        cuts = np.unique(np.r_[0, np.searchsorted(edge - edge[0], np.arange(PART, edge[-1] - edge[0], PART)), len(edge) - 1])
        lead = self.model.encode(LEAD)
        parts = [flat[edge[a] : edge[b]].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        return self.model.decode(parts[0]) + "".join(self.model.decode(lead + p)[len(LEAD) :] for p in parts[1:])


def encode(docs: DataFrame, model_file: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of (text, ...) with ``ids``, the library's ids with an end id only, and ``decoded``, its decode(ids).

    Null counts as empty, whose ids are the end alone.  Repeated rows, null or
    repeated ids and ties stay rows of their own; a text of any length is read
    alone if it is longer than a block; columns that are not named are left out,
    so that none can clash.  An empty table gives none.
    """
    # The operator's own names are kept off the table's.
    inner = {c: f"c{n}" for n, c in enumerate(columns)}
    plain = docs.select(F.col("text"), *[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    carried = [f for f in plain.schema if f.name != "text"]
    schema = T.StructType([*carried, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(model_file)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for lo, hi in _ranges(pa.compute.utf8_length(texts).to_pylist()):
                flat, offsets, decoded = table.encode(texts[lo:hi].to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name)[lo:hi] for f in carried), ids, pa.array(decoded, pa.string())], [f.name for f in schema])

    return plain.mapInArrow(read, schema).select(*[F.col(n).alias(c) for c, n in inner.items()], "ids", "decoded")
