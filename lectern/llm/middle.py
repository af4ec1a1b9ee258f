"""Fill-in-the-middle: texts cut at two unit boundaries and put together in another order.

The Split pre-tokenizer of the tokenizers library, whose regex matches are
isolated pieces, gives the code-point offsets of a text's units and needs no
training.  As many offsets as there are units give n; the offsets at two ranks,
drawn from a hash of the document's id, cut the text.  All else is expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A unit: a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Where a unit surely ends.
BOUNDARY = re.compile(r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are rearranged, and percent of those that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
#: Code points that the pre-tokenizer sees at once; it takes some 250 bytes for each.
WINDOW = 1 << 17


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(UNIT), "isolated")


def ends(text: str) -> np.ndarray:
    """Code-point offsets at which the units of a text end.

    A long text is read in windows that end where a unit ends; a unit longer
    than a window is read whole.
    """
    split, found, at = _splitter(), [np.zeros(0, np.int64)], 0
    while at < len(text):
        near = BOUNDARY.search(text, at + WINDOW) if len(text) - at > WINDOW else None
        to = near.start() if near else len(text)
        found.append(at + np.fromiter((end for _, (_, end) in split.pre_tokenize_str(text[at:to])), np.int64))
        at = to
    return np.concatenate(found)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")]))
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, one, other in batches:
        rows = []
        for text, *drawn in zip(texts, one, other):
            edge = np.r_[0, ends(text)]
            low, high = sorted(h % len(edge) for h in drawn)
            rows.append((len(edge) - 1, edge[low], edge[high]))
        yield pd.DataFrame(rows, columns=["n", "first", "second"], dtype="int64")


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the seed and an id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``columns`` of (doc_id, text, ...) with n units, ``form``, prefix_chars, middle_chars and ``output``.

    The form is ``plain`` (the text as it is; no lengths) for empty texts, for
    those that hold a marker already, and for all but ``rate`` percent; else
    ``spm``, suffix first, or ``psm``.  Null text counts as empty, a null id as
    an empty one.  Rows with equal ids draw equal numbers; repeated rows stay.
    Columns that are not named are left out, so that none can clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    inner = {c: f"c{n}" for n, c in enumerate(columns)}
    drawn = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], text.alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)])
    cut = drawn.withColumn("cut", _cuts("text", "h1", "h2"))
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(marker))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    first, second = F.col("cut.first"), F.col("cut.second")
    prefix, middle = F.substr("text", F.lit(1), first.cast("int")), F.substr("text", (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substr("text", (second + 1).cast("int"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).select(
        *[F.col(n).alias(c) for c, n in inner.items()], F.col("cut.n").alias("n"), "form",
        F.when(moved, first).alias("prefix_chars"), F.when(moved, second - first).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``rearrange`` was given, from its output and form: no marker can stand in it or arise at its edges."""
    second = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    third = F.locate(MIDDLE, output)
    parts = F.substr(output, F.lit(4), second - 4), F.substr(output, second + 3, third - second - 3)
    middle = F.substr(output, third + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[0], middle, parts[1])).otherwise(F.concat(parts[1], middle, parts[0]))
