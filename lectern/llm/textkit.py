"""Vectorised byte, word and shingle arrays over the texts of an Arrow batch.

Texts are never looped over in Python: a chunk of whole texts is one byte array
with offsets, and words and hashes are found for all of it at once.  A chunk
holds about a megabyte, or a single longer text, which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that belong to words after A-Z is lower-cased: digits, a-z and all of UTF-8 beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Letters only: as WORD without digits.
LETTERS = WORD.copy()
LETTERS[48:58] = False
#: Everything but space and the five control characters from tab to carriage return.
TOKEN = np.ones(256, bool)
TOKEN[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, ``n`` at least."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(CHUNK + 4096, n)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * CHUNK:
            _powers[0] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, target: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes each; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of the table's bytes; runs end with their text."""
    inside = table[data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; see :func:`span_hash`."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(running))
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each lower-cased word of a chunk."""
    low = LOWER[data]
    starts, ends, rows = spans(low, offsets, WORD)
    return span_hash(prefix_hash(low), starts, ends), rows


def shingles(words: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``k`` words; a text of one to ``k - 1`` words is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1], True])
    counts = np.diff(edges)
    total = np.zeros(len(words), np.uint64)
    up, _ = powers(k + 1)
    position = np.arange(len(words))
    limit = np.repeat(edges[1:], counts)
    for i in range(k):
        at = position + i
        ok = at < limit
        total[ok] += (words[at[ok]] >> np.uint64(1)) * up[i + 1]
    keep = (position + k <= limit) | (np.repeat(counts, counts) < k) & (position == np.repeat(edges[:-1], counts))
    return mix(total[keep]), rows[keep]
