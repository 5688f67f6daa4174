"""Words of whole texts, found on the UTF-8 bytes of an Arrow column with numpy: no Python object per word.

A word is a longest run of characters other than space and U+0009 to U+000D; UTF-8 keeps these bytes for themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15
#: Bytes of a word that are hashed in lanes of eight, at most; longer words are hashed one by one.
_LANES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Some texts: rows first..first+len(offsets)-1 of the batch; starts, ends, doc and key are by word."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def bounds(self) -> np.ndarray:
        """Index of each document's first word, and the number of words last."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value by byte over each document."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit value for each word; equal for equal bytes.

        Eight bytes at a time are mixed into the value by a bijection that is no polynomial, so words built of few
        letters in any pattern differ like all others; words of over _LANES bytes get XXH3.
        """
        data = LOWER[self.data] if lower else self.data
        size = self.ends - self.starts
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
        out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(_P))
        with np.errstate(over="ignore"):
            for done in range(0, _LANES, 8):
                live = np.flatnonzero((size > done) & (size <= _LANES)) if done else np.flatnonzero(size <= _LANES)
                if not len(live):
                    break
                rest = np.minimum(size[live] - done, 8).astype(np.uint64)
                lane = eight[self.starts[live] + done] << (np.uint64(64) - np.uint64(8) * rest)  # bytes after the word go
                out[live] = mix((out[live] ^ lane) * np.uint64(_P) + np.uint64(done + 1))
        for k in np.flatnonzero(size > _LANES).tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[self.starts[k] : self.ends[k]].tobytes())
        return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array | pa.ChunkedArray, most: int = 2 << 20) -> Iterator[Slice]:
    """The texts of a column in runs of about `most` bytes; a longer text is a run of its own, whole."""
    data, offsets = text_buffers(column)
    n, k = len(offsets) - 1, 0
    while k < n:
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        at = offsets[k : to + 1] - offsets[k]
        piece = data[offsets[k] : offsets[to]]
        inside = IN_WORD[piece]
        before = np.zeros(len(piece), bool)
        before[1:] = inside[:-1]
        cut = at[:-1][at[:-1] < len(piece)]
        before[cut] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(piece), bool)
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        yield Slice(k, piece, at, starts, ends, np.searchsorted(at, starts, "right") - 1)
        k = to


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit value for each window of `size` words of one document; with fewer words, one for them all."""
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * np.uint64(_P) + h[k : k + n])
    return out
