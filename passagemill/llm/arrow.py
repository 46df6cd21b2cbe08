"""Words, lines and hashes of Arrow text columns, computed for whole slices of documents with numpy.

White space is always ``[\\x20\\x09-\\x0D]``; nulls count as empty texts. Every function takes whole texts; slices and
blocks only bound the memory that one numpy expression takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
_LETTERS = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(values: np.ndarray) -> np.ndarray:
    """MurmurHash3's 64-bit finaliser."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows whose texts hold about ``limit`` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if batch.num_rows > start:
        yield batch.slice(start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in one array, and where each text starts (one more entry at the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[starts[0] : starts[-1]], starts - starts[0]


class Units:
    """The words, or the lines that hold a word, of a slice of texts.

    ``start`` and ``end`` are byte positions in ``data``; those of text ``i`` are ``first[i] .. first[i + 1]``.
    """

    def __init__(self, texts: pa.Array, kind: str):
        self.data, self.texts = text_bytes(texts)
        if kind == "words":
            self._words()
        elif kind == "lines":
            self._lines()
        else:
            raise ValueError(f"unknown unit {kind}")
        self.first = np.searchsorted(self.start, self.texts).astype(np.int64)

    def _edges(self) -> np.ndarray:
        """Where a text begins, as a mask over the bytes (empty texts have no byte)."""
        mask = np.zeros(len(self.data) + 1, dtype=bool)
        mask[self.texts] = True
        return mask

    def _words(self) -> None:
        ink, edge = ~_IS_WHITE[self.data], self._edges()
        before = np.concatenate([[False], ink[:-1]]) if len(ink) else ink
        after = np.concatenate([ink[1:], [False]]) if len(ink) else ink
        self.start = np.flatnonzero(ink & (~before | edge[:-1]))
        self.end = np.flatnonzero(ink & (~after | edge[1:])) + 1

    def _lines(self) -> None:
        cut = np.flatnonzero(self.data == 10)
        start = np.unique(np.concatenate([self.texts[:-1], cut + 1]))
        start = start[start < len(self.data)]
        end = np.minimum(
            np.concatenate([cut, [len(self.data)]])[np.searchsorted(cut, start)],
            self.texts[np.searchsorted(self.texts, start, side="right")],
        )
        inked = np.concatenate([[0], np.cumsum(~_IS_WHITE[self.data])])
        held = inked[end] > inked[start]
        self.start, self.end = start[held], end[held]

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for the bytes of each unit, computed block by block."""
        out = np.empty(len(self.start), dtype=np.uint64)
        inverse = pow(int(_BASE), -1, 1 << 64)
        at = 0
        while at < len(out):
            begin = self.start[at]
            stop = max(at + 1, int(np.searchsorted(self.end, begin + BLOCK_BYTES, side="right")))
            held = self.data[begin : self.end[stop - 1]]
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[held] * powers(int(_BASE), len(held)))])
            low, high = self.start[at:stop] - begin, self.end[at:stop] - begin
            value = (sums[high] - sums[low]) * powers(inverse, int(low[-1]) + 1)[low]
            out[at:stop] = mix(value ^ (high - low).astype(np.uint64))
            at = stop
        return out


class Spans:
    """Hashes of runs of units: 64 and 32 bits that depend on the units and their number only."""

    def __init__(self, hashes: np.ndarray):
        rises, falls = powers(int(_BASE), len(hashes) + 1), powers(pow(int(_BASE), -1, 1 << 64), len(hashes) + 1)
        self.falls = falls
        self.sums = [
            np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * rises[:-1])])
            for values in (hashes, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        ]

    def of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (high - low).astype(np.uint64)
        first, second = (mix(((sums[high] - sums[low]) * self.falls[low]) ^ size) for sums in self.sums)
        return first.view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)
