"""Static three-wise binary fuse filters (Graf and Lemire, 2022) over 64-bit keys, built with numpy.

A filter answers yes for every key that it was built from, and for about one in 256 others. It takes about nine to ten bits a key.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from passagemill.llm.arrow import mix

_HEAD = "<QIII"


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in three neighbouring segments, and the one-byte fingerprint, of each key."""
    hashes = mix(keys + np.uint64(seed))
    high = (hashes >> np.uint64(32)).astype(np.uint64)
    first = (high * np.uint64(segments)) >> np.uint64(32)
    one, two = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), mix(hashes ^ np.uint64(0x14057B7EF767814F))
    size, low = np.uint64(segment), np.uint64(segment - 1)
    slots = np.stack([
        first * size + (hashes & low), (first + np.uint64(1)) * size + (one & low), (first + np.uint64(2)) * size + (two & low)
    ]).astype(np.int64)
    return slots, ((hashes ^ (hashes >> np.uint64(17))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for seed in range(1, 200):
        slots, prints = _places(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments)
        table = _assign(slots, prints, segment * (segments + 2))
        if table is not None:
            return struct.pack(_HEAD, seed, segment, segments, n) + table.tobytes()
        if seed % 10 == 0:
            segments += max(1, segments // 8)
    raise RuntimeError("no seed gives a filter")


def _assign(slots: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray | None:
    """Peels keys that are alone in a slot, layer by layer; then fills the slots in the opposite order."""
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    sums = np.zeros(size, dtype=np.int64)
    for row in slots:
        np.bitwise_xor.at(sums, row, np.arange(n))
    layers, left = [], n
    single = np.flatnonzero(count == 1)
    while len(single):
        keys, at = np.unique(sums[single], return_index=True)
        layers.append((keys, single[at]))
        left -= len(keys)
        touched = slots[:, keys].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(sums, touched, np.tile(keys, 3))
        touched = np.unique(touched)
        single = touched[count[touched] == 1]
    if left:
        return None
    table = np.zeros(size, dtype=np.uint8)
    for keys, own in reversed(layers):
        # A slot that a key owns holds nothing yet, and no key of this layer uses another one's slot.
        table[own] = prints[keys] ^ table[slots[0, keys]] ^ table[slots[1, keys]] ^ table[slots[2, keys]]
    return table


def contains(packed: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, segments, n = struct.unpack_from(_HEAD, packed)
    if not n:
        return np.zeros(len(keys), dtype=bool)
    table = np.frombuffer(packed, dtype=np.uint8, offset=struct.calcsize(_HEAD))
    slots, prints = _places(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == prints
