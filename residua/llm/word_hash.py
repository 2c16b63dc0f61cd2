"""Words of many texts at once, as 64-bit hashes, without a Python object a word.

Texts lie one behind another in one buffer, as Arrow keeps them. Words are runs of other bytes than ASCII white
space, A-Z lower-cased. A word's hash takes in eight bytes a round; words beyond LONG bytes are hashed by XXH64.
Words are told apart by these 64 bits: among a billion different words some two share one with a chance of 3 %.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Lower-cases A-Z and turns white space into a space.
_TABLE = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
LONG = 64
#: Bytes that are worked on at once; a longer text is one piece.
SEGMENT = 1 << 18
#: Masks that leave the first 0 to 8 bytes of eight.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text) of texts data[offsets[i]:offsets[i + 1]]."""
    offsets = np.asarray(offsets, np.int64)
    if len(offsets) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    first = 0
    while first < len(counts):  # as many texts as stay in the processor's cache, one at least
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT, "right")) - 1)
        h, counts[first:last] = _segment(data, offsets[first : last + 1])
        hashes.append(h)
        first = last
    return np.concatenate(hashes), counts


def _segment(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    view, cuts = memoryview(data), offsets.tolist()
    # A space before, between and behind the texts; eight bytes may be read behind the last word.
    joined = b" ".join([b"", *(view[a:b] for a, b in zip(cuts, cuts[1:])), bytes(8).replace(b"\0", b" ")]).translate(_TABLE)
    buffer = np.frombuffer(joined, np.uint8)
    word = buffer != 32
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(starts, offsets - offsets[0] + np.arange(1, len(offsets) + 1)))
    sizes = ends - starts
    eights = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    h = mixed((eights[starts] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more = np.flatnonzero(sizes > 8)
    for at in range(8, LONG, 8):
        if not len(more):
            break
        h[more] = mixed(h[more] ^ (eights[starts[more] + at] & _MASKS[np.minimum(sizes[more] - at, 8)]) * np.uint64(0xD6E8FEB86659FD93))
        more = more[sizes[more] > at + 8]
    for i in more.tolist():
        h[i] = xxhash.xxh64_intdigest(buffer[starts[i] : ends[i]])
    return h, counts


def binary_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of an Arrow binary array without nulls."""
    wide = str(column.type).startswith("large")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at.astype(np.int64)


class HashTable:
    """Distinct hashes to their positions, in open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = np.flatnonzero(self.values[at] < 0)
            # Of several that want one free place, the one that is written last has it.
            self.values[at[free]] = left[free]
            own = self.values[at] == left
            self.keys[at[own]] = keys[left[own]]
            left, at = left[~own], (at[~own] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where there is none."""
        at = self._home(keys)
        out = self.values[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[left] = got = self.values[at]
            on = np.flatnonzero((got >= 0) & (self.keys[at] != keys[left]))
            left, at = left[on], at[on]
        return out
