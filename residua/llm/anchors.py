"""Windows of fixed length, grouped under content-defined keys.

The key of a window is the smallest hash among its grams (half a window long). Equal windows have equal keys,
wherever they stand, and neighbouring windows mostly share theirs. So windows that may be repeated are found
by their keys, of which there are few: what repeats no key repeats no window.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the two polynomial hashes, modulo 2^64.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Symbols that are worked on at once.
SEGMENT = 1 << 20

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """B^k and B^-k for k below n."""
    have = _tables.get(which)
    if have is None or len(have[0]) < n:
        n = max(1 << 12, 1 << (n - 1).bit_length())
        b = MULTIPLIERS[which]
        both = []
        for x in (b, pow(b, -1, 1 << 64)):
            a = np.full(n, x, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _tables[which] = (both[0], both[1])
    return have


def prefix_sums(symbols: np.ndarray, which: int) -> np.ndarray:
    """From which span_hash takes the hash of any span of the symbols (uint64)."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _powers(len(symbols) + 1, which)[1][: len(symbols)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of symbols[start:end]: of equal spans equal, wherever they stand."""
    with np.errstate(over="ignore"):
        return (sums[end] - sums[start]) * _powers(len(sums), which)[0][start]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbours."""
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def window_keys(symbols: np.ndarray, window: int) -> np.ndarray:
    """The key of the window that starts at each symbol; empty for fewer symbols than a window has."""
    if len(symbols) < window:
        return np.zeros(0, np.uint64)
    gram = window // 2
    parts = []
    for at in range(0, len(symbols) - window + 1, SEGMENT):
        s = symbols[at : at + SEGMENT + window - 1]
        sums = prefix_sums(s, 0)
        starts = np.arange(len(s) - gram + 1)
        parts.append(sliding_min(mixed(span_hash(sums, starts, starts + gram, 0)), window - gram + 1))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def key_runs(keys: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys, none longer than longest."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
    ends = np.append(cuts[1:], len(keys))
    if longest is not None and (ends - cuts > longest).any():
        cuts = np.concatenate([np.arange(a, b, longest) for a, b in zip(cuts, ends)])
        ends = np.append(cuts[1:], len(keys))
    return cuts, ends - cuts


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols lie in a window that starts at starts .. starts + counts - 1."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + window, -1)
    return np.cumsum(edge[:n]) > 0
