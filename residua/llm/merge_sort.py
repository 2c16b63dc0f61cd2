"""Merging of front-coded sorted runs of byte strings with a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each string with the one before; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    for at in range(1, len(strings), 4096):
        part = strings[at - 1 : at + 4096]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        width = int(sizes.max()) + 1
        # Zero bytes at the end look like padding, so the shorter length bounds the prefix.
        a = np.array(part, dtype=f"S{width}").view(np.uint8).reshape(len(part), width)
        differ = a[1:] != a[:-1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        out[at : at + len(first)] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(prefix lengths, rest lengths, rests) of sorted strings."""
    lcp = common_prefixes(strings)
    rests = [s[k:] for s, k in zip(strings, lcp.tolist())]
    return lcp, np.fromiter(map(len, rests), np.int64, len(rests)), b"".join(rests)


def front_decoded(lcp: np.ndarray, sizes: np.ndarray, rests: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(lcp.tolist(), sizes.tolist()):
        last = last[:k] + rests[at : at + n]
        at += n
        out.append(last)
    return out


def extend(a: bytes, b: bytes, k: int) -> int:
    """The common prefix's length, from k known bytes on."""
    n = min(len(a), len(b))
    while k + 16 <= n and a[k : k + 16] == b[k : k + 16]:
        k += 16
    while k < n and a[k] == b[k]:
        k += 1
    return k


def merge(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Runs of (common prefix with the string before in the run, string, payload), in order, to one such run.

    Every loser in the tree keeps its common prefix with the last winner that passed it. Where two prefixes
    differ, the longer one wins without a look at the strings; where they agree, comparison starts behind them.
    """
    k = len(runs)
    size = 1
    while size < max(1, k):
        size *= 2
    done = (-1, None, None)
    heads = [next(r, done) for r in runs] + [done] * (size - k)
    heads = [(0 if h[1] is not None else -1, h[1], h[2]) for h in heads]

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one with the winner."""
        (hx, sx, px), (hy, sy, py) = heads[x], heads[y]
        if hx > hy:
            return x, y
        if hx < hy:
            return y, x
        if sx is None:
            return x, y
        h = extend(sx, sy, hx)
        if h == len(sx) or (h < len(sy) and sx[h] < sy[h]):
            heads[y] = (h, sy, py)
            return x, y
        heads[x] = (h, sx, px)
        return y, x

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if size > 1 else 0
    while heads[best][1] is not None:
        yield heads[best]
        heads[best] = next(runs[best], done)
        node = (best + size) // 2
        while node:
            rival = losers[node]
            a, b = heads[best][0], heads[rival][0]
            if a < b:
                losers[node], best = best, rival
            elif a == b:
                best, losers[node] = play(best, rival)
            node //= 2
