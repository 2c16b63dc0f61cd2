"""A gated recurrent network in numpy with a class-factored softmax, trained by truncated backpropagation.

Arrays hold features first and documents or streams last, so that every numpy call works on long contiguous
rows. The hidden state carries a row of ones, so that biases are columns of the matrices. Gates are
1 / (1 + exp(a)), which is a sigmoid of weights of the other sign.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Sizes of the network: embedding, hidden state, classes of words.
EMBEDDING, HIDDEN, CLASSES = 16, 24, 90
#: Parallel streams, steps of a window, Adagrad's rate.
STREAMS, WINDOW, RATE = 512, 16, 0.2
#: What Adagrad's sums of squares start from.
SQUARES = 1e-8
#: Documents scored abreast, states whose targets are scored at once.
ABREAST, STATES = 1024, 8192


class Vocabulary:
    """Model words by falling count; id 0 is the end, id 1 any word beyond, then the words."""

    def __init__(self, counts: np.ndarray, ends: int, beyond: int, classes: int = CLASSES):
        self.counts = np.concatenate([[ends, beyond], counts]).astype(np.float64) + 1
        n = len(self.counts)
        # End and the words beyond are classes of their own; the rest is cut at equal shares of the root counts.
        mass = np.cumsum(np.sqrt(self.counts[2:]))
        classes = min(classes, max(1, n - 2))
        cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 3 if n > 2 else np.zeros(0, np.int64)
        self.starts = np.unique(np.concatenate([[0, 1, 2], cuts, [n]]).clip(max=n)).astype(np.int64)
        self.class_of = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)).astype(np.int16)
        self.alone = np.diff(self.starts) == 1


def _bounded(weights: np.ndarray) -> bool:
    """No logit can overflow: logits are products of weights and of states within -1 and 1."""
    return float(np.abs(weights).sum(1).max()) < 80


def _softmax(a: np.ndarray, bounded: bool, axis: int) -> None:
    """In place."""
    if not bounded:
        a -= a.max(axis, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis, keepdims=True)


def _log_sums(logits: np.ndarray, bounded: bool) -> np.ndarray:
    """Log of the sums of exponentials by column; logits are overwritten."""
    if bounded:
        return np.log(np.exp(logits, out=logits).sum(0))
    top = logits.max(0)
    logits -= top
    return np.log(np.exp(logits, out=logits).sum(0)) + top


class Gru:
    NAMES = ("e", "wx", "wh", "wc", "wo")

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        self.v = vocabulary
        self.bounded = False, False  # whether logits of classes, of words, can't overflow
        n, c = len(vocabulary.counts), len(vocabulary.starts) - 1
        self.shapes = {"e": (n, EMBEDDING), "wx": (3 * HIDDEN, EMBEDDING), "wh": (3 * HIDDEN, HIDDEN + 1), "wc": (c, HIDDEN + 1), "wo": (n, HIDDEN + 1)}
        if flat is None:
            rng = np.random.default_rng(0)
            for k, shape in self.shapes.items():
                setattr(self, k, (rng.standard_normal(shape) * {"e": 0.3, "wx": 0.3, "wh": 0.2, "wc": 0.1, "wo": 0.05}[k]).astype(np.float32))
            # Biases start at the counts, so the untrained model is near the unigram model.
            by_class = np.add.reduceat(vocabulary.counts, vocabulary.starts[:-1])
            self.wh[:, -1] = 0
            self.wc[:, -1] = np.log(by_class / by_class.sum())
            self.wo[:, -1] = np.log(vocabulary.counts / by_class[vocabulary.class_of])
        else:
            at = 0
            for k, shape in self.shapes.items():
                size = math.prod(shape)
                setattr(self, k, flat[at : at + size].reshape(shape).astype(np.float32))
                at += size

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def by_class(self, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """(places of the targets that share a class, by class; (first word, end, first place, end) of each class)."""
        cls = self.v.class_of[targets]
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(len(self.v.starts)))
        parts, picked, at = [], [], 0
        for c in np.flatnonzero((edges[1:] > edges[:-1]) & ~self.v.alone).tolist():
            a, b = int(edges[c]), int(edges[c + 1])
            picked.append(order[a:b])
            parts.append((int(self.v.starts[c]), int(self.v.starts[c + 1]), at, at + b - a))
            at += b - a
        return (np.concatenate(picked) if picked else order[:0]), parts

    # Scoring

    def step(self, ids: np.ndarray, h: np.ndarray) -> None:
        """Reads one id of each document; h (HIDDEN + 1 rows, the last of ones) becomes the next state."""
        a = self.wx @ self.e.take(ids, axis=0).T
        u = self.wh @ h
        rz = u[: 2 * HIDDEN]
        rz += a[: 2 * HIDDEN]
        np.exp(rz, out=rz)  # an overflow is a closed gate
        rz += 1
        np.reciprocal(rz, out=rz)
        n = u[2 * HIDDEN :]
        n *= rz[:HIDDEN]
        n += a[2 * HIDDEN :]
        np.tanh(n, out=n)
        own = h[:HIDDEN]
        own -= n
        own *= rz[HIDDEN:]
        own += n

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logs, class and word, of the targets given states (HIDDEN + 1, n)."""
        n = len(targets)
        logits = self.wc @ h
        out = logits.reshape(-1).take(self.v.class_of.take(targets).astype(np.int64) * n + np.arange(n)).astype(np.float64)
        out -= _log_sums(logits, self.bounded[0])
        order, parts = self.by_class(targets)
        states = np.ascontiguousarray(h.T).take(order, axis=0)
        words = targets.take(order).astype(np.int64)
        got = np.empty(len(order), np.float32)
        places = np.arange(len(order))
        for s, e, a, b in parts:
            logits = self.wo[s:e] @ states[a:b].T
            got[a:b] = logits.reshape(-1).take((words[a:b] - s) * (b - a) + places[: b - a])
            got[a:b] -= _log_sums(logits, self.bounded[1])
        out[order] += got
        return out

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 probability of documents of these lengths (1 at least), one behind another; state is carried from start to end."""
        out = np.zeros(len(lengths))
        self.bounded = _bounded(self.wc), _bounded(self.wo)
        order = np.argsort(-lengths, kind="stable")
        offsets = np.cumsum(lengths) - lengths
        with np.errstate(over="ignore"):
            for at in range(0, len(order), ABREAST):
                own = order[at : at + ABREAST]
                out[own] = self._score(ids, offsets[own], lengths[own])
        return out / math.log(10)

    def _score(self, ids: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Documents abreast, by falling length."""
        total = np.zeros(len(sizes))
        h = np.zeros((HIDDEN + 1, len(sizes)), np.float32)
        h[-1] = 1
        last = np.zeros(len(sizes), ids.dtype)  # the end id stands before a document
        states = np.empty((HIDDEN + 1, STATES + len(sizes)), np.float32)
        targets, owners, filled = [], [], 0
        longest = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(longest)).tolist()
        for t, n in enumerate(active):
            if n < h.shape[1]:
                h, offsets = np.ascontiguousarray(h[:, :n]), offsets[:n]
            self.step(last[:n], h)
            last = ids.take(offsets + t)
            states[:, filled : filled + n] = h
            filled += n
            targets.append(last)
            owners.append(n)
            if filled >= STATES or t + 1 == longest:
                got = self.log_probabilities(states[:, :filled], np.concatenate(targets))
                at = 0
                for k in owners:
                    total[:k] += got[at : at + k]
                    at += k
                targets, owners, filled = [], [], 0
        return total

    # Training

    def train(self, ids: np.ndarray) -> None:
        """Truncated backpropagation over a string of documents, cut into parallel streams."""
        n = len(ids) - 1
        sums = {k: np.full(self.shapes[k], SQUARES, np.float32) for k in self.NAMES}
        streams = max(1, min(STREAMS, n // (4 * WINDOW)))
        width = n // streams
        x, y = ids[: streams * width].reshape(streams, width).T, ids[1 : streams * width + 1].reshape(streams, width).T
        h = np.zeros((HIDDEN, streams), np.float32)
        with np.errstate(over="ignore"):
            for at in range(0, width, WINDOW):
                h = self._window(np.ascontiguousarray(x[at : at + WINDOW]), np.ascontiguousarray(y[at : at + WINDOW]), h, sums, streams)
            # What the streams' equal widths leave over goes on from the last stream.
            h = np.ascontiguousarray(h[:, -1:])
            for at in range(streams * width, n, WINDOW):
                end = min(at + WINDOW, n)
                h = self._window(ids[at:end, None], ids[at + 1 : end + 1, None], h, sums, streams)

    def _window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, sums: dict[str, np.ndarray], streams: int) -> np.ndarray:
        steps, width = x.shape
        H, n = HIDDEN, x.size
        words = x.ravel()
        inputs = self.e.take(words, axis=0).reshape(steps, width, EMBEDDING)
        a = np.matmul(self.wx, inputs.transpose(0, 2, 1))
        keep = (x != 0).astype(np.float32)  # after an end a new document starts
        before, after = np.empty((steps, H + 1, width), np.float32), np.empty((steps, H + 1, width), np.float32)
        before[:, H] = after[:, H] = 1
        gates, pre = np.empty((steps, 3 * H, width), np.float32), np.empty((steps, H, width), np.float32)
        for t in range(steps):
            own = np.multiply(h, keep[t], out=before[t, :H])
            g = np.matmul(self.wh, before[t], out=gates[t])
            pre[t] = c = g[2 * H :]
            rz = g[: 2 * H]
            rz += a[t, : 2 * H]
            np.exp(rz, out=rz)  # an overflow is a closed gate
            rz += 1
            np.reciprocal(rz, out=rz)
            c *= rz[:H]
            c += a[t, 2 * H :]
            np.tanh(c, out=c)
            h = np.subtract(own, c, out=after[t, :H])
            h *= rz[H:]
            h += c

        # Class of each target; gradients are sums over the window, their scale comes with the step.
        targets = y.ravel()
        p = np.matmul(self.wc, after)
        _softmax(p, _bounded(self.wc), 1)
        step_of, place = np.divmod(np.arange(n), width)
        p.reshape(-1)[(step_of * len(self.wc) + self.v.class_of.take(targets)) * width + place] -= 1
        scale = np.float32(1 / (streams * WINDOW))
        dh = np.matmul(np.ascontiguousarray(self.wc[:, :H].T), p)
        self._learn("wc", ..., np.matmul(p, after.transpose(0, 2, 1)).sum(0) * scale, sums)
        order, parts = self.by_class(targets)
        if len(order):
            states = np.ascontiguousarray(after.transpose(0, 2, 1)).reshape(n, H + 1).take(order, axis=0)
            ids = targets.take(order).astype(np.int64)
            back, grad = np.empty((len(order), H + 1), np.float32), np.zeros_like(self.wo)
            bounded, places = _bounded(self.wo), np.arange(len(order))
            for s, e, i, j in parts:
                part, own = states[i:j], self.wo[s:e]
                q = own @ part.T
                _softmax(q, bounded, 0)
                q.reshape(-1)[(ids[i:j] - s) * (j - i) + places[: j - i]] -= 1
                np.matmul(q.T, own, out=back[i:j])
                np.matmul(q, part, out=grad[s:e])
            grad *= scale
            self._learn("wo", ..., grad, sums)
            spread = np.zeros((n, H), np.float32)
            spread[order] = back[:, :H]
            dh += spread.reshape(steps, width, H).transpose(0, 2, 1)

        # Back through the steps.
        da, du = np.empty((steps, 3 * H, width), np.float32), np.empty((steps, 3 * H, width), np.float32)
        recurrent = np.ascontiguousarray(self.wh[:, :H].T)
        back = np.zeros((H, width), np.float32)
        for t in range(steps - 1, -1, -1):
            d = dh[t]
            d += back
            g = gates[t]
            r, z, c = g[:H], g[H : 2 * H], g[2 * H :]
            dc = np.multiply(z, d, out=da[t, 2 * H :])
            np.subtract(d, dc, out=dc)
            slope = c * c
            slope *= dc
            dc -= slope
            dz = np.subtract(c, before[t, :H], out=da[t, H : 2 * H])  # gates fall as their inputs rise
            dz *= d
            np.multiply(dc, pre[t], out=da[t, :H])
            np.negative(da[t, :H], out=da[t, :H])
            rest = 1 - g[: 2 * H]
            rest *= g[: 2 * H]
            np.multiply(da[t, : 2 * H], rest, out=du[t, : 2 * H])
            da[t, : 2 * H] = du[t, : 2 * H]
            np.multiply(dc, r, out=du[t, 2 * H :])
            back = recurrent @ du[t]
            d *= z
            back += d
            back *= keep[t]
        self._learn("wx", ..., np.clip(np.matmul(da, inputs).sum(0) * scale, -1, 1), sums)
        self._learn("wh", ..., np.clip(np.matmul(du, before.transpose(0, 2, 1)).sum(0) * scale, -1, 1), sums)
        de = np.matmul(np.ascontiguousarray(self.wx.T), da).transpose(1, 0, 2).reshape(EMBEDDING, n)
        at = words.astype(np.int64)
        self._learn("e", ..., np.stack([np.bincount(at, d, len(self.e)) for d in de], 1).astype(np.float32) * scale, sums)
        return h

    def _learn(self, name: str, where, grad: np.ndarray, sums: dict[str, np.ndarray]) -> None:
        s = sums[name][where]
        s += grad * grad
        getattr(self, name)[where] -= np.float32(RATE) * grad / np.sqrt(s)

