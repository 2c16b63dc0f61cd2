"""Vector codes: product quantisation of integer components, its codebooks learnt by Lloyd's rounds with Elkan's bounds.

A vector is cut into equal parts, and each part position has a codebook of entries. After an assignment every row keeps, for
each part, its entry, an upper bound of the distance to it and a lower bound of the distance to every entry. When entries
move, bounds are shifted by how far they moved, and an entry is measured only where the triangle inequality can't exclude it: not
if its lower bound, or half its distance from the row's own entry, is strictly above the upper bound. What is
measured is measured in whole numbers, so equal distances are seen as equal and go to the lower index.

Rows with their bounds are a written table between rounds. Entries move to means that are summed within a task first; the
codebooks, parts x entries x width numbers, are all that goes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_text, unused

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows measured at once.
ROWS = 1024
#: Lower bounds are kept as multiples, 0 to 15, of a quarter of the upper bound, two to a byte.
STEPS, MOST = 4.0, 15
#: Bounds are floats; this relative slack covers their rounding.
SLACK = 1e-6


def whole_parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(rows, width) floats to (parts, rows, part width) numbers floor(256 x)."""
    whole = np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)
    return np.ascontiguousarray(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2))


def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of (rows, width) to (entries, width) in whole numbers."""
    out = np.zeros((len(rows), len(entries)), np.int64)
    for k in range(rows.shape[1]):
        d = rows[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def first_assignment(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, upper bound, lower bounds) of one part's rows, all distances measured."""
    d2 = squared(rows, entries)
    own = d2.argmin(1)  # the first of equal ones
    least = d2[np.arange(len(rows)), own]
    d = np.sqrt(d2.astype(np.float64))
    return own, least, np.sqrt(least.astype(np.float64)) * (1 + SLACK), d * (1 - SLACK)


def next_assignment(rows: np.ndarray, entries: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """As first_assignment, of bounds that held before the entries moved by these distances; last, how many distances were measured."""
    upper = (upper + moved[own]) * (1 + SLACK)
    lower = np.maximum(lower - moved[None, :] * (1 + SLACK), 0.0)
    half = np.sqrt(squared(entries, entries).astype(np.float64)) * (0.5 * (1 - SLACK))
    at = np.arange(len(rows))

    def open_to(u: np.ndarray) -> np.ndarray:
        near = ~((lower > u[:, None]) | (half[own] > u[:, None]))
        near[at, own] = False
        return near

    # What the shifted bounds leave open is looked at again with the own distance as it is now.
    diff = rows - entries[own]
    least = (diff * diff).sum(1)
    exact = np.sqrt(least.astype(np.float64)) * (1 + SLACK)
    upper = np.minimum(upper, exact)
    i, j = np.nonzero(open_to(upper))
    d = rows[i] - entries[j]
    d2 = (d * d).sum(1)
    lower[i, j] = np.sqrt(d2.astype(np.float64)) * (1 - SLACK)
    lower[at, own] = exact / (1 + SLACK) * (1 - SLACK)
    if len(i):
        # The least of a row's measured entries, then the lowest index: pairs come in the order of rows and indices.
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        best = np.minimum.reduceat(d2, starts)
        first = np.minimum.reduceat(np.where(d2 == np.repeat(best, np.diff(np.r_[starts, len(i)])), j, len(entries)), starts)
        r = i[starts]
        wins = (best < least[r]) | ((best == least[r]) & (first < own[r]))
        own = own.copy()
        own[r[wins]], least[r[wins]] = first[wins], best[wins]
        upper[r[wins]] = np.sqrt(best[wins].astype(np.float64)) * (1 + SLACK)
    return own, least, upper, lower, len(i)


def pack_bounds(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds as float32 rounded up and lower bounds as half bytes rounded down."""
    up = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
    unit = np.where(up > 0, up, 1).astype(np.float64)[:, None] / STEPS
    steps = np.minimum(np.floor(lower / unit), MOST).astype(np.uint8)
    if steps.shape[1] % 2:
        steps = np.concatenate([steps, np.zeros((len(steps), 1), np.uint8)], 1)
    return up, steps[:, 0::2] | steps[:, 1::2] << 4


def unpack_bounds(up: np.ndarray, packed: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds as they are kept: never below a true upper one nor above a true lower one."""
    unit = np.where(up > 0, up, 1).astype(np.float64)[:, None] / STEPS
    steps = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    steps[:, 0::2], steps[:, 1::2] = packed & 15, packed >> 4
    return up.astype(np.float64), steps[:, :entries] * unit


def _table(column: pd.Series, kind: type, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(rows, -1)


def _bytes(table: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(table)]


def _valid(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): rows whose vector is there and holds finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).filter(sound).select("id", "label", "v")


class Codebooks:
    """The entries (parts, entries, part width) and how far each moved in the last round."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.moved = np.zeros(entries.shape[:2])

    def move(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> None:
        """Entries with rows go to floor(sum / count), by component; others stay."""
        new = self.entries.copy()
        for (part, entry), (count, total) in sums.items():
            new[part, entry] = [x // count for x in total]
        d = (new - self.entries).astype(np.float64)
        self.moved = np.sqrt((d * d).sum(2)) * (1 + SLACK)
        self.entries = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row of vectors: id, label, ``code`` (bytes, one a part), ``error`` and ``codebooks_sha256``.

    Rows whose vector is null, empty or holds null or non-finite components are left out. All other vectors must have one length, a
    multiple of ``parts``, and components that leave squared distances within 63 bits (for parts of four numbers, below some three million); else
    the job ends with an error. Null ids come last where the smallest ids are wanted, and rows that repeat an id are ordered by
    their vectors. Fewer kept rows than ``entries`` give that many entries; an empty table gives an empty one. Equal
    vectors have equal codes. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    if rounds < 1:
        raise ValueError("at least one round is needed")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = _valid(vectors, id_col, vector_col, label_col)
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    first = rows.orderBy(F.col("id").isNull(), "id", "v").limit(entries).collect()  # as many rows as entries
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {id_kind}, `{label_col}` {label_kind}, code binary, error long, codebooks_sha256 string")
    width = len(first[0].v)
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    bound = int(((2**63 - 1) // (4 * (width // parts) * parts)) ** 0.5)
    count = len(first)

    def whole(column: pd.Series) -> np.ndarray:
        if any(len(v) != width for v in column):
            raise ValueError("vectors have different lengths")
        flat = np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, width))
        if np.abs(flat).max(initial=0) * SCALE + 1 > bound:
            raise ValueError("components are too large for exact distances")
        return whole_parts(flat, parts)

    books = Codebooks(whole(pd.Series([r.v for r in first])))
    state_kind = "id string, label string, whole binary, small boolean, code binary, upper binary, lower binary"

    def state(pdf: pd.DataFrame, w: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pd.DataFrame:
        small = np.abs(w).max(initial=0) < 1 << 15
        flat = w.transpose(1, 0, 2).reshape(len(pdf), width)
        return pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "whole": _bytes(flat.astype(np.int16 if small else np.int64)), "small": bool(small), "code": _bytes(own.T.astype(np.uint8)), "upper": _bytes(upper.T), "lower": _bytes(lower.transpose(1, 0, 2).reshape(len(pdf), -1))})

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                yield pdf.iloc[at : at + ROWS]

    def stored_whole(pdf: pd.DataFrame) -> np.ndarray:
        """The rows' numbers by part; a written batch may hold rows of both widths."""
        flat = np.empty((len(pdf), width), np.int64)
        small = pdf["small"].to_numpy(bool)
        for mask, kind in ((small, np.int16), (~small, np.int64)):
            if mask.any():
                flat[mask] = _table(pdf["whole"][mask], kind, int(mask.sum()))
        return np.ascontiguousarray(flat.reshape(len(pdf), parts, -1).transpose(1, 0, 2))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = begun
        for pdf in pieces(batches):
            w = whole(pdf["v"])
            own, upper, lower = [], [], []
            for p in range(parts):
                o, _, u, low = first_assignment(w[p], table.entries[p])
                u, low = pack_bounds(u, low)
                own, upper, lower = [*own, o], [*upper, u], [*lower, low]
            yield state(pdf, w, np.stack(own), np.stack(upper), np.stack(lower))

    def assigned(pdf: pd.DataFrame, table: Codebooks) -> tuple[np.ndarray, ...]:
        w = stored_whole(pdf)
        code, up = _table(pdf["code"], np.uint8, len(pdf)).T, _table(pdf["upper"], np.float32, len(pdf)).T
        low = _table(pdf["lower"], np.uint8, len(pdf)).reshape(len(pdf), parts, -1)
        own, least, upper, lower = [], [], [], []
        for p in range(parts):
            o, d2, u, lb, _ = next_assignment(w[p], table.entries[p], code[p].astype(np.int64), *unpack_bounds(up[p], low[:, p], count), table.moved[p])
            own, least, upper, lower = [*own, o], [*least, d2], [*upper, u], [*lower, lb]
        return w, np.stack(own), np.stack(least), upper, lower

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((parts, count), np.int64)
        total = np.zeros((parts, count, width // parts), np.int64)
        for pdf in pieces(batches):
            w, code = stored_whole(pdf), _table(pdf["code"], np.uint8, len(pdf)).T
            for p in range(parts):
                n[p] += np.bincount(code[p], minlength=count)
                np.add.at(total[p], code[p], w[p])
        p, e = np.nonzero(n)
        yield pd.DataFrame({"part": p, "entry": e, "n": n[p, e], **{f"s{k}": total[p, e, k] for k in range(width // parts)}})

    columns = [f"s{k}" for k in range(width // parts)]
    begun = Codebooks(books.entries.copy())
    now = scratch.table(as_text(as_text(rows), "label").mapInPandas(begin, state_kind))
    for number in range(rounds):
        each = now.select("whole", "small", "code").mapInPandas(sums, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in columns))
        wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns]
        met = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect()  # a row an entry
        books.move({(r.part, r.entry): (r.n, [int(r[c]) for c in columns]) for r in met})
        moved, last = Codebooks(books.entries.copy()), number == rounds - 1
        moved.moved = books.moved

        def again(batches: Iterator[pd.DataFrame], table: Codebooks = moved) -> Iterator[pd.DataFrame]:
            for pdf in pieces(batches):
                w, own, _, upper, lower = assigned(pdf, table)
                kept = [pack_bounds(u, low) for u, low in zip(upper, lower)]
                yield state(pdf, w, own, np.stack([k[0] for k in kept]), np.stack([k[1] for k in kept]))

        def end(batches: Iterator[pd.DataFrame], table: Codebooks = moved) -> Iterator[pd.DataFrame]:
            for pdf in pieces(batches):
                _, own, least, _, _ = assigned(pdf, table)
                yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "code": _bytes(own.T.astype(np.uint8)), "error": least.sum(0)})

        old = now
        if last:
            now = scratch.table(now.mapInPandas(end, "id string, label string, code binary, error long"))
        else:
            now = scratch.table(now.mapInPandas(again, state_kind))
        scratch.drop(old)
    return now.select(F.col("id").cast(id_kind).alias(id_col), F.col("label").cast(label_kind).alias(label_col), "code", "error", F.lit(books.sha256()).alias("codebooks_sha256"))


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """vector_codes' rows with ``label_error``: the errors summed over rows of the same label, null labels together."""
    of, total = unused(coded, "of", "total")
    sums = Scratch(coded.sparkSession).table(coded.groupBy(F.col(label_col).alias(of)).agg(F.sum("error").alias(total)))
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col(of))).withColumn("label_error", F.col(total)).drop(of, total)
