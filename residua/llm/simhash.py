"""SimHash near-duplicates: 64-bit fingerprints, linked by an exact tiled comparison.

Distinct fingerprints are dealt by range of their population counts (of the eight bytes, the first byte
leading) into blocks, blocks into tiles. Two fingerprints within the radius have byte population counts
whose differences add up to the radius at most. So a pair of blocks, and in it a pair of tiles, is skipped
when the boxes around their population counts are farther apart. All other pairs of tiles are compared
whole with exclusive-or and bit counts. Each pair of blocks returns a spanning forest of its links, so
a group of copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Scratch, text_of

SEED = 42
#: Rows of a block on average, rows of a tile. A block's box of sixteen bytes goes to every task.
BLOCK_ROWS, TILE = 1 << 16, 256
#: Cells of one exclusive-or.
CELLS = 1 << 20


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a text in UTF-8: A-Z lower-cased, split at ASCII white space; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else iter((b" ".join(words),))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED, min(1 << 15, n - at))), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def byte_counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the eight bytes."""
    return np.bitwise_count(fps.view(np.uint8)).reshape(-1, 8)


def labels_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of fingerprints, of the pairs within the radius: of a with b, or in a alone.

    Both come in the order of their byte counts, so that tiles have narrow boxes.
    """
    both = a if b is None else np.concatenate([a, b])
    first = 0 if b is None else len(a)
    other = both[first:]
    starts = np.arange(0, len(other), TILE)
    pops = byte_counts(other).astype(np.int16)
    low, high = np.minimum.reduceat(pops, starts), np.maximum.reduceat(pops, starts)
    found_u, found_v = [], []
    for at in range(0, len(a), TILE):
        tile = a[at : at + TILE]
        p = byte_counts(tile).astype(np.int16)
        gap = np.maximum(0, np.maximum(p.min(0) - high, low - p.max(0))).sum(1)
        near = starts[(gap <= radius) & ((starts >= at) if b is None else True)]
        if not len(near):
            continue
        cols = (near[:, None] + np.arange(TILE)).ravel()
        cols = cols[cols < len(other)]
        step = max(1, CELLS // len(tile))
        for k in range(0, len(cols), step):
            c = cols[k : k + step]
            i, j = np.nonzero(np.bitwise_count(tile[:, None] ^ other[c][None, :]) <= radius)
            u, v = i + at, c[j] + first
            if b is None:
                u, v = u[u < v], v[u < v]
            if len(u):
                nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
                label = labels_of(len(nodes), ends[: len(u)], ends[len(u) :])
                found_u.append(nodes[label != np.arange(len(nodes))])
                found_v.append(nodes[label[label != np.arange(len(nodes))]])
    if not found_u:
        return both[:0], both[:0]
    nodes, ends = np.unique(np.concatenate(found_u + found_v), return_inverse=True)
    label = labels_of(len(nodes), ends[: len(ends) // 2], ends[len(ends) // 2 :])
    own = label != np.arange(len(nodes))
    return both[nodes[own]], both[nodes[label[own]]]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp) of every row."""

    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([simhash(x, shingle) for x in s], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(udf, "long")(text_of(text_col).cast("binary")).alias("fp"))


def fingerprint_links(fps: DataFrame, n: int, radius: int, scratch: Scratch) -> DataFrame:
    """Distinct fingerprints (fp), n of them, to links (u, v) that connect what lies within the radius."""
    key = F.concat(*(F.hex(F.bit_count(F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)))) for k in range(8)))
    ranged = fps.withColumn("key", key).repartitionByRange(max(1, -(-n // BLOCK_ROWS)), "key", "fp").sortWithinPartitions("key", "fp")

    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [x["fp"].to_numpy(np.int64) for x in rows]
        if parts and len(all_fps := np.concatenate(parts).view(np.uint64)):
            pops = byte_counts(all_fps)
            yield pd.DataFrame({"block": [TaskContext.get().partitionId()], "low": [pops.min(0).tobytes()], "high": [pops.max(0).tobytes()], "fps": [all_fps.tobytes()]})

    blocks = scratch.table(ranged.select("fp").mapInPandas(pack, "block long, low binary, high binary, fps binary"))
    boxes = sorted(blocks.select("block", "low", "high").collect())  # a row a block
    names = np.array([x.block for x in boxes], np.int64)
    low, high = (np.array([list(x[k]) for x in boxes], np.int16).reshape(-1, 8) for k in ("low", "high"))

    def emit(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for block, fps in zip(pdf["block"], pdf["fps"]):
                at = int(np.searchsorted(names, block))
                gap = np.maximum(0, np.maximum(low[at] - high, low - high[at])).sum(1)
                for k in np.nonzero(gap <= radius)[0].tolist():
                    yield pd.DataFrame({"a": [min(at, k)], "b": [max(at, k)], "fps": [fps]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [np.frombuffer(x, np.uint64) for x in pdf["fps"]]
        u, v = links(sides[0], sides[1] if len(sides) > 1 else None, radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return blocks.select("block", "fps").mapInPandas(emit, "a int, b int, fps binary").groupBy("a", "b").applyInPandas(compare, "u long, v long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id of its component).

    Two documents are linked when their fingerprints differ in ``radius`` bits at most; components are what
    links connect. Null and empty texts have no words and the fingerprint zero, which is linked like
    any other. Repeated rows have equal fingerprints. A null id is never a component_id unless its component has no
    other id. An empty table gives an empty table; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.table(fingerprints(docs, id_col, text_col, shingle))
    distinct = scratch.table(fps.groupBy("fp").agg(F.min("id").alias("first")))
    linked = fingerprint_links(distinct.select("fp"), distinct.count(), radius, scratch)
    roots = connected_components(linked, scratch)
    rooted = scratch.table(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = scratch.table(rooted.hint("merge").join(least, "root").select("fp", "component_id"))
    out = fps.hint("merge").join(by_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
