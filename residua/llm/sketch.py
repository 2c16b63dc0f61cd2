"""Count-min sketches of keys, merged over partitions.

Partitions send the cells they touch, sorted, each twice at most; every shard of cells is added up by one task,
saturating at two. What is left is one bit a cell: reached twice or more. A key that occurs twice finds all its
bits set; a key that occurs once finds them set only if every cell is shared. All cells of a key lie in one shard. So
a sketch of any size serves: a small one goes to every task, of a larger one each shard meets the keys that belong to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DEPTH, SHARD_BITS = 2, 20
#: log2 of the cells of a row, at least, and of the largest sketch that is broadcast: DEPTH * 2^(28 - 3) bytes, 64 MB.
LEAST_BITS, MOST_BITS = 16, 28
#: A shard of more than so many times the mean keys is dealt to several tasks.
UNEVEN = 4


def sketch_bits(keys: float, spare: int = 8) -> int:
    """log2 of the cells of a row for so many keys; it may exceed MOST_BITS."""
    return int(max(LEAST_BITS, np.ceil(np.log2(max(1.0, spare * keys)))))


def cells(keys: np.ndarray, row: int, bits: int, inside: int) -> np.ndarray:
    """A row's cell of each key: the shard by the key's hash, in it one of 2^inside by the row. Keys may be small hashes only."""
    spread = keys * np.uint64(0x9E3779B97F4A7C15)
    first = spread >> np.uint64(64 - bits)
    if row == 0:
        return first
    other = ((spread ^ (spread >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - inside)
    return (first >> np.uint64(inside) << np.uint64(inside)) | other


def packed(a: np.ndarray) -> bytes:
    """Sorted uint32 as differences in byte planes, of which the shuffle's compression leaves about one."""
    return np.ascontiguousarray(np.diff(a, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


class Sketch:
    """The merged bits; ``twice`` tells which keys may have been counted twice."""

    def __init__(self, bits: int, inside: int, rows: list[bytes]):
        self.bits, self.inside, self.rows = bits, inside, [np.frombuffer(r, np.uint8) for r in rows]

    def __reduce__(self):
        return Sketch, (self.bits, self.inside, [r.tobytes() for r in self.rows])

    def twice(self, keys: np.ndarray) -> np.ndarray:
        """Also of one shard of a sketch, for the keys that belong to it."""
        out, place = np.ones(len(keys), bool), np.uint64(8 * len(self.rows[0]) - 1)
        for row, bitmap in enumerate(self.rows):
            c = cells(keys, row, self.bits, self.inside) & place
            out &= (bitmap[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def merged_shards(texts: DataFrame, keys_of: Callable[[bytes], np.ndarray], bits: int) -> DataFrame:
    """(shard, row0, row1 binary): the sketch's bits. texts has one binary column ``text``; keys_of gives the keys that a
    text counts, each as often as it counts.

    A batch sends at most two counts a cell, so a key that fills a batch is no larger message than any other.
    """
    inside = min(bits, SHARD_BITS)
    width = 1 << inside

    def touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(found: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            keys = np.concatenate(found)
            for row in range(DEPTH):
                c = np.sort(cells(keys, row, bits, inside))
                c = c[np.concatenate([np.ones(min(2, len(c)), bool), c[2:] != c[:-2]])]  # at most two of a cell
                shard = (c // np.uint64(width)).astype(np.int64)
                starts = np.flatnonzero(np.diff(shard, prepend=-1))
                places = (c & np.uint64(width - 1)).astype(np.uint32)
                yield pd.DataFrame({"shard": shard[starts], "row": row, "cells": [packed(x) for x in np.split(places, starts[1:])]})

        found, n = [], 0
        for pdf in batches:
            for text in pdf["text"]:
                k = keys_of(text)
                if len(k):
                    found.append(k)
                    n += len(k)
                if n > 1 << 21:
                    yield from flush(found)
                    found, n = [], 0
        if found:
            yield from flush(found)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, have = None, None

        def out() -> pd.DataFrame:
            return pd.DataFrame({"shard": [now], **{f"row{k}": [np.packbits(x >= 2, bitorder="little").tobytes()] for k, x in enumerate(have)}})

        for pdf in batches:
            for shard, row, data in zip(pdf["shard"], pdf["row"], pdf["cells"]):
                if shard != now:
                    if now is not None:
                        yield out()
                    now, have = shard, np.zeros((DEPTH, width), np.uint8)
                c = unpacked(data)
                first = np.concatenate([[True], c[1:] != c[:-1]])
                own = have[row]
                own[c[first]] = np.minimum(own[c[first]] + 1, 2)
                own[c[~first]] = 2
        if now is not None:
            yield out()

    sent = texts.select("text").mapInPandas(touch, "shard long, row int, cells binary")
    return sent.repartition(F.col("shard")).sortWithinPartitions("shard").mapInPandas(add, "shard long, row0 binary, row1 binary")


def build_sketch(texts: DataFrame, keys_of: Callable[[bytes], np.ndarray], bits: int) -> Sketch:
    """The whole sketch on the driver, for a broadcast."""
    width = 1 << min(bits, SHARD_BITS)
    rows = [bytearray(1 << (bits - 3)) for _ in range(DEPTH)]
    for r in merged_shards(texts, keys_of, bits).toLocalIterator():  # DEPTH * 2^bits bits in all
        for k in range(DEPTH):
            rows[k][r.shard * width // 8 : (r.shard + 1) * width // 8] = r[f"row{k}"]
    return Sketch(bits, min(bits, SHARD_BITS), [bytes(r) for r in rows])


def estimated_twice(pairs: DataFrame, shards: DataFrame, bits: int) -> DataFrame:
    """(id string, key, shard) to (id, key) of those whose key the sketch estimates at two or more: keys go to the task that has their shard.

    Of a shard with far more keys than others (a key of very many documents is in it) each of several tasks has a copy.
    """
    inside = min(bits, SHARD_BITS)
    sizes = pairs.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    mean = sizes.agg(F.avg("n")).first()[0] or 1.0
    # A quarter of the shards at most.
    hot = F.broadcast(sizes.filter(F.col("n") > UNEVEN * mean).select("shard", F.ceil(F.col("n") / mean).cast("long").alias("copies")))
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    keys = pairs.join(hot, "shard", "left").select("shard", F.pmod(F.xxhash64("id"), copies).alias("copy"), F.lit(1).alias("kind"), "id", "key", F.lit(None).cast("binary").alias("row0"), F.lit(None).cast("binary").alias("row1"))
    tables = shards.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(0).cast("long").alias("key"), "row0", "row1")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = None
        for pdf in batches:
            kinds = pdf["kind"].to_numpy()
            cuts = np.unique(np.concatenate([np.flatnonzero(kinds == 0), [0, len(pdf)]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = pdf.iloc[a:b]
                if kinds[a] == 0:
                    sketch = Sketch(bits, inside, [part["row0"].iloc[0], part["row1"].iloc[0]])
                    part = part.iloc[1:]
                if len(part):
                    yield part[["id", "key"]][sketch.twice(part["key"].to_numpy(np.int64).view(np.uint64))]

    both = tables.unionByName(keys).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return both.mapInPandas(test, "id string, key long")


class Prefilter:
    """Tells which keys of a document may be repeated: by the sketch, or by the keys that came with the document."""

    def __init__(self, sketch=None):
        self.sketch = sketch

    def of(self, shared: np.ndarray | None) -> Callable[[np.ndarray], np.ndarray]:
        if self.sketch is not None:
            return self.sketch.value.twice
        own = np.zeros(0, np.uint64) if shared is None else np.asarray(shared, np.int64).view(np.uint64)
        return lambda keys: np.isin(keys, own)


def prefilter(base: DataFrame, keys_of: Callable[[bytes], np.ndarray], keys: float, scratch: Scratch) -> tuple[DataFrame, Prefilter]:
    """(id, text) to the same with a column ``shared`` for the Prefilter.

    The sketch grows with the keys (``keys`` is about their number). Up to MOST_BITS it goes to every task. A larger one
    stays a table of shards in the shared folder: the keys go to it, some sixteen bytes each, and each document gets back those
    of its own that are estimated at two or more. Both ways ask the same bits.
    """
    bits = sketch_bits(keys)
    if bits <= MOST_BITS:
        made = build_sketch(base, keys_of, bits)
        return base.withColumn("shared", F.lit(None).cast("array<long>")), Prefilter(base.sparkSession.sparkContext.broadcast(made))
    kind, inside = base.schema["id"].dataType, min(bits, SHARD_BITS)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.unique(keys_of(text)) for text in pdf["text"]]
            own = pdf["id"].take(np.repeat(np.arange(len(found)), list(map(len, found))))
            if len(own):
                keys = np.concatenate(found)
                yield pd.DataFrame({"id": own.reset_index(drop=True), "key": keys.view(np.int64), "shard": (cells(keys, 0, bits, inside) >> np.uint64(inside)).astype(np.int64)})

    shards = scratch.table(merged_shards(base, keys_of, bits))
    pairs = scratch.table(base.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(emit, "id string, key long, shard long"))
    own = estimated_twice(pairs, shards, bits).groupBy(F.col("id").cast(kind).alias("own_id")).agg(F.collect_set("key").alias("shared"))
    return base.join(own, F.col("id").eqNullSafe(F.col("own_id")), "left").drop("own_id"), Prefilter()
