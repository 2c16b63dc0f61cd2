"""Near duplicates: candidates by 256-bit SimHash, verified by the Jaccard similarity of their five-word shingles.

Where the similarity is 0.8, shingle sets are at an angle that makes 38.8 of 256 bits differ on average; the
radius is 3.4 standard deviations above that. Of unrelated texts 128 bits differ, and two of them lie within the radius with a chance of
about 10^-18, so candidates don't grow together by chance at any number of documents (with 128 bits they would from some 10^7 on).
Fingerprints are compared where sets meet in a shingle of their prefixes: of n shingles the n - ceil(0.8 n) + 1 of smallest hash. Two sets of
similarity 0.8 have one of those in common, so no pair is lost. What meets in a frequent shingle is compared
block by block and tile by tile; tiles whose population counts differ by more than the radius are skipped. Links
connect candidates to components, and in a component the sets themselves decide: what a chain of pairs at or above the
similarity connects is one group. A component's sets are dealt to blocks of bounded size, and every two of its blocks
meet in a task, which returns a spanning forest of the links it has verified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.forest import mixed
from .common import Scratch, text_of
from .simhash import CELLS, TILE, labels_of

WORDS, SIMILARITY, RADIUS = 5, 0.8, 58
#: 64-bit numbers of a fingerprint.
PIECES = 4
PRINTS = [f"f{k}" for k in range(PIECES)]
#: Rows of a block on average, of those that have a shingle in common; up to FEW rows are paired by a join.
BLOCK_ROWS, FEW = 1 << 16, 32
#: Shingles on average of a block of a component's sets, eight bytes each; a task holds two blocks.
BLOCK_SHINGLES = 1 << 20


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """128-bit hashes, a row of two numbers each, of a text's distinct shingles; A-Z lower-cased, a shorter text is one shingle."""
    found = text.lower().split()
    if not found:
        return np.zeros((0, 2), np.uint64)
    pieces = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) > words else (b" ".join(found),)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.uint64).reshape(-1, 2)
    return h[np.unique(h[:, 0], return_index=True)[1]]


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: the majority of the bits of the shingles' hashes and of what these are mixed to."""
    counts = np.zeros(64 * PIECES, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        h = shingles[at : at + (1 << 14)]
        wide = np.ascontiguousarray(np.concatenate([h, mixed(h)], 1))
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.uint64)


def populations(fps: np.ndarray) -> np.ndarray:
    """Population counts of fingerprints, a row of numbers each."""
    return np.bitwise_count(fps).sum(1, dtype=np.int16)


def set_key(shingles: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return hashlib.sha256(shingles.tobytes()).digest()[:16]


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of row numbers, of the pairs within the radius: of a with b, which count on after a, or in a alone.

    Both come in the order of their population counts.
    """
    other, first = (a, 0) if b is None else (b, len(a))
    pops, step = populations(other), CELLS // TILE
    columns = [np.ascontiguousarray(c) for c in other.T]
    found_u, found_v = [], []
    for at in range(0, len(a), TILE):
        tile = a[at : at + TILE]
        own = populations(tile)
        for k in range(at if b is None else 0, len(other), step):
            if max(own[0] - pops[k : k + step][-1], pops[k] - own[-1]) > radius:
                continue
            # Eight bits a count: of exactly opposite fingerprints it wraps to nought, one more candidate to be verified.
            d = np.bitwise_count(tile[:, 0, None] ^ columns[0][None, k : k + step])
            for own_bits, bits in zip(tile.T[1:], columns[1:]):
                d += np.bitwise_count(own_bits[:, None] ^ bits[None, k : k + step])
            i, j = np.nonzero(d <= radius)
            u, v = i + at, j + k + first
            if b is None:
                u, v = u[u < v], v[u < v]
            if len(u):
                nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
                label = labels_of(len(nodes), ends[: len(u)], ends[len(u) :])
                moved = label != np.arange(len(nodes))
                found_u.append(nodes[moved])
                found_v.append(nodes[label[moved]])
    if not found_u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, ends = np.unique(np.concatenate(found_u + found_v), return_inverse=True)
    label = labels_of(len(nodes), ends[: len(ends) // 2], ends[len(ends) // 2 :])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets of n and more shingles with at least this Jaccard similarity, the so many smallest have one in common."""
    return n - math.ceil(similarity * n - 1e-6) + 1


def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, prefix) to a row (h, node) per shingle."""
    for pdf in batches:
        for at in range(0, len(pdf), 1024):
            part = pdf.iloc[at : at + 1024]
            found = [np.frombuffer(x, np.int64) for x in part["prefix"]]
            yield pd.DataFrame({"h": np.concatenate(found), "node": np.repeat(part["node"].to_numpy(np.int64), [len(x) for x in found])})


def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (h, node) in the order of h those whose h another row has. One row is carried from batch to batch."""
    h, node, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for pdf in batches:
        h, node = np.concatenate([h, pdf["h"].to_numpy(np.int64)]), np.concatenate([node, pdf["node"].to_numpy(np.int64)])
        if not len(h):
            continue
        keep, same = np.zeros(len(h), bool), h[1:] == h[:-1]
        keep[0] = kept
        keep[1:] |= same
        keep[:-1] |= same
        yield pd.DataFrame({"h": h[:-1][keep[:-1]], "node": node[:-1][keep[:-1]]})
        h, node, kept = h[-1:], node[-1:], keep[-1]
    if kept:
        yield pd.DataFrame({"h": h, "node": node})


def candidate_links(rows: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Rows (node, prefix, PRINTS) to links (u, v) that connect what has a shingle of its prefix in common and lies within the radius."""
    prints = [F.col(c) for c in PRINTS]
    single = rows.select("node", "prefix").mapInPandas(flat, "h long, node long")
    met = scratch.table(single.repartition("h").sortWithinPartitions("h").mapInPandas(repeated, "h long, node long"))
    many = met.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > FEW)
    # Both sides grow with the documents, so their join is a merge join at every size.
    tagged = scratch.table(met.hint("merge").join(rows.select("node", *PRINTS), "node").join(many, "h", "left"))

    few = tagged.filter("m is null").select("h", "node", *PRINTS)
    other = few.select("h", F.col("node").alias("v"), *(c.alias(f"v{k}") for k, c in enumerate(prints)))
    bits = sum((F.bit_count(c.bitwiseXOR(F.col(f"v{k}"))) for k, c in enumerate(prints)), F.lit(0))
    pairs = few.hint("merge").join(other, "h").filter((F.col("node") < F.col("v")) & (bits <= radius)).select(F.col("node").alias("u"), "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own, nodes = pdf["own"].to_numpy(), pdf["node"].to_numpy(np.int64)
        fps = np.ascontiguousarray(pdf[PRINTS].to_numpy(np.int64)).view(np.uint64)
        order = np.lexsort((populations(fps), own))
        sides = np.split(order, np.flatnonzero(np.diff(own[order])) + 1)
        if len(sides) == 1 and pdf["a"].iloc[0] != pdf["b"].iloc[0]:
            return pd.DataFrame({"u": nodes[:0], "v": nodes[:0]})
        u, v = links(fps[sides[0]], fps[sides[1]] if len(sides) > 1 else None, radius)
        return pd.DataFrame({"u": nodes[order][u], "v": nodes[order][v]})

    blocks = tagged.filter("m is not null").withColumn("blocks", F.ceil(F.col("m") / BLOCK_ROWS).cast("int"))
    dealt = blocks.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("h", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", *PRINTS)
    return pairs.unionByName(dealt.groupBy("h", "a", "b").applyInPandas(compare, "u long, v long"))


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, none of them empty, the first set that a chain of pairs of at least this Jaccard similarity leads to."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    label, inside = np.full(len(sets), -1), np.zeros(len(values), bool)
    rest, flat = np.arange(len(sets)), place  # what no group has yet, and its values
    while len(rest):
        first = rest[0]
        label[first] = first
        queue, rest, flat = [first], rest[1:], flat[size[first] :]
        while queue and len(rest):
            at = queue.pop()
            own = place[ends[at] - size[at] : ends[at]]
            inside[own] = True
            common = np.add.reduceat(inside[flat], np.cumsum(size[rest]) - size[rest], dtype=np.int64)
            inside[own] = False
            near = common >= similarity * (size[at] + size[rest] - common) - 1e-9
            if near.any():
                label[rest[near]] = first
                queue += rest[near].tolist()
                flat, rest = flat[np.repeat(~near, size[rest])], rest[~near]
    return label


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row per document with an id: id, ``component_id`` (smallest id of its group of near duplicates).

    Null and empty texts have no shingles and are copies of each other. Rows that repeat
    an id have a row each. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, fps, sizes, prefixes = [], np.zeros((len(pdf), PIECES), np.uint64), [], []
            for k, text in enumerate(pdf["text"]):
                s = shingle_set(text, words)
                keys.append(set_key(s))
                sizes.append(len(s))
                prefixes.append(s[: prefix_length(len(s), similarity) if len(s) else 0, 0].tobytes())
                fps[k] = fingerprint(s)
            yield pd.DataFrame({"id": pdf["id"], "key": keys, "n": sizes, "prefix": prefixes, **{c: fps[:, k].view(np.int64) for k, c in enumerate(PRINTS)}})

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for root, node, blocks, key, text in zip(pdf["root"], pdf["node"], pdf["blocks"], pdf["key"], pdf["text"]):
                s = shingle_set(text, words)
                if set_key(s) == key:  # another row may have the same id
                    yield pd.DataFrame({"root": [root], "node": [node], "blocks": [blocks], "shingles": [s[:, 0].tobytes()]})

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf["node"].to_numpy(np.int64)
        label = similar_groups([np.frombuffer(x, np.uint64) for x in pdf["shingles"]], similarity)
        moved = nodes != nodes[label]
        return pd.DataFrame({"u": nodes[moved], "v": nodes[label][moved]})

    fps = scratch.table(base.mapInPandas(prints, f"id {kind}, key binary, n long, prefix binary, " + ", ".join(f"{c} long" for c in PRINTS)))
    distinct = scratch.table(fps.groupBy("key", "n", *PRINTS).agg(F.min("id").alias("first"), F.any_value("prefix").alias("prefix")).withColumn("node", F.monotonically_increasing_id()))
    some = distinct.filter("n > 0")
    roots = connected_components(candidate_links(some.select("node", "prefix", *PRINTS), radius, scratch), scratch)
    members = scratch.table(distinct.join(roots, "node").select("root", "node", "first", "key", "n"))
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = scratch.table(members.join(blocks, "root", "left").select("root", "node", "first", "key", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    # Members grow with the documents, so their join is a merge join at every size.
    texts = dealt.hint("merge").join(base, F.col("first") == F.col("id")).select("root", "node", "blocks", "key", "text")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = texts.mapInPandas(sets, "root long, node long, blocks int, shingles binary").withColumn("own", own)
    met = met.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), k -> k <> own or blocks = 1)")))
    verified = met.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "shingles").groupBy("root", "a", "b").applyInPandas(verify, "u long, v long")
    groups = connected_components(verified, scratch)
    rooted = scratch.table(distinct.join(groups, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "first"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_key = scratch.table(rooted.hint("merge").join(least, "root").select("key", "component_id"))
    return fps.select("id", "key").hint("merge").join(by_key, "key").select(F.col("id").alias(id_col), "component_id")
