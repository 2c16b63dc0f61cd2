"""A random forest whose trees grow by counts: bags and class weights drawn a tree, trees kept as a table of nodes.

A tree's bag gives each row a Poisson(1) number of copies, drawn by a hash of seed, tree and row key, so any task that sees the row
draws the same. Class weights are n / (2 n_class) within each bag. Values are cut into bins once, and a node is split by the
counts of copies and rows in its bins. The counts are whole numbers, so neither partitions nor the order of rows change a tree.

Nodes with many rows are counted where the rows are, level by level: tasks emit the cells that are not empty, a shuffle adds
them up and splits the node. A node with few rows goes to one task with its rows, which grows what is below it by the same rule.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Scratch
from .quantiles import exact_quantiles

BINS = 64
#: A node of more rows is split where they are. At least so many, so that nodes above are few: 2 x TOP a tree.
FEW, TOP = 1 << 16, 1 << 12
#: Nodes that are sent to every task for scoring, 24 bytes each; more are met in joins.
SENT = 1 << 22
#: Bits of a count of copies or rows where three are packed in a double.
DIGITS = 17
NODE = "tree int, node long, feature int, bin int, gain double, rows long, score double"
#: Multipliers and shifts of a well-known 64-bit mixing function, and the odd step between its streams.
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
STEP = 0x9E3779B97F4A7C15
#: Chances of at most 0, 1, ... copies.
_COPIES = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(16)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64 hashed bits of each number."""
    x = np.asarray(x, np.uint64) + np.uint64(STEP)
    for shift, times in MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x


def stream(*parts: int) -> int:
    """One number from several, for hashing on from."""
    out = 0
    for p in parts:
        out = int(mixed(np.array([(out ^ p) % 2**64], np.uint64))[0])
    return out


def copies(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in the tree's bag."""
    u = (mixed(keys ^ np.uint64(stream(seed, 1, tree))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_COPIES, u, side="right").astype(np.int64)


def drawn_features(nodes: np.ndarray, features: int, seed: int, tree: int) -> np.ndarray:
    """(nodes, about the root of features): which features each node may split by, in rising order."""
    m = max(1, int(features**0.5))
    h = mixed(nodes.astype(np.uint64)[:, None] * np.uint64(STEP) ^ mixed(np.arange(features, dtype=np.uint64) + np.uint64(stream(seed, 2, tree)))[None, :])
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :m], axis=1)


def best_splits(cells: np.ndarray, weights: tuple[float, float], leaf: int) -> tuple[np.ndarray, ...]:
    """(which drawn feature, bin, gain, counts of the left side) for cells (nodes, drawn, BINS, 3) of copies by class and rows.

    Which is -1 where no split leaves ``leaf`` rows on both sides or the node is pure. Of equal splits the first counts.
    """
    whole = cells[:, 0].sum(1)
    left = cells.cumsum(2)[:, :, :-1]
    right = whole[:, None, None, :] - left

    def impurity(c: np.ndarray) -> np.ndarray:
        a, b = c[..., 0] * weights[0], c[..., 1] * weights[1]
        return np.where(a + b > 0, 2 * a * b / np.maximum(a + b, 1e-300), 0.0)  # weight x Gini

    gain = impurity(whole)[:, None, None] - impurity(left) - impurity(right)
    gain = np.where((left[..., 2] >= leaf) & (right[..., 2] >= leaf), gain, -1.0)
    flat = gain.reshape(len(cells), -1)
    best = flat.argmax(1)
    which, cut = np.divmod(best, BINS - 1)
    at = np.arange(len(cells))
    sound = (flat[at, best] > -1e-12) & (whole[:, 0] > 0) & (whole[:, 1] > 0)
    return np.where(sound, which, -1), cut, np.maximum(flat[at, best], 0.0), left[at, which, cut]


def _count(bins: np.ndarray, labels: np.ndarray, times: np.ndarray, place: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """cells of rows whose node is the place-th one."""
    n, m = drawn.shape
    out = np.zeros((n, m, BINS, 3))
    for k in range(m):
        at = place * BINS + bins[np.arange(len(bins)), drawn[place, k]]
        for c, w in enumerate((times * (labels == 0), times * (labels == 1), None)):
            out[:, k, :, c] = np.bincount(at, w, n * BINS).reshape(n, BINS)
    return out


def _score(counts: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    a, b = counts[..., 0] * weights[0], counts[..., 1] * weights[1]
    return b / np.maximum(a + b, 1e-300)


def _impurity(a: np.ndarray, b: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    a, b = a * weights[0], b * weights[1]
    return np.where(a + b > 0, 2 * a * b / np.maximum(a + b, 1e-300), 0.0)  # weight x Gini


def _small_splits(bins: np.ndarray, packed: np.ndarray, place: np.ndarray, whole: np.ndarray, drawn: np.ndarray, weights: tuple[float, float], leaf: int) -> tuple[np.ndarray, ...]:
    """(which drawn feature, bin, gain) as best_splits has them, of nodes whose rows lie together in the order of place.

    A row's copies of either class and itself are packed in one number, of DIGITS bits each, and only bins with rows are looked at.
    """
    n, rows = len(drawn), np.arange(len(bins))
    which, cut, gain = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1.0)
    before = _impurity(whole[:, 0], whole[:, 1], weights)
    mask = (1 << DIGITS) - 1
    for k in range(drawn.shape[1]):
        cells = np.bincount(place * BINS + bins[rows, drawn[place, k]], packed, n * BINS)
        filled = np.flatnonzero(cells)
        node, starts = filled // BINS, np.searchsorted(filled, np.arange(n) * BINS)
        sums = np.r_[0, cells[filled].cumsum().astype(np.int64)]
        left = sums[1:] - sums[starts][node]
        a, b, r = left & mask, (left >> DIGITS) & mask, left >> (2 * DIGITS)
        w = whole[node]
        got = before[node] - _impurity(a, b, weights) - _impurity(w[:, 0] - a, w[:, 1] - b, weights)
        got = np.where((r >= leaf) & (w[:, 2] - r >= leaf), got, -1.0)
        best = np.maximum.reduceat(got, starts)
        first = np.minimum.reduceat(np.where(got == best[node], filled % BINS, BINS), starts)
        better = best > gain
        which, cut, gain = np.where(better, k, which), np.where(better, first, cut), np.where(better, best, gain)
    sound = (gain > -1e-12) & (whole[:, 0] > 0) & (whole[:, 1] > 0)
    return np.where(sound, which, -1), cut, np.maximum(gain, 0.0)


def grow(bins: np.ndarray, labels: np.ndarray, times: np.ndarray, node: int, tree: int, weights: tuple[float, float], seed: int, depth: int, leaf: int) -> pd.DataFrame:
    """The nodes at and below one node, of the rows that reach it. depth is that of the deepest level allowed below the root."""
    level = node.bit_length() - 1
    ids, place = np.array([node], np.int64), np.zeros(len(bins), np.int64)
    out = []
    small = leaf > 0 and max(times.sum(), len(bins)) < 1 << DIGITS
    while len(ids):
        whole = np.stack([np.bincount(place, w, len(ids)) for w in (times * (labels == 0), times * (labels == 1), None)], 1)
        which, cut, gain = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.zeros(len(ids))
        feature = np.full(len(ids), -1)
        if level < depth:
            # Nodes that may be split, and their rows in the nodes' order.
            open_ = np.flatnonzero((whole[:, 0] > 0) & (whole[:, 1] > 0) & (whole[:, 2] >= 2 * leaf))
            rank = np.full(len(ids), -1)
            rank[open_] = np.arange(len(open_))
            rows = np.flatnonzero(rank[place] >= 0)
            own = rank[place[rows]]
            order = np.argsort(own.astype(np.uint16) if len(open_) <= 1 << 16 else own, kind="stable")
            rows, own = rows[order], own[order]
            drawn = drawn_features(ids[open_], bins.shape[1], seed, tree)
            for at in range(0, len(open_), 2048):
                span = slice(at, at + 2048)
                some = slice(*np.searchsorted(own, (at, at + 2048)))
                i, to = rows[some], open_[span]
                if small:
                    packed = times[i] * ((labels[i] == 0) + (labels[i] == 1) * float(1 << DIGITS)) + float(1 << 2 * DIGITS)
                    which[to], cut[to], gain[to] = _small_splits(bins[i], packed, own[some] - at, whole[to], drawn[span], weights, leaf)
                else:
                    cells = _count(bins[i], labels[i], times[i], own[some] - at, drawn[span])
                    which[to], cut[to], gain[to], _ = best_splits(cells, weights, leaf)
            feature[open_] = np.where(which[open_] >= 0, drawn[np.arange(len(open_)), np.maximum(which[open_], 0)], -1)
        split = feature >= 0
        out.append(pd.DataFrame({"tree": tree, "node": ids, "feature": feature, "bin": np.where(split, cut, -1), "gain": np.where(split, gain, 0.0), "rows": whole[:, 2].astype(np.int64), "score": _score(whole, weights)}))
        goes = split[place]
        bins, labels, times, place = bins[goes], labels[goes], times[goes], place[goes]
        right = bins[np.arange(len(bins)), feature[place]] > cut[place]
        rank = np.cumsum(split) - 1
        place = 2 * rank[place] + right
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], 1).ravel()
        level += 1
    return pd.concat(out, ignore_index=True)


def _walk(bins: np.ndarray, top: pd.DataFrame) -> np.ndarray:
    """The node of one tree's top that each row comes to; the top's nodes are all split."""
    at = np.ones(len(bins), np.int64)
    ids, feature, cut = (top[c].to_numpy(np.int64) for c in ("node", "feature", "bin"))
    while len(ids):
        k = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
        inside = ids[k] == at
        if not inside.any():
            break
        r = np.flatnonzero(inside)
        at[r] = 2 * at[r] + (bins[r, feature[k[r]]] > cut[k[r]])
    return at


@dataclass
class Forest:
    """Nodes (NODE; feature -1 is a leaf), the features' bin edges and what a missing value counts as."""

    features: tuple[str, ...]
    edges: list[list[float]]
    medians: list[float]
    trees: int
    nodes: DataFrame

    def importance(self) -> dict[str, float]:
        """Mean over trees of each feature's share of the tree's gain."""
        gains = self.nodes.filter("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
        total = gains.groupBy("tree").agg(F.sum("g").alias("total")).filter("total > 0")
        shares = gains.join(total, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("total")).alias("share"))
        found = {r.feature: r.share for r in shares.collect()}  # one row a feature
        all_of = sum(found.values()) or 1.0
        return {f: found.get(k, 0.0) / all_of for k, f in enumerate(self.features)}

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        rest = json.dumps({"features": self.features, "edges": self.edges, "medians": self.medians, "trees": self.trees})
        self.nodes.sparkSession.createDataFrame([(rest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        rest = json.loads(spark.read.text(f"{path}/forest").first()[0])
        return cls(tuple(rest["features"]), rest["edges"], rest["medians"], rest["trees"], spark.read.parquet(f"{path}/nodes"))


def _binned(values: np.ndarray, edges: list[np.ndarray], medians: list[float]) -> np.ndarray:
    """(rows, features) numbers of bins; what is missing counts as the median."""
    out = np.empty(values.shape, np.uint8)
    for k, (e, m) in enumerate(zip(edges, medians)):
        v = values[:, k]
        out[:, k] = np.searchsorted(e, np.where(np.isnan(v), m, v))
    return out


def fit_forest(train: DataFrame, features: tuple[str, ...], label: str = "label", key: str | None = None, trees: int = 500, depth: int = 30, leaf: int = 2, seed: int = 42, few: int = FEW) -> Forest:
    """A forest with balanced weights within each bag; at least ``leaf`` rows a side, about the root of the features tried a split.

    ``key`` names a column that tells rows apart for the draws of bags (default: the row's place in the stored table). Rows with a
    null label are left out; missing and NaN values count as the feature's median. A tree whose bag has one class only, or nothing, is a
    leaf. ``depth`` is at most 60.
    """
    if not 0 < depth <= 60 or trees < 1:
        raise ValueError("a depth of 1 to 60 and at least one tree are needed")
    spark = train.sparkSession
    scratch = Scratch(spark)
    features = tuple(features)
    identity = F.monotonically_increasing_id() if key is None else F.xxhash64(key)
    base = scratch.table(train.filter(F.col(label).isNotNull()).select(identity.alias("__key"), F.col(label).cast("int").alias("__label"), *(F.col(f).cast("double") for f in features)))
    present = base.unpivot([], list(features), "feature", "value").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    cuts = {r.feature: r.q for r in exact_quantiles(present, "value", ("feature",), [k / BINS for k in range(1, BINS)]).collect()}  # one row a feature
    edges = [np.unique(np.array(cuts.get(f, []), float)) for f in features]
    medians = [float(cuts[f][BINS // 2 - 1]) if f in cuts else 0.0 for f in features]

    def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = _binned(pdf[list(features)].to_numpy(float), edges, medians)
            yield pd.DataFrame({"key": pdf["__key"], "label": pdf["__label"], "bins": [r.tobytes() for r in b]})

    rows = scratch.table(base.mapInPandas(to_bins, "key long, label int, bins binary"))
    n = rows.count()
    few = max(few, n // TOP)
    width = len(features)

    def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        return pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["label"].to_numpy(np.int64), np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), width)

    def bag_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((trees, 3), np.int64)
        for pdf in batches:
            keys, labels, _ = arrays(pdf)
            for t in range(trees):
                times = copies(keys, seed, t)
                total[t] += [times[labels == 0].sum(), times[labels == 1].sum(), (times > 0).sum()]
        yield pd.DataFrame({"tree": np.arange(trees), "a": total[:, 0], "b": total[:, 1], "rows": total[:, 2]})

    bags = rows.mapInPandas(bag_sizes, "tree int, a long, b long, rows long").groupBy("tree").agg(*(F.sum(c).alias(c) for c in ("a", "b", "rows"))).collect()  # one row a tree
    bag = {r.tree: np.array([r.a, r.b, r.rows], np.float64) for r in bags}
    zero = np.zeros(3)
    weights = {t: tuple((bag.get(t, zero)[0] + bag.get(t, zero)[1]) / (2 * max(1.0, c)) for c in bag.get(t, zero)[:2]) for t in range(trees)}

    # The top: nodes of more than `few` rows, of which a tree has 2 x TOP x levels at most.
    top = {t: pd.DataFrame({"node": np.zeros(0, np.int64), "feature": np.zeros(0, np.int64), "bin": np.zeros(0, np.int64)}) for t in range(trees)}
    many = {t: np.array([1], np.int64) for t in range(trees) if bag.get(t, zero)[2] > few}
    written = []
    for level in range(depth):
        if not many:
            break
        sent = spark.sparkContext.broadcast((top, many))

        def count(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            tops, wanted = sent.value
            for pdf in batches:
                keys, labels, bins = arrays(pdf)
                for t, nodes in wanted.items():
                    times = copies(keys, seed, t)
                    at = _walk(bins, tops[t])
                    place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                    here = (times > 0) & (nodes[place] == at)
                    if not here.any():
                        continue
                    some, inverse = np.unique(place[here], return_inverse=True)
                    cells = _count(bins[here], labels[here], times[here], inverse, drawn_features(nodes[some], width, seed, t))
                    kind = cells.reshape(len(some), -1, 3)
                    filled = [np.flatnonzero(c[:, 2]) for c in kind]
                    yield pd.DataFrame({"tree": t, "node": nodes[some], "cells": [np.c_[f, c[f]].astype(np.int64).tobytes() for f, c in zip(filled, kind)]})

        def split(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            held, total = None, None

            def done() -> pd.DataFrame:
                t, node = held
                drawn = drawn_features(np.array([node]), width, seed, t)
                cells = total.reshape(1, drawn.shape[1], BINS, 3)
                which, cut, gain, left = best_splits(cells, weights[t], leaf)
                whole = cells[0, 0].sum(0)
                found = which[0] >= 0
                return pd.DataFrame({"tree": [t], "node": [node], "feature": [int(drawn[0, which[0]]) if found else -1], "bin": [int(cut[0]) if found else -1], "gain": [float(gain[0]) if found else 0.0], "rows": [int(whole[2])], "score": [float(_score(whole, weights[t]))], "left_rows": [int(left[0, 2])]})

            for pdf in batches:
                for t, node, cells in zip(pdf["tree"], pdf["node"], pdf["cells"]):
                    if held != (t, node):
                        if held is not None:
                            yield done()
                        held, total = (t, node), np.zeros((max(1, int(width**0.5)) * BINS, 3))
                    part = np.frombuffer(cells, np.int64).reshape(-1, 4)
                    total[part[:, 0]] += part[:, 1:]
            if held is not None:
                yield done()

        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        counted = rows.mapInPandas(count, "tree int, node long, cells binary").repartition(parts, "tree", "node").sortWithinPartitions("tree", "node")
        now = scratch.table(counted.mapInPandas(split, NODE + ", left_rows long"))
        written.append(now.drop("left_rows"))
        many = {}
        for t, some in now.filter("feature >= 0").select("tree", "node", "feature", "bin", "rows", "left_rows").toPandas().groupby("tree"):
            top[t] = pd.concat([top[t], some[["node", "feature", "bin"]]], ignore_index=True).sort_values("node", ignore_index=True)
            children = np.r_[2 * some["node"].to_numpy(), 2 * some["node"].to_numpy() + 1]
            sizes = np.r_[some["left_rows"].to_numpy(), (some["rows"] - some["left_rows"]).to_numpy()]
            if (sizes > few).any() and level + 1 < depth:
                many[t] = np.sort(children[sizes > few])
        sent.unpersist()

    # What no level has split or made a leaf grows where its rows are brought together.
    leaves = {t: set() for t in range(trees)}
    for table in written:
        for r in table.filter("feature < 0").select("tree", "node").collect():
            leaves[r.tree].add(r.node)
    sent = spark.sparkContext.broadcast((top, {t: np.array(sorted(v), np.int64) for t, v in leaves.items()}))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops, ended = sent.value
        for pdf in batches:
            keys, labels, bins = arrays(pdf)
            for t in range(trees):
                times = copies(keys, seed, t)
                at = _walk(bins, tops[t])
                here = np.flatnonzero((times > 0) & ~np.isin(at, ended[t]))
                here = here[np.argsort(at[here], kind="stable")]
                if len(here):
                    packed = np.c_[labels[here].astype(np.uint8), times[here].astype(np.uint8), bins[here]]
                    starts = np.flatnonzero(np.r_[True, np.diff(at[here]) != 0])
                    yield pd.DataFrame({"tree": t, "node": at[here][starts], "block": [p.tobytes() for p in np.split(packed, starts[1:])]})

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        block = np.frombuffer(b"".join(pdf["block"]), np.uint8).reshape(-1, width + 2)
        return grow(block[:, 2:], block[:, 0].astype(np.int64), block[:, 1].astype(np.float64), node, t, weights[t], seed, depth, leaf)

    grown = rows.mapInPandas(deal, "tree int, node long, block binary").groupBy("tree", "node").applyInPandas(below, NODE)
    nodes = scratch.table(grown)
    for table in written:
        nodes = nodes.unionByName(table)
    empty = [t for t in range(trees) if bag.get(t, zero)[2] == 0]
    if empty:
        nodes = nodes.unionByName(spark.createDataFrame([(t, 1, -1, -1, 0.0, 0, 0.5) for t in empty], NODE))
    return Forest(features, [e.tolist() for e in edges], medians, trees, nodes)


def forest_scores(forest: Forest, df: DataFrame, score: str = "score", sent: int = SENT) -> DataFrame:
    """df with the mean over trees of the leaf's weighted share of label 1.

    The nodes go to every task if they are no more than ``sent``, else as many trees at a time as have no more. Rows meet
    a forest with a larger tree in joins, a level of all trees at a time.
    """
    edges, spark = [np.array(e) for e in forest.edges], df.sparkSession
    names = list(forest.features)
    kept = df.columns
    sizes = sorted((r["tree"], r["count"]) for r in forest.nodes.groupBy("tree").count().collect())  # one row a tree
    scratch, medians = Scratch(spark), forest.medians

    def walked(trees: range | None = None):
        """A function of (bins, sums) that adds the scores of these trees' leaves to the sums, and the broadcast of their nodes."""
        some = forest.nodes if trees is None else forest.nodes.filter(F.col("tree").between(trees[0], trees[-1]))
        table = some.select("tree", "node", "feature", "bin", "score").toPandas().sort_values(["tree", "node"], ignore_index=True)
        begin = np.searchsorted(table["tree"].to_numpy(), np.arange(forest.trees + 1) if trees is None else np.arange(trees[0], trees[-1] + 2))
        node = table["node"].to_numpy(np.int64)
        child = np.zeros(len(table), np.int32)
        for a, b in zip(begin[:-1], begin[1:]):
            child[a:b] = a + np.minimum(np.searchsorted(node[a:b], 2 * node[a:b]), b - a - 1)
        packed = spark.sparkContext.broadcast((begin, child, table["feature"].to_numpy(np.int16), table["bin"].to_numpy(np.int16), table["score"].to_numpy(float)))

        def add(bins: np.ndarray, total: np.ndarray) -> np.ndarray:
            start, child, feature, cut, scores = packed.value
            for first in start[:-1]:
                at = np.full(len(bins), first, np.int64)
                going = np.flatnonzero(feature[at] >= 0)
                while len(going):
                    here = at[going]
                    at[going] = child[here] + (bins[going, feature[here]] > cut[here])
                    going = going[feature[at[going]] >= 0]
                total = total + scores[at]
            return total

        return add, packed

    def binned(columns: tuple[pd.Series, ...]) -> np.ndarray:
        return _binned(np.stack([c.to_numpy(float) for c in columns], 1), edges, medians)

    values = [F.col(n).cast("double") for n in names]
    if sum(k for _, k in sizes) <= sent:
        add, _ = walked()
        trees = forest.trees

        def mean(*columns: pd.Series) -> pd.Series:
            return pd.Series(add(binned(columns), np.zeros(len(columns[0]))) / trees)

        return df.withColumn(score, F.pandas_udf(mean, "double")(*values))
    if max(k for _, k in sizes) <= sent:
        # Some trees at a time, so that no task holds more than ``sent`` nodes; rows carry their bins and the sum so far.
        rows = scratch.table(df.withColumn("__row", F.monotonically_increasing_id()))

        def packed_bins(*columns: pd.Series) -> pd.Series:
            return pd.Series([r.tobytes() for r in binned(columns)])

        state = scratch.table(rows.select("__row", F.pandas_udf(packed_bins, "binary")(*values).alias("bins"), F.lit(0.0).alias("sum")))
        groups, held = [[]], 0
        for t, k in sizes:
            if groups[-1] and held + k > sent:
                groups.append([])
                held = 0
            groups[-1].append(t)
            held += k
        width = len(names)
        for trees in groups:
            add, broadcast = walked(range(trees[0], trees[-1] + 1))

            def more(bins: pd.Series, total: pd.Series) -> pd.Series:
                return pd.Series(add(np.frombuffer(b"".join(bins), np.uint8).reshape(-1, width), total.to_numpy(float)))

            old, state = state, scratch.table(state.select("__row", "bins", F.pandas_udf(more, "double")("bins", "sum").alias("sum")))
            scratch.drop(old)
            broadcast.destroy()
        means = state.select("__row", (F.col("sum") / forest.trees).alias("__score"))
        return rows.join(means, "__row").select(*(c for c in kept if c != score), F.col("__score").alias(score))

    rows = scratch.table(df.withColumn("__row", F.monotonically_increasing_id()))
    low = [F.coalesce(F.when(~F.isnan(n), F.col(n).cast("double")), F.lit(m)) for n, m in zip(names, forest.medians)]

    def bin_of(value: Column, cuts: np.ndarray) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts.tolist())).cast("array<double>"), lambda x: x < value))

    bins = F.array(*(bin_of(v, e) for v, e in zip(low, edges)))
    state = rows.select("__row", bins.alias("bins"), F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"))
    ended = None
    while True:
        met = scratch.table(state.join(forest.nodes, ["tree", "node"]).select("__row", "bins", "tree", "node", "feature", "bin", "score"))
        leaf = met.filter("feature < 0").select("__row", "score")
        ended = leaf if ended is None else ended.unionByName(leaf)
        state = met.filter("feature >= 0").select("__row", "bins", "tree", (2 * F.col("node") + (F.col("bins")[F.col("feature")] > F.col("bin")).cast("long")).alias("node"))
        if state.isEmpty():
            break
    means = ended.groupBy("__row").agg((F.sum("score") / forest.trees).alias("__score"))
    return rows.join(means, "__row").select(*(c for c in kept if c != score), F.col("__score").alias(score))

