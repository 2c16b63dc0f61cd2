"""Benchmark decontamination: a BM25 index of the test items, queried by every passage with block-max WAND.

Impacts are divided by the item's own score (of itself as a query), so one threshold fits short and long
items. Passages overlap such that each item fits whole into one of them. Before the walk over postings, bounds
over ranges of items are added up for all passages of a document at once; a passage that no range can lift
to the threshold needs no walk. What is retrieved counts only if item and passage share five-word shingles:
of the whole item, and of both its question (the first two thirds) and its answer (the rest).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import InitVar, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

K1, B = 1.2, 0.75
#: Postings of a block, ranges of items; items and words of an index, which bound what is broadcast, but for a longer item.
#: More items are split over several indexes.
BLOCK, RANGES, INDEX_ITEMS, INDEX_WORDS = 16, 32, 50_000, 2_000_000
SHINGLE = 5
_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def shingles(words: Sequence[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; of fewer words the whole sequence, of none nothing."""
    if len(words) <= SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


@dataclass
class Postings:
    items: list[int]
    impacts: list[float]
    most: float
    block_last: list[int]
    block_most: list[float]


@dataclass
class Statistics:
    """Of all items that have words, however many indexes hold them: number, words, longest item, items of each word."""

    n: int = 0
    words: int = 0
    longest: int = 0
    df: Counter = field(default_factory=Counter)

    def add(self, words: list[str]) -> None:
        self.n, self.words, self.longest = self.n + 1, self.words + len(words), max(self.longest, len(words))
        self.df.update(set(words))


@dataclass
class Bm25Index:
    """Postings by term id, items in the order given. The statistics are not sent along."""

    ids: list
    words: list[list[str]]
    statistics: InitVar[Statistics]
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[Postings] = field(default_factory=list)

    def __post_init__(self, statistics: Statistics) -> None:
        tfs = [Counter(w) for w in self.words]
        n, df = statistics.n, statistics.df
        mean = statistics.words / max(1, n) or 1.0
        found: dict[str, list[tuple[int, float]]] = {}
        for i, tf in enumerate(tfs):
            size = len(self.words[i])
            own = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in tf.items()}
            total = sum(own.values())
            for t, x in own.items():
                found.setdefault(t, []).append((i, float(x / total)))
        self.bounds = np.zeros((len(found) + 1, RANGES), np.float32)  # the last row is for words of no item
        self.per_range = max(1, -(-len(tfs) // RANGES))
        for t, rows in found.items():
            k = self.terms[t] = len(self.terms)
            blocks = [rows[a : a + BLOCK] for a in range(0, len(rows), BLOCK)]
            self.postings.append(Postings([i for i, _ in rows], [x for _, x in rows], max(x for _, x in rows), [b[-1][0] for b in blocks], [max(x for _, x in b) for b in blocks]))
            for i, x in rows:
                r = i // self.per_range
                self.bounds[k, r] = max(self.bounds[k, r], x)
        self.longest = statistics.longest

    def wand(self, terms: Sequence[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts over the distinct terms add up to the threshold."""
        slack = threshold - 1e-6
        cursors = [[self.postings[t].items[0], 0, self.postings[t]] for t in terms]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2].most
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # Bounds of the blocks that hold the pivot, or that follow where a list has none.
            bound, block_end = 0.0, None
            for c in cursors[: pivot + 1]:
                k = bisect_left(c[2].block_last, item)
                if k < len(c[2].block_last):
                    bound += c[2].block_most[k]
                    end = c[2].block_last[k]
                    block_end = end if block_end is None else min(block_end, end)
            if bound < slack:
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else None
                target = (block_end if block_end is not None else item) + 1
                target = min(target, after) if after is not None else target
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(c[2].impacts[c[1]] for c in cursors[: pivot + 1])
                if score >= slack:
                    out.append((item, score))
                target, moved = item + 1, cursors[: pivot + 1]
            else:
                target, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moved:
                if c[0] < target:
                    c[1] = bisect_left(c[2].items, target, c[1])
                    c[0] = c[2].items[c[1]] if c[1] < len(c[2].items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def matches(self, text: str, threshold: float, similarity: float, part_similarity: float) -> dict[int, tuple[float, float, float, float]]:
        """Item number to (score, similarity, question's, answer's) of the best verified passage of a whole text."""
        words = words_of(text)
        size = self.longest
        if not words or not size:
            return {}
        none = len(self.terms)
        get = self.terms.get
        ids = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        starts = np.arange(0, max(1, len(words) - size), size)
        out: dict[int, tuple[float, float, float, float]] = {}
        for group in range(0, len(starts), 512):  # bounds of so many passages at a time
            at = starts[group : group + 512]
            low, high = int(at[0]), min(len(words), int(at[-1]) + 2 * size)
            sums = np.concatenate([np.zeros((1, RANGES), np.float64), np.cumsum(self.bounds[ids[low:high]], axis=0, dtype=np.float64)])
            ends = np.minimum(at + 2 * size, high)
            reach = (sums[ends - low] - sums[at - low]).max(1)
            for k in np.nonzero(reach >= threshold - 1e-4)[0].tolist():
                passage = words[at[k] : ends[k]]
                terms = np.unique(ids[at[k] : ends[k]])
                if self.bounds[terms].sum(0).max() < threshold - 1e-4:
                    continue
                found = self.wand(terms[terms < none].tolist(), threshold)
                if not found:
                    continue
                have = {n: set(zip(*(passage[i:] for i in range(n)))) for n in {SHINGLE, *(min(SHINGLE, len(p)) for i, _ in found for p in self.parts(i))} if n}
                for i, score in found:
                    whole, question, answer = (self.overlap(p, have) for p in self.parts(i))
                    if whole >= similarity and min(question, answer) >= part_similarity:
                        out[i] = max(out.get(i, (0.0, 0.0, 0.0, 0.0)), (score, whole, question, answer))
        return out

    def parts(self, i: int) -> tuple[list[str], list[str], list[str]]:
        w = self.words[i]
        cut = -(-2 * len(w) // 3)
        return w, w[:cut], w[cut:] or w

    @staticmethod
    def overlap(part: list[str], have: dict[int, set]) -> float:
        own = shingles(part)
        there = have[min(SHINGLE, len(part))]
        return sum(s in there for s in own) / len(own)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.6,
    similarity: float = 0.8,
    part_similarity: float = 0.5,
) -> DataFrame:
    """Verified matches: id, item_id, score (BM25 over the item's own), similarity, question_overlap, answer_overlap.

    One row per document and item, of the document's best passage. Null and empty texts and items match nothing;
    null ids are kept; repeated documents or items match each for itself. Items are read twice: for the
    statistics of all of them (a count for each word of the benchmark stays on the driver), then index by index. An index is
    bounded by INDEX_ITEMS and INDEX_WORDS; each more index is one more pass over docs and changes no result.
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), text_of(item_text_col).alias("t")).orderBy(benchmark[item_col], "t")
    statistics = Statistics()
    for r in items.toLocalIterator():
        if w := words_of(r.t):
            statistics.add(w)
    rows = items.toLocalIterator()
    base = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    schema = "id string, item_id string, score double, similarity double, question_overlap double, answer_overlap double"
    out = None
    while True:
        ids, words, size = [], [], 0
        for r in rows:
            if w := words_of(r.t):
                ids.append(r.i)
                words.append(w)
                size += len(w)
            if len(ids) == INDEX_ITEMS or size >= INDEX_WORDS:
                break
        if not ids and out is not None:
            break
        index = spark.sparkContext.broadcast(Bm25Index(ids, words, statistics))

        def udf(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            it = index.value
            for pdf in batches:
                hits = [(key, it.ids[i], *x) for key, text in zip(pdf["id"], pdf["text"]) for i, x in sorted(it.matches(text, threshold, similarity, part_similarity).items())]
                if hits:
                    yield pd.DataFrame(hits, columns=["id", "item_id", "score", "similarity", "question_overlap", "answer_overlap"])

        found = base.mapInPandas(udf, schema)
        out = found if out is None else out.unionByName(found)
        if len(ids) < INDEX_ITEMS and size < INDEX_WORDS:
            break
    return out.withColumns({"id": F.col("id").cast(kinds[0]), "item_id": F.col("item_id").cast(kinds[1])}).withColumnRenamed("id", id_col)
