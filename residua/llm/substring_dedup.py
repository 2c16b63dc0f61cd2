"""Substring dedup over windows of words, with a count-min prefilter.

First pass: every partition counts the keys of its windows (see anchors), once a document, into a count-min
sketch; merged, it never underestimates in how many documents a window stands. Second pass: runs of windows
whose key is estimated to be in two documents or more are grouped exactly, by 128 bits of hash. A run
of windows that equals another one whole is settled by the smallest document of its group; only where
one key has several different runs are the windows of each group's first document grouped one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import covered, key_runs, prefix_sums, span_hash, window_keys
from .common import Scratch, as_text, text_of
from .sketch import prefilter

WINDOW = 50
#: Keys a byte of text, about: a word has six bytes, and a run of equal keys about thirteen windows.
KEYS_PER_BYTE = 1 / 80


def word_symbols(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def _document_keys(window: int) -> Callable[[bytes], np.ndarray]:
    def keys_of(text: bytes) -> np.ndarray:
        words = text.split()
        return np.unique(window_keys(word_symbols(words, 0), window)) if len(words) >= window else np.zeros(0, np.uint64)

    return keys_of


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept_text`` (kept words, one space between).

    A word goes if a window of ``window`` consecutive words covers it whose words also start in a document of
    smaller id; windows are judged on the input. Words are split at ASCII white space and compared as they are. Null
    and empty texts have no words. Rows that repeat an id are one document for the comparison: they never remove from each
    other. A null id is larger than all others, and rows without an id don't remove from each other. An empty table gives an empty table; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    base, filtered = prefilter(base, _document_keys(window), size * KEYS_PER_BYTE, scratch)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per document its runs of windows that may be repeated."""
        for pdf in batches:
            out = []
            for text, shared in zip(pdf["text"], pdf["shared"]):
                words = text.split()
                runs: list[tuple] = []
                if len(words) >= window:
                    symbols = word_symbols(words, 0)
                    keys = window_keys(symbols, window)
                    starts, counts = key_runs(keys)
                    may = filtered.of(shared)(keys[starts])
                    starts, counts = starts[may], counts[may]
                    if len(starts):
                        hashes = [span_hash(prefix_sums(s, w), starts, starts + counts + (window - 1), w) for w, s in ((0, symbols), (1, word_symbols(words, 1)))]
                        runs = list(zip(_signed(keys[starts]).tolist(), _signed(hashes[0]).tolist(), _signed(hashes[1]).tolist(), starts.tolist(), counts.tolist()))
                out.append((len(words), runs, b" ".join(words)))
            frame = pd.DataFrame(out, columns=["n_words", "runs", "words"])
            frame.insert(0, "id", pdf["id"])
            yield frame

    scanned = scratch.table(
        as_text(base)
        .mapInPandas(scan, "id string, n_words long, runs array<struct<key:long,c1:long,c2:long,start:long,n:long>>, words binary")
        .withColumns({"id": F.col("id").cast(kind), "row": F.monotonically_increasing_id()})
    )
    # Numbers stand for ids, so that null ids have an order: by id, nulls last.
    runs = scanned.select("row", "id", F.explode("runs").alias("r")).select("row", "id", "r.*")
    groups = scratch.table(runs.groupBy("key", "c1", "c2", "n").agg(F.min("id").alias("first"), F.min("row").alias("some_row"), F.count(F.lit(1)).alias("members")))
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    whole = runs.hint("merge").join(groups.filter("members > 1"), ["key", "c1", "c2", "n"]).filter(later).select("row", "start", "n")

    # Keys with several groups: windows of one run of each group, that of its first document, one by one.
    several = groups.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("key")
    open_groups = groups.join(several, "key", "left_semi").select("key", "c1", "c2", "n", "first")
    firsts = runs.hint("merge").join(open_groups, ["key", "c1", "c2", "n"]).filter(F.col("id").eqNullSafe(F.col("first")))
    by_row = firsts.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, key, text, spans in zip(pdf["row"], pdf["id"], pdf["words"], pdf["spans"]):
                words = text.split()
                at = np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in spans])
                h = [_signed(span_hash(prefix_sums(word_symbols(words, w), w), at, at + window, w)) for w in (0, 1)]
                yield pd.DataFrame({"row": row, "id": key, "start": at, "w1": h[0], "w2": h[1]})

    # A document without a run of windows that may be repeated loses nothing, so its text is never moved.
    may_lose = F.size("runs") > 0
    opened = as_text(scanned.filter(may_lose).select("row", "id", "words").join(by_row, "row")).mapInPandas(windows, "row long, id string, start long, w1 long, w2 long")
    opened = scratch.table(opened.withColumn("id", F.col("id").cast(kind)))
    least = opened.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    single = opened.hint("merge").join(least, ["w1", "w2"]).filter(later).select("row", "start", F.lit(1).cast("long").alias("n"))
    hits = whole.unionByName(single).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("gone"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            removed, kept = [], []
            for text, gone in zip(pdf["words"], pdf["gone"]):
                if gone is None or not len(gone):
                    removed.append(0)
                    kept.append(text)
                    continue
                words = text.split()
                a = np.array([(s["start"], s["n"]) for s in gone], np.int64)
                out = covered(len(words), a[:, 0], a[:, 1], window)
                removed.append(int(out.sum()))
                kept.append(b" ".join([w for w, x in zip(words, out.tolist()) if not x]))
            yield pd.DataFrame({"id": pdf["id"], "n_words": pdf["n_words"], "n_removed": removed, "kept_text": kept})

    out = scanned.filter(may_lose).select("row", "id", "n_words", "words").join(hits, "row", "left").select("id", "n_words", "words", "gone")
    out = as_text(out).mapInPandas(cut, "id string, n_words long, n_removed long, kept_text binary").withColumn("id", F.col("id").cast(kind))
    out = out.unionByName(scanned.filter(~may_lose).select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("words").alias("kept_text")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text"))
