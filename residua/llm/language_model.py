"""Gated recurrent language model in numpy, trained over the cluster, scoring whole documents.

Counts of every training token give the vocabulary, the classes and the tail's distribution. The model's
output is factored: a class, then a word of the class; words are in classes of about equal weight, by falling
count. Words beyond the vocabulary share one output, below which the tail's smoothed counts decide.

Texts are read twice: to count words, and to write each document's ids as a table that training and scoring
read. Training is truncated backpropagation over the whole text of every document: documents are strung into
parallel streams, and state is carried from window to window. Each partition trains from the same weights on its
own documents; the results are averaged, weighted by tokens, and a next round would start from the average. So
the weights depend, within limits, on how documents lie in partitions. Scoring carries the state across windows
to the end of each document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .recurrent import Gru, Vocabulary
from .word_hash import HashTable, binary_column, word_hashes

#: Words of the model, and words whose counts go to every task. They bound what is broadcast.
MODEL_WORDS, COUNT_WORDS = 8192, 1 << 18
#: Rounds of training, each over all training tokens.
ROUNDS = 1
#: Bytes of text, and tokens, that a task works on at once, but for a longer document.
TEXT_BYTES, TOKENS = 8 << 20, 4 << 20


def _parts(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes or tokens, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def count_words(texts: DataFrame) -> DataFrame:
    """(text binary) to (word long: a word's hash, c)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_column(batch.column("text"))
            for a, b in _parts(offsets, TEXT_BYTES):
                word, c = np.unique(word_hashes(data, offsets[a : b + 1])[0], return_counts=True)
                yield pa.record_batch({"word": word.view(np.int64), "c": c.astype(np.int64)})

    return texts.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) by falling count, ties by hash: all words down to a count, k of them at most."""
    step = F.floor(F.log2("c") * 16)
    rows = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), reverse=True)  # a thousand rows at most
    seen, least = 0, None
    for r in rows:
        seen += r.n
        if seen > k:
            break
        least = r.least
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, c = (batch.column(x).to_numpy() for x in ("word", "c"))
            yield pa.record_batch({"words": pa.array([word.tobytes()], pa.binary()), "cs": pa.array([c.tobytes()], pa.binary())})

    got = counts.filter(F.col("c") >= least).select("word", "c").mapInArrow(pack, "words binary, cs binary").collect()
    words = np.concatenate([np.frombuffer(r.words, np.uint64) for r in got])
    c = np.concatenate([np.frombuffer(r.cs, np.int64) for r in got])
    order = np.lexsort((words, -c))
    return words[order], c[order]


def train(ids: DataFrame, vocabulary: Vocabulary, scratch: Scratch, rounds: int = ROUNDS) -> Gru:
    """Rounds of training in every partition of (ids binary, of documents) and of averaging."""
    spark = ids.sparkSession
    model = Gru(vocabulary)
    for _ in range(rounds):
        start = spark.sparkContext.broadcast((vocabulary, model.flat()))

        def fit(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            voc, flat = start.value
            own, n = Gru(voc, flat), 0
            for batch in batches:
                data, offsets = binary_column(batch.column("ids"))
                for a, b in _parts(offsets, 2 * TOKENS):
                    part = data[offsets[a] : offsets[b]].view(np.uint16)
                    own.train(np.concatenate([np.zeros(1, np.uint16), part]))
                    n += len(part)
            if n:
                yield pa.record_batch({"weights": pa.array([(own.flat() * np.float32(n)).tobytes()], pa.binary()), "n": pa.array([float(n)])})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = None, 0.0
            for pdf in batches:
                for w, k in zip(pdf["weights"], pdf["n"]):
                    a = np.frombuffer(w, np.float32)
                    total = a.copy() if total is None else total + a
                    n += k
            if total is not None:
                yield pd.DataFrame({"weights": [total.tobytes()], "n": [n]})

        # Averaged as a tree: sixteen to one, until eight are left for the driver.
        fitted = scratch.table(ids.select("ids").mapInArrow(fit, "weights binary, n double"))
        left = fitted.count()
        while left > 8:
            left = -(-left // 16)
            fitted = fitted.repartition(left).mapInPandas(add, "weights binary, n double")
        rows = fitted.collect()
        if rows:
            total = sum(np.frombuffer(x.weights, np.float32).astype(np.float64) for x in rows)
            model = Gru(vocabulary, total / sum(x.n for x in rows))
    return model


def encoded(base: DataFrame, words: np.ndarray, c: np.ndarray, ends: int) -> DataFrame:
    """(id, text, training) to rows of ids, sums over words with counts here, and the words without."""
    shared = base.sparkSession.sparkContext.broadcast((words, c))
    made: list = []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            keys, counts = shared.value
            made.extend([HashTable(keys), np.append(np.log10(counts + 1.0), 0.0)])
        find, logs = made[0].find, made[1]
        for batch in batches:
            data, offsets = binary_column(batch.column("text"))
            for a, b in _parts(offsets, TEXT_BYTES):
                hashes, n = word_hashes(data, offsets[a : b + 1])
                at = find(hashes)
                doc = np.repeat(np.arange(b - a), n)
                known, beyond = at >= 0, (at < 0) | (at >= MODEL_WORDS)
                log = logs[at]
                ids = np.zeros(len(at) + b - a, np.uint16)
                ids[np.arange(len(at)) + doc] = np.where(beyond, 1, at + 2)
                bounds = np.concatenate([[0], np.cumsum(n + 1)])
                rare = np.concatenate([[0], np.cumsum(n - np.bincount(doc[known], minlength=b - a))])
                yield pa.record_batch(
                    {
                        "id": batch.column("id").slice(a, b - a),
                        "training": batch.column("training").slice(a, b - a),
                        "n_tokens": n + 1,
                        "head_known": np.bincount(doc[known], minlength=b - a) + (ends > 0),
                        "head_sum": np.bincount(doc, log, b - a).astype(float) + math.log10(ends + 1),
                        "below_sum": np.bincount(doc, log * beyond, b - a).astype(float),
                        "n_beyond": np.bincount(doc[beyond], minlength=b - a),
                        "rare": pa.LargeListArray.from_arrays(rare, hashes[~known].view(np.int64)).cast(pa.list_(pa.int64())),
                        "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(2 * bounds), pa.py_buffer(ids)]).cast(pa.binary()),
                    }
                )

    schema = f"id {base.schema['id'].dataType.simpleString()}, training boolean, n_tokens long, head_known long, head_sum double, below_sum double, n_beyond long, rare array<long>, ids binary"
    return base.select("id", "text", "training").mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id())


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from the rows that meet ``training`` (default: all), scores every row's whole text. ``base_score`` is
    the add-one unigram model's log10 probability, ``score`` the recurrent model's, both with an end token after each
    document. Null counts as empty, and an empty text is its end token. Rows are scored one by one, also if they
    repeat another or have no id; rows where ``training`` is null are not learnt from. Without training rows all
    counts are zero. Other columns are ignored. Words are told apart by 64 bits of hash (see word_hash).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"), F.coalesce(F.lit(True) if training is None else training, F.lit(False)).alias("training"))
    learnt = base.filter("training")
    counts = scratch.table(count_words(learnt))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = learnt.count()
    n_all, v_all = (total.n or 0) + ends, total.v + (ends > 0)
    words, c = frequent_words(counts, COUNT_WORDS)
    beyond = int((total.n or 0) - c[:MODEL_WORDS].sum())
    vocabulary = Vocabulary(c[:MODEL_WORDS], ends, beyond)
    table = scratch.table(encoded(base, words, c, ends))
    model = train(table.filter("training"), vocabulary, scratch, rounds) if ends else Gru(vocabulary)
    # Of words beyond the model's, and one more that was never seen.
    tail_norm = math.log10(beyond + total.v - len(c[:MODEL_WORDS]) + 1)
    shared = spark.sparkContext.broadcast((vocabulary, model.flat()))
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = ("id", "n_tokens", "head_known", "head_sum", "below_sum", "n_beyond", "row")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru = Gru(*shared.value)
        for batch in batches:
            data, offsets = binary_column(batch.column("ids"))
            scores = [gru.score(data[offsets[a] : offsets[b]].view(np.uint16), np.diff(offsets[a : b + 1]) // 2) for a, b in _parts(offsets, 2 * TOKENS)]
            yield pa.record_batch({**{k: batch.column(k) for k in plain}, "gru": np.concatenate(scores) if scores else np.zeros(0)})

    schema = f"id {id_type}, n_tokens long, head_known long, head_sum double, below_sum double, n_beyond long, row long, gru double"
    out = table.select(*plain, "ids").mapInArrow(scored, schema)
    rare = table.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("tf"))
    sums = rare.hint("merge").join(counts, "word").groupBy("row").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail_sum"))
    out = out.join(sums, "row", "left").na.fill(0, ["tail_known"]).na.fill(0.0, ["tail_sum"])
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("head_known") + F.col("tail_known")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * math.log10(n_all + v_all + 1)).alias("base_score"),
        (F.col("gru") + F.col("below_sum") + F.col("tail_sum") - F.col("n_beyond") * tail_norm).alias("score"),
    )
