"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is a pair of polynomial hashes over its bytes, modulo two primes. The hash of two
joined byte strings follows from their hashes: ``H(ab) = H(a) * B^len(b) + H(b)``. So a chunk can be
hashed anywhere: a text within ``parallel_bytes`` is hashed chunk by chunk in the task that read it, a
longer one is cut into chunk rows that are dealt to all tasks and combined afterwards. Both ways give the
same number.

Equal fingerprints are a claim, not a proof: members are then compared with the group's first row, chunk
by chunk, in a join of chunks. A row that differs (a collision) is grouped again by its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, text_of

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525737)
#: Of these bytes a dot product with powers below 2^31 stays below 2^63.
CHUNK = 1 << 16


def powers(n: int, which: int) -> np.ndarray:
    """B^(n-1), ..., B, 1 modulo the prime."""
    out = np.empty(n, np.int64)
    p, b, m = 1, BASES[which], PRIMES[which]
    for i in range(n - 1, -1, -1):
        out[i] = p
        p = p * b % m
    return out


_powers: dict[int, np.ndarray] = {}


def chunk_hash(data: bytes | memoryview, which: int) -> int:
    """The hash of at most CHUNK bytes."""
    if which not in _powers:
        _powers[which] = powers(CHUNK, which)
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    a += 1
    return int(a @ _powers[which][CHUNK - len(a) :]) % PRIMES[which] if len(a) else 0


def combine(left: int, right: int, right_bytes: int, which: int) -> int:
    """The hash of two joined byte strings from their hashes."""
    return (left * pow(BASES[which], right_bytes, PRIMES[which]) + right) % PRIMES[which]


def fingerprint(data: bytes) -> int:
    """The 62-bit fingerprint of a byte string of any length."""
    view, out = memoryview(data), 0
    for which in (0, 1):
        h = 0
        for at in range(0, len(data), CHUNK):
            piece = view[at : at + CHUNK]
            h = combine(h, chunk_hash(piece, which), len(piece), which)
        out = out << 31 | h
    return out


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([fingerprint(x) for x in s], dtype="int64")


def _chunk_hashes(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in chunks:
        yield pd.DataFrame(
            {f"h{w + 1}": [chunk_hash(x, w) for x in s] for w in (0, 1)}
            | {f"p{w + 1}": [pow(BASES[w], len(x), PRIMES[w]) for x in s] for w in (0, 1)}
        )


def normalised(text_col: str) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text_of(text_col), SPACES, " ")


def fingerprints(texts: DataFrame, parallel_bytes: int) -> DataFrame:
    """(id, text binary, sha) to (id, n, fp, sha); texts above parallel_bytes go as chunk rows to all tasks."""
    n = F.octet_length("text").cast("long")
    small = texts.filter(n <= parallel_bytes).select("id", n.alias("n"), F.pandas_udf(_fingerprints, "long")("text").alias("fp"), "sha")
    chunks = (
        texts.filter(n > parallel_bytes)
        .withColumn("n", n)
        .select("id", "n", "sha", "text", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")).alias("k"))
        .select("id", "n", "sha", "k", F.expr(f"substring(text, cast(k * {CHUNK} + 1 as int), {CHUNK})").alias("piece"))
        .repartition("id", "sha", "k")
        .select("id", "n", "sha", "k", F.pandas_udf(_chunk_hashes, "h1 long, h2 long, p1 long, p2 long")("piece").alias("h"))
        # Rows that repeat id and text have the same chunks: they are combined once and come back as often as they were.
        .groupBy("id", "n", "sha", "k")
        .agg(F.first("h").alias("h"), F.count(F.lit(1)).alias("copies"))
        .groupBy("id", "n", "sha")
        .agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("hs"), F.max("copies").alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    )

    def joined(which: int) -> Column:
        return F.aggregate(
            "hs", F.lit(0).cast("long"), lambda a, x: F.pmod(a * x["h"][f"p{which + 1}"] + x["h"][f"h{which + 1}"], F.lit(PRIMES[which]))
        )

    return small.unionByName(chunks.select("id", "n", (F.shiftleft(joined(0), 31).bitwiseOR(joined(1))).alias("fp"), "sha"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parallel_bytes: int = 4 * CHUNK) -> DataFrame:
    """Groups documents whose texts are equal after white space runs became one space.

    Returns one row per document: the id column, ``keep_id`` (smallest id of its group), ``group_size``,
    ``kept`` (it is that row) and ``text_sha256`` of the normalised text. Null text counts as empty, and
    empty texts are equal to each other. Ids are taken as unique; a row that repeats id and text is one more
    member of its group and has the same verdict. A row without an id can't be named by another row:
    it is kept, in a group of its own. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    all_texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("text"))
    no_id = all_texts.filter(F.col("id").isNull()).select(
        "id", F.lit(None).cast(all_texts.schema["id"].dataType).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("text", 256).alias("sha")
    )
    texts = all_texts.filter(F.col("id").isNotNull()).select("id", F.col("text").cast("binary").alias("text"), F.sha2("text", 256).alias("sha"))

    fps = scratch.table(fingerprints(texts, parallel_bytes))
    firsts = fps.groupBy("fp", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))
    claims = scratch.table(fps.hint("merge").join(firsts, ["fp", "n"]).select("id", "fp", "n", "rep", "members", "sha"))

    # Texts of the rows that are not alone, to be compared with their group's first.
    shared = scratch.table(
        texts.join(claims.filter("members > 1").select("id", "fp", "n", "rep", "sha").distinct(), ["id", "sha"]).select("id", "fp", "n", "rep", "sha", "text")
    )
    pieces = shared.select("id", "fp", "n", "rep", "text", F.explode(F.expr(f"sequence(0L, greatest(n - 1, 0L) div {CHUNK})")).alias("k")).select(
        "id", "fp", "n", "rep", "k", F.expr(f"substring(text, cast(k * {CHUNK} + 1 as int), {CHUNK})").alias("piece")
    )
    first_pieces = pieces.filter("id = rep").groupBy("fp", "n", "k").agg(F.min("piece").alias("first_piece"))
    differ = (
        pieces.filter("id <> rep")
        .hint("merge")
        .join(first_pieces, ["fp", "n", "k"])
        .filter("piece <> first_piece")
        .select("id", "fp", "n")
        .distinct()
    )
    # Collisions, if there ever are any: grouped by the text itself.
    collided = shared.join(differ, ["id", "fp", "n"])
    own = collided.groupBy("fp", "n", "sha", "text").agg(F.min("id").alias("own_keep")).select("fp", "n", "sha", "own_keep")
    moved = collided.select("id", "fp", "n", "sha").distinct().join(own, ["fp", "n", "sha"]).select("id", "sha", "own_keep")
    verdict = claims.join(moved, ["id", "sha"], "left").select("id", F.coalesce("own_keep", "rep").alias("keep_id"), "sha")
    verdict = scratch.table(verdict)
    scratch.drop(fps, claims, shared)
    sizes = verdict.groupBy("keep_id", "sha").agg(F.count(F.lit(1)).alias("group_size"))
    out = verdict.hint("merge").join(sizes, ["keep_id", "sha"]).select("id", "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), "sha")
    return out.unionByName(no_id).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
