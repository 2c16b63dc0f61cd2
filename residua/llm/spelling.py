"""Spelling variants: words one edit from a word that is at least ten times as frequent.

A word's whole neighbourhood is generated: all distinct deletions, replacements and insertions over the letters that occur. A
candidate that is found in a hash table of the vocabulary is a near word; its distance needs no check. Candidates of
one edit don't travel: an edit lies in one of a word's segments and leaves the others as they are, so words meet by what lies
outside a segment. A key under which too many words meet is split by segments half as long, and so on; where a segment is a single
letter, words of a key differ in that letter only. So a task holds a bounded part of the vocabulary, however many words look alike.

Candidates are rolling hashes, a few array operations for all edits of a segment; equal hashes are compared as words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, parallelism

#: Runs of these are words.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, TIMES, DROP = 7, 2, 10, 31
#: Words that may meet under a key before it is split.
CROWD = 20_000
#: Candidates hashed at once.
AT_ONCE = 1 << 20
FACTOR = 0x9E3779B97F4A7C15


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, of at least min_length code points and min_count occurrences.

    In a run whose checksum with its document's id is divisible by DROP, one letter is left out, as the checksum says. Null
    texts have no words; a null id counts as empty. Rows that repeat an id count each.
    """
    # Shorter runs can't become words.
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.pmod("h", F.lit(DROP)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def hash_powers(n: int) -> np.ndarray:
    """FACTOR^0, ..., FACTOR^n modulo 2^64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(n, FACTOR, np.uint64)], dtype=np.uint64)


def code_points(words: list[str]) -> np.ndarray:
    """(words, length) code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of rows of code points."""
    w = hash_powers(points.shape[1])
    return (points * w[: points.shape[1]][::-1]).sum(1, dtype=np.uint64)


def edits(points: np.ndarray, start: int, end: int, letters: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, hashes, allowed) of all edits in [start, end) of words of one length: deletions (words, places), replacements and
    insertions (words, places, letters). Of edits with the same result one is allowed, so what is allowed is distinct.

    An insertion at a place comes before its letter; one after the last letter belongs to the last segment.
    """
    k, n = points.shape
    w = hash_powers(n + 1)
    place = np.arange(n)
    zero = np.zeros((k, 1), np.uint64)
    # Sums of the first letters where the word becomes one shorter or longer, and of the last ones.
    shorter = np.c_[zero, np.cumsum(points[:, :-1] * w[n - 2 - place[:-1]], 1, dtype=np.uint64)] if n > 1 else zero
    longer = np.c_[zero, np.cumsum(points * w[n - place], 1, dtype=np.uint64)]
    own = points * w[n - 1 - place]
    rest = np.c_[np.cumsum(own[:, ::-1], 1, dtype=np.uint64)[:, ::-1], zero]
    whole = rest[:, :1]
    at = np.arange(start, end)
    repeats = np.c_[np.zeros((k, 1), bool), points[:, 1:] == points[:, :-1]]
    yield "deletion", shorter[:, at] + rest[:, at + 1], ~repeats[:, at]
    change = (letters[None, None, :] - points[:, at, None]) * w[n - 1 - at][None, :, None]
    yield "replacement", whole[:, :, None] + change, letters[None, None, :] != points[:, at, None]
    into = np.arange(start, end + (end == n))
    before = np.c_[np.zeros((k, 1), np.uint64), points][:, into]  # no letter is zero
    yield "insertion", (longer[:, into] + rest[:, into])[:, :, None] + letters[None, None, :] * w[n - into][None, :, None], letters[None, None, :] != before[:, :, None]


def edited(word: str, kind: str, at: int, letter: str) -> str:
    return word[:at] + ("" if kind == "deletion" else letter) + word[at + (kind != "insertion") :]


class Vocabulary:
    """A hash table of words: a bitmap says of most others that they aren't there."""

    def __init__(self, words: list[str], counts: list[int]):
        self.counts = dict(zip(words, counts))
        hashes = [np.zeros(0, np.uint64)]
        for n, some in by_length(list(self.counts)).items():
            hashes += [word_hashes(code_points(some[at : at + max(1, AT_ONCE // max(1, n))])) for at in range(0, len(some), max(1, AT_ONCE // max(1, n)))]
        self.hashes = np.unique(np.concatenate(hashes))
        self.shift = np.uint64(64 - max(10, min(27, int(len(self.hashes) * 16).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.hashes >> self.shift] = True

    def found(self, hashes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
        """Indices of allowed candidates whose hash is in the table."""
        hit = np.nonzero(self.bits[hashes >> self.shift] & allowed)
        h = hashes[hit]
        known = self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h
        return tuple(x[known] for x in hit)


def by_length(words: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def near_words(words: list[str], start: list[int], end: list[int], known: Vocabulary, letters: str) -> Iterator[tuple[str, str]]:
    """(word, near word) of the words' edits within their segments."""
    points = np.array([ord(c) for c in letters], np.uint64)
    groups: dict[tuple[int, int, int], list[str]] = {}
    for w, s, e in zip(words, start, end):
        groups.setdefault((len(w), s, e), []).append(w)
    for (n, s, e), some in groups.items():
        width = max(1, AT_ONCE // max(1, len(letters)))  # of a long word's segment, so many places at once
        for lo in range(s, e, width):
            hi = min(e, lo + width)
            step = max(1, AT_ONCE // max(n, (hi - lo) * len(letters)))
            for k in range(0, len(some), step):
                batch = some[k : k + step]
                for kind, hashes, allowed in edits(code_points(batch), lo, hi, points):
                    hit = known.found(hashes, allowed)
                    for row, at, *letter in zip(*(x.tolist() for x in hit)):
                        near = edited(batch[row], kind, lo + at, letters[letter[0]] if letter else "")
                        if near in known.counts:
                            yield batch[row], near


def _keyed(rows: DataFrame, segment: str, level: int) -> DataFrame:
    """rows (word, n, of) with the segment's bounds in words of length ``of`` and a key of all that lies outside of it.

    Level k cuts a word into 2^k segments; empty ones have no rows.
    """
    cuts = rows.withColumn("segment", F.expr(segment)).withColumns({"s": F.expr(f"int(bigint(segment) * of div {1 << level})"), "e": F.expr(f"int(bigint(segment + 1) * of div {1 << level})")}).filter("e > s")
    outside = [F.substring("word", F.lit(1), F.col("s")), F.expr("right(word, int(of - e))")]
    return cuts.select("word", "n", "size", "of", "segment", "s", "e", F.xxhash64(F.col("of"), F.lit(level), F.col("segment"), *outside).alias("key"))


def spelling_variants(counts: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """(word, n) with distinct words to (word, form, root, n, n_near, form_n).

    Near words differ by one inserted, deleted or replaced code point; n_near counts them. A word's form is the near one of largest n, of
    equal ones the first in code-point order, if its n is ``times`` the word's own or more; else null. The root follows forms to the
    last. Words may be of any length from 1; an empty table gives an empty one.
    """
    spark = counts.sparkSession
    scratch = Scratch(spark)
    words = scratch.table(counts.select("word", "n"))
    # As many as the words' letters, which are runs of an alphabet.
    letters = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()))
    # A word meets words of its own length, of one less and of one more; `of` is the length of the word that is edited.
    roles = words.withColumn("size", F.char_length("word")).withColumn("of", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).filter("of > 0").select("word", "n", "size", "of")
    level, final = 1, None
    rows = _keyed(roles, "explode(array(0, 1))", level)
    while True:
        crowded = scratch.table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("e") - F.col("s")).alias("width")).filter((F.col("k") > crowd) & (F.col("width") > 1)).select("key"))
        if crowded.isEmpty():
            final = rows if final is None else final.unionByName(rows)
            break
        calm = rows.join(crowded, "key", "left_anti")
        final = calm if final is None else final.unionByName(calm)
        level += 1
        rows = scratch.table(_keyed(rows.join(crowded, "key", "left_semi").select("word", "n", "size", "of", F.col("segment").alias("up")), "explode(array(2 * up, 2 * up + 1))", level))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def look(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            known = Vocabulary(pdf["word"].tolist(), pdf["n"].tolist())
            edit = pdf[pdf["size"] == pdf["of"]]
            best: dict[str, tuple[int, int, str]] = {}
            # Words of other keys are in the table too: what is found is a word all the same, and found once.
            for word, near in near_words(edit["word"].tolist(), edit["s"].tolist(), edit["e"].tolist(), known, letters):
                have = best.get(word)
                one = (-known.counts[near], near)
                best[word] = (1, *one) if have is None else (have[0] + 1, *min(have[1:], one))
            if best:
                yield pd.DataFrame({"word": list(best), "n_near": [b[0] for b in best.values()], "form_n": [-b[1] for b in best.values()], "form": [b[2] for b in best.values()]})

        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            whole = int((rest["key"] != rest["key"].iloc[-1]).sum())  # the last key may go on
            if whole >= 16384:
                yield from look(rest.iloc[:whole])
                rest = rest.iloc[whole:].reset_index(drop=True)
        if rest is not None:
            yield from look(rest)

    final = final.select("key", "word", "n", "size", "of", "s", "e").repartition(parallelism(spark), "key").sortWithinPartitions("key")
    found = final.mapInPandas(meet, "word string, n_near long, form_n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("k"), "form")).alias("b"))
    near = scratch.table(best.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.k")).alias("form_n")))
    formed = scratch.table(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(F.col("form_n") >= times * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n"))))
    roots = last_forms(formed.filter("form is not null").select("word", "form"), scratch)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form) to (word, root): each step doubles how far a word looks; counts grow along a chain, so it ends."""
    now = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = scratch.table(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return now
