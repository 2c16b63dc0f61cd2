"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

A piece goes to the open sequence, or to a new one, after which the squared counts of open sequences per
residual gap add up to least. That keeps gaps varied, so that later pieces find one that fits them. Pieces
are dealt by hash to shards of bounded size, each packed longest first. What a shard leaves badly filled is
packed again together with what other shards left, until the rest fits one shard.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_text, text_of

SEQUENCE, END_ID = 4096, 1
#: Pieces of a shard on average; a shard's result is refilled where a sequence keeps a larger gap than this part of it.
SHARD_PIECES, LOOSE = 8192, 1 / 64
#: Cached words, and cached pre-tokens, of a worker, about 200 bytes each.
CACHE = 800_000

#: Characters for which Python's rules and the tokenizer's agree: no combining marks, no numbers but ASCII digits, no exotic spaces.
_PLAIN = re.compile(r"[\t-\r -~¡-±´-¸º»¿-įĲ-ſ]*\Z")
_PRETOKENS = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pretokens(dict):
    """Pre-token to its ids as little-endian bytes; a missing one is encoded by the tokenizer's own merges."""

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def encode(self, piece: str) -> bytes:
        letters = self.letters
        return np.array([t.id for t in self.model.tokenize("".join([letters[b] for b in piece.encode()]))], "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        got = self[piece] = self.encode(piece)
        return got


#: The normaliser and pre-tokenizer for which words are encoded one by one. With any other a text is encoded whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordIds(dict):
    """Word to its ids. Text between white space is encoded on its own, so a text's ids are its words' ids in a row.

    A word of plain characters goes pre-token by pre-token, any other, or one with an added token, to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.by_word = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER and made["model"]["type"] == "BPE" and not made["model"]["dropout"]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pretokens = Pretokens(self.tokenizer.model)

    def __missing__(self, key: bytes) -> bytes:
        word = key.decode()
        if _PLAIN.match(word) and not any(t in word for t in self.added):
            pieces = _PRETOKENS.findall(word.lower())
            # What is a word by itself is cached as that only.
            got = b"".join([self.pretokens[x] for x in pieces]) if len(pieces) > 1 else b"".join([self.pretokens.get(x) or self.pretokens.encode(x) for x in pieces])
        else:
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[key] = got
        return got

    def encode(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8."""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        for cache in (self, self.pretokens):
            if len(cache) > CACHE:
                cache.clear()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids, then end_id, cut where longer than size."""

    def udf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], "<u4").tobytes()
        encode = word_ids(tokenizer_path).encode
        for pdf in batches:
            out = []
            for key, text in zip(pdf["id"], pdf["text"]):
                data = encode(text) + end
                for k, at in enumerate(range(0, len(data), size * 4)):
                    part = data[at : at + size * 4]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), *((part,) if keep_ids else ())))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", *(("ids",) if keep_ids else ())])

    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    schema = "id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return as_text(base).mapInPandas(udf, schema).withColumn("id", F.col("id").cast(base.schema["id"].dataType))


def pack_shard(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs pieces in order of falling length; returns each piece's sequence and offset, and each sequence's gap."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)  # of open sequences by gap; gap 0 isn't open and stays 0
    gaps: list[int] = []
    far = np.iinfo(np.int64).max
    for i in order.tolist():
        n = int(lengths[i])
        # Moving a sequence from gap g to g - n changes the sum of squares by 2 (count[g-n] - count[g]) + 2, or less 1 if it fills up.
        change = np.where(count[n:size] > 0, 2 * (count[: size - n] - count[n:size]) + 2, far)
        if n < size and change[0] != far:
            change[0] -= 1
        k = int(change.argmin()) if len(change) else -1
        fresh = 2 * int(count[size - n]) + 1 if n < size else 0
        if k >= 0 and change[k] != far and change[k] <= fresh:
            g = n + k
            b = open_at[g].pop()
            count[g] -= 1
        else:
            g, b = size, len(gaps)
            gaps.append(size)
        where[i], offset[i] = b, size - g
        gaps[b] = g - n
        if g > n:
            open_at[g - n].append(b)
            count[g - n] += 1
    return where, offset, np.array(gaps, np.int64)


def _shard_key(shards: int, salt: int):
    return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(shards)).cast("int")


def pack_pieces(pieces: DataFrame, scratch: Scratch, size: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(row, length), row unique, to (row, sequence_id, offset).

    Level 0 packs all pieces in shards. Sequences left loose are dissolved and their pieces go to the next
    level, which has fewer of them and so fewer shards, until a level has one shard. A level that leaves nearly all
    of its pieces loose (pieces of which no two fit together, say) is the last one too, and its sequences stay as they are.
    """
    todo = pieces.select("row", "length")
    n = todo.count()
    done: list[DataFrame] = []
    level = 0
    while n:
        shards = -(-n // shard_pieces)
        last = shards == 1
        base = level << 56  # shards stay below 2^24, sequences of a shard below 2^32

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "row"], ignore_index=True)
            where, offset, gap = pack_shard(pdf["length"].to_numpy(), size)
            loose = (gap > size * LOOSE)[where] if not last else np.zeros(len(pdf), bool)
            ids = base + (int(pdf["shard"].iloc[0]) << 32) + where
            return pdf[["row", "length"]].assign(sequence_id=ids, offset=offset, loose=loose)

        packed = todo.withColumn("shard", _shard_key(shards, level)).groupBy("shard").applyInPandas(pack, "row long, length long, sequence_id long, offset long, loose boolean")
        packed = scratch.table(packed)
        todo, before = packed.filter("loose").select("row", "length"), n
        n, level = todo.count(), level + 1
        last = n > before * 0.9
        done.append(packed.filter(F.lit(last) | ~F.col("loose")).select("row", "sequence_id", "offset"))
        if last:
            break
    out = done[0] if done else pieces.select("row", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids (little-endian).

    A text's ids are followed by end_id; only what is longer than ``size`` is cut. Null and empty texts are one
    piece, the end id. Every row is a document of its own, also if it repeats another or has no id. An empty
    table gives an empty table; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = token_pieces(base, tokenizer_path, "id", "text", size, end_id, keep_ids)
    pieces = scratch.table(pieces.withColumn("row", F.monotonically_increasing_id()))
    out = pieces.join(pack_pieces(pieces, scratch, size), "row")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(("ids",) if keep_ids else ()))
