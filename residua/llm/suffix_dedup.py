"""Suffix-array dedup of byte strings: a distributed merge sort of suffixes that knows common prefixes.

Not every byte's suffix is sorted. Each window of ``window`` bytes has a key, the smallest hash of its grams
(see anchors); the suffixes that are sorted start where such a gram stands, and a count-min sketch has shown
before that the gram may stand twice. Equal windows hold the same gram at the same place, so none is
missed. A record is such a suffix as far as the windows around its gram reach, followed by what they reach to the left.

Every task sorts its records into a run, front-coded. Runs are cut at sampled splitters and exchanged; each
range is merged by a loser tree that skips known prefixes. Equal neighbours are the same run of windows: all
but the earliest go whole. Neighbours that share the gram only are compared window by window, in the task that
has merged them; for a gram at the edge of a range, whose neighbours may be in the next one, firsts are
grouped over all ranges.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import covered, key_runs, mixed, prefix_sums, sliding_min, span_hash
from .common import Scratch, as_text, text_of
from .merge_sort import front_coded, front_decoded, merge
from .sketch import prefilter

WINDOW = 100
#: Windows of a record, records of a run and of a block.
RECORD_WINDOWS, RUN_RECORDS, BLOCK_RECORDS = 128, 100_000, 1000
#: Records of a range, about; sampled block heads (four a range at least) and their bytes, which bound what is collected.
RANGE_RECORDS, SAMPLE, HEAD = 60_000, 200_000, 64
#: Distinct records of one gram that a task compares at once.
GROUP_RECORDS = 10_000
#: Bytes that are worked on at once.
SEGMENT = 1 << 20
_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams_and_keys(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the gram at each byte, key of the window at each byte."""
    gram = window // 2
    sums = prefix_sums(_SYMBOLS[data], 0)
    at = np.arange(len(data) - gram + 1)
    g = mixed(span_hash(sums, at, at + gram, 0))
    return g, sliding_min(g, window - gram + 1)


def segments(text: bytes, window: int) -> Iterator[tuple[int, np.ndarray]]:
    a = np.frombuffer(text, np.uint8)
    for at in range(0, len(a) - window + 1, SEGMENT):
        yield at, a[at : at + SEGMENT + window - 1]


def selected_keys(text: bytes, window: int) -> np.ndarray:
    """The hash of every gram that is the smallest of some window, as often as it stands in the text."""
    out = []
    for _, a in segments(text, window):
        g, keys = grams_and_keys(a, window)
        reach = window - window // 2
        # A gram is selected if the largest key of the windows around it is its own hash.
        padded = np.concatenate([np.zeros(reach, np.uint64), keys, np.zeros(reach, np.uint64)])
        out.append(g[~sliding_min(~padded, reach + 1)[: len(g)] == g])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def records(text: bytes, window: int, twice) -> Iterator[tuple[bytes, int, int, bool]]:
    """(string, start, windows, may repeat itself) of the runs of windows whose key twice() lets pass.

    The string is text from the gram on, then text before the gram, then the gram's place in two bytes.
    """
    gram = window // 2
    for base, a in segments(text, window):
        g, keys = grams_and_keys(a, window)
        starts, counts = key_runs(keys, RECORD_WINDOWS)
        may = twice(keys[starts])
        if not may.any():
            continue
        part = a.tobytes()
        for s, n in zip(starts[may].tolist(), counts[may].tolist()):
            same = g[s : s + n + window - gram] == keys[s]
            m = int(same.argmax())
            end = s + n + window - 1
            yield part[s + m : end] + part[s : s + m] + struct.pack(">H", m), base + s, n, int(same.sum()) > 1


def windows_of(string: bytes, n: int, window: int) -> Iterator[bytes]:
    (m,) = struct.unpack(">H", string[-2:])
    right = len(string) - 2 - m
    text = string[right:-2] + string[:right]
    return (text[i : i + window] for i in range(n))


_BLOCK = "lcp binary, size binary, rests binary, ids array<{id}>, at binary, n binary, own binary"


def _block(part: list[tuple]) -> dict:
    lcp, size, rests = front_coded([r[0] for r in part])
    return {"lcp": lcp.astype("<u2").tobytes(), "size": size.astype("<u2").tobytes(), "rests": rests, "ids": [r[1] for r in part], "at": np.array([r[2] for r in part], "<i8").tobytes(), "n": np.array([r[3] for r in part], "<u2").tobytes(), "own": np.array([r[4] for r in part], "u1").tobytes()}


def _unblock(row) -> Iterator[tuple]:
    """(string, id, start, n, own) of a block."""
    strings = front_decoded(np.frombuffer(row.lcp, "<u2"), np.frombuffer(row.size, "<u2"), row.rests)
    ids = row.ids.tolist() if hasattr(row.ids, "tolist") else row.ids
    return zip(strings, ids, np.frombuffer(row.at, "<i8").tolist(), np.frombuffer(row.n, "<u2").tolist(), np.frombuffer(row.own, "u1").tolist())


class _Hits:
    """Removed windows on their way out, neighbours joined."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, key, start: int, n: int) -> None:
        last = self.rows[-1] if self.rows else None
        if last and last[0] == key and last[1] + last[2] == start:
            self.rows[-1] = (key, last[1], last[2] + n)
        else:
            self.rows.append((key, start, n))

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=["id", "start", "n"])
        self.rows = []
        return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary: what remains of the text).

    A byte of the UTF-8 text goes if a string of ``window`` bytes covers it that also starts earlier: in a document of
    smaller id, or before in the same one. Strings are judged on the input and never cross documents; spans are
    maximal runs of removed bytes. Null counts as empty. Ids are taken as unique; rows that repeat id and text are the same
    document and have the same result. Rows without an id are compared with nothing and stay whole. An
    empty table gives an empty table; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    named = base.filter(F.col("id").isNotNull())
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    gram = window // 2
    named, filtered = prefilter(named, lambda t: selected_keys(t, window), 2 * total / (window - gram + 2), scratch)
    block = _BLOCK.format(id=id_type)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted runs in blocks; of equal records of a run only the earliest is sent on."""

        def flush(found: list[tuple]) -> Iterator[pd.DataFrame]:
            found.sort(key=lambda r: r[:3])
            first, gone, last = [], [], None
            for r in found:
                if r[0] != last:
                    first.append(r)
                    last = r[0]
                elif r[1:3] != first[-1][1:3]:
                    gone.append(r)
            run = TaskContext.get().partitionId() << 32 | next(numbers)
            for k in range(0, len(first), BLOCK_RECORDS):
                part = first[k : k + BLOCK_RECORDS]
                yield pd.DataFrame([{"run": run, "seq": k, "head": part[0][0], **_block(part), "gone_ids": [], "gone_at": b"", "gone_n": b""}])
            for k in range(0, len(gone), 100_000):
                part = gone[k : k + 100_000]
                yield pd.DataFrame([{"run": run, "seq": -1, "head": None, **_block([]), "gone_ids": [r[1] for r in part], "gone_at": np.array([r[2] for r in part], "<i8").tobytes(), "gone_n": np.array([r[3] for r in part], "<u2").tobytes()}])

        found: list[tuple] = []
        numbers = count()
        for pdf in batches:
            for key, text, shared in zip(pdf["id"].tolist(), pdf["text"], pdf["shared"]):
                found += [(s, key, at, n, own) for s, at, n, own in records(text, window, filtered.of(shared))]
                if len(found) >= RUN_RECORDS:
                    yield from flush(found)
                    found = []
        if found:
            yield from flush(found)

    runs = scratch.table(named.mapInPandas(sort, f"run long, seq long, head binary, {block}, gone_ids array<{id_type}>, gone_at binary, gone_n binary"))
    blocks = runs.filter("seq >= 0")
    n_blocks = blocks.count()
    n_ranges = max(1, min(n_blocks * BLOCK_RECORDS // RANGE_RECORDS, SAMPLE // 4))
    heads = sorted(bytes(r.head) for r in blocks.select(F.expr(f"substring(head, 1, {HEAD})").alias("head")).orderBy(F.xxhash64("run", "seq")).limit(SAMPLE).collect())
    splitters = [heads[len(heads) * k // n_ranges] for k in range(1, n_ranges)] if heads else []

    def cut_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                parts: dict[int, list[tuple]] = {}
                for r in _unblock(row):
                    parts.setdefault(bisect_right(splitters, r[0]), []).append(r)
                for k, part in parts.items():
                    yield pd.DataFrame([{"range": k, "run": row.run, "seq": row.seq, **_block(part)}])

    dealt = blocks.select("run", "seq", *[c.split()[0] for c in block.split(", ")]).mapInPandas(cut_blocks, f"range int, run long, seq long, {block}").repartition(n_ranges, "range").sortWithinPartitions("range", "run", "seq")

    def merge_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run_of(rows: list) -> Iterator[tuple[int, bytes, object]]:
            last = None
            for row in rows:
                lcps = np.frombuffer(row.lcp, "<u2").tolist()
                for lcp, (s, *rest) in zip(lcps, _unblock(row)):
                    if last is not None and lcp == 0:  # a block starts anew
                        n = min(len(s), len(last))
                        while lcp < n and s[lcp] == last[lcp]:
                            lcp += 1
                    last = s
                    yield lcp, s, rest

        def one_range(by_run: dict[int, list]) -> Iterator[pd.DataFrame]:
            hits, edge = _Hits(), []
            group: list[list] = []  # [string, id, start, n, own] of the distinct records of one gram, earliest of each
            first_group, split = True, False

            def edges_out() -> Iterator[pd.DataFrame]:
                for k in range(0, len(edge), 50_000):
                    yield pd.DataFrame(edge[k : k + 50_000], columns=["w", "id", "start"])
                edge.clear()

            def resolve(at_edge: bool) -> None:
                if not group or len(group) == 1 and not group[0][4] and not at_edge:
                    return
                least: dict[bytes, tuple] = {}
                for s, key, start, n, _ in group:
                    for i, w in enumerate(windows_of(s, n, window)):
                        if (have := least.get(w)) is None or (key, start + i) < have:
                            least[w] = (key, start + i)
                for s, key, start, n, _ in group:
                    for i, w in enumerate(windows_of(s, n, window)):
                        if least[w] != (key, start + i):
                            hits.add(key, start + i, 1)
                if at_edge:
                    edge.extend((xxhash.xxh3_128_digest(w), key, at) for w, (key, at) in least.items())

            for lcp, s, (key, start, n, own) in merge([run_of(rows) for rows in by_run.values()]):
                if group and lcp == len(s) == len(group[-1][0]):
                    best = group[-1]
                    if (key, start) < (best[1], best[2]):
                        hits.add(best[1], best[2], best[3])
                        best[1], best[2] = key, start
                    elif (key, start) != (best[1], best[2]):
                        hits.add(key, start, n)
                    continue
                if (group or split) and lcp < gram:
                    resolve(first_group or split)
                    first_group = split = False
                    group = []
                group.append([s, key, start, n, own])
                if len(group) >= GROUP_RECORDS:  # a gram of very many texts: parts of it meet as ranges do
                    resolve(True)
                    group, split = [], True
                if len(hits.rows) > 50_000:
                    yield hits.frame()
                if len(edge) > 200_000:
                    yield from edges_out()
            resolve(True)
            if hits.rows:
                yield hits.frame()
            yield from edges_out()

        def shaped(frame: pd.DataFrame) -> pd.DataFrame:
            if "w" not in frame:
                frame["w"] = None
            if "n" not in frame:
                frame["n"] = 1
            return frame[["id", "start", "n", "w"]]

        now, by_run = None, {}
        for pdf in batches:
            for row in pdf.itertuples():
                if row.range != now:
                    if by_run:
                        yield from map(shaped, one_range(by_run))
                    now, by_run = row.range, {}
                by_run.setdefault(row.run, []).append(row)
        if by_run:
            yield from map(shaped, one_range(by_run))

    merged = scratch.table(dealt.mapInPandas(merge_ranges, f"id {id_type}, start long, n long, w binary"))

    def gone_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                yield pd.DataFrame({"id": row.gone_ids, "start": np.frombuffer(row.gone_at, "<i8"), "n": np.frombuffer(row.gone_n, "<u2").astype("i8")})

    edges = merged.filter("w is not null")
    least = edges.groupBy("w").agg(F.min(F.struct("id", "start")).alias("least"), F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    at_edges = edges.hint("merge").join(least, "w").filter(F.struct("id", "start") > F.col("least")).select("id", "start", "n")
    in_runs = runs.filter("seq < 0").select("gone_ids", "gone_at", "gone_n").mapInPandas(gone_rows, f"id {id_type}, start long, n long")
    hits = merged.filter("w is null").select("id", "start", "n").unionByName(at_edges).unionByName(in_runs)
    by_doc = hits.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, gone in zip(pdf["text"], pdf["gone"]):
                if gone is None or not len(gone):
                    out.append((len(text), 0, 0, text))
                    continue
                a = np.array([(s["start"], s["n"]) for s in gone], np.int64)
                off = covered(len(text), a[:, 0], a[:, 1], window)
                spans = int(np.count_nonzero(np.diff(off.astype(np.int8), prepend=0) == 1))
                out.append((len(text), int(off.sum()), spans, np.frombuffer(text, np.uint8)[~off].tobytes()))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            frame.insert(0, "id", pdf["id"])
            yield frame

    out = as_text(base.join(by_doc, "id", "left")).mapInPandas(cut, "id string, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
