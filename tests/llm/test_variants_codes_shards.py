"""Operators 11 to 13 against plain versions, and on nulls, ties, repeated rows, long words, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from residua.llm import sharding, spelling, vector_codes

# 11


def plain_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, times=10):
    forms, out = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w] = (len(near), best if near and n[best] >= times * n[w] else None)
    for w in n:
        root = w
        while forms[root][1] is not None:
            root = forms[root][1]
        form = forms[w][1]
        out[w] = (form, root, n[w], forms[w][0], n[form] if form else None)
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(7, 12))) for _ in range(30)]
    texts = []
    for w in base:
        texts += [w] * rng.choice((2, 20, 250))
        for _ in range(12):
            i = rng.randint(0, len(w))
            c = rng.choice("abcdeéßz")
            texts += [rng.choice((w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]))] * rng.choice((1, 2, 3, 25))
    texts += ["AAAAAAAA"] * 30 + ["aaaaaaa", "aaaaaaaaa"] * 2 + ["short"] * 5 + ["bbbbbbbb", "Bbbbbbbc"] * 2 + ["x" * 3000] * 2 + ["x" * 3001] * 40
    texts += ["résumés÷×", "RÉSUMÉS"] * 2
    rng.shuffle(texts)
    rows = [(i // 3, " ".join(texts[i : i + 4])) for i in range(0, len(texts), 4)]
    return rows + [(900, None), (901, ""), (None, "nullidword nullidword"), (902, "1234567 -- 中文")]


def test_spelling_variants(spark, spelled):
    docs = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in spelled], "doc_id long, text string, word string, n long, key string")
    counts = spelling.word_counts(docs)
    want = plain_counts(spelled)
    assert {r.word: r.n for r in counts.collect()} == want
    expected = plain_variants(want)
    assert any(e[1] not in (w, e[0]) for w, e in expected.items())  # a chain of forms
    for crowd in (spelling.CROWD, 6):  # the second splits keys down to letters
        out = spelling.spelling_variants(counts, crowd=crowd)
        assert {r.word: tuple(r)[1:] for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()} == expected


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(docs)).collect() == []
    alone = spark.createDataFrame([("lonesome", 3)], "word string, n long")
    assert [tuple(r) for r in spelling.spelling_variants(alone).collect()] == [("lonesome", None, "lonesome", 3, 0, None)]


def test_edits_are_the_whole_neighbourhood():
    rng = random.Random(7)
    letters = np.array([ord(c) for c in "abé"], np.uint64)
    for n in (1, 2, 7, 9):
        words = ["".join(rng.choice("abé") for _ in range(n)) for _ in range(20)]
        points = spelling.code_points(words)
        for cuts in ([0, n], [0, n // 2, n], list(range(n + 1))):
            made = [Counter() for _ in words]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    for kind, hashes, allowed in spelling.edits(points, s, e, letters):
                        for hit in zip(*np.nonzero(allowed)):
                            word = spelling.edited(words[hit[0]], kind, s + int(hit[1]), "abé"[hit[2]] if len(hit) > 2 else "")
                            made[hit[0]][word] += 1
                            assert not word or spelling.word_hashes(spelling.code_points([word]))[0] == hashes[hit]
            for w, got in zip(words, made):
                want = {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + c + w[i + 1 :] for i in range(n) for c in "abé"} | {w[:i] + c + w[i:] for i in range(n + 1) for c in "abé"}
                assert set(got) == want - {w} and set(got.values()) == {1}


# 12


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    width = len(whole[0]) // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(row[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for row in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            members = {}
            for row, code in zip(cut, codes):
                members.setdefault(code[p][1], []).append(row[p])
            for j, rows_of in members.items():
                books[p][j] = [sum(c) // len(rows_of) for c in zip(*rows_of)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [(kept[k][0], bytes(c[1] for c in code), sum(c[0] for c in code), kept[k][2]) for k, code in enumerate(assign())]
    return found, digest


def vectors(n, width=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    return [(int(i), (centres[i % 9] + 0.3 * rng.normal(size=width)).astype(np.float32).tolist(), int(i % 5)) for i in rng.permutation(n)]


KIND = "vec_id long, embedding array<float>, label int, code string, part int, whole string"


def test_vector_codes(spark):
    rows = vectors(300)
    zero = [0.0] * 32
    rows += [(400, zero, None), (400, zero, None), (401, zero, 3), (7, rows[0][1], 2), (None, rows[1][1], 2)]
    rows += [(-5, None, 1), (-4, [None, *zero[1:]], 1), (-3, [float("nan"), *zero[1:]], 1), (-2, [float("inf"), *zero[1:]], 1), (-1, [], 1)]
    want, digest = plain_codes(rows)
    df = spark.createDataFrame([(*r, "c", 1, "x") for r in rows], KIND).repartition(3)
    out = vector_codes.label_errors(vector_codes.vector_codes(df)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, bytes(r.code), r.error, r.label) for r in out), key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in out} == {digest}
    sums = Counter()
    for _, _, e, lab in want:
        sums[lab] += e
    assert all(r.label_error == sums[r.label] for r in out)


def test_vector_codes_few_and_none(spark):
    few = vectors(10, seed=4)
    want, digest = plain_codes(few)
    out = vector_codes.vector_codes(spark.createDataFrame([(*r, "c", 1, "x") for r in few], KIND)).collect()
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in out) == sorted(w[:3] for w in want) and out[0].codebooks_sha256 == digest
    empty = vector_codes.label_errors(vector_codes.vector_codes(spark.createDataFrame([(1, None, 1, "c", 1, "x")], KIND)))
    assert empty.collect() == [] and empty.columns[:4] == ["vec_id", "label", "code", "error"]


def test_vector_codes_refuses(spark):
    for bad in ([[0.0] * 30], [[0.0] * 32, [0.0] * 48], [[1e12] * 32]):
        with pytest.raises(Exception, match="parts|lengths|too large"):
            vector_codes.vector_codes(spark.createDataFrame([(i, v, 1, "c", 1, "x") for i, v in enumerate(bad)], KIND)).collect()


def test_bounds_exclude_only_what_is_farther():
    """Rounds by kept bounds give what measuring everything gives, ties included, and measure less."""
    rng = np.random.default_rng(2)
    for width, spread in ((1, 6), (2, 12), (4, 200), (4, 40)):
        rows = rng.integers(-spread, spread, (900, width))
        entries = rows[:40].copy()
        own, _, upper, lower = vector_codes.first_assignment(rows, entries)
        for _ in range(5):
            upper, lower = vector_codes.unpack_bounds(*vector_codes.pack_bounds(upper, lower), len(entries))
            d = np.sqrt(vector_codes.squared(rows, entries).astype(float))
            assert (upper >= d[np.arange(len(rows)), own]).all() and (lower <= d + 1e-9).all()
            new = np.array([rows[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else entries[j] for j in range(len(entries))])
            moved = np.sqrt(((new - entries) ** 2).sum(1).astype(float)) * (1 + vector_codes.SLACK)
            entries = new
            own, least, upper, lower, measured = vector_codes.next_assignment(rows, entries, own, upper, lower, moved)
            want = vector_codes.first_assignment(rows, entries)
            assert (own == want[0]).all() and (least == want[1]).all()
        assert measured < 0.5 * len(rows) * len(entries)


# 13


def plain_shards(rows, shards=8, seed=42):
    strata = {}
    for i, text, source in rows:
        data = (text or "").encode()
        key = hashlib.md5(f"{seed}|{'' if i is None else i}".encode()).hexdigest()[:16]
        strata.setdefault(source, []).append((key, i is None, i or 0, zlib.crc32(data), len(data) + 1, i))
    order = []
    for source, found in strata.items():
        for r, row in enumerate(sorted(found)):
            order.append(((2 * r + 1) / (2 * len(found)), source is None, source or "", row))
    n, out, starts = len(order), [], {}
    for p, (_, none, source, row) in enumerate(sorted(order)):
        shard = p * shards // n
        starts.setdefault(shard, p)
        out.append((row[5], None if none else source, row[4], row[3], shard, p - starts[shard]))
    return out


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(11)
    rows = [(i, "w" * rng.randint(0, 50) + "é", "hot" if i % 3 else f"s{rng.randint(0, 12)}") for i in range(500)]
    return rows + [(600, None, None), (601, "", None), (None, "a", "hot"), (7, "again", "hot"), (7, rows[7][1], rows[7][2])]


def placed(df):
    return sorted(((r.doc_id, r.source, r["size"], r.text_crc32, r.shard, r.slot) for r in df.collect()), key=str)


def test_sharding(spark, sourced):
    df = spark.createDataFrame([(*r, "p", 1) for r in sourced], "doc_id long, text string, source string, place string, part int").repartition(5)
    for shards in (8, 1, 7):
        got = placed(sharding.assign_shards(df, shards))
        assert got == sorted(plain_shards(sourced, shards), key=str)
        sizes = Counter(r[4] for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        hot = Counter(r[4] for r in got if r[1] == "hot")
        assert max(hot.values()) - min(hot.values()) <= len({r[1] for r in got})


def test_sharding_of_few_and_none(spark):
    kind = "doc_id long, text string, source string"
    few = [(1, "a", "x"), (2, "b", "y"), (3, "c", "x")]
    assert placed(sharding.assign_shards(spark.createDataFrame(few, kind))) == sorted(plain_shards(few), key=str)
    assert sharding.assign_shards(spark.createDataFrame([], kind)).collect() == []
    with pytest.raises(ValueError, match="carried"):
        sharding.assign_shards(spark.createDataFrame([(1, "a", "x", 2)], kind + ", slot int"), carry=("slot",))


def test_written_shards(spark, sourced, tmp_path):
    df = spark.createDataFrame([(*r, "p") for r in sourced], "doc_id long, text string, source string, place string")
    out = sharding.write_shards(df, str(tmp_path / "shards"), 4)
    assert out.count() == len(sourced) and set(out.columns) == {"doc_id", "source", "text", "place", "shard", "slot"}
    want = Counter((r[0], r[4], r[5]) for r in plain_shards(sourced, 4))
    assert Counter((r.doc_id, r.shard, r.slot) for r in out.collect()) == want
