"""Each operator against a plain version, and on nulls, empty and long texts, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from residua.llm import decontamination, exact_dedup, language_model, line_dedup, merge_sort, near_duplicates, packing, quality, recurrent, simhash, sketch, substring_dedup, suffix_dedup, url_reputation, word_hash

WORDS = [a + b for a in ("ba", "to", "ki", "re", "su", "na") for b in ("n", "la", "mi", "sto", "ger", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Prose with exact and near copies, shared passages, repeats within a document and edge cases."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    passage = prose(rng, 70)
    for i in (3, 9, 21):
        texts[i] = prose(rng, 40) + " " + passage + " " + prose(rng, 30)
    texts[12] = texts[5] + "  "
    texts[13] = texts[5].replace(" ", "\t\n")
    texts[14] = texts[5].upper()
    texts[30] = texts[21].replace(texts[21].split()[60], "changed")
    texts[31] = "xyzzy " * 400
    texts[32] = "A" * 700
    texts[33] = passage + " " + passage
    return [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, " \n\t "), (103, "ba"), (104, "ba"), (105, prose(rng, 9000)), (106, "é" * 130 + " ß " + "é" * 130)]


COLUMNS = "doc_id long, text string, source string, row long, rep string, key long, start long, n long, word string, gone string"


def frame(spark, rows):
    """The rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "site", 7, "x", 1, 2, 3, "w", "g") for i, t in rows], COLUMNS)


def got(df, *names):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *names).collect()}


# 1


def test_exact_dedup(spark, corpus):
    out = exact_dedup.exact_dedup(frame(spark, corpus), parallel_bytes=2000)
    found = got(out, "keep_id", "group_size", "kept", "text_sha256")
    norm = {i: __import__("re").sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in corpus}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    assert found == {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_exact_dedup_repeats_and_nulls(spark):
    out = exact_dedup.exact_dedup(frame(spark, [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "a")])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out), key=str) == sorted([(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (None, None, 1, True), (None, None, 1, True)], key=str)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_of_repeated_huge_rows(spark):
    big = "ab " * 200_000
    out = exact_dedup.exact_dedup(frame(spark, [(1, big), (1, big), (2, big), (3, "c")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == [(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True)]


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda texts, _: texts.selectExpr("id", "length(text) * 0L as n", "0L as fp", "sha"))
    out = got(exact_dedup.exact_dedup(frame(spark, [(1, "a"), (2, "b"), (3, "b"), (4, "a")])), "keep_id", "group_size")
    assert out == {1: (1, 2), 4: (1, 2), 2: (2, 2), 3: (2, 2)}


def test_fingerprints_compose():
    data = bytes(random.Random(1).randrange(256) for _ in range(200_000))
    for which in (0, 1):
        h = 0
        for at in range(0, len(data), 777):
            piece = data[at : at + 777]
            h = exact_dedup.combine(h, exact_dedup.chunk_hash(piece, which), len(piece), which)
        assert h == exact_dedup.fingerprint(data) >> (31 * (1 - which)) & (1 << 31) - 1


# 2


def plain_log10(gru, ids):
    """The model's log10 probability of ids, token by token in double precision."""
    H = recurrent.HIDDEN
    e, wx, wh, wc, wo = (getattr(gru, k).astype(np.float64) for k in gru.NAMES)
    starts, h, last, total = gru.v.starts, np.zeros(H), 0, 0.0
    for w in ids:
        a, u = wx @ e[last], wh @ np.append(h, 1)
        r, z = (1 / (1 + np.exp(a[k : k + H] + u[k : k + H])) for k in (0, H))
        c = np.tanh(a[2 * H :] + r * u[2 * H :])
        h = z * h + (1 - z) * c
        k = int(np.searchsorted(starts, w, "right")) - 1
        for weights, at in ((wc, k), (wo[starts[k] : starts[k + 1]], w - starts[k])):
            logits = weights @ np.append(h, 1)
            total += logits[at] - np.log(np.exp(logits).sum())
        last = w
    return total / math.log(10)


@pytest.mark.parametrize("model_words, count_words, partitions", [(8192, 1 << 18, 3), (10, 20, 1), (3, 0, 4)])
def test_lm_score(spark, corpus, monkeypatch, model_words, count_words, partitions):
    """Against plain counts, and the model that was trained against a loop over tokens."""
    from pyspark.sql import functions as F

    from residua.llm.common import id_crc32

    rows = [*corpus, (200, "w" * 100 + " " + "w" * 101), (201, "Rare\x0bonce\x1cnot split"), (202, "only held out"), (202, "only held out"), (None, "ba to")]
    monkeypatch.setattr(language_model, "MODEL_WORDS", model_words)
    monkeypatch.setattr(language_model, "COUNT_WORDS", count_words)
    made = []
    train = language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a: made.append(train(*a)) or made[-1])
    learnt = F.pmod(id_crc32(F.col("doc_id")), F.lit(7)) != 2
    out = language_model.lm_score(frame(spark, rows).repartition(partitions), training=learnt).collect()
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v, ends = sum(counts.values()), len(counts), counts.pop(None)
    gru = made[0]
    head = len(gru.v.counts) - 2
    order = sorted(counts, key=lambda w: (-counts[w], int(word_hash.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])))
    ids = {w: k + 2 for k, w in enumerate(order[:head])} | {None: 0}
    assert head == (min(model_words, len(counts)) if count_words else 0) or 0 < count_words <= 20
    tail = sum(counts[w] for w in order[head:]) + len(order[head:]) + 1
    counts[None] = ends
    assert Counter(str(r.doc_id) for r in out) == Counter(str(i) for i, _ in rows)
    found = {r.doc_id: r for r in out}
    for i, ws in tokens:
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        own = [ids.get(w, 1) for w in ws]
        below = sum(math.log10((counts[w] + 1) / tail) for w, k in zip(ws, own) if k == 1)
        assert r.score == pytest.approx(plain_log10(gru, own) + below, rel=1e-4, abs=1e-3)
    if count_words > 20:
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_score_of_nothing(spark):
    from pyspark.sql import functions as F

    assert language_model.lm_score(frame(spark, [])).count() == 0
    out = language_model.lm_score(frame(spark, [(1, "a b"), (2, None)]), training=F.lit(None).cast("boolean")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}


def test_word_hashes():
    rng = random.Random(10)
    texts = [b"", b" ", *(bytes(rng.choice(b"abAB\t\n \x1c\xc3\xa9") for _ in range(rng.randint(0, 400))) for _ in range(300)), b"x" * 9, b"x" * 70 + b"y", b"x" * 70 + b"z"]
    offsets = np.cumsum([0, *map(len, texts)])
    hashes, n = word_hash.word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    words = [t.lower().split() for t in texts]
    assert n.tolist() == list(map(len, words))
    pairs = set(zip((w for ws in words for w in ws), hashes.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    keys = np.unique(hashes)[::2]
    assert word_hash.HashTable(keys).find(hashes).tolist() == [{k: i for i, k in enumerate(keys.tolist())}.get(h, -1) for h in hashes.tolist()]


def test_lm_is_a_distribution_and_learns():
    voc = recurrent.Vocabulary(np.array([9, 7, 5, 3, 2]), 4, 6)
    gru = recurrent.Gru(voc)
    h = np.ones((recurrent.HIDDEN + 1, 3), np.float32)
    h[:-1] = np.random.default_rng(0).standard_normal((recurrent.HIDDEN, 3))
    assert np.allclose(sum(np.exp(gru.log_probabilities(h, np.full(3, w, np.uint16))) for w in range(len(voc.counts))), 1, atol=1e-5)
    docs = [np.array(x, np.uint16) for x in ([2, 3, 2, 3, 2, 3, 0], [0], [2, 3, 2, 3, 0])]
    flat, lengths = np.concatenate(docs), np.array(list(map(len, docs)))
    before = gru.score(flat, lengths)
    assert np.allclose(before, [gru.score(d, np.array([len(d)]))[0] for d in docs], atol=1e-4)
    gru.train(np.concatenate([np.zeros(1, np.uint16), *(docs * 200)]))
    assert gru.score(flat, lengths).sum() > before.sum() / 2


def test_lm_gradients(monkeypatch):
    """Backpropagation against differences of the loss."""
    for name, value in (("EMBEDDING", 5), ("HIDDEN", 6), ("WINDOW", 4)):
        monkeypatch.setattr(recurrent, name, value)
    rng = np.random.default_rng(1)
    gru = recurrent.Gru(recurrent.Vocabulary(np.sort(rng.integers(1, 50, 30))[::-1], 7, 9, 4))
    x, y = rng.integers(0, 32, (2, 4, 8))
    grads = {}
    monkeypatch.setattr(gru, "_learn", lambda name, where, grad, sums: grads.update({name: grad}))
    start = (rng.standard_normal((6, 8)) * 0.3).astype(np.float32)
    gru._window(x, y, start, None, 8)

    def loss():
        h, total = np.vstack([start, np.ones((1, 8))]).astype(np.float64), 0.0
        for t in range(4):
            h = h.copy()
            h[:6] *= x[t] != 0
            gru.step(x[t], h)
            total -= gru.log_probabilities(h, y[t]).sum()
        return total / x.size

    for name in gru.NAMES:
        setattr(gru, name, getattr(gru, name).astype(np.float64))
    for name, grad in grads.items():
        weights = getattr(gru, name)
        for at in zip(*np.unravel_index(np.argsort(-np.abs(grad), axis=None)[:4], grad.shape)):
            was, ends = weights[at], []
            for d in (1e-2, -1e-2):
                weights[at] = was + d
                ends.append(loss())
            weights[at] = was
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(grad[at], rel=0.02, abs=1e-4)


def test_lm_learns_from_every_token(spark, monkeypatch):
    from residua.llm.common import Scratch

    rng = np.random.default_rng(11)
    docs = [np.append(rng.integers(1, 40, n), 0).astype(np.uint16) for n in (0, 1, 30, 1009, 70_003)]
    whole = np.concatenate([np.zeros(1, np.uint16), *docs])
    voc = recurrent.Vocabulary(np.arange(40, 0, -1), len(docs), 0)
    learnt = []
    monkeypatch.setattr(recurrent.Gru, "_window", lambda self, x, y, h, sums, streams: learnt.extend(zip(x.ravel().tolist(), y.ravel().tolist())) or h)
    recurrent.Gru(voc).train(whole)
    assert Counter(learnt) == Counter(zip(whole[:-1].tolist(), whole[1:].tolist()))

    monkeypatch.undo()
    own = recurrent.Gru(voc)
    own.train(whole)
    rows = spark.createDataFrame([(d.tobytes(),) for d in docs], "ids binary").coalesce(1)
    assert np.allclose(language_model.train(rows, voc, Scratch(spark)).flat(), own.flat(), atol=1e-4)


# 3


def test_line_dedup(spark):
    rows = [(i, f"own {i}\nmenu\n\nshared {i // 2}") for i in range(40)] + [(50, None), (51, ""), (52, "menu"), (53, "menu\nmenu")]
    out = line_dedup.dedup_lines(frame(spark, rows), ratio=0.2, min_pages=3)
    found = got(out, "text", "n_lines", "n_removed")
    for i in range(40):
        assert found[i] == (f"own {i}\n\nshared {i // 2}", 4, 1)
    assert (found[50], found[51], found[52], found[53]) == ((None, 0, 0), ("", 1, 0), ("", 1, 1), ("", 2, 2))
    assert out.columns[:10] == frame(spark, []).columns
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_with_clashing_names_and_ties(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, "a\nb" if i < 5 else "b", 1, 2, 3, 4, "left") for i in range(10)], "doc_id long, text string, drop int, host int, own_host int, n_lines int, left string")
    out = line_dedup.dedup_lines(rows, host=F.lit("h"), ratio=0.5, min_pages=1)
    assert out.columns == [*rows.columns, "n_removed"]
    # Exactly at the ratio a line stays.
    assert got(out, "text", "drop", "host", "own_host", "left", "n_lines") == {i: ("a" if i < 5 else "", 1, 2, 3, "left", 2 if i < 5 else 1) for i in range(10)}


def test_line_dedup_of_pages(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<ul><li>menu {i % 2}</li></ul><p>own {i}</p>") for i in range(20)] + [(30, None, None), (31, "no url", "<p>x")]
    out = line_dedup.dedup_page_lines(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.host, r.text, r.n_lines, r.n_removed) for r in out} == {i: (f"h{i % 2}.org", f"own {i}", 2, 1) for i in range(20)} | {30: ("", None, 0, 0), 31: ("", "x", 1, 0)}


# 4


def test_substring_dedup(spark, corpus):
    found = got(substring_dedup.substring_dedup(frame(spark, corpus)), "n_words", "n_removed", "kept_text")
    first, expected = {}, {}
    for i, t in sorted(corpus, key=lambda r: r[0]):
        w = (t or "").encode().split()
        out = [False] * len(w)
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), i) < i:
                out[p : p + 50] = [True] * 50
        expected[i] = (len(w), sum(out), b" ".join(x for x, o in zip(w, out) if not o).decode())
    assert found == expected
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


# 5


def test_suffix_dedup(spark, corpus):
    found = got(suffix_dedup.suffix_dedup(frame(spark, corpus)), "n_bytes", "n_removed", "n_spans", "kept")
    seen, expected = set(), {}
    for i, t in sorted(corpus, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        expected[i] = (len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), bytes(x for x, g in zip(b, gone) if not g))
    assert {k: (*v[:3], bytes(v[3])) for k, v in found.items()} == expected
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_suffix_dedup_of_repeated_rows(spark, monkeypatch):
    """Runs of several partitions that start with the same record, and one gram in many texts."""
    rng = random.Random(13)
    shared = [prose(rng, 60) for _ in range(30)]
    first = "\0" * 300 + prose(rng, 90)  # its record sorts before all others
    common = "c" + prose(rng, 12)[:60]
    rows = [(i, prose(rng, 40) + shared[i] + prose(rng, 40)) for i in range(30)] + [(100 + i, prose(rng, 40) + shared[i] + prose(rng, 40)) for i in range(30)]
    rows += [(200 + i, common + prose(rng, 30)) for i in range(25)] + [(300, first)] * 3 + [(301, first)]
    df = spark.createDataFrame([(i, t, k % 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, p int").repartitionByRange(3, "p")
    seen, expected = {}, {}
    for i, t in dict(rows).items():
        b = t.encode()
        for p in range(len(b) - 99):
            seen.setdefault(b[p : p + 100], (i, p))
    for i, t in dict(rows).items():
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 99):
            if seen[b[p : p + 100]] != (i, p):
                gone[p : p + 100] = b"\1" * 100
        expected[i] = sum(gone)
    for records in (10_000, 4):
        monkeypatch.setattr(suffix_dedup, "GROUP_RECORDS", records)
        out = suffix_dedup.suffix_dedup(df).collect()
        assert len(out) == len(rows) and {(r.doc_id, r.n_removed) for r in out} == set(expected.items())


def test_suffix_dedup_with_small_ranges(spark, corpus, monkeypatch):
    whole = got(suffix_dedup.suffix_dedup(frame(spark, corpus)), "n_removed")
    for name in ("BLOCK_RECORDS", "RANGE_RECORDS"):
        monkeypatch.setattr(suffix_dedup, name, 5)
    monkeypatch.setattr(suffix_dedup, "RUN_RECORDS", 20)
    assert got(suffix_dedup.suffix_dedup(frame(spark, corpus).repartition(3)), "n_removed") == whole


def test_merge_of_front_coded_runs():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(7)]

    def coded(run):
        lcp, size, rest = merge_sort.front_coded(run)
        assert merge_sort.front_decoded(lcp, size, rest) == run
        return iter(zip(lcp.tolist(), run, run))

    out = list(merge_sort.merge([coded(r) for r in runs]))
    assert [s for _, s, _ in out] == sorted(s for r in runs for s in r)
    for (_, a, _), (k, b, _) in zip(out, out[1:]):
        assert k == len(__import__("os").path.commonprefix([a, b]))
    assert list(merge_sort.merge([])) == []


def test_large_ids_beside_null_ids(spark, corpus):
    """No operator takes ids through floats."""
    from residua.llm.queries import tokenizer_path

    big = (1 << 62) + 1
    rows = [(None, corpus[3][1]), (big, corpus[3][1]), (big + 2, corpus[3][1] + " x")]
    bench = spark.createDataFrame([(None, corpus[3][1]), (big, corpus[3][1])], "item_id long, text string")
    df = frame(spark, rows).coalesce(1)
    ids = {None, big, big + 2}
    for out in (exact_dedup.exact_dedup(df), language_model.lm_score(df), line_dedup.dedup_lines(df), substring_dedup.substring_dedup(df), suffix_dedup.suffix_dedup(df), decontamination.find_contamination(df, bench.coalesce(1)), packing.pack_documents(df, tokenizer_path()), simhash.simhash_dedup(df)):
        assert {r.doc_id for r in out.collect()} == ids
    assert {r.item_id for r in decontamination.find_contamination(df, bench.coalesce(1)).collect()} == {None, big}
    assert {r.doc_id for r in near_duplicates.near_duplicate_groups(df).collect()} == {big, big + 2}


def test_prefilter_without_a_sketch(spark, corpus, monkeypatch):
    rows = frame(spark, [r for r in corpus if r[0] != 105] + [(None, corpus[3][1])])
    words, spans = got(substring_dedup.substring_dedup(rows), "n_removed"), got(suffix_dedup.suffix_dedup(rows), "n_removed")
    monkeypatch.setattr(sketch, "MOST_BITS", 1)
    assert got(substring_dedup.substring_dedup(rows), "n_removed") == words
    assert got(suffix_dedup.suffix_dedup(rows), "n_removed") == spans


def test_a_sketch_spreads_small_keys():
    """Keys are the smallest of some hashes each, so their first bits say little."""
    rng = np.random.default_rng(18)
    keys = rng.integers(0, 1 << 58, 20_000, np.uint64)
    for bits, inside in ((18, 18), (18, 10)):
        for row in (0, 1):
            assert len(np.unique(sketch.cells(keys, row, bits, inside))) > 18_500
    pairs = sketch.cells(keys, 0, 18, 10) << np.uint64(18) | sketch.cells(keys, 1, 18, 10)
    assert len(np.unique(pairs)) > 19_900


def test_a_sketch_in_shards_tells_the_same(spark, monkeypatch):
    """Every key that occurs twice passes, the others mostly don't, whether the sketch goes to the keys or the keys to its shards."""
    from residua.llm.common import Scratch

    rng = np.random.default_rng(14)
    keys = rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2)
    docs = [np.concatenate([keys[k::60], keys[:40]]) for k in range(60)]  # the first forty are in all documents
    base = spark.createDataFrame([(i if i % 7 else None, d.tobytes()) for i, d in enumerate(docs)], "id long, text binary")
    keys_of = lambda t: np.frombuffer(t, np.uint64)
    monkeypatch.setattr(sketch, "SHARD_BITS", 11)
    found = {}
    for most in (28, 1):
        monkeypatch.setattr(sketch, "MOST_BITS", most)
        rows, filtered = sketch.prefilter(base, keys_of, len(keys), Scratch(spark))
        found[most] = {}
        for r in rows.collect():
            own = keys_of(bytes(r.text))
            found[most][str(r.id), bytes(r.text)] = set(own[filtered.of(r.shared)(own)].tolist())
    common = set(keys[:40].tolist())
    # A null id gets back what all null ids have: more may pass, never less.
    assert found[1].keys() == found[28].keys() and all(common <= k <= found[1][at] and len(k) < 50 for at, k in found[28].items())
    assert all(k == found[1][at] for at, k in found[28].items() if at[0] != "None")


def test_sketch_never_underestimates(spark):
    texts = spark.createDataFrame([(bytes([i % 60]),) for i in range(90)], "text binary")
    made = sketch.build_sketch(texts, lambda t: np.array([t[0] * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64), 16)
    keys = np.array([i * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(100)], np.uint64)
    may = made.twice(keys)
    assert may[:30].all() and may[30:].sum() < 3


# 6


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) if i % 3 else "!! ".join(rng.choice(WORDS).upper() for _ in range(60))) for i in range(150)] + [(200, None), (201, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 100)] + [(None, 1), (5, None)], "doc_id long, quality int")
    df = frame(spark, rows)
    out = got(quality.score_quality(df, quality.fit_quality(df, labels)), "quality_score")
    assert all((out[i][0] >= 0.5) == (i % 3 > 0) for i in range(100, 150))
    assert all(0 <= x[0] <= 1 for x in out.values()) and out[200] == out[201]
    empty = quality.fit_quality(df, labels.limit(0))
    assert {x[0] for x in got(quality.score_quality(df, empty), "quality_score").values()} == {0.5}
    assert quality.score_quality(frame(spark, []), empty).count() == 0


def test_quality_votes(spark):
    """Against a plain vote, with ties at the k-th neighbour."""
    rng = np.random.default_rng(15)
    vectors = rng.standard_normal((30, 8)).astype(np.float32)
    vectors[20:] = vectors[10:20]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality.QualityModel(np.eye(8, dtype=np.float32), vectors, rng.integers(0, 2, 30).astype(float), 5, 8.0)
    z = model.project(np.concatenate([rng.standard_normal((40, 8)).astype(np.float32), vectors[10:12]]))
    for row, vote in zip(z, model.vote(z)):
        s = [float(row @ v) for v in vectors]
        least = sorted(s, reverse=True)[4] - 1e-7
        near = [(x**8, y) for x, y in zip(s, model.labels) if x >= least and x > 0]
        assert vote == pytest.approx(sum(w * y for w, y in near) / sum(w for w, _ in near), abs=1e-4)
    order = rng.permutation(30)
    shuffled = quality.QualityModel(model.weights, vectors[order], model.labels[order], 5, 8.0)
    assert np.allclose(shuffled.vote(z), model.vote(z))


# 7


def test_wand_finds_all_above_threshold():
    rng = random.Random(5)
    items = [[rng.choice(WORDS) + str(rng.randrange(4)) for _ in range(rng.randint(3, 30))] for _ in range(150)]
    statistics = decontamination.Statistics()
    for words in items:
        statistics.add(words)
    index = decontamination.Bm25Index(list(range(150)), items, statistics)
    for _ in range(100):
        terms = sorted({index.terms[w] for w in rng.choice(items)[:20]} | {rng.randrange(len(index.terms)) for _ in range(25)})
        sums = {}
        for t in terms:
            for i, x in zip(index.postings[t].items, index.postings[t].impacts):
                sums[i] = sums.get(i, 0) + x
        assert {i for i, _ in index.wand(terms, 0.25)} == {i for i, s in sums.items() if s >= 0.25 - 1e-6}


def test_decontamination_with_several_indexes(spark, monkeypatch):
    rng = random.Random(16)
    items = [(k, " ".join(f"{rng.choice(WORDS)}{rng.randrange(30)}" for _ in range(rng.randint(12, 60)))) for k in range(40)]
    rows = [(i, prose(rng, 60) + " " + " ".join(items[i][1].split()[: rng.randint(8, 60)]) + " " + prose(rng, 60)) for i in range(40)]
    rows += [rows[3], (None, rows[4][1])]
    bench = spark.createDataFrame([*items, items[5], (None, items[6][1])], "item_id long, text string")
    found = {}
    for size, words in ((50_000, 2_000_000), (7, 2_000_000), (1000, 100)):
        monkeypatch.setattr(decontamination, "INDEX_ITEMS", size)
        monkeypatch.setattr(decontamination, "INDEX_WORDS", words)
        out = decontamination.find_contamination(frame(spark, rows), bench, threshold=0.4, similarity=0.3, part_similarity=0.1)
        found[size] = sorted((str(r.doc_id), str(r.item_id), round(r.score, 9), r.similarity, r.question_overlap, r.answer_overlap) for r in out.collect())
    assert found[50_000] == found[7] == found[1000]
    pairs = Counter(x[:2] for x in found[7])
    assert len(pairs) > 20 and pairs["3", "3"] == 2 * pairs["2", "2"] or pairs["3", "3"] in (0, 2)
    assert pairs["4", "4"] == pairs["None", "4"] and pairs["5", "5"] in (0, 2) and pairs["6", "6"] == pairs["6", "None"]


def test_decontamination_against_plain_bm25(spark):
    """All passages and items, scored and compared one by one."""
    rng = random.Random(17)
    items = [(k, " ".join(f"{rng.choice(WORDS)}{rng.randrange(12)}" for _ in range(rng.randint(3, 25)))) for k in range(25)]
    rows = [(i, " ".join(w for k in range(rng.randint(0, 4)) for w in (prose(rng, rng.randint(0, 40)), " ".join(rng.choice(items)[1].split()[: rng.randint(5, 30)])))) for i in range(60)]
    words = {k: t.split() for k, t in items}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    size = max(map(len, words.values()))

    def impact(k, w):
        f, x = words[k].count(w), len(words[k])
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * x / mean))

    def overlap(part, passage):
        m = min(5, len(part))
        own, there = ({tuple(x[i : i + m]) for i in range(len(x) - m + 1)} for x in (part, passage))
        return len(own & there) / len(own)

    expected = {}
    for i, t in rows:
        ws = t.lower().split()
        for at in range(0, max(1, len(ws) - size), size):
            passage = ws[at : at + 2 * size]
            for k, own in words.items():
                total = sum(impact(k, w) for w in set(own))
                score = sum(impact(k, w) for w in set(own) & set(passage)) / total
                cut = -(-2 * len(own) // 3)
                parts = [overlap(p, passage) for p in (own, own[:cut], own[cut:] or own)]
                if score >= 0.6 and parts[0] >= 0.8 and min(parts[1:]) >= 0.5:
                    expected[i, k] = max(expected.get((i, k), (0.0,)), (score, *parts))
    out = decontamination.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): pytest.approx((r.score, r.similarity, r.question_overlap, r.answer_overlap), abs=1e-5) for r in out} == expected and len(expected) > 20


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, " ".join(f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(rng.randint(12, 60)))) for k in range(30)]
    rows = [(i, prose(rng, 200)) for i in range(30)]
    rows += [(100 + k, prose(rng, 90) + " " + items[k][1].upper() + ". " + prose(rng, 300)) for k in range(10)]
    rows += [(200, " ".join(items[11][1].split()[: len(items[11][1].split()) // 2])), (300, None), (301, ""), (302, prose(rng, 8000) + " " + items[12][1])]
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    out = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(frame(spark, rows), bench).collect()}
    assert out == {(100 + k, k) for k in range(10)} | {(302, 12)}
    assert decontamination.find_contamination(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.find_contamination(frame(spark, []), bench).count() == 0


# 8


def test_url_rules_and_reputation(spark):
    urls = ["http://a.COM/en/1", "https://x.example.com/en/7?q", "http://example.com/en/8", "http://s.net/de/1", "http://example.net/de/85#t", "ftp://o.org/es/", "http://bad.org/x", "http://good.org/x", "no url", None, "http://h?a/b", "x://notexample.com/en/7"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("bad.org", 0)] * 60 + [("bad.org", None)] + [("good.org", 1)] * 60 + [("few.org", 0)] * 2 + [("ok.org", 1)] * 40, "host string, good int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert out == {
        0: ("a.com", "/en/1", "com/en/", "block"), 1: ("x.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("example.com", "/en/8", "com/en/", "block"), 3: ("s.net", "/de/1", "net/de/", "allow"),
        4: ("example.net", "/de/85", "example.net/de/8", "block"), 5: ("o.org", "/es/", "org/es/", "block"), 6: ("bad.org", "/x", None, "block"), 7: ("good.org", "/x", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("h", "", None, "allow"), 11: ("notexample.com", "/en/7", "com/en/", "block"),
    }
    rep = {r.host: r for r in url_reputation.host_reputation(outcomes).collect()}
    assert rep["bad.org"].posterior < rep["few.org"].posterior < rep["good.org"].posterior and rep["few.org"].posterior > 0.05
    assert {r.verdict for r in url_reputation.judge_urls(pages.filter("page_id in (6, 8)"), outcomes.limit(0)).collect()} == {"allow"}
    assert url_reputation.judge_urls(pages.limit(0), outcomes).count() == 0


# 9


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    from residua.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(frame(spark, corpus), tokenizer_path(), keep_ids=True).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.length <= 4096
        assert r.start == len(by_doc.setdefault(r.doc_id, b"")) // 4
        by_doc[r.doc_id] += bytes(r.ids)
    assert by_doc == {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in corpus}
    places = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 4096 and len(places) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.pack_documents(frame(spark, []), tokenizer_path()).count() == 0
    assert packing.pack_documents(frame(spark, [(1, "a"), (1, "a"), (None, "b")]), tokenizer_path()).count() == 3


def test_words_are_encoded_as_the_tokenizer_does():
    from residua.llm.queries import tokenizer_path

    words = packing.WordIds(tokenizer_path())
    rng = random.Random(7)
    letters = [chr(c) for c in range(9, 0x180)] + ["\u0301", "Σ", "İ", "₂", "²", "中", "\u00a0", "\u2028"]
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + rng.choice(["", "'s", "'LL", " 'T", " _a_"])
        assert np.frombuffer(words.encode(s.encode()), "<u4").tolist() == words.tokenizer.encode(s, add_special_tokens=False).ids


def test_added_tokens_are_recognised(spark):
    from tokenizers import Tokenizer

    from residua.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["hello <|endoftext|> b", "a<|endoftext|>b\n<|startoftext|><|endoftext|>c", "é<|startoftext|>Σ", "<|ENDOFTEXT|> <|endof text|> <|endoftext|", "x  <|endoftext|>  y"]
    rows = packing.pack_documents(frame(spark, list(enumerate(texts))), tokenizer_path(), keep_ids=True).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    assert 49407 in np.frombuffer(next(r.ids for r in rows if r.doc_id == 0), "<u4")


def test_shards_and_levels(spark):
    from residua.llm.common import Scratch

    rng = random.Random(8)
    pieces = spark.createDataFrame([(i, rng.choice([4096, rng.randint(1, 900), rng.randint(1000, 3000)])) for i in range(600)], "row long, length long")
    out = packing.pack_pieces(pieces, Scratch(spark), shard_pieces=64).join(pieces, "row").collect()
    assert len(out) == 600
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= 1.05 * sum(used.values()) / 4096 + 2


def test_pieces_of_which_no_two_fit_stay_in_shards(spark):
    from residua.llm.common import Scratch

    pieces = spark.range(2000).selectExpr("id as row", "2100L as length")
    out = packing.pack_pieces(pieces, Scratch(spark), shard_pieces=100).collect()
    assert len(out) == len({r.sequence_id for r in out}) == 2000 and {r.offset for r in out} == {0}
    assert max(Counter(r.sequence_id >> 32 for r in out).values()) < 200


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    from residua.llm.queries import tokenizer_path

    made = __import__("json").loads(Tokenizer.from_file(tokenizer_path()).to_str())
    made["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(__import__("json").dumps(made))
    words = packing.WordIds(str(tmp_path / "t.json"))
    text = "Hello  World, it's é"
    assert not words.by_word and np.frombuffer(words.encode(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


# 10


def test_simhash(spark, corpus):
    found = got(simhash.simhash_dedup(frame(spark, corpus)), "fingerprint", "component_id")

    def plain(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: plain(t) for i, t in corpus}
    root = {i: i for i in fps}
    for _ in fps:
        for i in fps:
            root[i] = min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
    assert found == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert simhash.simhash_dedup(frame(spark, [])).count() == 0


def test_simhash_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "x y z w"), (9, None)]
    out = simhash.simhash_dedup(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter([(5, 3), (5, 3), (None, 3), (3, 3), (None, None), (9, 9)])


def test_blocks_whose_fingerprints_differ_in_the_first_bits_only(spark, monkeypatch):
    from residua.llm.common import Scratch
    from residua.operators.components import connected_components

    monkeypatch.setattr(simhash, "BLOCK_ROWS", 2)
    fps = [k << 62 | 5 for k in range(4)] + [k << 62 | 0xFFFF0005 for k in range(4)]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = connected_components(simhash.fingerprint_links(df, 8, 3, Scratch(spark)), Scratch(spark)).collect()
    assert len(roots) == 8 and len({r.root for r in roots}) == 2


@pytest.mark.parametrize("block", (1 << 20, 700))
def test_near_duplicate_groups(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", block)  # at 700 a component has several blocks
    rng = random.Random(12)
    rows = list(corpus)
    for i in range(60):  # copies of copies, edited little by little
        w = rng.choice(rows[:40] + rows[47:])[1].split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((200 + i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(12):
        root = {i: min(root[j] for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in sets}
    found = got(near_duplicates.near_duplicate_groups(frame(spark, rows + [(None, corpus[3][1])])), "component_id")
    assert found == {i: (root[i],) for i in sets} and len(set(root.values())) < len(root) - 20
    assert near_duplicates.near_duplicate_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("few, rows_of", ((32, 1 << 16), (2, 1 << 16), (2, 9)))
def test_candidate_links_meet_in_prefixes(spark, monkeypatch, few, rows_of):
    """Every pair of the similarity is linked, by join, in a block and across blocks; sets without a common shingle never meet, whatever the radius."""
    from residua.llm.common import Scratch
    from residua.operators.components import connected_components

    monkeypatch.setattr(near_duplicates, "FEW", few)
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", rows_of)
    rng = np.random.default_rng(3)
    families = [rng.integers(0, 1 << 63, 40, np.uint64) for _ in range(4)]
    sets = [np.unique(rng.choice(f, 38, replace=False)) for f in families for _ in range(20)]
    sets += [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 2, 7, 40)]
    rows = [(k, s[: near_duplicates.prefix_length(len(s), 0.8)].tobytes(), 0, 0, 0, 0) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, prefix binary, f0 long, f1 long, f2 long, f3 long").repartition(3)
    scratch = Scratch(spark)
    root = {r.node: r.root for r in connected_components(near_duplicates.candidate_links(df, 0, scratch), scratch).collect()}
    similar = [(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert len(similar) > 200 and all(root[i] == root[j] for i, j in similar)
    assert set(root.values()) == {0, 20, 40, 60} and set(root) == set(range(80))


def test_near_duplicate_links_skip_only_far_tiles(monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE", 4)
    monkeypatch.setattr(near_duplicates, "CELLS", 32)
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 64, (150, 2), np.uint64)
    fps[:50] &= rng.integers(0, 1 << 64, (50, 2), np.uint64) & rng.integers(0, 1 << 64, (50, 2), np.uint64)  # few bits
    fps[50:80] = fps[20:50] ^ (np.uint64(1) << rng.integers(0, 63, (30, 2), np.uint64))
    a, b = (x[np.argsort(near_duplicates.populations(x), kind="stable")] for x in (fps[:90], fps[90:]))
    both = np.concatenate([a, b])
    near = np.bitwise_count(both[:, None] ^ both[None, :]).sum(2) <= 24
    near[90:, 90:] = np.eye(60, dtype=bool)
    expected, found = np.arange(150), np.arange(150)
    u, v = (np.concatenate(x) for x in zip(near_duplicates.links(a, None, 24), near_duplicates.links(a, b, 24)))
    for _ in range(150):
        expected = np.array([expected[near[i]].min() for i in range(150)])
        for i, j in zip(u, v):
            found[i] = found[j] = min(found[i], found[j])
    assert (found == expected).all() and len(set(expected.tolist())) < 130


def test_links_connect_what_is_within_the_radius(spark, monkeypatch):
    from residua.llm.common import Scratch
    from residua.operators.components import connected_components

    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 63, 60, np.uint64)
    fps = np.unique(np.concatenate([seeds, *(seeds[:20] ^ (np.uint64(1) << rng.integers(0, 63, 20, np.uint64)) for _ in range(6))]))
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)
    monkeypatch.setattr(simhash, "TILE", 4)
    scratch = Scratch(spark)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long"), len(fps), 3, scratch)
    found = {r.node: r.root for r in connected_components(links, scratch).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = fps.view(np.int64).copy()
    for _ in range(8):
        label = np.array([label[near[i]].min() for i in range(len(fps))])
    assert [found.get(x, x) for x in fps.view(np.int64).tolist()] == label.tolist()
