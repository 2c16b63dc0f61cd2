import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.functions.constants import FEATURES, RESIDUES
from residua.functions.features import with_features
from residua.operators import audits, dataset, metrics, models, relational, similarity, splitting


def peptides(rng, n, low=8, high=24):
    return ["".join(rng.choice(RESIDUES) for _ in range(rng.randint(low, high))) for _ in range(n)]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *row[1:]]
        last = i - 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s):
    s = list(s)
    for _ in range(rng.randint(1, 3)):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice([[], [rng.choice(RESIDUES)], [s[k], rng.choice(RESIDUES)]])
    return "".join(s)


@pytest.fixture(scope="module")
def family(spark):
    rng = random.Random(1)
    seeds = peptides(rng, 25)
    rows = sorted({*seeds, *(edited(rng, s) for s in seeds for _ in range(4))})
    return rows, spark.createDataFrame([(s,) for s in [*rows, rows[0], None, ""]], "sequence string")


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_similar_pairs(family, threshold):
    rows, df = family
    found = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, threshold).collect()}
    expected = {}
    for i, x in enumerate(rows):
        for y in rows[:i]:
            a, b = (x, y) if (len(x), x) > (len(y), y) else (y, x)
            if 1 - lev(a, b) / len(a) >= threshold:
                expected[a, b] = 1 - lev(a, b) / len(a)
    assert found == pytest.approx(expected)


def test_pairs_are_judged_where_they_meet(family):
    """Every pair that met was measured whole, without a bound: the threshold's filter went into the join before the bounded distance."""
    plan = similarity.similar_pairs(family[1], 0.8)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "levenshtein" in line]
    assert len(joins) == 1 and joins[0].index("bit_count") < joins[0].index("levenshtein")
    assert not re.search(r"levenshtein\([^()]*, None\)", joins[0])
    assert not any("Filter" in line and "levenshtein" in line for line in plan.splitlines())


def test_pairs_of_repeated_letters_and_shifts(spark):
    """Counts beyond what the bits hold, letters that are no residues, and edits at both ends lose no pair."""
    rng = random.Random(5)
    rows = {"A" * k for k in range(1, 50)} | {"AÄ" * k for k in range(1, 20)} | {"bjz" * k + "K" for k in range(1, 14)}
    for _ in range(30):
        s = "".join(rng.choice("ACD") for _ in range(rng.randint(5, 49)))
        rows |= {s, s[1:] + "A", "C" + s[:-1], s[2:], s + "DD", edited(rng, s)}
    rows = sorted(rows - {""})
    found = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(spark.createDataFrame([(s,) for s in rows], "sequence string")).collect()}
    expected = {}
    for i, x in enumerate(rows):
        for y in rows[:i]:
            a, b = (x, y) if (len(x), x.encode()) > (len(y), y.encode()) else (y, x)
            if 1 - lev(a, b) / len(a) >= 0.8:
                expected[a, b] = 1 - lev(a, b) / len(a)
    assert found == pytest.approx(expected)


def test_greedy_groups(family):
    rows, df = family
    found = {r.sequence: (r.representative, r.group_number) for r in similarity.greedy_groups(df, 0.8).collect()}
    leaders, expected = [], {}
    for s in sorted(rows, key=lambda s: (-len(s), s)):
        near = [(-(1 - lev(s, r) / max(len(s), len(r))), len(r), k) for k, r in enumerate(leaders) if 1 - lev(s, r) / max(len(s), len(r)) >= 0.8]
        if near:
            k = min(near)[2]
        else:
            k = len(leaders)
            leaders.append(s)
        expected[s] = (leaders[k], k)
    assert found == expected


def test_splits(spark, family):
    rows, _ = family
    df = spark.createDataFrame([(s, int(sum(map(ord, s)) % 2)) for s in rows], "sequence string, label int")
    for mode in ("similarity", "random"):
        out = splitting.assign_splits(df, mode)
        assert out.count() == len(rows)
        shares = {r.split: r["rows"] / len(rows) for r in splitting.split_diagnostics(out).collect()}
        assert set(shares) == {"train", "validation", "test"} and 0.1 < shares["test"] < 0.35
        r = splitting.integrity_report(out).first()
        assert tuple(r) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        splitting.assign_splits(df.filter("label = 1"))
    with pytest.raises(ValueError):
        splitting.assign_splits(df, "other")
    with pytest.raises(ValueError):
        splitting.validate_splits(out.withColumn("split_group", F.lit("one")))
    with pytest.raises(ValueError):
        splitting.group_folds(spark.createDataFrame([("g", 1, 1)], "split_group string, n long, pos long"), 5, 1)


def test_folds_are_balanced_at_any_number_of_groups(spark):
    rng = random.Random(5)
    for big in (0, 400):
        kinds = [(n, pos, rng.randint(1, 90)) for n in range(1, 6) for pos in range(n + 1)] + ([(big, 100, 1)] if big else [])
        total = np.maximum(1, np.sum([((n - p) * k, p * k) for n, p, k in kinds], 0))
        have, expected = np.zeros((5, 2)), {}
        for n, p, k in sorted(kinds, key=lambda x: (-abs(x[0] - 2 * x[1]), x)):
            for _ in range(k):
                keys = [(((have + np.eye(5)[f][:, None] * (n - p, p)) / total).std(0).mean(), have[f].sum()) for f in range(5)]
                f = min(range(5), key=lambda f: (round(keys[f][0], 10), keys[f][1], f))
                have[f] += (n - p, p)
                expected.setdefault((n, p), [0] * 5)[f] += 1
        assert splitting.deal_counts(kinds, 5) == [expected[n, p] for n, p, _ in kinds]
    # One group has a fifth of the rows, the others are of one label each.
    many = spark.range(240_001).selectExpr("concat('g', id) as split_group", "if(id = 240000, 60000L, 1L) as n", "if(id = 240000, 12000L, if(id % 5 = 0, 1L, 0L)) as pos")
    rows = splitting.group_folds(many, 5, 1).groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.count("*").alias("k")).collect()
    assert sum(r.k for r in rows) == 240_001 and {(r.n, r.pos) for r in rows} == {(60_000, 12_000)}


def test_cleaning_and_negatives(spark):
    rows = [(0, "a", "ACDEFGHIKL"), (1, "b", "ACDEFGHIKL"), (2, "c", "ACDX"), (3, "d", "ACD"), (4, "e", None)]
    records = spark.createDataFrame(rows, "ordinal long, record_id string, sequence string")
    assert tuple(dataset.cleaning_report(records, "sequence", 5, 20).first()) == (5, 2, 1, 1, 1)
    assert [r.source_id for r in dataset.clean_positives(records, 5, 20).collect()] == ["a"]
    rng = random.Random(2)
    parents = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(peptides(rng, 6, 60, 60))] + [("bad", "XX"), ("none", None)], "id string, sequence string")
    positives = spark.createDataFrame([(s,) for s in peptides(rng, 40, 8, 12)], "sequence string")
    targets = dataset.target_lengths(positives, 40, 7)
    made = dataset.negative_fragments(parents, targets, positives, 7).collect()
    again = dataset.negative_fragments(parents, targets, positives, 7).collect()
    assert sorted(made) == sorted(again) and len({r.sequence for r in made}) == 40
    by_id = {r.id: r.sequence for r in parents.collect()}
    for r in made:
        low, high = map(int, r.source_id.split(":")[1].split("-"))
        assert by_id[r.parent_id][low - 1 : high] == r.sequence
    assert sorted(len(r.sequence) for r in made) == sorted(r["size"] for r in targets.collect())
    one = spark.createDataFrame([("p", "ACDEFGHIKLMNPQRSTVWY")], "id string, sequence string")
    five = spark.createDataFrame([(0, 5)], "fragment_index long, size int")
    forbidden = spark.createDataFrame([("ACDEF",)], "sequence string")
    assert dataset.negative_fragments(one, five, forbidden).first().sequence != "ACDEF"
    with pytest.raises(ValueError):
        dataset.negative_fragments(one, spark.createDataFrame([(0, 50)], "fragment_index long, size int"), forbidden)
    with pytest.raises(ValueError):
        dataset.negative_fragments(parents.filter("id = 'bad'"), five, forbidden)
    toy = dataset.toy_sequences(spark, 30).collect()
    assert len({r.sequence for r in toy}) == 60 and all(10 <= len(r.sequence) <= 42 for r in toy)


def plain_metrics(y, s, t):
    pos, neg = [x for x, k in zip(s, y) if k], [x for x, k in zip(s, y) if not k]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, before = 0.0, 0.0
    for c in sorted(set(s), reverse=True):
        tp, n = sum(x >= c for x in pos), sum(x >= c for x in s)
        ap += (tp / len(pos) - before) * tp / n
        before = tp / len(pos)
    tp, fp = sum(x >= t for x in pos), sum(x >= t for x in neg)
    fn, tn = len(pos) - tp, len(neg) - fp
    under = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return auc, ap, (tp * tn - fp * fn) / math.sqrt(under) if under else 0.0, (tn, fp, fn, tp)


def test_metrics_and_threshold(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    y, s = [r[1] for r in rows], [r[2] for r in rows]
    r = metrics.binary_metrics(df, 0.5).first()
    auc, ap, m, c = plain_metrics(y, s, 0.5)
    assert (r.roc_auc, r.average_precision, r.mcc) == pytest.approx((auc, ap, m)) and (r.tn, r.fp, r.fn, r.tp) == c
    best = max(sorted({*np.linspace(0.05, 0.95, 181).tolist(), *s}), key=lambda t: (round(plain_metrics(y, s, t)[2], 12), -abs(t - 0.5), -t))
    assert metrics.mcc_threshold(df).first().threshold == pytest.approx(best)
    easy = spark.createDataFrame([(i, int(i > 2), i / 10) for i in range(6)], "id long, label int, score double")
    t = metrics.mcc_threshold(easy).first()
    assert t.mcc == 1 and tuple(metrics.confusion(easy, t.threshold).first()) == (3, 0, 0, 3)
    got = metrics.bootstrap_intervals(df, "id", 0.5, 100).collect()
    assert len(got) == 8 and all(r.lower <= r.estimate <= r.upper for r in got)
    with pytest.raises(ValueError):
        metrics.mcc_threshold(df.filter("label = 1"))
    with pytest.raises(ValueError):
        metrics.bootstrap_intervals(df, "id", 0.5, 10)


def test_blocks_of_scores_stay_dealt_out(spark):
    """All blocks were brought into one task by adaptive execution."""
    df = spark.createDataFrame([(i, i % 2, (i * 7919 % 9000) / 9000) for i in range(9000)], "id long, label int, score double")
    plan = metrics.bootstrap_intervals(df, "id", 0.5, 100)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(block#\d+L?, 9\), REPARTITION_BY_NUM", plan)


def test_whole_chunks_are_searched():
    """Each draw of a whole chunk walked up the distribution function by itself, some 256 steps; the counts are the same."""
    rng = np.random.default_rng(11)
    share = rng.choice([0.5, 0.03, 0.97, 0.31, 0.499], 3000)
    n, u = np.full(3000, float(metrics.ONCE)), rng.random(3000)
    u[:5] = 0.5 / 2**32, 1 - 0.5 / 2**32, 0.5, 1e-3, 0.999
    p = np.minimum(share, 1 - share)
    pmf = np.power(1 - p, n)
    cdf, k, odds = pmf.copy(), np.zeros(3000), p / (1 - p)
    for step in range(metrics.ONCE):
        going = (cdf < u) & (k == step)
        pmf = pmf * ((n - step) / (step + 1)) * odds
        cdf, k = np.where(going, cdf + pmf, cdf), np.where(going, step + 1, k)
    assert (metrics._inverted(n, share, u) == np.where(share > 0.5, n - k, k)).all()

    class Seen(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            Seen.reads += 1
            return super().__getitem__(at)

    metrics._inverted(n, share, u.view(Seen))
    assert Seen.reads < 50  # the walk read it at every step


def test_audits(spark):
    df = spark.createDataFrame([("ACDEF", 1, "train", "g"), ("ac-def", 0, "test", "g"), ("KKKKK", 1, "train", "h"), (None, 0, "test", "i")], "sequence string, label int, split string, split_group string")
    got = {r.domain: r.status for r in audits.dataset_audit(df).collect()}
    assert got == {"Canonical sequences": "Critical issue", "Exact duplicates": "Needs revision", "Cross-label conflicts": "Critical issue", "Class balance": "Pass", "Group-disjoint split": "Critical issue", "Record provenance": "Needs revision"}
    with pytest.raises(ValueError):
        audits.dataset_audit(df.drop("label"))
    rows = audits.sequence_audit(with_features(spark.createDataFrame([("KWKLFKKIGAVLKVL",)], "sequence string")), 10, 42).collect()
    assert len(rows) == 5 and rows[-1].status == "Sequence-only limitation"
    reading = spark.createDataFrame([(0.5,), (0.9,), (0.1,)], "score double").select(audits.interpretation(F.col("score"), 0.5)).collect()
    assert [r[0] for r in reading] == ["Uncertain / borderline", "AMP-like", "Non-AMP-like"]
    library = audits.fixed_table(spark, audits.LIBRARY, audits.LIBRARY_COLUMNS)
    assert relational.search(library, " dbaasp").count() == 1 and relational.search(library, "", "Positive data").count() == 1 and relational.search(library, "[a-z]").count() == 0
    batch = audits.batch_screening(spark.createDataFrame([("ACDEFG",), ("X",), (None,)], "sequence string"), F.lit(0.9), 0.5).collect()
    assert [r.interpretation for r in batch] == ["AMP-like", "Invalid", "Invalid"] and batch[0].validation_error is None


def test_models(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 2), f"g{i}", ("train", "train", "train", "validation", "test")[(i // 2) % 5], (rng.standard_normal(6) + 1.5 * (i % 2)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, split_group string, split string, embedding array<double>")
    model, threshold, out, test = models.fit_and_test(df, models.fit_logistic, "embedding")
    assert 0 < threshold < 1 and test.first().roc_auc > 0.9 and out.filter("score < 0 or score > 1").isEmpty()
    models.save_model(model, str(tmp_path / "m"), {"threshold": threshold})
    loaded, metadata = models.load_model(str(tmp_path / "m"))
    assert metadata["threshold"] == threshold
    a, b = (models.predict(m, df, threshold, "embedding").orderBy("id").select("score").collect() for m in (model, loaded))
    assert a == b
    with pytest.raises(ValueError):
        models.training_frame(df.filter("split <> 'test'"))
    peps = spark.createDataFrame([("KWKLFKKIGAVLKVL"[: 8 + i % 7] + RESIDUES[i % 20], 1) if i % 2 else ("DESTNQDESTGNQDE"[: 8 + i % 7] + RESIDUES[i % 20], 0) for i in range(60)], "sequence string, label int")
    forest = models.fit_forest(with_features(peps), FEATURES, 5, 4)
    table = models.importance_table(forest, spark).collect()
    assert len(table) == 34 and table[0].importance >= table[-1].importance
    emb = models.embed(peps.limit(3), lambda seqs: [np.ones((len(s), 2)) * len(s) for s in seqs]).collect()
    assert all(r.embedding == [float(len(r.sequence))] * 2 for r in emb)


def test_prediction_audit_and_report(spark):
    rows = [("A" * (i + 5), ("train", "validation", "test")[i % 3], f"g{i}", i % 2, 0.1 + 0.08 * (i % 10)) for i in range(30)]
    df = spark.createDataFrame(rows, "sequence string, split string, split_group string, label int, score double")
    assert all(metrics.prediction_audit(df, 0.5, 10).first())
    bad = df.unionByName(spark.createDataFrame([("AAAAA", "other", "g1", 1, 1.5), ("C", "test", "gx", 0, None)], df.schema))
    got = metrics.prediction_audit(bad, 1.0, 10).first().asDict()
    assert got == dict.fromkeys(got, False)
    assert not metrics.prediction_audit(df.limit(0), 0.5).first().three_splits
    report = {r["dataset"]: r for r in metrics.metric_report(df, 0.5).collect()}
    assert set(report) == {"validation", "held-out test"} and report["validation"].n == 10 and report["validation"].asDict().keys() == {"dataset", *metrics.REPORT}


def test_predict_from_raw_text(spark):
    rng = random.Random(3)
    rows = sorted({("".join(rng.choice("KRLA" if i % 2 else "DESG") for _ in range(12)), i % 2) for i in range(60)})
    df = spark.createDataFrame(rows, "sequence string, label int")
    model = models.fit_forest(with_features(df), trees=10, depth=4)
    metadata = {"kind": models.FOREST_KIND, "threshold": 0.5}
    out = models.predict_sequences(model, metadata, spark.createDataFrame([(">h\nkrl-aKRLAKRLA",), ("DESGDESGDESG",)], "raw string"), "raw")
    assert out.columns == ["sequence", *FEATURES, "score", "threshold", "interpretation", "binary_prediction"]
    assert {r.sequence: r.binary_prediction for r in out.collect()} == {"KRLAKRLAKRLA": 1, "DESGDESGDESG": 0}
    assert models.predict_sequences(model, metadata, df.limit(0)).count() == 0
    with pytest.raises(Exception, match="Invalid symbol"):
        models.predict_sequences(model, metadata, spark.createDataFrame([("XXXXXX",)], "sequence string")).collect()
    with pytest.raises(ValueError, match="Unsupported model kind"):
        models.predict_sequences(model, {"threshold": 0.5}, df)
    with pytest.raises(ValueError, match="encoder"):
        models.predict_sequences(model, {"kind": models.EMBEDDING_KIND, "threshold": 0.5}, df)


def test_predict_with_an_encoder(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(x.tolist(), int(x[0] > 0)) for x in rng.standard_normal((80, 2))], "embedding array<double>, label int")
    model = models.fit_logistic(rows)

    def encoder(sequences):
        return [np.array([[1.0 if a == "K" else -1.0, 0.0] for a in s]) for s in sequences]

    out = models.predict_sequences(model, {"kind": models.EMBEDDING_KIND, "threshold": 0.5}, spark.createDataFrame([("KKKKKA",), ("AAAAAA",)], "sequence string"), encoder=encoder).collect()
    assert {r.sequence: r.binary_prediction for r in out} == {"KKKKKA": 1, "AAAAAA": 0}


def test_thresholds_are_checked(spark):
    df = spark.createDataFrame([("ACDEF",)], "sequence string")
    for bad in (0, -1, 1.1):
        with pytest.raises(ValueError, match="similarity threshold"):
            similarity.greedy_groups(df, bad)


def test_toy_dataset(spark):
    rows = dataset.toy_dataset(spark).collect()
    assert len(rows) == len({r.sequence for r in rows}) == len({r.source_id for r in rows}) == 240
    assert sorted(r.source_id for r in rows) == [f"toy_{i:04d}" for i in range(240)] and all(r.source_id < "toy_0120" for r in rows if r.label)
    assert {r.split for r in rows} == {"train", "validation", "test"} and all(10 <= r.length <= 42 for r in rows)


def test_scratch_is_deleted(spark):
    import os

    from residua.plans import storage

    storage.clean(spark)
    scratch = storage.Scratch(spark)
    a, b = scratch.table(spark.range(3)), scratch.table(spark.range(4))
    scratch.drop(a)
    folder = scratch.root.removeprefix("file:")
    assert os.listdir(folder) == ["2"] and b.count() == 4
    storage.clean(spark)
    assert not os.path.exists(folder)


def test_fragments_use_up_a_space(spark):
    """Sixteen fragments of five there are, and sixteen are found, whatever the walk's order; the seventeenth isn't."""
    one = spark.createDataFrame([("p", "ACDEFGHIKLMNPQRSTVWY"), ("q", "ACDEF")], "id string, sequence string")
    nothing = spark.createDataFrame([], "sequence string")
    want = spark.createDataFrame([(i, 5) for i in range(16)], "fragment_index long, size int")
    made = dataset.negative_fragments(one, want, nothing, 3).collect()
    assert {r.sequence for r in made} == {"ACDEFGHIKLMNPQRSTVWY"[i : i + 5] for i in range(16)} and {r.fragment_index for r in made} == set(range(16))
    with pytest.raises(RuntimeError, match="not enough"):
        dataset.negative_fragments(one, spark.createDataFrame([(i, 5) for i in range(17)], "fragment_index long, size int"), nothing, 3)
    walked = spark.range(256).select(dataset.permuted(F.col("id"), F.lit(4), F.lit("5"), "s").alias("x")).collect()
    assert sorted(r.x for r in walked) == list(range(256)) and [r.x for r in walked] != list(range(256))


def test_representatives_by_blocks(spark):
    """The sequential rule on a chain longer than its blocks, and on a random graph."""
    names = [f"{i:05d}" for i in range(10_001)]
    chain = spark.createDataFrame(list(zip(names, names[1:])), "u string, v string")
    assert sorted(r.node for r in similarity.representatives(chain, 6000).collect()) == names[::2]
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(names[:600], 2))) for _ in range(1500)}
    near = {}
    for a, b in edges:
        near.setdefault(b, set()).add(a)
    leads = set()
    for x in sorted({x for e in edges for x in e}):
        if not near.get(x, set()) & leads:
            leads.add(x)
    graph = spark.createDataFrame(sorted(edges), "u string, v string")
    for block in (1 << 20, 300):
        assert {r.node for r in similarity.representatives(graph, block).collect()} == leads


def test_fragments_of_long_parents_and_joins_by_slot(spark):
    """Every walked number met all spans of its size, and all were drawn in one task: adaptive execution brought the chunks together."""
    parents = spark.createDataFrame([(k, "".join(np.random.default_rng(k).choice(list("ACDEFGHIKLMNPQRSTVWY"), 40 + 700 * k))) for k in range(6)], "id long, sequence string")
    targets = spark.range(600).selectExpr("id AS fragment_index", "cast(10 + id % 3 AS int) AS size")
    joins = []
    real = dataset.Scratch.table

    def seen(self, df):
        if "step" in df.columns and "sequence" in df.columns and "nth" not in df.columns:
            joins.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(self, df)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(dataset.Scratch, "table", seen)
        rows = dataset.negative_fragments(parents, targets, spark.createDataFrame([], "sequence string")).collect()
    texts = {str(r.id): r.sequence for r in parents.collect()}
    assert len(rows) == 600 and len({r.sequence for r in rows}) == 600
    for r in rows:
        first, last = map(int, r.source_id.rsplit(":", 1)[1].split("-"))
        assert texts[r.parent_id][first - 1 : last] == r.sequence
    assert any(int(r.source_id.rsplit(":", 1)[1].split("-")[0]) > 2 * dataset.PIECE for r in rows)
    assert "RepartitionByExpression [size" in joins[0] and re.search(r"\(slot#\d+L? = slot#\d+L?\)", joins[0])
    assert not re.search(r"RepartitionByExpression \[size[^\]]*\]\n", joins[0])  # a number of partitions follows


def test_negative_fragments_broadcast_no_walked_numbers(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    parents = spark.createDataFrame([(i, "ACDEFGHIKLMNPQRSTVWY" * 5 + "ACDEF"[i:]) for i in range(4)], "id int, sequence string")
    targets = spark.createDataFrame([(i, 5 + i % 3) for i in range(30)], "fragment_index long, size int")
    made = dataset.negative_fragments(parents, targets, spark.createDataFrame([("ACDEF",)], "sequence string"))
    assert len({r.sequence for r in made.collect()}) == 30
    runs = store.executionsList()
    plans = "\n".join(runs.apply(i).physicalPlanDescription() for i in range(int(before), runs.size()))
    inputs = re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*?)\]", plans)
    assert inputs and not [c for c in inputs if re.search(r"\b(x|nth|of_nth)#", c)]
