"""Exact quantiles against Spark's own, and the forest: trees that don't depend on partitions, scores walked in SQL, plain growth."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.operators import forest, relational
from residua.operators.quantiles import exact_quantiles


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 7 == 0 else i % 3, float(x)) for i, x in enumerate(rng.lognormal(0, 5, 4000))]
    rows += [(5, x) for x in (1.0, 1.0, float("inf"), float("-inf"), None)] + [(6, None), (7, float("nan")), (7, 2.0), (7, 5.0)]
    rows += [(8, x) for x in (1e308, -1e308, 3.0, 5e-324)] + [(9, 4.0)] * 50
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    qs = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {r.g: (r.n, r.q) for r in exact_quantiles(df, "v", ("g",), qs).collect()}
    want = {r.g: (r.n, r.q) for r in df.filter("v is not null").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect()}
    assert got.keys() == want.keys() and 6 not in got
    for g in want:
        assert got[g][0] == want[g][0]
        np.testing.assert_array_equal(got[g][1], want[g][1])
    assert exact_quantiles(df.limit(0), "v", (), (0.5,)).collect() == []
    assert exact_quantiles(df, "v", (), (0.3,)).first().q == [df.agg(F.percentile("v", F.lit(0.3))).first()[0]]
    with pytest.raises(ValueError, match="quantiles"):
        exact_quantiles(df, "v", (), (1.5,))


def test_summaries_sort_no_class(spark):
    """The plans of the summaries hold no percentile over a table, and their results are Spark's."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("ACDEFGHIK"[: 3 + i % 6], i % 2, *map(float, rng.normal(size=2))) for i in range(500)], "sequence string, label int, a double, b double")
    out = relational.class_summary(df, ("a", "b"))
    plan = out._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median(" not in plan
    want = {(r.label, r.feature): r.m for r in df.unpivot(["label"], ["a", "b"], "feature", "value").groupBy("label", "feature").agg(F.round(F.median("value"), 3).alias("m")).collect()}
    assert {(r.label, r.feature): r["median"] for r in out.collect()} == want
    header = relational.dataset_header(df).first()
    assert header.median_length == df.agg(F.median(F.length("sequence"))).first()[0]
    none = relational.dataset_header(df.limit(0)).first()
    assert none["rows"] == 0 and none.median_length is None


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6)).round(2)
    y = ((x[:, 0] + x[:, 1] > 0.8) ^ (rng.random(600) < 0.05)).astype(int)  # about a quarter is positive
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(600)]
    rows += [(1000, 1, None, float("nan"), 0.0, 0.0, 0.0, 0.0), (1001, None, *[0.0] * 6)]
    return spark.createDataFrame(rows, "id long, label int, " + ", ".join(f"f{k} double" for k in range(6)))


NAMES = tuple(f"f{k}" for k in range(6))


def nodes(found):
    return sorted(map(tuple, found.nodes.select("tree", "node", "feature", "bin", "gain", "rows", "score").collect()))


def test_trees_depend_on_rows_alone(spark, labelled):
    kinds = {"key": "id", "trees": 6, "depth": 9, "seed": 5}
    one = forest.fit_forest(labelled.coalesce(1), NAMES, **kinds)
    want = nodes(one)
    again = forest.fit_forest(labelled.repartition(7), NAMES, few=40, **kinds)
    assert again.edges == one.edges
    # Of nodes that are split where rows are and of those grown in one task the same tree results.
    assert [n[:4] + n[5:6] for n in nodes(again)] == [n[:4] + n[5:6] for n in want]
    np.testing.assert_allclose([n[6] for n in nodes(again)], [n[6] for n in want])
    by_tree = {}
    for t, node, feature, *_ in want:
        by_tree.setdefault(t, {})[node] = feature
    for tree in by_tree.values():
        assert all((2 * n in tree) == (2 * n + 1 in tree) == (f >= 0) for n, f in tree.items())
        assert max(tree).bit_length() - 1 <= 9
    assert all(rows >= 2 for _, node, _, _, _, rows, _ in want if node > 1)


def test_bags_are_balanced(spark, labelled):
    """A tree's root has the score 1/2, whatever the classes' shares: weights are those of its own bag."""
    found = forest.fit_forest(labelled, NAMES, key="id", trees=5, depth=3)
    assert all(abs(r.score - 0.5) < 1e-9 for r in found.nodes.filter("node = 1").collect())
    n = [r["rows"] for r in found.nodes.filter("node = 1").collect()]
    assert all(0.55 * 601 < k < 0.72 * 601 for k in n) and len(set(n)) > 1


def test_scores_walked_in_sql(spark, labelled, tmp_path):
    found = forest.fit_forest(labelled, NAMES, key="id", trees=7, depth=8)
    sent = {r.id: r.score for r in forest.forest_scores(found, labelled).collect()}
    joined = {r.id: r.score for r in forest.forest_scores(found, labelled, sent=0).collect()}
    assert sent.keys() == joined.keys() and all(abs(sent[i] - joined[i]) < 1e-12 for i in sent)
    found.nodes.write.parquet(str(tmp_path / "nodes"))
    labelled.write.parquet(str(tmp_path / "rows"))
    value = " ".join(f"WHEN {k} THEN len(list_filter({e}::DOUBLE[], lambda e: e < coalesce(CASE WHEN NOT isnan(f{k}) THEN f{k} END, {m})))" for k, (e, m) in enumerate(zip(found.edges, found.medians)))
    sql = f"""WITH RECURSIVE n AS (SELECT * FROM read_parquet('{tmp_path}/nodes/*.parquet')), r AS (SELECT * FROM read_parquet('{tmp_path}/rows/*.parquet')), walk AS (
        SELECT id, tree, 1::BIGINT AS node FROM r, (SELECT DISTINCT tree FROM n)
        UNION ALL SELECT w.id, w.tree, 2 * w.node + (CASE n.feature {value} END > n.bin)::INT FROM walk w JOIN n USING (tree, node) JOIN r ON r.id = w.id WHERE n.feature >= 0
    ) SELECT id, avg(score) FROM walk JOIN n USING (tree, node) WHERE n.feature < 0 GROUP BY id"""
    walked = dict(duckdb.sql(sql).fetchall())
    assert walked.keys() == sent.keys() and all(abs(walked[i] - sent[i]) < 1e-9 for i in sent)
    truth = {r.id: r.label for r in labelled.filter("label is not null").collect()}
    assert np.mean([(sent[i] >= 0.5) == y for i, y in truth.items()]) > 0.9
    assert found.importance().keys() == set(NAMES) and sum(sorted(found.importance().values())[-2:]) > 0.5


def test_scores_by_some_trees_at_a_time(spark, labelled, monkeypatch):
    """A forest of more nodes than are sent met its rows in joins: a row a tree and level, though each tree was small."""
    found = forest.fit_forest(labelled, NAMES, key="id", trees=7, depth=8)
    whole = {r.id: r.score for r in forest.forest_scores(found, labelled).collect()}
    largest = max(r["count"] for r in found.nodes.groupBy("tree").count().collect())
    written, real = [], forest.Scratch.table
    monkeypatch.setattr(forest.Scratch, "table", lambda self, df: written.append(df.columns) or real(self, df))
    parts = {r.id: r.score for r in forest.forest_scores(found, labelled, sent=2 * largest).collect()}
    assert parts == whole and len(written) > 4
    assert not any("tree" in c for c in written)


def test_one_class_and_nothing(spark, labelled):
    only = forest.fit_forest(labelled.filter("label = 1"), NAMES, key="id", trees=2)
    assert {(r.node, r.feature, r.score) for r in only.nodes.collect()} == {(1, -1, 1.0)}
    none = forest.fit_forest(labelled.limit(0), NAMES, key="id", trees=2)
    assert [r.score for r in forest.forest_scores(none, labelled.limit(1)).collect()] == [0.5]


def test_growth_against_plain_splits():
    """Every split is the best of its drawn features by weighted Gini."""
    rng = np.random.default_rng(8)
    bins = rng.integers(0, 12, (200, 5)).astype(np.uint8)
    y = (bins[:, 0] + rng.integers(0, 8, 200) > 9).astype(np.int64)
    times = rng.integers(1, 4, 200).astype(float)
    weights = (0.7, 1.9)
    got = {r.node: r for r in forest.grow(bins, y, times, 1, 0, weights, 1, 6, 2).itertuples()}
    members = {1: np.arange(200)}

    def weighted_gini(i):
        a, b = (times[i] * (y[i] == 0)).sum() * weights[0], (times[i] * (y[i] == 1)).sum() * weights[1]
        return 2 * a * b / (a + b) if a + b else 0.0

    for node in sorted(got):
        i, r = members[node], got[node]
        assert r.rows == len(i)
        options = [(weighted_gini(i) - weighted_gini(i[bins[i, f] <= c]) - weighted_gini(i[bins[i, f] > c]), f, c) for f in forest.drawn_features(np.array([node]), 5, 1, 0)[0] for c in range(12) if min((bins[i, f] <= c).sum(), (bins[i, f] > c).sum()) >= 2]
        if r.feature < 0:
            assert not options or len(set(y[i])) < 2 or node.bit_length() - 1 == 6
            continue
        assert abs(r.gain - max(o[0] for o in options)) < 1e-9
        assert abs(next(o[0] for o in options if o[1:] == (r.feature, r.bin)) - r.gain) < 1e-9
        members[2 * node], members[2 * node + 1] = i[bins[i, r.feature] <= r.bin], i[bins[i, r.feature] > r.bin]


def test_growth_looks_at_filled_bins_only(monkeypatch):
    """All 64 bins of every small node were filled and judged; the trees of both ways are the same, to the last bit."""
    rng = np.random.default_rng(9)
    bins = rng.integers(0, 64, (4000, 7)).astype(np.uint8)
    bins[:, 1] //= 16
    y = (bins[:, 0] + rng.integers(0, 80, 4000) > 90).astype(np.int64)
    times = rng.integers(1, 4, 4000).astype(float)
    given = (bins, y, times, 1, 3, (0.6, 2.3), 4, 30, 2)
    with monkeypatch.context() as m:
        m.setattr(forest, "DIGITS", 1)  # too few for these counts
        whole = forest.grow(*given)
    monkeypatch.setattr(forest, "_count", None)
    filled = forest.grow(*given)
    assert len(whole) > 500 and whole.equals(filled)
