import math

import pytest
from pyspark.sql import functions as F

from residua.functions import constants as K
from residua.functions.features import feature_columns, feature_label, scaled_position, with_features
from residua.functions.sequence import cluster_id, edit_similarity, fragment, fragment_id, normalize_sequence, parent_sequence, sequence_sha256, status_title


def normalised(spark, rows, **k):
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    return [(r.n.sequence, r.n.error_code, r.n.error) for r in df.select(normalize_sequence(F.col("raw"), **k).alias("n")).collect()]


def test_normalize(spark):
    got = normalised(spark, [" acd-efg \n", ">example\nACD EFG\n", "ACDEXG", "ACD", "A" * 201, None, "  ", ">only", ">h\n>AC DEF", "- -", "acz1def"])
    assert [g[0] for g in got] == ["ACDEFG", "ACDEFG"] + [None] * 9
    assert [g[1] for g in got] == [None, None, "invalid_symbol", "too_short", "too_long", "missing", "empty", "no_residues", "invalid_symbol", "no_residues", "invalid_symbol"]
    assert got[10][2].endswith("Invalid symbol(s): 1, Z.") and got[3][2] == "Sequence is too short (3 aa); minimum is 5."


def test_small_functions(spark):
    r = spark.range(1).select(
        sequence_sha256(F.lit("ACDEFG")).alias("sha"), parent_sequence(F.lit("ac d-e")).alias("parent"), parent_sequence(F.lit("acx")).alias("no_parent"),
        fragment(F.lit("ACDEFG"), F.lit(2), F.lit(3)).alias("piece"), fragment_id(F.lit("p"), F.lit(2), F.lit(3)).alias("piece_id"), cluster_id(F.lit(7)).alias("cluster"),
        edit_similarity(F.lit("ACDEF"), F.lit("ACDEG")).alias("sim"), status_title(F.lit("real_data")).alias("title"),
        scaled_position(F.lit(5.0), F.lit(0.0), F.lit(10.0)).alias("mid"), scaled_position(F.lit(5.0), F.lit(3.0), F.lit(3.0)).alias("flat"),
        feature_label(F.lit("aa_K")).alias("aa"), feature_label(F.lit("gravy")).alias("gravy"),
    ).first()
    assert len(r.sha) == 64 and (r.parent, r.no_parent, r.piece, r.piece_id, r.cluster, r.title) == ("ACDE", "", "DEF", "p:3-5", "cluster_000007", "Real Data")
    assert r.sim == pytest.approx(0.8) and (r.mid, r.flat, r.aa, r.gravy) == (0.5, 0.5, "K", "Mean hydropathy (GRAVY)")


def plain_charge(s, ph):
    plus = sum(s.count(a) / (1 + 10 ** (ph - pk)) for a, pk in K.PK_POSITIVE.items()) + 1 / (1 + 10 ** (ph - K.PK_N_TERMINUS_OF.get(s[0], K.PK_N_TERMINUS)))
    minus = sum(s.count(a) / (1 + 10 ** (pk - ph)) for a, pk in K.PK_NEGATIVE.items()) + 1 / (1 + 10 ** (K.PK_C_TERMINUS_OF.get(s[-1], K.PK_C_TERMINUS) - ph))
    return plus - minus


def test_features(spark):
    sequences = ["KWKLFKKIGAVLKVL", K.RESIDUES, "KKKKK", "DDDDD", "MAAAPE"]
    rows = {r.sequence: r for r in with_features(spark.createDataFrame([(s,) for s in sequences], "sequence string")).collect()}
    for s, r in rows.items():
        assert all(math.isfinite(r[f]) for f in K.FEATURES) and list(r.asDict())[1:] == list(K.FEATURES)
        assert sum(r[f] for f in K.COMPOSITION_FEATURES) == pytest.approx(1)
        assert r.net_charge_pH7 == pytest.approx(plain_charge(s, 7.0)) and r.charge_density == pytest.approx(plain_charge(s, 7.0) / len(s))
        assert r.gravy == pytest.approx(sum(K.KYTE_DOOLITTLE[a] for a in s) / len(s))
        x, y = (sum(K.EISENBERG[a] * f(math.radians(100 * i)) for i, a in enumerate(s)) for f in (math.cos, math.sin))
        assert r.hydrophobic_moment == pytest.approx(math.hypot(x, y) / len(s))
        assert r.molecular_weight == pytest.approx(sum(K.MASSES[a] for a in s) - (len(s) - 1) * K.WATER)
        assert r.instability_index == pytest.approx(10 / len(s) * sum(K.INSTABILITY[a].get(b, 1.0) for a, b in zip(s, s[1:])))
        assert abs(plain_charge(s, r.isoelectric_point)) < 0.01 or r.isoelectric_point < 4.06 or r.isoelectric_point > 11.99
    assert rows["KKKKK"].net_charge_pH7 > 0 > rows["DDDDD"].net_charge_pH7 and rows["KKKKK"].shannon_entropy == 0


def test_counts_leave_columns_of_their_name(spark):
    df = spark.createDataFrame([("ACDEF", "mine")], "sequence string, __count_A string")
    row = with_features(df, names=("aa_A",)).first()
    assert row["__count_A"] == "mine" and row.aa_A == 0.2


def test_normalisation_computes_each_step_once(spark):
    """Column expressions were put in wherever a message or a code named them: some hundred regular expressions a row."""
    rows = spark.createDataFrame([(" >h\nac-de fg\u0085",), ("ACDXB",), (None,), ("　",)], "raw string")
    got = rows.select(normalize_sequence(F.col("raw"))["error"].alias("message"), normalize_sequence(F.col("raw"))["sequence"].alias("sequence"))
    assert [tuple(r) for r in got.collect()] == [(None, "ACDEFG"), ("Only the 20 canonical one-letter amino-acid codes are accepted. Invalid symbol(s): B, X.", None), ("Sequence is missing.", None), ("Sequence is empty.", None)]
    plan = rows.select(normalize_sequence(F.col("raw"))["error"].alias("message"))._jdf.queryExecution().optimizedPlan().expressions().toString()
    assert 0 < plan.lower().count("regexp_replace") <= 3


def test_isoelectric_points_by_batch(spark):
    """The bisection was interpreted row by row; the batch finds the same points, and none of a null."""
    rows = ["ACDEFGHIKLMNPQRSTVWY", "KKKKK", "DDDDD", "A", "MEEEED", "PHHHHCY", "RRKKCCYYE", None]
    df = spark.createDataFrame([(s,) for s in rows], "sequence string")
    got = with_features(df, names=("isoelectric_point", "length"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    found = {r.sequence: r.isoelectric_point for r in got.collect()}
    want = {r.sequence: r.p for r in df.select("sequence", feature_columns(F.col("sequence"), ("isoelectric_point",))["isoelectric_point"].alias("p")).collect()}
    assert found.pop(None) is None and len(found) == 7
    assert all(found[s] == want[s] for s in found)
