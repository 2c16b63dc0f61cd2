"""Queries against their SQL on a few of the driver's rows, where these are there."""

import inspect
import os

import numpy as np
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
CHEAP = ("normalize_status", "cleaning_report", "feature_charge", "split_profile", "similarity_pairs", "binary_metrics", "evidence_matrix")


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ("rf_features", "rf_importance"))
def test_registered_forests_are_the_full_setting(monkeypatch, name):
    from residua.functions.constants import FEATURES
    from residua.operators import forest, models
    from residua.plans import catalogue

    class Fitted(Exception):
        pass

    class Frame:
        def filter(self, _):
            return self

    monkeypatch.setattr(catalogue.X, "lab", lambda *_: Frame())
    asked = []
    monkeypatch.setattr(catalogue, "with_features", lambda df, names=FEATURES: asked.append(tuple(names)) or df)
    monkeypatch.setattr(catalogue.splitting, "random_split", lambda df, *_: df)
    monkeypatch.setattr(catalogue, "stored", lambda df: df)
    monkeypatch.setattr(models, "training_frame", lambda df: None)
    fit = inspect.signature(forest.fit_forest)

    def stop(*given, **named):
        asked_of = fit.bind(*given, **named)
        asked_of.apply_defaults()
        raise Fitted(asked_of.arguments)

    monkeypatch.setattr(models.forest, "fit_forest", stop)
    with pytest.raises(Fitted) as e:
        catalogue.QUERIES[name](None, "")
    given = e.value.args[0]
    assert (given["trees"], given["depth"], given["leaf"], given["key"]) == (500, 30, 2, "source_id")
    assert (asked[0], given["features"]) == (FEATURES, FEATURES) and len(FEATURES) == 34
    assert forest.drawn_features(np.arange(1, 9), len(FEATURES), 42, 0).shape == (8, 5)  # the root of 34


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_and_sql_agree(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    a = c.execute(__spark_entry__.oracle_sql()[name]).df()
    b = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    rows = [sorted(map(repr, x[names].astype(object).where(x[names].notna(), None).map(lambda v: round(float(v), 6) if isinstance(v, (int, float)) else v).itertuples(index=False, name=None))) for x in (a, b)]
    assert rows[0] == rows[1]
