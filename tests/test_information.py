"""Information value over many features, percentiles by key, and correlations inside a league only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.operators import features as X
from scoutframe.operators.quantiles import keyed_percentiles


def test_percentiles_by_key(spark):
    rng = np.random.default_rng(1)
    groups = {"even": rng.standard_normal(501), "heavy": rng.integers(0, 3, 400).astype(float), "one": np.array([7.0]), "wide": np.array([-1e308, 1e308, 0.0]), "same": np.full(50, 2.5)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = {r.feature: r.edges for r in keyed_percentiles(spark.createDataFrame(rows, "feature string, v double"), probs, bins=16).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        if k == "wide":
            assert got[k][0] == -1e308 and got[k][-1] == 1e308
        else:
            assert got[k] == pytest.approx(np.quantile(values, probs).tolist(), abs=1e-12)


def test_a_thousand_features(spark):
    """The plan has the same operators for any number of features."""
    wide = spark.range(300).select((F.col("id") % 2).alias("y"), *[((F.col("id") * (2 * k + 1)) % 97 + F.when(F.col("id") % 11 == 0, None).otherwise(0)).alias(f"f{k}") for k in range(1_000)])
    found = X.information_value(wide, "y", [f"f{k}" for k in range(1_000)])
    one = found.groupBy("feature").agg(F.sum("n").alias("n"), F.max("share_missing").alias("missing")).collect()
    assert len(one) == 1_000 and all(r.n == 300 and abs(r.missing - 28 / 300) < 1e-9 for r in one)


def test_levels_are_bins(spark):
    rows = [(1, "a", 1), (1, "a", 2), (0, "a", 2), (0, "b", 3), (1, None, 4), (0, None, None)]
    found = X.information_value(spark.createDataFrame(rows, "y int, c string, who int"), "y", [], categorical=["c"], entity="who").collect()
    assert {(r.bin, r.level, r.n, r.entities) for r in found} == {(0, "a", 3, 2), (1, "b", 1, 1), (-1, None, 2, 1)}


def test_only_pairs_of_one_league_are_compared(spark, monkeypatch):
    rows = spark.range(200).select((F.col("id") % 2).alias("y"), *[(F.col("id") * k % 31).alias(f) for f, k in (("p1", 3), ("p2", 3), ("team_t1", 3), ("team_t2", 7))])
    iv = spark.createDataFrame([("p1", 0.2, 0.0, "Medium"), ("p2", 0.3, 0.0, "Medium"), ("team_t1", 0.2, 0.0, "Medium"), ("team_t2", 0.1, 0.0, "Low")], "feature string, total_iv double, share_missing double, strength string")
    seen = []
    plain = X.feature_correlations
    monkeypatch.setattr(X, "feature_correlations", lambda df, pairs: seen.extend(pairs) or plain(df, pairs))
    kept = X.iv_tournament(rows, iv, X.feature_taxonomy(iv.select("feature"))).collect()
    assert {frozenset(p) for p in seen} == {frozenset(("p1", "p2")), frozenset(("team_t1", "team_t2"))}
    assert {r.feature for r in kept} == {"p2", "team_t1", "team_t2"}
