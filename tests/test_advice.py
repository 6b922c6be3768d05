"""Queries that once ran a smaller job than the whole one."""

import inspect

import pytest
from pyspark.sql import functions as F

from scoutframe.models import search, training
from scoutframe.plans import models
from scoutframe.plans.catalog import QUERIES
from scoutframe.sources.tables import staged


class Seen(Exception):
    pass


def asked(monkeypatch, spark, folder, query, function, module=training):
    """The arguments with which a query calls a function of a module; the function itself is not run."""
    shape = inspect.signature(getattr(module, function))

    def stop(*args, **kwargs):
        bound = shape.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Seen(bound.arguments)

    monkeypatch.setattr(module, function, stop)
    with pytest.raises(Seen) as found:
        QUERIES[query](spark, folder)
    return found.value.args[0]


@pytest.mark.parametrize("query", ["m1_boosted_search", "m2_forest_search"])
def test_searches_are_whole(monkeypatch, spark, folder, query):
    a = asked(monkeypatch, spark, folder, query, "random_search", search)
    assert (a["draws"], a["folds"]) == (100, 5) and search.SPACES[a["family"]]["trees"].high == 600


def test_neural_grid_is_whole(monkeypatch, spark, folder):
    a = asked(monkeypatch, spark, folder, "m3_neural_grid", "neural_grid")
    assert len(a["layers"]) == 6 and len(a["seeds"]) == 3 and a["iterations"] == 50


def test_permutation_takes_all_columns(monkeypatch, spark, folder):
    a = asked(monkeypatch, spark, folder, "m14_permutation_importance", "permutation_importance")
    assert sorted(a["columns"]) == sorted([*models.NUMERIC, *models.CATEGORICAL])
    assert a["model"].stages[-1].getNumTrees == 20


def test_every_target_is_fitted_and_scored(spark, folder):
    assert len(models.TARGETS) == 30
    rows = QUERIES["m12_refit_on_all_rows"](spark, folder).collect()
    assert sorted(r.response_var for r in rows) == sorted(models.TARGETS)
    assert all(0 <= r.training_log_loss < 1 for r in rows)


def test_sweep_has_every_risk_aversion_and_bet(spark):
    out = staged(QUERIES["b10_weight_sweep"](spark, "/root/testdata/sf0.01"), "sweep")  # the smallest tables have no week of more than ten bets
    rows = out.groupBy("season", "week").agg(F.count_distinct("gamma_index").alias("k"), F.count("*").alias("n")).collect()
    assert rows and all(r.k == 100 for r in rows)
    assert out.groupBy("season", "week", "gamma_index").count().where("count > 10").count() > 0
