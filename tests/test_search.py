"""Searches on counts: the trees against a plain version, what they learn, and the counting pass."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.models import search as H


def plain_tree(bins, categories, first, second, depth, gain, value, level=0):
    """Depth-first and by single rows, for one tree."""
    best, rule = 1e-12, None
    if depth is None or level < depth:
        for f in range(bins.shape[1]):
            for cut in range(int(bins.max()) + 1):
                left = bins[:, f] == cut if categories[f] else bins[:, f] <= cut
                rated = float(gain(first[left].sum(), second[left].sum(), first.sum(), second.sum()))
                if rated > best + (0 if rule is None else 1e-12):
                    best, rule = rated, left
    if rule is None:
        return np.full(len(bins), value(first.sum(), second.sum()))
    out = np.empty(len(bins))
    for side in (rule, ~rule):
        out[side] = plain_tree(bins[side], categories, first[side], second[side], depth, gain, value, level + 1)
    return out


def _gain(g, h, all_g, all_h):
    right_g, right_h = all_g - g, all_h - h
    return np.where((h >= 2) & (right_h >= 2), g * g / (h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1), -1.0)


@pytest.mark.parametrize("depth", [0, 1, 3, None])
def test_trees_are_those_of_a_plain_version(depth):
    rng = np.random.default_rng(1)
    bins, categories = rng.integers(0, 5, (60, 3)), np.array([False, False, True])
    first, second = rng.standard_normal((60, 4)), rng.integers(0, 4, (60, 4)).astype(float)
    got = H.grow(bins, categories, first, second, depth, _gain, lambda g, h: -g / (h + 1))
    for t in range(4):
        assert np.allclose(got[:, t], plain_tree(bins, categories, first[:, t], second[:, t], depth, _gain, lambda g, h: -g / (h + 1)))


def test_draws_stay_in_their_ranges():
    for family, space in H.SPACES.items():
        draws = H.draw_settings(family, 100, 123)
        assert draws == H.draw_settings(family, 100, 123) and len({tuple(x.items()) for x in draws}) > 95
        for x in draws:
            assert all(x[k] in v if isinstance(v, tuple) else v.low <= x[k] < v.high for k, v in space.items())


@pytest.fixture(scope="module")
def rows(spark):
    numbers = spark.range(4_000).withColumn("a", F.expr("double(id * 37 % 101)")).withColumn("b", F.expr("if(id % 9 = 0, null, double(id * 53 % 89))"))
    named = numbers.withColumn("c", F.expr("case id % 4 when 0 then null when 1 then 'x' when 2 then 'y' else 'rare ' || id % 1000 end"))
    return named.withColumn("label", F.expr("double(int(a > 50) ^ int(coalesce(c, '') = 'x'))")).withColumn("fold", F.expr("int(id % 5)"))


def test_cells_hold_every_row_once(rows):
    cells = H.training_cells(rows, "label", "fold", ["a", "b"], ["c"], bins=16, max_cells=100_000)
    assert cells.agg(F.sum("n"), F.sum("ones")).first() == (rows.count(), rows.where("label = 1").count())
    few = H.training_cells(rows, "label", "fold", ["a", "b"], ["c"], bins=16, max_cells=100)
    assert few.select("a", "b", "c").distinct().count() <= 100 and few.agg(F.sum("n")).first()[0] == 4_000
    with pytest.raises(ValueError):
        H.training_cells(rows, "label", "fold", ["a", "b"], ["c"], max_cells=3)


@pytest.mark.parametrize("family", ["boosted", "forest"])
def test_search_learns_and_chooses_the_least_loss(rows, family, monkeypatch):
    small = dict(H.SPACES[family], trees=H.Range(20, 60))
    monkeypatch.setitem(H.SPACES, family, small)
    found = H.random_search(rows, family, ["a", "b"], ["c"], draws=8, max_cells=500).collect()
    again = H.random_search(rows.repartition(3), family, ["a", "b"], ["c"], draws=8, max_cells=500).collect()
    assert sorted(r.draw for r in found) == list(range(8)) and sorted(map(tuple, found)) == sorted(map(tuple, again))
    least = min(found, key=lambda r: (r.log_loss, r.draw))
    assert [r.draw for r in found if r.chosen] == [least.draw]
    assert least.log_loss < 0.2 < math.log(2)  # the label is a function of the features
