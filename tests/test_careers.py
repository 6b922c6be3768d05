"""Rank-sum tests over careers: against counting every past by itself, and without a history in any row."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.operators import contributors as K
from scoutframe.operators import features as X
from scoutframe.operators import ranks as R

SCHEMA = "family string, entity int, season int, week int, team int, metric double, group_metric double, share double"
TAILS = R.chances_at_least(R.EXACT_BELOW)


def one_test(first, second, less):
    """(z, p) by counting all pairs; None where no test can be made."""
    n1, n2 = len(first), len(second)
    if n1 < 2 or n2 < 2:
        return None
    u = sum((a > b) + 0.5 * (a == b) for a in first for b in second)
    both = list(first) + list(second)
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    n = n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if variance == 0:
        return None
    z = (u - n1 * n2 / 2 + (0.5 if less else -0.5)) / math.sqrt(variance)
    if ties == 0 and n1 < R.EXACT_BELOW and n2 < R.EXACT_BELOW:
        return z, TAILS[n1, n2][int(n1 * n2 - u if less else u)]
    tail = 0.5 * math.erfc(z / math.sqrt(2))
    return z, 1 - tail if less else tail


def moves(past, less=False):
    groups = list(dict.fromkeys(k for _, k in past if k is not None))
    of = {k: [x for x, g in past if g == k] for k in groups}
    found = [one_test(of[a], of[b], less) for i, a in enumerate(groups) for b in groups[i + 1 :]]
    return [f for f in found if f]


def some_careers(seed=3, lengths=(1, 2, 5, 17, 40, 70), distinct=9):
    """(entity, t, x, k): values tie, some values and groups are missing, one entity has no number."""
    rng = np.random.default_rng(seed)
    entities = [None, *range(1, len(lengths))]
    return [
        (e, t, None if rng.random() < 0.1 else float(rng.integers(0, distinct if e != 4 else 10**6)), None if rng.random() < 0.1 else int(rng.integers(0, 5)))
        for e, n in zip(entities, lengths[::-1]) for t in range(n)
    ]


@pytest.mark.parametrize("side", ["greater", "less"])
def test_former_groups_against_counting(spark, side):
    rows = some_careers()
    df = spark.createDataFrame(rows, "entity int, t int, x double, k int").repartition(5)
    got = {(r["entity"], r["t"]): r for r in X.former_groups_test(df, "entity", ["t"], "k", "x", side).collect()}
    want = {}
    for e, t, x, _ in rows:
        found = moves([(r[2], r[3]) for r in rows if r[0] == e and r[1] < t and r[2] is not None], side == "less")
        if x is not None and found:
            want[e, t] = (min(p for _, p in found), max(z for z, _ in found), len(found))
    assert set(got) == set(want) and len(want) > 80
    for key, (p, z, n) in want.items():
        assert got[key]["changing_groups_p"] == pytest.approx(p, abs=1e-7) and got[key]["largest_z"] == pytest.approx(z) and got[key]["pairs_tested"] == n


def test_every_row_can_be_kept(spark):
    rows = some_careers()
    df = spark.createDataFrame(rows, "entity int, t int, x double, k int").withColumn("g", F.col("k") > 1)
    word = F.when(F.col("entity") % 2 == 0, "less").otherwise("greater")
    all_rows = X.former_groups_test(X.played_or_not_test(df, ["entity"], ["t"], "x", "g", word, keep_rows=True), ["entity"], ["t"], "k", "x", keep_rows=True)
    got = {(r["entity"], r["t"]): r for r in all_rows.collect()}
    assert len(got) == len(rows)
    apart = {(r["entity"], r["t"]): r for r in X.former_groups_test(df, "entity", ["t"], "k", "x").collect()}
    for key, r in got.items():
        assert r["changing_groups_p"] == (apart[key]["changing_groups_p"] if key in apart else None)
    for side in ("greater", "less"):
        for r in X.played_or_not_test(df, ["entity"], ["t"], "x", "g", side).collect():
            if ((r["entity"] or 1) % 2 == 0) == (side == "less"):
                kept = got[r["entity"], r["t"]]
                assert (kept["u"], kept["n1"], kept["n2"], kept["z"], kept["p_value"]) == (r["u"], r["n1"], r["n2"], r["z"], r["p_value"])
    assert all(r["n1"] is None and r["p_value"] is None for r in got.values() if r["x"] is None)


def test_an_unknown_side_leaves_later_rows_untested(spark):
    rows = [("e", t, float(v), g) for t, (v, g) in enumerate(zip([3, 1, 4, 1, 5, 9, 2], [True, False, True, False, None, True, False]))]
    got = {r["t"]: r for r in X.played_or_not_test(spark.createDataFrame(rows, "entity string, t int, x double, g boolean"), ["entity"], ["t"], "x", "g").collect()}
    assert (got[4]["u"], got[4]["n1"], got[4]["n2"]) == (4.0, 2, 2)
    assert all(got[t][c] is None for t in (5, 6) for c in ("u", "n1", "n2", "z", "p_value"))


def test_rows_of_one_period_are_one(spark):
    rows = [("e", t, float(t * t % 7), t % 3) for t in range(12)] + [("e", 11, 100.0, 1)]
    got = X.former_groups_test(spark.createDataFrame(rows, "entity string, t int, x double, k int"), "entity", ["t"], "k", "x")
    assert got.where("t = 11").count() == 1 and got.select("entity", "t").distinct().count() == got.count()


def test_blocks_do_not_change_results(monkeypatch):
    rng = np.random.default_rng(8)
    career = np.repeat(np.arange(6), [1, 30, 3, 50, 2, 14])
    x, group, played = rng.integers(0, 8, 100).astype(float), rng.integers(-1, 7, 100), rng.random(100) < 0.5
    whole = R.former_groups(career, x, group, False), R.played_or_not(career, x, played, played & False)
    monkeypatch.setattr(R, "_BLOCK", 7)
    parts = R.former_groups(career, x, group, False), R.played_or_not(career, x, played, played & False)
    assert all((a[c] == b[c]).all() for a, b in zip(whole, parts) for c in a)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_carries_its_history_and_evidence_joins_nothing(spark):
    rows = spark.createDataFrame([("passing", 1, 2000, 1, 1, 5.0, 1.0, 1.0)], SCHEMA)
    plan = plan_of(K.contributor_evidence(rows))
    assert "collect_list" not in plan and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_evidence_of_seasons_before_and_rows_without_keys(spark):
    """Games of two earlier seasons count; a gap in seasons or a missing key leaves no metric, a row alone is kept."""
    rows = [("passing", e, s, w, 1, float(10 * s + w), 1.0 * w, 0.5) for e in (1, None) for s in (0, 1, 2, 4) for w in (1, 2)]
    rows += [("other", 1, 2, 1, 1, 7.0, None, None), ("passing", 2, None, 1, 1, 3.0, 3.0, 0.1)]
    got = defaultdict(list)
    for r in K.contributor_evidence(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["family"], r["entity"], r["season"], r["week"]].append(r)
    assert len(got) == len(rows) and all(len(v) == 1 for v in got.values())
    # weeks 1 and 2 of seasons 0 and 1, then week 1 of season 2
    assert got["passing", 1, 2, 1][0]["metric"] == pytest.approx((1 + 2 + 11 + 12) / 4)
    assert got["passing", 1, 2, 2][0]["metric"] == pytest.approx((1 + 2 + 11 + 12 + 21) / 5)
    assert got["passing", 1, 4, 1][0]["metric"] is None and got["other", 1, 2, 1][0]["metric"] is None
    for key, (r,) in got.items():
        if None in key:
            assert (r["metric"], r["p_play"], r["p_move"]) == (None, None, None)
    assert got["passing", 1, 4, 2][0]["p_play"] is not None
