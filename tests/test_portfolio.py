"""Covariance, weights, stakes and stress on hand-made bets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.operators import aggregates as A
from scoutframe.operators import features as X
from scoutframe.operators import portfolio as R
from scoutframe.operators import value as V

COEFS = [
    ("same_player", "WR", "yards", "WR", "catches", 0.8), ("same_player", "WR", "catches", "WR", "yards", 0.8),
    ("same_team", "QB", "yards", "WR", "yards", 0.4), ("same_team", "WR", "yards", "QB", "yards", 0.4),
    ("same_team", "WR", "yards", "WR", "yards", -0.2), ("opp_team", "QB", "yards", "QB", "yards", 0.1),
]
BETS = [
    ("1", "g", "A", "B", "w1", "WR", "yards", 20.0, 1.0), ("2", "g", "A", "B", "w1", "WR", "yards", 15.0, 2.0),
    ("3", "g", "A", "B", "w1", "WR", "catches", 30.0, 1.5), ("4", "g", "A", "B", "q1", "QB", "yards", 12.0, 0.8),
    ("5", "g", "B", "A", "q2", "QB", "yards", 25.0, 3.0), ("6", "g", "A", "B", "w2", "WR", "yards", 18.0, 1.2),
    ("7", "h", "C", "D", "w9", "WR", "yards", 22.0, 1.1), ("8", "h", "C", "D", "q9", "QB", "yards", 9.0, 0.7),
]


@pytest.fixture(scope="module")
def bets(spark):
    return spark.createDataFrame(
        [(1, *b) for b in BETS], "week int, bet_id string, game string, team string, opponent string, label string, position string, var string, ev double, risk_score double"
    )


@pytest.fixture(scope="module")
def coefs(spark):
    return spark.createDataFrame(COEFS, "relation string, position1 string, var1 string, position2 string, var2 string, cor double")


def rho(a, b):
    table = {c[:5]: c[5] for c in COEFS}
    if a[4] == b[4]:
        return 1.0 if a[6] == b[6] else table.get(("same_player", a[5], a[6], b[5], b[6]), 0.0)
    kind = "same_team" if a[2] == b[2] else "opp_team" if a[2] == b[3] else None
    return table.get((kind, a[5], a[6], b[5], b[6]), 0.0)


def covariance():
    sd = np.sqrt([b[8] for b in BETS])
    m = np.array([[1.0 if i == j else rho(a, b) for j, b in enumerate(BETS)] for i, a in enumerate(BETS)])
    return m * np.outer(sd, sd)


def test_pair_covariance_equals_all_pairs(bets, coefs):
    out = R.pair_covariance(bets.withColumn("sd", F.sqrt("risk_score")), coefs, ["week"], "sd")
    total = sum(r["cov_sum"] for r in out.collect())
    cov = covariance()
    assert total == pytest.approx(sum(cov[i, j] for i, j in itertools.combinations(range(len(BETS)), 2)))


def test_metrics_equal_the_quadratic_form(bets, coefs):
    w = np.linspace(1, 2, len(BETS))
    w /= w.sum()
    weights = dict(zip([b[0] for b in BETS], w.tolist()))
    weighted = bets.withColumn("weight", V.choose("bet_id", weights))
    row = R.portfolio_metrics(weighted, coefs, ["week"]).first()
    assert row["portfolio_mu"] == pytest.approx(sum(wi * b[7] / 100 for wi, b in zip(w, BETS)))
    assert row["portfolio_var"] == pytest.approx(float(w @ covariance() @ w))


def test_weight_sweep_is_optimal(bets, coefs):
    gammas = [0.01, 0.3, 10.0]
    out = R.weight_sweep(bets, R.coefficient_map(coefs), ["week"], gammas, max_bets=8).collect()
    cov = np.zeros((8, 8))
    full = covariance()
    for game in ("g", "h"):
        idx = [i for i, b in enumerate(BETS) if b[1] == game]
        cov[np.ix_(idx, idx)] = R._nearest_psd(full[np.ix_(idx, idx)])[0]
    mu = np.array([b[7] / 100 for b in BETS])
    rng = np.random.default_rng(1)
    for k, g in enumerate(gammas):
        w = np.zeros(8)
        for r in out:
            if r["gamma_index"] == k:
                w[int(r["bet_id"]) - 1] = r["weight"]
        assert w.sum() == pytest.approx(1.0) and (w >= 0).all()

        def objective(x):
            return mu @ x - g * x @ cov @ x

        rivals = [np.full(8, 1 / 8), *np.eye(8), *rng.dirichlet(np.ones(8) * 0.3, 400)]
        assert all(objective(w) >= objective(x) - 1e-3 * max(1.0, g) for x in rivals)


def test_sweep_keeps_all_bets_by_default(bets, coefs):
    few = R.weight_sweep(bets, R.coefficient_map(coefs), ["week"], [300.0], max_bets=3).count()
    assert few == 3 < R.weight_sweep(bets, R.coefficient_map(coefs), ["week"], [300.0]).count()


def test_sweep_keeps_at_most_the_wanted_bets(bets, coefs):
    out = R.weight_sweep(bets, R.coefficient_map(coefs), ["week"], [10.0], max_bets=3)
    row = out.agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    assert row["n"] == 3 and row["w"] == pytest.approx(1.0)


def test_repair_gives_positive_blocks(spark, bets):
    bad = [("same_team", "WR", "yards", "WR", "yards", -0.9), ("same_team", "QB", "yards", "WR", "yards", 0.95), ("same_team", "WR", "yards", "QB", "yards", 0.95)]
    coef = {c[:5]: c[5] for c in bad}
    rows = R.game_blocks(bets, coef, ["week"]).collect()
    assert min(r["lowest_before"] for r in rows) < 0 < min(r["lowest_after"] for r in rows) + 1e-9
    assert sum(r["n_bets"] for r in rows) == len(BETS)


def test_stakes_sum_to_the_bank(spark):
    df = spark.createDataFrame([(1, 0.6), (1, 0.39), (1, 0.01), (2, 1.0)], "p int, weight double")
    out = R.stakes(df, ["p"], 50.0, 0.5)
    sums = {r["p"]: r["s"] for r in out.groupBy("p").agg(F.sum("bet_amount").alias("s")).collect()}
    assert sums == pytest.approx({1: 50.0, 2: 50.0}) and out.count() == 3


def test_stress_on_five_bets(spark):
    rows = [("s", 1, 300.0, True, 10.0), ("s", 1, 100.0, True, 10.0), ("s", 2, 100.0, False, 10.0), ("s", 2, 200.0, False, 10.0), ("s", 2, 150.0, False, 10.0)]
    settled = A.settle(spark.createDataFrame(rows, "strategy string, week int, odds double, bet_hit boolean, stake double"), F.col("stake"))
    out = {r["scenario"]: r["adjusted_return"] for r in V.win_removal_stress(settled, ["strategy"]).collect()}
    assert out["top 1"] == pytest.approx((20 - 50) / 50) and out["top 2"] == pytest.approx(-1.0) and out["top 10"] == pytest.approx(-1.0)
    even = V.wins_to_break_even(settled, ["strategy"]).first()
    assert even["wins_to_break_even"] == 1 and even["num_wins"] == 2 and even["baseline_return"] == pytest.approx(0.2)


def test_ladder_is_monotone_after_the_screen(spark):
    df = spark.createDataFrame([("p", 25.0, 0.6), ("p", 40.0, 0.7), ("p", 60.0, 0.3), ("q", None, 0.5)], "label string, number double, p double")
    kept = V.without_ladder_violations(df, ["label"]).collect()
    assert {(r["label"], r["number"]) for r in kept} == {("p", 25.0), ("p", 60.0), ("q", None)}


def test_rank_sum_against_counting(spark):
    rng = np.random.default_rng(5)
    rows = [("e", 1, w, float(rng.integers(0, 6)), bool(rng.integers(0, 2))) for w in range(1, 25)]
    df = spark.createDataFrame(rows, "entity string, season int, week int, x double, g boolean")
    got = {r["week"]: r for r in X.played_or_not_test(df, ["entity"], ["season", "week"], "x", "g").collect()}
    for w in range(1, 25):
        past = [r for r in rows if r[2] < w]
        one, two = [r[3] for r in past if r[4]], [r[3] for r in past if not r[4]]
        if len(one) > 1 and len(two) > 1:
            u = sum((a > b) + 0.5 * (a == b) for a in one for b in two)
            assert got[w]["u"] == pytest.approx(u)
        else:
            assert got[w]["u"] is None and got[w]["p_value"] is None


def test_pair_correlation_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for week in range(12):
        for team, opp in (("A", "B"), ("B", "A")):
            for i in range(5):
                rows.append((week, team, opp, f"{team}{i}", ["QB", "WR", "WR", "RB", "RB"][i], float(rng.integers(0, 50)), float(rng.integers(0, 9)) if i else None))
    df = spark.createDataFrame(rows, "week int, team string, opponent string, player string, position string, yards double, catches double")
    got = {(r["relation"], r["position1"], r["var1"], r["position2"], r["var2"]): r["cor"] for r in A.pair_correlations(df, ["week"], "team", "opponent", "position", ["yards", "catches"], threshold=0.0).collect()}
    value = {"yards": 5, "catches": 6}
    for (relation, p1, v1, p2, v2), cor in got.items():
        xs, ys = [], []
        for a in rows:
            for b in rows:
                if a[0] != b[0] or a[4] != p1 or b[4] != p2:
                    continue
                same = a[3] == b[3]
                fits = {"same_team": a[1] == b[1] and not same, "opp_team": a[1] == b[2], "same_player": same}[relation]
                x, y = a[value[v1]], b[value[v2]]
                if fits and x is not None and y is not None:
                    xs.append(x), ys.append(y)
        assert cor == pytest.approx(np.corrcoef(xs, ys)[0, 1], abs=1e-9)
    assert len(got) > 20


def test_exact_rank_sum_tails(spark):
    table = {(r.n1, r.n2): r.tails for r in X.rank_sum_tails(spark, 8).collect()}
    assert set(table) == {(a, b) for a in range(2, 8) for b in range(2, 8)}
    # known tails: 1 of 20, 1 of 35, 12 of 252
    assert table[3, 3][9] == pytest.approx(1 / 20) and table[4, 3][12] == pytest.approx(1 / 35) and table[5, 5][21] == pytest.approx(12 / 252)
    for (n1, n2), tails in table.items():
        us = [sum(p - i for i, p in enumerate(c)) for c in itertools.combinations(range(n1 + n2), n1)]
        assert tails == pytest.approx([sum(u >= k for u in us) / len(us) for k in range(n1 * n2 + 1)])


def test_p_values_are_exact_without_ties_only(spark):
    values = [3.0, 7.0, 1.0, 9.0, 8.0, 2.0, 2.0, 5.0]
    played = [False, True, False, True, True, False, True, True]
    rows = [("e", 1, w, x, g) for w, (x, g) in enumerate(zip(values, played))]
    df = spark.createDataFrame(rows, "entity string, season int, week int, x double, g boolean")
    for side, want in (("greater", 1 / 20), ("less", 1.0)):
        got = {r["week"]: r for r in X.played_or_not_test(df, ["entity"], ["season", "week"], "x", "g", side).collect()}
        assert got[6]["u"] == 9 and got[6]["p_value"] == pytest.approx(want)
        tail = 0.5 * math.erfc(got[7]["z"] / math.sqrt(2))  # week 7 looks back on a tie
        assert got[7]["p_value"] == pytest.approx(tail if side == "greater" else 1 - tail, abs=1e-6)


def test_team_scenarios_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows, results = [], []
    for week in range(12):
        for team, opp in (("A", "B"), ("B", "A"), ("C", "D")):  # nobody of D is in the table
            results.append((week, team, opp, float(rng.integers(-9, 9)) if week else None))
            for i in range(5):
                rows.append((week, team, opp, f"{team}{i}", ["QB", "WR", "TE", "RB", "RB"][i], float(rng.integers(0, 50))))
    df = spark.createDataFrame(rows, "week int, team string, opponent string, player string, position string, yards double")
    teams = spark.createDataFrame(results, "week int, team string, opponent string, diff double")
    out = A.pair_correlations(
        df, ["week"], "team", "opponent", "position", ["yards"], threshold=0.0, groups={"WR": "WR|TE", "TE": "WR|TE"},
        team_rows=teams, team_measures=["diff"],
    ).collect()
    everyone = [(w, t, o, p, "WR|TE" if g in ("WR", "TE") else g, y) for w, t, o, p, g, y in rows]
    everyone += [(w, t, o, t, "Team", d) for w, t, o, d in results if d is not None]
    for r in out:
        pairs = [
            (a[5], b[5]) for a in everyone for b in everyone
            if a[0] == b[0] and a[4] == r["position1"] and b[4] == r["position2"]
            and (a[1] == b[1] and a[3] != b[3] if r["relation"] == "same_team" else a[1] == b[2])
        ]
        assert r["n_pairs"] == len(pairs) and r["cor"] == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1], abs=1e-9)
    kinds = {(r["relation"], r["position1"], r["position2"]) for r in out}
    assert {("same_team", "Team", g) for g in ("QB", "RB", "WR|TE")} <= kinds and ("opp_team", "Team", "Team") in kinds
    assert ("same_team", "Team", "Team") not in kinds and ("same_team", "QB", "QB") not in kinds and ("same_team", "WR|TE", "WR|TE") in kinds
