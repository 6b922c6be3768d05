"""A game is solved by its blocks of correlated bets, whatever its size."""

import numpy as np
import pytest

from scoutframe.operators import portfolio as R

SCHEMA = "week int, bet_id string, game string, team string, opponent string, label string, position string, var string, ev double, risk_score double"
COEFS = {
    ("same_player", "WR", "yards", "WR", "catches"): 0.9, ("opp_team", "Team", "win", "Team", "win"): -1.0,
    ("same_team", "QB", "yards", "QB", "yards"): -0.6,
}


def game(n, seed=3):
    """Columns of a game: pairs of bets of one player, team wins that exclude each other, passers who share the ball."""
    rng = np.random.default_rng(seed)
    kinds = [("WR", "yards"), ("WR", "catches"), ("Team", "win"), ("QB", "yards"), ("TE", "yards")]
    rows = []
    for i in range(n):
        position, var = kinds[rng.integers(0, 5)]
        team, facing = [("A", "B"), ("B", "A")][rng.integers(0, 2)]
        label = f"T{team}" if position == "Team" else f"P{rng.integers(0, n // 2)}{position}{team}"
        rows.append((1, f"{i:05d}", "g", team, facing, label if i else None, position, var, float(rng.uniform(1, 30)), float(rng.uniform(0.5, 3))))
    return rows


def columns(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return {c: np.array([r[i] for r in rows], dtype=float if c in ("ev", "risk_score") else object) for i, c in enumerate(names)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_are_the_whole_matrix(seed):
    rows = game(60, seed)
    g = columns(rows)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    sd = np.sqrt(g["risk_score"])
    whole = R._game_correlation([dict(zip(names, r)) for r in rows], COEFS) * np.outer(sd, sd)
    alone, blocks = R._game_blocks(g, COEFS)
    built = np.zeros((60, 60))
    built[alone, alone] = g["risk_score"][alone]
    for bets, m in blocks:
        built[np.ix_(bets, bets)] = m
    assert len(alone) and len(blocks) > 1 and built == pytest.approx(whole, abs=1e-12)
    repaired, before, after = R._repaired([m for _, m in blocks], g["risk_score"][alone])
    dense = R._nearest_psd(whole)
    assert (before, after) == pytest.approx(dense[1:], abs=1e-9) and before < -0.1
    for (bets, _), m in zip(blocks, repaired):
        assert m == pytest.approx(dense[0][np.ix_(bets, bets)], abs=1e-9)


def test_a_game_of_many_bets_is_swept(spark):
    """One path over all bets of the game would take a solve of thousands of unknowns per bet."""
    n = 5_000
    rng = np.random.default_rng(4)
    rows = [(1, f"{i:05d}", "g", "A", "B", f"P{i}", "TE", "yards", float(rng.uniform(1, 30)), float(rng.uniform(0.5, 3))) for i in range(n)]
    out = R.weight_sweep(spark.createDataFrame(rows, SCHEMA), COEFS, ["week"], [5.0]).collect()
    w = np.zeros(n)
    for r in out:
        w[int(r["bet_id"])] = r["weight"]
    mu, var = np.array([r[8] for r in rows]) / 100, np.array([r[9] for r in rows])
    slope = (mu - 10.0 * w * var)[w > 0]  # at the optimum every bet taken has the same marginal worth
    assert w.sum() == pytest.approx(1.0) and slope == pytest.approx(np.full(len(slope), slope[0]), abs=1e-4)
    assert (mu[w == 0] <= slope[0] + 1e-4).all()
    lowest = R.game_blocks(spark.createDataFrame(rows, SCHEMA), COEFS, ["week"]).first()
    assert (lowest["n_units"], lowest["n_bets"]) == (n, n) and lowest["lowest_before"] == pytest.approx(var.min())
