"""Column functions, quantiles, sets and sources on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.functions import scalars as C
from scoutframe.operators import joins as J
from scoutframe.operators import schema as P
from scoutframe.operators import value as V
from scoutframe.operators.quantiles import exact_percentiles
from scoutframe.sources import tables as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("p, floor, ceiling", [(0.02, 200, 400), (0.0199, 0, 200), (0.10, 1000, 1500), (0.15, 1500, 2000), (0.30, 3000, 4000), (0.70, 7000, 8000), (0.2999, 2500, 3000)])
def test_probability_bin_edges(spark, p, floor, ceiling):
    low, high = C.probability_bin(F.lit(p))
    assert (one(spark, low), one(spark, high)) == (floor, ceiling)


def test_name_key(spark):
    assert one(spark, C.name_key(F.lit("A.J. O'Brien-Smith (SEA) Jr."))) == "aj obriensmith"
    assert one(spark, C.name_key(F.lit("  Kenneth  Walker III "))) == "kenneth walker"


def test_ladder_codes_round_trip(spark):
    for n in (-7.5, 2.5, 40.0):
        code = one(spark, C.ladder_code(F.lit("team_differential"), F.lit(n)))
        assert one(spark, C.ladder_number(F.lit(code))) == n
        assert one(spark, C.ladder_root(F.lit(code))) == "team_differential"


def test_bet_type(spark):
    for code, kind in (("rushing_receiving_yards_40", "rushing_receiving_yards"), ("anytime_td_scorer", "anytime_td_scorer"), ("team_win", "team_win"), ("team_differential_minus7.5", "team_differential")):
        assert one(spark, C.bet_type(F.lit(code))) == kind


def test_odds(spark):
    assert one(spark, C.profit_per_100(F.lit(-200.0))) == 50.0
    assert one(spark, C.american_to_number(F.lit("−150"))) == -150.0
    assert one(spark, C.implied_probability(F.lit(300.0))) == 0.25
    assert one(spark, C.odds_band(F.lit(250.0))[0]) == "Odds +251 to +450"
    assert one(spark, C.odds_band(F.lit(250.0), right=True)[0]) == "Positive Odds Up To +250"


def test_spread_must_be_beaten(spark):
    assert one(spark, V.bet_won(F.lit("team_differential"), F.lit(3.0), F.lit(3.0))) is False
    assert one(spark, V.bet_won(F.lit("rushing_yards"), F.lit(3.0), F.lit(3.0))) is True
    assert one(spark, V.bet_won(F.lit("rushing_yards"), F.lit(3.0), F.lit(None).cast("double"))) is False


@pytest.mark.parametrize("bins", [3, 1024])
def test_exact_percentiles(spark, bins):
    rng = random.Random(3)
    values = [rng.choice([0.0, -5.0, 1e6, rng.gauss(0, 1)]) for _ in range(501)] + [None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v, 7.0, None) for v in values], "a double, b double, c double")
    probs = [0.0, 0.1, 0.33, 0.5, 0.8, 1.0]
    got = exact_percentiles(df, ["a", "b", "c"], probs, bins=bins)
    finite = [v for v in values if v is not None and np.isfinite(v)]
    assert got["a"] == pytest.approx([float(np.quantile(finite, p)) for p in probs])
    assert got["b"] == [7.0] * 6 and got["c"] == [None] * 6


def test_neighbouring_doubles(spark):
    a = 5e-324
    df = spark.createDataFrame([(0.0,), (a,), (2 * a,)], "a double")
    assert exact_percentiles(df, ["a"], [0.0, 0.5, 1.0])["a"] == [0.0, a, 2 * a]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    updates = spark.createDataFrame([(2, "c", 5), (2, "d", 9), (3, "e", 1)], "k int, v string, t int")
    out = S.upsert(target, updates, ["k"], newest=["t"])
    assert {(r["k"], r["v"]) for r in out.collect()} == {(1, "a"), (2, "d"), (3, "e")}
    with pytest.raises(ValueError):
        S.upsert(target, updates, [])
    with pytest.raises(ValueError):
        S.upsert(target, updates, ["nope"])


def test_keyset_pages_cover_the_table(spark):
    df = spark.createDataFrame([(i // 3, i % 3) for i in range(20)], "a int, b int")
    seen, cursor = [], None
    while True:
        page = S.keyset_page(df, ["a", "b"], cursor, 6)
        moved = S.next_cursor(page, ["a", "b"], cursor)
        if moved is None:
            break
        seen += [tuple(r) for r in page.collect()]
        cursor = moved
    assert seen == [(i // 3, i % 3) for i in range(20)]


def test_filters_and_columns_reach_the_scan(spark, folder):
    df = S.read_seasons(spark, f"{folder}/orders.parquet", 1997, 1999, stamp="o_orderdate").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_totalprice" not in plan


def test_contracts(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 2.0)], "k int, p double")
    with pytest.raises(ValueError):
        J.require_empty(J.duplicate_keys(df, ["k"]), "key not unique")
    with pytest.raises(ValueError):
        J.require_empty(J.out_of_range(df, "p", 0, 1), "not a probability")
    J.require_empty(J.out_of_range(df, "p", 0, 5), "fine")


def test_registry_tags_columns(spark):
    registry = P.FeatureRegistry()
    registry.add("passing", ["p"])
    df = registry.tag(spark.createDataFrame([(1, 2.0)], "k int, p double"))
    assert df.schema["p"].metadata == {"group": "passing"}


def test_normal_tail(spark):
    for z, p in ((0.0, 0.5), (1.6448536, 0.05), (-1.2815516, 0.9)):
        assert one(spark, C.normal_upper_tail(F.lit(z))) == pytest.approx(p, abs=1e-6)


def test_interval_outside_is_week_zero(spark):
    events = spark.createDataFrame([("t", "2024-01-05 00:00:00"), ("t", "2024-01-04 12:00:00"), ("t", "2024-03-01 00:00:00"), ("u", "2024-01-01 00:00:00")], "team string, at string")
    spans = spark.createDataFrame([("t", "2024-01-01 00:00:00", "2024-01-04 10:00:00", 1), ("t", "2024-01-04 10:00:01", "2024-01-09 00:00:00", 2)], "team string, s string, e string, week long")
    events, spans = events.withColumn("at", F.col("at").cast("timestamp")), spans.withColumns({c: F.col(c).cast("timestamp") for c in "se"})
    out = J.within_interval(events, spans, ["team"], "at", "s", "e", "week")
    assert sorted((r["team"], r["week"]) for r in out.collect()) == [("t", 0), ("t", 2), ("t", 2), ("u", 0)]


def test_name_key_keeps_letters_of_any_script(spark):
    assert one(spark, C.name_key(F.lit("José Ramírez II"))) == "josé ramírez"


def test_day_parts(spark):
    assert [one(spark, C.day_part(F.lit(h))) for h in (11, 13, 14, 18, 19)] == ["Morning", "Early Window", "Late Window", "Late Window", "Night"]
    assert one(spark, C.day_part(F.lit(11), C.SHEET_HOURS)) == "Early Window"


def test_posted_season(spark):
    day = F.lit("2021-02-03").cast("date")
    assert [one(spark, C.posted_season(day, F.lit(w))) for w in (0, 22)] == [2021, 2020]
    assert one(spark, C.posted_season(F.lit("2021-05-03").cast("date"), F.lit(0))) == 2021


def test_markers_of_a_division_table(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in C.status_flags(F.lit("z - ABC"), division_table=True).items()]).first()
    assert row.clinched_seed1 and not row.clinched_playoff and not row.clinched_division and row.team_code == "ABC"


def test_full_participation_is_not_less_practice(spark):
    from scoutframe.operators import features as X

    reports = spark.createDataFrame([(1, 1, "Knee", "Full Participation in Practice", None), (2, 1, "Knee", "Limited Participation in Practice", "Out")], "k int, first int, injury string, practice string, status string")
    got = {r.k: r for r in X.availability(reports, spark.createDataFrame([(3,)], "k int"), ["k"], "first").collect()}
    assert not got[1].less_practice and got[2].less_practice and got[2].out and got[3].out and not got[1].out


def test_refunds_are_no_settled_bets(spark):
    from scoutframe.operators import ledger as L

    rows = [("a", "Win", 10.0, 100.0), ("a", "Loss", 10.0, 100.0), ("a", "Refund", 50.0, 100.0), ("a", None, 5.0, 100.0)]
    got = L.ledger_summary(spark.createDataFrame(rows, "who string, result string, amount double, odds double"), ["who"]).first()
    assert (got.bets, got.wins, got.win_share, got.spent, got.payout, got.total_return) == (2, 1, 0.5, 20.0, 20.0, 0.0)


def test_moneyline_and_both_spreads(spark):
    from scoutframe.plans.value import FAMILIES, ladder_targets

    rows = [("Moneyline", None, None), ("Spread", 3.5, None), ("Spread Alternate", -6.5, None), ("Spread", 100.0, None), ("Receptions", None, 6.0)]
    lines = spark.createDataFrame(rows, "market string, points double, number double")
    got = sorted(r.response_var for r in V.market_targets(lines, "market", "points", "number", FAMILIES, ladder_targets(spark)).collect())
    assert got == ["receptions_6", "team_differential_6.5", "team_differential_minus3.5", "team_win"]


def test_open_games(spark):
    rows = spark.createDataFrame([(1, None), (2, "2024-01-10 11:30:00"), (3, "2024-01-10 10:30:00")], "k int, start string").withColumn("start", F.col("start").cast("timestamp_ntz"))
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    assert {r.k for r in V.still_open(rows, "start", now).collect()} == {1, 2}


def test_one_directional_coefficient():
    from scoutframe.operators.portfolio import _game_correlation

    bet = lambda label, var: {"label": label, "var": var, "team": "A", "opponent": "B", "position": "WR"}
    table = {("same_team", "WR", "x", "WR", "y"): 0.4}
    for order in ([bet("p", "x"), bet("q", "y")], [bet("q", "y"), bet("p", "x")]):
        assert _game_correlation(order, table)[0, 1] == 0.2
