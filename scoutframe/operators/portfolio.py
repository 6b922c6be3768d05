"""Covariance, weights, metrics and stakes of bet portfolios.

Two bets are correlated only inside a game, and by how much depends only on what
they are: player, bet type, team and position.  So the covariance of a week is kept
as sums per class of bet plus a small coefficient table, and no bet-by-bet matrix is
built.  Only the weight search looks at single games, one game per call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from .windows import top_n

RIDGE = 1e-8


def coefficients(table: DataFrame) -> DataFrame:
    """Correlation rows with position lists such as ``WR|TE`` spread to single positions."""
    return (
        table.withColumn("position1", F.explode(F.split("position1", r"\|")))
        .withColumn("position2", F.explode(F.split("position2", r"\|")))
        .select("relation", "position1", "var1", "position2", "var2", "cor")
    )


def _lookup(pairs: DataFrame, coefs: DataFrame, relation: str) -> DataFrame:
    """Coefficient of a pair of classes; 0 where the table has none."""
    wanted = coefs.where(F.col("relation") == relation).drop("relation")
    return pairs.join(wanted, ["position1", "var1", "position2", "var2"], "left").withColumn(
        "cor", F.coalesce("cor", F.lit(0.0))
    )


def class_pairs(bets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of bet classes that meet in a game, with the relation of their teams."""
    classes = bets.select(*keys, "game", "team", "opponent", F.col("position"), F.col("var")).distinct()
    return _pair_up(classes, keys, [])


def _pair_up(classes: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    def side(n: str) -> DataFrame:
        return classes.select(
            *keys, "game", F.col("team").alias(f"team{n}"), F.col("position").alias(f"position{n}"), F.col("var").alias(f"var{n}"),
            *([F.col("opponent").alias("_facing")] if n == "1" else []), *[F.col(s).alias(f"{s}{n}") for s in sums],
        )

    met = side("1").join(side("2"), [*keys, "game"])
    relation = F.when(F.col("team1") == F.col("team2"), "same_team").when(F.col("_facing") == F.col("team2"), "opp_team")
    return met.withColumn("relation", relation).where("relation IS NOT NULL").drop("_facing")


def correlation_lookup(bets: DataFrame, coefs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coefficient chosen for each pair of classes, with the number of games it is used in."""
    seen = class_pairs(bets, keys).groupBy("relation", "position1", "var1", "position2", "var2").agg(F.count("*").alias("n"))
    on = ["relation", "position1", "var1", "position2", "var2"]
    return seen.join(coefs, on, "left").withColumn("cor", F.coalesce("cor", F.lit(0.0)))


def pair_covariance(bets: DataFrame, coefs: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Sum over pairs of different bets of rho * x_i * x_j, by game and kind of relation.

    ``x`` is the standard deviation for the covariance itself, or weight times standard
    deviation for the variance of a portfolio.  Columns: game, team, opponent, label,
    position, var and ``x``.  A label has one team and one position.
    """
    unit = bets.groupBy(*keys, "game", "team", "opponent", "position", "label", "var").agg(
        F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("ss"), F.count("*").alias("n")
    )
    unit = staged(unit, "units")  # four sums read it
    half = F.lit(0.5)
    s, n = F.col("s"), F.col("n")
    twins = unit.groupBy(*keys, "game").agg(
        F.sum(n * (n - 1) * half).alias("n_pairs"), F.sum((s * s - F.col("ss")) * half).alias("cov_sum")
    ).withColumn("relation", F.lit("same_label_and_type"))
    # types of one player, at most the number of bet types per label: brought together once, then paired in place
    kinds = unit.dropna(subset=[*keys, "game", "label"]).groupBy(*keys, "game", "label").agg(
        F.collect_list(F.struct("position", "var", "s", "n")).alias("_kinds")
    )
    own = kinds.select(*keys, "game", "label", "_kinds", F.explode("_kinds").alias("_a")).select(
        *keys, "game", "label", "_a", F.explode("_kinds").alias("_b")
    ).select(
        *keys, "game", "label", *[F.col(f"_{side}.{c}").alias(f"{c}{n}") for side, n in (("a", 1), ("b", 2)) for c in ("position", "var", "s", "n")]
    )
    product, count = F.col("s1") * F.col("s2"), F.col("n1") * F.col("n2")
    crossed = _lookup(own.where("var1 <> var2"), coefs, "same_player")
    players = crossed.groupBy(*keys, "game").agg(
        F.sum(count * half).alias("n_pairs"), F.sum(product * F.col("cor") * half).alias("cov_sum")
    ).withColumn("relation", F.lit("same_label"))
    # classes of a game, less the pairs that belong to one player
    classes = unit.groupBy(*keys, "game", "team", "opponent", "position", "var").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    met = _pair_up(classes, keys, ["s", "n"])
    inside = own.groupBy(*keys, "game", "position1", "var1", "position2", "var2").agg(
        F.sum(product).alias("own_s"), F.sum(count).alias("own_n")
    )
    # a label has one team, so the own pairs of both teams are taken off their common total
    mates = met.where("relation = 'same_team'").groupBy(*keys, "game", "position1", "var1", "position2", "var2").agg(
        F.sum(product).alias("all_s"), F.sum(count).alias("all_n")
    ).join(inside, [*keys, "game", "position1", "var1", "position2", "var2"], "left")
    mates = _lookup(mates, coefs, "same_team").groupBy(*keys, "game").agg(
        F.sum((F.col("all_n") - F.coalesce("own_n", F.lit(0))) * half).alias("n_pairs"),
        F.sum((F.col("all_s") - F.coalesce("own_s", F.lit(0.0))) * F.col("cor") * half).alias("cov_sum"),
    ).withColumn("relation", F.lit("same_team"))
    rivals = _lookup(met.where("relation = 'opp_team'").drop("relation"), coefs, "opp_team").groupBy(*keys, "game").agg(
        F.sum(count * half).alias("n_pairs"), F.sum(product * F.col("cor") * half).alias("cov_sum")
    ).withColumn("relation", F.lit("opp_team"))
    parts = twins.unionByName(players).unionByName(mates).unionByName(rivals)
    return parts.where("n_pairs > 0").withColumn("n_pairs", F.col("n_pairs").cast("bigint"))


def tilted_weights(bets: DataFrame, keys: Sequence[str], tilts: Sequence[float], portfolio: str = "portfolio_id") -> DataFrame:
    """One portfolio per tilt over every bet of worth: weight in proportion to value over risk to the power of the tilt.

    Tilt 0 looks at value only, larger ones shun risk. Bets without a positive value or risk have no weight; the weights
    of a portfolio add up to 1. Totals are aggregated and joined back, so a week may hold any number of bets.
    """
    each = bets.where("ev > 0 AND risk_score > 0")
    score = [F.col("ev") / F.pow("risk_score", F.lit(float(t))) for t in tilts]
    totals = each.groupBy(*keys).agg(F.array(*[F.sum(c) for c in score]).alias("_totals"))
    # a bet meets the totals of its week once, and becomes a row per tilt after that
    return each.join(totals, list(keys)).withColumn("_t", F.explode(F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(float(t)).alias("tilt"), (c / F.col("_totals")[i]).alias("weight"))
        for i, (t, c) in enumerate(zip(tilts, score))
    ]))).select(*each.columns, F.col("_t.id").alias(portfolio), F.col("_t.tilt").alias("tilt"), F.col("_t.weight").alias("weight"))


def portfolio_metrics(weighted: DataFrame, coefs: DataFrame, portfolio: Sequence[str]) -> DataFrame:
    """Mean, variance, deviation and Sharpe ratio of given weights."""
    x = weighted.withColumn("_x", F.col("weight") * F.sqrt("risk_score"))
    own = x.groupBy(*portfolio).agg(
        F.sum(F.col("weight") * F.col("ev") / 100.0).alias("portfolio_mu"), F.sum(F.col("_x") * F.col("_x")).alias("_diagonal")
    )
    cross = pair_covariance(x, coefs, portfolio, "_x").groupBy(*portfolio).agg(F.sum("cov_sum").alias("_pairs"))
    variance = F.col("_diagonal") + 2.0 * F.coalesce("_pairs", F.lit(0.0))
    out = own.join(cross, list(portfolio), "left").select(*portfolio, "portfolio_mu", variance.alias("portfolio_var"))
    sd = F.sqrt(F.greatest("portfolio_var", F.lit(0.0)))
    return out.select("*", sd.alias("portfolio_sd"), F.try_divide(F.col("portfolio_mu"), sd).alias("portfolio_sharpe"))


def best_portfolio(metrics: DataFrame, week: Sequence[str], portfolio: str, sd_cap: float | None = None) -> DataFrame:
    """Per week the largest Sharpe ratio, or the largest mean with its deviation below a cap."""
    if sd_cap is None:
        usable, goal = metrics.where("portfolio_sharpe IS NOT NULL"), "portfolio_sharpe"
    else:
        usable, goal = metrics.where(F.col("portfolio_sd") < sd_cap), "portfolio_mu"
    return top_n(usable, week, [F.desc(goal), portfolio], 1)


def stakes(weighted: DataFrame, portfolio: Sequence[str], bank: float, min_stake: float) -> DataFrame:
    """Amounts to bet: too small ones are dropped and their money goes to the others."""
    kept = weighted.where(F.col("weight") * bank > min_stake)
    totals = kept.groupBy(*portfolio).agg(F.sum("weight").alias("_total"))
    share = F.try_divide("weight", "_total")
    return kept.join(totals, list(portfolio)).withColumn("bet_amount", share * bank).withColumn("weight", share).drop("_total")


# --- one game at a time -----------------------------------------------------------------------

Game = Mapping[str, np.ndarray]  # the bets of a game as columns


def _both_ways(coefs: Mapping[tuple, float], relation: str, a: tuple, b: tuple) -> float:
    """Mean of the two directions, each 0 where the table lacks it: the same whichever bet comes first."""
    return (coefs.get((relation, *a, *b), 0.0) + coefs.get((relation, *b, *a), 0.0)) / 2


def _codes(*columns: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """A number per bet for its combination of values, and the combinations; missing values are equal."""
    number, seen = np.zeros(len(columns[0]), dtype=np.int64), 1
    for column in columns:
        code, values = pd.factorize(column, use_na_sentinel=False)
        number, kept = pd.factorize(number * len(values) + code)
        seen = len(kept)
    first = np.full(seen, -1)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, [tuple(column[i] for column in columns) for i in first]


def _class_tables(classes: Sequence[tuple], coefs: Mapping[tuple, float]) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of two bets by their classes (team, opponent, position, type): of two labels, and of one label."""
    between, within = np.zeros((2, len(classes), len(classes)))
    for i, (team, _, *a) in enumerate(classes):
        for j, (other, facing, *b) in enumerate(classes):
            if team == other:
                between[i, j] = _both_ways(coefs, "same_team", a, b)
            elif team == facing:
                between[i, j] = _both_ways(coefs, "opp_team", a, b)
            within[i, j] = 1.0 if a[1] == b[1] else _both_ways(coefs, "same_player", a, b)
    return between, within


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = i = up[up[i]]
    return i


def _parts(label: np.ndarray, kind: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bets that go with no other bet, and groups of bets with no correlation across groups.

    Classes with a coefficient hang together, and so do the bets of a label.
    """
    up = list(range(len(between)))
    tied = (between != 0) | (between.T != 0)
    for i, j in zip(*np.nonzero(np.triu(tied))):
        up[_root(up, int(j))] = _root(up, int(i))
    linked = tied.any(axis=1)[kind]
    met = np.unique(np.column_stack([label, kind])[linked], axis=0)
    shared = met[1:, 0] == met[:-1, 0]
    for i, j in np.unique(np.column_stack([met[:-1, 1], met[1:, 1]])[shared], axis=0):
        up[_root(up, int(j))] = _root(up, int(i))
    group = len(between) + label
    if len(met):
        roots = np.array([_root(up, i) for i in range(len(between))])
        of_label = np.full(label.max() + 1, -1)
        of_label[met[:, 0]] = roots[met[:, 1]]
        group = np.where(of_label[label] >= 0, of_label[label], group)
    _, group, size = np.unique(group, return_inverse=True, return_counts=True)
    order = np.argsort(group, kind="stable")
    alone = size[group[order]] == 1
    ends = np.cumsum(size[size > 1])[:-1]
    more = order[~alone]
    return order[alone], np.split(more, ends) if len(more) else []


def _game_blocks(game: Game, coefs: Mapping[tuple, float]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The covariance of a game as its diagonal blocks: bets that stand alone, and (bets, matrix) of the others."""
    label, _ = _codes(game["label"])
    kind, classes = _codes(*[game[c] for c in ("team", "opponent", "position", "var")])
    tables = _class_tables(classes, coefs)
    alone, groups = _parts(label, kind, tables[0])
    sd = np.sqrt(game["risk_score"])
    return alone, [(b, _correlation(label[b], kind[b], *tables) * np.outer(sd[b], sd[b])) for b in groups]


def _correlation(label: np.ndarray, kind: np.ndarray, between: np.ndarray, within: np.ndarray) -> np.ndarray:
    at = np.ix_(kind, kind)
    rho = np.triu(np.where(label[:, None] == label, within[at], between[at]), 1)
    return rho + rho.T + np.eye(len(label))


def _game_correlation(bets: Sequence[Mapping], coefs: Mapping[tuple, float]) -> np.ndarray:
    """The whole matrix of a few bets."""
    game = {c: np.array([b[c] for b in bets], dtype=object) for c in ("label", "team", "opponent", "position", "var")}
    kind, classes = _codes(*[game[c] for c in ("team", "opponent", "position", "var")])
    return _correlation(_codes(game["label"])[0], kind, *_class_tables(classes, coefs))


def _clip(m: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Negative eigenvalues to zero, diagonal kept."""
    diagonal = np.diag(m).copy()
    m = (vectors * np.maximum(values, 0.0)) @ vectors.T
    scale = np.sqrt(diagonal / np.maximum(np.diag(m), 1e-300))
    return m * np.outer(scale, scale)


def _nearest_psd(m: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Negative eigenvalues to zero, diagonal kept, and a small ridge."""
    (m,), lowest, after = _repaired([m], np.zeros(0))
    return m, lowest, after


def _repaired(blocks: Sequence[np.ndarray], alone: np.ndarray) -> tuple[list[np.ndarray], float, float]:
    """Diagonal blocks of one matrix repaired together; its smallest eigenvalue before and after.

    ``alone``: diagonal of the blocks of one bet, which are never negative and only get the ridge.
    """
    solved = [np.linalg.eigh(m) for m in blocks]
    least = alone.min(initial=np.inf)
    lowest = float(min([least, *[values[0] for values, _ in solved]]))
    if lowest < -RIDGE:
        blocks = [_clip(m, *s) for m, s in zip(blocks, solved)]
    blocks = [(m + m.T) / 2 + RIDGE * np.eye(len(m)) for m in blocks]
    after = float(min([least + RIDGE, *[np.linalg.eigvalsh(m)[0] for m in blocks]]))
    return blocks, lowest, after


def coefficient_map(coefs: DataFrame) -> dict[tuple, float]:
    """The coefficient table as a dictionary: positions by types, squared, times relations."""
    return {
        (r["relation"], r["position1"], r["var1"], r["position2"], r["var2"]): r["cor"] for r in coefs.collect()
    }


_GAME_COLUMNS = ["game", "team", "opponent", "label", "position", "var"]


def game_blocks(bets: DataFrame, coefs: Mapping[tuple, float], keys: Sequence[str]) -> DataFrame:
    """Smallest eigenvalue of each game's covariance before and after its repair.

    Bets of one player and type move together, so a game is first cut to one unit per
    player and type; that is all its matrix can distinguish.
    """
    units = bets.groupBy(*keys, *_GAME_COLUMNS).agg(F.sum("risk_score").alias("risk_score"), F.count("*").alias("bets"))
    fields = ", ".join(f"{k} {bets.schema[k].dataType.simpleString()}" for k in keys)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, game in _games(batch):
                alone, blocks = _game_blocks(game, coefs)
                _, before, after = _repaired([m for _, m in blocks], game["risk_score"][alone])
                rows.append((len(game["bets"]), int(game["bets"].sum()), before, after))
            more = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.float64(), pa.float64()])]
            names = [*keys, "game", "n_units", "n_bets", "lowest_before", "lowest_after"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keys, "game"]], *more], names=names)

    schema = f"{fields}, game string, n_units bigint, n_bets bigint, lowest_before double, lowest_after double"
    return _game_rows(units, keys, ["bets"], []).mapInArrow(repair, schema)


def _game_rows(df: DataFrame, keys: Sequence[str], more: Sequence[str], week: Sequence[str]) -> DataFrame:
    """One row per game with its bets as an array.

    Games are spread over all shuffle partitions: they are small in bytes but costly to
    solve, so partitions must not be merged by size.
    """
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "game")
    names = [F.col(c).cast("string").alias(c) for c in ("team", "opponent", "label", "position", "var")]
    bet = F.struct(*names, F.col("risk_score").cast("double").alias("risk_score"), *more)
    return spread.groupBy(*keys, "game").agg(*[F.first(w).alias(w) for w in week], F.collect_list(bet).alias("bets"))


def _games(batch: pa.RecordBatch) -> Iterator[tuple[int, Game]]:
    """Row number and bets of each game of a batch."""
    for i, bets in enumerate(batch.column("bets")):
        yield i, {f.name: bets.values.field(f.name).to_numpy(zero_copy_only=False) for f in bets.values.type}


def _price_path(cov: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solution of min u'Cu/2 - (mu + lam)'u, u >= 0 as lam grows: knots, values there, last slope.

    The solution is piecewise linear in lam; bets enter and leave one at a time.
    """
    n = len(mu)
    lam, active = -float(mu.max()), [int(np.argmax(mu))]
    knots, values = [lam], [np.zeros(n)]
    for turn in range(1 << 62):
        if turn > 1000 * (n + 1):
            raise RuntimeError(f"the price path of a game with {n} bets does not end")
        base, slope = np.linalg.solve(cov[np.ix_(active, active)], np.column_stack([mu[active], np.ones(len(active))])).T
        falls = slope < -1e-12
        leave = np.where(falls, -base / np.where(falls, slope, 1.0), np.inf)
        idle = np.setdiff1d(np.arange(n), active)
        gap = cov[np.ix_(idle, active)] @ base - mu[idle]
        gain = cov[np.ix_(idle, active)] @ slope - 1.0
        rises = gain < -1e-12
        enter = np.where(rises, -gap / np.where(rises, gain, 1.0), np.inf)
        first_leave = leave.min(initial=np.inf)
        first_enter = enter.min(initial=np.inf)
        step = min(first_leave, first_enter)
        if not np.isfinite(step):
            break
        lam = max(lam, float(step))
        u = np.zeros(n)
        u[active] = np.maximum(0.0, base + lam * slope)
        knots.append(lam)
        values.append(u)
        if first_enter <= first_leave:
            active.append(int(idle[int(np.argmin(enter))]))
        else:
            del active[int(np.argmin(leave))]
    final = np.zeros(n)
    final[active] = np.maximum(slope, 0.0)
    return np.array(knots), np.array(values), final


def _along(path: tuple[np.ndarray, np.ndarray, np.ndarray], lam: np.ndarray) -> np.ndarray:
    """Values of a path at given prices, one row per bet."""
    knots, values, final = path
    inside = np.array([np.interp(lam, knots, values[:, i]) for i in range(values.shape[1])])
    return inside + np.outer(final, np.maximum(lam - knots[-1], 0.0))


class _Answers:
    """What a game takes at any price of money: a straight line for a bet alone, a price path per block of the others."""

    def __init__(self, game: Game, coefs: Mapping[tuple, float]) -> None:
        mu = game["ev"] / 100.0
        self.n = len(mu)
        self.alone, blocks = _game_blocks(game, coefs)
        self.mu, self.var = mu[self.alone], game["risk_score"][self.alone] + RIDGE
        matrices, _, _ = _repaired([m for _, m in blocks], game["risk_score"][self.alone])
        self.paths = [(bets, _price_path(m, mu[bets])) for (bets, _), m in zip(blocks, matrices)]

    def at(self, lam: np.ndarray) -> np.ndarray:
        """One row per bet, one column per price."""
        out = np.empty((self.n, len(lam)))
        out[self.alone] = np.maximum(self.mu[:, None] + lam, 0.0) / self.var[:, None]
        for bets, path in self.paths:
            out[bets] = _along(path, lam)
        return out


def weight_sweep(
    bets: DataFrame, coefs: Mapping[tuple, float], keys: Sequence[str], gammas: Sequence[float], max_bets: int | None = None,
    grid: int = 160,
) -> DataFrame:
    """Long-only, fully invested mean-variance weights for every risk aversion.

    Games are independent given the price of money ``lam``: each game answers how much it
    would take at every price of a grid, the answers are added up per week, and the
    price at which a week is exactly invested is read off.  With u = 2 * gamma * w the
    games' answers do not depend on gamma, so one pass serves every gamma.  A week is only
    ever a vector of ``grid`` numbers.  A game is solved by its blocks of correlated bets, so its
    cost grows with its bets and with the cube of its largest block only.  ``max_bets`` keeps that many
    of the largest weights of a week, None keeps all.
    """
    steps = np.concatenate([[0.0], np.logspace(-5, 5, grid - 1)])
    goal = 2.0 * np.array([float(g) for g in gammas])
    cols = [*keys, *_GAME_COLUMNS, "bet_id", "ev", "risk_score"]
    tops = bets.groupBy(*keys).agg((F.max("ev") / 100.0).alias("_top"))
    inputs = staged(bets.select(*cols).join(tops, list(keys)), "inputs")
    fields = ", ".join(f"{k} {bets.schema[k].dataType.simpleString()}" for k in keys)

    def per_game(answer: Callable[[Game, float, list | None], np.ndarray]):
        """One row per game: its week and a sum over its bets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = [answer(game, *week).sum(axis=0) for game, *week in _with_week(batch)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], _lists(sums)], names=[*keys, "taken"])

        return run

    def added(games: DataFrame) -> DataFrame:
        weekly = games.select(*keys, F.posexplode("taken").alias("step", "taken")).groupBy(*keys, "step").agg(F.sum("taken").alias("taken"))
        return weekly.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "taken")))["taken"].alias("_curve"))

    def demand(game: Game, top: float, _) -> np.ndarray:
        return _Answers(game, coefs).at(steps - top)

    def weights(game: Game, top: float, curve: Sequence[float]) -> np.ndarray:
        return _Answers(game, coefs).at(_invested_prices(curve, steps - top, goal)) / goal

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (game, *week) in enumerate(_with_week(batch)):
                w = weights(game, *week)
                heads = [batch.column(k).take(pa.array([i] * len(w))) for k in keys]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(game["bet_id"], pa.string()), _lists(w)], names=[*keys, "bet_id", "weights"])

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (game, *week) in enumerate(_with_week(batch)):
                w, ids = weights(game, *week), game["bet_id"].astype(str)
                # a bet outside its own game's best cannot be among the week's best
                best = [np.lexsort((ids, -w[:, k]))[:max_bets] for k in range(len(goal))]
                at, k = np.concatenate(best), np.repeat(np.arange(len(goal)), [len(b) for b in best])
                at, k = at[w[at, k] > 0], k[w[at, k] > 0]
                heads = [batch.column(c).take(pa.array([i] * len(at), pa.int64())) for c in keys]
                yield pa.RecordBatch.from_arrays(
                    [*heads, pa.array(k, pa.int32()), pa.array(game["bet_id"][at], pa.string()), pa.array(w[at, k])],
                    names=[*keys, "gamma_index", "bet_id", "weight"],
                )

    games = _game_rows(inputs, keys, ["bet_id", F.col("ev").cast("double").alias("ev")], ["_top"])
    curve = added(games.mapInArrow(per_game(demand), f"{fields}, taken array<double>"))
    if max_bets is None:
        curve = staged(curve, "curve")  # the totals and the weights read it
        priced = games.join(curve, list(keys))
        totals = added(priced.mapInArrow(per_game(weights), f"{fields}, taken array<double>")).withColumnRenamed("_curve", "_totals")
        # a bet meets the totals of its week once, and becomes a row per risk aversion after that
        met = priced.mapInArrow(every, f"{fields}, bet_id string, weights array<double>").join(totals, list(keys))
        each = F.filter(
            F.transform("weights", lambda w, k: F.struct(k.alias("gamma_index"), w.alias("weight"), (w / F.get("_totals", k)).alias("share"))),
            lambda x: x["weight"] > 0,
        )
        best = met.select(*keys, "bet_id", F.explode(each).alias("_x")).select(*keys, "bet_id", "_x.gamma_index", F.col("_x.share").alias("weight"))
    else:
        solved = games.join(curve, list(keys)).mapInArrow(largest, f"{fields}, gamma_index int, bet_id string, weight double")
        kept = top_n(solved, [*keys, "gamma_index"], [F.desc("weight"), "bet_id"], max_bets)
        totals = kept.groupBy(*keys, "gamma_index").agg(F.sum("weight").alias("_total"))
        best = kept.join(totals, [*keys, "gamma_index"]).withColumn("weight", F.col("weight") / F.col("_total"))
    return best.select(*keys, "gamma_index", _gamma(gammas).alias("gamma"), portfolio_id(keys).alias("portfolio_id"), "bet_id", "weight")


def _with_week(batch: pa.RecordBatch) -> Iterator[tuple[Game, float, list | None]]:
    """Bets of each game of a batch, its week's top and, once known, curve."""
    curves = batch.column("_curve") if "_curve" in batch.schema.names else None
    for i, game in _games(batch):
        yield game, batch.column("_top")[i].as_py(), None if curves is None else curves[i].as_py()


def _lists(rows: Sequence[np.ndarray]) -> pa.Array:
    """Rows of equal length as one array of lists."""
    flat = np.concatenate(rows) if len(rows) else np.zeros(0)
    offsets = np.cumsum([0, *[len(r) for r in rows]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _invested_prices(taken: Sequence[float], lam: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Prices of money at which a week takes exactly the goals."""
    curve = np.maximum.accumulate(np.array(taken)) + 1e-15 * np.arange(len(taken))
    out = np.interp(goal, curve, lam)
    beyond = goal > curve[-1]
    if beyond.any():  # the last stretch is a straight line
        slope = max((curve[-1] - curve[-2]) / (lam[-1] - lam[-2]), 1e-12)
        out[beyond] = lam[-1] + (goal[beyond] - curve[-1]) / slope
    return out


def _gamma(values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("gamma_index") + 1)


def portfolio_id(keys: Sequence[str]) -> Column:
    """A stable id in place of a random one."""
    return F.xxhash64(*keys, F.col("gamma_index"))


def gamma_grid(n: int = 100) -> list[float]:
    """Risk aversions from 10^-3 to 10^3."""
    return [float(g) for g in np.logspace(-3, 3, n)]
