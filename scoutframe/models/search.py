"""Random search over boosted trees and forests, on counts instead of rows.

Trees read binned features only, so all rows with the same bins, fold and label do the same in every split. One pass over
the data counts them (a *cell* is a combination of bins), and every model of the search is fitted on the counts: exactly
what fitting on the binned rows would give. The number of cells is bounded by a parameter - bins are made wider until
they fit - so a task that fits models holds the same amount whatever the size of the data. Draws are independent and
spread over the cluster, one task each with the models of all folds; a lost executor costs only its draws.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import exact_percentiles
from ..sources.tables import staged

LEVELS = 254  # levels of a category with a bin of their own, the most frequent ones


@dataclass(frozen=True)
class Range:
    """A setting drawn evenly from low (included) to high (left out); whole numbers if both are."""

    low: float
    high: float

    def draw(self, rng: random.Random):
        if isinstance(self.low, int):
            return rng.randrange(self.low, self.high)
        return rng.uniform(self.low, self.high)


# The ranges from which settings are drawn.
BOOSTED = {"trees": Range(50, 600), "depth": Range(3, 10), "rate": Range(0.01, 0.21), "least_weight": Range(1, 20), "subsample": Range(0.4, 1.0)}
FOREST = {"trees": Range(100, 600), "depth": (None, 5, 10, 15), "least_to_split": Range(2, 10), "least_in_leaf": Range(1, 5)}
SPACES = {"boosted": BOOSTED, "forest": FOREST}


def draw_settings(family: str, n: int, seed: int) -> list[dict]:
    """n seeded draws; each setting is drawn on its own."""
    rng = random.Random(f"{family}:{seed}")
    return [{k: v.draw(rng) if isinstance(v, Range) else rng.choice(v) for k, v in SPACES[family].items()} for _ in range(n)]


def bin_columns(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int) -> list[Column]:
    """One bin number per feature: 0 is missing; numbers are cut at quantiles, categories go by frequency.

    Levels beyond the ``LEVELS`` most frequent ones, and those not seen here, share the last bin.
    """
    edges = exact_percentiles(train, list(numeric), [i / bins for i in range(1, bins)]) if numeric else {}
    out = []
    for c in numeric:
        v = F.col(c).cast("double")
        cuts = F.array(*[F.lit(float(e)) for e in sorted({e for e in edges[c] if e is not None})]).cast("array<double>")
        out.append(F.when(v.isNull() | F.isnan(v), 0).otherwise(1 + F.size(F.filter(cuts, lambda e: v > e))).cast("int").alias(c))
    for c in categorical:
        common = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(min(LEVELS, bins * 4)).collect()
        place = F.lit(len(common) + 1)
        for i, row in enumerate(common):
            place = F.when(F.col(c) == row[c], i + 1).otherwise(place)
        out.append(F.when(F.col(c).isNull(), 0).otherwise(place).cast("int").alias(c))
    return out


def training_cells(train: DataFrame, label: str, fold: str, numeric: Sequence[str], categorical: Sequence[str], bins: int = 16, max_cells: int = 4_096) -> DataFrame:
    """(features' bins, fold, n, ones): rows counted by their bins, with at most ``max_cells`` combinations of bins.

    Bins are halved in number until the combinations fit; with two bins a feature too many combinations are an error.
    """
    features = [*numeric, *categorical]
    rows = train.where(F.col(label).isNotNull())
    while True:
        placed = rows.select(*bin_columns(rows, numeric, categorical, bins), F.col(fold).cast("int").alias("fold"), F.col(label).cast("long").alias("one"))
        cells = staged(placed.groupBy(*features, "fold").agg(F.count("*").alias("n"), F.sum("one").alias("ones")), "cells")
        if cells.select(*features).distinct().count() <= max_cells:
            return cells
        if bins <= 2:
            raise ValueError(f"{len(features)} features make more than {max_cells} combinations of two bins; choose fewer features or allow more cells")
        bins //= 2


@dataclass(frozen=True)
class Table:
    """Cells as arrays: bins (cells x features), which features are categories, and rows and ones (cells x folds)."""

    bins: np.ndarray
    categories: np.ndarray
    n: np.ndarray
    ones: np.ndarray


def cell_table(cells: DataFrame, numeric: Sequence[str], categorical: Sequence[str], folds: int) -> Table:
    """The bounded table of ``training_cells`` in memory; at most max_cells x folds rows."""
    features = [*numeric, *categorical]
    rows = cells.orderBy(*features, "fold").toPandas()
    bins, of = np.unique(rows[features].to_numpy(np.int64), axis=0, return_inverse=True)
    n, ones = np.zeros((len(bins), folds)), np.zeros((len(bins), folds))
    np.add.at(n, (of.ravel(), rows["fold"]), rows["n"])
    np.add.at(ones, (of.ravel(), rows["fold"]), rows["ones"])
    return Table(bins, np.array([f in set(categorical) for f in features]), n, ones)


def grow(bins: np.ndarray, categories: np.ndarray, first: np.ndarray, second: np.ndarray, depth: int | None, gain, value, allowed=None) -> np.ndarray:
    """Several trees at once, level by level: cells x trees values of the leaves that the cells end in.

    ``first`` and ``second`` are weights, cells x trees; cells without weight go the way of the others and do not count.
    ``gain(left1, left2, all1, all2)`` rates splits, below or at zero for none; ``value(all1, all2)`` is a leaf's.
    ``allowed(nodes)`` may give a nodes x features mask of features to choose from.
    """
    trees, width = first.shape[1], int(bins.max(initial=0)) + 1
    # one element per cell and tree; at first every tree is one node
    first, second, out = first.ravel(), second.ravel(), np.empty(first.size)
    cell, node = np.divmod(np.arange(first.size), trees)
    cells, nodes, level = np.arange(first.size), trees, 0
    while len(cells):
        all1, all2 = (np.bincount(node, weights=x[cells], minlength=nodes) for x in (first, second))
        best, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
        if depth is None or level < depth:
            mask = allowed(nodes) if allowed else None
            for f in range(bins.shape[1]):
                at = node * width + bins[cell[cells], f]
                left1, left2 = (np.bincount(at, weights=x[cells], minlength=nodes * width).reshape(nodes, width) for x in (first, second))
                if not categories[f]:
                    left1, left2 = np.cumsum(left1, axis=1), np.cumsum(left2, axis=1)
                rated = gain(left1, left2, all1[:, None], all2[:, None])
                place = rated.argmax(axis=1)
                top = rated[np.arange(nodes), place]
                better = top > best + 1e-12
                if mask is not None:
                    better &= mask[:, f]
                best[better], feature[better], cut[better] = top[better], f, place[better]
        ended = feature < 0
        leaf = ended[node]
        out[cells[leaf]] = value(all1, all2)[node[leaf]]
        cells, node = cells[~leaf], node[~leaf]
        mine = bins[cell[cells], feature[node]]
        left = np.where(categories[feature[node]], mine == cut[node], mine <= cut[node])
        node = 2 * (np.cumsum(~ended) - 1)[node] + ~left
        nodes, level = 2 * int((~ended).sum()), level + 1
    return out.reshape(-1, trees)


def _log_loss(p: np.ndarray, n: np.ndarray, ones: np.ndarray) -> float:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return float(-(ones * np.log(p) + (n - ones) * np.log(1 - p)).sum() / n.sum()) if n.sum() else 0.0


def boosted(table: Table, n: np.ndarray, ones: np.ndarray, settings: dict, seed: int) -> np.ndarray:
    """Probability of each cell by second-order boosting of the log loss, one model per column of the weights n and ones."""
    rng = np.random.default_rng(seed)
    whole, positive = n.astype(np.int64), ones.astype(np.int64)

    def score(g, h):
        return g * g / (h + 1.0)

    def gain(left_g, left_h, all_g, all_h):
        right_g, right_h = all_g - left_g, all_h - left_h
        held = (left_h >= settings["least_weight"]) & (right_h >= settings["least_weight"])
        return np.where(held, score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h), -1.0)

    margin = np.zeros(n.shape)
    for _ in range(settings["trees"]):
        p = 1 / (1 + np.exp(-margin))
        yes = rng.binomial(positive, settings["subsample"])
        some = yes + rng.binomial(whole - positive, settings["subsample"])
        margin += settings["rate"] * grow(table.bins, table.categories, some * p - yes, some * p * (1 - p), settings["depth"], gain, lambda g, h: -g / (h + 1.0))
    return 1 / (1 + np.exp(-margin))


AT_ONCE = 8  # trees of each forest that are grown together


def forest(table: Table, n: np.ndarray, ones: np.ndarray, settings: dict, seed: int) -> np.ndarray:
    """Probability of each cell by a forest: bootstrap rows, and a random choice of features at each node; one forest per column."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate([ones, n - ones])
    size = rows.sum(axis=0).astype(np.int64)
    shares = (rows / np.maximum(rows.sum(axis=0), 1)).T
    features = table.bins.shape[1]
    chosen = max(1, int(np.sqrt(features)))

    def impurity(yes, some):
        return 2 * yes * (some - yes) / np.maximum(some, 1)

    def gain(left_yes, left_some, yes, some):
        right_yes, right_some = yes - left_yes, some - left_some
        held = (left_some >= settings["least_in_leaf"]) & (right_some >= settings["least_in_leaf"]) & (some >= settings["least_to_split"])
        return np.where(held, impurity(yes, some) - impurity(left_yes, left_some) - impurity(right_yes, right_some), -1.0)

    def allowed(nodes):
        return rng.random((nodes, features)).argsort(axis=1) < chosen

    total = np.zeros(n.shape)
    for done in range(0, settings["trees"], AT_ONCE):
        trees = min(AT_ONCE, settings["trees"] - done)
        drawn = np.concatenate([rng.multinomial(k, share, size=trees) if k else np.zeros((trees, len(rows))) for k, share in zip(size, shares)]).T
        yes = drawn[: len(n)].astype(float)
        leaves = grow(table.bins, table.categories, yes, yes + drawn[len(n) :], settings["depth"], gain, lambda y, s: y / np.maximum(s, 1), allowed)
        total += leaves.reshape(len(n), -1, trees).sum(axis=2)
    return total / settings["trees"]


FITS = {"boosted": boosted, "forest": forest}


def random_search(
    train: DataFrame, family: str, numeric: Sequence[str], categorical: Sequence[str], label: str = "label", fold: str = "fold",
    draws: int = 100, folds: int = 5, seed: int = 123, bins: int = 16, max_cells: int = 4_096,
) -> DataFrame:
    """(family, draw, settings, log_loss, chosen): mean log loss over the held-out folds of every draw; the first least one is chosen.

    ``fold`` is a column of 0 to folds - 1. A fold's rows are left out of the fit and scored by it.
    """
    spark = train.sparkSession
    cells = training_cells(train, label, fold, numeric, categorical, bins, max_cells)
    table = spark.sparkContext.broadcast(cell_table(cells, numeric, categorical, folds))
    settings = draw_settings(family, draws, seed)
    fit = FITS[family]

    def fit_draws(source):
        t = table.value
        others = 1 - np.eye(folds)  # a model per fold, on the rows of all others
        for rows in source:
            out = []
            for draw in rows["id"].tolist():
                p = fit(t, t.n @ others, t.ones @ others, settings[draw], seed + draw)
                out.extend((draw, k, _log_loss(p[:, k], t.n[:, k], t.ones[:, k])) for k in range(folds))
            yield pd.DataFrame(out, columns=["draw", "fold", "loss"])

    losses = spark.range(0, draws, 1, draws).mapInPandas(fit_draws, "draw int, fold int, loss double")
    by_draw = staged(losses.groupBy("draw").agg(F.avg("loss").alias("log_loss")), "losses")
    texts = [(i, ", ".join(f"{k}={v:.4g}" if isinstance(v, float) else f"{k}={v}" for k, v in s.items())) for i, s in enumerate(settings)]
    best = by_draw.agg(F.min(F.struct("log_loss", "draw")).alias("best")).select(F.col("best.draw").alias("draw"), F.lit(True).alias("chosen"))
    named = by_draw.join(F.broadcast(spark.createDataFrame(texts, "draw int, settings string")), "draw").join(F.broadcast(best), "draw", "left")
    return named.select(F.lit(family).alias("family"), "draw", "settings", "log_loss", F.coalesce("chosen", F.lit(False)).alias("chosen"))
