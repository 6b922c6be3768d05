"""Models as rows: one table of weights for all targets, fitted together and applied in one scan.

A row carries its features as one array, in the order of a ``Design``, and the labels of all its targets as an array of
(response_var, label).  A pass over the rows serves every target, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import staged

INTERCEPT = "(intercept)"


@dataclass(frozen=True)
class Design:
    """Order and names of the features: intercept, numbers with a flag for missing ones, levels of categories.

    A missing number counts as 0 and sets its flag.  A missing level is a level of its own, and a level that was not
    there when the design was fitted sets nothing.
    """

    numeric: tuple[str, ...]
    levels: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def names(self) -> list[str]:
        out = [INTERCEPT]
        for c in self.numeric:
            out += [c, f"{c}=missing"]
        for c, values in self.levels:
            out += [f"{c}={v}" for v in values] + [f"{c}=missing"]
        return out

    def vector(self) -> Column:
        parts = [F.lit(1.0)]
        for c in self.numeric:
            x = F.col(c).cast("double")
            known = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
            parts += [F.when(known, x).otherwise(0.0), F.when(known, 0.0).otherwise(1.0)]
        for c, values in self.levels:
            level = F.col(c).cast("string")
            parts += [F.when(level == v, 1.0).otherwise(0.0) for v in values] + [F.when(level.isNull(), 1.0).otherwise(0.0)]
        return F.array(*parts)


def fit_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], most: int = 128) -> Design:
    """Levels seen in ``df``; more than ``most`` features in all raise, as a fit holds their products for each target."""
    levels: tuple = ()
    if categorical:
        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical]))
        found = df.select(pair.alias("r")).select("r.*").where("v IS NOT NULL").distinct().limit(most + 1).collect()
        levels = tuple((c, tuple(sorted(r["v"] for r in found if r["c"] == c))) for c in categorical)
    design = Design(tuple(numeric), levels)
    if len(design.names) > most:
        raise ValueError(f"more than {most} features; combine rare levels first")
    return design


def label_list(codes: Mapping[str, Sequence[tuple[str, float]]]) -> Column:
    """Labels of all targets of a row: per measure, (target, least value) pairs; an unknown measure gives none."""
    each = [
        F.struct(F.lit(target).alias("response_var"), (F.col(measure) >= F.lit(float(least))).cast("double").alias("label"))
        for measure, rungs in codes.items() for target, least in rungs
    ]
    return F.filter(F.array(*each), lambda s: s["label"].isNotNull())


def _packed(a: np.ndarray) -> pa.Array:
    """The rows of a matrix as one binary value each."""
    a = np.ascontiguousarray(a)
    ends = np.arange(len(a) + 1, dtype=np.int32) * np.int32(a.itemsize * a.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(a)])


def _unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _coded(rows: DataFrame, names: Sequence[str], size: int) -> DataFrame:
    """Rows as a fit reads them, written once: features, labels seen per target and their sum, without any name."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = pa.array(names, pa.string())
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(n, size)
            lists = batch.column("labels")
            flat = lists.flatten()
            target = pc.index_in(flat.field("response_var"), order)
            known = pc.is_valid(target).to_numpy(zero_copy_only=False)
            owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            cell = owner * len(names) + pc.drop_null(target).to_numpy(zero_copy_only=False)
            label = flat.field("label").to_numpy(zero_copy_only=False)[known]
            seen = np.bincount(cell, minlength=n * len(names)).astype(np.int32).reshape(n, len(names))
            hits = np.bincount(cell, label, minlength=n * len(names)).reshape(n, len(names))
            yield pa.RecordBatch.from_arrays([_packed(x), _packed(seen), _packed(hits)], ["features", "seen", "hits"])

    return staged(rows.select("features", "labels").mapInArrow(code, "features binary, seen binary, hits binary"), "coded")


def _sums(weights: np.ndarray):
    """Arrow function: per target the objective, gradient and curvature at ``weights``, summed over the partition.

    The curvatures of all targets are one product of matrices: their p(1 - p) by the products of two features.
    """
    size = weights.shape[1]
    first, second = np.triu_indices(size)
    step = max(64, (1 << 20) // len(first))  # rows whose products are held at once

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), 2 + size + len(first)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = _unpacked(part.column("features"), np.float64, size)
                seen = _unpacked(part.column("seen"), np.int32, len(weights))
                hits = _unpacked(part.column("hits"), np.float64, len(weights))
                z = x @ weights.T
                low = np.exp(-np.abs(z))
                p = np.where(z >= 0, 1.0, low) / (1.0 + low)
                total[:, 0] += seen.sum(axis=0)
                total[:, 1] += (seen * (np.maximum(z, 0.0) + np.log1p(low)) - hits * z).sum(axis=0)
                total[:, 2:2 + size] += (hits - seen * p).T @ x
                total[:, 2 + size:] += (seen * (low / (1.0 + low) ** 2)).T @ (x[:, first] * x[:, second])
        t, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(t, pa.int32()), pa.array(place, pa.int32()), pa.array(total[t, place])], ["target", "place", "value"]
        )

    return add


def _gathered(coded: DataFrame, weights: np.ndarray) -> np.ndarray:
    size = weights.shape[1]
    out = np.zeros((len(weights), 2 + size + size * (size + 1) // 2))
    parts = coded.mapInArrow(_sums(weights), "target int, place int, value double")
    got = parts.groupBy("target", "place").agg(F.sum("value").alias("value")).toPandas()  # targets x products of features
    out[got["target"].to_numpy(), got["place"].to_numpy()] = got["value"].to_numpy()
    return out


def fit_targets(rows: DataFrame, design: Design, ridge: float = 1e-3, rounds: int = 60, close: float = 1e-9) -> DataFrame:
    """Logistic weights of every target as rows (response_var, feature, weight).

    ``rows`` holds ``features`` (``design.vector()``) and ``labels``.  It is read twice, to count the labels and to write
    them down without their names; each Newton round reads what was written, once for all targets together.  A weight is penalised by ``ridge`` times the rows times half its square in units of
    the feature's root mean square, the intercept is not; so expected and observed successes agree.  A round that does not
    lower a target's objective is halved; a target ends when its Newton decrement is below ``close``² times its rows.
    A target without a label has no weights; one whose labels are all equal is given the log odds with half a row added to either side as its intercept, and no other weight.
    """
    spark, size = rows.sparkSession, len(design.names)
    known = rows.select(F.explode("labels").alias("l")).groupBy("l.response_var").agg(
        F.count("*").alias("n"), F.sum("l.label").alias("hits")
    ).orderBy("response_var").collect()  # one row per target
    weights = {r["response_var"]: np.zeros(size) for r in known}
    for r in known:
        weights[r["response_var"]][0] = np.log((r["hits"] + 0.5) / (r["n"] - r["hits"] + 0.5))
    names = [r["response_var"] for r in known if 0 < r["hits"] < r["n"]]
    if names:
        for name, w in zip(names, _newton(_coded(rows, names, size), names, np.array([weights[n] for n in names]), ridge, rounds, close)):
            weights[name] = w
    out = [(t, f, float(v)) for t, w in weights.items() for f, v in zip(design.names, w)]
    return spark.createDataFrame(out, "response_var string, feature string, weight double")


def _newton(coded: DataFrame, names: Sequence[str], start: np.ndarray, ridge: float, rounds: int, close: float) -> np.ndarray:
    size = start.shape[1]
    upper = np.triu_indices(size)
    squares = _gathered(coded, np.zeros_like(start))  # at p = 1/2 the curvature is a quarter of the sum of squares
    penalty = np.zeros((len(names), size))
    for t in range(len(names)):
        curve = np.zeros((size, size))
        curve[upper] = squares[t, 2 + size:]
        penalty[t] = ridge * 4 * np.diag(curve)
        penalty[t, np.diag(curve) == 0] = 1.0  # a feature without values keeps weight 0
    penalty[:, 0] = 0.0
    best, step = start.copy(), np.zeros_like(start)
    lowest, open_ = np.full(len(names), np.inf), np.ones(len(names), bool)
    for _ in range(rounds):
        tried = best + step
        sums = _gathered(coded, tried)
        for t in np.flatnonzero(open_):
            objective = sums[t, 1] + 0.5 * penalty[t] @ tried[t] ** 2
            if objective > lowest[t] * (1 + 1e-12) + 1e-12:
                step[t] /= 2
                continue
            best[t], lowest[t] = tried[t], objective
            curve = np.zeros((size, size))
            curve[upper] = sums[t, 2 + size:]
            curve += np.triu(curve, 1).T + np.diag(penalty[t])
            slope = sums[t, 2:2 + size] - penalty[t] * tried[t]
            scale = 1.0 / np.sqrt(np.maximum(np.diag(curve), 1e-300))
            step[t] = scale * np.linalg.lstsq(curve * np.outer(scale, scale), scale * slope, rcond=1e-13)[0]
            open_[t] = slope @ step[t] > close**2 * sums[t, 0]
            if not open_[t]:
                step[t] = 0.0
        if not open_.any():
            return best
    raise RuntimeError(f"no convergence for {[n for n, o in zip(names, open_) if o]}")


def evidence_weights(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Weights of evidence as rows: the log odds of a target, and what each level adds to them.

    One grouped count for all targets and features; ``rows`` has ``labels`` and the categories.  Half a row is added to
    every count, missing is a level.
    """
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    named = F.array(F.lit(INTERCEPT), *[F.concat(F.lit(f"{c}="), level(c)) for c in features])
    # counts per combination of levels first: the explosion by feature works on these few rows
    cells = rows.select(named.alias("names"), F.explode("labels").alias("l")).groupBy("names", "l.response_var").agg(
        F.count("*").alias("n"), F.sum("l.label").alias("hits")
    )
    each = cells.select("response_var", F.explode("names").alias("feature"), "n", "hits").groupBy("response_var", "feature").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits")
    ).select("response_var", "feature", F.ln((F.col("hits") + 0.5) / (F.col("n") - F.col("hits") + 0.5)).alias("odds"))
    base = each.where(F.col("feature") == INTERCEPT).select("response_var", F.col("odds").alias("base"))
    return each.join(base, "response_var").select(
        "response_var", "feature",
        F.when(F.col("feature") == INTERCEPT, F.col("odds")).otherwise(F.col("odds") - F.col("base")).alias("weight"),
    )


def score_rows(rows: DataFrame, weights: DataFrame, design: Design, keys: Sequence[str], targets: str = "targets") -> DataFrame:
    """Probability of every target of a row: keys, response_var, model_probability.

    ``rows`` holds ``features`` and an array of target names, or of structs with a ``response_var`` whose other fields
    are handed on (``targets="labels"``).  The weights become one array per target, in the design's order, joined by the
    target's name: one scan of the rows whatever the number of targets, and no row per feature.  The arrays are sent to
    the rows, never the other way: they are as many as there are targets, but the size Spark guesses for them is that of
    whatever they were fitted on.
    A target without weights gives no row; a feature without a weight counts nothing.
    """
    places = F.create_map(*[F.lit(v) for i, n in enumerate(design.names) for v in (n, i)])
    by_place = weights.select("response_var", places[F.col("feature")].alias("place"), "weight").where("place IS NOT NULL")
    arrays = by_place.groupBy("response_var").agg(F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("m")).select(
        "response_var", F.transform(F.sequence(F.lit(0), F.lit(len(design.names) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("_w")
    )
    named = isinstance(rows.schema[targets].dataType.elementType, StructType)
    long = rows.select(*keys, "features", F.explode(targets).alias("_t")).select(
        *keys, "features", "_t.*" if named else F.col("_t").alias("response_var")
    )
    z = F.lit(0.0)
    for i in range(len(design.names)):
        z = z + F.get("features", F.lit(i)) * F.get("_w", F.lit(i))
    return long.join(F.broadcast(arrays), "response_var").withColumn("model_probability", 1.0 / (1.0 + F.exp(-z))).select(
        *keys, *[c for c in long.columns if c not in (*keys, "features")], "model_probability"
    )
