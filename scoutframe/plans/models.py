"""Model-table queries (M)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from ..models import linear as L
from ..models import prepare as Q
from ..models import search as H
from ..models import selection as S
from ..models import training as M
from ..operators import aggregates as A
from ..operators import features as X
from ..operators import windows as W
from ..sources.tables import scratch_path, staged
from . import domain as D
from .aggregates import reliability_sql
from .registry import query

NUMERIC = ["touches", "urgent", "yards_lag1", "avg_yards", "week"]
CATEGORICAL = ["position"]
KEYS = ["entity", "season", "week"]
# The hidden layers and seeds of the reference's neural grid
HIDDEN = [[a, *b] for a in (64, 128, 256) for b in ([], [64])]
SEEDS = [123, 456, 789]


def training_rows(spark, d):
    """Panel rows with features known beforehand; written once, read by every fit."""
    rows = D.panel(spark, d).select(
        "entity", "season", "week", "position", "touches", "urgent", (F.col("yards") >= 300).cast("double").alias("label"),
        F.lag("yards").over(W.Window.partitionBy("entity").orderBy("season", "week")).alias("yards_lag1"),
        F.avg("yards").over(W.prior(["entity"], ["season", "week"])).alias("avg_yards"),
    )
    return staged(rows.withColumn("split", X.chronological_split("season", 1999)), "training")


FOLDS = 5


def _search_rows(spark, d):
    rows = training_rows(spark, d).where("split = 'train'")
    return rows.withColumn("fold", F.expr(f"pmod(entity * 7 + season * 3 + week, {FOLDS})"))


_CELL_BINS = 8
_CELLS_SQL = (
    "WITH r AS MATERIALIZED (SELECT * FROM (SELECT entity, season, week, position, touches, urgent, yards, lag(yards) OVER (PARTITION BY entity ORDER BY season, week) AS yards_lag1, "
    "avg(yards) OVER (PARTITION BY entity ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS avg_yards FROM panel) WHERE season <= 1999 AND yards IS NOT NULL), "
    "e AS (SELECT " + ", ".join(f"list_distinct(quantile_cont(CAST({c} AS DOUBLE), [" + ", ".join(f"{i}/{_CELL_BINS}" for i in range(1, _CELL_BINS)) + f"])) AS {c}" for c in NUMERIC) + " FROM r), "
    "p AS (SELECT position, row_number() OVER (ORDER BY count(*) DESC, position) AS place FROM r WHERE position IS NOT NULL GROUP BY position), "
    "b AS (SELECT " + ", ".join(f"CASE WHEN r.{c} IS NULL THEN 0 ELSE 1 + len(list_filter(e.{c}, lambda q: r.{c} > q)) END AS {c}" for c in NUMERIC)
    + f", coalesce(p.place, 0) AS position, ((entity * 7 + season * 3 + r.week) % {FOLDS} + {FOLDS}) % {FOLDS} AS fold, yards >= 300 AS one FROM r CROSS JOIN e LEFT JOIN p ON p.position = r.position) "
    f"SELECT {', '.join(NUMERIC + CATEGORICAL)}, fold, count(*) AS n, CAST(count(*) FILTER (WHERE one) AS BIGINT) AS ones FROM b GROUP BY ALL"
)


@query("m1_training_cells", _CELLS_SQL, "panel")
def m1_cells(spark, d):
    """What the searches are fitted on: rows counted by bins and fold."""
    return H.training_cells(_search_rows(spark, d), "label", "fold", NUMERIC, CATEGORICAL, bins=_CELL_BINS, max_cells=1_000_000)


@query("m1_boosted_search")
def m1(spark, d):
    return H.random_search(_search_rows(spark, d), "boosted", NUMERIC, CATEGORICAL, folds=FOLDS)


@query("m2_forest_search")
def m2(spark, d):
    return H.random_search(_search_rows(spark, d), "forest", NUMERIC, CATEGORICAL, folds=FOLDS)


@query("m3_neural_grid")
def m3(spark, d):
    rows = training_rows(spark, d)
    scaling = Q.fit_scaling(rows.where("split = 'train'"), NUMERIC)
    ready = staged(Q.apply_scaling(rows, scaling, ["label", "split"]), "scaled")
    found = M.neural_grid(ready.where("split = 'train'"), ready.where("split = 'validation'"), scaling.columns, HIDDEN, SEEDS)
    return spark.createDataFrame([(h, s, float(l)) for l, h, s, _ in found], "hidden string, seed int, log_loss double")


_TRAIN_SQL = (
    "SELECT entity, season, week, position, touches, urgent, yards, lag(yards) OVER (PARTITION BY entity ORDER BY season, week) AS yards_lag1, 1 AS fixed FROM panel"
)


@query(
    "m4_scaling_and_encoding",
    f"WITH r AS MATERIALIZED ({_TRAIN_SQL}), s AS (SELECT avg(touches) AS mt, stddev_pop(touches) AS st, avg(yards_lag1) AS ml, stddev_pop(yards_lag1) AS sl FROM r WHERE season <= 1999) "
    "SELECT entity, season, week, (touches - mt) / st AS touches, coalesce((yards_lag1 - ml) / sl, 0.0) AS yards_lag1, CAST(position = 'QB' AS INT)::DOUBLE AS position_QB, CAST(position = 'RB' AS INT)::DOUBLE AS position_RB FROM r, s",
    "panel",
    "touches yards_lag1 position_QB position_RB",
)
def m4(spark, d):
    rows = D.panel(spark, d).select(
        "entity", "season", "week", "position", "touches",
        F.lag("yards").over(W.Window.partitionBy("entity").orderBy("season", "week")).alias("yards_lag1"), F.lit(1).alias("fixed"),
    )
    scaling = Q.fit_scaling(rows.where("season <= 1999"), ["touches", "yards_lag1", "fixed"])
    return Q.one_hot(Q.apply_scaling(rows, scaling, ["entity", "season", "week", "position"]), "position", ["QB", "RB"])


@query(
    "m4_missing_levels",
    "SELECT entity, season, week, " + ", ".join(f"CAST(level = '{v}' AS INT)::DOUBLE AS level_{v}" for v in ("QB", "RB", "missing"))
    + " FROM (SELECT entity, season, week, CASE WHEN air IS NULL THEN 'missing' ELSE position END AS level FROM panel)",
    "panel",
    "level_QB level_RB level_missing",
)
def m4_missing(spark, d):
    """A missing level has a column of its own; levels outside the list have zeros only."""
    rows = D.panel(spark, d).select("entity", "season", "week", F.when(F.col("air").isNotNull(), F.col("position")).alias("level"))
    return Q.one_hot(Q.named_missing(rows, ["level"]), "level", ["QB", "RB", Q.MISSING])


@query(
    "m5_rare_levels",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n >= 60 THEN level END AS level FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 997 AS VARCHAR) AS level FROM lineitem))",
)
def m5(spark, d):
    rows = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("CAST(l_partkey % 997 AS string)").alias("level"))
    return Q.drop_rare_levels(rows, ["level"], least=60)


@query(
    "m5_stable_columns",
    "WITH r AS (SELECT entity % 5 AS fold, yards, air, touches, CASE WHEN entity % 5 = 2 THEN 1 ELSE week END AS partly, 3 AS fixed FROM panel) "
    + " UNION ALL ".join(f"SELECT '{c}' AS name, (SELECT min({c}) < max({c}) FROM r) AS varies, (SELECT bool_and(v) FROM (SELECT min({c}) < max({c}) AS v FROM r GROUP BY fold)) AS varies_in_every_fold" for c in ("yards", "air", "touches", "partly", "fixed")),
    "panel",
)
def m5_stable(spark, d):
    rows = D.panel(spark, d).select(
        (F.col("entity") % 5).alias("fold"), "yards", "air", "touches", F.expr("CASE WHEN entity % 5 = 2 THEN 1 ELSE week END").alias("partly"), F.lit(3).alias("fixed")
    )
    return Q.stable_columns(rows, ["yards", "air", "touches", "partly", "fixed"], "fold")


def _plain_model():
    return Pipeline(stages=[*Q.feature_stages(NUMERIC, CATEGORICAL), LogisticRegression(labelCol="label")])


@query("m6_sigmoid_calibration")
def m6(spark, d):
    rows = training_rows(spark, d).where("split = 'train'")
    scores = staged(M.out_of_fold_scores(rows, _plain_model, KEYS), "scores")
    return M.calibrated(scores, M.sigmoid_calibration(scores)).select(*KEYS, "label", "score", "calibrated")


# --- comparison and selection ---------------------------------------------------------------

MODELS = [
    ("boosted", False, 1.0, 0.0), ("boosted", True, 0.98, 0.01), ("forest", False, 0.9, 0.05),
    ("forest", True, 0.95, 0.02), ("network", False, 0.8, 0.1), ("network", True, 0.85, 0.06),
]
_HIT_SQL = "((CAST(abs(odds) AS BIGINT) * 31 + q * 17) % 100) / CAST(100.0 AS DOUBLE) < p"
SCORES_SQL = (
    "SELECT bet_id, response_var, bet_hit, model_type, extra_calibration, p * a + b AS p FROM (SELECT bet_id, response_var, p, " + _HIT_SQL + " AS bet_hit FROM bets), (VALUES "
    + ", ".join(f"('{m}', {str(c).upper()}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, c, a, b in MODELS)
    + ") v(model_type, extra_calibration, a, b)"
)
TARGET_KEYS = ["response_var", "model_type", "extra_calibration"]


def scores(spark, d):
    """Six scored models per bet, each a known function of the true probability."""
    hit = ((F.abs("odds").cast("bigint") * 31 + F.col("q") * 17) % 100) / F.lit(100.0) < F.col("p")
    variants = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_type"), F.lit(c).alias("extra_calibration"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, c, a, b in MODELS
    ]))
    rows = D.bets(spark, d).select("bet_id", "response_var", "p", hit.alias("bet_hit"), variants.alias("m"))
    return rows.select(
        "bet_id", "response_var", "bet_hit", "m.model_type", "m.extra_calibration", (F.col("p") * F.col("m.a") + F.col("m.b")).alias("p")
    )


@query(
    "m7_ensembles",
    f"SELECT bet_id, 'trees' AS model_type, avg(p) AS p FROM ({SCORES_SQL}) WHERE NOT extra_calibration AND model_type IN ('boosted', 'forest') GROUP BY bet_id UNION ALL SELECT bet_id, 'all', avg(p) FROM ({SCORES_SQL}) WHERE NOT extra_calibration GROUP BY bet_id",
    "bets",
    "p",
    digits=9,
)
def m7(spark, d):
    raw = scores(spark, d).where("NOT extra_calibration")
    return S.ensemble(raw, ["bet_id"], "trees", ["boosted", "forest"]).unionByName(S.ensemble(raw, ["bet_id"], "all"))


_TK = "response_var, model_type, extra_calibration"


def _cal_sql(src: str, by: str, name: str) -> str:
    return f"SELECT {by}, sum(sqrt(n) * abs(pct_win - mean_prediction)) / sum(sqrt(n)) AS {name} FROM ({reliability_sql(src, by + ',')}) WHERE n >= 10 GROUP BY {by}"


_COMPARE_SQL = (
    f"SELECT l.*, calibration_score, calibration_score_under_30, calibration_score_30_to_60, calibration_score_above_60, num_inside_range, num_near_range, num_bad FROM "
    f"(SELECT {_TK}, avg(CASE WHEN bet_hit THEN -ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE -ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END) AS validation_log_loss FROM sc GROUP BY ALL) l "
    f"LEFT JOIN ({_cal_sql('sc', _TK, 'calibration_score')}) o USING ({_TK}) "
    f"LEFT JOIN ({_cal_sql('(SELECT * FROM sc WHERE p < 0.3)', _TK, 'calibration_score_under_30')}) r1 USING ({_TK}) "
    f"LEFT JOIN ({_cal_sql('(SELECT * FROM sc WHERE p >= 0.3 AND p < 0.6)', _TK, 'calibration_score_30_to_60')}) r2 USING ({_TK}) "
    f"LEFT JOIN ({_cal_sql('(SELECT * FROM sc WHERE p >= 0.6)', _TK, 'calibration_score_above_60')}) r3 USING ({_TK}) "
    f"LEFT JOIN (SELECT {_TK}, CAST(coalesce(sum(n) FILTER (WHERE assessment = 'Inside Target Range'), 0) AS BIGINT) AS num_inside_range, CAST(coalesce(sum(n) FILTER (WHERE assessment = 'Near Target Range'), 0) AS BIGINT) AS num_near_range, "
    f"CAST(coalesce(sum(n) FILTER (WHERE assessment = 'Bad'), 0) AS BIGINT) AS num_bad FROM ({reliability_sql('sc', _TK + ',')}) GROUP BY ALL) c USING ({_TK})"
)
_COMPARE_COLS = "validation_log_loss calibration_score calibration_score_under_30 calibration_score_30_to_60 calibration_score_above_60"


def comparison(spark, d):
    """Comparison table; it is small and read by several steps, so it is written once."""
    return staged(S.comparison_table(scores(spark, d), TARGET_KEYS), "comparison")


@query("m8_comparison_table", f"WITH sc AS MATERIALIZED ({SCORES_SQL}) {_COMPARE_SQL}", "bets", _COMPARE_COLS)
def m8(spark, d):
    return S.comparison_table(scores(spark, d), TARGET_KEYS)


_RC = "greatest(calibration_score_under_30, calibration_score_30_to_60, calibration_score_above_60) - least(calibration_score_under_30, calibration_score_30_to_60, calibration_score_above_60)"
_GAIN_SQL = (
    f"SELECT c.*, baseline_log_loss, (baseline_log_loss - validation_log_loss) / baseline_log_loss AS improvement, num_bad / nullif(num_bad + num_inside_range + num_near_range, 0) AS pct_bad, {_RC} AS range_calibrations, "
    "CAST((calibration_score_under_30 IS NOT NULL)::INT + (calibration_score_30_to_60 IS NOT NULL)::INT + (calibration_score_above_60 IS NOT NULL)::INT AS BIGINT) AS ranges_available FROM "
    f"({_COMPARE_SQL}) c LEFT JOIN (SELECT response_var, -(m * ln(m) + (1 - m) * ln(1 - m)) AS baseline_log_loss FROM (SELECT response_var, avg(CAST({_HIT_SQL} AS INT)::DOUBLE) AS m FROM bets GROUP BY response_var)) b USING (response_var)"
)


def _stage_sql(src: str, metric: str, tol: str, higher: bool = False) -> str:
    best, op = ("max", f">= best - {tol}") if higher else ("min", f"<= best + {tol}")
    return f"SELECT * EXCLUDE (best, cnt) FROM (SELECT *, {best}({metric}) OVER (PARTITION BY response_var) AS best, count(*) OVER (PARTITION BY response_var) AS cnt FROM ({src})) WHERE cnt = 1 OR {metric} {op}"


_sel = f"SELECT * FROM ({_GAIN_SQL}) WHERE calibration_score <= 0.06 AND pct_bad <= 0.3 AND improvement > 0"
for _m, _t, _h in (("calibration_score", "0.01", False), ("pct_bad", "0.05", False), ("range_calibrations", "0.02", False), ("improvement", "0.02", True), ("ranges_available", "0", True)):
    _sel = _stage_sql(_sel, _m, _t, _h)
_G = "OVER (PARTITION BY response_var)"
_BEST_SQL = (
    f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY response_var ORDER BY tie_break_score ASC NULLS LAST, model_type, extra_calibration) AS rn FROM (SELECT *, (calibration_score - min(calibration_score) {_G}) / 0.01 + (pct_bad - min(pct_bad) {_G}) / 0.05 + (range_calibrations - min(range_calibrations) {_G}) / 0.02 + (max(improvement) {_G} - improvement) / 0.02 AS tie_break_score FROM ({_sel}))) WHERE rn = 1"
)


def _tier_sql() -> str:
    out = "CASE "
    for name, criteria in S.TIERS:
        strict = " + ".join(f"coalesce(({m} {'>=' if hi else '<='} {c})::INT, 0)" for m, c, hi in criteria)
        near = " AND ".join(f"coalesce({m} {'>=' if hi else '<='} {c} {'-' if hi else '+'} {S.TOLERANCE[m] + 1e-4}, FALSE)" for m, c, hi in criteria)
        out += f"WHEN {strict} = 4 OR ({strict} = 3 AND {near}) THEN '{name}' "
    return out + "ELSE 'Weakest' END"


def chosen(spark, d):
    baseline = A.prevalence(scores(spark, d).where("model_type = 'boosted' AND NOT extra_calibration"), ["response_var"], "bet_hit")
    gained = staged(S.with_gain(comparison(spark, d), baseline), "gained")
    return S.select_best(S.survivors(gained))


@query(
    "m9_staged_selection",
    f"WITH sc AS MATERIALIZED ({SCORES_SQL}) SELECT response_var, model_type, extra_calibration, calibration_score, pct_bad, improvement, range_calibrations, ranges_available, tie_break_score FROM ({_BEST_SQL})",
    "bets",
    "calibration_score pct_bad improvement range_calibrations tie_break_score",
)
def m9(spark, d):
    return chosen(spark, d).select(*TARGET_KEYS, "calibration_score", "pct_bad", "improvement", "range_calibrations", "ranges_available", "tie_break_score")


@query(
    "m10_strength_tier",
    f"WITH sc AS MATERIALIZED ({SCORES_SQL}) SELECT {_TK}, {_tier_sql()} AS model_assessment FROM ({_GAIN_SQL})",
    "bets",
)
def m10(spark, d):
    baseline = A.prevalence(scores(spark, d).where("model_type = 'boosted' AND NOT extra_calibration"), ["response_var"], "bet_hit")
    return S.with_gain(comparison(spark, d), baseline).select(*TARGET_KEYS, S.tier().alias("model_assessment"))


@query(
    "m11_chosen_bins",
    f"WITH sc AS MATERIALIZED ({SCORES_SQL}), ch AS MATERIALIZED (SELECT {_TK}, {_tier_sql()} AS model_assessment FROM ({_BEST_SQL})) SELECT * FROM ({reliability_sql(f'(SELECT sc.*, ch.model_assessment FROM sc JOIN ch USING ({_TK}))', _TK + ', model_assessment,')})",
    "bets",
    "probability_floor probability_ceiling pct_win mean_prediction",
)
def m11(spark, d):
    best = staged(chosen(spark, d).withColumn("model_assessment", S.tier()), "chosen")
    return S.chosen_bins(best, scores(spark, d))


@query(
    "m12_conflicting_choices",
    f"WITH sc AS (SELECT DISTINCT response_var, model_type, extra_calibration FROM ({SCORES_SQL}) WHERE p > 0.97) SELECT response_var, count(*) AS choices FROM sc GROUP BY response_var HAVING count(*) > 1",
    "bets",
)
def m12_conflicts(spark, d):
    return M.conflicting_choices(scores(spark, d).where("p > 0.97"))


@query(
    "m12_conflicting_choices_all",
    f"SELECT response_var, count(*) AS choices FROM (SELECT DISTINCT response_var, model_type, extra_calibration FROM ({SCORES_SQL})) GROUP BY response_var HAVING count(*) > 1",
    "bets",
)
def m12_conflicts_all(spark, d):
    """As above, over the whole range of scores."""
    return M.conflicting_choices(scores(spark, d))


# The reference's thresholds, each on the panel's measure that stands for it; spreads and the two
# single targets have none there
FAMILIES = {
    "passing": ("yards", [150, 180, 210, 240, 270, 300, 330, 360]), "receiving": ("yards", [25, 40, 60, 80, 100, 120, 140]),
    "rushing_receiving": ("yards", [40, 70, 100, 130]), "rushing": ("air", [25, 40, 60, 80, 100, 120, 140]), "receptions": ("touches", [4, 6, 8, 10]),
}
TARGETS = {f"{family}_{n}": (family, measure, n) for family, (measure, numbers) in FAMILIES.items() for n in numbers}


def _target_rows(spark, d):
    """Per target its rows and labels, each read off one narrow table: no target reads the rows of another."""
    rows = staged(D.panel(spark, d).select(
        "entity", "season", "week", "position", "touches", "urgent", "yards", "air",
        F.lag("yards").over(W.Window.partitionBy("entity").orderBy("season", "week")).alias("yards_lag1"),
        F.avg("yards").over(W.prior(["entity"], ["season", "week"])).alias("avg_yards"),
    ), "targets")
    kept = [*KEYS, "position", *[c for c in NUMERIC if c not in KEYS]]
    return {
        target: X.threshold_targets(rows.withColumn("_measure", F.col(measure)), kept, "_measure", [n], family).withColumn("label", F.col("label").cast("double"))
        for target, (family, measure, n) in TARGETS.items()
    }


def _refit(spark, d):
    """A saved model per target.  Targets of one measure have the same rows, so what prepares them is fitted once."""
    rows = _target_rows(spark, d)
    known = {target: part.where("label IS NOT NULL") for target, part in rows.items()}
    *steps, model = _plain_model().getStages()
    ready = {}
    for target, (_, measure, _) in TARGETS.items():
        if measure not in ready:
            ready[measure] = Pipeline(stages=steps).fit(known[target])
    paths = {target: scratch_path(spark, target) for target in TARGETS}
    M.fit_targets(known, {target: ready[measure] for target, (_, measure, _) in TARGETS.items()}, model, paths)
    return rows, known, paths


@query("m12_refit_on_all_rows")
def m12(spark, d):
    _, known, paths = _refit(spark, d)
    scored = M.score_targets(known, paths, [*KEYS, "label"])
    return scored.groupBy("response_var").agg(
        F.avg(A.log_loss("model_probability", F.col("label") == 1.0)).alias("training_log_loss"), F.count("*").alias("n")
    )


@query("m13_batch_scoring")
def m13(spark, d):
    rows, _, paths = _refit(spark, d)
    return M.score_targets({target: part.drop("label") for target, part in rows.items()}, paths, KEYS)


# --- models as rows: all forty targets in one table of weights ------------------------------


def _codes(root, numbers):
    return [(f"{root}_{D._code(n)}", n) for n in numbers]


PLAYER_CODES = {
    "yards": _codes("passing_yards", D.PASSING_LADDER) + _codes("receiving_yards", D.YARD_LADDER) + _codes("rushing_receiving_yards", D.COMBINED_LADDER),
    "air": _codes("rushing_yards", D.YARD_LADDER), "count": _codes("receptions", D.RECEPTION_LADDER), "urgent": [("anytime_td_scorer", 1)],
}
TEAM_CODES = {"differential": _codes("team_differential", D.SPREAD_LADDER) + [("team_win", 0.5)]}
KNOWN_BEFORE = ["week", "lag_yards", "avg_yards", "avg_count", "avg_urgent"]
EVIDENCE = ["position", "phase", "form"]


def _targets_of(codes):
    return F.array(*[F.lit(code) for rungs in codes.values() for code, _ in rungs])


def _sides(spark, d):
    """Players and teams in one shape: what is known before the game, and the measures that become labels."""
    players = D.panel(spark, d).select(
        F.concat(F.lit("P"), "entity").alias("label"), "season", "week", "position", "yards", "air", F.col("touches").alias("count"), "urgent",
        F.lit(None).cast("bigint").alias("differential"),
    )
    own = D.teams(spark, d)
    facing = own.select("season", "week", F.col("team").alias("opponent"), F.col("score").alias("allowed"))
    sides = own.join(facing, ["season", "week", "opponent"], "left").select(
        F.concat(F.lit("T"), "team").alias("label"), "season", "week", F.lit("team").alias("position"), "yards", "air", F.col("plays").alias("count"), "urgent",
        F.when(F.col("team") != F.col("opponent"), F.col("score") - F.col("allowed")).alias("differential"),
    )
    earlier = W.prior(["label"], ["season", "week"])
    before = players.unionByName(sides).select(
        "*", F.lag("yards").over(W.Window.partitionBy("label").orderBy("season", "week")).alias("lag_yards"),
        *[F.avg(c).over(earlier).alias(f"avg_{c}") for c in ("yards", "count", "urgent")],
    )
    phase = F.expr("CASE WHEN week < 4 THEN 'early' WHEN week < 16 THEN 'mid' WHEN week < 19 THEN 'late' ELSE 'after' END")
    form = F.expr("CASE WHEN lag_yards >= avg_yards THEN 'above' WHEN lag_yards < avg_yards THEN 'below' END")
    return before.withColumns({"phase": phase, "form": form})


def _labelled(sides):
    """The labels and targets of each side, as arrays made where they are read: a row on storage holds its measures only."""
    is_team = F.col("position") == "team"
    return sides.withColumns({
        "labels": F.when(is_team, L.label_list(TEAM_CODES)).otherwise(L.label_list(PLAYER_CODES)),
        "targets": F.when(is_team, _targets_of(TEAM_CODES)).otherwise(_targets_of(PLAYER_CODES)),
    })


SIDE_KEYS = ["label", "season", "week"]


MEASURES = list({**PLAYER_CODES, **TEAM_CODES})


def _fitted(spark, d):
    kept = _labelled(staged(_sides(spark, d).select(*SIDE_KEYS, "position", *[c for c in KNOWN_BEFORE if c not in SIDE_KEYS], *MEASURES), "sides"))
    design = L.fit_design(kept, KNOWN_BEFORE, ["position"])
    rows = kept.select(*SIDE_KEYS, design.vector().alias("features"), "labels", "targets")
    return rows, design, L.fit_targets(rows, design)


_SIDES_SQL = (
    "SELECT *, lag(yards) OVER (PARTITION BY label ORDER BY season, week) AS lag_yards, avg(yards) OVER (PARTITION BY label ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS avg_yards FROM ("
    "SELECT 'P' || entity AS label, season, week, position, yards, air, touches AS n_count, urgent, NULL::BIGINT AS differential FROM panel UNION ALL "
    "SELECT 'T' || t.team, t.season, t.week, 'team', t.yards, t.air, t.plays, t.urgent, CASE WHEN t.team <> t.opponent THEN t.score - o.score END FROM teams t LEFT JOIN teams o ON o.season = t.season AND o.week = t.week AND o.team = t.opponent)"
)
_TARGETS_SQL = "(VALUES " + ", ".join(
    f"({str(team).upper()}, '{measure}', '{code}', {float(least)}::DOUBLE)"
    for team, codes in ((False, PLAYER_CODES), (True, TEAM_CODES)) for measure, rungs in codes.items() for code, least in rungs
) + ") g(for_team, measure, response_var, least)"
_VALUE_SQL = "CASE g.measure WHEN 'yards' THEN s.yards WHEN 'air' THEN s.air WHEN 'count' THEN s.n_count WHEN 'urgent' THEN s.urgent ELSE s.differential END"
_LABELLED_SQL = (
    f"SELECT s.label, s.season, s.week, s.position, s.lag_yards, s.avg_yards, g.response_var, {_VALUE_SQL} >= g.least AS hit "
    f"FROM ({_SIDES_SQL}) s JOIN {_TARGETS_SQL} ON (s.position = 'team') = g.for_team"
)


@query(
    "m12_refit_forty_targets",
    f"SELECT response_var, count(*) AS n, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS expected_hits FROM ({_LABELLED_SQL}) WHERE hit IS NOT NULL "
    "GROUP BY response_var HAVING count(*) FILTER (WHERE hit) BETWEEN 1 AND count(*) - 1",
    "panel teams",
    "expected_hits",
    digits=3,
)
def m12_forty(spark, d):
    """All targets refitted on all rows: at the optimum the expected successes of a target are those observed."""
    rows, design, weights = _fitted(spark, d)
    scored = L.score_rows(rows.dropna(subset=SIDE_KEYS), weights, design, [], "labels")
    return scored.groupBy("response_var").agg(
        F.count("*").alias("n"), F.sum("label").cast("bigint").alias("hits"), F.sum("model_probability").alias("expected_hits")
    ).where("hits > 0 AND hits < n")


@query("m13_scores_forty_targets")
def m13_forty(spark, d):
    rows, design, weights = _fitted(spark, d)
    return L.score_rows(rows, weights, design, SIDE_KEYS)


_LEVELS_SQL = (
    "SELECT *, CASE WHEN week < 4 THEN 'early' WHEN week < 16 THEN 'mid' WHEN week < 19 THEN 'late' ELSE 'after' END AS phase, "
    f"CASE WHEN lag_yards >= avg_yards THEN 'above' WHEN lag_yards < avg_yards THEN 'below' ELSE 'missing' END AS form FROM ({_LABELLED_SQL})"
)
_EVIDENCE_SQL = (
    f"r AS MATERIALIZED ({_LEVELS_SQL}), o AS (SELECT response_var, feature, ln((count(*) FILTER (WHERE hit) + 0.5::DOUBLE) / (count(*) FILTER (WHERE NOT hit) + 0.5::DOUBLE)) AS odds FROM ("
    "SELECT response_var, hit, '(intercept)' AS feature FROM r UNION ALL "
    + " UNION ALL ".join(f"SELECT response_var, hit, '{c}=' || {c} FROM r" for c in EVIDENCE)
    + ") WHERE hit IS NOT NULL GROUP BY ALL), "
    "wt AS MATERIALIZED (SELECT o.response_var, o.feature, CASE WHEN o.feature = '(intercept)' THEN o.odds ELSE o.odds - b.odds END AS weight FROM o JOIN o b ON b.response_var = o.response_var AND b.feature = '(intercept)')"
)


def _evidence(spark, d):
    rows = _labelled(staged(_sides(spark, d).select(*SIDE_KEYS, *EVIDENCE, *MEASURES), "evidence"))
    return rows, L.evidence_weights(rows, EVIDENCE)


@query("m13_evidence_weights", f"WITH {_EVIDENCE_SQL} SELECT * FROM wt", "panel teams", "weight")
def m13_weights(spark, d):
    return _evidence(spark, d)[1]


@query(
    "m13_evidence_scores",
    f"WITH {_EVIDENCE_SQL} SELECT r.label, r.season, r.week, r.response_var, 1 / (1 + exp(-(i.weight + "
    + " + ".join(f"coalesce({c[:2]}.weight, 0)" for c in EVIDENCE)
    + "))) AS model_probability FROM r JOIN wt i ON i.response_var = r.response_var AND i.feature = '(intercept)' "
    + " ".join(f"LEFT JOIN wt {c[:2]} ON {c[:2]}.response_var = r.response_var AND {c[:2]}.feature = '{c}=' || r.{c}" for c in EVIDENCE),
    "panel teams",
    "model_probability",
)
def m13_evidence(spark, d):
    rows, weights = _evidence(spark, d)
    design = L.fit_design(rows, [], EVIDENCE)
    return L.score_rows(rows.withColumn("features", design.vector()), weights, design, SIDE_KEYS)


def _boosted(rows):
    stages = [*Q.feature_stages(NUMERIC, CATEGORICAL, missing=-999.0), GBTClassifier(labelCol="label", seed=1)]
    return Pipeline(stages=stages).fit(rows)


@query("m14_feature_importance")
def m14(spark, d):
    rows = Q.tree_input(training_rows(spark, d), NUMERIC)
    model = _boosted(rows.where("split = 'train'"))
    ranked = [(i + 1, n, w) for i, (n, w) in enumerate(M.importance_table(model, rows)[:20])]
    return spark.createDataFrame(ranked, "rank int, feature string, importance double")


@query("m14_permutation_importance")
def m14_permutation(spark, d):
    rows = Q.tree_input(training_rows(spark, d), NUMERIC)
    model = _boosted(rows.where("split = 'train'"))
    return M.permutation_importance(model, rows.where("split = 'validation'"), [*NUMERIC, *CATEGORICAL], KEYS)
