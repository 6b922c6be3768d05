"""Feature queries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import aggregates as A
from ..operators import contributors as K
from ..operators import features as X
from ..operators import joins as J
from ..operators import schema as P
from ..operators import sets as U
from ..operators import windows as W
from ..operators.quantiles import exact_percentiles
from ..sources.tables import staged
from . import domain as D
from .registry import query
from .windows import week_bounds

CAREER = ["season", "week"]


def _tail_sql(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(CASE WHEN {z} >= 0 THEN exp(-({z}) * ({z}) / 2.0) / 2.5066282746310002 * {poly} ELSE 1.0 - exp(-({z}) * ({z}) / 2.0) / 2.5066282746310002 * {poly} END)"


# chance of each U for sides of up to 49 rows: the largest row lies in the first side with odds n1 : n2
_EXACT = (
    "cnt(n1, n2, u, p) AS (SELECT 0, 0, 0, 1.0::DOUBLE UNION ALL SELECT n1, n2, u, sum(p) FROM ("
    "SELECT n1 + 1 AS n1, n2, u + n2 AS u, p * (n1 + 1) / (n1 + 1 + n2) AS p FROM cnt WHERE n1 < 49 "
    "UNION ALL SELECT n1, n2 + 1, u, p * (n2 + 1) / (n1 + n2 + 1) FROM cnt WHERE n2 < 49) GROUP BY n1, n2, u), "
    "tail AS MATERIALIZED (SELECT n1, n2, u, sum(p) OVER (PARTITION BY n1, n2 ORDER BY u DESC) AS p FROM cnt)"
)


_HIST = "SELECT i.entity, i.t, j.x, j.g FROM r i JOIN r j ON j.entity = i.entity AND j.t < i.t"


@query(
    "d1_played_or_not_test",
    f"WITH RECURSIVE {_EXACT}, r AS MATERIALIZED (SELECT p.entity, p.season, p.week, p.season * 53 + p.week AS t, tm.yards AS x, p.urgent = 0 AS g FROM panel p JOIN teams tm ON tm.season = p.season AND tm.week = p.week AND tm.team = p.team), "
    f"h AS MATERIALIZED ({_HIST}), n AS (SELECT entity, t, count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2 FROM h GROUP BY ALL), "
    "u AS (SELECT a.entity, a.t, sum(CASE WHEN a.x > b.x THEN 1.0::DOUBLE WHEN a.x = b.x THEN 0.5 ELSE 0 END) AS u FROM h a JOIN h b ON a.entity = b.entity AND a.t = b.t AND a.g AND NOT b.g GROUP BY ALL), "
    "ties AS (SELECT entity, t, CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT entity, t, x, count(*) AS c FROM h GROUP BY ALL) GROUP BY ALL) "
    f"SELECT entity, season, week, s.u, s.n1, s.n2, z, coalesce(tail.p, {_tail_sql('z')}) AS p_value FROM (SELECT r.entity, r.season, r.week, coalesce(ties, 0) AS ties, CASE WHEN n1 > 1 AND n2 > 1 THEN u END AS u, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, "
    "CASE WHEN n1 > 1 AND n2 > 1 THEN (u - n1 * n2 / 2.0::DOUBLE - 0.5) / nullif(sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) END AS z "
    "FROM r LEFT JOIN n ON n.entity = r.entity AND n.t = r.t LEFT JOIN u ON u.entity = r.entity AND u.t = r.t LEFT JOIN ties ON ties.entity = r.entity AND ties.t = r.t) s "
    "LEFT JOIN tail ON tail.n1 = s.n1 AND tail.n2 = s.n2 AND tail.u = s.u AND s.ties = 0",
    "panel teams",
    "u z p_value",
)
def d1(spark, d):
    totals = D.teams(spark, d).select("season", "week", "team", F.col("yards").alias("team_yards"))
    rows = D.panel(spark, d).join(totals, ["season", "week", "team"]).withColumn("played", F.col("urgent") == 0)
    out = X.played_or_not_test(rows.select("entity", "season", "week", "team_yards", "played"), ["entity"], CAREER, "team_yards", "played")
    return out.select("entity", "season", "week", "u", "n1", "n2", "z", "p_value")


@query(
    "d2_former_groups_test",
    f"WITH RECURSIVE {_EXACT}, r AS MATERIALIZED (SELECT entity, season, week, season * 53 + week AS t, yards AS x, season // 3 AS k FROM panel), h AS MATERIALIZED (SELECT i.entity, i.t, j.t AS tj, j.x, j.k FROM r i JOIN r j ON j.entity = i.entity AND j.t < i.t), "
    "f AS (SELECT entity, t, k, min(tj) AS seen, count(*) AS n FROM h GROUP BY ALL), pr AS (SELECT a.entity, a.t, a.k AS ka, b.k AS kb, a.n AS n1, b.n AS n2 FROM f a JOIN f b ON a.entity = b.entity AND a.t = b.t AND a.seen < b.seen WHERE a.n > 1 AND b.n > 1), "
    "u AS (SELECT pr.entity, pr.t, ka, kb, any_value(n1) AS n1, any_value(n2) AS n2, sum(CASE WHEN a.x > b.x THEN 1.0::DOUBLE WHEN a.x = b.x THEN 0.5 ELSE 0 END) AS u FROM pr JOIN h a ON a.entity = pr.entity AND a.t = pr.t AND a.k = ka JOIN h b ON b.entity = pr.entity AND b.t = pr.t AND b.k = kb GROUP BY ALL), "
    "ti AS (SELECT entity, t, ka, kb, CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT pr.entity, pr.t, ka, kb, h.x, count(*) AS c FROM pr JOIN h ON h.entity = pr.entity AND h.t = pr.t AND (h.k = ka OR h.k = kb) GROUP BY ALL) GROUP BY ALL) "
    f"SELECT entity, season, week, min(coalesce(tail.p, {_tail_sql('z')})) AS changing_groups_p, max(z) AS largest_z, count(*) AS pairs_tested FROM (SELECT u.entity, r.season, r.week, n1, n2, u, ties, (u - n1 * n2 / 2.0::DOUBLE - 0.5) / nullif(sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z "
    "FROM u JOIN ti USING (entity, t, ka, kb) JOIN r ON r.entity = u.entity AND r.t = u.t) s LEFT JOIN tail ON tail.n1 = s.n1 AND tail.n2 = s.n2 AND tail.u = s.u AND s.ties = 0 WHERE z IS NOT NULL GROUP BY entity, season, week",
    "panel",
    "changing_groups_p largest_z",
)
def d2(spark, d):
    df = D.panel(spark, d).select("entity", "season", "week", "yards", F.expr("season div 3").alias("spell"))
    return X.former_groups_test(df, "entity", CAREER, "spell", "yards")


_SEASONS_SQL = "SELECT entity, season, avg(yards) AS m, count(*) AS g FROM panel GROUP BY entity, season"
_THREE_SQL = (
    f"SELECT p.entity, p.season, p.week, CASE WHEN l.g > 0 AND b.g > 0 THEN (CASE WHEN p.games > 0 THEN p.now * p.games ELSE 0 END + l.m * l.g + b.m * b.g) / (p.games + l.g + b.g) END AS metric FROM ("
    "SELECT entity, season, week, avg(yards) OVER (PARTITION BY entity, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now, row_number() OVER (PARTITION BY entity, season ORDER BY week) - 1 AS games FROM panel) p "
    f"LEFT JOIN ({_SEASONS_SQL}) l ON l.entity = p.entity AND l.season = p.season - 1 LEFT JOIN ({_SEASONS_SQL}) b ON b.entity = p.entity AND b.season = p.season - 2"
)


def three_seasons(spark, d):
    panel = D.panel(spark, d).select("entity", "season", "week", "yards")
    seasons = panel.groupBy("entity", "season").agg(F.avg("yards").alias("m"), F.count("*").alias("g"))
    now = panel.select(
        "entity", "season", "week", F.avg("yards").over(W.prior(["entity", "season"], ["week"])).alias("now"), W.ordinal(["entity", "season"], ["week"]).alias("games")
    )
    for back, tag in ((1, "l"), (2, "b")):
        earlier = seasons.select("entity", (F.col("season") + back).alias("season"), F.col("m").alias(f"{tag}_m"), F.col("g").alias(f"{tag}_g"))
        now = now.join(earlier, ["entity", "season"], "left")
    return now.select("entity", "season", "week", X.weighted_three_seasons("now", "games", "l_m", "l_g", "b_m", "b_g").alias("metric"))


@query(
    "d3_weighted_three_seasons",
    f"SELECT entity, season, week, last_value(metric IGNORE NULLS) OVER (PARTITION BY entity ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS metric FROM ({_THREE_SQL})",
    "panel",
    "metric",
)
def d3(spark, d):
    return three_seasons(spark, d).withColumn("metric", W.fill_down("metric", ["entity"], CAREER))


_D4_SRC = f"SELECT *, CASE WHEN (entity + week) % 5 = 0 THEN NULL ELSE ((entity * 37 + week * 11) % 100) / CAST(100.0 AS DOUBLE) END AS p_play, CASE WHEN (entity + week) % 3 = 0 THEN NULL ELSE ((entity * 53 + week * 7) % 100) / CAST(100.0 AS DOUBLE) END AS p_move, ((entity * 11 + week) % 60) / CAST(100.0 AS DOUBLE) AS share FROM ({_THREE_SQL})"


def _verdict_sql(alpha: str, share: str | None) -> str:
    low_share = f"WHEN share < {share} THEN FALSE " if share else ""
    return f"CASE WHEN metric IS NULL THEN FALSE WHEN metric < q66 THEN FALSE WHEN p_play > {alpha} THEN FALSE WHEN p_move < {alpha} THEN FALSE {low_share}WHEN p_play IS NULL AND metric < q80 THEN FALSE ELSE TRUE END"


@query(
    "d4_contributor_verdict",
    f"WITH s AS MATERIALIZED ({_D4_SRC}) SELECT entity, season, week, {_verdict_sql('0.1', None)} AS passing, {_verdict_sql('0.15', '0.4')} AS rushing, {_verdict_sql('0.15', '0.2')} AS receiving FROM s, (SELECT quantile_cont(metric, 0.66) AS q66, quantile_cont(metric, 0.8) AS q80 FROM s)",
    "panel",
)
def d4(spark, d):
    e, w = F.col("entity"), F.col("week")
    rows = three_seasons(spark, d).select(
        "*",
        F.when((e + w) % 5 != 0, (e * 37 + w * 11) % 100 / F.lit(100.0)).alias("p_play"),
        F.when((e + w) % 3 != 0, (e * 53 + w * 7) % 100 / F.lit(100.0)).alias("p_move"),
        ((e * 11 + w) % 60 / F.lit(100.0)).alias("share"),
    )
    low, high = exact_percentiles(rows, ["metric"], [0.66, 0.8])["metric"]

    def verdict(share, alpha, least):
        return X.contributor_verdict("metric", "p_play", "p_move", share, low, high, alpha, least)

    return rows.select(
        "entity", "season", "week", verdict(None, 0.1, None).alias("passing"),
        verdict("share", 0.15, 0.4).alias("rushing"), verdict("share", 0.15, 0.2).alias("receiving"),
    )


# family: positions, own measure, side and measure of the group's result; the panel has no defenders, offensive positions stand for them
_FAMILY_ROWS = {
    "passing": (("QB",), "yards", "own", "yards"), "rushing": (("RB",), "air", "own", "air"), "receiving": (("WR", "TE"), "yards", "own", "yards"),
    "pass_rushers": (("RB", "TE"), "urgent", "own", "urgent"), "rush_tackles": (("RB", "WR", "TE"), "touches", "other", "air"),
    "secondary": (("QB", "WR"), "touches", "other", "yards"),
}
_MEASURES = ("yards", "air", "touches", "urgent")


def family_rows(spark, d):
    """Long rows of all families: one per family, player and week."""
    rows = D.panel(spark, d)
    # sums of a team and week are few; written down, their size is known before the players are joined to them
    totals = staged(rows.groupBy("season", "week", "team").agg(*[F.sum(c).alias(f"all_{c}") for c in _MEASURES]), "totals")
    sides = staged(D.teams(spark, d).select("season", "week", "team", "yards", "air", "urgent"), "sides")
    own = sides.select("season", "week", "team", F.struct("yards", "air", "urgent").alias("own"))
    other = sides.select("season", "week", F.col("team").alias("opponent"), F.struct("yards", "air", "urgent").alias("other"))
    full = rows.join(totals, ["season", "week", "team"]).join(own, ["season", "week", "team"], "left").join(other, ["season", "week", "opponent"], "left")
    full = full.repartition("entity")  # a career's windows need no other shuffle, and players move before they are copied per family
    each = F.array(*[
        F.struct(
            F.lit(name).alias("family"), F.col("position").isin(*positions).alias("member"), F.col(own_measure).cast("double").alias("metric"),
            F.col(f"{side}.{measure}").cast("double").alias("group_metric"), F.try_divide(own_measure, f"all_{own_measure}").alias("part"),
        )
        for name, (positions, own_measure, side, measure) in _FAMILY_ROWS.items()
    ])
    long = full.select("entity", "season", "week", "team", F.explode(F.filter(each, lambda f: f["member"])).alias("f")).select("entity", "season", "week", "team", "f.*")
    return long.withColumn("share", F.avg("part").over(W.prior(["entity", "family", "season"], ["week"]))).drop("member", "part")


def _family_sql() -> str:
    totals = ", ".join(f"sum({c}) OVER (PARTITION BY season, week, team) AS all_{c}" for c in _MEASURES)
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS family, p.entity, p.season, p.week, p.team, CAST(p.{own} AS DOUBLE) AS m, CAST({side}.{measure} AS DOUBLE) AS x, p.{own} / CAST(nullif(p.all_{own}, 0) AS DOUBLE) AS part FROM (SELECT *, {totals} FROM panel) p "
        "LEFT JOIN teams own ON own.season = p.season AND own.week = p.week AND own.team = p.team LEFT JOIN teams other ON other.season = p.season AND other.week = p.week AND other.team = p.opponent "
        f"WHERE p.position IN ({', '.join(repr(q) for q in positions)})"
        for name, (positions, own, side, measure) in _FAMILY_ROWS.items()
    )
    before = "OVER (PARTITION BY family, entity, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    less = ", ".join(repr(f.name) for f in K.FAMILIES if f.side == "less")
    z = "(u - n1 * n2 / 2.0::DOUBLE - CASE WHEN less THEN -0.5 ELSE 0.5 END) / nullif(sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0)"
    limits = ", ".join(f"('{f.name}', {f.alpha}::DOUBLE, {'NULL' if f.min_share is None else f.min_share}::DOUBLE)" for f in K.FAMILIES)
    verdict = "CASE WHEN three IS NULL THEN FALSE WHEN three < q66 THEN FALSE WHEN p_play > alpha THEN FALSE WHEN p_move < alpha THEN FALSE WHEN share < least THEN FALSE WHEN p_play IS NULL AND three < q80 THEN FALSE ELSE TRUE END"
    flags = ", ".join(f"coalesce(bool_or(verdict) FILTER (WHERE family = '{f.name}'), FALSE) AS {f.name}" for f in K.FAMILIES)
    return (
        f"WITH RECURSIVE {_EXACT}, f AS MATERIALIZED (SELECT *, season * 53 + week AS t, avg(m) {before} AS now, avg(part) {before} AS share, row_number() OVER (PARTITION BY family, entity, season ORDER BY week) - 1 AS games, family IN ({less}) AS less FROM ({parts})), "
        "y AS (SELECT family, entity, season, avg(m) AS m, count(*) AS g FROM f GROUP BY ALL), "
        "h3 AS (SELECT f.*, CASE WHEN l.g > 0 AND b.g > 0 THEN (CASE WHEN games > 0 THEN now * games ELSE 0 END + l.m * l.g + b.m * b.g) / (games + l.g + b.g) END AS raw FROM f "
        "LEFT JOIN y l ON l.family = f.family AND l.entity = f.entity AND l.season = f.season - 1 LEFT JOIN y b ON b.family = f.family AND b.entity = f.entity AND b.season = f.season - 2), "
        "three AS MATERIALIZED (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY family, entity, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS three FROM h3), "
        # with and without the entity; the results without are the first side
        "h AS MATERIALIZED (SELECT i.family, i.entity, i.t, i.less, j.x, j.now IS NULL AS a FROM f i JOIN f j ON j.family = i.family AND j.entity = i.entity AND j.t < i.t WHERE i.x IS NOT NULL AND j.x IS NOT NULL), "
        "n AS (SELECT family, entity, t, any_value(less) AS less, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2 FROM h GROUP BY family, entity, t), "
        "u AS (SELECT p.family, p.entity, p.t, sum(CASE WHEN p.x > q.x THEN 1.0::DOUBLE WHEN p.x = q.x THEN 0.5 ELSE 0 END) AS u FROM h p JOIN h q ON p.family = q.family AND p.entity = q.entity AND p.t = q.t AND p.a AND NOT q.a GROUP BY ALL), "
        "ti AS (SELECT family, entity, t, CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT family, entity, t, x, count(*) AS c FROM h GROUP BY ALL) GROUP BY ALL), "
        f"s AS (SELECT family, entity, t, less, n1, n2, u, ties, {z} AS z FROM n JOIN u USING (family, entity, t) JOIN ti USING (family, entity, t) WHERE n1 > 1 AND n2 > 1), "
        f"pp AS (SELECT family, entity, s.t, round(coalesce(tail.p, CASE WHEN less THEN 1 - {_tail_sql('z')} ELSE {_tail_sql('z')} END), 12) AS p_play FROM s "
        "LEFT JOIN tail ON tail.n1 = s.n1 AND tail.n2 = s.n2 AND tail.u = CASE WHEN less THEN s.n1 * s.n2 - s.u ELSE s.u END AND s.ties = 0), "
        # every pair of earlier teams, in the order in which they were met
        "g AS MATERIALIZED (SELECT i.family, i.entity, i.t, j.t AS tj, j.m AS x, j.team AS k FROM f i JOIN f j ON j.family = i.family AND j.entity = i.entity AND j.t < i.t WHERE i.m IS NOT NULL AND j.m IS NOT NULL), "
        "gs AS (SELECT family, entity, t, k, min(tj) AS seen, count(*) AS n FROM g GROUP BY ALL), "
        "pr AS (SELECT c.family, c.entity, c.t, c.k AS ka, e.k AS kb, c.n AS n1, e.n AS n2 FROM gs c JOIN gs e ON c.family = e.family AND c.entity = e.entity AND c.t = e.t AND c.seen < e.seen WHERE c.n > 1 AND e.n > 1), "
        "gu AS (SELECT pr.family, pr.entity, pr.t, ka, kb, any_value(n1) AS n1, any_value(n2) AS n2, sum(CASE WHEN c.x > e.x THEN 1.0::DOUBLE WHEN c.x = e.x THEN 0.5 ELSE 0 END) AS u FROM pr "
        "JOIN g c ON c.family = pr.family AND c.entity = pr.entity AND c.t = pr.t AND c.k = ka JOIN g e ON e.family = pr.family AND e.entity = pr.entity AND e.t = pr.t AND e.k = kb GROUP BY pr.family, pr.entity, pr.t, ka, kb), "
        "gt AS (SELECT family, entity, t, ka, kb, CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT pr.family, pr.entity, pr.t, ka, kb, g.x, count(*) AS c FROM pr JOIN g ON g.family = pr.family AND g.entity = pr.entity AND g.t = pr.t AND (g.k = ka OR g.k = kb) GROUP BY ALL) GROUP BY ALL), "
        f"gz AS (SELECT family, entity, t, n1, n2, u, ties, {z} AS z FROM (SELECT *, FALSE AS less FROM gu JOIN gt USING (family, entity, t, ka, kb))), "
        f"mv AS (SELECT family, entity, gz.t, round(min(coalesce(tail.p, {_tail_sql('z')})), 12) AS p_move FROM gz LEFT JOIN tail ON tail.n1 = gz.n1 AND tail.n2 = gz.n2 AND tail.u = gz.u AND gz.ties = 0 WHERE z IS NOT NULL GROUP BY family, entity, gz.t), "
        "q AS (SELECT family, quantile_cont(three, 0.66) AS q66, quantile_cont(three, 0.8) AS q80 FROM three GROUP BY family), "
        f"v AS (SELECT family, three.entity, season, week, team, {verdict.replace('share <', 'round(share, 12) <')} AS verdict FROM three JOIN q USING (family) JOIN (VALUES {limits}) l(family, alpha, least) USING (family) "
        "LEFT JOIN pp USING (family, entity, t) LEFT JOIN mv USING (family, entity, t) WHERE season >= (SELECT min(season) + 2 FROM panel)) "
        f"SELECT entity, season, week, team, {flags} FROM v GROUP BY entity, season, week, team"
    )


@query("d4_contributor_families", _family_sql(), "panel teams")
def d4_families(spark, d):
    return K.contributor_verdicts(family_rows(spark, d))


_INJ_SQL = (
    "SELECT entity, season, week, illness, personal AS out_not_injury_related, less_practice, coalesce(status = 'Out' OR inactive, FALSE) AS out FROM ("
    "SELECT entity, season, week, injury LIKE '%illness%' AS illness, injury LIKE '%personal%' AS personal, practice <> 'Full Participation in Practice' AS less_practice, status FROM ("
    "SELECT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS season, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS BIGINT) AS week, arg_min(CASE o_orderpriority WHEN '1-URGENT' THEN 'illness' WHEN '2-HIGH' THEN 'personal' ELSE 'knee' END, o_orderkey) AS injury, "
    "arg_min(CASE WHEN o_orderstatus = 'F' THEN 'Full Participation in Practice' ELSE 'Limited Participation in Practice' END, o_orderkey) AS practice, arg_min(CASE WHEN o_orderstatus = 'O' THEN 'Out' ELSE 'Questionable' END, o_orderkey) AS status FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3)) "
    "FULL JOIN (SELECT DISTINCT entity, season, week, TRUE AS inactive FROM panel WHERE urgent > 0) USING (entity, season, week)"
)


def injuries(spark, d):
    reports = D.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_custkey").alias("entity"), *D.period_columns("o_orderdate"), "o_orderkey",
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'Illness' WHEN '2-HIGH' THEN 'Personal' ELSE 'Knee' END").alias("injury"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 'Full Participation in Practice' ELSE 'Limited Participation in Practice' END").alias("practice"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN 'Out' ELSE 'Questionable' END").alias("status"),
    )
    inactive = D.panel(spark, d).where("urgent > 0").select("entity", "season", "week")
    return X.availability(reports, inactive, ["entity", "season", "week"], "o_orderkey")


@query("d5_availability", _INJ_SQL, "panel")
def d5(spark, d):
    return injuries(spark, d)


@query(
    "d5_contributors_out",
    f"SELECT p.season, p.week, p.team, bool_or(coalesce(i.out, FALSE) AND p.yards > 300) AS has_star_out, bool_or(coalesce(i.out, FALSE) AND p.touches > 1) AS has_regular_out FROM panel p LEFT JOIN ({_INJ_SQL}) i USING (entity, season, week) GROUP BY p.season, p.week, p.team",
    "panel",
)
def d5_out(spark, d):
    flags = D.panel(spark, d).select("entity", "season", "week", "team", (F.col("yards") > 300).alias("star"), (F.col("touches") > 1).alias("regular"))
    return X.contributors_out(flags, injuries(spark, d), ["entity", "season", "week"], ["season", "week", "team"], ["star", "regular"])


_TALENT_SQL = (
    "WITH s AS MATERIALIZED (SELECT entity, season, week, team, position, urgent > 1 AS out, yards / nullif(sum(yards) OVER (PARTITION BY season, week, team), 0) AS share FROM panel), "
    "y AS (SELECT entity, season, avg(share) AS m FROM s GROUP BY ALL), pr AS (SELECT position, avg(share) AS newcomer FROM s GROUP BY ALL), "
    "c AS (SELECT s.*, avg(share) OVER (PARTITION BY entity, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur, CASE WHEN count(*) OVER (PARTITION BY entity ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN avg(share) OVER (PARTITION BY entity ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS recent, "
    "row_number() OVER (PARTITION BY entity, season ORDER BY week) - 1 AS games, row_number() OVER (PARTITION BY entity ORDER BY season, week) - 1 AS career FROM s), "
    "t AS (SELECT c.*, CASE WHEN games > 5 THEN cur WHEN games > 0 AND career > games THEN games / 6.0::DOUBLE * cur + (1 - games / 6.0::DOUBLE) * coalesce(l.m, b.m, newcomer) WHEN career > games THEN coalesce(l.m, b.m, newcomer) WHEN games > 0 THEN games / 6.0::DOUBLE * cur + (1 - games / 6.0::DOUBLE) * newcomer ELSE newcomer END AS talent "
    "FROM c JOIN pr USING (position) LEFT JOIN y l ON l.entity = c.entity AND l.season = c.season - 1 LEFT JOIN y b ON b.entity = c.entity AND b.season = c.season - 2) "
    "SELECT entity, season, week, talent, talent / nullif(tot, 0) AS adjusted_share, talent / nullif(tot, 0) - talent AS delta_adjusted_share, CASE WHEN games = 0 THEN 0.0 ELSE recent - talent END AS recent_form_delta FROM (SELECT *, sum(talent) OVER (PARTITION BY season, week, team) AS tot FROM t WHERE NOT out)"
)


@query("d6_talent_shares", _TALENT_SQL, "panel", "talent adjusted_share delta_adjusted_share recent_form_delta", digits=10)
def d6(spark, d):
    shares = W.share_of_group(D.panel(spark, d), ["season", "week", "team"], "yards", "share")
    rows = staged(shares.select("entity", "season", "week", "team", "position", (F.col("urgent") > 1).alias("out"), "share"), "shares")
    recent = W.prior(["entity"], CAREER, 3)
    now = rows.select(
        "*", F.avg("share").over(W.prior(["entity", "season"], ["week"])).alias("cur"),
        F.when(F.count(F.lit(1)).over(recent) == 3, F.avg("share").over(recent)).alias("recent"),
        W.ordinal(["entity", "season"], ["week"]).alias("games"), W.ordinal(["entity"], CAREER).alias("career"),
    )
    seasons = rows.groupBy("entity", "season").agg(F.avg("share").alias("m"))
    for back, name in ((1, "last"), (2, "before")):
        now = now.join(seasons.select("entity", (F.col("season") + back).alias("season"), F.col("m").alias(name)), ["entity", "season"], "left")
    newcomers = rows.groupBy("position").agg(F.avg("share").alias("newcomer"))  # one row per position
    full = now.join(newcomers, "position").withColumn("talent", X.talent_baseline("cur", "last", "before", "newcomer", "games", "career"))
    out = X.active_share(full, ["season", "week", "team"], "talent", "out", "games", "recent")
    return out.select("entity", "season", "week", "talent", "adjusted_share", "delta_adjusted_share", "recent_form_delta")


@query(
    "d7_leader_workload",
    "WITH l AS MATERIALIZED (SELECT team % 7 AS leader, season, week, CAST(sum(plays) AS DOUBLE) AS plays FROM teams GROUP BY ALL), q AS (SELECT round(quantile_cont(plays, 0.33), 6) AS q33, round(quantile_cont(plays, 0.66), 6) AS q66 FROM l), y AS (SELECT leader, season, avg(plays) AS m FROM l GROUP BY ALL) "
    "SELECT leader, season, week, leader_workload, volume, CASE WHEN volume > q66 THEN 'High' WHEN volume > q33 THEN 'Medium' ELSE 'Low' END AS volume_class FROM (SELECT w.leader, w.season, w.week, leader_workload, coalesce(leader_workload, y.m) AS volume FROM ("
    "SELECT *, CASE WHEN row_number() OVER (PARTITION BY leader ORDER BY season, week) > row_number() OVER (PARTITION BY leader, season ORDER BY week) THEN avg(plays) OVER (PARTITION BY leader ORDER BY season, week ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS leader_workload FROM l) w LEFT JOIN y ON y.leader = w.leader AND y.season = w.season - 1), q",
    "teams",
    "leader_workload volume",
)
def d7(spark, d):
    led = D.teams(spark, d).groupBy((F.col("team") % 7).alias("leader"), "season", "week").agg(F.sum("plays").cast("double").alias("plays"))
    medium, high = exact_percentiles(led, ["plays"], [0.33, 0.66])["plays"]
    worked = X.leader_workload(led, "leader", "season", CAREER, "plays")
    last = led.groupBy("leader", (F.col("season") + 1).alias("season")).agg(F.avg("plays").alias("m"))
    volume = worked.join(last, ["leader", "season"], "left").withColumn("volume", F.coalesce("leader_workload", "m"))
    return volume.select("leader", "season", "week", "leader_workload", "volume", X.volume_class(F.col("volume"), (medium, high)).alias("volume_class"))


_PASSER_SQL = "SELECT entity, team % 7 AS leader, season, week, touches, avg(touches) OVER (PARTITION BY entity, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM panel WHERE position = 'QB'"


@query(
    "d7_passing_volume",
    f"WITH p AS MATERIALIZED ({_PASSER_SQL}), q AS (SELECT quantile_cont(own, 0.33) AS q33, quantile_cont(own, 0.66) AS q66 FROM p), "
    "s AS (SELECT leader, season, week, arg_max(own, (touches, -entity)) AS own FROM (SELECT leader, season, week, touches, entity, struct_pack(own := own) AS own FROM p) GROUP BY ALL), "
    "l AS MATERIALIZED (SELECT team % 7 AS leader, season, week, CAST(sum(plays) AS DOUBLE) AS plays FROM teams GROUP BY ALL), y AS (SELECT leader, season, avg(plays) AS m FROM l GROUP BY ALL), "
    "w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY leader ORDER BY season, week) > row_number() OVER (PARTITION BY leader, season ORDER BY week) THEN avg(plays) OVER (PARTITION BY leader ORDER BY season, week ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS led FROM l), "
    "v AS (SELECT w.leader, w.season, w.week, s.own.own AS own, w.led, y.m FROM w LEFT JOIN s ON s.leader = w.leader AND s.season = w.season AND s.week = w.week LEFT JOIN y ON y.leader = w.leader AND y.season = w.season - 1) "
    "SELECT leader, season, week, coalesce(own, led, m) AS volume, CASE WHEN own IS NOT NULL THEN 'passer' WHEN led IS NOT NULL THEN 'leader' WHEN m IS NOT NULL THEN 'last season' END AS volume_from, "
    "CASE WHEN coalesce(own, led, m) > q66 THEN 'High' WHEN coalesce(own, led, m) > q33 THEN 'Medium' ELSE 'Low' END AS volume_class FROM v, q",
    "panel teams",
    "volume",
)
def d7_passing(spark, d):
    """Volume from the passer's own mean, else the leader's earlier games, else last season's mean."""
    passers = D.panel(spark, d).where("position = 'QB'").select(
        "entity", (F.col("team") % 7).alias("leader"), "season", "week", "touches", F.avg("touches").over(W.prior(["entity", "season"], ["week"])).alias("own")
    )
    passers = staged(passers, "passers")
    medium, high = exact_percentiles(passers, ["own"], [0.33, 0.66])["own"]
    starters = passers.groupBy("leader", "season", "week").agg(F.max_by(F.struct("own"), F.struct("touches", -F.col("entity"))).alias("s"))
    led = D.teams(spark, d).groupBy((F.col("team") % 7).alias("leader"), "season", "week").agg(F.sum("plays").cast("double").alias("plays"))
    last = led.groupBy("leader", (F.col("season") + 1).alias("season")).agg(F.avg("plays").alias("last_season"))
    full = X.leader_workload(led, "leader", "season", CAREER, "plays").join(last, ["leader", "season"], "left").join(starters, ["leader", "season", "week"], "left")
    volume, taken = X.first_known({"passer": F.col("s.own"), "leader": "leader_workload", "last season": "last_season"})
    return full.select("leader", "season", "week", volume.alias("volume"), taken.alias("volume_from"), X.volume_class(volume, (medium, high)).alias("volume_class"))


@query(
    "d8_stakes_flags",
    "SELECT doc_id, entity, bool_or(contains(line, entity) AND contains(lower(line), 'and')) AS could_clinch, bool_or(contains(line, entity) AND contains(lower(line), 'er')) AS could_be_eliminated, count(*) AS scenarios FROM ("
    "SELECT doc_id, CASE lang WHEN 'de' THEN 'Die' WHEN 'fr' THEN 'La' WHEN 'es' THEN 'El' ELSE 'The' END AS entity, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id, entity",
)
def d8(spark, d):
    docs = D.table(spark, d, "documents").select(
        "doc_id", F.expr("CASE lang WHEN 'de' THEN 'Die' WHEN 'fr' THEN 'La' WHEN 'es' THEN 'El' ELSE 'The' END").alias("entity"), F.split("text", "\n").alias("lines")
    )
    return X.stakes_flags(docs, ["doc_id"], "entity", "lines", clinch="and", eliminate="er")


TARGETS = [100, 200, 300, 400]


@query(
    "d9_threshold_targets",
    "SELECT entity, season, week, 'air_yards_' || n AS response_var, CASE WHEN air IS NOT NULL THEN CAST(air >= n AS INT)::BIGINT END AS label FROM panel, (SELECT unnest([100, 200, 300, 400]) AS n)",
    "panel",
)
def d9(spark, d):
    return X.threshold_targets(D.panel(spark, d), ["entity", "season", "week"], "air", TARGETS, "air_yards")


@query(
    "d10_phase_and_masks",
    "SELECT entity, season, week, CAST(week < 4 AS INT)::BIGINT AS early_season, CAST(week >= 4 AND week < 16 AS INT)::BIGINT AS mid_season, CAST(week >= 16 AND week < 19 AS INT)::BIGINT AS late_season, CAST(week >= 19 AS INT)::BIGINT AS playoffs, "
    "lag(yards, 1) OVER w IS NULL AND lag(air, 1) OVER w IS NULL AS mask_lag1_missing, lag(yards, 2) OVER w IS NULL AND lag(air, 2) OVER w IS NULL AS mask_lag2_missing, row_number() OVER (PARTITION BY entity, season ORDER BY week) = 1 AS mask_current_season_missing FROM panel WINDOW w AS (PARTITION BY entity ORDER BY season, week)",
    "panel",
)
def d10(spark, d):
    rows = W.lags(D.panel(spark, d), ["entity"], CAREER, ["yards", "air"], steps=(1, 2))
    masks = X.missing_masks({f"lag{n}": [f"yards_lag{n}", f"air_lag{n}"] for n in (1, 2)})
    return rows.select(
        "entity", "season", "week", *[c.alias(n) for n, c in X.phase_dummies("week").items()], *[c.alias(n) for n, c in masks.items()],
        (W.ordinal(["entity", "season"], ["week"]) == 0).alias("mask_current_season_missing"),
    )


@query(
    "d11_chronological_split",
    "SELECT CASE WHEN season <= 1999 THEN 'train' WHEN season = 2000 THEN 'validation' ELSE 'holdout' END AS split, count(*) AS n, min(season) AS first_season, max(season) AS last_season FROM panel GROUP BY 1",
    "panel",
)
def d11(spark, d):
    return D.panel(spark, d).groupBy(X.chronological_split("season", 1999).alias("split")).agg(
        F.count("*").alias("n"), F.min("season").alias("first_season"), F.max("season").alias("last_season")
    )


_FEATURE_NAMES = [
    "avg_{}", "last3_avg_{}", "last_season_avg_{}_per_attempt", "opp_defense_{}_allowed", "team_avg_{}", "pct_share_of_{}", "{}_lag1",
    "opp_avg_{}_per_play", "last_season_opp_total_{}", "team_pct_plays_{}", "team_{}_per_drive", "last_season_team_qb_sneaks_{}", "avg_{}_attempts",
]


def taxonomy_sql(source: str) -> str:
    """Rules of each scope, spelled out for DuckDB; ``source`` has a column feature."""
    def names(values):
        return ", ".join(f"'{v}'" for v in values)

    raw, kind = [], []
    for (scope, past), cut in X.NAME_CUTS.items():
        mine = f"WHEN scope = '{scope}' AND past = {past} THEN"
        chance, rate = X.OPPORTUNITY_WORDS[scope, past], X.RATE_WORDS[scope, past]
        named = f"raw_name IN ({names(X.OPPORTUNITY_NAMES.get((scope, past), ('',)))})"
        raw.append(f"{mine} regexp_replace(feature, '{cut}', '', 'g')")
        if scope == "Team Stats":
            rule = f"WHEN (raw_name = 'differential_per_win' OR regexp_matches(raw_name, '{rate}')) AND NOT regexp_matches(raw_name, '{X.TEAM_NO_RATE}') THEN 'Efficiency' WHEN regexp_matches(raw_name, '{chance}') OR {named} THEN 'Opportunity'"
        elif scope == "Opp Stats":
            rule = f"WHEN regexp_matches(raw_name, '{chance}') AND (NOT contains(raw_name, 'per_') OR contains(raw_name, 'per_play')) THEN 'Opportunity' WHEN regexp_matches(raw_name, '{rate}') AND NOT contains(raw_name, 'per_play') THEN 'Efficiency'"
        else:
            rule = f"WHEN (regexp_matches(raw_name, '{chance}') AND raw_name <> '{X.PLAYER_NO_OPPORTUNITY}' AND NOT regexp_matches(raw_name, '{rate}')) OR {named} THEN 'Opportunity' WHEN regexp_matches(raw_name, '{rate}') AND NOT contains(raw_name, 'snap') AND raw_name NOT IN ({names(X.PLAYER_NO_RATE)}) THEN 'Efficiency'"
        kind.append(f"{mine} CASE {rule} ELSE 'Production' END")
    return (
        f"SELECT * EXCLUDE (past), CASE {' '.join(kind)} END AS kind FROM (SELECT *, CASE WHEN past THEN 'Historical Seasons' WHEN regexp_matches(feature, CASE scope WHEN 'Player Stats' THEN 'lag|last3' ELSE 'last3' END) THEN 'Recent Games' ELSE 'Full Current Season' END AS timeframe, "
        f"CASE {' '.join(raw)} END AS raw_name FROM (SELECT *, CASE WHEN regexp_matches(feature, '^(last3_|last_season_|two_seasons_ago_|[a-z]+_)?opp_') THEN 'Opp Stats' WHEN contains(feature, 'team_') THEN 'Team Stats' ELSE 'Player Stats' END AS scope, "
        f"regexp_matches(feature, 'last_season|two_seasons_ago') AS past FROM ({source})))"
    )


@query(
    "d12_feature_taxonomy",
    taxonomy_sql(
        "SELECT replace(pattern, '{}', type) AS feature, count(*) AS n FROM (SELECT CASE WHEN response_var IN ('anytime_td_scorer', 'team_win') THEN response_var ELSE regexp_replace(response_var, '_[^_]*$', '') END AS type FROM bets), (SELECT unnest(["
        + ", ".join(f"'{p}'" for p in _FEATURE_NAMES)
        + "]) AS pattern) GROUP BY ALL"
    ),
    "bets",
)
def d12(spark, d):
    types = D.bets(spark, d).groupBy(C.bet_type("response_var").alias("type")).agg(F.count("*").alias("n"))
    names = types.select(
        F.explode(F.array(*[F.replace(F.lit(p), F.lit("{}"), F.col("type")) for p in _FEATURE_NAMES])).alias("feature"), "n"
    )
    return X.feature_taxonomy(names)


_IV_FEATURES = ["air", "touches", "urgent", "yards_lag1", "avg_yards"]
_IV_SRC = "SELECT yards >= 300 AS y, air, touches, urgent, lag(yards) OVER (PARTITION BY entity ORDER BY season, week) AS yards_lag1, avg(yards) OVER (PARTITION BY entity ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS avg_yards FROM panel"
_IV_SQL = (
    f"WITH src AS MATERIALIZED ({_IV_SRC}), lng AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(y AS INT) AS y, CAST({f} AS DOUBLE) AS v FROM src" for f in _IV_FEATURES)
    + "), ed AS (SELECT feature, list_distinct(quantile_cont(v, [1/6, 2/6, 3/6, 4/6, 5/6])) AS e FROM lng GROUP BY feature), "
    "b AS (SELECT lng.feature, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(e, lambda q: v > q)) END AS bin, sum(y) AS ones, count(*) AS n FROM lng JOIN ed ON ed.feature = lng.feature GROUP BY ALL), "
    "t AS (SELECT feature, sum(ones) AS a1, sum(n) AS an, count(*) AS k, coalesce(sum(n) FILTER (WHERE bin = -1), 0) AS miss FROM b GROUP BY feature), "
    "w AS (SELECT b.feature, CAST(bin AS BIGINT) AS bin, n, ones / CAST(n AS DOUBLE) AS positive_share, (ones + 0.5::DOUBLE) / (a1 + 0.5::DOUBLE * k) AS s1, (n - ones + 0.5::DOUBLE) / (an - a1 + 0.5::DOUBLE * k) AS s0, miss / CAST(an AS DOUBLE) AS share_missing FROM b JOIN t ON t.feature = b.feature) "
    "SELECT feature, bin, n, positive_share, woe, bin_iv, share_missing, total_iv, CASE WHEN total_iv < 0.02 THEN 'None' WHEN total_iv <= 0.1 THEN 'Low' WHEN total_iv <= 0.3 THEN 'Medium' WHEN total_iv <= 0.5 THEN 'High' ELSE 'Suspicious' END AS strength FROM (SELECT *, sum(bin_iv) OVER (PARTITION BY feature) AS total_iv FROM (SELECT feature, bin, n, positive_share, ln(s1 / s0) AS woe, (s1 - s0) * ln(s1 / s0) AS bin_iv, share_missing FROM w))"
)


def _iv_source(spark, d):
    rows = D.panel(spark, d).select(
        "entity", "season", (F.col("yards") >= 300).alias("y"), "air", "touches", "urgent",
        F.lag("yards").over(W.Window.partitionBy("entity").orderBy(*CAREER)).alias("yards_lag1"),
        F.avg("yards").over(W.prior(["entity"], CAREER)).alias("avg_yards"),
    )
    return staged(rows, "features")  # read by several passes


@query("d13_information_value", _IV_SQL, "panel", "positive_share woe bin_iv share_missing total_iv")
def d13(spark, d):
    return X.information_value(_iv_source(spark, d), "y", _IV_FEATURES)


# one bin per level, by frequency, and how many players each bin holds
_IV_LEVELS_SQL = (
    f"WITH src AS MATERIALIZED (SELECT entity, CASE WHEN touches < 4 THEN position END AS position, y, air, avg_yards FROM (SELECT entity, position, {_IV_SRC.removeprefix('SELECT ')})), "
    "lng AS (SELECT entity, 'air' AS feature, CAST(y AS INT) AS y, CAST(air AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS level FROM src UNION ALL SELECT entity, 'avg_yards', CAST(y AS INT), avg_yards, NULL FROM src UNION ALL SELECT entity, 'position', CAST(y AS INT), NULL, position FROM src), "
    "ed AS (SELECT feature, list_distinct(quantile_cont(v, [1/6, 2/6, 3/6, 4/6, 5/6])) AS e FROM lng WHERE v IS NOT NULL GROUP BY feature), "
    "lv AS (SELECT feature, level, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, level) - 1 AS place FROM lng WHERE level IS NOT NULL GROUP BY feature, level), "
    "pl AS (SELECT lng.*, CASE WHEN lng.feature = 'position' THEN coalesce(place, -1) WHEN v IS NULL THEN -1 ELSE len(list_filter(e, lambda q: v > q)) END AS bin FROM lng LEFT JOIN ed ON ed.feature = lng.feature LEFT JOIN lv ON lv.feature = lng.feature AND lv.level = lng.level), "
    "b AS (SELECT feature, bin, level, sum(y) AS ones, count(*) AS n, count(DISTINCT entity) AS entities FROM pl GROUP BY ALL), "
    "t AS (SELECT feature, sum(ones) AS a1, sum(n) AS an, count(*) AS k, coalesce(sum(n) FILTER (WHERE bin = -1), 0) AS miss FROM b GROUP BY feature), "
    "w AS (SELECT b.feature, CAST(bin AS BIGINT) AS bin, level, n, entities, ones / CAST(n AS DOUBLE) AS positive_share, (ones + 0.5::DOUBLE) / (a1 + 0.5::DOUBLE * k) AS s1, (n - ones + 0.5::DOUBLE) / (an - a1 + 0.5::DOUBLE * k) AS s0, miss / CAST(an AS DOUBLE) AS share_missing FROM b JOIN t ON t.feature = b.feature) "
    "SELECT feature, bin, level, n, entities, positive_share, ln(s1 / s0) AS woe, (s1 - s0) * ln(s1 / s0) AS bin_iv, share_missing, sum((s1 - s0) * ln(s1 / s0)) OVER (PARTITION BY feature) AS total_iv FROM w"
)


@query("d13_levels_and_entities", _IV_LEVELS_SQL, "panel", "positive_share woe bin_iv share_missing total_iv")
def d13_levels(spark, d):
    """Text features bin by bin, and the players behind each bin; missing positions are a bin too."""
    rows = D.panel(spark, d).select(
        "entity", (F.col("yards") >= 300).alias("y"), "air", F.avg("yards").over(W.prior(["entity"], CAREER)).alias("avg_yards"),
        F.when(F.col("touches") < 4, F.col("position")).alias("position"),
    )
    return X.information_value(staged(rows, "features"), "y", ["air", "avg_yards"], categorical=["position"], entity="entity").drop("strength")


def _taxonomy(spark):
    return X.feature_taxonomy(spark.createDataFrame([(f,) for f in _IV_FEATURES], "feature string"))


_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM ({_IV_SRC})" for i, a in enumerate(_IV_FEATURES) for b in _IV_FEATURES[i + 1 :]
)
# of two winners of one scope and timeframe that move together the one with less information goes
_TOURNAMENT_SQL = (
    f"WITH one AS MATERIALIZED (SELECT DISTINCT feature, total_iv FROM ({_IV_SQL}) WHERE share_missing < 0.9 AND strength <> 'None'), "
    f"named AS ({taxonomy_sql('SELECT * FROM one')}), "
    "win AS MATERIALIZED (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY scope, timeframe, kind ORDER BY total_iv DESC, feature) <= 5), "
    f"twins AS (SELECT x.feature AS fx, y.feature AS fy, x.total_iv AS ix, y.total_iv AS iy, x.kind = y.kind OR abs(x.total_iv - y.total_iv) > 0.15 AS by_value FROM ({_CORR_SQL}) c JOIN win x ON x.feature = f1 JOIN win y ON y.feature = f2 WHERE r > 0.9 AND x.timeframe = y.timeframe), "
    "gone AS (SELECT CASE WHEN NOT by_value THEN greatest(fx, fy) WHEN ix < iy OR (ix = iy AND fy < fx) THEN fx ELSE fy END AS feature FROM twins) "
    "SELECT feature, scope, timeframe, kind, total_iv FROM win WHERE feature NOT IN (SELECT feature FROM gone)"
)


@query("d14_iv_tournament", _TOURNAMENT_SQL, "panel", "total_iv")
def d14(spark, d):
    rows = _iv_source(spark, d)
    return X.iv_tournament(rows, X.information_value(rows, "y", _IV_FEATURES), _taxonomy(spark), max_missing=0.9)


@query(
    "d15_either_or",
    f"SELECT o.option1, o.option2, arg_max(feature, (total_iv, feature)) AS decision FROM (VALUES ('air', 'touches'), ('yards_lag1', 'avg_yards'), ('urgent', 'not_there')) o(option1, option2) JOIN (SELECT DISTINCT feature, total_iv FROM ({_IV_SQL})) ON feature = o.option1 OR feature = o.option2 GROUP BY ALL",
    "panel",
)
def d15(spark, d):
    iv = X.information_value(_iv_source(spark, d), "y", _IV_FEATURES)
    pairs = spark.createDataFrame([("air", "touches"), ("yards_lag1", "avg_yards"), ("urgent", "not_there")], "option1 string, option2 string")
    return X.either_or(pairs, iv)


@query("d16_selected_columns")
def d16(spark, d):
    rows = _iv_source(spark, d)
    chosen = X.iv_tournament(rows, X.information_value(rows, "y", _IV_FEATURES), _taxonomy(spark), max_missing=0.9)
    registry = P.FeatureRegistry()
    registry.add("selected", [r["feature"] for r in chosen.select("feature").orderBy("feature").collect()])
    picked = registry.tag(rows.select("entity", "season", "y", *registry.columns("selected")))
    return picked.withColumn("split", X.chronological_split("season", 1999))


_KEYED_IV_SRC = _IV_SRC.replace("SELECT ", "SELECT entity, season, week, ", 1)


@query(
    "d16_selected_values",
    f"WITH chosen AS MATERIALIZED (SELECT feature FROM ({_TOURNAMENT_SQL})), src AS MATERIALIZED ({_KEYED_IV_SRC}) "
    "SELECT entity, season, week, feature, value, CASE WHEN season <= 1999 THEN 'train' WHEN season = 2000 THEN 'validation' ELSE 'holdout' END AS split FROM ("
    + " UNION ALL ".join(f"SELECT entity, season, week, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM src" for f in _IV_FEATURES)
    + ") JOIN chosen USING (feature) WHERE value IS NOT NULL",
    "panel",
    "value",
)
def d16_values(spark, d):
    """Values of the selected features as rows: the selection is joined, so the plan does not depend on what was chosen."""
    rows = staged(D.panel(spark, d).select(
        "entity", "season", "week", (F.col("yards") >= 300).alias("y"), "air", "touches", "urgent",
        F.lag("yards").over(W.Window.partitionBy("entity").orderBy(*CAREER)).alias("yards_lag1"),
        F.avg("yards").over(W.prior(["entity"], CAREER)).alias("avg_yards"),
    ), "features")
    chosen = X.iv_tournament(rows, X.information_value(rows, "y", _IV_FEATURES), _taxonomy(spark), max_missing=0.9).select("feature")
    value = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in _IV_FEATURES]))
    long = rows.select("entity", "season", "week", value.alias("f")).select("entity", "season", "week", "f.*").where("value IS NOT NULL")
    return long.join(chosen, "feature", "left_semi").withColumn("split", X.chronological_split("season", 1999))


@query(
    "d17_panel_assembly",
    f"WITH inj AS MATERIALIZED ({_INJ_SQL}) SELECT p.entity, p.season, p.week, p.team, p.opponent, t.yards AS team_yards, o.yards AS opp_yards, n.n_name AS team_name, coalesce(i.out, FALSE) AS out, coalesce(i.illness, FALSE) AS illness, CASE WHEN t.plays > 0 THEN p.yards / t.plays END AS yards_per_team_play, CASE WHEN p.season = 2001 AND p.week = 20 THEN 55.0 END AS temp "
    "FROM panel p JOIN teams t ON t.season = p.season AND t.week = p.week AND t.team = p.team JOIN teams o ON o.season = p.season AND o.week = p.week AND o.team = p.opponent LEFT JOIN nation n ON n.n_nationkey = p.team LEFT JOIN inj i ON i.entity = p.entity AND i.season = p.season AND i.week = p.week",
    "panel teams",
    "team_yards opp_yards yards_per_team_play temp",
)
def d17(spark, d):
    teams = D.teams(spark, d)
    own = teams.select("season", "week", "team", F.col("yards").alias("team_yards"), "plays")
    other = teams.select("season", "week", F.col("team").alias("opponent"), F.col("yards").alias("opp_yards"))
    names = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.col("n_name").alias("name"))
    joined = D.panel(spark, d).join(own, ["season", "week", "team"]).join(other, ["season", "week", "opponent"])
    joined = J.lookup(joined, names, "team", "n_nationkey", "team_").join(injuries(spark, d), ["entity", "season", "week"], "left")
    rows = P.finite_only(P.default_flags(joined, ["out", "illness"]).withColumn("yards_per_team_play", F.try_divide("yards", "plays")))
    rows = rows.select("entity", "season", "week", "team", "opponent", "team_yards", "opp_yards", "team_name", "out", "illness", "yards_per_team_play", F.lit(None).cast("double").alias("temp"))
    period = (F.col("season") == 2001) & (F.col("week") == 20)
    return U.replace_slice(rows, period, rows.where(period).withColumn("temp", F.lit(55.0)))


@query(
    "d18_weather_attach",
    "SELECT g.game_id, g.season, g.week, g.home, f.air AS temp FROM games g LEFT JOIN teams f ON g.home % 2 = 0 AND g.season >= 2000 AND f.team = g.home AND f.season = g.season AND f.week = g.week",
    "games teams",
    "temp",
)
def d18(spark, d):
    games = D.games(spark, d).select("game_id", "season", "week", "home")
    outdoor = games.where("home % 2 = 0 AND season >= 2000").select("season", "week", "home").distinct()
    forecast = D.teams(spark, d).select("season", "week", F.col("team").alias("home"), F.col("air").alias("temp"))
    return games.join(outdoor.join(forecast, ["season", "week", "home"], "left"), ["season", "week", "home"], "left")


@query(
    "d19_conference_text",
    "WITH b AS (SELECT team, season, week, week_end, coalesce(lag(week_end) OVER (PARTITION BY team, season ORDER BY week) + INTERVAL 1 SECOND, make_timestamp(season, 1, 1, 0, 0, 0)) AS week_start FROM ("
    "SELECT CAST(c_nationkey AS BIGINT) AS team, CAST(year(o_orderdate) AS BIGINT) AS season, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS BIGINT) AS week, max(o_orderdate) AS week_end FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)), "
    "t AS (SELECT doc_id, text, doc_id % 25 AS team, TIMESTAMP '1997-01-01' + INTERVAL 1 DAY * ((doc_id * 37) % 1500) AS posted FROM documents), "
    "s AS (SELECT *, CAST(CASE WHEN month(posted) < 3 THEN year(posted) - 1 ELSE year(posted) END AS BIGINT) AS season FROM t) "
    "SELECT season, week, team, doc_id // 10000 AS segment, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS text_hash, count(*) AS n_texts FROM (SELECT s.season, s.team, s.doc_id, s.text, coalesce(b.week, 0) AS week FROM s LEFT JOIN b ON b.team = s.team AND b.season = s.season AND s.posted BETWEEN b.week_start AND b.week_end WHERE regexp_matches(lower(text), 'the|der|les')) GROUP BY ALL",
)
def d19(spark, d):
    posted = D.table(spark, d, "documents").select(
        "doc_id", "text", (F.col("doc_id") % 25).alias("team"),
        F.expr("CAST(date_add(DATE '1997-01-01', CAST((doc_id * 37) % 1500 AS int)) AS timestamp_ntz)").alias("posted"),
    )
    dated = posted.where(C.mentions("text", "the|der|les")).withColumn("season", C.season_of("posted"))
    placed = J.within_interval(dated, week_bounds(spark, d), ["team", "season"], "posted", "week_start", "week_end", "week")
    out = A.text_segments(placed, ["season", "week", "team"], "doc_id", "text", 10000)
    return out.select("season", "week", "team", "segment", F.md5("joined_text").alias("text_hash"), "n_texts")


# the documents have no titles; one of four kinds by id stands for them
_TITLE = (
    "CASE doc_id % 4 WHEN 0 THEN 'Head Coach Press Conference' WHEN 1 THEN 'Players ADDRESS the Media' "
    "WHEN 2 THEN 'Coach on the draft' ELSE 'Players address fans' END"
)


@query(
    "d19_press_conferences",
    "WITH b AS (SELECT team, season, week, week_end, coalesce(lag(week_end) OVER (PARTITION BY team, season ORDER BY week) + INTERVAL 1 SECOND, make_timestamp(season, 1, 1, 0, 0, 0)) AS week_start FROM ("
    "SELECT CAST(c_nationkey AS BIGINT) AS team, CAST(year(o_orderdate) AS BIGINT) AS season, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS BIGINT) AS week, max(o_orderdate) AS week_end FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)), "
    f"t AS (SELECT doc_id, text, lang, doc_id % 25 AS team, TIMESTAMP '1997-01-01' + INTERVAL 1 DAY * ((doc_id * 37) % 1500) AS posted, {_TITLE} AS title FROM documents), "
    "s AS (SELECT *, CAST(CASE WHEN month(posted) < 3 THEN year(posted) - 1 ELSE year(posted) END AS BIGINT) AS season FROM t), "
    "w AS (SELECT s.*, coalesce(b.week, 0) AS week FROM s LEFT JOIN b ON b.team = s.team AND b.season = s.season AND s.posted BETWEEN b.week_start AND b.week_end), "
    "c AS (SELECT *, CASE WHEN week = 0 AND month(posted) < 3 THEN season + 1 ELSE season END AS told FROM w WHERE contains(lower(title), 'press') OR (contains(lower(title), 'address') AND contains(lower(title), 'media'))) "
    "SELECT told AS season, week, team, md5(string_agg(concat_ws(' ', title, lang, text), chr(10) || chr(10) ORDER BY posted, doc_id)) AS text_hash, bool_or(contains(lower(title), 'coach')) AS has_coach, count(*) AS n_posts FROM c GROUP BY ALL",
)
def d19_press(spark, d):
    posted = D.table(spark, d, "documents").select(
        "doc_id", "text", "lang", (F.col("doc_id") % 25).alias("team"), F.expr(_TITLE).alias("title"),
        F.expr("CAST(date_add(DATE '1997-01-01', CAST((doc_id * 37) % 1500 AS int)) AS timestamp_ntz)").alias("posted"),
    )
    placed = J.within_interval(posted.withColumn("season", C.season_of("posted")), week_bounds(spark, d), ["team", "season"], "posted", "week_start", "week_end", "week")
    told = placed.withColumn("season", C.posted_season("posted", "week"))
    out = A.conference_text(told, ["season", "week", "team"], "title", ["lang", "text"], ["posted", "doc_id"])
    return out.select("season", "week", "team", F.md5("conference_text").alias("text_hash"), "has_coach", "n_posts")
