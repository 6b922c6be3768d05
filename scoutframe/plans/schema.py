"""Projection, schema, ordering and set queries (P, T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as C
from ..operators import schema as P
from ..operators import sets as U
from ..operators import windows as W
from . import domain as D
from .registry import query

TEAM_ROWS_SQL = (
    "SELECT game_id, season, week, 'home' AS venue, home AS team, away AS opponent, home_score AS team_score, away_score AS opponent_score FROM games "
    "UNION ALL SELECT game_id, season, week, 'away', away, home, away_score, home_score FROM games"
)


@query("p1_team_rows", TEAM_ROWS_SQL, "games")
def p1(spark, d):
    return P.team_rows(D.games(spark, d))


@query(
    "p2_mirrored_defence",
    "SELECT t.season, t.week, t.team, t.yards, o.yards AS opp_defense_yards_allowed, o.urgent AS opp_defense_urgent_forced, o.plays AS opp_defense_plays FROM teams t JOIN teams o ON t.season = o.season AND t.week = o.week AND t.team = o.opponent",
    "teams",
    "yards opp_defense_yards_allowed",
)
def p2(spark, d):
    teams = D.teams(spark, d)
    mirrored = P.mirror_columns(
        teams.select("season", "week", "opponent", "yards", "urgent", "plays"),
        {"season": "season", "week": "week", "opponent": "team"}, forced=["urgent"], neutral=["plays"],
    )
    return teams.select("season", "week", "team", "yards").join(mirrored, ["season", "week", "team"])


_VERDICT_COLS = ["yards", "air", "touches", "urgent", "flag", "constant", "rare"]
_P3_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS rows, count(v) AS present, count(DISTINCT v) AS distinct_values, avg(v) AS mean, quantile_cont(v, 0.5) AS median, "
    f"CASE WHEN NOT (CAST(count(v) AS DOUBLE) / count(*) > 1 - 0.7 AND count(DISTINCT v) > 1) THEN 'drop' WHEN bool_and(v IN (0, 1)) THEN 'zero_one' WHEN quantile_cont(v, 0.5) = 0 AND avg(v) < 1 AND count(DISTINCT v) < 10 THEN 'low_median' ELSE 'keep' END AS verdict "
    f"FROM (SELECT CAST({c} AS DOUBLE) AS v FROM src)"
    for c in _VERDICT_COLS
)


@query(
    "p3_informative_columns",
    "SELECT * FROM (WITH src AS (SELECT yards, air, touches, urgent, entity % 2 AS flag, 7 AS constant, CASE WHEN entity % 10 = 0 THEN yards END AS rare FROM panel) " + _P3_SQL + ")",
    "panel",
    "mean median",
)
def p3(spark, d):
    df = D.panel(spark, d).select(
        "yards", "air", "touches", "urgent", F.expr("entity % 2").alias("flag"), F.lit(7).alias("constant"),
        F.expr("CASE WHEN entity % 10 = 0 THEN yards END").alias("rare"),
    )
    return P.informative_columns(df, _VERDICT_COLS, missing_threshold=0.7)


@query(
    "p4_finite_only",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS ratio, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem",
    doubles="ratio tax",
)
def p4(spark, d):
    raw = D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_quantity", "l_discount")).alias("ratio"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"),
    )
    return P.finite_only(raw)


@query(
    "p5_default_flags",
    "SELECT c_custkey, coalesce(any_urgent, FALSE) AS any_urgent, coalesce(any_open, FALSE) AS any_open FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS any_urgent, bool_or(o_orderstatus = 'O') AS any_open FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
)
def p5(spark, d):
    flags = D.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"),
        F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"),
    )
    joined = D.table(spark, d, "customer").select("c_custkey").join(flags, "c_custkey", "left")
    return P.default_flags(joined, ["any_urgent", "any_open"])


@query(
    "p6_zero_if_took_part",
    "SELECT entity, season, week, CASE WHEN air IS NULL AND urgent > 0 THEN 0.0 ELSE air END AS air, CASE WHEN late IS NULL AND urgent > 0 AND season >= 1998 THEN 0.0 ELSE late END AS late FROM (SELECT *, CASE WHEN week > 26 THEN yards END AS late FROM panel)",
    "panel",
    "air late",
)
def p6(spark, d):
    df = D.panel(spark, d).withColumn("late", F.when(F.col("week") > 26, F.col("yards")))
    out = P.zero_if_took_part(df, ["air", "late"], "urgent", since={"late": 1998})
    return out.select("entity", "season", "week", "air", "late")


@query(
    "p7_blank_targets",
    "SELECT entity, season, week, CASE WHEN NOT (season = 2001 AND week >= 20) THEN yards END AS yards, CASE WHEN NOT (season = 2001 AND week >= 20) THEN air END AS air FROM panel",
    "panel",
    "yards air",
)
def p7(spark, d):
    ahead = (F.col("season") == 2001) & (F.col("week") >= 20)
    return P.blank_targets(D.panel(spark, d), ["yards", "air"], ahead).select("entity", "season", "week", "yards", "air")


@query(
    "p8_target_families",
    "SELECT 'passing' AS family, entity, season, week, yards, air, NULL::BIGINT AS touches FROM panel WHERE position = 'QB' UNION ALL SELECT 'receiving', entity, season, week, NULL, air, touches FROM panel WHERE position IN ('RB', 'WR', 'TE')",
    "panel",
    "yards air",
)
def p8(spark, d):
    registry = P.FeatureRegistry()
    registry.add("passing", ["yards", "air"])
    registry.add("receiving", ["air", "touches"])
    df = D.panel(spark, d)
    keys = ["entity", "season", "week"]
    passing = P.target_family(df, registry, ["passing"], keys, "position", ["QB"])
    receiving = P.target_family(df, registry, ["receiving"], keys, "position", ["RB", "WR", "TE"])
    return U.union_wide(passing.withColumn("family", F.lit("passing")), receiving.withColumn("family", F.lit("receiving")))


@query(
    "p9_align_schema",
    "SELECT o_orderkey, o_totalprice, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_number, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS o_orderstatus, CAST(NULL AS DOUBLE) AS never_seen FROM orders",
    doubles="o_totalprice priority_number never_seen",
)
def p9(spark, d):
    new = D.table(spark, d, "orders").withColumn("priority_number", F.substring("o_orderpriority", 1, 1)).withColumn("extra", F.lit(1))
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("priority_number", T.DoubleType()), T.StructField("o_orderstatus", T.StringType()),
        T.StructField("never_seen", T.DoubleType()),
    ])
    return P.align_schema(new, schema, {"o_orderstatus": ["F", "O"]})


@query(
    "p10_row_filters",
    "SELECT season, week, team, opponent FROM teams WHERE team <> opponent AND (season > 1999 OR (season = 1999 AND week >= 10)) AND coalesce(NOT (air > 300), TRUE)",
    "teams",
)
def p10(spark, d):
    later = (F.col("season") > 1999) | ((F.col("season") == 1999) & (F.col("week") >= 10))
    not_out = F.coalesce(~(F.col("air") > 300), F.lit(True))
    return D.teams(spark, d).where((F.col("team") != F.col("opponent")) & later & not_out).select("season", "week", "team", "opponent")


@query(
    "p11_code_aliases",
    "SELECT n_nationkey, CASE n_name WHEN 'NATION_3' THEN 'N3' WHEN 'NATION_7' THEN 'N7' ELSE n_name END AS code FROM nation",
)
def p11(spark, d):
    codes = D.table(spark, d, "nation").replace({"NATION_3": "N3", "NATION_7": "N7"}, subset=["n_name"])
    return codes.select("n_nationkey", F.col("n_name").alias("code"))


@query(
    "p12_location_and_time",
    "SELECT event_id, CASE WHEN h < 12 THEN 'Morning' WHEN h < 14 THEN 'Early Window' WHEN h < 19 THEN 'Late Window' ELSE 'Night' END AS day_part, CASE WHEN h < 11 THEN 'Morning' WHEN h < 15 THEN 'Early Window' WHEN h < 19 THEN 'Late Window' ELSE 'Night' END AS sheet_part, CASE WHEN k % 3 = 0 THEN 'Home' WHEN k % 3 = 1 THEN 'Away' ELSE 'Neutral' END AS location FROM (SELECT *, hour(run_time) AS h FROM lines)",
    "lines",
)
def p12(spark, d):
    side = F.expr("k % 3")
    return D.lines(spark, d).select(
        "event_id", C.day_part(F.hour("run_time")).alias("day_part"), C.day_part(F.hour("run_time"), C.SHEET_HOURS).alias("sheet_part"),
        F.when(side == 0, "Home").when(side == 1, "Away").otherwise("Neutral").alias("location"),
    )


@query(
    "p13_context_flags",
    "SELECT season, week, team, coalesce(rest < 2, FALSE) AS short_week, coalesce(rest > 3, FALSE) AS long_week, coalesce(NOT ((temp < 40 AND team % 2 = 0) OR (temp > 80 AND team % 3 = 0)), TRUE) AS familiar_temperature, "
    "team % 5 <> opponent % 5 AS long_travel FROM (SELECT *, (season * 53 + week) - lag(season * 53 + week) OVER (PARTITION BY team ORDER BY season, week) AS rest, CASE WHEN air IS NOT NULL THEN CAST(air AS BIGINT) % 110 END AS temp FROM teams)",
    "teams",
)
def p13(spark, d):
    stamp = F.col("season") * 53 + F.col("week")
    df = D.teams(spark, d).select(
        "*", (stamp - F.lag(stamp).over(W.Window.partitionBy("team").orderBy("season", "week"))).alias("rest"),
        F.expr("CAST(air AS bigint) % 110").alias("temp"),
    )
    odd = ((F.col("temp") < 40) & (F.col("team") % 2 == 0)) | ((F.col("temp") > 80) & (F.col("team") % 3 == 0))
    return df.select(
        "season", "week", "team",
        F.coalesce(F.col("rest") < 2, F.lit(False)).alias("short_week"),
        F.coalesce(F.col("rest") > 3, F.lit(False)).alias("long_week"),
        F.coalesce(~odd, F.lit(True)).alias("familiar_temperature"),
        (F.col("team") % 5 != F.col("opponent") % 5).alias("long_travel"),
    )


# --- ordering -------------------------------------------------------------------------------


@query(
    "t1_newest_period",
    "SELECT season, week, team, score FROM teams WHERE season * 53 + week = (SELECT max(season * 53 + week) FROM teams)",
    "teams",
)
def t1(spark, d):
    return U.newest_period(D.teams(spark, d), F.col("season") * 53 + F.col("week")).select("season", "week", "team", "score")


@query(
    "t1_first_row",
    "SELECT game_id, season, week FROM games ORDER BY season, week, game_id LIMIT 1",
    "games",
)
def t1_first(spark, d):
    return D.games(spark, d).select("game_id", "season", "week").orderBy("season", "week", "game_id").limit(1)


@query(
    "t2_top_winners",
    "SELECT bet_id, odds FROM bets WHERE bet_hit ORDER BY odds DESC, bet_id LIMIT 10",
    "bets",
    "odds",
)
def t2(spark, d):
    return D.bets(spark, d).where("bet_hit").select("bet_id", "odds").orderBy(F.desc("odds"), "bet_id").limit(10)


@query(
    "t3_report_order",
    "SELECT season, team, sum(score) AS points, row_number() OVER (ORDER BY season, sum(score) DESC, team) AS line FROM (SELECT season, team, CAST(score AS BIGINT) AS score FROM teams) GROUP BY season, team",
    "teams",
)
def t3(spark, d):
    totals = D.teams(spark, d).groupBy("season", "team").agg(F.sum("score").alias("points"))
    return U.numbered_report(totals, ["season"], [F.col("season"), F.desc("points"), F.col("team")], "line")


# --- set operations -------------------------------------------------------------------------


@query(
    "u1_union_different_columns",
    "SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier",
    doubles="balance",
)
def u1(spark, d):
    customers = D.table(spark, d, "customer").selectExpr("'customer' kind", "c_custkey id", "c_acctbal balance", "c_mktsegment segment")
    suppliers = D.table(spark, d, "supplier").selectExpr("'supplier' kind", "s_suppkey id", "s_acctbal balance")
    return U.union_wide(customers, suppliers)


@query(
    "u2_replace_period",
    "SELECT season, week, team, yards FROM teams WHERE NOT (season = 2000 AND week = 10) UNION ALL SELECT season, week, team, yards + 1000 FROM teams WHERE season = 2000 AND week = 10",
    "teams",
    "yards",
)
def u2(spark, d):
    df = D.teams(spark, d).select("season", "week", "team", "yards")
    period = (F.col("season") == 2000) & (F.col("week") == 10)
    return U.replace_slice(df, period, df.where(period).withColumn("yards", F.col("yards") + 1000))


@query(
    "u3_distinct_keep_first",
    "SELECT l_suppkey, l_partkey, l_orderkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1",
    doubles="l_quantity",
)
def u3(spark, d):
    df = D.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return U.first_per_key(df, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"]).drop("l_linenumber")


@query("u3_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def u3_distinct(spark, d):
    return D.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("u4_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u4(spark, d):
    ordered = D.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return U.keys_without(D.table(spark, d, "customer").select("c_custkey"), ordered, ["c_custkey"])
