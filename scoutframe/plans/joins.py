"""Join queries (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import joins as J
from . import domain as D
from .registry import query
from .scalars import NAME_SQL
from .windows import week_bounds


@query(
    "j1_panel_join",
    "SELECT p.entity, p.season, p.week, p.team, p.opponent, t.yards AS team_yards, o.yards AS opponent_yards FROM panel p JOIN teams t ON p.season = t.season AND p.week = t.week AND p.team = t.team "
    "JOIN teams o ON p.season = o.season AND p.week = o.week AND p.opponent = o.team",
    "panel teams",
    "team_yards opponent_yards",
)
def j1(spark, d):
    teams = D.teams(spark, d)
    own = teams.select("season", "week", "team", F.col("yards").alias("team_yards"))
    other = teams.select("season", "week", F.col("team").alias("opponent"), F.col("yards").alias("opponent_yards"))
    panel = D.panel(spark, d).select("entity", "season", "week", "team", "opponent")
    return panel.join(own, ["season", "week", "team"]).join(other, ["season", "week", "opponent"])


@query(
    "j2_lookup_roles",
    "SELECT t.season, t.week, t.team, t.opponent, a.n_name AS team_n_name, b.n_name AS opp_n_name FROM teams t LEFT JOIN nation a ON a.n_nationkey = t.team LEFT JOIN nation b ON b.n_nationkey = t.opponent",
    "teams",
)
def j2(spark, d):
    nation = D.table(spark, d, "nation").select("n_nationkey", "n_name")
    df = D.teams(spark, d).select("season", "week", "team", "opponent")
    return J.lookup(J.lookup(df, nation, "team", "n_nationkey", "team_"), nation, "opponent", "n_nationkey", "opp_")


@query(
    "j3_full_outer",
    "SELECT entity, season, f.yards AS f_yards, o.yards AS o_yards, f.yards IS NOT NULL AS has_f FROM "
    "(SELECT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS season, CAST(count(*) AS DOUBLE) AS yards FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) f FULL JOIN "
    "(SELECT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS season, CAST(count(*) AS DOUBLE) AS yards FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) o USING (entity, season)",
    doubles="f_yards o_yards",
)
def j3(spark, d):
    def one(status, name):
        return (
            D.table(spark, d, "orders").where(F.col("o_orderstatus") == status)
            .groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("bigint").alias("season"))
            .agg(F.count("*").cast("double").alias(name))
        )

    return one("F", "f_yards").join(one("O", "o_yards"), ["entity", "season"], "full_outer").withColumn(
        "has_f", F.col("f_yards").isNotNull()
    )


@query(
    "j4_keep_dimension_rows",
    "SELECT n_nationkey, n_name, coalesce(n, 0) AS n_weeks, coalesce(w, '') AS weeks FROM nation LEFT JOIN (SELECT team, count(*) AS n, string_agg(season || ':' || week, ',' ORDER BY season, week) AS w FROM teams WHERE urgent > 0 GROUP BY team) ON team = n_nationkey",
    "teams",
)
def j4(spark, d):
    from ..operators.aggregates import ordered_text

    busy = (
        D.teams(spark, d).where("urgent > 0").withColumn("wk", F.concat_ws(":", "season", "week"))
        .groupBy(F.col("team").alias("n_nationkey")).agg(F.count("*").alias("n"), ordered_text(["season", "week"], "wk", ",").alias("w"))
    )
    return D.table(spark, d, "nation").select("n_nationkey", "n_name").join(busy, "n_nationkey", "left").select(
        "n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n_weeks"), F.coalesce("w", F.lit("")).alias("weeks")
    )


@query(
    "j5_interval_join",
    "WITH b AS (SELECT team, season, week, week_end, coalesce(lag(week_end) OVER (PARTITION BY team, season ORDER BY week) + INTERVAL 1 SECOND, make_timestamp(season, 1, 1, 0, 0, 0)) AS week_start FROM ("
    "SELECT CAST(c_nationkey AS BIGINT) AS team, CAST(year(o_orderdate) AS BIGINT) AS season, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS BIGINT) AS week, max(o_orderdate) AS week_end FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)) "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(b.week, 0) AS week FROM lineitem LEFT JOIN b ON b.team = l_suppkey % 25 AND b.season = year(l_shipdate) AND l_shipdate BETWEEN b.week_start AND b.week_end",
)
def j5(spark, d):
    events = D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.expr("l_suppkey % 25").alias("team"), F.year("l_shipdate").cast("bigint").alias("season"),
    )
    out = J.within_interval(events, week_bounds(spark, d), ["team", "season"], "l_shipdate", "week_start", "week_end", "week")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "week")


@query(
    "j6_earlier_seasons",
    "WITH s AS (SELECT entity, season, avg(yards) AS avg_yards, count(*) AS weeks_active FROM panel GROUP BY entity, season) SELECT s.entity, s.season, s.avg_yards, l.avg_yards AS last_season_avg_yards, "
    "l.weeks_active AS last_season_weeks_active, t.avg_yards AS two_seasons_ago_avg_yards, t.weeks_active AS two_seasons_ago_weeks_active FROM s LEFT JOIN s l ON l.entity = s.entity AND l.season = s.season - 1 LEFT JOIN s t ON t.entity = s.entity AND t.season = s.season - 2",
    "panel",
    "avg_yards last_season_avg_yards two_seasons_ago_avg_yards",
)
def j6(spark, d):
    df = D.panel(spark, d).groupBy("entity", "season").agg(F.avg("yards").alias("avg_yards"), F.count("*").alias("weeks_active"))
    out = J.lag_periods(df, ["entity"], "season", ["avg_yards", "weeks_active"], {1: "last_season_", 2: "two_seasons_ago_"})
    return out.drop("weeks_active")


@query(
    "j7_same_group_pairs",
    "SELECT a.season, a.week, a.team, count(*) AS n_pairs, sum(a.yards * b.yards) AS sum_products, sum(a.yards * b.yards) / count(*) AS mean_product FROM panel a JOIN panel b ON a.season = b.season AND a.week = b.week AND a.team = b.team AND a.entity <> b.entity GROUP BY ALL",
    "panel",
    "sum_products mean_product",
)
def j7(spark, d):
    return J.pair_summary(D.panel(spark, d), ["season", "week", "team"], "yards")


@query(
    "j7_opposing_pairs",
    "SELECT a.season, a.week, a.team, a.opponent, count(*) AS n_pairs, sum(a.yards * b.yards) AS sum_products FROM panel a JOIN panel b ON a.season = b.season AND a.week = b.week AND a.opponent = b.team GROUP BY ALL",
    "panel",
    "sum_products",
)
def j7_opposing(spark, d):
    return J.opposing_summary(D.panel(spark, d), ["season", "week"], "team", "opponent", "yards")


@query(
    "j8_context_join",
    "WITH qb AS (SELECT season, team, arg_max(entity, (week, entity)) AS qb_id FROM panel WHERE position = 'QB' GROUP BY season, team), s AS (SELECT entity, season, avg(yards) AS avg_yards FROM panel GROUP BY entity, season), "
    "r AS (SELECT p.entity, p.season, p.week, CASE WHEN p.urgent > 0 THEN NULL ELSE qb_id END AS listed, p.entity AS own FROM panel p LEFT JOIN qb ON qb.season = p.season AND qb.team = p.team WHERE position <> 'QB') "
    "SELECT r.entity, r.season, r.week, coalesce(listed, own) AS team_qb_id_used, s.avg_yards AS avg_yards_this_qb FROM r LEFT JOIN s ON s.entity = coalesce(listed, own) AND s.season = r.season",
    "panel",
    "avg_yards_this_qb",
)
def j8(spark, d):
    panel = D.panel(spark, d)
    starters = panel.where("position = 'QB'").groupBy("season", "team").agg(F.max_by("entity", F.struct("week", "entity")).alias("qb_id"))
    stats = panel.groupBy("entity", "season").agg(F.avg("yards").alias("avg_yards"))
    receivers = panel.where("position <> 'QB'").join(starters, ["season", "team"], "left").select(
        "entity", "season", "week", F.when(~(F.col("urgent") > 0), F.col("qb_id")).alias("team_qb_id"), F.col("entity").alias("own")
    )
    out = J.context_join(receivers, stats, "team_qb_id", "own", "entity", ["season"], {"avg_yards": "avg_yards_this_qb"})
    return out.select("entity", "season", "week", "team_qb_id_used", "avg_yards_this_qb")


@query(
    "j9_semi_join",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
)
def j9(spark, d):
    keys = D.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return D.table(spark, d, "customer").select("c_custkey", "c_name").join(keys, "c_custkey", "left_semi")


@query(
    "j9_anti_join",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
)
def j9_anti(spark, d):
    keys = D.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return D.table(spark, d, "customer").select("c_custkey", "c_name").join(keys, "c_custkey", "left_anti")


@query(
    "j10_entity_resolution",
    f"WITH l AS (SELECT event_id, {NAME_SQL.format(c='raw')} AS k FROM (SELECT event_id, 'CUSTOMER#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || CASE k % 2 WHEN 0 THEN ' Jr.' ELSE ' (prop)' END AS raw FROM lines)), "
    "a AS (SELECT event_id, CASE WHEN k LIKE '%5' THEN 'customer000000000' ELSE k END AS k FROM l) "
    f"SELECT event_id, k AS name_key, c_custkey FROM a LEFT JOIN customer ON {NAME_SQL.format(c='c_name')} = k",
    "lines",
)
def j10(spark, d):
    left = D.lines(spark, d).select(
        "event_id",
        F.expr("concat('CUSTOMER#', lpad(CAST(user_id AS string), 9, '0'), CASE k % 2 WHEN 0 THEN ' Jr.' ELSE ' (prop)' END)").alias("raw"),
    )
    customers = D.table(spark, d, "customer").select("c_custkey", "c_name")
    aliases = customers.select(C.name_key("c_name").alias("alias"), F.lit("customer000000000").alias("name")).where("alias LIKE '%5'")
    out = J.resolve_names(left, C.name_key("raw"), customers, C.name_key("c_name"), aliases)
    return out.select("event_id", "name_key", "c_custkey")


@query(
    "j10_unmatched_report",
    "SELECT user_id, count(*) AS n FROM events WHERE user_id * 11 NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id",
)
def j10_unmatched(spark, d):
    wanted = D.table(spark, d, "events").select("user_id", (F.col("user_id") * 11).alias("c_custkey"))
    return wanted.join(D.table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


_WORDS_SQL = "trim(regexp_replace(lower({c}), '[^a-zà-ÿ]+', ' ', 'g'))"


@query(
    "j11_dictionary_match",
    f"WITH names AS (SELECT DISTINCT k AS name_key FROM (SELECT {_WORDS_SQL.format(c='phrase')} AS k FROM (SELECT array_to_string(string_split({_WORDS_SQL.format(c='text')}, ' ')[1:2], ' ') AS phrase FROM benchmark)) WHERE k <> ''), "
    f"t AS (SELECT doc_id, ' ' || {_WORDS_SQL.format(c='text')} || ' ' AS w FROM documents) SELECT doc_id, name_key FROM t JOIN names ON contains(w, ' ' || name_key || ' ')",
)
def j11(spark, d):
    names = D.table(spark, d, "benchmark").select(F.array_join(F.slice(J.plain_words("text"), 1, 2), " ").alias("phrase"))
    return J.dictionary_matches(D.table(spark, d, "documents"), ["doc_id"], "text", names, "phrase")


@query(
    "j12_as_of_version",
    "WITH v AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS max_year, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1, 2) "
    "SELECT DISTINCT p.entity, p.season, v.max_year AS version_period, v.o_orderkey FROM (SELECT DISTINCT entity, season FROM panel) p LEFT JOIN v ON v.entity = p.entity AND v.max_year = (SELECT max(x.max_year) FROM v x WHERE x.entity = p.entity AND x.max_year <= p.season - 1)",
    "panel",
)
def j12(spark, d):
    versions = D.table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("bigint").alias("max_year"), "o_orderdate", "o_orderkey"
    )
    seasons = D.panel(spark, d).select("entity", "season").distinct()
    return J.as_of(seasons, versions, ["entity"], "season", "max_year", ["o_orderdate", "o_orderkey"], ["o_orderkey"])


@query(
    "j14_contract_violations",
    "SELECT 'duplicate line' AS contract, l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'discount out of range', l_orderkey, 1 FROM lineitem WHERE l_discount IS NULL OR NOT l_discount BETWEEN 0.01 AND 0.09",
)
def j14(spark, d):
    lines = D.table(spark, d, "lineitem")
    doubled = J.duplicate_keys(lines.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    outside = J.out_of_range(lines.select("l_orderkey", "l_discount"), "l_discount", 0.01, 0.09)
    return doubled.select(F.lit("duplicate line").alias("contract"), F.col("l_orderkey").alias("id"), "n").unionByName(
        outside.select(F.lit("discount out of range").alias("contract"), F.col("l_orderkey").alias("id"), F.lit(1).cast("bigint").alias("n"))
    )
