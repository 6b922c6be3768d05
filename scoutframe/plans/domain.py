"""Views of the test tables in the shape of the library's domain.

Each view exists twice: as a DataFrame for the queries and as SQL text for the
checks.  Measures are whole numbers where possible, so that sums are exact in
every engine and in every order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEAMS = 25

# Ladders of thresholds per bet family.
PASSING_LADDER = [150, 180, 210, 240, 270, 300, 330, 360]
YARD_LADDER = [25, 40, 60, 80, 100, 120, 140]
COMBINED_LADDER = [40, 70, 100, 130]
RECEPTION_LADDER = [4, 6, 8, 10]
SPREAD_LADDER = [-7.5, -6.5, -3.5, -2.5, 2.5, 3.5, 6.5, 7.5]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def period_columns(ts: str) -> list[Column]:
    return [
        F.year(ts).cast("bigint").alias("season"),
        F.expr(f"(dayofyear({ts}) - 1) div 7 + 1").cast("bigint").alias("week"),
    ]


def _opponent(week: str, team: str) -> str:
    return f"pmod(7 * {week} - {team}, {TEAMS})"


_POSITION = "CASE pmod({e}, 4) WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' ELSE 'TE' END"


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per player and week: the fact rows are combined before any window."""
    orders = table(spark, folder, "orders")
    weekly = (
        orders.select(
            F.col("o_custkey").alias("entity"),
            *period_columns("o_orderdate"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
            "o_orderstatus",
            "o_orderpriority",
        )
        .groupBy("entity", "season", "week")
        .agg(
            F.expr("sum(cents) div 100000").cast("double").alias("yards"),
            F.expr("sum(cents) FILTER (WHERE o_orderstatus = 'F') div 100000").cast("double").alias("air"),
            F.count("*").alias("touches"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        )
    )
    placed = weekly.select(
        "*",
        F.expr(_POSITION.format(e="entity")).alias("position"),
        F.expr(f"pmod(entity + (season * 53 + week) div 40, {TEAMS})").alias("team"),
    )
    return placed.withColumn("opponent", F.expr(_opponent("week", "team")))


def teams(spark: SparkSession, folder: str) -> DataFrame:
    """One row per team and week."""
    orders = table(spark, folder, "orders").select(
        "o_custkey",
        *period_columns("o_orderdate"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        "o_orderstatus",
        "o_orderpriority",
    )
    homes = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("team")
    )
    weekly = (
        orders.join(homes, "o_custkey")
        .groupBy("season", "week", "team")
        .agg(
            F.expr("sum(cents) div 100000").cast("double").alias("yards"),
            F.expr("sum(cents) FILTER (WHERE o_orderstatus = 'F') div 100000").cast("double").alias("air"),
            F.count("*").alias("plays"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        )
    )
    return weekly.select(
        "season", "week", "team", F.expr(_opponent("week", "team")).alias("opponent"),
        "yards", "air", "plays", "urgent", (F.col("plays") * 3 + F.col("urgent")).alias("score"),
    )


def games(spark: SparkSession, folder: str) -> DataFrame:
    """One row per game, with a home and an away side."""
    side = teams(spark, folder).where("team <> opponent")
    away = side.select(
        "season", "week", F.col("team").alias("away"), F.col("score").alias("away_score"),
        F.col("yards").alias("away_yards"),
    )
    home = side.select(
        "season", "week", F.col("team").alias("home"), F.col("opponent").alias("away"),
        F.col("score").alias("home_score"), F.col("yards").alias("home_yards"),
    ).where("home < away")
    return home.join(away, ["season", "week", "away"]).select(
        F.concat_ws("_", "season", "week", "home", "away").alias("game_id"),
        "season", "week", "home", "away", "home_score", "away_score", "home_yards", "away_yards",
    )


def plays(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_partkey").alias("play_id"),
        F.col("l_suppkey").alias("drive"),
        F.expr(f"l_suppkey % {TEAMS}").alias("posteam"),
        F.expr("CAST(l_quantity AS bigint) * 2 - 1").alias("yardline_100"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'pass' WHEN 'A' THEN 'run' ELSE 'punt' END").alias("play_type"),
        (F.col("l_linestatus") == "F").alias("touchdown"),
        F.expr("CAST(l_linenumber AS bigint)").alias("down"),
        F.expr("CAST(round(l_discount * 100) AS bigint)").alias("rushers"),
        F.expr("CAST(round(l_tax * 100) AS bigint)").alias("blitzers"),
        F.expr("concat(lpad(CAST(CAST(l_quantity AS int) % 12 AS string), 2, '0'), ':', "
               "lpad(CAST(l_partkey % 60 AS string), 2, '0'))").alias("possession"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Odds snapshots: many per market, newest counts."""
    return (
        table(spark, folder, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
        .select(
            "event_id", "user_id", "event_type", F.col("ts").alias("run_time"), "k",
            F.expr("CASE WHEN k % 3 = 0 THEN '−' ELSE '+' END || CAST(100 + CAST(floor(value * 10) AS bigint) AS string)")
            .alias("american_odds"),
            F.expr("CAST(k AS double) / 2 - 25").alias("points"),
            F.expr("date_trunc('DAY', ts) + INTERVAL 18 HOURS").alias("start_time"),
            F.expr("CAST(floor(value * 10) AS bigint) + 100").alias("price"),
        )
    )


def bets(spark: SparkSession, folder: str) -> DataFrame:
    """Priced predictions with a known outcome; narrow, one row per line item."""
    base = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("bet_id"),
        F.col("l_partkey").alias("player"),
        *period_columns("l_shipdate"),
        F.expr(f"l_suppkey % {TEAMS}").alias("team"),
        F.expr("(l_partkey + l_linenumber) % 8").alias("family"),
        F.expr("CAST(l_quantity AS bigint)").alias("q"),
        F.expr("CAST(floor(l_extendedprice) AS bigint)").alias("e"),
        (F.col("l_returnflag") == "R").alias("bet_hit"),
        F.expr("dayofweek(l_shipdate)").cast("bigint").alias("day_of_week"),
        F.expr(_POSITION.format(e="l_partkey")).alias("player_position"),
    )

    # all target codes in one list; a family starts at its offset and cycles through its rungs
    families = [
        [f"passing_yards_{_code(n)}" for n in PASSING_LADDER], [f"rushing_yards_{_code(n)}" for n in YARD_LADDER],
        [f"receiving_yards_{_code(n)}" for n in YARD_LADDER], [f"receptions_{_code(n)}" for n in RECEPTION_LADDER],
        [f"rushing_receiving_yards_{_code(n)}" for n in COMBINED_LADDER], ["anytime_td_scorer"], ["team_win"],
        [f"team_differential_{_code(n)}" for n in SPREAD_LADDER],
    ]
    sizes = [len(f) for f in families]
    offsets = [sum(sizes[:i]) for i in range(len(sizes))]
    codes = F.array(*[F.lit(c) for f in families for c in f])
    place = F.expr(
        f"CAST(element_at(array({', '.join(map(str, offsets))}), CAST(family + 1 AS int)) + q % element_at(array({', '.join(map(str, sizes))}), CAST(family + 1 AS int)) + 1 AS int)"
    )
    return base.select(
        "bet_id", "season", "week",
        F.expr("CASE WHEN family >= 6 THEN concat('T', team) ELSE concat('P', player) END").alias("label"),
        F.expr("CASE WHEN family >= 6 THEN 'team' ELSE player_position END").alias("position"),
        "team", F.expr(_opponent("week", "team")).alias("opponent"),
        F.element_at(codes, place).alias("response_var"),
        (F.col("q") / F.lit(51.0)).alias("p"),
        F.expr("CAST(CASE WHEN e % 4 = 0 THEN -(105 + e % 300) ELSE 100 + (e % 50) * (e % 50) END AS double)").alias("odds"),
        "bet_hit", "day_of_week", "q",
    )


def _code(n: float) -> str:
    return ("minus" if n < 0 else "") + f"{abs(n):g}"


# name -> (views it reads, SQL body)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _period_sql(ts: str) -> str:
    return (f"CAST(year({ts}) AS BIGINT) AS season, "
            f"CAST((dayofyear({ts}) - 1) // 7 + 1 AS BIGINT) AS week")


def _opponent_sql(week: str, team: str) -> str:
    return f"((7 * {week} - {team}) % {TEAMS} + {TEAMS}) % {TEAMS}"


SQL_VIEWS["panel"] = (
    (),
    f"""
  SELECT *, {_opponent_sql('week', 'team')} AS opponent FROM (
    SELECT *, CASE entity % 4 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' ELSE 'TE' END AS position,
           (entity + (season * 53 + week) // 40) % {TEAMS} AS team
    FROM (
      SELECT entity, season, week,
             CAST(CAST(sum(cents) AS BIGINT) // 100000 AS DOUBLE) AS yards,
             CAST(CAST(sum(cents) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) // 100000 AS DOUBLE) AS air,
             count(*) AS touches,
             count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
      FROM (SELECT o_custkey AS entity, {_period_sql('o_orderdate')},
                   CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus, o_orderpriority
            FROM orders)
      GROUP BY entity, season, week))
""",
)

SQL_VIEWS["teams"] = (
    (),
    f"""
  SELECT season, week, team, {_opponent_sql('week', 'team')} AS opponent, yards, air, plays, urgent,
         plays * 3 + urgent AS score
  FROM (
    SELECT season, week, team,
           CAST(CAST(sum(cents) AS BIGINT) // 100000 AS DOUBLE) AS yards,
           CAST(CAST(sum(cents) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) // 100000 AS DOUBLE) AS air,
           count(*) AS plays,
           count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
    FROM (SELECT CAST(c_nationkey AS BIGINT) AS team, {_period_sql('o_orderdate')},
                 CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus, o_orderpriority
          FROM orders JOIN customer ON o_custkey = c_custkey)
    GROUP BY season, week, team)
""",
)

SQL_VIEWS["games"] = (
    ("teams",),
    """
  SELECT concat_ws('_', h.season, h.week, h.team, a.team) AS game_id, h.season, h.week,
         h.team AS home, a.team AS away, h.score AS home_score, a.score AS away_score,
         h.yards AS home_yards, a.yards AS away_yards
  FROM teams h JOIN teams a ON h.season = a.season AND h.week = a.week AND h.opponent = a.team
  WHERE h.team < a.team
""",
)

SQL_VIEWS["plays"] = (
    (),
    f"""
  SELECT l_orderkey AS game_id, l_partkey AS play_id, l_suppkey AS drive, l_suppkey % {TEAMS} AS posteam,
         CAST(l_quantity AS BIGINT) * 2 - 1 AS yardline_100,
         CASE l_returnflag WHEN 'R' THEN 'pass' WHEN 'A' THEN 'run' ELSE 'punt' END AS play_type,
         l_linestatus = 'F' AS touchdown, CAST(l_linenumber AS BIGINT) AS down,
         CAST(round(l_discount * 100) AS BIGINT) AS rushers, CAST(round(l_tax * 100) AS BIGINT) AS blitzers,
         lpad(CAST(CAST(l_quantity AS INTEGER) % 12 AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') AS possession
  FROM lineitem
""",
)

SQL_VIEWS["lines"] = (
    (),
    """
  SELECT event_id, user_id, event_type, ts AS run_time, k,
         CASE WHEN k % 3 = 0 THEN '−' ELSE '+' END || CAST(100 + CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS american_odds,
         CAST(k AS DOUBLE) / 2 - 25 AS points,
         date_trunc('day', ts) + INTERVAL 18 HOUR AS start_time,
         CAST(floor(value * 10) AS BIGINT) + 100 AS price
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""",
)

SQL_VIEWS["bets"] = (
    (),
    f"""
  SELECT bet_id, season, week,
         CASE WHEN family >= 6 THEN 'T' || team ELSE 'P' || player END AS label,
         CASE WHEN family >= 6 THEN 'team' ELSE player_position END AS position,
         team, {_opponent_sql('week', 'team')} AS opponent,
         CASE family WHEN 0 THEN 'passing_yards_' || CAST(number AS INTEGER)
              WHEN 1 THEN 'rushing_yards_' || CAST(number AS INTEGER)
              WHEN 2 THEN 'receiving_yards_' || CAST(number AS INTEGER)
              WHEN 3 THEN 'receptions_' || CAST(number AS INTEGER)
              WHEN 4 THEN 'rushing_receiving_yards_' || CAST(number AS INTEGER)
              WHEN 5 THEN 'anytime_td_scorer' WHEN 6 THEN 'team_win'
              ELSE 'team_differential_' || CASE WHEN number < 0 THEN 'minus' ELSE '' END || CAST(abs(number) AS VARCHAR) END AS response_var,
         q / CAST(51.0 AS DOUBLE) AS p,
         CAST(CASE WHEN e % 4 = 0 THEN -(105 + e % 300) ELSE 100 + (e % 50) * (e % 50) END AS DOUBLE) AS odds,
         bet_hit, day_of_week, q
  FROM (
    SELECT *, CAST(CASE family
        WHEN 0 THEN {PASSING_LADDER}[CAST(q % {len(PASSING_LADDER)} + 1 AS INTEGER)]
        WHEN 1 THEN {YARD_LADDER}[CAST(q % {len(YARD_LADDER)} + 1 AS INTEGER)]
        WHEN 2 THEN {YARD_LADDER}[CAST(q % {len(YARD_LADDER)} + 1 AS INTEGER)]
        WHEN 3 THEN {RECEPTION_LADDER}[CAST(q % {len(RECEPTION_LADDER)} + 1 AS INTEGER)]
        WHEN 4 THEN {COMBINED_LADDER}[CAST(q % {len(COMBINED_LADDER)} + 1 AS INTEGER)]
        WHEN 7 THEN {SPREAD_LADDER}[CAST(q % {len(SPREAD_LADDER)} + 1 AS INTEGER)] END AS DOUBLE) AS number
    FROM (
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS bet_id, l_partkey AS player,
             {_period_sql('l_shipdate')}, l_suppkey % {TEAMS} AS team,
             (l_partkey + l_linenumber) % 8 AS family, CAST(l_quantity AS BIGINT) AS q,
             CAST(floor(l_extendedprice) AS BIGINT) AS e, l_returnflag = 'R' AS bet_hit,
             CAST(dayofweek(l_shipdate) + 1 AS BIGINT) AS day_of_week,
             CASE l_partkey % 4 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' ELSE 'TE' END AS player_position
      FROM lineitem))
""",
)
