"""Column-function queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from . import domain as D
from .aggregates import BIN_SQL, CATEGORY_SQL, EV_BAND_SQL, EV_SQL, IMPLIED_SQL, ODDS_BAND_SQL
from .registry import query

NAME_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\([^)]*\\)', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}} ]+', '', 'g'), "
    "'\\b(jr|sr|i{{1,3}}|iv|v|vi{{1,3}}|ix|x|xi{{1,3}})\\b', '', 'g'), ' +', ' ', 'g'))"
)


@query(
    "c1_name_key",
    f"SELECT p_partkey, {NAME_SQL.format(c='raw')} AS name_key FROM (SELECT p_partkey, p_name || ' (' || p_type || ') O''Neil-' || p_brand || CASE p_size % 3 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' ELSE '' END AS raw FROM part)",
)
def c1(spark, d):
    raw = F.expr("concat(p_name, ' (', p_type, ') O\\'Neil-', p_brand, CASE p_size % 3 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' ELSE '' END)")
    return D.table(spark, d, "part").select("p_partkey", C.name_key(raw).alias("name_key"))


@query(
    "c2_status_flags",
    "SELECT *, CAST(won AS DOUBLE) / nullif(won + lost, 0) AS win_share FROM (SELECT s_suppkey, marker = 'x' AS division_clinched_playoff, marker = 'y' AS division_clinched_division, marker = 'z' AS division_clinched_seed1, marker = 'e' AS division_eliminated, marker = 'k' AS division_eliminated_division, regexp_matches(marker, '[xyz]') AS clinched_playoff, regexp_matches(marker, '[yz]') AS clinched_division, contains(marker, 'z') AS clinched_seed1, "
    "contains(marker, 'e') AS eliminated, regexp_matches(marker, '[ke]') AS eliminated_division, 'NATION' AS team_code, s_suppkey % 7 AS won, s_suppkey % 5 AS lost FROM (SELECT s_suppkey, substr('xyzek', CAST(s_suppkey % 6 + 1 AS INTEGER), 1) AS marker FROM supplier))",
    doubles="win_share",
)
def c2(spark, d):
    tagged = D.table(spark, d, "supplier").select(
        "s_suppkey",
        F.expr("concat(substring('xyzek', CAST(s_suppkey % 6 + 1 AS int), 1), ' - NATION')").alias("team"),
        F.expr("concat(s_suppkey % 7, '-', s_suppkey % 5)").alias("record"),
    )
    return tagged.select(
        "s_suppkey", *[c.alias(n) for n, c in C.status_flags("team").items()],
        *[c.alias(f"division_{n}") for n, c in C.status_flags("team", division_table=True).items() if n != "team_code"],
        C.record_share("record").alias("win_share"),
        F.split("record", "-")[0].cast("bigint").alias("won"),
        F.split("record", "-")[1].cast("bigint").alias("lost"),
    )


@query(
    "c3_keyword_flags",
    f"SELECT doc_id, regexp_matches(lower(text), '{C.ILLNESS_WORDS}') AS illness, regexp_matches(lower(text), '{C.NOT_INJURY_WORDS}') AS not_injury_related, regexp_matches(lower(text), '{C.CONFERENCE_WORDS}') AS conference FROM documents",
)
def c3(spark, d):
    return D.table(spark, d, "documents").select(
        "doc_id",
        C.mentions("text", C.ILLNESS_WORDS).alias("illness"),
        C.mentions("text", C.NOT_INJURY_WORDS).alias("not_injury_related"),
        C.mentions("text", C.CONFERENCE_WORDS).alias("conference"),
    )


@query(
    "c4_season_from_month",
    "SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) < 3 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS BIGINT) AS season, CAST(CASE WHEN month(o_orderdate) >= 3 OR o_orderkey % 3 = 0 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS BIGINT) AS posted_season FROM orders",
)
def c4(spark, d):
    return D.table(spark, d, "orders").select(
        "o_orderkey", C.season_of("o_orderdate").alias("season"),
        C.posted_season("o_orderdate", F.when(F.col("o_orderkey") % 6 == 0, 0).when(F.col("o_orderkey") % 3 != 0, 5)).alias("posted_season"),
    )


@query(
    "c5_age_and_birthday",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', CAST(born AS DATE), CAST(l_shipdate AS DATE)) / CAST(365.0 AS DOUBLE) AS age, strftime(l_shipdate, '%m-%d') = strftime(born, '%m-%d') AS on_birthday "
    "FROM (SELECT *, DATE '1970-01-01' + CAST(l_partkey AS INTEGER) AS born FROM lineitem)",
    doubles="age",
)
def c5(spark, d):
    df = D.table(spark, d, "lineitem").withColumn("born", F.date_add(F.lit("1970-01-01").cast("date"), F.col("l_partkey").cast("int")))
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        C.age_years("l_shipdate", "born").alias("age"), C.on_birthday("l_shipdate", "born").alias("on_birthday"),
    )


@query(
    "c6_time_zones",
    "SELECT event_id, CAST(CAST(timezone('America/New_York', timezone('UTC', run_time)) AS DATE) AS VARCHAR) AS gameday, (epoch_us(start_time) - epoch_us(run_time)) / CAST(60000000.0 AS DOUBLE) AS minutes_before_start FROM lines",
    "lines",
    "minutes_before_start",
    digits=10,
)
def c6(spark, d):
    return D.lines(spark, d).select(
        "event_id",
        C.local_day("run_time", "America/New_York").cast("string").alias("gameday"),
        C.minutes_before("run_time", "start_time").alias("minutes_before_start"),
    )


@query(
    "c7_odds_algebra",
    "SELECT event_id, odds, CASE WHEN odds > 0 THEN odds ELSE 10000.0 / -odds END AS profit_per_100, "
    f"{IMPLIED_SQL} AS implied_probability, 50.0 * (1.0 + (CASE WHEN odds > 0 THEN odds ELSE 10000.0 / -odds END) / 100.0) AS payout_of_50 "
    "FROM (SELECT event_id, CAST(replace(replace(american_odds, '−', '-'), '+', '') AS DOUBLE) AS odds FROM lines)",
    "lines",
    "odds profit_per_100 implied_probability payout_of_50",
)
def c7(spark, d):
    df = D.lines(spark, d).select("event_id", C.american_to_number("american_odds").alias("odds"))
    return df.select(
        "event_id", "odds", C.profit_per_100("odds").alias("profit_per_100"),
        C.implied_probability("odds").alias("implied_probability"), C.payout(F.lit(50.0), "odds").alias("payout_of_50"),
    )


@query(
    "c8_probability_bins",
    f"SELECT bet_id, fl / CAST(10000.0 AS DOUBLE) AS probability_floor, (fl + wd) / CAST(10000.0 AS DOUBLE) AS probability_ceiling, (fl // 100) || '% to ' || ((fl + wd) // 100) || '%' AS probability_range FROM ({BIN_SQL.format(src='bets')})",
    "bets",
    "probability_floor probability_ceiling",
)
def c8(spark, d):
    out = C.with_probability_bin(D.bets(spark, d), "p")
    return out.select("bet_id", "probability_floor", "probability_ceiling", "probability_range")


@query(
    "c9_bands",
    f"SELECT bet_id, {ODDS_BAND_SQL} AS odds_band, {EV_BAND_SQL} AS ev_band, CASE WHEN q <= 10 THEN 'low' WHEN q <= 40 THEN 'mid' ELSE 'high' END AS q_right, CASE WHEN q < 10 THEN 'low' WHEN q < 40 THEN 'mid' ELSE 'high' END AS q_left, "
    "CASE WHEN q < 10 THEN 0 WHEN q < 40 THEN 1 ELSE 2 END AS q_order FROM (SELECT *, " + EV_SQL + " AS ev FROM bets)",
    "bets",
)
def c9(spark, d):
    left, order = C.cut("q", [10, 40], ["low", "mid", "high"], right=False)
    return D.bets(spark, d).select(
        "bet_id", C.odds_band("odds")[0].alias("odds_band"), C.ev_band(C.expected_value("p", "odds"))[0].alias("ev_band"),
        C.cut("q", [10, 40], ["low", "mid", "high"])[0].alias("q_right"), left.alias("q_left"), order.alias("q_order"),
    )


@query(
    "c10_target_codes",
    "SELECT bet_id, root, number, CASE WHEN number IS NULL THEN NULL ELSE root || '_' || CASE WHEN number < 0 THEN 'minus' ELSE '' END || CASE WHEN abs(number) = floor(abs(number)) THEN CAST(CAST(abs(number) AS BIGINT) AS VARCHAR) ELSE CAST(abs(number) AS VARCHAR) END END AS code, "
    f"CASE WHEN response_var IN ('anytime_td_scorer', 'team_win') THEN response_var ELSE regexp_replace(response_var, '_[^_]*$', '') END AS bet_type, {CATEGORY_SQL} AS category FROM ("
    "SELECT *, regexp_replace(response_var, '_(minus)?[0-9]+([.][0-9]+)?$', '') AS root, CAST(nullif(regexp_extract(replace(response_var, 'minus', '-'), '-?[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS number FROM bets)",
    "bets",
    "number",
)
def c10(spark, d):
    df = D.bets(spark, d).select(
        "bet_id", "response_var", C.ladder_root("response_var").alias("root"), C.ladder_number("response_var").alias("number")
    )
    return df.select(
        "bet_id", "root", "number", C.ladder_code("root", "number").alias("code"),
        C.bet_type("response_var").alias("bet_type"), C.bet_category("response_var").alias("category"),
    )


@query(
    "c11_ratio_features",
    "SELECT entity, season, week, yards / nullif(touches, 0) AS yards_per_touch, air / nullif(yards, 0) AS air_share, CAST(touches AS DOUBLE) / nullif(urgent, 0) AS touches_per_urgent, "
    "CASE WHEN count(*) OVER w = 3 THEN coalesce(sum(yards) OVER w, 0) / nullif(coalesce(sum(touches) OVER w, 0), 0) END AS last3_cumulative_yards_per_touch FROM panel WINDOW w AS (PARTITION BY entity ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
    "panel",
    "yards_per_touch air_share touches_per_urgent last3_cumulative_yards_per_touch",
)
def c11(spark, d):
    from ..operators.windows import prior_stats

    spec = {
        "yards_per_touch": ("yards", "touches"),
        "air_share": ("air", "yards"),
        "touches_per_urgent": ("touches", "urgent"),
        "not_there": ("yards", "missing_column"),
    }
    df = prior_stats(D.panel(spark, d), ["entity"], ["season", "week"], ["yards", "touches"], sums_only=True)
    ratios = C.ratio_columns(spec, df.columns, last="last3_cumulative_")
    return df.select("entity", "season", "week", *ratios)


@query(
    "c12_composite_scores",
    "SELECT game_id, play_id, drive, down, CAST(rushers + blitzers AS DOUBLE) AS pressure, 0.7 * rushers + 0.3 * blitzers AS opportunity_rating, CAST(yardline_100 AS DOUBLE) * down AS weighted_total FROM plays",
    "plays",
    "pressure opportunity_rating weighted_total",
)
def c12(spark, d):
    return D.plays(spark, d).select(
        "game_id", "play_id", "drive", "down",
        (F.col("rushers") + F.col("blitzers")).cast("double").alias("pressure"),
        (0.7 * F.col("rushers") + 0.3 * F.col("blitzers")).alias("opportunity_rating"),
        (F.col("yardline_100").cast("double") * F.col("down")).alias("weighted_total"),
    )


@query(
    "c13_pair_key",
    "SELECT game, count(*) AS n FROM (SELECT least(CAST(team AS VARCHAR), CAST(opponent AS VARCHAR)) || '-' || greatest(CAST(team AS VARCHAR), CAST(opponent AS VARCHAR)) AS game FROM bets) GROUP BY game",
    "bets",
)
def c13(spark, d):
    return D.bets(spark, d).groupBy(C.pair_key("team", "opponent").alias("game")).agg(F.count("*").alias("n"))


@query(
    "c14_json_features",
    "SELECT event_id, k AS intent_score, event_type AS feature, unnest([0, 1]) AS position, k + unnest([0, 1]) AS weight FROM lines",
    "lines",
)
def c14(spark, d):
    # text around the object, as a chat model returns it
    raw = F.concat(
        F.lit("Result: {\"team_intent\": {\"score\": "), F.col("k"), F.lit("}, \"player_features\": [{\"name\": \""), "event_type",
        F.lit("\", \"weight\": "), F.col("k"), F.lit("}, {\"name\": \""), "event_type", F.lit("\", \"weight\": "), F.col("k") + 1, F.lit("}]} done"),
    )
    schema = "team_intent STRUCT<score: BIGINT>, player_features ARRAY<STRUCT<name: STRING, weight: BIGINT>>"
    parsed = D.lines(spark, d).select(
        "event_id", F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema).alias("doc")
    )
    return parsed.select(
        "event_id", F.col("doc.team_intent.score").alias("intent_score"), F.posexplode("doc.player_features").alias("position", "f")
    ).select("event_id", "intent_score", "position", F.col("f.name").alias("feature"), F.col("f.weight").alias("weight"))


@query(
    "c15_text_templates",
    "SELECT entity, season, week, concat_ws('; ', 'W' || week || ' vs ' || opponent, CAST(CAST(yards AS BIGINT) AS VARCHAR) || ' yards', CASE WHEN air IS NOT NULL THEN CAST(CAST(air AS BIGINT) AS VARCHAR) || ' in the air' END) AS note, coalesce(printf('%.1f', air / touches), '') AS air_text FROM panel",
    "panel",
)
def c15(spark, d):
    def whole(c):
        return F.col(c).cast("bigint").cast("string")

    return D.panel(spark, d).select(
        "entity", "season", "week",
        F.concat_ws(
            "; ", F.concat(F.lit("W"), "week", F.lit(" vs "), "opponent"), F.concat(whole("yards"), F.lit(" yards")),
            F.concat(whole("air"), F.lit(" in the air")),
        ).alias("note"),
        F.coalesce(F.when(F.col("air").isNotNull(), F.format_string("%.1f", F.col("air") / F.col("touches"))), F.lit("")).alias("air_text"),
    )


@query(
    "c16_row_spread",
    "SELECT entity, season, week, greatest(yards, air, CAST(touches AS DOUBLE)) - least(yards, air, CAST(touches AS DOUBLE)) AS spread, CAST((yards IS NOT NULL)::INT + (air IS NOT NULL)::INT + (touches IS NOT NULL)::INT AS BIGINT) AS available FROM panel",
    "panel",
    "spread",
)
def c16(spark, d):
    cols = ["yards", "air", "touches"]
    df = D.panel(spark, d).withColumn("touches", F.col("touches").cast("double"))
    return df.select("entity", "season", "week", C.row_spread(cols).alias("spread"), C.non_null_count(cols).alias("available"))
