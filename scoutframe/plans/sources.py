"""Source and sink queries (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as S
from . import domain as D
from .registry import query


@query(
    "s1_read_seasons",
    "SELECT CAST(year(o_orderdate) AS BIGINT) AS season, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999 GROUP BY 1",
)
def s1(spark, d):
    df = S.read_seasons(spark, f"{d}/orders.parquet", 1997, 1999, stamp="o_orderdate")
    return df.groupBy(F.year("o_orderdate").cast("bigint").alias("season")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    )


@query(
    "s2_read_table",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def s2(spark, d):
    return S.read_table(
        spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_custkey"],
        equals={"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]},
    )


@query(
    "s3_keyset_page",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey) > (100, 3, 50) ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 500",
)
def s3(spark, d):
    df = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return S.keyset_page(df, ["l_orderkey", "l_linenumber", "l_partkey"], (100, 3, 50), 500)


@query("s4_append", "SELECT n_regionkey, 2 * count(*) AS n FROM nation GROUP BY n_regionkey")
def s4(spark, d):
    path = S.scratch_path(spark, "append")
    nation = D.table(spark, d, "nation")
    S.append(nation, path)
    S.append(nation, path)
    return spark.read.schema(nation.schema).parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query(
    "s5_upsert",
    "WITH u AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey + 100000000, 'N', o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'), "
    "best AS (SELECT o_orderkey, arg_max(o_orderstatus, o_totalprice) AS o_orderstatus, max(o_totalprice) AS o_totalprice FROM u GROUP BY o_orderkey) "
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM best) UNION ALL SELECT * FROM best",
    doubles="o_totalprice",
)
def s5(spark, d):
    orders = D.table(spark, d, "orders")
    target = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(*target.columns)
    fresh = orders.where("o_orderpriority = '2-HIGH'").selectExpr("o_orderkey + 100000000 AS o_orderkey", "'N' AS o_orderstatus", "o_totalprice")
    updates = urgent.withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(urgent).unionByName(fresh)
    return S.upsert(target, updates, ["o_orderkey"], newest=["o_totalprice"])


_SPLIT = "CASE WHEN season <= 1998 THEN 'train' WHEN season = 1999 THEN 'validation' ELSE 'holdout' END"


@query(
    "s6_write_by_target",
    f"SELECT response_var, {_SPLIT} AS split, count(*) AS n FROM bets GROUP BY 1, 2",
    "bets",
)
def s6(spark, d):
    path = S.scratch_path(spark, "targets")
    data = D.bets(spark, d).select("response_var", F.expr(_SPLIT).alias("split"), "label", "p", "bet_hit")
    S.write_by_target(data, path)
    return spark.read.schema(data.schema).parquet(path).groupBy("response_var", "split").agg(F.count("*").alias("n"))


@query(
    "s7_nested_odds",
    "SELECT event_id, 'E' || event_id AS eventId, event_type AS EventName, 'M' || event_id AS marketId, 'Spread' AS name, 'S' || event_id || '-' || side AS selectionId, side AS label, CASE WHEN side = 'over' THEN points ELSE -points END AS points, replace(american_odds, '−', '-') AS americanOdds, '2024-01-01' AS startEventDate "
    "FROM lines, (SELECT unnest(['over', 'under']) AS side)",
    "lines",
    "points",
)
def s7(spark, d):
    selection = '{"id":"S%s-%s","marketId":"M%s","label":"%s","points":%s,"displayOdds":{"american":"%s"}}'

    def pick(side, points):
        return F.format_string(selection, "event_id", F.lit(side), "event_id", F.lit(side), points, "american_odds")

    points = F.col("points").cast("string")
    document = F.concat(
        F.format_string('{"events":[{"id":"E%s","name":"%s","startEventDate":"2024-01-01"}],', "event_id", "event_type"),
        F.format_string('"markets":[{"id":"M%s","eventId":"E%s","name":"Spread"},{"id":"M%s-x","eventId":"none","name":"Other"}],', "event_id", "event_id", "event_id"),
        F.lit('"selections":['), pick("over", points), F.lit(","), pick("under", (-F.col("points")).cast("string")), F.lit("]}"),
    )
    return S.odds_lines(D.lines(spark, d).select("event_id", document.alias("doc")), "doc", ["event_id"])


@query(
    "s8_stage_boundary",
    "SELECT season, count(*) AS n, sum(yards) AS yards FROM panel GROUP BY season",
    "panel",
    "yards",
)
def s8(spark, d):
    stage = S.staged(D.panel(spark, d), "panel")
    return stage.groupBy("season").agg(F.count("*").alias("n"), F.sum("yards").alias("yards"))


@query(
    "s9_page_rows",
    "SELECT page_id, CAST(position AS BIGINT) AS position, href, label FROM (SELECT page_id, generate_subscripts(h, 1) - 1 AS position, unnest(h) AS href, unnest(l) AS label FROM ("
    "SELECT page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2) AS l FROM pages))",
)
def s9(spark, d):
    pattern = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    return S.page_rows(D.table(spark, d, "pages"), "html", ["page_id"], pattern, ["href", "label"])
