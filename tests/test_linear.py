"""Models as rows: weights against Spark's own logistic regression, and the cases at the edges."""

import math

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from scoutframe.models import linear as L


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(4000).select(
        "id", ((F.xxhash64("id", F.lit(1)) % 1000) / 500.0).alias("x"), (50 + (F.xxhash64("id", F.lit(2)) % 1000) / 100.0).alias("far"),
        F.expr("CASE pmod(xxhash64(id, 3), 4) WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END").alias("level"),
        F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1000)).alias("u"),
    ).withColumn("x", F.when(F.col("id") % 11 != 0, F.col("x")))
    z = F.coalesce("x", F.lit(0.4)) + 0.1 * (F.col("far") - 50) + F.when(F.col("level") == "a", 0.7).otherwise(0.0)
    return made.withColumn("m", (1000 / (1 + F.exp(-z)) - F.col("u")))


CODES = {"m": [("often", -300), ("even", 0), ("seldom", 400), ("never", 5000)]}


@pytest.fixture(scope="module")
def fitted(rows):
    design = L.fit_design(rows, ["x", "far"], ["level"])
    made = rows.select("id", design.vector().alias("features"), L.label_list(CODES).alias("labels"), F.array(*[F.lit(c) for c, _ in CODES["m"]]).alias("targets"))
    made = made.cache()
    return design, made, L.fit_targets(made, design, ridge=1e-6)


def test_probabilities_are_those_of_a_single_fit(rows, fitted):
    design, made, weights = fitted
    got = L.score_rows(made, weights, design, ["id"]).where("response_var = 'even'").orderBy("id")
    plain = made.select("id", array_to_vector("features").alias("features"), F.expr("filter(labels, l -> l.response_var = 'even')[0].label").alias("label"))
    model = LogisticRegression(maxIter=300, tol=1e-12, fitIntercept=True).fit(plain)
    from pyspark.ml.functions import vector_to_array

    want = model.transform(plain).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id")
    gap = got.join(want, "id").agg(F.max(F.abs(F.col("model_probability") - F.col("p")))).first()[0]
    assert gap < 1e-3


def test_one_class_only_has_an_intercept_and_nothing_else(fitted):
    design, _, weights = fitted
    never = {r["feature"]: r["weight"] for r in weights.where("response_var = 'never'").collect()}
    assert set(never) == set(design.names)
    assert math.isclose(never.pop(L.INTERCEPT), math.log(0.5 / 4000.5))
    assert set(never.values()) == {0.0}


def test_all_targets_share_one_scan_without_a_row_per_feature(rows, fitted):
    design, made, weights = fitted
    scored = L.score_rows(made, weights, design, ["id"])
    assert scored.count() == 4000 * 4
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1


def test_missing_unseen_and_infinite_values(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, None)], "x double, level string")
    design = L.fit_design(train, ["x"], ["level"])
    assert design.names == [L.INTERCEPT, "x", "x=missing", "level=a", "level=missing"]
    odd = spark.createDataFrame([(None, "new"), (float("nan"), None), (float("inf"), "a"), (3.0, "")], "x double, level string")
    got = [list(r[0]) for r in odd.select(design.vector()).collect()]
    assert got == [[1, 0, 1, 0, 0], [1, 0, 1, 0, 1], [1, 0, 1, 1, 0], [1, 3, 0, 0, 0]]


def test_empty_rows_and_too_many_levels(spark):
    empty = spark.createDataFrame([], "x double, m double")
    design = L.fit_design(empty, ["x"], [])
    rows = empty.select(design.vector().alias("features"), L.label_list({"m": [("t", 1)]}).alias("labels"))
    assert L.fit_targets(rows, design).count() == 0
    with pytest.raises(ValueError):
        L.fit_design(spark.range(200).select(F.col("id").cast("string").alias("c")), [], ["c"])


def test_separable_targets_still_end(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").alias("m"))
    design = L.fit_design(df, ["x"], [])
    rows = df.select("x", design.vector().alias("features"), L.label_list({"m": [("half", 50)]}).alias("labels"), F.array(F.lit("half")).alias("targets")).cache()
    weights = L.fit_targets(rows, design)
    right = L.score_rows(rows, weights, design, ["x"]).where("(model_probability >= 0.5) = (x >= 50)").count()
    assert right >= 98


def test_evidence_counts_each_level(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1)], "c string, m int")
    got = {r["feature"]: r["weight"] for r in L.evidence_weights(df.withColumn("labels", L.label_list({"m": [("t", 1)]})), ["c"]).collect()}
    base = math.log(3.5 / 1.5)
    want = {L.INTERCEPT: base, "c=a": -base, "c=b": math.log(1.5 / 0.5) - base, "c=missing": math.log(1.5 / 0.5) - base}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_weights_of_unknown_size_are_sent_to_the_rows(spark, fitted):
    design, made, weights = fitted
    big = weights.crossJoin(spark.range(1)).drop("id").join(weights.select("response_var").distinct(), "response_var")
    plan = L.score_rows(made, big, design, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "rightHint=(strategy=broadcast)" in joins[0]
    assert L.score_rows(made, big, design, ["id"]).count() == 4000 * 4
