"""Replays against numbers that are known beforehand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltawarden.operators.compare import Thresholds, compare_profiles, comparison_rollup
from deltawarden.operators.models import build_models
from deltawarden.operators.profile import median_argument, profile_table
from deltawarden.operators.quantile import exact_median
from deltawarden.plans.replay import Measures, RowModel, replay, replay_models, replay_rowwise
from deltawarden.session import with_key

# --- fixed values: twenty seed orders (id, segment, gross amount, discount in percent) --------
SEED = [
    (1001, "enterprise", 1200.00, 25.0), (1002, "consumer", 80.50, 10.0), (1003, "enterprise", 2400.00, 20.0),
    (1004, "consumer", 50.00, None), (1005, "enterprise", 1800.00, 15.0), (1006, "consumer", 120.75, 5.0),
    (1007, "enterprise", 3200.00, 30.0), (1008, "consumer", 64.00, 0.0), (1009, "enterprise", 900.00, 12.0),
    (1010, "consumer", 210.40, 8.0), (1011, "enterprise", 1500.00, 22.0), (1012, "consumer", 95.00, 18.0),
    (1013, "enterprise", 2750.00, 28.0), (1014, "consumer", 145.25, None), (1015, "enterprise", 1100.00, 10.0),
    (1016, "consumer", 72.50, 35.0), (1017, "enterprise", 4100.00, 18.0), (1018, "consumer", 188.00, 14.0),
    (1019, "enterprise", 1950.00, 26.0), (1020, "consumer", 58.90, 2.0),
]
SCHEMA = "order_id bigint, customer_segment string, gross_amount double, discount_percentage double"
SMALL = [(1001, "enterprise", 100.0, 25.0), (1002, "consumer", 80.0, 10.0), (1003, "enterprise", 200.0, 20.0),
         (1004, "consumer", 50.0, None)]
NET = "gross_amount * (1 - coalesce(discount_percentage, 0D) / 100D)"
UNSAFE = "gross_amount * (1 - coalesce(discount_percentage, 0D))"
REVENUE = Measures(
    {"total": "SUM(net_revenue)", "average": "AVG(net_revenue)"},
    {"median": "MEDIAN(net_revenue)",
     "share": "SUM(net_revenue) FILTER (WHERE customer_segment = 'enterprise') / NULLIF(SUM(net_revenue), 0)"})


def model(net, where=None, **more):
    return RowModel({"order_id": "order_id", "gross_amount": "gross_amount", "customer_segment": "customer_segment",
                     "net_revenue": net, **more}, where)


def value(profile, side, metric, category=None):
    found = profile.filter((F.col("side") == side) & (F.col("metric") == metric))
    if category:
        found = found.filter(F.col("category") == category)
    return found.first()["num_value"]


def seed_models(spark, rate):
    def staging(inputs):
        net = f"gross_amount * (1 - {rate})"
        return inputs["raw"].select("*", F.expr(rate).alias("discount_rate"), F.expr(net).alias("net_revenue"))

    def fact(inputs):
        return inputs["stg"].groupBy("customer_segment").agg(
            F.sum("gross_amount").alias("gross_revenue"), F.sum("net_revenue").alias("net_revenue"))

    def features(inputs):
        return inputs["stg"].select(
            "order_id", F.col("discount_rate").alias("ratio"), F.expr("int(discount_rate > 0.20)").alias("is_high"))

    return build_models({"raw": spark.createDataFrame(SEED, SCHEMA)}, {
        "features": (("stg",), features), "fact": (("stg",), fact), "stg": (("raw",), staging)})


SEED_MEASURES = {
    "stg": Measures({"total": "SUM(net_revenue)", "average_rate": "AVG(discount_rate)"},
                    {"median": "MEDIAN(net_revenue)", "max_rate": "MAX(discount_rate)"}),
    "fact": Measures({"total": "SUM(net_revenue)", "gross": "SUM(gross_revenue)"},
                     {"share": "SUM(net_revenue) FILTER (WHERE customer_segment = 'enterprise') / SUM(net_revenue)"}),
    "features": Measures({"average_ratio": "AVG(ratio)", "high": "SUM(is_high)"}, {"max_ratio": "MAX(ratio)"}),
}


@pytest.mark.parametrize("run", ["rowwise", "apart"])
def test_small_fixture_catches_the_unscaled_discount(spark, run):
    source = spark.createDataFrame(SMALL, SCHEMA)
    if run == "rowwise":
        result = replay_rowwise(source, model(NET), model(UNSAFE), REVENUE)
    else:
        result = replay(model(NET).apply(source), model(UNSAFE).apply(source), REVENUE)
    profile = result.profile.cache()
    assert value(profile, "before", "total") == 357 and value(profile, "after", "total") == -6870
    assert value(profile, "before", "rowCount") == value(profile, "after", "rowCount") == 4
    assert value(profile, "after", "net_revenue", "null_rate") == 0
    breached = {(r["category"], r["metric"]): r["magnitude"] for r in result.differences.filter("breached").collect()}
    assert breached[("metric", "total")] < -100
    assert ("distribution", "median") in breached
    assert not any(category == "schema" for category, _ in breached)


def test_equivalent_refactor_has_no_difference(spark):
    source = spark.createDataFrame(SMALL, SCHEMA)
    refactored = source.withColumn("f", F.expr("coalesce(discount_percentage, 0D) / 100D")).select(
        "order_id", "gross_amount", "customer_segment", F.expr("gross_amount - gross_amount * f").alias("net_revenue"))
    result = replay(model(NET).apply(source), refactored, REVENUE)
    assert result.differences.count() == 0


def test_all_categories_are_reported(spark):
    source = spark.createDataFrame(SMALL, SCHEMA)
    after = RowModel({**model(NET).columns, "order_id": "cast(order_id as string)",
                      "net_revenue": "case when order_id = 1001 then null else gross_amount end"}, "order_id <> 1004")
    result = replay_rowwise(source, model(NET), after, REVENUE)
    assert {r[0] for r in result.differences.select("category").distinct().collect()} == {
        "schema", "volume", "null_rate", "metric", "distribution"}


def test_rowwise_side_without_rows(spark, rows):
    source = spark.createDataFrame(SMALL, SCHEMA)
    result = replay_rowwise(source, model(NET), model(NET, "order_id < 0"), REVENUE)
    apart = replay(model(NET).apply(source), model(NET, "order_id < 0").apply(source), REVENUE)
    assert rows(result.differences) == rows(apart.differences)
    volume = result.differences.filter("category = 'volume'").first()
    assert (volume["before_num"], volume["after_num"], volume["magnitude"], volume["breached"]) == (4, 0, -100, True)


def test_seed_project_numbers(spark):
    right, wrong = "coalesce(discount_percentage, 0D) / 100.0D", "coalesce(discount_percentage, 0D)"
    before, after = seed_models(spark, right), seed_models(spark, wrong)
    result = replay_models(before, after, SEED_MEASURES, ["stg", "fact", "features", "gone"])
    assert result.skipped == ["gone"]
    found = {(r["model"], r["side"], r["metric"]): r["num_value"]
             for r in result.profile.filter("category in ('metric', 'distribution')").collect()}
    expected = {
        ("fact", "total"): (17311.4075, -445403.95), ("fact", "gross"): (21985.3, 21985.3),
        ("features", "average_ratio"): (0.149, 14.9), ("features", "max_ratio"): (0.35, 35),
        ("stg", "median"): (492.784, -6182.5), ("features", "high"): (6, 17), ("stg", "average_rate"): (0.149, 14.9),
    }
    for (name, metric), (b, a) in expected.items():
        assert found[(name, "before", metric)] == pytest.approx(b, rel=1e-9)
        assert found[(name, "after", metric)] == pytest.approx(a, rel=1e-9)
    breached = result.differences.filter("breached").groupBy("model").count().collect()
    assert {r["model"]: r["count"] for r in breached} == {"stg": 4, "fact": 1, "features": 3}


def test_scaling_a_column_breaches(spark):
    source = spark.createDataFrame(SMALL, SCHEMA)
    for factor, breaks in ((1.04, False), (1.06, True), (2.0, True)):
        result = replay_rowwise(source, model(NET), model(f"{NET} * {factor}D"), Measures({"total": "SUM(net_revenue)"}))
        assert (result.differences.filter("breached").count() > 0) is breaks


def snapshot(spark, side, schema, count, nulls, metrics, distributions):
    rows = [("schema", c, None, t) for c, t in schema.items()] + [("volume", "rowCount", float(count), None)]
    for category, values in (("null_rate", nulls), ("metric", metrics), ("distribution", distributions)):
        rows += [(category, name, None if v is None else float(v), None) for name, v in values.items()]
    df = spark.createDataFrame(rows, "category string, metric string, num_value double, text_value string")
    return with_key(df, {"analysis_id": "a", "model": "m", "side": side})


def test_snapshot_pair(spark):
    before = snapshot(spark, "before", {"order_id": "BIGINT", "net": "DECIMAL"}, 1000, {"net": 0.2}, {"revenue": 100000},
                      {"score": 0.1})
    after = snapshot(spark, "after", {"order_id": "BIGINT", "net": "DOUBLE"}, 820, {"net": 3.5}, {"revenue": 75250},
                     {"score": 0.18})
    differences = {(r["category"], r["metric"]): r for r in compare_profiles(before.unionByName(after)).collect()}
    assert differences[("metric", "revenue")]["magnitude"] == pytest.approx(-24.75)
    assert differences[("schema", "net")]["change"] == "type_changed"
    assert differences[("volume", "rowCount")]["magnitude"] == pytest.approx(-18)
    assert differences[("null_rate", "net")]["magnitude"] == pytest.approx(3.3)
    assert all(r["breached"] for r in differences.values()) and len(differences) == 5


def test_comparison_edges(spark):
    before = snapshot(spark, "before", {"a": "INT", "b": "INT"}, 10, {"a": 0, "b": 0}, {"zero": 0, "gone": 5, "none": None}, {})
    after = snapshot(spark, "after", {"a": "INT", "c": "INT"}, 10, {"a": 2, "c": 0}, {"zero": 1, "gone": None, "none": None}, {})
    profile = before.unionByName(after)
    found = {(r["category"], r["metric"]): r for r in compare_profiles(profile).collect()}
    assert found[("schema", "c")]["breached"] is False and found[("schema", "b")]["breached"] is True
    assert found[("null_rate", "c")]["magnitude"] is None and found[("null_rate", "c")]["breached"] is True
    assert found[("metric", "zero")]["magnitude"] == float("inf")
    assert found[("metric", "gone")]["magnitude"] is None and found[("metric", "gone")]["breached"] is True
    assert ("metric", "none") not in found and found[("null_rate", "a")]["breached"] is False
    lenient = compare_profiles(profile, Thresholds(ignore_added_null_rate=True))
    assert lenient.filter("category = 'null_rate' and metric = 'c'").count() == 0
    summary = comparison_rollup(compare_profiles(profile)).first()
    assert summary["passed"] is False and summary["equivalent"] is False


def test_empty_table_profile(spark):
    empty = spark.createDataFrame([], "a int, b string")
    found = {(r["category"], r["metric"]): r["num_value"] for r in
             profile_table(empty, {"s": "SUM(a)"}, {"m": "MEDIAN(a)"}).collect()}
    assert found[("volume", "rowCount")] == 0 and found[("null_rate", "a")] == 0
    assert found[("metric", "s")] is None and found[("distribution", "m")] is None


def test_expressions_are_checked(spark):
    table = spark.createDataFrame([(1.0,)], "a double")
    for metrics in ({"x y": "SUM(a)"}, {"x": ""}, {"x": "SUM(a); DROP"}, {"x": "MEDIAN(a) / 2"}):
        with pytest.raises(ValueError):
            profile_table(table, metrics)
    with pytest.raises(Exception, match="finite"):
        profile_table(table, {"x": "SUM(double('Infinity'))"}).collect()
    assert median_argument("MEDIAN(f(a, (b)))") == "f(a, (b))"
    assert median_argument("MEDIAN(a) + MEDIAN(b)") is None


@pytest.mark.parametrize("shape", ["spread", "hot", "two", "odd"])
def test_exact_median_matches_numpy(spark, shape):
    random.seed(7)
    values = {
        "spread": [random.gauss(0, 100) for _ in range(5001)], "odd": [3.0, 1.0, 2.0],
        "hot": [5.0] * 3000 + [random.random() * 10 for _ in range(6000)], "two": [1.0, 2.0],
    }[shape]
    table = spark.createDataFrame([("k", v) for v in values] + [("n", None)], "k string, v double").repartition(7)
    found = {r["k"]: r["median"] for r in exact_median(table, "v", ["k"], accuracy=2000).collect()}
    assert found == {"k": float(np.median(values)), "n": None}
    assert exact_median(table, "v", accuracy=2000).first()["median"] == float(np.median(values))


def test_model_chain_errors():
    with pytest.raises(ValueError, match="cycle"):
        build_models({}, {"a": (("b",), lambda i: i["b"]), "b": (("a",), lambda i: i["a"])})
    with pytest.raises(ValueError, match="unknown input"):
        build_models({}, {"a": (("nothing",), lambda i: i["nothing"])})
