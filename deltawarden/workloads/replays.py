"""Queries: models, profiles, comparisons, replays, bounds and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltawarden.operators.checks import constraint_checks, input_bounds, result_bounds
from deltawarden.operators.compare import compare_profiles, comparison_rollup
from deltawarden.operators.decide import Policy, decide_merge
from deltawarden.operators.guards import stopped_bounds
from deltawarden.operators.models import build_models
from deltawarden.operators.profile import null_rate, profile_table
from deltawarden.operators.stored_profile import State, StoredMeasures, StoredProfile
from deltawarden.plans.replay import Measures, RowModel, profile_sides, replay, replay_models, replay_rowwise
from deltawarden.session import cut_lineage, scratch_path, with_key
from deltawarden.workloads.inputs import LINES, derive, query, table

PERCENT = "coalesce(discount_percentage, cast(0 as decimal(5,2)))"
RATE = f"{PERCENT} * cast(0.01 as decimal(3,2))"
NET = f"gross_amount * (cast(1 as decimal(5,0)) - {RATE})"
NET_UNSAFE = f"gross_amount * (cast(1 as decimal(5,0)) - {PERCENT})"
KEPT = {"order_id": "order_id", "gross_amount": "gross_amount", "customer_segment": "customer_segment"}
BEFORE = RowModel({**KEPT, "net_revenue": f"cast({NET} as double)"})
UNSAFE = RowModel({**KEPT, "net_revenue": f"cast({NET_UNSAFE} as double)"})
# The same amount as exact decimals, so that no order of rows can show in a sum.
EXACT_BEFORE = RowModel({**KEPT, "net_revenue": f"cast({NET} as decimal(22,6))"})
EXACT_UNSAFE = RowModel({**KEPT, "net_revenue": f"cast({NET_UNSAFE} as decimal(22,6))"})
REVENUE = Measures(
    {"total_revenue": "SUM(net_revenue)", "average_revenue": "AVG(net_revenue)"},
    {"median_revenue": "MEDIAN(net_revenue)",
     "returned_share": "CAST(SUM(net_revenue) FILTER (WHERE customer_segment = 'R') AS DOUBLE)"
                       " / NULLIF(CAST(SUM(net_revenue) AS DOUBLE), 0)"},
)
REVENUE_TYPES = {"order_id": "bigint", "gross_amount": "decimal(12,2)", "customer_segment": "string",
                 "net_revenue": "decimal(22,6)"}


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- check SQL: a long profile and its comparison, written for any engine -------------------

ORACLE_LINES = f"({LINES}) lines"


def oracle_model(net: str) -> str:
    return (f"select order_id, gross_amount, customer_segment, cast({net} as decimal(22,6)) as net_revenue "
            f"from {ORACLE_LINES}")


ORACLE_REVENUE = [
    ("metric", "total_revenue", "cast(sum(net_revenue) as double)"),
    ("metric", "average_revenue", "cast(sum(net_revenue) as double) / count(net_revenue)"),
    ("distribution", "median_revenue", "median(cast(net_revenue as double))"),
    ("distribution", "returned_share",
     "cast(sum(net_revenue) filter (where customer_segment = 'R') as double)"
     " / nullif(cast(sum(net_revenue) as double), 0)"),
]


def oracle_profile(sub: str, types: dict[str, str], measures: list[tuple[str, str, str]]) -> str:
    parts = [f"select 'volume' as category, 'rowCount' as metric, cast(count(*) as double) as num_value, "
             f"cast(null as varchar) as text_value from ({sub}) s"]
    for name, kind in types.items():
        parts.append(f"select 'schema', '{name}', cast(null as double), '{kind}'")
        parts.append(f"select 'null_rate', '{name}', coalesce(100.0 * count(*) filter (where {name} is null)"
                     f" / nullif(count(*), 0), 0), null from ({sub}) s")
    for category, name, expression in measures:
        parts.append(f"select '{category}', '{name}', {expression}, null from ({sub}) s")
    return "\nunion all\n".join(parts)


def oracle_compare(before: str, after: str) -> str:
    """Full outer join of two profiles with the default thresholds."""
    return f"""
select coalesce(b.category, a.category) as category, coalesce(b.metric, a.metric) as metric,
       round(b.num_value, 4) as before_num, round(a.num_value, 4) as after_num,
       b.text_value as before_text, a.text_value as after_text,
       case when coalesce(b.category, a.category) <> 'schema' then null when b.metric is null then 'added'
            when a.metric is null then 'dropped' else 'type_changed' end as change,
       round({MAGNITUDE}, 4) as magnitude,
       case coalesce(b.category, a.category) when 'schema' then null when 'null_rate' then 'percentage_points'
            else 'percent' end as unit,
       case when coalesce(b.category, a.category) = 'schema' then b.metric is not null
            when b.num_value is null or a.num_value is null then true
            else abs({MAGNITUDE}) > case coalesce(b.category, a.category) when 'null_rate' then 2
                 when 'distribution' then 10 else 5 end end as breached
from ({before}) b full outer join ({after}) a on b.category = a.category and b.metric = a.metric
where case when coalesce(b.category, a.category) = 'schema' then b.text_value is distinct from a.text_value
           when b.num_value is null and a.num_value is null then b.metric is null or a.metric is null
           when b.num_value is null or a.num_value is null then true
           else abs(a.num_value - b.num_value) > 1e-9 * greatest(abs(a.num_value), abs(b.num_value)) end
"""


MAGNITUDE = """case when coalesce(b.category, a.category) = 'schema' then null
            when coalesce(b.category, a.category) = 'null_rate' then a.num_value - b.num_value
            when a.num_value = b.num_value then 0 when b.num_value = 0 then cast('Infinity' as double)
            else (a.num_value - b.num_value) / abs(b.num_value) * 100.0 end"""


def differences_of(result: DataFrame) -> DataFrame:
    return rounded(result, "before_num", "after_num", "magnitude").drop("analysis_id", "model")


# --- models ----------------------------------------------------------------------------------

@query("model_staging", f"""
select order_id, line_number, coalesce(cast(discount_percentage as double), 0) / 100.0 as discount_rate,
       cast(gross_amount as double) * (1 - coalesce(cast(discount_percentage as double), 0) / 100.0) as net_revenue
from {ORACLE_LINES}""")
def model_staging(spark, sf_dir):
    lines = derive(spark, sf_dir, LINES, heavy=True)
    rate = F.coalesce(F.col("discount_percentage").cast("double"), F.lit(0.0)) / 100.0
    return lines.select("order_id", "line_number", rate.alias("discount_rate"),
                        (F.col("gross_amount").cast("double") * (1 - rate)).alias("net_revenue"))


@query("model_features", f"""
select order_id, line_number, customer_segment, {RATE} as order_discount_ratio,
       case when {RATE} > 0.08 then 1 else 0 end as is_high_discount
from {ORACLE_LINES}""")
def model_features(spark, sf_dir):
    rate = F.expr(RATE)
    return derive(spark, sf_dir, LINES, heavy=True).select(
        "order_id", "line_number", "customer_segment", rate.alias("order_discount_ratio"),
        F.when(rate > 0.08, 1).otherwise(0).alias("is_high_discount"))


def staging(net: str):
    def build(inputs):
        return inputs["lines"].select(
            "order_id", "customer_segment", "gross_amount", F.expr(RATE).cast("decimal(12,4)").alias("discount_rate"),
            F.expr(net).cast("decimal(22,6)").alias("net_revenue"))
    return build


def fact(inputs):
    return inputs["stg_orders"].groupBy("customer_segment").agg(
        F.count("*").alias("order_count"), F.sum("gross_amount").alias("gross_revenue"),
        F.sum("net_revenue").alias("net_revenue"), F.avg("discount_rate").alias("average_discount_rate"))


def features(inputs):
    return inputs["stg_orders"].select(
        "order_id", "customer_segment", F.col("discount_rate").alias("order_discount_ratio"),
        F.when(F.col("discount_rate") > 0.08, 1).otherwise(0).alias("is_high_discount"))


def chain(spark, sf_dir, net: str = NET, share: bool = False) -> dict[str, DataFrame]:
    return build_models({"lines": derive(spark, sf_dir, LINES, heavy=True)}, {
        "order_discount_features": (("stg_orders",), features),
        "fct_order_revenue": (("stg_orders",), fact),
        "stg_orders": (("lines",), staging(net)),
    }, share)


FACT_SQL = f"""
select customer_segment, count(*) as order_count, cast(sum(gross_amount) as double) as gross_revenue,
       cast(sum(cast({NET} as decimal(22,6))) as double) as net_revenue,
       round(cast(sum({RATE}) as double) / count(*), 6) as average_discount_rate
from {ORACLE_LINES} group by customer_segment"""


@query("model_fact", FACT_SQL)
def model_fact(spark, sf_dir):
    built = chain(spark, sf_dir)["fct_order_revenue"]
    return built.select(
        "customer_segment", "order_count", F.col("gross_revenue").cast("double").alias("gross_revenue"),
        F.col("net_revenue").cast("double").alias("net_revenue"),
        F.round(F.col("average_discount_rate").cast("double"), 6).alias("average_discount_rate"))


@query("model_chain", f"""
select f.customer_segment, f.order_count, f.net_revenue, d.high_discount_lines
from ({FACT_SQL}) f join (
  select customer_segment, cast(count(*) filter (where {RATE} > 0.08) as bigint) as high_discount_lines
  from {ORACLE_LINES} group by customer_segment) d on f.customer_segment = d.customer_segment""")
def model_chain(spark, sf_dir):
    built = chain(spark, sf_dir)
    high = built["order_discount_features"].groupBy("customer_segment").agg(
        F.sum("is_high_discount").alias("high_discount_lines"))
    revenue = built["fct_order_revenue"].select(
        "customer_segment", "order_count", F.col("net_revenue").cast("double").alias("net_revenue"))
    return revenue.join(high, "customer_segment")


# --- profiles --------------------------------------------------------------------------------

@query("profile_table", f"""
select category, metric, round(num_value, 4) as num_value, text_value
from ({oracle_profile(oracle_model(NET), REVENUE_TYPES, ORACLE_REVENUE)}) p""")
def profile_query(spark, sf_dir):
    rows = EXACT_BEFORE.apply(derive(spark, sf_dir, LINES, heavy=True))
    return rounded(profile_table(rows, REVENUE.metrics, REVENUE.distributions), "num_value")


STORED = StoredMeasures(
    {"net": State("sum", "net_revenue"), "n": State("count", "net_revenue"),
     "returned": State("sum", "net_revenue", "customer_segment = 'R'")},
    {"total_revenue": "net", "average_revenue": "cast(net as double) / n"},
    {"returned_share": "cast(returned as double) / nullif(cast(net as double), 0)"}, {"near_median": "net_revenue"}, k=800)


@query("profile_appended", f"""
select category, metric, round(num_value, 4) as num_value, text_value
from ({oracle_profile(oracle_model(NET), REVENUE_TYPES, [m for m in ORACLE_REVENUE if m[1] != 'median_revenue'])}) p
union all select 'distribution', 'near_median within 1 % of ranks', 1, null""")
def profile_appended(spark, sf_dir):
    """Profiled, appended to, profiled again: the second time only the appended order lines are read."""
    rows = EXACT_BEFORE.apply(derive(spark, sf_dir, LINES, heavy=True))
    path = scratch_path(spark, "lines")
    stored = StoredProfile(spark, path, scratch_path(spark, "states"), STORED)
    rows.where("order_id % 100 <> 7").write.parquet(path)
    stored.refresh()
    rows.where("order_id % 100 = 7").write.mode("append").parquet(path)
    profile = cut_lineage(stored.refresh())
    median = profile.where("metric = 'near_median'").select(F.col("num_value").alias("median"))
    near = rows.join(F.broadcast(median)).agg(
        F.abs(F.count_if(F.col("net_revenue").cast("double") <= F.col("median")) / F.count("net_revenue") - 0.5).alias("off"))
    told = near.select(F.lit("distribution").alias("category"), F.lit("near_median within 1 % of ranks").alias("metric"),
                       F.when(F.col("off") <= 0.01, 1.0).otherwise(0.0).alias("num_value"),
                       F.lit(None).cast("string").alias("text_value"))
    return rounded(profile.where("metric <> 'near_median'"), "num_value").unionByName(told)


@query("null_rates", f"""
select customer_segment, round(100.0 * count(*) filter (where discount_percentage is null) / count(*), 6) as discount_nulls,
       round(100.0 * count(*) filter (where nullif(line_number, 3) is null) / count(*), 6) as line_nulls,
       round(100.0 * count(*) filter (where gross_amount is null) / count(*), 6) as gross_nulls
from {ORACLE_LINES} group by customer_segment""")
def null_rates(spark, sf_dir):
    lines = derive(spark, sf_dir, LINES, heavy=True).withColumn("line_number", F.expr("nullif(line_number, 3)"))
    return rounded(lines.groupBy("customer_segment").agg(
        null_rate("discount_percentage").alias("discount_nulls"), null_rate("line_number").alias("line_nulls"),
        null_rate("gross_amount").alias("gross_nulls")), "discount_nulls", "line_nulls", "gross_nulls", digits=6)


# Whole cents as doubles: their sums are exact in any order of rows.
CENTS = "cast(cast(gross_amount * 100 as bigint) as double)"


@query("metrics_profile", f"""
select customer_segment, line_number, category, metric, num_value from (
  select customer_segment, line_number, 'metric' as category, 'total' as metric,
         cast(sum(gross_amount) as double) as num_value from {ORACLE_LINES} group by 1, 2
  union all
  select customer_segment, line_number, 'metric', 'average', avg({CENTS}) from {ORACLE_LINES} group by 1, 2
  union all
  select customer_segment, line_number, 'distribution', 'largest', cast(max(gross_amount) as double)
  from {ORACLE_LINES} group by 1, 2) m""")
def metrics_profile(spark, sf_dir):
    rows = derive(spark, sf_dir, LINES, heavy=True).select(
        "customer_segment", "line_number", "gross_amount", F.expr(CENTS).alias("cents"))
    profile = profile_table(rows, {"total": "SUM(gross_amount)", "average": "AVG(cents)"},
                            {"largest": "MAX(gross_amount)"}, keys=["customer_segment", "line_number"])
    return profile.filter("category in ('metric', 'distribution')").drop("text_value")


@query("distribution_median", f"""
select customer_segment, line_number, round(median(cast({NET} as double)), 4) as median_net
from {ORACLE_LINES} group by 1, 2""")
def distribution_median(spark, sf_dir):
    rows = derive(spark, sf_dir, LINES, heavy=True).select("customer_segment", "line_number", F.expr(NET).alias("net"))
    profile = profile_table(rows, {}, {"median_net": "MEDIAN(net)"}, keys=["customer_segment", "line_number"],
                            accuracy=10_000)
    return profile.filter("category = 'distribution'").select(
        "customer_segment", "line_number", F.round("num_value", 4).alias("median_net"))


@query("distribution_share", f"""
select line_number, round(cast(sum(gross_amount) filter (where customer_segment = 'R') as double)
       / nullif(cast(sum(gross_amount) as double), 0), 6) as returned_share
from {ORACLE_LINES} group by 1""")
def distribution_share(spark, sf_dir):
    rows = derive(spark, sf_dir, LINES, heavy=True).select("customer_segment", "line_number", "gross_amount")
    share = "SUM(gross_amount) FILTER (WHERE customer_segment = 'R') / NULLIF(SUM(gross_amount), 0)"
    profile = profile_table(rows, {}, {"returned_share": share}, keys=["line_number"])
    return profile.filter("category = 'distribution'").select(
        "line_number", F.round("num_value", 6).alias("returned_share"))


# --- comparisons -----------------------------------------------------------------------------

REWORKED = RowModel(
    {"order_id": "cast(order_id as string)", "gross_amount": "gross_amount", "segment": "customer_segment",
     "net_revenue": f"case when order_id % 10 = 1 then null else cast({NET} as decimal(22,6)) end"},
    where="line_number <> 4")
REWORKED_MEASURES = Measures(REVENUE.metrics, {"median_revenue": "MEDIAN(net_revenue)"})
REWORKED_ORACLE = oracle_compare(
    oracle_profile(oracle_model(NET), REVENUE_TYPES, ORACLE_REVENUE[:3]),
    oracle_profile(
        f"select cast(order_id as varchar) as order_id, gross_amount, customer_segment as segment, "
        f"case when order_id % 10 = 1 then null else cast({NET} as decimal(22,6)) end as net_revenue "
        f"from {ORACLE_LINES} where line_number <> 4",
        {"order_id": "string", "gross_amount": "decimal(12,2)", "segment": "string", "net_revenue": "decimal(22,6)"},
        ORACLE_REVENUE[:3]))


def reworked(spark, sf_dir):
    lines = derive(spark, sf_dir, LINES, heavy=True)
    return replay(EXACT_BEFORE.apply(lines), REWORKED.apply(lines), REWORKED_MEASURES)


@query("replay_all_categories", REWORKED_ORACLE)
def replay_all_categories(spark, sf_dir):
    return differences_of(reworked(spark, sf_dir).differences)


@query("compare_profiles", REWORKED_ORACLE)
def compare_profiles_query(spark, sf_dir):
    lines = derive(spark, sf_dir, LINES, heavy=True)
    sides = profile_sides(EXACT_BEFORE.apply(lines), REWORKED.apply(lines), REWORKED_MEASURES)
    keyed = with_key(sides, {"analysis_id": "x", "model": "m"})
    return differences_of(compare_profiles(keyed))


@query("compare_schema", f"select * from ({REWORKED_ORACLE}) d where category = 'schema'")
def compare_schema(spark, sf_dir):
    return differences_of(reworked(spark, sf_dir).differences.filter("category = 'schema'"))


@query("compare_volume", f"select * from ({REWORKED_ORACLE}) d where category = 'volume'")
def compare_volume(spark, sf_dir):
    return differences_of(reworked(spark, sf_dir).differences.filter("category = 'volume'"))


def per_order(spark, sf_dir) -> DataFrame:
    """A replay keyed by order: every order is an analysis of its own."""
    lines = derive(spark, sf_dir, LINES, heavy=True)
    sides = []
    for side, net in (("before", NET), ("after", f"case when line_number = 2 then null else {NET_UNSAFE} end")):
        rows = lines.select(F.concat(F.lit("o"), F.col("order_id").cast("string")).alias("analysis_id"),
                            F.expr(net).cast("decimal(22,6)").alias("net_revenue"))
        sides.append(with_key(profile_table(rows, {"total": "SUM(net_revenue)"}, keys=["analysis_id"]),
                              {"side": side, "model": "lines"}))
    return compare_profiles(sides[0].unionByName(sides[1]))


@query("comparison_rollup", f"""
with sides as (
  select 'o' || cast(order_id as varchar) as analysis_id,
         cast(sum({NET}) as double) as b, cast(sum(case when line_number <> 2 then {NET_UNSAFE} end) as double) as a,
         100.0 * count(*) filter (where line_number = 2) / count(*) as nulls
  from {ORACLE_LINES} group by order_id),
found as (
  select analysis_id,
         case when a is null then 1 when abs(a - b) > 1e-9 * greatest(abs(a), abs(b)) then 1 else 0 end as metric_diff,
         case when a is null then 1 when abs(a - b) <= 1e-9 * greatest(abs(a), abs(b)) then 0
              when b = 0 or abs((a - b) / b * 100) > 5 then 1 else 0 end as metric_breach,
         case when nulls > 0 then 1 else 0 end as null_diff, case when nulls > 2 then 1 else 0 end as null_breach
  from sides)
select analysis_id, cast(metric_diff + null_diff as bigint) as difference_count,
       cast(metric_breach + null_breach as bigint) as breached_count,
       metric_diff + null_diff = 0 as equivalent, metric_breach + null_breach = 0 as passed
from found""")
def comparison_rollup_query(spark, sf_dir):
    scope = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("analysis_id"))
    return comparison_rollup(per_order(spark, sf_dir), scope=scope)


# --- replays ---------------------------------------------------------------------------------

DANGEROUS_ORACLE = oracle_compare(
    oracle_profile(oracle_model(NET), REVENUE_TYPES, ORACLE_REVENUE),
    oracle_profile(oracle_model(NET_UNSAFE), REVENUE_TYPES, ORACLE_REVENUE))


@query("replay_dangerous", DANGEROUS_ORACLE)
def replay_dangerous(spark, sf_dir):
    lines = derive(spark, sf_dir, LINES, heavy=True)
    return differences_of(replay_rowwise(lines, EXACT_BEFORE, EXACT_UNSAFE, REVENUE).differences)


@query("replay_safe_refactor", oracle_compare(
    oracle_profile(oracle_model(NET), REVENUE_TYPES, ORACLE_REVENUE),
    oracle_profile(oracle_model(f"gross_amount - gross_amount * ({RATE})"), REVENUE_TYPES, ORACLE_REVENUE)))
def replay_safe_refactor(spark, sf_dir):
    lines = derive(spark, sf_dir, LINES, heavy=True)
    rated = lines.withColumn("rate", F.expr(RATE))
    refactored = rated.select("order_id", "gross_amount", "customer_segment", F.expr(
        "cast(gross_amount - gross_amount * rate as decimal(22,6))").alias("net_revenue"))
    return differences_of(replay(EXACT_BEFORE.apply(lines), refactored, REVENUE).differences)


MODEL_MEASURES = {
    "stg_orders": Measures({"total_net_revenue": "SUM(net_revenue)"}, {"max_discount_rate": "MAX(discount_rate)"}),
    "fct_order_revenue": Measures({"total_net_revenue": "SUM(net_revenue)", "total_gross_revenue": "SUM(gross_revenue)"}),
    "order_discount_features": Measures({"high_discount_orders": "SUM(is_high_discount)"}),
}


@query("replay_models", f"""
with totals as (
  select cast(sum(cast({NET} as decimal(22,6))) as double) as b,
         cast(sum(cast({NET_UNSAFE} as decimal(22,6))) as double) as a from {ORACLE_LINES})
select m.model, 'metric' as category, 'total_net_revenue' as metric, round(b, 4) as before_num, round(a, 4) as after_num,
       cast(null as varchar) as before_text, cast(null as varchar) as after_text, cast(null as varchar) as change,
       round((a - b) / abs(b) * 100.0, 4) as magnitude, 'percent' as unit, abs((a - b) / b * 100) > 5 as breached
from totals, (values ('stg_orders'), ('fct_order_revenue')) m(model)""")
def replay_models_query(spark, sf_dir):
    names = ["stg_orders", "fct_order_revenue", "order_discount_features"]
    sides = [chain(spark, sf_dir, net, share=True) for net in (NET, NET_UNSAFE)]
    result = replay_models(*sides, MODEL_MEASURES, names)
    return rounded(result.differences, "before_num", "after_num", "magnitude").drop("analysis_id")


def flagship(spark, sf_dir) -> DataFrame:
    """The whole question on real rows: replay the unscaled discount, compare, decide."""
    lines = derive(spark, sf_dir, LINES, heavy=True)
    result = replay_rowwise(lines, BEFORE, UNSAFE, REVENUE, analysis_id="unscaled_discount")
    one = spark.range(1).select(F.lit("unscaled_discount").alias("analysis_id"),
                                F.lit("passed").alias("execution_status"))
    nobody = one.select("analysis_id", F.lit("DASHBOARD").alias("type"), F.lit("tier_1").alias("tier"),
                        F.lit(True).alias("production"), F.lit(False).alias("business_critical"),
                        F.lit(True).alias("affected"))
    gaps = one.select("analysis_id", F.lit(0).alias("ordinal"), F.lit("").alias("reason"))
    return decide_merge(one, nobody, result.differences, gaps, Policy())


# --- guards ----------------------------------------------------------------------------------

@query("replay_bounds", f"""
with sizes as (select count(*) as n, max(octet_length(encode(customer_segment))) as widest from {ORACLE_LINES}),
     orders_size as (select count(*) as n, max(greatest(octet_length(encode(o_orderstatus)),
                     octet_length(encode(o_orderpriority)))) as widest from orders)
select 'result' as "table", 'rows' as rule, cast(1000 as bigint) as bound, n as observed, n > 1000 as breached from sizes
union all select 'result', 'columns', 100, 5, false
union all select 'result', 'cell_bytes', 1000000, widest, widest > 1000000 from sizes
union all select '*', 'tables', 8, 2, false
union all select '*', 'columns', 100, 11, false
union all select '*', 'rows', 10000, s.n + o.n, s.n + o.n > 10000 from sizes s, orders_size o
union all select 'lines', 'cell_bytes', 1000000, widest, false from sizes
union all select 'orders', 'cell_bytes', 1000000, widest, false from orders_size""")
def replay_bounds(spark, sf_dir):
    lines = derive(spark, sf_dir, LINES, heavy=True)
    inputs = input_bounds({"lines": lines, "orders": table(spark, sf_dir, "orders")})
    return result_bounds(lines, "result", max_rows=1000).unionByName(inputs)


@query("guard_exploding_result", """
select 'orders x orders' as "table", 'rows' as rule, cast(100000 as bigint) as bound,
       cast(least(count(*) * count(*), 100001) as bigint) as observed, count(*) * count(*) > 100000 as breached from orders
union all select 'orders', 'rows', 100000, least(count(*), 100001), count(*) > 100000 from orders
union all select 'high lines', 'rows', 100000, least(count(*), 100001), count(*) > 100000 from lineitem where l_quantity > 45""")
def guard_exploding_result(spark, sf_dir):
    """The product is user SQL; the guard ends it after a small multiple of its bound."""
    orders = table(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("guarded_orders")
    product = spark.sql("select a.o_orderkey, b.o_custkey from guarded_orders a cross join guarded_orders b")
    high = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return stopped_bounds({"orders x orders": product, "orders": orders, "high lines": high}, 100_000)


@query("constraint_checks", """
select 'orders' as "table", 'o_orderkey' as "column", 'not_null' as rule,
       cast(count(*) filter (where o_orderkey is null) as bigint) as violations from orders
union all select 'orders', 'o_orderkey', 'unique', count(*) from (
  select o_orderkey from orders where o_orderkey is not null group by 1 having count(*) > 1) d
union all select 'lineitem', 'l_orderkey', 'unique', count(*) from (
  select l_orderkey from lineitem group by 1 having count(*) > 1) d
union all select 'lineitem', 'discount', 'not_null', count(*) filter (where l_discount = 0.05) from lineitem
union all select 'lineitem', 'l_discount', 'range', count(*) filter (where not (l_discount between 0.02 and 0.08)) from lineitem""")
def constraint_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").withColumn("discount", F.expr("nullif(l_discount, 0.05D)"))
    return constraint_checks(orders, "orders", unique=["o_orderkey"], not_null=["o_orderkey"]).unionByName(
        constraint_checks(lines, "lineitem", unique=["l_orderkey"], not_null=["discount"],
                          between={"l_discount": (0.02, 0.08)}))
