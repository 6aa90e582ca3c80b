"""Queries: windows of events as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltawarden.operators.stored_profile import State, StoredMeasures, approximate_profile
from deltawarden.session import cut_lineage, scratch_path
from deltawarden.streaming.windows import WindowWatch
from deltawarden.workloads.inputs import query, table
from deltawarden.workloads.replays import rounded

MEASURES = StoredMeasures(
    {"total": State("sum", "amount"), "n": State("count", "amount"), "errors": State("count", "amount", "event_type = 'error'")},
    {"average_value": "cast(total as double) / n"}, {"error_share": "cast(errors as double) / n"})
COLUMNS = ["event_type", "amount", "label"]
SHOWN = ["event_type", "cast(value as decimal(12,2)) as amount", "nullif(event_type, 'click') as label"]


@query("event_windows", """
with e as (select date_trunc('day', ts) as day, event_type, cast(value as decimal(12,2)) as amount, nullif(event_type, 'click') as label
           from events),
closed as (select day from e group by day having day + interval 1 day <= (select max(ts) from events) - interval 1 hour),
p as (
  select day, cast(count(*) as double) as n, cast(sum(amount) as double) / count(amount) as average_value,
         cast(count(amount) filter (where event_type = 'error') as double) / count(amount) as error_share,
         100.0 * count(*) filter (where label is null) / count(*) as nulls
  from e group by day),
base as (select p.* from p where day = (select min(day) from e)),
found as (
  select strftime(p.day, '%Y-%m-%dT%H:%M:%S') as "window", u.category, u.metric, u.b as before_num, u.a as after_num,
         u.points, u.bound
  from p join closed on closed.day = p.day, base,
  lateral (values ('volume', 'rowCount', base.n, p.n, false, 5.0),
                  ('metric', 'average_value', base.average_value, p.average_value, false, 5.0),
                  ('distribution', 'error_share', base.error_share, p.error_share, false, 10.0),
                  ('null_rate', 'label', base.nulls, p.nulls, true, 2.0)) u(category, metric, b, a, points, bound))
select "window", category, metric, round(before_num, 4) as before_num, round(after_num, 4) as after_num,
       abs(case when points then after_num - before_num else (after_num - before_num) / abs(before_num) * 100 end) > bound as breached
from found where abs(after_num - before_num) > 1e-9 * greatest(abs(before_num), abs(after_num))""")
def event_windows(spark, sf_dir):
    """Days of events, each compared with the first day once it is closed."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min(F.date_trunc("day", "ts")).alias("first_day"))
    opening = events.join(F.broadcast(first), F.date_trunc("day", "ts") == F.col("first_day"))
    baseline = cut_lineage(approximate_profile(opening.selectExpr(*SHOWN), MEASURES))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "100").parquet(
        f"{sf_dir}/events.parquet*").selectExpr("cast(ts as timestamp) as ts", *SHOWN)
    watch = WindowWatch(scratch_path(spark, "windows"), "events", MEASURES, baseline)
    watch.start(stream, "ts", "1 day", "1 hour", scratch_path(spark, "stream"), COLUMNS).awaitTermination()
    return rounded(watch.store("differences").rows(), "before_num", "after_num").select(
        "window", "category", "metric", "before_num", "after_num", "breached")
