"""Windows of a stream: as a batch would have them, late rows counted, repeated batches stored once."""

from deltawarden.operators.stored_profile import State, StoredMeasures, approximate_profile
from deltawarden.session import cut_lineage, scratch_path
from deltawarden.streaming.windows import WindowWatch, against_baseline, late_rows, window_profiles, window_states
from deltawarden.operators.compare import Thresholds

MEASURES = StoredMeasures({"total": State("sum", "v"), "n": State("count", "v")}, {"average": "total / n"}, medians={"middle": "v"})
SCHEMA = "ts timestamp, v double, note string"


def write(spark, path, rows):
    frame = spark.createDataFrame(rows, "at string, v double, note string")
    frame.selectExpr("cast(at as timestamp) as ts", "v", "note").coalesce(1).write.mode("append").parquet(path)


def profiles(rows):
    return {(r["window"], r["category"], r["metric"]): r["num_value"] for r in rows.collect()}


def test_closed_windows_equal_those_of_a_batch_and_late_rows_are_counted(spark):
    path, checkpoint = scratch_path(spark, "events"), scratch_path(spark, "checkpoint")
    hour = lambda h, m, v: (f"2024-01-01 {h:02d}:{m:02d}:00", v, None if v > 5 else "n")
    write(spark, path, [hour(0, m, float(m)) for m in range(0, 60, 7)] + [hour(1, m, 2.0) for m in range(0, 60, 9)])
    baseline = cut_lineage(approximate_profile(spark.read.parquet(path).drop("ts"), MEASURES))
    watch = WindowWatch(scratch_path(spark, "watch"), "events", MEASURES, baseline)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(path)
        query = watch.start(stream, "ts", "1 hour", "10 minutes", checkpoint)
        query.awaitTermination()
        return late_rows(query)

    assert run() == 0
    assert {r["window"] for r in watch.store("profiles").rows().collect()} == {"2024-01-01T00:00:00"}
    write(spark, path, [hour(3, 30, 9.0)])
    assert run() == 0
    write(spark, path, [hour(0, 1, 100.0), hour(3, 40, 1.0), hour(5, 30, 1.0)])  # the first is too late
    assert run() == 1
    closed = spark.read.parquet(path).where("v <> 100 and ts < '2024-01-01 05:00:00'")
    types = closed.drop("ts").dtypes
    batch = window_profiles(window_states(closed, "ts", "1 hour", "0 seconds", MEASURES), types, MEASURES)
    stored = watch.store("profiles").rows()
    assert profiles(stored) == profiles(batch) and stored.count() == batch.count()
    want = against_baseline(batch, baseline, "events", Thresholds())
    key = lambda df: sorted((r["window"], r["category"], r["metric"], r["breached"]) for r in df.collect())
    assert key(watch.store("differences").rows()) == key(want)


def test_a_batch_that_runs_again_is_stored_once(spark):
    one = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:20:00", 3.0)], "at string, v double").selectExpr(
        "cast(at as timestamp) as ts", "v")
    closed = window_states(one, "ts", "1 hour", "0 seconds", MEASURES)
    rows = window_profiles(closed, [("v", "double")], MEASURES)
    watch = WindowWatch(scratch_path(spark, "watch"), "m", MEASURES, rows.drop("window"))
    replace = lambda stored, new: new.unionByName(stored.join(new.select("window").distinct(), "window", "left_anti"))
    for _ in range(2):
        watch.store("profiles").update(rows, replace)
    assert watch.store("profiles").rows().count() == rows.count()
