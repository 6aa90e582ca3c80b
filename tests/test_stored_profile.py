"""Stored profiles next to whole ones: appended, replaced and removed files; the error of the medians."""

from pathlib import Path

import numpy as np
import pytest

from deltawarden.operators.compare import compare_profiles
from deltawarden.operators.profile import profile_table
from deltawarden.operators.stored_profile import (
    State, StoredMeasures, StoredProfile, approximate_profile, with_model)
from deltawarden.session import scratch_path

SUMS = StoredMeasures(
    {"total": State("sum", "net"), "n": State("count", "net"), "most": State("max", "net"), "least": State("min", "net"),
     "of_a": State("sum", "net", "seg = 'a'")},
    {"total": "total", "average": "total / n", "range": "most - least"}, {"share": "of_a / nullif(total, 0)"})
WHOLE = ({"total": "SUM(net)", "average": "AVG(net)", "range": "MAX(net) - MIN(net)"},
         {"share": "SUM(net) FILTER (WHERE seg = 'a') / NULLIF(SUM(net), 0)"})


def table(spark, low, high):
    return spark.range(low, high).selectExpr(
        "id", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end as seg",
        "case when id % 7 > 0 then cast(id % 1000 as decimal(12,2)) end as net")


def rows_of(profile):
    return {(r["category"], r["metric"]): (None if r["num_value"] is None else round(r["num_value"], 6), r["text_value"])
            for r in profile.collect()}


def test_only_new_files_are_read(spark):
    path, store = scratch_path(spark, "lines"), scratch_path(spark, "states")
    table(spark, 0, 5000).repartition(4).write.parquet(path)
    kept = StoredProfile(spark, path, store, SUMS)
    whole = lambda: rows_of(profile_table(spark.read.parquet(path), *WHOLE))
    assert rows_of(kept.refresh()) == whole()
    table(spark, 5000, 5050).coalesce(1).write.mode("append").parquet(path)
    read = []
    states_of = StoredProfile._states_of

    def watched(self, rows, listing):
        read.append(rows.count())
        return states_of(self, rows, listing)

    StoredProfile._states_of = watched
    try:
        assert rows_of(kept.refresh()) == whole()
        assert read == [50]
        assert rows_of(kept.refresh()) == whole() and read == [50]
    finally:
        StoredProfile._states_of = states_of


def test_replaced_removed_and_empty_files(spark, tmp_path):
    path, store = f"{tmp_path}/in put", scratch_path(spark, "states")
    table(spark, 0, 300).repartition(3).write.parquet(path)
    kept = StoredProfile(spark, path, store, SUMS, ["seg", "net * 2 as net"], buckets=4)
    whole = lambda: rows_of(profile_table(spark.read.parquet(path).selectExpr("seg", "net * 2 as net"), *WHOLE))
    assert rows_of(kept.refresh()) == whole()
    files = sorted(Path(path).glob("part-*.parquet"))
    files[0].write_bytes(files[1].read_bytes())
    for crc in Path(path).glob(".*.crc"):
        crc.unlink()
    files[2].unlink()
    table(spark, 0, 0).coalesce(1).write.mode("append").parquet(path)
    assert rows_of(kept.refresh()) == whole()
    assert rows_of(kept.refresh()) == whole()


def test_sides_can_be_compared(spark):
    before, after = table(spark, 0, 900), table(spark, 0, 450)
    sides = [with_model(approximate_profile(rows, SUMS), "a", "m", side)
             for side, rows in (("before", before), ("after", after))]
    found = {r["metric"]: r["breached"] for r in compare_profiles(sides[0].unionByName(sides[1])).collect()}
    assert found["rowCount"] and found["total"]


@pytest.mark.parametrize("k, error", [(200, 0.0266), (800, 0.0066)])
def test_median_error_is_bounded(spark, k, error):
    """Twice the stated rank error leaves room for the rare case beyond 99 %."""
    values = np.random.default_rng(k).lognormal(0, 2, 40_000)
    rows = spark.createDataFrame([(i % 4, float(v)) for i, v in enumerate(values)], "part int, v double").repartition(6)
    found = approximate_profile(rows, StoredMeasures(medians={"middle": "v"}, k=k), ["part"])
    for r in found.where("metric = 'middle'").collect():
        own = values[r["part"]::4]
        assert abs((own <= r["num_value"]).mean() - 0.5) <= error


def test_odd_measures(spark):
    none = approximate_profile(table(spark, 0, 0), StoredMeasures(SUMS.states, SUMS.metrics, medians={"m": "net"}))
    assert rows_of(none)[("distribution", "m")] == (None, None) and rows_of(none)[("volume", "rowCount")] == (0.0, None)
    with pytest.raises(ValueError, match="state is one of"):
        approximate_profile(table(spark, 0, 1), StoredMeasures({"x": State("avg", "net")}))
    with pytest.raises(ValueError, match="identifier"):
        StoredMeasures({"a b": State("sum", "net")})
