"""Large walks shuffle a level once, keep what they saw in buckets and remove what they no longer read."""

from pathlib import Path

from pyspark.sql import functions as F

from deltawarden.operators import lineage as L
from deltawarden.plans.context import change_context
from deltawarden.session import cut_large, cut_lineage, discard, scratch_root


def tables(spark):
    folder = Path(scratch_root(spark).removeprefix("file:"))
    return {p for p in folder.iterdir()} if folder.exists() else set()


def test_a_large_walk_leaves_no_edges(spark, monkeypatch):
    monkeypatch.setattr(L, "SEEN_TABLES", 2)
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "b"), ("x", "d"), ("a", "b"), (None, "b"), ("b", None)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    roots = spark.createDataFrame([("a",), ("x",), ("none",), ("a",)], "root string")
    for hubs in ({}, {"hub_degree": 0, "hub_salts": 2}):
        before = tables(spark)
        found = L.downstream_lineage(edges, roots, None, with_hops=False, broadcast_bytes=0, **hubs)
        left = [spark.read.parquet(str(p)).columns for p in tables(spark) - before if list(p.glob("*.parquet"))]
        assert not [c for c in left if "dst" in c]
        assert sorted(tuple(r) for r in found.nodes.collect()) == [
            ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("a", "e", 4),
            ("x", "b", 3), ("x", "c", 4), ("x", "d", 1), ("x", "e", 2)]


def test_buckets_meet_without_a_shuffle_or_an_entry(spark):
    rows = spark.range(50).select((F.col("id") % 7).alias("block"), F.col("id").cast("string").alias("urn"))
    one, two = (cut_large(rows.withColumn(n, F.lit(n)), ["block", "urn"]) for n in ("x", "y"))
    met = one.join(two.hint("merge"), ["block", "urn"], "left")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 50 and met.filter("y is null").count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("step_")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_column_steps_may_repeat(spark):
    steps = spark.createDataFrame([("d", "c", "u", "t"), ("d", "c", "u", "t"), ("u", "t", "v", None)],
                                  "src_urn string, src_field string, dst_urn string, dst_field string")
    before = tables(spark)
    found = L.column_lineage_consumers(steps, spark.createDataFrame([("d", "c")], "urn string, field string"), broadcast_bytes=0)
    left = [spark.read.parquet(str(p)).columns for p in tables(spark) - before if list(p.glob("*.parquet"))]
    assert not [c for c in left if "dst" in c]
    assert sorted((r["consumer_urn"], r["downstream_field"], r["degree"]) for r in found.collect()) == [("u", "t", 1), ("v", None, 2)]


def test_only_own_tables_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "given"))
    given, made, kept = spark.read.parquet(str(tmp_path / "given")), cut_lineage(spark.range(2)), cut_large(spark.range(4))
    discard(given.union(made).union(kept), kept)
    assert given.count() == 3 and kept.count() == 4
    assert not Path(made.inputFiles()[0].removeprefix("file://")).exists()


def test_a_context_leaves_its_assets_alone(spark):
    urn = "urn:li:dataset:(urn:li:dataPlatform:dbt,s.{},PROD)"
    top, below = urn.format("details"), urn.format("finance")
    catalog = spark.createDataFrame(
        [(u, None, "dbt", [(f, "BIGINT", None)]) for u, f in ((top, "pct"), (below, "net"))],
        "urn string, name string, platform string, fields array<struct<field_path:string,native_type:string,description:string>>")
    edges = spark.createDataFrame([(top, below)], "src string, dst string")
    columns = spark.createDataFrame([(top, "pct", below, "net")], "src_urn string, src_field string, dst_urn string, dst_field string")
    changes = spark.createDataFrame([("a", "m.sql", 0, "details", "pct", None)],
                                    "analysis_id string, path string, ordinal int, dataset string, column string, columns array<string>")
    before = tables(spark)
    found = change_context(changes, catalog, edges, columns, broadcast_bytes=0)
    assert [(r["urn"], r["degree"], len(r["column_lineage"])) for r in found.consumers.collect()] == [(below, 1, 1)]
    left = [set(spark.read.parquet(str(p)).columns) for p in tables(spark) - before if list(p.glob("*.parquet"))]
    # Levels of walks, their edges and the two sides of the assets are gone.
    assert not [c for c in left if {"bits"} & c or {"dst"} & c or {"spot"} & c]
