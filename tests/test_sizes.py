"""Sides of joins that grow with the data are not broadcast, however small Spark takes them for."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from deltawarden.functions import sqltext as S
from deltawarden.functions import urns as U
from deltawarden.operators import consumers as C
from deltawarden.operators import identity as I
from deltawarden.operators.cycles import strongly_connected
from deltawarden.operators.lineage import downstream_lineage
from deltawarden.session import scratch_root, spread

FIELDS = "array<struct<field_path:string,native_type:string,description:string>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def catalog(spark, count):
    return spark.createDataFrame(
        [(f"urn:li:dataset:(urn:li:dataPlatform:dbt,shop.part_{i},PROD)", f"part_{i}", "dbt",
          [("net", "DOUBLE", None)]) for i in range(count)],
        f"urn string, name string, platform string, fields {FIELDS}")


def hints(spark, names):
    return spark.createDataFrame([(n, "dbt", ["net"]) for n in names], "hint string, platform_hint string, columns array<string>")


def test_identity_broadcasts_no_catalog(spark):
    known, wanted = catalog(spark, 3), hints(spark, ["part_1", "part"])
    for found in (I.resolve_identity(wanted, known), I.tied_candidates(wanted, known), I.top_candidates(wanted, known, 2)):
        assert "Broadcast" not in plan(found)


def test_names_that_differ_in_a_number_meet_few_hints(spark):
    names = I.searchable_catalog(catalog(spark, 2000))
    wanted = hints(spark, [f"shop.part_{i}" for i in range(1000, 2000)]).select(F.col("hint").alias("hint_norm"))
    found = I.containing_names(wanted, names)
    assert found.count() == 1000
    # What meets is checked in full: as many pairs as there are, not all names that share three digits.
    met = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in met
    longest = I._grams(F.lit("shop.part_1234"), max(w for w in I.WIDTHS if w <= len("shop.part_1234")))
    assert max(map(len, spark.range(1).select(longest).first()[0])) == 12


def test_first_candidates_are_the_first_of_all(spark):
    known = catalog(spark, 40)
    wanted = hints(spark, ["part_1", "part", "PART_39", "none"])
    scores = {}
    for hint in ("part_1", "part", "part_39"):
        rows = [(f"shop.part_{i}", r["urn"]) for i, r in enumerate(known.select("urn").collect())]
        scores[hint] = sorted((-(600 + 25 + (2500 if q == f"shop.{hint}" else 0)), u) for q, u in rows if hint in q)
    for k in (1, 3, 12):
        found = I.top_candidates(wanted, known, k).orderBy("hint_norm", "rank").collect()
        expected = [(h, u, -s, n) for h in sorted(scores) for n, (s, u) in enumerate(scores[h][:k], 1)]
        assert [(r["hint_norm"], r["urn"], r["score"], r["rank"]) for r in found] == expected


def test_column_presence_broadcasts_no_fields(spark):
    wanted = spark.createDataFrame([("u", "a"), ("u", "z")], "urn string, column string")
    fields = spark.createDataFrame([("u", "n.a")], "urn string, field_path string")
    found = I.column_presence(wanted, fields)
    assert "Broadcast" not in plan(found)
    assert {(r["column"], r["present"]) for r in found.collect()} == {("a", True), ("z", False)}


def test_consumers_broadcast_no_matches(spark):
    given = spark.createDataFrame(
        [("a", "u", "select x from t", None, None, 0)],
        "analysis_id string, urn string, sql string, input_columns array<string>, "
        "column_lineage array<struct<upstream_dataset:string,upstream_column:string>>, change_ordinal int")
    changes = spark.createDataFrame([("a", "p", 0, "column_dropped", "d", "x", None)],
                                    "analysis_id string, path string, ordinal int, kind string, dataset string, "
                                    "column string, columns array<string>")
    matches = C.match_consumers(given, changes)
    merged = C.merge_consumers(C.classify_consumers(given, changes, matches), matches)
    assert "Broadcast" not in plan(matches) and "Broadcast" not in plan(merged)
    assert [(r["urn"], r["match_count"]) for r in merged.collect()] == [("u", 1)]


def test_cycles_broadcast_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    found = strongly_connected(edges)
    assert "Broadcast" not in plan(found) and {tuple(r) for r in found.collect()} == {("a", "a"), ("a", "b")}


def test_walked_edges_are_not_written(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("b", "a")], "src string, dst string")
    roots = spark.createDataFrame([("r",)], "root string")
    folder = Path(scratch_root(spark).removeprefix("file:"))
    written = []
    for with_hops in (False, True):
        before = set(folder.iterdir()) if folder.exists() else set()
        found = downstream_lineage(edges, roots, 3, with_hops=with_hops)
        written.append(len(set(folder.iterdir()) - before))
    assert written[0] == written[1]
    assert {tuple(r) for r in found.hops.collect()} == {("r", "r", "a", 1), ("r", "a", "b", 2), ("r", "b", "a", 3)}


def test_costly_work_gets_many_short_tasks(spark, tmp_path):
    spark.range(30).repartition(9).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    splits = rows.rdd.getNumPartitions()
    assert splits > 1 and spread(rows).rdd.getNumPartitions() == 16 * splits


def test_field_urns_are_read_without_patterns_for_the_whole_text(spark):
    pattern = r"\A(?s:urn:li:schemaField:\((urn:li:dataset:\(.*\))),([^\n\r  ]*)\)\z"
    start = "urn:li:schemaField:(urn:li:dataset:("
    texts = [None, "", start, start + ")", start + "),)", start + ",)", start + "a,b,PROD),f)", start + "a),f),g%2B)",
             start + "a),f\n),g)", start + "a),f),g\n)", start + "a),f)x", "urn:li:schemaField:(x),f)", start + "),),)"]
    urn = F.col("urn")
    read = spark.createDataFrame([(t,) for t in texts], "urn string").select(
        urn, U.field_dataset(urn).alias("dataset"), U.field_path(urn).alias("path"))
    assert "regexp_extract" not in plan(read)
    whole = re.compile(pattern.replace(r"\z", r"\Z"))
    for row in read.collect():
        match = whole.match(row["urn"] or "")
        assert row["dataset"] == (match[1] if match else None), row
        assert row["path"] == (match[2].replace("%2B", "+") if match else None), row


def test_lists_and_filters_are_read_by_a_plain_dot(spark):
    text = "-- x\nSELECT a,\n b c \U0001f600 fromage\r\nFROM t WHERE a\n= 1 Group By a"
    row = spark.createDataFrame([(text,)], "t string").select(
        S.select_list_text(F.col("t")).alias("list"), S.where_clause(F.col("t")).alias("filter")).first()
    assert row["list"] == " a,\n b c \U0001f600 fromage\r\n" and row["filter"] == "a = 1"
    assert r"[\s\S]" not in S.SELECT_LIST + S.WHERE_CLAUSE
