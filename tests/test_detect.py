"""What the detector reports for single files, and the text rules beneath it."""

import pytest
from pyspark.sql import functions as F

from deltawarden import schemas
from deltawarden.functions import sqltext as S
from deltawarden.operators.detect import detect_changes, detect_changes_in_patches

BASE = dict(repository="acme/shop", pull=1, base="1" * 40, head="2" * 40)


def detect(spark, before, after, path="models/orders.sql", status="modified"):
    row = ("a", BASE["repository"], 1, BASE["base"], BASE["head"], path, status, before, after)
    found = detect_changes(spark.createDataFrame([row], schemas.FILE_REVISION)).orderBy("ordinal").collect()
    return [r.asDict() for r in found]


def test_dropped_column_and_filter(spark):
    found = detect(
        spark, "\nselect order_id, discount_percentage, revenue\nfrom {{ ref('raw_orders') }}\nwhere status = 'complete'\n",
        "\nselect order_id, revenue\nfrom {{ ref('raw_orders') }}\nwhere status in ('complete', 'refunded')\n")
    assert [(r["kind"], r["column"], r["columns"], r["confidence"]) for r in found] == [
        ("column_dropped", "discount_percentage", None, 0.95), ("filter_changed", None, ["status"], 0.95)]
    assert {r["dataset"] for r in found} == {"orders"} and found[0]["sources"] == ["raw_orders"]


def test_formatting_is_no_change(spark):
    assert detect(spark, "select order_id from raw_orders", " SELECT   order_id\nFROM raw_orders -- x") == []
    assert detect(spark, "a", "b", path="docs/readme.md") == []


def test_rename_needs_a_new_name_and_the_first_twin(spark):
    drop = detect(spark, "select a, b from t", "select a, c from t")
    assert [(r["kind"], r["column"]) for r in drop] == [("column_dropped", "b")]
    rename = detect(spark, "select b, a from t", "select c, a from t")
    assert [(r["kind"], r["column"], r["new_column"]) for r in rename] == [("column_renamed", "b", "c")]
    computed = detect(spark, "select id, x + y as total from t", "select id, x + y as amount from t")
    assert [(r["kind"], r["new_column"], r["confidence"]) for r in computed] == [("column_renamed", "amount", 0.9)]


def test_unsafe_and_refactored_staging_model(spark):
    before = ("select order_id, customer_id, order_date, customer_segment, gross_amount, discount_percentage,\n"
              "coalesce(discount_percentage, 0) / 100.0 as discount_rate,\n"
              "gross_amount * (1 - coalesce(discount_percentage, 0) / 100.0) as net_revenue\nfrom {{ source('raw', 'orders') }}")
    unsafe = detect(spark, before, before.replace(" / 100.0", ""))
    assert [(r["kind"], r["column"]) for r in unsafe] == [
        ("column_expression_changed", "discount_rate"), ("column_expression_changed", "net_revenue")]
    assert unsafe[0]["sources"] == ["raw.orders"]
    refactored = ("with rated as (\n select *, coalesce(discount_percentage, 0) / 100.0 as rate\n"
                  " from {{ source('raw', 'orders') }}\n)\n" + before.replace("{{ source('raw', 'orders') }}", "rated"))
    found = detect(spark, before, refactored)
    assert len(found) == 8
    assert [r["new_column"] for r in found if r["kind"] == "column_renamed"] == ["rate"]


def test_casts_and_repeated_names(spark):
    found = detect(spark, "select cast(a as int) as a, x as d, y as d from t", "select cast(a as bigint) as a, z as d from t")
    assert [(r["kind"], r["column"], r["confidence"]) for r in found] == [
        ("column_type_changed", "a", 0.9), ("column_expression_changed", "d", 0.85)]
    same = detect(spark, "select x as d, y as d from t", "select y as d from t ")
    assert same == []


def test_ddl_patch(spark):
    patch = ("@@ -1 +1 @@\n-ALTER TABLE analytics.orders RENAME COLUMN discount_pct TO discount_percentage;\n"
             "+ALTER TABLE analytics.orders RENAME COLUMN discount_percentage TO discount_rate;\n")
    row = spark.createDataFrame([("a", "schemas/orders.sql", "modified", patch)],
                                "analysis_id string, path string, status string, patch string")
    found = [r.asDict() for r in detect_changes_in_patches(row).collect()]
    assert len(found) == 1
    assert {k: found[0][k] for k in ("kind", "dataset", "column", "new_column", "sources", "confidence")} == {
        "kind": "column_renamed", "dataset": "analytics.orders", "column": "discount_percentage",
        "new_column": "discount_rate", "sources": [], "confidence": 1.0}
    typed = detect(spark, "x", 'alter table "T" alter column `c` set data type decimal(10, 2);', path="t.ddl")
    assert [(r["dataset"], r["column"], r["after_type"]) for r in typed] == [("T", "c", "decimal(10, 2)")]


def test_dataset_marker(spark):
    found = detect(spark, "select a, b from t", "-- deltawarden:dataset = shop.orders\nselect a from t")
    assert {r["dataset"] for r in found} == {"shop.orders"}


@pytest.mark.parametrize("text, parts", [
    ("a, b", ["a", "b"]), ("f(a, b), ',' as c", ["f(a, b)", "',' as c"]), ("a), b", ["a)", "b"]),
    ('"x,y", `p,q`, \'it\'\'s, so\'', ['"x,y"', "`p,q`", "'it''s, so'"]), ("'open, end", ["'open, end"]),
    (" , ,a", ["a"]), (None, []), ("", []), ("((a, b), c), d", ["((a, b), c)", "d"]),
])
def test_top_level_commas(spark, text, parts):
    row = spark.createDataFrame([(text,)], "t string").select(S.split_select_list(F.col("t"))).first()
    assert row[0] == parts


def test_comma_cut_against_character_scan(spark):
    import random

    random.seed(3)
    cases = {}
    for _ in range(3000):
        text = "".join(random.choice("a,() '\"`b") for _ in range(random.randint(0, 25)))
        depth, quote, current, parts = 0, None, "", []
        for c in text:
            if quote:
                quote = None if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c == "(":
                depth += 1
            elif c == ")":
                depth = max(0, depth - 1)
            elif c == "," and depth == 0:
                parts.append(current)
                current = ""
                continue
            current += c
        parts.append(current)
        cases[text] = [p.strip() for p in parts if p.strip()]
    texts = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r[0]: r[1] for r in texts.select("t", S.split_select_list(F.col("t"))).collect()} == cases


def test_detection_stays_in_the_jvm(spark):
    revisions = spark.createDataFrame([("a", "m.sql", "modified", "select a, f(b, ',') as c from t", "select a from t")],
                                      "analysis_id string, path string, status string, before string, after string")
    plan = detect_changes(revisions)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_text_rules(spark):
    cases = [
        ("count(*)", None, ["count"]), ("t.amount", "amount", ["t"]), ("x AS `y z`", None, ["x", "y", "z"]),
        ('sum(a) as "Total"', "Total", ["sum", "a", "Total"]), ("'lit' as k", "k", []), ("caf\u00e9 as b", "b", ["caf"]),
        ("a$b + _c$", None, ["a$b", "_c"]), ("1.5", "5", []),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "e string")
    found = df.select("e", S.output_name(F.col("e")), S.source_columns(F.col("e"))).collect()
    assert [tuple(r) for r in found] == cases
    sql = "SELECT a -- b\n/* c */ , 'd' FROM caf\u00e9\u00a0\u2003x where note = 'it''s' and Z_1 > 1"
    one = spark.createDataFrame([(sql,)], "s string").select(
        S.normalize_sql(F.col("s")), S.sql_identifiers(F.col("s")), S.where_clause(F.col("s"))).first()
    assert one[0] == "select a , 'd' from caf\u00e9 x where note = 'it''s' and z_1 > 1"
    assert one[1] == ["select", "a", "from", "caf", "x", "where", "note", "and", "z_1"]
    assert one[2] == "note = 'it''s' and z_1 > 1"
    stops = spark.createDataFrame([("from t where my_limit > 1 group  by x",), ("where a order by b",)], "s string")
    assert [r[0] for r in stops.select(S.where_clause(F.col("s"))).collect()] == ["my_limit > 1", "a"]


def test_long_texts_do_not_overflow(spark):
    long = "select '" + "x" * 400_000 + ", " + ", ".join(f"c{i}" for i in range(2000)) + " from t where " + "a" * 200_000
    assert [r["kind"] for r in detect(spark, long, long + " and b")] == ["filter_changed"]
