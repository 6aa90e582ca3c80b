"""Queries: catalog, identity, lineage, consumers, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltawarden.functions import urns as U
from deltawarden.operators.consumers import (
    affected_owners, classify_consumers, match_consumers, merge_consumers, only_affected, related_assets,
)
from deltawarden.operators.identity import (
    column_presence, normalize_catalog, resolve_identity, tied_candidates, top_candidates)
from deltawarden.operators.lineage import column_lineage_consumers, downstream_lineage, lineage_stats
from deltawarden.operators.models import affected_models, model_ref_edges
from deltawarden.plans.context import change_context, enrich_consumers
from deltawarden.session import grows, spread
from deltawarden.sources.catalog import catalog_fields, column_lineage_edges, lineage_edges
from deltawarden.workloads.detection import SCANNED, revisions
from deltawarden.workloads.inputs import CHANGES, CONSUMERS, DATASETS, EDGES, HINTS, derive, query, table

SUPPLIER_URN = "'urn:li:dataset:(urn:li:dataPlatform:hive,stock.supplier_' || cast(s_suppkey as string) || ',PROD)'"


def raw_catalog(spark, sf_dir) -> DataFrame:
    """A catalog export: every part a dataset, fed by the suppliers that deliver it."""
    parts = derive(spark, sf_dir, DATASETS)
    number = F.col("number")

    def text(value):
        return F.lit(value) if isinstance(value, str) else value

    def owner(urn, user, name, shown):
        return F.struct(F.struct(
            text(urn).alias("urn"), F.lit("CORP_GROUP").alias("type"), text(user).alias("username"),
            text(name).alias("name"), F.struct(text(shown).alias("display_name")).alias("properties")).alias("owner"))

    none = F.lit(None).cast("string")
    owners = F.array(
        owner(F.concat(F.lit("urn:li:corpGroup:team-"), (number % 9).cast("string")), none, none,
              F.when(number % 2 == 0, F.concat(F.lit("Team "), (number % 9).cast("string")))),
        owner(F.when(number % 3 == 0, "urn:li:corpuser:amy"), F.when(number % 6 == 0, "amy.user"), F.lit("Amy"), F.lit("")))

    def field(path):
        return F.struct(text(path).alias("field_path"), F.lit("BIGINT").alias("native_type"), F.lit("").alias("description"))

    fields = F.array(field(F.col("field_a")), field(""), field(F.col("field_b")), field(F.col("field_c")))
    return parts.select(
        "urn", F.when(number % 4 != 0, "DATASET").alias("type"),
        F.when(number % 8 < 6, F.col("name")).otherwise("").alias("name"),
        F.when(number % 8 == 7, F.when(number % 16 == 7, none).otherwise("titled")).alias("dashboard_id"),
        none.alias("chart_id"),
        F.struct(F.when(number % 8 == 6, F.col("name")).alias("name"),
                 F.concat(F.lit("part "), number.cast("string")).alias("description")).alias("properties"),
        F.struct(F.col("platform").alias("name")).alias("platform"),
        F.when(number % 5 == 0, "own text").otherwise("").alias("description"),
        F.struct(owners.alias("owners")).alias("ownership"),
        F.struct(fields.alias("fields")).alias("schema_metadata"), "number")


@query("catalog_normalize", f"""
select urn, case when number % 4 <> 0 then 'DATASET' else 'UNKNOWN' end as type,
       case when number % 8 <= 6 then name when number % 16 = 15 then 'titled'
            else name || '_' || cast(number as varchar) end as name,
       qualified as qualified_name, platform,
       case when number % 5 = 0 then 'own text' else 'part ' || cast(number as varchar) end as description,
       case when number % 2 = 0 then 'Team ' || cast(number % 9 as varchar) else 'urn:li:corpGroup:team-' || cast(number % 9 as varchar) end
         || case when number % 6 = 0 then '|amy.user' when number % 3 = 0 then '|Amy' else '' end as owner_names,
       field_a || '|' || field_b || '|' || field_c as field_names
from ({DATASETS}) d""")
def catalog_normalize(spark, sf_dir):
    return normalize_catalog(raw_catalog(spark, sf_dir)).select(
        "urn", "type", "name", "qualified_name", "platform", "description",
        F.array_join(F.transform("owners", lambda o: o["name"]), "|").alias("owner_names"),
        F.array_join(F.transform("fields", lambda f: f["field_path"]), "|").alias("field_names"))


PART_URN = ("'urn:li:dataset:(urn:li:dataPlatform:dbt,shop.part_' || cast(l_partkey as string) || ',PROD)'")


def fed_catalog(spark, sf_dir) -> DataFrame:
    """Raw metadata with lineage: each order line makes its part's dataset read its supplier's."""
    lines = table(spark, sf_dir, "lineitem")
    supplier = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:hive,stock.supplier_"),
                        F.col("l_suppkey").cast("string"), F.lit(",PROD)"))
    part = F.expr(PART_URN)

    def entry(upstream, downstream, op):
        return F.struct(F.array(*upstream).alias("upstreams"), F.array(downstream).alias("downstreams"),
                        F.lit(op).alias("transform_operation"), F.lit(1.0).alias("confidence_score"))

    def at(urn, name):
        return U.schema_field_urn(urn, name)

    flag = F.concat(F.lit("qty_"), F.col("l_returnflag"))
    return lines.select(
        part.alias("urn"),
        F.struct(
            F.array(F.struct(supplier.alias("dataset"), F.lit("TRANSFORMED").alias("type"))).alias("upstreams"),
            F.array(entry([at(supplier, flag), at(supplier, F.lit("price"))], at(part, F.lit("net")), "TRANSFORM"),
                    entry([at(supplier, F.lit("id"))], at(part, F.lit("supplier_id")), "IDENTITY")).alias("fine_grained"),
        ).alias("upstream_lineage"))


FED = f"""
select {PART_URN} as part,
       'urn:li:dataset:(urn:li:dataPlatform:hive,stock.supplier_' || cast(l_suppkey as string) || ',PROD)' as supplier,
       'qty_' || l_returnflag as flag from [[lineitem]]"""


@query("lineage_edges_flatten", f"""
select 'table' as level, supplier as src, cast(null as varchar) as src_field, part as dst, cast(null as varchar) as dst_field,
       cast(null as varchar) as op from (select distinct supplier, part from ({FED}) f) t
union all select 'column', supplier, flag, part, 'net', 'TRANSFORM' from ({FED}) f
union all select 'column', supplier, 'price', part, 'net', 'TRANSFORM' from ({FED}) f
union all select 'column', supplier, 'id', part, 'supplier_id', 'IDENTITY' from ({FED}) f""")
def lineage_edges_flatten(spark, sf_dir):
    raw = fed_catalog(spark, sf_dir)
    none = F.lit(None).cast("string")
    tables = lineage_edges(raw).select(
        F.lit("table").alias("level"), "src", none.alias("src_field"), "dst", none.alias("dst_field"), none.alias("op"))
    return tables.unionByName(column_lineage_edges(raw).select(
        F.lit("column").alias("level"), F.col("src_urn").alias("src"), "src_field", F.col("dst_urn").alias("dst"),
        "dst_field", "op"))


@query("lineage_stats", f"""
with u as (select part, count(distinct supplier) as n from ({FED}) f group by 1),
     c as (select part, 3 * count(*) as n from ({FED}) f group by 1)
select u.part as urn, cast(0 as bigint) as field_count, u.n as upstream_count, cast(c.n as bigint) as column_edge_count
from u join c on u.part = c.part
union all
select urn, cast(3 as bigint), cast(0 as bigint), cast(0 as bigint) from ({DATASETS}) d""")
def lineage_stats_query(spark, sf_dir):
    raw = fed_catalog(spark, sf_dir)
    fields = catalog_fields(normalize_catalog(raw_catalog(spark, sf_dir)))
    return lineage_stats(lineage_edges(raw), column_lineage_edges(raw), fields)


URN_TEXTS = f"""
select urn, 'urn:li:schemaField:(' || urn || ',' || replace(field_b, 'g', 'g%2Bx+%2') || ')' as field_urn,
       'urn:li:dashboard:(looker,board_' || cast(number as string) || ')' as board, name, qualified, platform, number, field_b
from ({DATASETS}) d"""


@query("urn_parse", f"""
select urn, name || '_' || cast(number as varchar) as leaf, qualified, platform, urn as owner_dataset,
       replace(field_b, 'g', 'g%2Bx+%2') as field, 'board_' || cast(number as varchar) as segment,
       'urn:li:schemaField:(' || urn || ',f)' as built from ({URN_TEXTS}) u""")
def urn_parse(spark, sf_dir):
    urn, field, board = F.col("urn"), F.col("field_urn"), F.col("board")
    return derive(spark, sf_dir, URN_TEXTS).select(
        "urn", U.dataset_leaf_name(urn).alias("leaf"), U.dataset_qualified_name(urn).alias("qualified"),
        U.dataset_platform(urn).alias("platform"), U.field_dataset(field).alias("owner_dataset"),
        U.field_path(field).alias("field"), U.last_segment(board).alias("segment"),
        U.schema_field_urn(urn, F.lit("f")).alias("built"))


HINTED = """
select o_orderkey as number,
       case o_orderkey % 4 when 0 then ' raw.Orders ' when 1 then 'unknown' when 2 then '' end as dataset,
       case o_orderkey % 3 when 0 then 'dbt/Models/x_' || cast(o_custkey as string) || '.sql'
            when 1 then 'etl\\jobs\\y_' || cast(o_custkey as string) || '.DDL' else 'z' end as path,
       case when o_orderkey % 5 = 0 then '"Col%41"' end as changed, '`' || o_orderstatus || '`' as other
from [[orders]]"""


@query("change_hints", f"""
select number, case when number % 4 = 0 then 'raw.Orders'
         else case number % 3 when 2 then 'z' else regexp_extract(path, '([xy]_[0-9]+)', 1) end end as hint,
       case when number % 3 = 0 then 'dbt' end as platform,
       case when number % 5 = 0 then 'cola,' else '' end || lower(replace(other, '`', '')) as wanted
from ({HINTED}) h""")
def change_hints_query(spark, sf_dir):
    changes = derive(spark, sf_dir, HINTED.replace("\\", "\\\\"))
    return changes.select(
        "number", U.dataset_hint(F.col("dataset"), F.col("path")).alias("hint"),
        U.platform_hint(F.lit(""), F.col("path")).alias("platform"),
        F.array_join(U.column_hints(F.col("changed"), F.array("other", "other")), ",").alias("wanted"))


# --- identity --------------------------------------------------------------------------------

def catalog(spark, sf_dir) -> DataFrame:
    parts = derive(spark, sf_dir, DATASETS, heavy=True)
    fields = F.transform(F.array("field_a", "field_b", "field_c"), lambda f: F.struct(
        f.alias("field_path"), F.lit("BIGINT").alias("native_type"), F.lit(None).cast("string").alias("description")))
    return parts.select("urn", "name", "platform", fields.alias("fields"))


def hints(spark, sf_dir) -> DataFrame:
    return derive(spark, sf_dir, HINTS, heavy=True).withColumn("columns", F.array("want_a", "want_b", "want_c"))


# Every hint held against every dataset: what the search must find without comparing all pairs.
SCORED = f"""
with wanted as (select number as asked, lower(trim(both '"' from hint)) as h, platform_hint, want_a, lower(want_b) as want_b
                from ({HINTS}) h),
scored as (
  select w.asked, d.urn, d.number as found, d.field_a, d.field_b,
         case when lower(d.qualified) = w.h then 2000 else 0 end + case when lower(d.name) = w.h then 1500 else 0 end
         + case when ends_with(lower(d.qualified), '.' || w.h) then 1000 else 0 end
         + case when contains(lower(d.qualified), w.h) then 100 else 0 end as named,
         case when d.platform = w.platform_hint then 500 else 0 end
         + case when lower(d.field_a) = w.want_a then 25 else 0 end as extra
  from wanted w join ({DATASETS}) d on contains(lower(d.qualified), w.h) or lower(d.name) = w.h),
ranked as (
  select *, named + extra as score, rank() over (partition by asked order by named + extra desc) as place,
         count(*) over (partition by asked, named + extra) as tied
  from scored)
"""


@query("identity_resolution", SCORED + f"""
select h.number, case when r.tied = 1 then r.urn end as urn, r.score, coalesce(r.tied > 1, false) as ambiguous,
       case when r.tied > 1 then r.tied else 0 end as tied_candidates,
       case when r.tied = 1 then
         array_to_string(list_filter([h.want_a, lower(h.want_b)],
           lambda c: list_contains([lower(r.field_a), lower(r.field_b), regexp_extract(lower(r.field_b), '[^.]*$')], c)), ',')
         else '' end as matched,
       case when r.tied = 1 then
         array_to_string(list_filter([h.want_a, lower(h.want_b), 'absent'],
           lambda c: not list_contains([lower(r.field_a), lower(r.field_b), regexp_extract(lower(r.field_b), '[^.]*$')], c)), ',')
         else h.want_a || ',' || lower(h.want_b) || ',absent' end as missing
from ({HINTS}) h left join (select * from ranked where place = 1 qualify row_number() over (partition by asked order by urn) = 1) r
  on r.asked = h.number""")
def identity_resolution(spark, sf_dir):
    return resolve_identity(hints(spark, sf_dir), catalog(spark, sf_dir)).select(
        "number", "urn", "score", "ambiguous", "tied_candidates",
        F.array_join("matched_columns", ",").alias("matched"), F.array_join("missing_columns", ",").alias("missing"))


@query("identity_ambiguity", SCORED + f"""
select lower(trim(both '"' from h.hint)) as hint, coalesce(h.platform_hint, '') as platform, h.want_a, lower(h.want_b) as want_b,
       r.urn, r.score
from ranked r join ({HINTS}) h on h.number = r.asked where r.place = 1 and r.tied > 1
group by all""")
def identity_ambiguity(spark, sf_dir):
    ties = tied_candidates(hints(spark, sf_dir), catalog(spark, sf_dir))
    return ties.select(
        F.col("hint_norm").alias("hint"), F.col("platform_norm").alias("platform"),
        F.col("columns_norm")[0].alias("want_a"), F.col("columns_norm")[1].alias("want_b"), "urn", "score")


@query("identity_candidates", SCORED + f"""
, requests as (
  select distinct lower(trim(both '"' from h.hint)) as hint, coalesce(h.platform_hint, '') as platform, h.want_a,
         lower(want_b) as want_b, urn, score
  from ranked r join ({HINTS}) h on h.number = r.asked)
select hint, platform, want_a, want_b, urn, score,
       row_number() over (partition by hint, platform, want_a, want_b order by score desc, urn) as rank
from requests qualify rank <= 5""")
def identity_candidates(spark, sf_dir):
    best = top_candidates(hints(spark, sf_dir), catalog(spark, sf_dir), 5)
    return best.select(
        F.col("hint_norm").alias("hint"), F.col("platform_norm").alias("platform"),
        F.col("columns_norm")[0].alias("want_a"), F.col("columns_norm")[1].alias("want_b"), "urn", "score", "rank")


@query("column_presence", f"""
select d.urn, h.want_a as wanted, h.want_a = lower(d.field_a) as present
from ({DATASETS}) d join ({HINTS}) h on h.number = d.number
union all
select d.urn, h.want_b, lower(h.want_b) = regexp_extract(lower(d.field_b), '[^.]*$')
from ({DATASETS}) d join ({HINTS}) h on h.number = d.number
union all select d.urn, 'absent', false from ({DATASETS}) d""")
def column_presence_query(spark, sf_dir):
    wanted = derive(spark, sf_dir, DATASETS).select("urn", "number").join(
        grows(derive(spark, sf_dir, HINTS).drop("hint")), "number").select(
        "urn", F.explode(F.array("want_a", "want_b", "want_c")).alias("column"))
    return column_presence(wanted, catalog_fields(catalog(spark, sf_dir))).select(
        "urn", F.col("column").alias("wanted"), "present")


# --- lineage ---------------------------------------------------------------------------------

DEPTH = 6
REACHED = f"""
with recursive edges as materialized (select distinct src, dst from ({EDGES}) e),
roots as (select 'region:' || cast(r_regionkey as varchar) as root from region),
walk(root, urn, degree) as (
  select root, root, 0 from roots
  union
  select w.root, e.dst, w.degree + 1 from walk w join edges e on e.src = w.urn
  where w.degree < {DEPTH} and e.dst <> w.root),
nodes as (select root, urn, min(degree) as degree from walk group by root, urn)
"""


def reach(spark, sf_dir, **options):
    roots = table(spark, sf_dir, "region").select(
        F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("root"))
    return downstream_lineage(derive(spark, sf_dir, EDGES), roots, DEPTH, **options)


@query("lineage_downstream", REACHED + "select root, urn, cast(degree as integer) as degree from nodes where urn <> root")
def lineage_downstream(spark, sf_dir):
    return reach(spark, sf_dir, with_hops=False).nodes


@query("lineage_edges_reached", REACHED + f"""
select n.root, e.src, e.dst, cast(n.degree + 1 as integer) as degree
from nodes n join edges e on e.src = n.urn where n.degree < {DEPTH} and e.dst <> n.root""")
def lineage_edges_reached(spark, sf_dir):
    return reach(spark, sf_dir).hops


@query("lineage_node_cap", f"""
with edges as (select distinct src, dst from ({EDGES}) e),
l1 as (select 'region:' || cast(n_regionkey as varchar) as root, 'nation:' || cast(n_nationkey as varchar) as urn from nation),
n1 as (select root, urn from (select *, row_number() over (partition by root order by urn) as rn from l1) x where rn <= 100),
l2 as (select distinct n1.root, e.dst as urn from n1 join edges e on e.src = n1.urn),
n2 as (select root, urn from (select l2.*, row_number() over (partition by root order by urn) as rn,
         (select count(*) from n1 where n1.root = l2.root) as used from l2) x where rn <= 100 - used),
over_ as (select root from (select root, count(*) as n from (select * from l1 union all select * from l2) a group by root) c where n > 100)
select root, urn, 1 as degree, root in (select root from over_) as warned from n1
union all select root, urn, 2, root in (select root from over_) from n2""")
def lineage_node_cap(spark, sf_dir):
    roots = table(spark, sf_dir, "region").select(
        F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("root"))
    capped = downstream_lineage(derive(spark, sf_dir, EDGES), roots, 2, node_cap=100)
    return capped.nodes.join(capped.warnings.withColumn("warned", F.lit(True)).drop("warning"), "root", "left").select(
        "root", "urn", "degree", F.coalesce("warned", F.lit(False)).alias("warned"))


COLUMN_STEPS = """
select 'order_' || cast(l_orderkey as string) as src_urn, 'c' || cast(l_linenumber as string) as src_field,
       'part_' || cast(l_partkey as string) as dst_urn, 'qty' as dst_field from [[lineitem]]
union all
select 'part_' || cast(l_partkey as string), 'qty', 'supplier_' || cast(l_suppkey as string), 'total' from [[lineitem]]
union all
select 'supplier_' || cast(s_suppkey as string), 'total', 'nation_' || cast(s_nationkey as string), 'total' from [[supplier]]
union all
select 'part_' || cast(l_partkey as string), 'qty', 'part_' || cast(l_partkey as string), 'self' from [[lineitem]]"""


@query("column_lineage_consumers", f"""
with recursive edges as materialized (
  select distinct src_urn || '.' || src_field as src, dst_urn || '.' || dst_field as dst from ({COLUMN_STEPS}) e),
walk(root, at_, degree) as (
  select 'part_' || cast(p_partkey as varchar) || '.qty', 'part_' || cast(p_partkey as varchar) || '.qty', 0 from part
  union select w.root, e.dst, w.degree + 1 from walk w join edges e on e.src = w.at_ where w.degree < 3 and e.dst <> w.root)
select split_part(root, '.', 1) as urn, split_part(root, '.', 2) as field, split_part(at_, '.', 1) as consumer_urn,
       split_part(at_, '.', 2) as downstream_field, cast(min(degree) as integer) as degree
from walk where split_part(root, '.', 1) <> split_part(at_, '.', 1) group by 1, 2, 3, 4""")
def column_lineage_query(spark, sf_dir):
    changed = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("urn"), F.lit("qty").alias("field"))
    # Steps come once for every order line; the walk makes them distinct.
    return column_lineage_consumers(derive(spark, sf_dir, COLUMN_STEPS), changed)


# Models in a tree: order n refers to order n / 3 by ref(); every customer's first order is changed.
MODEL_TEXTS = """
select 'm_' || cast(o_orderkey as string) as name,
       'select * from {{ ref(''m_' || cast(cast(floor(o_orderkey / 3) as bigint) as string) || ''') }}'
       || case when o_orderkey % 2 = 0 then ' join {{ ref( "m_' || cast(cast(floor(o_orderkey / 7) as bigint) as string)
          || '" ) }} on true' else '' end as sql
from [[orders]]"""


@query("affected_models", f"""
with recursive refs as materialized (
  select 'm_' || cast(cast(floor(o_orderkey / 3) as bigint) as varchar) as src, 'm_' || cast(o_orderkey as varchar) as dst from orders
  union select 'm_' || cast(cast(floor(o_orderkey / 7) as bigint) as varchar), 'm_' || cast(o_orderkey as varchar) from orders
  where o_orderkey % 2 = 0),
walk(analysis_id, name, degree) as (
  select 'a' || cast(cast(floor(p_partkey / 40) as bigint) as varchar), 'm_' || cast(p_partkey as varchar), 0 from part
  union select w.analysis_id, r.dst, w.degree + 1 from walk w join refs r on r.src = w.name where r.dst <> w.name)
select analysis_id, name, cast(min(degree) as integer) as degree from walk group by 1, 2""")
def affected_models_query(spark, sf_dir):
    refs = model_ref_edges(derive(spark, sf_dir, MODEL_TEXTS))
    changed = table(spark, sf_dir, "part").select(
        F.concat(F.lit("a"), F.floor(F.col("p_partkey") / 40).cast("string")).alias("analysis_id"),
        F.concat(F.lit("m_"), F.col("p_partkey").cast("string")).alias("name"))
    return affected_models(refs, changed)


# --- consumers -------------------------------------------------------------------------------

def changes(spark, sf_dir) -> DataFrame:
    rows = derive(spark, sf_dir, CHANGES)
    return rows.select(
        "analysis_id", "path", "file_status", "ordinal", "kind", "dataset",
        F.when(F.col("kind") == "column_dropped", F.col("changed")).alias("column"),
        F.when(F.col("kind") == "filter_changed", F.array("changed", "also")).alias("columns"))


def consumers(spark, sf_dir) -> DataFrame:
    rows = derive(spark, sf_dir, CONSUMERS, heavy=True)
    return rows.select(
        "analysis_id", "urn", "name", "type", "tier", "production", "business_critical", "sql",
        F.when(F.col("input_column").isNotNull(), F.array("input_column")).alias("input_columns"),
        F.array(F.struct("upstream_dataset", "upstream_column",
                         F.lit(None).cast("string").alias("downstream_column"))).alias("column_lineage"),
        F.array(F.struct(F.col("owner_urn").alias("urn"), F.col("owner_name").alias("name"),
                         F.lit("CORP_GROUP").alias("type"))).alias("owners"), "ordinal")


# The consumers' columns are known from the order number; nothing is parsed here.
MATCHED = f"""
with proofs as (
  select analysis_id, urn, 'col_' || cast(ordinal % 8 as varchar) as col, 0 as strength, lower(upstream_dataset) as up from ({CONSUMERS}) c
  union all select analysis_id, urn, 'col_' || cast(ordinal % 9 as varchar), 1, '' from ({CONSUMERS}) c where ordinal % 2 = 1
  union all select analysis_id, urn, 'col_' || cast(ordinal % 7 as varchar), 2, '' from ({CONSUMERS}) c),
wanted as (
  select analysis_id, dataset, kind, ordinal * 10 as pos, lower(changed) as col from ({CHANGES}) g
  union all select analysis_id, dataset, kind, ordinal * 10 + 1, also from ({CHANGES}) g where also is not null),
matches as (
  select p.analysis_id, p.urn, w.dataset, w.col, w.kind, min(p.strength) as strength, min(w.pos) as pos
  from proofs p join wanted w on p.analysis_id = w.analysis_id and p.col = w.col
  where p.strength > 0 or p.up = '' or p.up = lower(w.dataset) group by 1, 2, 3, 4, 5),
cols as (select analysis_id, urn, col, count(*) as n, min(pos) as pos from matches group by 1, 2, 3),
summed as (select analysis_id, urn, cast(sum(n) as bigint) as match_count, string_agg(col, ', ' order by pos) as listed
           from cols group by 1, 2),
classified as (
  select c.*, s.match_count is not null as affected, coalesce(s.match_count, 0) as match_count,
         case when s.listed is null then 'No changed column is referenced' else 'References ' || s.listed end as reason
  from ({CONSUMERS}) c left join summed s on c.analysis_id = s.analysis_id and c.urn = s.urn)
"""


def classified(spark, sf_dir) -> DataFrame:
    return classify_consumers(consumers(spark, sf_dir), changes(spark, sf_dir))


@query("classify_consumers", MATCHED + """
select analysis_id, urn, type, affected, case when affected then 'true_consumer' else 'lineage_only' end as classification,
       match_count, reason from classified""")
def classify_query(spark, sf_dir):
    return classified(spark, sf_dir).select(
        "analysis_id", "urn", "type", "affected", "classification", "match_count", "reason")


@query("consumer_matches", MATCHED + """
select analysis_id, urn, dataset, col, kind as change_kind,
       case strength when 0 then 'column_lineage' when 1 then 'declared_input' else 'sql_reference' end as evidence from matches""")
def consumer_matches(spark, sf_dir):
    return match_consumers(consumers(spark, sf_dir), changes(spark, sf_dir)).select(
        "analysis_id", "urn", "dataset", F.col("column").alias("col"), "change_kind", "evidence")


@query("consumers_affected", MATCHED + "select analysis_id, urn, match_count from classified where affected")
def consumers_affected(spark, sf_dir):
    return only_affected(classified(spark, sf_dir)).select("analysis_id", "urn", "match_count")


@query("merge_consumers", MATCHED + """
, seen as (select c.*, 'asset_' || cast(ordinal % 3 as varchar) as asset from classified c)
select s.analysis_id, asset as urn, bool_or(affected) as affected,
       coalesce(any_value(m.n), 0) as match_count, arg_max(name, ordinal) as name, arg_max(type, ordinal) as type,
       coalesce(arg_max(reason, ordinal) filter (where affected), 'No changed column is referenced') as reason
from seen s left join (
  select a.analysis_id as id, a.asset as of_asset, count(distinct (m.dataset, m.col, m.kind)) as n
  from matches m join seen a on a.analysis_id = m.analysis_id and a.urn = m.urn group by 1, 2) m
on m.id = s.analysis_id and m.of_asset = s.asset group by 1, 2""")
def merge_query(spark, sf_dir):
    given = consumers(spark, sf_dir)
    matches = match_consumers(given, changes(spark, sf_dir))
    asset = F.concat(F.lit("asset_"), (F.col("ordinal") % 3).cast("string"))
    seen = classify_consumers(given, changes(spark, sf_dir), matches).withColumn("urn", asset).withColumnRenamed(
        "ordinal", "change_ordinal")
    of_asset = matches.join(grows(given.select("analysis_id", "urn", "ordinal")), ["analysis_id", "urn"]).withColumn(
        "urn", asset)
    return merge_consumers(seen, of_asset).select("analysis_id", "urn", "affected", "match_count", "name", "type", "reason")


@query("owner_routing", MATCHED + """
select analysis_id, lower(owner_name) as owner_key, arg_min(owner_name, ordinal) as owner
from classified where affected group by 1, 2""")
def owner_routing(spark, sf_dir):
    return affected_owners(classified(spark, sf_dir))


@query("related_assets", MATCHED + f"""
select distinct analysis_id, urn as asset_urn from classified where affected
union select distinct analysis_id, 'urn:li:dataset:' || dataset from ({CHANGES}) g""")
def related_query(spark, sf_dir):
    resolved = changes(spark, sf_dir).select(
        "analysis_id", F.concat(F.lit("urn:li:dataset:"), "dataset").alias("urn"))
    return related_assets(resolved, classified(spark, sf_dir))


@query("consumer_enrichment", f"""
select c.analysis_id, c.urn, coalesce(d.name, c.name) as name, coalesce(d.platform, 'none') as platform
from (select analysis_id, case when ordinal % 2 = 0 then d.urn else c.urn end as urn, c.name, ordinal
      from ({CONSUMERS}) c left join ({DATASETS}) d on d.number = c.ordinal % 100) c
left join ({DATASETS}) d on d.urn = c.urn and c.ordinal % 4 = 0""")
def consumer_enrichment(spark, sf_dir):
    listed = catalog(spark, sf_dir)
    numbered = derive(spark, sf_dir, DATASETS).select(F.col("urn").alias("d_urn"), (F.col("number")).alias("slot"))
    rows = derive(spark, sf_dir, CONSUMERS).withColumn("slot", F.col("ordinal") % 100).join(numbered, "slot", "left")
    assets = rows.select("analysis_id", F.when(F.col("ordinal") % 2 == 0, F.col("d_urn")).otherwise(F.col("urn")).alias("urn"),
                         "name", "ordinal")
    proven = assets.filter("ordinal % 4 = 0")
    rest = assets.filter("ordinal % 4 <> 0").withColumn("platform", F.lit(None).cast("string"))
    rich = enrich_consumers(proven, listed, proven).unionByName(rest, allowMissingColumns=True)
    return rich.select("analysis_id", "urn", "name", F.coalesce("platform", F.lit("none")).alias("platform"))


# --- context ---------------------------------------------------------------------------------

CONTEXT_CHANGES = """
select 'a' || cast(p_partkey as string) as analysis_id, 'models/p.sql' as path, 0 as ordinal,
       'shop.part_' || cast(p_partkey as string) as dataset, 'net' as changed from [[part]]"""


@query("change_context", f"""
with lines as (select distinct l_partkey as p, l_suppkey as s from lineitem),
reach as (
  select p, 'urn:li:dataset:(urn:li:dataPlatform:hive,stock.supplier_' || cast(s as varchar) || ',PROD)' as urn, 1 as degree,
         'supplier_' || cast(s as varchar) as name from lines
  union all
  select distinct l.p, 'urn:li:dataset:(urn:li:dataPlatform:hive,stock.nation_' || cast(s_nationkey as varchar) || ',PROD)', 2,
         'nation_' || cast(s_nationkey as varchar) from lines l join supplier on s_suppkey = l.s)
select 'a' || cast(p as varchar) as analysis_id, urn, degree, name, 'net' as upstream_column,
       case degree when 1 then 'paid' else 'sum' end as downstream_column from reach""")
def change_context_query(spark, sf_dir):
    found = derive(spark, sf_dir, CONTEXT_CHANGES, heavy=True).select(
        "analysis_id", "path", "ordinal", "dataset", F.col("changed").alias("column"),
        F.lit(None).cast("array<string>").alias("columns"))
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")

    def named(prefix, key):
        return F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(",PROD)"))

    hive = "urn:li:dataset:(urn:li:dataPlatform:hive,stock."
    part, supplier = F.expr(PART_URN), named(hive + "supplier_", "l_suppkey")
    steps = lines.select("l_partkey", "l_suppkey").distinct().select(
        part.alias("src"), supplier.alias("dst"), F.lit("net").alias("f"), F.lit("paid").alias("t"))
    steps = steps.unionByName(suppliers.select(
        named(hive + "supplier_", "s_suppkey").alias("src"), named(hive + "nation_", "s_nationkey").alias("dst"),
        F.lit("paid").alias("f"), F.lit("sum").alias("t")))
    columns = steps.select(F.col("src").alias("src_urn"), F.col("f").alias("src_field"),
                           F.col("dst").alias("dst_urn"), F.col("t").alias("dst_field"))
    parts = spread(table(spark, sf_dir, "part")).select(
        F.expr(PART_URN.replace("l_partkey", "p_partkey")).alias("urn"),
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), F.lit("dbt").alias("platform"),
        F.array(F.struct(F.lit("net").alias("field_path"), F.lit("DOUBLE").alias("native_type"),
                         F.lit("").alias("description"))).alias("fields"))
    context = change_context(found, parts, steps.select("src", "dst"), columns, depth=2)
    return context.consumers.select(
        "analysis_id", "urn", "degree", "name", F.inline("column_lineage")).select(
        "analysis_id", "urn", "degree", "name", "upstream_column", "downstream_column")
