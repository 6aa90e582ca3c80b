"""Inputs of the registered queries, derived from the given tables.

The derivations are plain SQL that Spark and the checking engine both run, so the
check restates only the operator, never the input. All rows of a table take part.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltawarden.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its check."""
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = plain(sql)
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\[\[(\w+)\]\]", sql)))


def derive(spark: SparkSession, sf_dir: str, sql: str, heavy: bool = False) -> DataFrame:
    """Run a shared derivation; ``[[orders]]`` stands for the table. ``heavy`` spreads thin tables first."""
    for name in _names(sql):
        view = f"given_{name}"
        rows = table(spark, sf_dir, name)
        (spread(rows) if heavy else rows).createOrReplaceTempView(view)
        sql = sql.replace(f"[[{name}]]", view)
    return spark.sql(sql)


def plain(sql: str) -> str:
    return re.sub(r"\[\[(\w+)\]\]", r"\1", sql)


# Order lines as the source of a revenue model: decimals keep every sum exact in any row order.
LINES = """
select l_orderkey as order_id, l_linenumber as line_number, l_returnflag as customer_segment,
       cast(l_extendedprice as decimal(12,2)) as gross_amount,
       cast(nullif(l_discount, 0.05) * 100 as decimal(5,2)) as discount_percentage
from [[lineitem]]
"""

# One changed file per order, one pull request per customer; the order number picks the edit.
EXPORTED = """
select o_orderkey as number, 'acme/shop_' || cast(o_custkey % 7 as string) as repository,
       cast(o_custkey + 1 as int) as pull_request,
       lpad(cast(o_custkey as string), 40, 'A') as base_sha,
       lpad(cast(o_custkey as string), 40, 'B') as head_sha,
       case when o_orderkey % 11 = 0 then 'docs/m_' || cast(o_orderkey as string) || '.md'
            else 'models/m_' || cast(o_orderkey as string) || case when o_orderkey % 2 = 0 then '.sql' else '.DDL' end
       end as path,
       case o_orderkey % 10 when 8 then 'added' when 9 then 'removed' when 3 then 'renamed' else 'modified' end as status,
       old_text as before,
       case o_orderkey % 10
         when 0 then old_text
         when 1 then '/* tidy */' || chr(10) || upper(replace(old_text, ', ', ',' || chr(9) || ' '))
         when 2 then replace(old_text, ', note', '')
         when 3 then replace(old_text, ' as gross,', ' as gross_value,')
         when 4 then replace(old_text, 'as int)', 'as bigint)')
         when 5 then replace(old_text, ' / 100.0', '')
         when 6 then old_text || ' and status = ''F'''
         when 7 then 'alter table raw.orders rename column a_' || cast(o_orderkey % 3 as string) || ' to b;' || chr(10)
                     || 'ALTER TABLE raw.orders DROP COLUMN c;' || chr(10) || old_text
         else old_text
       end as after
from (
  select o.*,
         case when o_orderkey % 13 = 0 then '-- deltawarden:dataset=shop.m_' || cast(o_orderkey as string) || chr(10)
              else '' end
         || '-- model of priority ' || o_orderpriority || chr(10)
         || 'select order_id, gross_' || cast(o_custkey % 5 as string)
         || ' as gross, cast(qty as int) as qty, coalesce(disc, 0) / 100.0 as rate, note' || chr(10)
         || 'from {{ ref(''stg_' || cast(o_custkey % 3 as string) || ''') }} join raw.x on true' || chr(10)
         || 'where o_totalprice > ' || cast(cast(floor(o_totalprice) as bigint) as string) as old_text
  from [[orders]] o
) texts
"""

# Two changes per customer: a dropped column and a filter over two columns.
CHANGES = """
select 'a' || cast(c_custkey as string) as analysis_id, 'models/m.sql' as path, 'modified' as file_status, 0 as ordinal,
       'column_dropped' as kind, 'raw.T' || cast(c_custkey % 4 as string) as dataset,
       'Col_' || cast(c_custkey % 5 as string) as changed, cast(null as string) as also
from [[customer]]
union all
select 'a' || cast(c_custkey as string), 'models/m.sql', 'modified', 1, 'filter_changed',
       'raw.T' || cast(c_custkey % 4 as string), 'col_' || cast((c_custkey + 1) % 5 as string),
       'col_' || cast(c_custkey % 5 as string)
from [[customer]]
"""

# One downstream asset per order of the customer.
CONSUMERS = """
select 'a' || cast(o_custkey as string) as analysis_id, 'urn:li:dataset:o' || cast(o_orderkey as string) as urn,
       'asset ' || cast(o_orderkey as string) as name,
       case o_orderkey % 6 when 0 then 'dashboard' when 1 then 'DATASET' when 2 then 'mlModel'
            when 3 then 'feature_table' when 4 then 'chart' else 'dataset' end as type,
       case o_orderkey % 40 when 0 then 'tier_1' when 1 then 'Critical' when 2 then 'tier_2' end as tier,
       case o_orderkey % 3 when 0 then true when 1 then false end as production,
       (o_orderkey % 170 = 7) as business_critical,
       'select sum(col_' || cast(o_orderkey % 7 as string) || ') /* col_0 */ from t where note = ''col_'
         || cast((o_orderkey + 1) % 7 as string) || ''' -- col_1' as sql,
       case when o_orderkey % 2 = 1 then 'COL_' || cast(o_orderkey % 9 as string) end as input_column,
       case o_orderkey % 3 when 0 then '' when 1 then 'RAW.t' || cast(o_orderkey % 4 as string) else 'other' end
         as upstream_dataset,
       '`col_' || cast(o_orderkey % 8 as string) || '`' as upstream_column,
       case when o_orderkey % 5 = 0 then 'Finance' when o_orderkey % 5 = 1 then 'finance'
            else 'team-' || cast(o_custkey % 13 as string) end as owner_name,
       'urn:li:corpGroup:g' || cast(o_orderkey % 4 as string) as owner_urn, o_orderkey as ordinal
from [[orders]]
"""

# What the replays found, one row per order; every third customer was not replayed.
DIFFERENCES = """
select 'a' || cast(case when o_custkey % 3 = 0 then o_custkey + 1 else o_custkey end as string) as analysis_id, 'm_' || cast(o_orderkey as string) as model,
       case o_orderkey % 5 when 0 then 'schema' when 1 then 'volume' when 2 then 'null_rate' when 3 then 'metric'
            else 'distribution' end as category,
       case when o_orderkey % 23 = 0 then cast(null as double)
            when o_orderkey % 5 = 0 then cast(null as double)
            else cast(o_orderkey % 61 - 30 as double) end as magnitude,
       (o_orderkey % 4 = 0) as breached
from [[orders]]
"""

ANALYSES = """
select 'a' || cast(c_custkey as string) as analysis_id, 'acme/shop_' || cast(c_custkey % 7 as string) as repository,
       cast(c_custkey + 1 as int) as pull_request, lpad(cast(c_custkey as string), 40, 'b') as head_sha,
       case c_custkey % 6 when 0 then 'passed' when 1 then 'failed' when 2 then 'not_run' end as execution_status
from [[customer]]
"""

GAPS = """
select 'a' || cast(o_custkey as string) as analysis_id, o_orderkey as ordinal,
       case when o_orderkey % 31 = 0 then 'Dataset identity was not resolved for m_' || cast(o_orderkey % 3 as string)
            else '' end as reason
from [[orders]]
"""

# The order graph: region > nation > customer > order > part > supplier > nation, so it is cyclic.
EDGES = """
select distinct src, dst from (
  select 'region:' || cast(n_regionkey as string) as src, 'nation:' || cast(n_nationkey as string) as dst from [[nation]]
  union all
  select 'nation:' || cast(c_nationkey as string), 'customer:' || cast(c_custkey as string) from [[customer]]
  union all
  select 'customer:' || cast(o_custkey as string), 'order:' || cast(o_orderkey as string) from [[orders]]
  union all
  select 'order:' || cast(l_orderkey as string), 'part:' || cast(l_partkey as string) from [[lineitem]]
  union all
  select 'part:' || cast(l_partkey as string), 'supplier:' || cast(l_suppkey as string) from [[lineitem]]
  union all
  select 'supplier:' || cast(s_suppkey as string), 'nation:' || cast(s_nationkey as string) from [[supplier]]
) e
"""

# One catalogued dataset per part. Names repeat, so a bare name is ambiguous; the qualified name is not.
DATASETS = """
select 'urn:li:dataset:(urn:li:dataPlatform:' || platform || ',' || p_brand || '.' || replace(p_name, ' ', '%20') || '_'
         || cast(p_partkey as string) || ',PROD)' as urn,
       p_brand || '.' || p_name || '_' || cast(p_partkey as string) as qualified, p_name as name, platform,
       p_partkey as number, 'F_' || cast(p_partkey % 5 as string) as field_a,
       'nested.g_' || cast(p_partkey % 7 as string) as field_b, lower(p_type) as field_c
from (select p.*, case when p_partkey % 2 = 0 then 'dbt' else 'snowflake' end as platform from [[part]] p) parts
"""

HINTS = """
select p_partkey as number,
       case p_partkey % 5
         when 0 then upper(p_brand) || '.' || p_name || '_' || cast(p_partkey as string)
         when 1 then '"' || p_name || '"'
         when 2 then p_name || '_' || cast(p_partkey as string)
         when 3 then 'missing_' || cast(p_partkey as string)
         else substr(p_name, 3, 20) || '_' || cast(p_partkey as string) end as hint,
       case p_partkey % 3 when 0 then 'dbt' when 1 then cast(null as string) else 'snowflake' end as platform_hint,
       'f_' || cast(p_partkey % 5 as string) as want_a, 'G_' || cast(p_partkey % 7 as string) as want_b,
       'absent' as want_c
from [[part]]
"""
