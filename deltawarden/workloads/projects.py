"""Queries: replays of changed models from their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltawarden.operators.cycles import strongly_connected
from deltawarden.plans.project import Project, ProjectModel, replay_revisions
from deltawarden.plans.replay import Measures
from deltawarden.workloads.inputs import derive, query, table
from deltawarden.workloads.replays import oracle_compare, oracle_profile, rounded

LINES_SQL = """select l_orderkey as order_id, l_partkey as part_id, l_returnflag as segment,
       cast(l_extendedprice as decimal(12,2)) as gross,
       cast({net} as decimal(18,4)) as net
from {{{{ source('raw', 'lineitem') }}}}{where}"""
RATE = "cast(l_discount as decimal(5,2))"
SCALED = f"cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(5,0)) - {RATE})"
UNSCALED = f"cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(5,0)) - {RATE} * cast(100 as decimal(3,0)))"
REFACTORED = f"cast(l_extendedprice as decimal(12,2)) - cast(l_extendedprice as decimal(12,2)) * {RATE}"
LINES = LINES_SQL.format(net=SCALED, where="")
PARTS = "select p_partkey as part_id, p_brand as brand from {{ source('raw', 'part') }}"
BRANDS = """select p.brand, count(*) as lines, cast(sum(l.gross) as decimal(24,2)) as gross,
       cast(sum(l.net) as decimal(24,4)) as net
from {{ ref('stg_lines') }} l join {{ ref('dim_parts') }} p on l.part_id = p.part_id group by p.brand;"""
FLAGS = """select order_id, segment, case when net * 100 < gross * 95 then 1 else 0 end as is_discounted
from {{ref("stg_lines")}}"""
SEGMENTS = "select segment, sum(is_discounted) as discounted from {{ ref('line_flags') }} group by segment"

MEASURES = {
    "stg_lines": Measures({"total_net": "SUM(net)"}, {"median_net": "MEDIAN(net)"}),
    "fct_brands": Measures({"total_net": "SUM(net)", "total_gross": "SUM(gross)"}),
    "line_flags": Measures({"discounted": "SUM(is_discounted)"}),
    "fct_segments": Measures({"discounted": "SUM(discounted)"}),
}

# What pull requests say: path, text before, text after. A request may change several files.
REVISIONS = {
    "unscaled": [("stg_lines", LINES, LINES_SQL.format(net=UNSCALED, where=""))],
    "refactored": [("stg_lines", LINES, "-- same amounts\n" + LINES_SQL.format(net=REFACTORED, where=""))],
    "fewer_lines": [("stg_lines", LINES, LINES_SQL.format(net=SCALED, where="\nwhere l_quantity < 40"))],
    "fewer_parts": [("dim_parts", PARTS, PARTS + " where p_size > 25"), ("other", "", "select 1")],
    "broken": [("dim_parts", PARTS, PARTS.replace("p_brand", "p_absent"))],
    "cyclic": [("dim_parts", PARTS, "select part_id, brand from {{ ref('fct_brands') }}")],
    "writes": [("line_flags", FLAGS, "drop table t")],
    "untouched": [("other", "select 1", "select 2")],
}


def project(spark: SparkSession, sf_dir: str) -> Project:
    texts = {"fct_segments": SEGMENTS, "fct_brands": BRANDS, "stg_lines": LINES, "line_flags": FLAGS, "dim_parts": PARTS}
    return Project([ProjectModel(name, f"models/{name}.sql", sql, MEASURES.get(name, Measures()))
                    for name, sql in texts.items()],
                   {f"raw.{name}": table(spark, sf_dir, name) for name in ("lineitem", "part")})


def revisions(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    rows = [(f"acme/shop#{number + 1}@{number:040x}", name, "acme/shop", number + 1, f"{number + 1:040x}", f"{number:040x}",
             f"models/{path}.sql", "added" if not before else "modified", before, after)
            for number, (name, files) in enumerate(REVISIONS.items()) if names is None or name in names
            for path, before, after in files]
    return spark.createDataFrame(rows, "key string, analysis_id string, repository string, pull_request int, "
                                       "base_sha string, head_sha string, path string, status string, before string, after string")


# --- check SQL: the models once more for any engine ------------------------------------------

def oracle_lines(net: str, where: str = "") -> str:
    return LINES_SQL.format(net=net, where=f" {where}").replace("{{ source('raw', 'lineitem') }}", "lineitem")


def oracle_models(net: str = SCALED, where: str = "", parts: str = "") -> dict[str, str]:
    lines = oracle_lines(net, where)
    flags = f"select order_id, segment, case when net * 100 < gross * 95 then 1 else 0 end as is_discounted from ({lines}) l"
    return {
        "stg_lines": lines,
        "dim_parts": f"select p_partkey as part_id, p_brand as brand from part {parts}",
        "fct_brands": f"""select p.brand, count(*) as lines, cast(sum(l.gross) as decimal(24,2)) as gross,
            cast(sum(l.net) as decimal(24,4)) as net from ({lines}) l join (
            select p_partkey as part_id, p_brand as brand from part {parts}) p on l.part_id = p.part_id group by p.brand""",
        "line_flags": flags,
        "fct_segments": f"select segment, sum(is_discounted) as discounted from ({flags}) f group by segment",
    }


COLUMNS = {
    "stg_lines": ["order_id", "part_id", "segment", "gross", "net"], "dim_parts": ["part_id", "brand"],
    "fct_brands": ["brand", "lines", "gross", "net"], "line_flags": ["order_id", "segment", "is_discounted"],
    "fct_segments": ["segment", "discounted"]}
ORACLE_MEASURES = {
    "stg_lines": [("metric", "total_net", "cast(sum(net) as double)"),
                  ("distribution", "median_net", "median(cast(net as double))")],
    "fct_brands": [("metric", "total_net", "cast(sum(net) as double)"), ("metric", "total_gross", "cast(sum(gross) as double)")],
    "line_flags": [("metric", "discounted", "cast(sum(is_discounted) as double)")],
    "fct_segments": [("metric", "discounted", "cast(sum(discounted) as double)")],
}


def oracle_analysis(name: str, after: dict[str, str], models: list[str]) -> str:
    before, parts = oracle_models(), []
    for model in models:
        sides = [oracle_profile(side[model], dict.fromkeys(COLUMNS[model], "same"), ORACLE_MEASURES.get(model, []))
                 for side in (before, after)]
        parts.append(f"select '{name}' as analysis_id, 'passed' as execution_status, '{model}' as model, category, metric, "
                     f"before_num, after_num, magnitude, breached from ({oracle_compare(*sides)}) d")
    return "\nunion all\n".join(parts)


ALL_LINES = ["fct_segments", "fct_brands", "stg_lines", "line_flags"]
FAILED = "\nunion all\n".join(
    f"select '{name}', 'failed', null, null, null, null, null, null, null" for name in ("broken", "cyclic", "writes"))
EQUAL = "select 'refactored', 'passed', null, null, null, null, null, null, null"


@query("replay_from_texts", f"""
select * from ({oracle_analysis('unscaled', oracle_models(UNSCALED), ALL_LINES)}) a
union all select * from ({oracle_analysis('fewer_lines', oracle_models(where='where l_quantity < 40'), ALL_LINES)}) b
union all select * from ({oracle_analysis('fewer_parts', oracle_models(parts='where p_size > 25'), ['fct_brands', 'dim_parts'])}) c
union all {EQUAL} union all {FAILED}""")
def replay_from_texts(spark, sf_dir):
    """Differences of every analysis, found from the texts alone; one row for a replay that failed or found none."""
    found = replay_revisions(revisions(spark), project(spark, sf_dir))
    rows = found.execution.join(found.differences, "analysis_id", "left")
    return rounded(rows, "before_num", "after_num", "magnitude").select(
        "analysis_id", "execution_status", "model", "category", "metric", "before_num", "after_num", "magnitude", "breached")


# Parts of a decade refer to the next one; every third decade closes to a ring, and one in seven parts to itself.
REFERENCES = """
select 'p' || cast(p_partkey as string) as src, 'p' || cast(coalesce(
         lead(p_partkey) over (partition by floor(p_partkey / 10) order by p_partkey),
         case when cast(floor(p_partkey / 10) as bigint) % 3 = 0
              then min(p_partkey) over (partition by floor(p_partkey / 10)) end) as string) as dst from [[part]]
union all select 'p' || cast(p_partkey as string), 'p' || cast(p_partkey as string) from [[part]] where p_partkey % 7 = 0
union all select 'o' || cast(l_orderkey as string), 'p' || cast(l_partkey as string) from [[lineitem]]
union all select 'p' || cast(l_partkey as string), 's' || cast(l_suppkey as string) from [[lineitem]]
"""


@query("reference_cycles", """
with rings as (
  select floor(p_partkey / 10) as g, min('p' || cast(p_partkey as varchar)) as component from part
  where cast(floor(p_partkey / 10) as bigint) % 3 = 0 group by 1)
select component, 'p' || cast(p_partkey as varchar) as vertex from part join rings on floor(p_partkey / 10) = g
union all
select 'p' || cast(p_partkey as varchar), 'p' || cast(p_partkey as varchar) from part
where p_partkey % 7 = 0 and cast(floor(p_partkey / 10) as bigint) % 3 <> 0""")
def reference_cycles(spark, sf_dir):
    """Every vertex on a cycle of a reference graph with an edge for each order line."""
    return strongly_connected(derive(spark, sf_dir, REFERENCES))
