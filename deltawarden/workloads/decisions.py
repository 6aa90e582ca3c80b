"""Queries: severity, decisions, reports, evidence, views and the whole analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltawarden.functions.severity import difference_severity, impact_severity, severity_name
from deltawarden.operators import evidence as E
from deltawarden.operators.compare import compare_profiles, comparison_rollup
from deltawarden.operators.consumers import affected_owners, owner_line
from deltawarden.operators.decide import (
    context_completeness, decide_merge, decision_reasons, decision_report, severity_rollup,
)
from deltawarden.operators.profile import profile_table
from deltawarden.plans.analysis import Analysis, analysis_bundles, full_analysis
from deltawarden.plans.view import analysis_view
from deltawarden.session import cut_lineage, scratch_path, spread, with_key
from deltawarden.sources.revisions import scan_revisions
from deltawarden.sources.tables import conform_table, read_typed_csv
from deltawarden.workloads.catalogs import PART_URN, consumers
from deltawarden.workloads.inputs import ANALYSES, CONSUMERS, DIFFERENCES, GAPS, LINES, derive, query, table
from deltawarden.workloads.replays import NET, NET_UNSAFE

# --- severity and decision -------------------------------------------------------------------

RANKED = f"""
select analysis_id, count(*) filter (where breached) as breached_count,
       max(case when not breached then 0 when category = 'schema' then 4 when magnitude is null or abs(magnitude) >= 25 then 4
                when abs(magnitude) >= 10 then 3 else 2 end) as breach_rank
from ({DIFFERENCES}) d group by analysis_id"""
IMPACT = f"""
select analysis_id, count(*) filter (where affected) as affected_asset_count,
       max(case when not affected then 0
                when production and lower(type) in ('mlmodel', 'ml_model', 'feature_table') then 4
                when lower(tier) in ('tier_1', 'critical') or business_critical then 4
                when lower(type) in ('dashboard', 'chart', 'data_product', 'mlmodel', 'ml_model') then 3 else 2 end) as impact_rank
from (select c.*, ordinal % 7 < 2 as affected from ({CONSUMERS}) c) c group by analysis_id"""
DECIDED = f"""
with state as (
  select a.*, coalesce(i.affected_asset_count, 0) as affected, coalesce(d.breached_count, 0) as breached,
         coalesce(a.execution_status, case when d.analysis_id is null then 'not_run' else 'passed' end) as status,
         coalesce(g.n, 0) as gaps,
         case when coalesce(d.breached_count, 0) > 0 then greatest(d.breach_rank, coalesce(i.impact_rank, 0)) else 0 end as rank0
  from ({ANALYSES}) a left join ({IMPACT}) i on i.analysis_id = a.analysis_id
  left join ({RANKED}) d on d.analysis_id = a.analysis_id
  left join (select analysis_id, count(*) as n from ({GAPS}) g where reason <> '' group by 1) g on g.analysis_id = a.analysis_id),
ranked as (select *, case when status = 'failed' then 4 else rank0 end as sev,
                  status = 'not_run' and affected > 0 as replay_missing from state),
decided as (
  select *, status <> 'failed' and (gaps > 0 or replay_missing) as neutral from ranked),
final as (
  select *, case when neutral then 'neutral' when sev >= 3 then 'failure' else 'success' end as conclusion,
         case when neutral and sev = 0 then 'unknown'
              else case sev when 0 then 'none' when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end end as severity
  from decided)
"""


def marked_consumers(spark, sf_dir) -> DataFrame:
    return consumers(spark, sf_dir).withColumn("affected", F.col("ordinal") % 7 < 2)


def decided(spark, sf_dir) -> DataFrame:
    return decide_merge(derive(spark, sf_dir, ANALYSES), marked_consumers(spark, sf_dir),
                        derive(spark, sf_dir, DIFFERENCES), derive(spark, sf_dir, GAPS))


@query("severity_rollup", f"select analysis_id, breached_count, "
       f"case breach_rank when 0 then 'none' when 2 then 'medium' when 3 then 'high' else 'critical' end as severity from ({RANKED}) r")
def severity_query(spark, sf_dir):
    return severity_rollup(derive(spark, sf_dir, DIFFERENCES)).select(
        "analysis_id", "breached_count", severity_name(F.col("breach_rank")).alias("severity"))


@query("severity_of_rows", f"""
select 'difference' as about, model as item, case when not breached then 'none' when category = 'schema' then 'critical'
    when magnitude is null or abs(magnitude) >= 25 then 'critical' when abs(magnitude) >= 10 then 'high' else 'medium' end as severity
from ({DIFFERENCES}) d
union all
select 'consumer', urn, case when ordinal % 7 >= 2 then 'none'
    when production and type in ('mlModel', 'feature_table') then 'critical'
    when tier in ('tier_1', 'Critical') or business_critical then 'critical'
    when type in ('dashboard', 'chart', 'mlModel') then 'high' else 'medium' end from ({CONSUMERS}) c""")
def severity_of_rows(spark, sf_dir):
    found = derive(spark, sf_dir, DIFFERENCES).select(
        F.lit("difference").alias("about"), F.col("model").alias("item"),
        difference_severity(F.col("breached"), F.col("category"), F.col("magnitude")).alias("severity"))
    columns = [F.col(c) for c in ("affected", "type", "tier", "production", "business_critical")]
    return found.unionByName(marked_consumers(spark, sf_dir).select(
        F.lit("consumer").alias("about"), F.col("urn").alias("item"), impact_severity(*columns).alias("severity")))


@query("decide_merge", DECIDED + """
select analysis_id, conclusion, conclusion = 'success' as mergeable, severity, affected as affected_asset_count, breached as breached_count,
       case conclusion when 'neutral' then 'Shadow analysis inconclusive: required evidence is missing'
            when 'failure' then 'Merge blocked: ' || severity || ' data change risk' else 'Shadow analysis passed' end as summary,
       case conclusion when 'success' then 0 when 'failure' then 1 else 2 end as gate_code
from final""")
def decide_query(spark, sf_dir):
    return decided(spark, sf_dir).select(
        "analysis_id", "conclusion", "mergeable", "severity", "affected_asset_count", "breached_count", "summary", "gate_code")


REASONED = DECIDED + f"""
, own as (
  select analysis_id, 0 as section, 0 as place, cast(affected as varchar) || case when affected = 1
    then ' downstream asset references the changed field' else ' downstream assets reference the changed field' end as reason
  from final where affected > 0
  union all select analysis_id, 1, 0, cast(breached as varchar) || case when breached = 1
    then ' counterfactual check exceeded policy thresholds' else ' counterfactual checks exceeded policy thresholds' end
  from final where breached > 0
  union all select analysis_id, 2, 0, 'Counterfactual execution failed' from final where status = 'failed'
  union all select analysis_id, 2, 0, 'Execution evidence is required for affected assets' from final where replay_missing
  union all select g.analysis_id, 3, min(g.ordinal), g.reason from ({GAPS}) g join final f on f.analysis_id = g.analysis_id
    where f.neutral and g.reason <> '' group by g.analysis_id, g.reason
  union all select analysis_id, 4, 0, 'Required counterfactual replay was not run' from final where neutral and replay_missing
  union all select analysis_id, 6, 0, 'No breaking downstream impact detected' from final
    where not neutral and affected = 0 and breached = 0 and status <> 'failed'),
numbered as (select *, row_number() over (partition by analysis_id order by section, place) as rn from own),
bullets as (select analysis_id, string_agg('- ' || reason, chr(10) order by rn) as listed from numbered group by 1)
"""


@query("decision_reasons", REASONED + "select analysis_id, reason, rn as place from numbered")
def reasons_query(spark, sf_dir):
    from pyspark.sql import Window

    reasons = decision_reasons(cut_lineage(decided(spark, sf_dir)), derive(spark, sf_dir, GAPS))
    order = Window.partitionBy("analysis_id").orderBy("position")
    return reasons.select("analysis_id", "reason", F.row_number().over(order).alias("place"))


@query("decision_report", REASONED + f"""
, owners as (
  select analysis_id, string_agg(owner, ', ' order by owner_key) as names from (
    select analysis_id, lower(owner_name) as owner_key, arg_min(owner_name, ordinal) as owner
    from ({CONSUMERS}) c where ordinal % 7 < 2 group by 1, 2) o group by 1)
select f.analysis_id, f.head_sha, f.conclusion,
       case f.conclusion when 'failure' then 'Unsafe data change blocked' when 'neutral' then 'Data change analysis is inconclusive'
            else 'Data change is safe to merge' end as title,
       'Commit: `' || f.head_sha || '`' || chr(10) || 'Pull request: #' || cast(f.pull_request as varchar) || chr(10)
       || 'Risk: ' || f.severity || chr(10) || 'Affected assets: ' || cast(f.affected as varchar) || chr(10)
       || 'Route to: ' || coalesce(o.names, 'no affected owner found in DataHub') || chr(10) || chr(10) || 'Evidence:' || chr(10)
       || b.listed as text, true as valid
from final f left join owners o on o.analysis_id = f.analysis_id left join bullets b on b.analysis_id = f.analysis_id""")
def report_query(spark, sf_dir):
    # Read by the reasons and by the report, so written once.
    gaps, verdicts = derive(spark, sf_dir, GAPS), cut_lineage(decided(spark, sf_dir))
    owners = owner_line(affected_owners(marked_consumers(spark, sf_dir)))
    return decision_report(verdicts, decision_reasons(verdicts, gaps), owners).drop("summary")


@query("evidence_records", REASONED + """
, keyed as (select *, 'deltawarden:' || repository || '#' || cast(pull_request as varchar) || '@' || head_sha as k from final)
select k.analysis_id, 'urn:li:document:deltawarden_' || sha256(k) as target_urn, k as idempotency_key,
       'Deltawarden: ' || repository || ' PR #' || cast(pull_request as varchar) || ' @ ' || substr(head_sha, 1, 12) as title,
       '<!-- ' || k || ' -->' || chr(10) || '# Deltawarden decision: '
       || case conclusion when 'failure' then 'BLOCKED' when 'neutral' then 'INCONCLUSIVE' else 'PASSED' end || chr(10) || chr(10)
       || '- Repository: `' || repository || '`' || chr(10) || '- Pull request: #' || cast(pull_request as varchar) || chr(10)
       || '- Commit: `' || head_sha || '`' || chr(10) || '- Severity: ' || severity || chr(10)
       || '- Affected assets: ' || cast(affected as varchar) || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) || b.listed as body,
       'Analysis ID is not scoped to the head commit' as problem
from keyed k join bullets b on b.analysis_id = k.analysis_id""")
def evidence_query(spark, sf_dir):
    verdicts = cut_lineage(decided(spark, sf_dir))
    return E.evidence_records(verdicts, decision_reasons(verdicts, derive(spark, sf_dir, GAPS)))


CONTEXT_IDENTITIES = """
select 'a' || cast(o_custkey as string) as analysis_id, o_orderkey as change_ordinal, 'm_' || cast(o_orderkey % 4 as string) as hint,
       case when o_orderkey % 3 <> 0 then 'urn:li:dataset:m_' || cast(o_orderkey % 4 as string) end as urn,
       (o_orderkey % 6 = 0) as ambiguous, case when o_orderkey % 7 = 0 then 'x,y' else '' end as missing,
       o_orderkey % 5 as consumer_count,
       case o_orderkey % 4 when 0 then 'Lineage stopped at the 100-node safety limit.' when 1 then 'text was truncated'
            when 2 then 'request timed out' else 'all fine' end as warning
from [[orders]]"""
SOURCES = """
select 'a' || cast(c_custkey as string) as analysis_id, case c_custkey % 4 when 0 then 'live' when 1 then 'demo' when 2 then 'deterministic' end
       as source, c_custkey % 4 < 3 as has_context, c_custkey % 9 <> 0 as has_change from [[customer]]"""


@query("context_completeness", f"""
with s as (select * from ({SOURCES}) s), i as (select i.* from ({CONTEXT_IDENTITIES}) i join s on s.analysis_id = i.analysis_id and s.has_context)
select analysis_id, 'No supported SQL or schema change was detected' as reason from s where not has_change
union select analysis_id, 'DataHub identity and lineage context is unavailable' from s where not has_context
union select analysis_id, 'DataHub context did not come from a live catalog' from s where has_context and source = 'demo'
union select analysis_id, 'Dataset identity was not resolved for ' || hint from i where urn is null
union select analysis_id, 'Dataset identity is ambiguous for ' || hint from i where ambiguous
union select analysis_id, 'DataHub schema is missing changed columns: x, y' from i where missing <> ''
union select analysis_id, 'No downstream lineage evidence was returned for ' || urn from i where urn is not null and consumer_count = 0
union select analysis_id, 'Lineage completeness warning: ' || warning from i where warning like '%limit%' or warning like '%timed out%'""")
def completeness_query(spark, sf_dir):
    sources = derive(spark, sf_dir, SOURCES)
    rows = derive(spark, sf_dir, CONTEXT_IDENTITIES)
    identities = rows.withColumn("missing_columns", F.filter(F.split("missing", ","), lambda m: m != ""))
    return context_completeness(
        sources, sources.filter("has_change"), sources.filter("has_context"), identities,
        rows.select("analysis_id", "warning")).select("analysis_id", "reason")


# --- sources and sinks -----------------------------------------------------------------------

CSV_TYPES = {"order_id": "BIGINT", "customer_id": "VARCHAR", "order_date": "DATE", "gross_amount": "DOUBLE",
             "discount_percentage": "DOUBLE"}


@query("csv_typed_scan", """
select o_orderkey as order_id, 'C-' || cast(o_custkey as varchar) as customer_id, cast(o_orderdate as date) as order_date,
       o_totalprice as gross_amount, case when o_orderkey % 4 <> 0 then cast(o_custkey % 40 as double) end as discount_percentage
from orders""")
def csv_typed_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit(" C-"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_totalprice").alias("gross_amount"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") % 40).alias("discount_percentage"),
    ).write.option("header", True).option("emptyValue", "").csv(path)
    return read_typed_csv(spark, path, CSV_TYPES)


@query("typed_table_scan", """
select l_orderkey, cast(l_linenumber as smallint) as l_linenumber, cast(l_quantity as decimal(10,2)) as l_quantity,
       cast(l_partkey as bigint) as l_partkey, cast(l_shipdate as date) as l_shipdate, l_returnflag,
       cast(null as varchar) as note from lineitem""")
def typed_table_scan(spark, sf_dir):
    types = {"l_orderkey": "BIGINT", "l_linenumber": "UTINYINT", "l_quantity": "DECIMAL(10,2)", "l_partkey": "UINTEGER",
             "l_shipdate": "DATE", "l_returnflag": "VARCHAR(1)", "note": "VARCHAR"}
    return conform_table(table(spark, sf_dir, "lineitem").select(*[c for c in types if c != "note"]), types)


BUNDLES = """
select o_orderkey as number, lpad(cast(o_custkey as string), 40, 'c') as requested_head_sha,
       case o_orderkey % 6
         when 0 then '{"schemaVersion": "1", "generatedFor": {"headSha": "' || upper(lpad(cast(o_custkey as string), 40, 'c'))
              || '"}, "decision": {"severity": "' || o_orderstatus || '"}}'
         when 1 then '{"schemaVersion": "2", "decision": {"severity": "high"}}'
         when 2 then '{"schemaVersion": "3", "decision": {"severity": "high"}}'
         when 3 then '{"schemaVersion": "1", "decision": {"severity": '
         when 4 then '{"decision": {"severity": "low"}}'
         else '{"schemaVersion": "1", "generatedFor": {"headSha": "' || lpad(cast(o_custkey + 1 as string), 40, 'c') || '"}}' end as content
from [[orders]]"""


@query("evidence_scan", f"""
select number, case number % 6 when 0 then null when 1 then null when 2 then 'Unsupported evidence schema version: 3'
    when 3 then 'Evidence JSON is malformed' when 4 then 'Unsupported evidence schema version: undefined'
    else 'Evidence artifact head SHA does not match PR' end as reject_reason,
  case number % 6 when 0 then (select o_orderstatus from orders where o_orderkey = number) when 1 then 'high' end as severity
from ({BUNDLES}) b""")
def evidence_scan(spark, sf_dir):
    scanned = E.scan_bundles(derive(spark, sf_dir, BUNDLES))
    return scanned.select("number", "reject_reason", F.when(
        F.col("reject_reason").isNull(), F.col("evidence.decision.severity")).alias("severity"))


CHECKS = """
select lpad(cast(o_custkey as string), 40, 'd') as head_sha, o_orderkey as ordinal,
       case o_orderkey % 3 when 0 then 'lint' else 'Data CHANGE impact' end as name,
       case when o_orderkey % 5 = 0 then '' else 'Commit: `x`' || chr(10) || 'Risk: ' || o_orderpriority || ' ' || chr(10)
       || 'Affected assets: ' || cast(o_custkey % 17 as string) || chr(10) || 'Route to: a, ' || o_orderstatus || chr(10)
       || chr(10) || 'Evidence:' || chr(10) || '- first ' || cast(o_orderkey as string) || chr(10) || '- second' end as text
from [[orders]]"""


@query("check_text_extract", f"""
with first as (select head_sha, arg_min(ordinal, ordinal) as ordinal from ({CHECKS}) c where name = 'Data CHANGE impact' group by 1)
select f.head_sha, case when f.ordinal % 5 = 0 then 'unknown' else o_orderpriority end as risk,
       case when f.ordinal % 5 = 0 then 0 else o_custkey % 17 end as affected_assets,
       case when f.ordinal % 5 = 0 then '' else 'a, ' || o_orderstatus end as owner_routing,
       case when f.ordinal % 5 = 0 then '' else 'first ' || cast(f.ordinal as varchar) || '|second' end as reasons
from first f join orders on o_orderkey = f.ordinal""")
def check_text_query(spark, sf_dir):
    found = E.extract_check_text(derive(spark, sf_dir, CHECKS), "data change impact")
    return found.withColumn("reasons", F.array_join("reasons", "|"))


ARTIFACTS = """
select o_orderkey as artifact_id, 'evidence-' || lpad(cast(o_orderkey as string), 40, 'a') || '-' || upper(lpad(cast(o_custkey as string), 40, 'e')) || '-run' as name,
       (o_orderkey % 3 = 0) as expired, case when o_orderkey % 7 = 0 then 5000001 else 100 end as size_bytes from [[orders]]"""


@query("evidence_freshness", f"""
with first as (select lower(substr(name, 51, 40)) as head_sha, max(artifact_id) as artifact_id from ({ARTIFACTS}) a
               where not expired group by 1)
select c_custkey as number, f.artifact_id, case when f.artifact_id is null then 'missing' when f.artifact_id % 7 = 0 then 'oversized'
       else 'fresh' end as status
from customer left join first f on f.head_sha = lpad(cast(c_custkey as varchar), 40, 'e')""")
def freshness_query(spark, sf_dir):
    heads = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("number"), F.lpad(F.col("c_custkey").cast("string"), 40, "e").alias("head_sha"))
    return E.evidence_freshness(heads, derive(spark, sf_dir, ARTIFACTS), size_limit=5_000_000).select("number", "artifact_id", "status")


@query("evidence_bundle_write", DECIDED + "select analysis_id, repository, conclusion, severity, affected as affected_asset_count from final")
def bundle_write(spark, sf_dir):
    path = scratch_path(spark, "bundles")
    verdicts = decided(spark, sf_dir)
    content = E.bundle_json(F.struct(
        F.lit("1").alias("schemaVersion"),
        F.struct("repository", F.col("pull_request").alias("pullRequest"), F.lit("").alias("baseSha"),
                 F.col("head_sha").alias("headSha")).alias("generatedFor"),
        F.struct("conclusion", "severity", F.col("affected_asset_count").cast("int").alias("affectedAssetCount"),
                 "summary").alias("decision")))
    bundles = verdicts.select("analysis_id", "repository", F.col("head_sha").alias("requested_head_sha"),
                              content.alias("content"), "pull_request")
    # Two batches that share repositories, and one analysis in three written again.
    E.write_bundles(bundles.filter("pull_request % 2 = 0").drop("pull_request"), path)
    E.write_bundles(bundles.filter("pull_request % 2 = 1 or pull_request % 3 = 0").drop("pull_request"), path)
    read = E.scan_bundles(E.read_bundles(spark, path)).filter("reject_reason is null")
    return read.select("analysis_id", "repository", "evidence.decision.conclusion", "evidence.decision.severity",
                       F.col("evidence.decision.affectedAssetCount").cast("bigint").alias("affected_asset_count"))


STORED = """select 'urn:li:document:d' || cast(c_custkey % 1000 as string) as target_urn, 'k' || cast(c_custkey % 1000 as string)
  as idempotency_key, 'old' as title, '<!-- k' || cast(c_custkey % 1000 as string) || ' -->' as body, c_custkey as version from [[customer]]"""
INCOMING = """select 'urn:li:document:d' || cast(o_custkey as string) as target_urn, 'k' || cast(o_custkey as string) as idempotency_key,
  'new ' || cast(o_orderkey as string) as title,
  case when o_orderkey % 50 = 0 then 'lost' else '<!-- k' || cast(o_custkey as string) || ' -->' end as body, o_orderkey as version from [[orders]]"""


@query("evidence_upsert", f"""
with s as (select target_urn, max(version) as version from ({STORED}) s group by 1),
     i as (select target_urn, arg_max(title, version) as title, arg_max(body, version) as body, max(version) as version from ({INCOMING}) i group by 1)
select coalesce(i.target_urn, s.target_urn) as target_urn, coalesce(i.title, 'old') as title, coalesce(i.version, s.version) as version,
       case when i.target_urn is null then 'kept' when s.target_urn is null then 'created' else 'updated' end as action,
       coalesce(i.body = 'lost', false) as unverified
from i full outer join s on s.target_urn = i.target_urn""")
def upsert_query(spark, sf_dir):
    path, incoming = scratch_path(spark, "evidence"), derive(spark, sf_dir, INCOMING)
    E.write_evidence(derive(spark, sf_dir, STORED), path)
    written, missing = E.write_evidence(incoming, path)
    lost = missing.select("target_urn", F.lit(True).alias("unverified"))
    sent = incoming.select("target_urn", F.lit(True).alias("sent")).distinct()
    return written.join(lost, "target_urn", "left").join(sent, "target_urn", "left").select(
        "target_urn", "title", "version", F.when(F.col("sent"), F.col("action")).otherwise("kept").alias("action"),
        F.coalesce("unverified", F.lit(False)).alias("unverified"))


@query("evidence_assets", f"""
select distinct 'urn:li:document:' || analysis_id as target_urn, case when ordinal % 9 = 0 then 'not a urn' else urn end as asset_urn,
       ordinal % 9 <> 0 as valid from ({CONSUMERS}) c where ordinal % 7 < 2""")
def assets_query(spark, sf_dir):
    affected = marked_consumers(spark, sf_dir).filter("affected")
    related = affected.select("analysis_id", F.when(F.col("ordinal") % 9 == 0, "not a urn").otherwise(
        F.col("urn")).alias("asset_urn")).distinct()
    records = derive(spark, sf_dir, ANALYSES).select(
        "analysis_id", F.concat(F.lit("urn:li:document:"), "analysis_id").alias("target_urn"))
    return E.evidence_assets(records, related)


# --- view and whole analysis -----------------------------------------------------------------

@query("analysis_view", """
with base as (select c_custkey as n, 'a' || cast(c_custkey as varchar) as analysis_id, c_custkey % 4 as kind from customer)
select 'header' as section, analysis_id, case kind when 0 then 'critical' when 1 then 'medium' else 'unknown' end as key,
       case when kind = 0 then 'commit_scoped_evidence' else 'missing' end as value,
       case kind when 0 then null when 1 then 'Unsupported evidence schema version: 9' else 'No evidence artifact found for this commit' end as note
from base
union all select 'consumer', analysis_id, 'urn:c' || cast(n as varchar), 'dataset', 'true' from base where kind = 0
union all select 'consumer', analysis_id, 'urn:d' || cast(n as varchar), 'chart', 'false' from base where kind = 0
union all select 'measure', analysis_id, 'total', 'metric', 'true' from base where kind = 0
union all select 'node', analysis_id, 'urn:r' || cast(n as varchar), 'DATASET', '0' from base where kind = 0
union all select 'node', analysis_id, 'urn:c' || cast(n as varchar), 'DATASET', '1' from base where kind = 0
union all select 'edge', analysis_id, 'urn:r' || cast(n as varchar), 'urn:c' || cast(n as varchar), null from base where kind = 0
union all select 'owner', analysis_id, 'Finance', null, null from base where kind = 0
union all select 'owner', analysis_id, 'data', null, null from base where kind = 1
union all select 'owner', analysis_id, 'ml', null, null from base where kind = 1""")
def view_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("n"), F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("analysis_id"),
        F.lpad(F.col("c_custkey").cast("string"), 40, "f").alias("head_sha"), (F.col("c_custkey") % 4).alias("kind"))
    n = F.col("n").cast("string")

    def asset(prefix, kind, **more):
        fields = [F.concat(F.lit(prefix), n).alias("urn"), F.lit("x").alias("name"), F.lit(kind).cast("string").alias("type")]
        return F.struct(*fields, *[v.alias(k) for k, v in more.items()])

    def owners(name):
        return F.array(F.struct(F.lit("u").alias("urn"), F.lit(name).alias("name"), F.lit("g").alias("type")))

    content = F.to_json(F.struct(
        F.when(F.col("kind") == 1, "9").otherwise("2").alias("schemaVersion"),
        F.struct(F.lit("critical").alias("severity")).alias("decision"),
        F.array(asset("urn:c", None, classification=F.lit("true_consumer"), affected=F.lit(True), owners=owners("Finance")),
                asset("urn:d", "chart", classification=F.lit("lineage_only"), affected=F.lit(False), owners=owners("Else")),
                ).alias("consumers"),
        F.array(F.struct(F.lit("m").alias("model"), F.lit("metric").alias("category"), F.lit("total").alias("metric"),
                         F.lit(True).alias("breached"))).alias("differences"),
        F.struct(F.array(F.struct(
            F.concat(F.lit("urn:r"), n).alias("urn"), F.lit("root").alias("name"), F.lit("dbt").alias("platform"),
            F.array(asset("urn:c", None)).alias("consumers"))).alias("changes")).alias("context")))
    bundles = E.scan_bundles(customers.filter("kind < 2").select(
        "analysis_id", F.col("head_sha").alias("requested_head_sha"), content.alias("content")))
    texts = customers.filter("kind = 1").select(
        "head_sha", F.lit("medium").alias("risk"), F.lit(1).alias("affected_assets"),
        F.lit("data, ml").alias("owner_routing"))
    view = analysis_view(customers.select("analysis_id", "head_sha"), bundles, texts)
    none = F.lit(None).cast("string")

    def part(df, section, key, value=none, note=none):
        return df.select(F.lit(section).alias("section"), "analysis_id", key.alias("key"), value.alias("value"),
                         note.cast("string").alias("note"))

    c = F.col
    return (
        part(view.header, "header", c("risk_level"), c("evidence_source"), c("evidence_note"))
        .unionByName(part(view.consumers, "consumer", c("urn"), c("type"), c("affected")))
        .unionByName(part(view.measurements, "measure", c("metric"), c("category"), c("breached")))
        .unionByName(part(view.nodes, "node", c("urn"), c("type"), c("degree")))
        .unionByName(part(view.edges, "edge", c("src"), c("dst")))
        .unionByName(part(view.owners, "owner", c("owner"))))


def whole_analysis(spark, sf_dir) -> Analysis:
    """Every part is a model in a pull request of ten; its order lines are the data the change is replayed on."""
    parts, lines = spread(table(spark, sf_dir, "part")), table(spark, sf_dir, "lineitem")
    group = F.floor(F.col("p_partkey") / 10)
    name = F.concat(F.lit("shop.part_"), F.col("p_partkey").cast("string"))
    text = F.concat(
        F.lit("-- deltawarden:dataset="), name,
        F.lit("\nselect id, gross * (1 - discount / 100.0) as net\nfrom {{ source('raw', 'lines') }}"))
    exported = parts.select(
        F.lit("acme/shop").alias("repository"), (group + 1).cast("int").alias("pull_request"),
        F.when(group % 7 == 3, F.lpad(group.cast("string"), 40, "b")).otherwise(F.lpad(group.cast("string"), 40, "a"))
        .alias("base_sha"), F.lpad(group.cast("string"), 40, "b").alias("head_sha"),
        F.concat(F.lit("models/"), name, F.lit(".sql")).alias("path"), F.lit("modified").alias("status"),
        text.alias("before"), F.when(group % 3 == 0, text).when(group % 3 == 1, F.replace(
            text, F.lit("gross * (1 - discount / 100.0)"), F.lit("gross - gross * discount / 100.0"))).otherwise(
            F.replace(text, F.lit(" / 100.0"), F.lit(""))).alias("after"))
    revisions = scan_revisions(exported)
    urn = F.expr(PART_URN.replace("l_partkey", "p_partkey"))
    none = F.lit(None).cast("string")
    catalog = parts.select(
        urn.alias("urn"), name.alias("name"), F.lit("DATASET").alias("type"), F.lit("dbt").alias("platform"),
        F.array(F.struct(F.lit("net").alias("field_path"), F.lit("DOUBLE").alias("native_type"), none.alias("description"))).alias("fields"),
        F.array(F.struct(F.lit("urn:li:corpGroup:a").alias("urn"), F.lit("Analytics").alias("name"), F.lit("g").alias("type"))).alias("owners"),
        none.alias("tier"), F.lit(None).cast("boolean").alias("production"), F.lit(None).cast("boolean").alias("business_critical"))
    supplier = F.concat(F.lit("urn:li:dashboard:(looker,supplier_"), F.col("l_suppkey").cast("string"), F.lit(")"))
    edges = lines.select("l_partkey", "l_suppkey").distinct().select(F.expr(PART_URN).alias("src"), supplier.alias("dst"))
    columns = edges.select(F.col("src").alias("src_urn"), F.lit("net").alias("src_field"),
                           F.col("dst").alias("dst_urn"), F.lit("total").alias("dst_field"))
    boards = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("urn:li:dashboard:(looker,supplier_"), F.col("s_suppkey").cast("string"), F.lit(")")).alias("urn"),
        F.col("s_name").alias("name"), F.lit("DASHBOARD").alias("type"), F.lit("looker").alias("platform"),
        F.lit(None).cast(catalog.schema["fields"].dataType).alias("fields"),
        F.array(F.struct(F.lit("urn:li:corpGroup:f").alias("urn"), F.lit("Finance").alias("name"), F.lit("g").alias("type"))).alias("owners"),
        F.when(F.col("s_suppkey") % 10 == 0, "tier_1").alias("tier"), F.lit(True).alias("production"),
        F.lit(False).alias("business_critical"))
    line_group = F.floor(F.col("l_partkey") / 10)
    source = derive(spark, sf_dir, LINES.replace("l_returnflag as", "l_partkey, l_returnflag as"))
    keyed = source.withColumn("analysis_id", F.concat(
        F.lit("acme/shop#"), (line_group + 1).cast("string"), F.lit("@"), F.lpad(line_group.cast("string"), 40, "b")))
    after = F.when(line_group % 3 == 2, F.expr(NET_UNSAFE)).otherwise(F.expr(NET)).cast("decimal(22,6)")
    sides = [
        with_key(profile_table(keyed.select("analysis_id", value.alias("net")), {"total": "SUM(net)"}, keys=["analysis_id"]),
                 {"side": side, "model": "lines"})
        for side, value in (("before", F.expr(NET).cast("decimal(22,6)")), ("after", after))]
    differences = compare_profiles(sides[0].unionByName(sides[1]))
    # Nobody says that a replay passed: equal sides are known from the comparison, and one replay in seven failed.
    numbers = keyed.select("analysis_id", line_group.alias("number")).distinct()
    execution = numbers.filter("number % 7 = 5").select(
        "analysis_id", F.lit("failed").alias("execution_status"), F.lit("out of memory").alias("execution_error"))
    skipped = numbers.filter("number % 7 = 6").select("analysis_id", F.lit("Model was not replayed: m").alias("reason"))
    return full_analysis(
        revisions, catalog.unionByName(boards), edges, columns, differences, execution, depth=2, skipped=skipped,
        comparisons=comparison_rollup(differences, scope=numbers))


@query("full_analysis", """
with g as (select distinct floor(p_partkey / 10) as g from part),
lines as (select floor(l_partkey / 10) as g, count(distinct l_suppkey) as assets from lineitem group by 1)
select 'acme/shop#' || cast(cast(g.g + 1 as bigint) as varchar) || '@' || lpad(cast(cast(g.g as bigint) as varchar), 40, 'b') as analysis_id,
       case when g.g % 7 = 3 then 'rejected' when g.g % 7 = 5 then 'failure' when g.g % 3 = 0 or g.g % 7 = 6 then 'neutral'
            when g.g % 3 = 1 then 'success' else 'failure' end as conclusion,
       case when g.g % 7 = 3 then 'unknown' when g.g % 7 = 5 then 'critical' when g.g % 3 = 0 then 'unknown'
            when g.g % 3 = 1 then case when g.g % 7 = 6 then 'unknown' else 'none' end else 'critical' end as severity,
       case when g.g % 3 = 0 or g.g % 7 = 3 then 0 else coalesce(l.assets, 0) end as affected_asset_count,
       case when g.g % 3 = 0 or g.g % 7 = 3 then 'Route to: no affected owner found in DataHub' else 'Route to: Finance' end as routing,
       case when g.g % 7 = 3 then 'base_equals_head' when g.g % 7 = 5 then 'out of memory'
            when g.g % 7 = 6 then 'Model was not replayed: m' end as special
from g left join lines l on l.g = g.g""")
def full_analysis_query(spark, sf_dir):
    result = whole_analysis(spark, sf_dir)
    routing = result.report.select("analysis_id", F.regexp_extract("text", r"(?m)^(Route to: .*)$", 1).alias("routing"))
    special = result.reasons.filter(F.col("reason").isin(
        "base_equals_head", "out of memory", "Model was not replayed: m")).select("analysis_id", F.col("reason").alias("special"))
    return result.decisions.join(routing, "analysis_id").join(special, "analysis_id", "left").select(
        "analysis_id", "conclusion", "severity", "affected_asset_count", "routing", "special")


@query("analysis_bundle_view", """
with g as (select distinct floor(p_partkey / 10) as g from part),
lines as (select floor(l_partkey / 10) as g, count(distinct l_suppkey) as assets from lineitem group by 1)
select 'acme/shop#' || cast(cast(g.g + 1 as bigint) as varchar) || '@' || lpad(cast(cast(g.g as bigint) as varchar), 40, 'b') as analysis_id,
       case when g.g % 7 = 3 then 'unknown' when g.g % 7 = 5 then 'critical' when g.g % 3 = 0 then 'unknown'
            when g.g % 3 = 1 then case when g.g % 7 = 6 then 'unknown' else 'none' end else 'critical' end as risk_level,
       'commit_scoped_evidence' as evidence_source,
       case when g.g % 3 = 0 or g.g % 7 = 3 then 0 else coalesce(l.assets, 0) end as affected,
       case when g.g % 3 = 2 then 1 else 0 end as breaches
from g left join lines l on l.g = g.g""")
def bundle_view_query(spark, sf_dir):
    """What the whole analysis found, written as bundles, read back and shown."""
    path = scratch_path(spark, "bundles")
    stored = E.write_bundles(analysis_bundles(whole_analysis(spark, sf_dir)), path)
    scanned = cut_lineage(E.scan_bundles(stored))
    texts = spark.createDataFrame([], "head_sha string, risk string, affected_assets bigint, owner_routing string")
    heads = stored.select("analysis_id", F.col("requested_head_sha").alias("head_sha"))
    view = analysis_view(heads, scanned, texts)
    affected = view.consumers.filter("affected").groupBy("analysis_id").agg(F.count("*").alias("affected"))
    breaches = view.measurements.filter("breached").groupBy("analysis_id").agg(F.count("*").alias("breaches"))
    zero = F.lit(0)
    return view.header.join(affected, "analysis_id", "left").join(breaches, "analysis_id", "left").select(
        "analysis_id", "risk_level", "evidence_source", F.coalesce("affected", zero).alias("affected"),
        F.coalesce("breaches", zero).alias("breaches"))
