"""Queries: file revisions, diffs, SQL text and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltawarden.functions import sqltext as S
from deltawarden.functions.safetext import evidence_text
from deltawarden.operators.checks import RevisionLimits, file_summary, revision_violations, screen_sql
from deltawarden.operators.detect import dedupe_changes, detect_changes
from deltawarden.session import settle
from deltawarden.sources.revisions import scan_revisions
from deltawarden.workloads.inputs import EXPORTED, derive, query, table

ID_SQL = "repository || '#' || cast(pull_request as string) || '@' || lower(head_sha)"
SCANNED = f"""
select {ID_SQL} as analysis_id, repository, pull_request, lower(base_sha) as base_sha, lower(head_sha) as head_sha,
       path, status, case when status = 'added' then '' else before end as before,
       case when status = 'removed' then '' else after end as after
from ({EXPORTED}) exported"""


def revisions(spark, sf_dir) -> DataFrame:
    return scan_revisions(with_texts(derive(spark, sf_dir, EXPORTED, heavy=True)))


def with_texts(exported: DataFrame) -> DataFrame:
    """The derived texts are long expressions, built once here; a real export would simply be read."""
    kept = exported.withColumnsRenamed({"before": "_before", "after": "_after"})
    return settle(kept, {"before": F.col("_before"), "after": F.col("_after")}).drop("_before", "_after")


@query("revision_scan", SCANNED)
def revision_scan(spark, sf_dir):
    return revisions(spark, sf_dir)


@query("revision_file_summary", f"""
select analysis_id, count(*) as received,
       count(*) filter (where lower(path) like '%.sql' or lower(path) like '%.ddl') as analyzed,
       count(*) filter (where not (lower(path) like '%.sql' or lower(path) like '%.ddl')) as ignored
from ({SCANNED}) r group by analysis_id""")
def revision_file_summary(spark, sf_dir):
    return file_summary(revisions(spark, sf_dir))


# Revisions with every kind of defect; one in 2111 is a file of two megabytes.
DEFECTIVE = f"""
select {ID_SQL} as analysis_id, case when number % 71 = 0 then 'no-slash' else repository end as repository,
       case when number % 73 = 0 then 0 else pull_request end as pull_request,
       case when number % 79 = 0 then head_sha else base_sha end as base_sha,
       case when number % 83 = 0 then substr(head_sha, 1, 39) else head_sha end as head_sha,
       case when number % 97 = 0 then '/abs/' || path when number % 101 = 0 then 'a/../' || path
            when number % 107 = 0 then 'models/same.sql' when number % 109 = 0 then '' else path end as path,
       case when number % 103 = 0 then 'copied' when number % 113 = 0 then 'added' when number % 127 = 0 then 'removed'
            else 'modified' end as status,
       case when number % 2111 = 0 then repeat('x', 2000001) else before end as before, after
from ({EXPORTED}) e"""


@query("revision_validate", f"""
with d as materialized (select analysis_id, repository, pull_request, base_sha, head_sha, path, status,
                               octet_length(encode(before)) as ob, octet_length(encode(after)) as oa from ({DEFECTIVE}) x)
select distinct analysis_id, path, 'path_required' as rule from d where path = ''
union all select distinct analysis_id, path, 'path_absolute' from d where starts_with(path, '/')
union all select distinct analysis_id, path, 'path_traversal' from d where path like 'a/../%'
union all select distinct analysis_id, path, 'status_unsupported' from d where status = 'copied'
union all select distinct analysis_id, path, 'added_has_before' from d where status = 'added' and ob > 0
union all select distinct analysis_id, path, 'removed_has_after' from d where status = 'removed' and oa > 0
union all select distinct analysis_id, path, 'file_too_large' from d where ob + oa > 1000000
union all select analysis_id, path, 'path_duplicate' from d group by 1, 2 having count(*) > 1
union all select distinct analysis_id, null, 'repository_malformed' from d where repository = 'no-slash'
union all select distinct analysis_id, null, 'pull_request_not_positive' from d where pull_request <= 0
union all select distinct analysis_id, null, 'head_sha_malformed' from d where length(head_sha) <> 40
union all select distinct analysis_id, null, 'base_equals_head' from d where base_sha = head_sha
union all select analysis_id, null, 'too_many_files' from d group by 1 having count(*) > 100
union all select analysis_id, null, 'total_too_large' from d group by 1 having sum(ob + oa) > 2000000""")
def revision_validate(spark, sf_dir):
    limits = RevisionLimits(max_files=100, max_file_bytes=1_000_000, max_total_bytes=2_000_000)
    return revision_violations(with_texts(derive(spark, sf_dir, DEFECTIVE, heavy=True)), limits)


PATCHES = """
select cast(o_orderkey as bigint) as number,
       'diff --git a/m b/m' || chr(10) || 'index 1..2' || chr(10) || '--- a/m' || chr(10) || '+++ b/m' || chr(10)
       || '@@ -1,3 +1,3 @@' || chr(10) || ' select ' || o_orderstatus || chr(13) || chr(10)
       || '-old ' || o_orderpriority || chr(10) || '+new ' || cast(o_custkey as string) || chr(10)
       || case when o_orderkey % 3 = 0 then '\\ No newline' || chr(10) else '' end || ' from t' || chr(10) as patch,
       o_orderstatus, o_orderpriority, o_custkey
from [[orders]]"""


@query("diff_reconstruct", f"""
select number, 'select ' || o_orderstatus || chr(10) || 'old ' || o_orderpriority || chr(10) || 'from t' as before,
       'select ' || o_orderstatus || chr(10) || 'new ' || cast(o_custkey as varchar) || chr(10) || 'from t' as after
from ({PATCHES}) p""")
def diff_reconstruct(spark, sf_dir):
    spark_sql = PATCHES.replace("'\\ No", "'\\\\ No")
    return derive(spark, sf_dir, spark_sql).select("number", S.split_patch(F.col("patch")).alias("s")).select(
        "number", "s.before", "s.after")


# --- text functions over whole documents -----------------------------------------------------

@query("sql_normalize", r"""
select doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '--[^\n\r\x{2028}\x{2029}]*', '', 'g'),
         '/\*[\s\S]*?\*/', '', 'g'), '[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'), ' ')) as normalized
from documents""")
def sql_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize_sql(F.col("text")).alias("normalized"))


@query("consumer_identifiers", r"""
select doc_id, lower(word) as identifier from (
  select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(
    regexp_replace(regexp_replace(regexp_replace(text, '--[^\n\r\x{2028}\x{2029}]*', ' ', 'g'), '/\*[\s\S]*?\*/', ' ', 'g'),
                   '''[^'']*''', ' ', 'g'),
    '[0-9A-Za-z_$]*[A-Za-z_0-9]'), lambda w: lower(ltrim(w, '$'))))) as word from documents) w
where regexp_matches(word, '^[a-z_]')""")
def consumer_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(S.sql_identifiers(F.col("text"))).alias("identifier"))


@query("text_redaction", r"""
select page_id, case when cut = '' then 'Unknown' else cut end as redacted from (
  select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '```[\s\S]*?```', '[redacted code]', 'g'), '(?i)<script\b[^>]*>[\s\S]*?</script>', '[redacted code]', 'g'),
    '(?i)\b(?:ignore (?:all |any )?(?:previous|prior) instructions|system prompt|you are chatgpt)\b', '[redacted instruction]', 'g'),
    '[\x00-\x1f\x7f]', ' ', 'g'),
    '^[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$', '', 'g') as cut
  from pages) t""")
def text_redaction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", evidence_text(F.col("html")).alias("redacted"))


@query("sql_sources", f"""
select path, side, text as sql, case when text = '' then '' else regexp_extract(text, '(?i)stg_[0-9]') end as sources
from (select path, 'before' as side, before as text from ({SCANNED}) b union all select path, 'after', after from ({SCANNED}) a) r""")
def sql_sources(spark, sf_dir):
    sides = F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("sql")),
                    F.struct(F.lit("after").alias("side"), F.col("after").alias("sql")))
    return revisions(spark, sf_dir).select("path", F.inline(sides)).select(
        "path", "side", "sql", F.array_join(S.source_datasets(F.col("sql")), ",").alias("sources"))


SCREENED = """
select o_orderkey as number,
       case o_orderkey % 9
         when 0 then 'select ' || o_orderstatus || ' from t;'
         when 1 then '-- drop it' || chr(10) || 'with x as (select 1) select ''a;b; delete'' from x /* ; */ ;  '
         when 2 then 'drop table t_' || cast(o_custkey as string)
         when 3 then 'select 1 from t; select 2'
         when 4 then 'select * from (delete from t) x'
         when 5 then '   '
         when 6 then 'selected from t'
         when 7 then 'select updated_at, "set_x" from created'
         else 'SELECT Replace(x, ''a'', ''b'') from t' end as sql
from [[orders]]"""


@query("sql_screen", f"""
select number, sql, case number % 9 when 0 then 'ok' when 1 then 'ok' when 2 then 'not_read_only'
  when 3 then 'multiple_statements' when 4 then 'mutating' when 5 then 'empty' when 6 then 'not_read_only'
  when 7 then 'ok' else 'mutating' end as verdict from ({SCREENED}) s""")
def sql_screen(spark, sf_dir):
    return screen_sql(derive(spark, sf_dir, SCREENED))


# --- detection -------------------------------------------------------------------------------

def flat(changes: DataFrame) -> DataFrame:
    return changes.select(
        "analysis_id", "path", "file_status", "ordinal", "kind", "dataset", F.col("column").alias("changed"),
        F.array_join("columns", ",").alias("columns_used"), "new_column", "before_type", "after_type",
        "before_filter", "after_filter", F.array_join("sources", ",").alias("sources"), "confidence")


# What each edit must be reported as, told by the order number and not by reading the text.
EXPECTED = f"""
with files as (
  select r.*, cast(regexp_extract(path, 'm_([0-9]+)', 1) as bigint) as number,
         'stg_' || regexp_extract(coalesce(nullif(before, ''), after), 'stg_([0-9])', 1) as src,
         regexp_extract(coalesce(nullif(before, ''), after), '(o_totalprice > [0-9]+)', 1) as cond
  from ({SCANNED}) r where lower(path) like '%.sql' or lower(path) like '%.ddl'),
f as (select *, number % 10 as edit,
             case when number % 13 = 0 then 'shop.m_' else 'm_' end || cast(number as varchar) as own from files),
rows_ as (
  select f.*, 0 as ordinal, 'column_dropped' as kind, own as dataset, 'note' as changed, cast(null as varchar) as columns_used,
         cast(null as varchar) as new_column, cast(null as varchar) as before_type, cast(null as varchar) as after_type,
         cast(null as varchar) as before_filter, cast(null as varchar) as after_filter, 0.95 as confidence
  from f where edit = 2
  union all select f.*, 0, 'column_renamed', own, 'gross', null, 'gross_value', null, null, null, null, 0.9 from f where edit = 3
  union all select f.*, 0, 'column_type_changed', own, 'qty', null, null, 'int) as qty', 'bigint) as qty', null, null, 0.9 from f where edit = 4
  union all select f.*, 0, 'column_expression_changed', own, 'rate', null, null, null, null, null, null, 0.85 from f where edit = 5
  union all select f.*, 0, 'filter_changed', own, null, 'o_totalprice,status', null, null, null, cond, cond || ' and status = ''f''', 0.95 from f where edit = 6
  union all select f.*, 0, 'column_renamed', 'raw.orders', 'a_' || cast(number % 3 as varchar), null, 'b', null, null, null, null, 1.0 from f where edit = 7
  union all select f.*, 1, 'column_dropped', 'raw.orders', 'c', null, null, null, null, null, null, 1.0 from f where edit = 7
  union all select f.*, 0, 'filter_changed', own, null, 'o_totalprice', null, null, null, null, cond, 0.95 from f where edit = 8
  union all select f.*, n.o, 'column_dropped', own, n.c, null, null, null, null, null, null, 0.95
    from f, (values (0, 'order_id'), (1, 'gross'), (2, 'qty'), (3, 'rate'), (4, 'note')) n(o, c) where edit = 9
  union all select f.*, 5, 'filter_changed', own, null, 'o_totalprice', null, null, null, cond, null, 0.95 from f where edit = 9)
select analysis_id, path, status as file_status, ordinal, kind, dataset, changed, columns_used, new_column, before_type,
       after_type, before_filter, after_filter, src as sources, cast(confidence as double) as confidence from rows_"""


@query("detect_changes", EXPECTED)
def detect_changes_query(spark, sf_dir):
    return flat(detect_changes(revisions(spark, sf_dir)))


def _kinds(name: str, condition: str):
    @query(name, f"select * from ({EXPECTED}) e where {condition}")
    def run(spark, sf_dir):
        return flat(detect_changes(revisions(spark, sf_dir)).filter(condition))
    return run


_kinds("detect_projection_changes",
       "kind in ('column_expression_changed', 'column_type_changed', 'column_dropped') and confidence < 1")
_kinds("detect_renames", "kind = 'column_renamed' and confidence < 1")
_kinds("detect_filter_changes", "kind = 'filter_changed'")
_kinds("detect_ddl_changes", "confidence = 1")

FINDINGS = """
select 'a' || cast(o_custkey as string) as analysis_id, 'm.sql' as path, 'modified' as file_status,
       cast(o_orderkey as int) as ordinal, 'column_dropped' as kind, 'd' || cast(o_orderkey % 2 as string) as dataset,
       case when o_orderkey % 3 = 0 then cast(null as string) else 'c' || cast(o_orderkey % 3 as string) end as changed,
       case o_orderkey % 4 when 0 then 0.85 when 1 then 0.9 else 0.95 end as confidence
from [[orders]]"""


@query("detect_dedupe", f"""
select analysis_id, dataset, changed, first_seen as ordinal, cast(confidence as double) as confidence, note from (
  select f.*, 'n' || cast(ordinal as varchar) as note,
         min(ordinal) over (partition by analysis_id, dataset, coalesce(changed, '')) as first_seen,
         row_number() over (partition by analysis_id, dataset, coalesce(changed, '') order by confidence desc, ordinal) as rn
  from ({FINDINGS}) f) r where rn = 1""")
def detect_dedupe(spark, sf_dir):
    found = derive(spark, sf_dir, FINDINGS).select(
        "analysis_id", "path", "file_status", "ordinal", "kind", "dataset", F.col("changed").alias("column"),
        F.lit(None).cast("string").alias("new_column"), F.col("confidence").cast("double").alias("confidence"),
        F.concat(F.lit("n"), F.col("ordinal").cast("string")).alias("note"))
    return dedupe_changes(found).select(
        "analysis_id", "dataset", F.col("column").alias("changed"), "ordinal", "confidence", "note")
