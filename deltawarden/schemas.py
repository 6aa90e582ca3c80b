"""Canonical tables as DDL strings, usable with ``spark.read.schema`` and ``createDataFrame``."""

OWNER = "struct<urn:string,name:string,type:string>"
COLUMN_EVIDENCE = "struct<upstream_dataset:string,upstream_column:string,downstream_column:string>"

FILE_REVISION = (
    "analysis_id string, repository string, pull_request int, base_sha string, head_sha string, "
    "path string, status string, before string, after string"
)
CHANGE = (
    "analysis_id string, path string, file_status string, ordinal int, kind string, dataset string, "
    "column string, columns array<string>, new_column string, before_type string, after_type string, "
    "before_filter string, after_filter string, sources array<string>, confidence double"
)
CATALOG_DATASET = (
    "urn string, type string, name string, qualified_name string, platform string, description string, "
    "tier string, production boolean, business_critical boolean, "
    f"owners array<{OWNER}>, fields array<struct<field_path:string,native_type:string,description:string>>"
)
LINEAGE_EDGE = "src string, dst string"
COLUMN_LINEAGE_EDGE = (
    "src_urn string, src_field string, dst_urn string, dst_field string, op string, confidence double"
)
CONSUMER = (
    "analysis_id string, urn string, name string, type string, tier string, production boolean, "
    "business_critical boolean, sql string, input_columns array<string>, "
    f"column_lineage array<{COLUMN_EVIDENCE}>, owners array<{OWNER}>"
)
PROFILE = (
    "analysis_id string, model string, side string, category string, metric string, "
    "num_value double, text_value string"
)
DIFFERENCE = (
    "analysis_id string, model string, category string, metric string, before_num double, after_num double, "
    "before_text string, after_text string, change string, magnitude double, unit string, breached boolean"
)
# ordinal may be any type; whole numbers sort as numbers, all else as text.
INCONCLUSIVE_REASON = "analysis_id string, ordinal string, reason string"
ANALYSIS = (
    "analysis_id string, repository string, pull_request int, base_sha string, head_sha string, "
    "execution_status string"
)
EVIDENCE_RECORD = (
    "target_urn string, idempotency_key string, title string, body string, related_assets array<string>, "
    "action string, version bigint"
)
# A catalog export as delivered by a metadata service, before normalisation.
RAW_ENTITY = (
    "urn string, type string, name string, dashboard_id string, chart_id string, "
    "properties struct<name:string,description:string>, platform struct<name:string>, description string, "
    "ownership struct<owners:array<struct<owner:struct<urn:string,type:string,username:string,name:string,"
    "properties:struct<display_name:string>>>>>, "
    "schema_metadata struct<fields:array<struct<field_path:string,native_type:string,description:string>>>, "
    "upstream_lineage struct<upstreams:array<struct<dataset:string,type:string>>,"
    "fine_grained:array<struct<upstreams:array<string>,downstreams:array<string>,"
    "transform_operation:string,confidence_score:double>>>"
)
