"""Idempotent evidence records: building, upserting, verifying, writing, reading back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from deltawarden.functions import fixed as K
from deltawarden.functions.safetext import evidence_text
from deltawarden.functions.sqltext import trim_spaces
from deltawarden.operators.decide import REJECTED, ReportLimits, bullet_lines, shown_reasons
from deltawarden.session import cut_lineage
from deltawarden.sources.store import KeyedStore

TOOL = "deltawarden"
BUNDLE_SCHEMA = (
    "schemaVersion string, generatedFor struct<repository:string,pullRequest:int,baseSha:string,headSha:string>, "
    "decision struct<conclusion:string,severity:string,affectedAssetCount:int,summary:string>, "
    "consumers array<struct<urn:string,name:string,type:string,classification:string,affected:boolean,"
    "owners:array<struct<urn:string,name:string,type:string>>>>, "
    "differences array<struct<model:string,category:string,metric:string,before:double,after:double,"
    "magnitude:double,breached:boolean>>, "
    "context struct<changes:array<struct<urn:string,name:string,platform:string,"
    "consumers:array<struct<urn:string,name:string,type:string,platform:string>>>>>"
)
SUPPORTED_VERSIONS = ("1", "2")


def analysis_id(repository: Column, pull_request: Column, head_sha: Column) -> Column:
    return F.concat(repository, F.lit("#"), pull_request.cast("string"), F.lit("@"), head_sha)


def analysis_problem(df: DataFrame) -> Column:
    """First reason why an analysis may not be published, or NULL."""
    expected = analysis_id(F.col("repository"), F.col("pull_request"), F.col("head_sha"))
    return (
        F.when(~F.coalesce(F.col("repository").rlike(K.REPOSITORY), F.lit(False)), "Repository must be owner/name")
        .when(~F.coalesce(F.col("pull_request") > 0, F.lit(False)), "Invalid PR number")
        .when(~F.coalesce(F.col("head_sha").rlike(K.FULL_SHA), F.lit(False)), "Head SHA must be a full Git object ID")
        .when(~F.coalesce(F.col("analysis_id") == expected, F.lit(False)),
              "Analysis ID is not scoped to the head commit")
    )


def evidence_key(tool: str = TOOL) -> Column:
    return F.concat(F.lit(f"{tool}:"), analysis_id(
        F.col("repository"), F.col("pull_request"), F.lower("head_sha")))


def marker(key: Column) -> Column:
    return F.concat(F.lit("<!-- "), key, F.lit(" -->"))


def evidence_records(
    decisions: DataFrame, reasons: DataFrame, tool: str = TOOL, limits: ReportLimits = ReportLimits()
) -> DataFrame:
    """One record per decision that carries ``repository, pull_request, head_sha`` (and maybe ``check_url``)."""
    title = tool.capitalize()
    outcome = F.when(F.col("conclusion") == "failure", "BLOCKED").when(
        F.col("conclusion") == "neutral", "INCONCLUSIVE").when(
        F.col("conclusion") == REJECTED, "REJECTED").otherwise("PASSED")
    joined = decisions.join(shown_reasons(reasons, evidence_text, limits), "analysis_id", "left").withColumn(
        "idempotency_key", evidence_key(tool))
    link = F.concat(F.lit("- GitHub Check: "), "check_url") if "check_url" in decisions.columns else F.lit(None)
    body = F.concat_ws(
        "\n", marker(F.col("idempotency_key")), F.concat(F.lit(f"# {title} decision: "), outcome), F.lit(""),
        F.concat(F.lit("- Repository: `"), "repository", F.lit("`")),
        F.concat(F.lit("- Pull request: #"), F.col("pull_request").cast("string")),
        F.concat(F.lit("- Commit: `"), F.lower("head_sha"), F.lit("`")),
        F.concat(F.lit("- Severity: "), evidence_text(F.col("severity"), "unknown")),
        F.concat(F.lit("- Affected assets: "), F.col("affected_asset_count").cast("string")),
        link.cast("string"), F.lit(""), F.lit("## Evidence"), F.lit(""),
        bullet_lines(F.coalesce("shown", F.array().cast("array<string>"))),
    )
    return joined.select(
        "analysis_id",
        F.concat(F.lit(f"urn:li:document:{tool}_"), F.sha2("idempotency_key", 256)).alias("target_urn"),
        "idempotency_key",
        F.concat(F.lit(f"{title}: "), "repository", F.lit(" PR #"), F.col("pull_request").cast("string"),
                 F.lit(" @ "), F.substring("head_sha", 1, 12)).alias("title"),
        body.alias("body"), analysis_problem(joined).alias("problem"),
    )


def evidence_assets(records: DataFrame, related: DataFrame) -> DataFrame:
    """``(target_urn, asset_urn, valid)``: assets of each record as rows; ``valid`` tells a well-formed urn."""
    return records.select("analysis_id", "target_urn").join(related, "analysis_id").select(
        "target_urn", "asset_urn", F.col("asset_urn").rlike(K.CATALOG_URN).alias("valid"))


def upsert_evidence(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored records with the incoming ones applied: ``action`` is created, updated or kept.

    ``version`` orders several writes of the same record. One shuffle on the record
    key; repeating the same upsert changes nothing but the action.
    """
    fields = [c for c in incoming.columns if c not in ("target_urn", "action")]
    both = stored.select("target_urn", *fields, F.lit(0).alias("is_new")).unionByName(
        incoming.select("target_urn", *fields, F.lit(1).alias("is_new")))
    latest = both.groupBy("target_urn").agg(
        F.max_by(F.struct(*fields), F.struct("is_new", "version")).alias("last"),
        F.max("is_new").alias("touched"), F.min("is_new").alias("fresh"))
    return latest.select(
        "target_urn", *[F.col(f"last.{f}").alias(f) for f in fields],
        F.when(F.col("touched") == 0, "kept").when(F.col("fresh") == 1, "created").otherwise("updated")
        .alias("action"))


def unverified(written: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records that cannot be read back, or came back without their marker."""
    stored = written.select("target_urn", F.col("body").alias("stored_body"))
    return incoming.select("target_urn", "idempotency_key").distinct().join(stored, "target_urn", "left").filter(
        F.col("stored_body").isNull() | ~F.col("stored_body").contains(marker(F.col("idempotency_key")))
    ).select("target_urn", "idempotency_key")


def write_bundles(bundles: DataFrame, path: str, buckets: int = 64, **commit) -> DataFrame:
    """Store evidence bundles, one per analysis; an analysis written again replaces its own bundle only."""
    store = KeyedStore(bundles.sparkSession, path, "analysis_id", buckets)

    def replaced(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        return incoming.unionByName(stored.join(incoming.select("analysis_id").distinct(), "analysis_id", "left_anti"))

    return store.rows(bundles.schema, store.update(bundles, replaced, **commit))


def write_evidence(incoming: DataFrame, path: str, buckets: int = 64, **commit) -> tuple[DataFrame, DataFrame]:
    """Upsert records into the store at ``path``; returns the store as read back, and incoming records that did not
    arrive. ``action`` in the store tells what the last write did to a record of a touched bucket.

    Other writers may update the store meanwhile: a version is committed whole or not at all.
    """
    incoming = cut_lineage(incoming)
    store = KeyedStore(incoming.sparkSession, path, "target_urn", buckets)
    schema = upsert_evidence(incoming, incoming).schema

    def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
        return upsert_evidence(stored.drop("action"), new)

    written = store.rows(schema, store.update(incoming, upserted, schema, **commit))
    return written, unverified(written, incoming)


def bundle_json(fields: Column) -> Column:
    return F.to_json(fields)


def scan_bundles(bundles: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Parse ``(content, requested_head_sha, ...)``; ``reject_reason`` is NULL for accepted bundles."""
    schema = T.StructType(T._parse_datatype_string(BUNDLE_SCHEMA).fields + [T.StructField("_malformed", T.StringType())])
    parsed = bundles.withColumn("evidence", F.from_json(
        "content", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}))
    version = F.col("evidence.schemaVersion")
    head = F.col("evidence.generatedFor.headSha")
    reason = (
        F.when(F.lit(False) if max_chars is None else F.length("content") > max_chars,
               "Evidence JSON exceeds size limit")
        .when(F.col("evidence").isNull() | F.col("evidence._malformed").isNotNull(), "Evidence JSON is malformed")
        .when(version.isNull() | ~version.isin(*SUPPORTED_VERSIONS), F.concat(
            F.lit("Unsupported evidence schema version: "), F.coalesce(version, F.lit("undefined"))))
        .when((F.coalesce(head, F.lit("")) != "") & (F.lower(head) != F.lower("requested_head_sha")),
              "Evidence artifact head SHA does not match PR")
    )
    return parsed.withColumn("reject_reason", reason)


def evidence_freshness(heads: DataFrame, artifacts: DataFrame, size_limit: int | None = None) -> DataFrame:
    """Per pull-request head the newest unexpired artifact that has it in its name: ``status`` fresh or missing.

    Every object id in a name counts, base and head alike. Newest is by ``created_at`` where artifacts have it, then
    by ``artifact_id``. With ``size_limit`` bytes, a larger artifact is ``oversized``.
    """
    ids = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(K.OBJECT_ID), F.lit(1)))
    age = [F.col(c) for c in ("created_at", "artifact_id") if c in artifacts.columns]
    first = artifacts.filter("not expired").select("*", F.explode(ids).alias("head_sha")).groupBy("head_sha").agg(
        F.max_by(F.struct("artifact_id", "size_bytes"), F.struct(*age)).alias("newest")).select(
        "head_sha", "newest.*")
    return heads.withColumn("head_sha", F.lower("head_sha")).join(first, "head_sha", "left").withColumn(
        "status", F.when(F.col("artifact_id").isNull(), "missing")
        .when(F.lit(False) if size_limit is None else F.col("size_bytes") > size_limit, "oversized").otherwise("fresh"))


def extract_check_text(checks: DataFrame, check_name: str) -> DataFrame:
    """``(head_sha, risk, affected_assets, owner_routing, reasons)`` from the first check of that name per head.

    ``checks(head_sha, ordinal, name, text)``.
    """
    ours = checks.filter(F.lower("name") == check_name.lower())
    first = ours.groupBy("head_sha").agg(F.min_by(F.coalesce("text", F.lit("")), "ordinal").alias("text"))
    line = r"[^\n\r\u2028\u2029]+"

    def value(label: str, pattern: str) -> Column:
        return F.regexp_extract("text", rf"(?m)^{label}{K.WS}*({pattern})", 1)

    bullets = F.filter(F.split("text", "\n"), lambda l: l.startswith("- "))
    return first.select(
        "head_sha",
        F.coalesce(F.nullif(trim_spaces(value("Risk:", line)), F.lit("")), F.lit("unknown")).alias("risk"),
        F.coalesce(F.try_to_number(F.nullif(value("Affected assets:", r"\d+"), F.lit("")), F.lit("9" * 18)).cast(
            "bigint"), F.lit(0).cast("bigint")).alias("affected_assets"),
        trim_spaces(value("Route to:", line)).alias("owner_routing"),
        F.transform(bullets, lambda l: F.substring(l, 3, 2_000_000_000)).alias("reasons"),
    )


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The latest committed version of a bundle store."""
    return KeyedStore(spark, path, "analysis_id").rows()
