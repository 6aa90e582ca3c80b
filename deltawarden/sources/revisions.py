"""File revisions as exported from version control."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltawarden.operators.evidence import analysis_id


def scan_revisions(exported: DataFrame) -> DataFrame:
    """Exported file pairs to the ``file_revision`` table.

    Added files have no earlier text and removed files no later text, whatever the
    export carries; a rename is known by its new path; object ids are lower case.
    """
    empty = F.lit("")
    return exported.select(
        analysis_id(F.col("repository"), F.col("pull_request"), F.lower("head_sha")).alias("analysis_id"),
        "repository", "pull_request", F.lower("base_sha").alias("base_sha"), F.lower("head_sha").alias("head_sha"),
        "path", "status",
        F.when(F.col("status") == "added", empty).otherwise(F.coalesce("before", empty)).alias("before"),
        F.when(F.col("status") == "removed", empty).otherwise(F.coalesce("after", empty)).alias("after"),
    )
