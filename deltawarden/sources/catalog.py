"""Lineage edges and fields out of catalog metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deltawarden.functions import urns as U


def lineage_edges(raw: DataFrame) -> DataFrame:
    """Table-level ``(src, dst)`` from each dataset's upstream list."""
    return raw.select(F.explode("upstream_lineage.upstreams").alias("u"), F.col("urn").alias("dst")).select(
        F.col("u.dataset").alias("src"), "dst").distinct()


def column_lineage_edges(raw: DataFrame) -> DataFrame:
    """Column-level edges: every upstream field of an entry to every downstream field of it.

    An end that is no schema field, a chart for instance, stands for itself and has no field.
    """
    def owner(end: str) -> Column:
        return F.coalesce(U.field_dataset(F.col(end)), F.col(end))

    entries = raw.select(F.explode("upstream_lineage.fine_grained").alias("e"))
    ups = entries.select(
        F.explode("e.upstreams").alias("up"), F.col("e.downstreams").alias("downs"),
        F.col("e.transform_operation").alias("op"), F.col("e.confidence_score").alias("confidence"))
    pairs = ups.select("up", F.explode("downs").alias("down"), "op", "confidence")
    return pairs.select(
        owner("up").alias("src_urn"), U.field_path(F.col("up")).alias("src_field"),
        owner("down").alias("dst_urn"), U.field_path(F.col("down")).alias("dst_field"),
        "op", "confidence")


def catalog_fields(catalog: DataFrame) -> DataFrame:
    return catalog.select("urn", F.inline("fields"))
