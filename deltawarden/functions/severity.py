"""Magnitudes, breaches and severities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from deltawarden.functions import fixed as K

INFINITY = "double('Infinity')"


def percent_change(before: Column, after: Column) -> Column:
    """Relative change in percent; equal is 0, a change from 0 is infinite."""
    return (
        F.when(before == after, F.lit(0.0))
        .when(before == 0, F.expr(INFINITY))
        .otherwise((after - before) / F.abs(before) * F.lit(100.0))
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(-1)
    for position, level in enumerate(K.SEVERITY_LEVELS):
        rank = F.when(severity == level, F.lit(position)).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(level) for level in K.SEVERITY_LEVELS]), rank + 1)


def difference_severity(breached: Column, category: Column, magnitude: Column) -> Column:
    size = F.abs(magnitude)
    return (
        F.when(~F.coalesce(breached, F.lit(False)), F.lit("none"))
        .when(category == "schema", F.lit("critical"))
        .when(size.isNull() | F.isnan(size) | (size >= K.CRITICAL_MAGNITUDE), F.lit("critical"))
        .when(size >= K.HIGH_MAGNITUDE, F.lit("high"))
        .otherwise(F.lit("medium"))
    )


def impact_severity(affected: Column, kind: Column, tier: Column, production: Column, critical: Column) -> Column:
    kind = F.lower(F.coalesce(kind, F.lit("")))
    tier = F.lower(F.coalesce(tier, F.lit("")))
    return (
        F.when(~F.coalesce(affected, F.lit(False)), F.lit("none"))
        .when(F.coalesce(production, F.lit(False)) & kind.isin(*K.PRODUCTION_CRITICAL_TYPES), F.lit("critical"))
        .when(tier.isin(*K.CRITICAL_TIERS) | F.coalesce(critical, F.lit(False)), F.lit("critical"))
        .when(kind.isin(*K.HIGH_TYPES), F.lit("high"))
        .otherwise(F.lit("medium"))
    )
