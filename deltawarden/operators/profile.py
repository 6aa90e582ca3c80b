"""Profiling a result table: schema, volume, null rates, metrics, distribution statistics."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from deltawarden.operators.quantile import bracket, medians_in_brackets
from deltawarden.session import cut_lineage

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_MEDIAN = re.compile(r"\s*median\s*\((?P<argument>.*)\)\s*\Z", re.IGNORECASE | re.DOTALL)
_ANY_MEDIAN = re.compile(r"\bmedian\s*\(", re.IGNORECASE)


def median_argument(expression: str) -> str | None:
    """The argument when the whole expression is one ``MEDIAN(...)`` call."""
    match = _MEDIAN.match(expression)
    if not match:
        return None
    depth = 0
    for symbol in match["argument"]:
        depth += {"(": 1, ")": -1}.get(symbol, 0)
        if depth < 0:
            return None
    return match["argument"]


def check_expressions(expressions: Mapping[str, str], label: str) -> dict[str, str]:
    for name, expression in expressions.items():
        if not NAME.match(name):
            raise ValueError(f"{label} name must be an identifier: {name}")
        if not isinstance(expression, str) or not expression.strip():
            raise ValueError(f"{label}.{name} must be a SQL expression")
        if ";" in expression:
            raise ValueError(f"{label}.{name} is not a single expression")
        if _ANY_MEDIAN.search(expression) and median_argument(expression) is None:
            raise ValueError(f"{label}.{name}: give MEDIAN(...) as an entry of its own")
    return dict(expressions)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _row(category: str, metric: str, number: Column, text: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(metric).alias("metric"),
        number.cast("double").alias("num_value"), text.cast("string").alias("text_value"),
    )


def finite(value: Column, label: str) -> Column:
    bad = F.isnan(value) | (F.abs(value) == F.expr("double('Infinity')"))
    complaint = F.raise_error(F.lit(f"{label} did not produce a finite numeric value")).cast("double")
    return F.when(bad, complaint).otherwise(value)


def null_rate(column: str) -> Column:
    rows = F.count(F.lit(1))
    return F.coalesce(F.try_divide(F.count_if(F.col(quoted(column)).isNull()) * F.lit(100.0), rows), F.lit(0.0))


def profile_table(
    df: DataFrame,
    metrics: Mapping[str, str] | None = None,
    distributions: Mapping[str, str] | None = None,
    keys: Sequence[str] = (),
    accuracy: int = 100_000,
) -> DataFrame:
    """Long profile ``(*keys, category, metric, num_value, text_value)``.

    Row count, every null rate, every metric and every distribution come from one
    aggregate over one scan, the brackets of exact medians included; if there are medians, one more pass over the
    data settles all of them.
    """
    keys = list(keys)
    columns = [c for c in df.columns if c not in keys]
    types = dict(df.dtypes)
    specs = [("metric", n, e) for n, e in check_expressions(metrics or {}, "metrics").items()]
    specs += [("distribution", n, e) for n, e in check_expressions(distributions or {}, "distributions").items()]

    aggregates = [F.count(F.lit(1)).alias("__rows")]
    aggregates += [null_rate(c).alias(f"__null_{i}") for i, c in enumerate(columns)]
    rows = [_row("schema", c, F.lit(None), F.lit(types[c])) for c in columns]
    rows += [_row("volume", "rowCount", F.col("__rows"), F.lit(None))]
    rows += [_row("null_rate", c, F.col(f"__null_{i}"), F.lit(None)) for i, c in enumerate(columns)]
    medians = []
    for position, (category, name, expression) in enumerate(specs):
        argument = median_argument(expression)
        if argument is not None:
            aggregates.append(bracket(F.expr(argument), accuracy).alias(f"__bounds_{len(medians)}"))
            medians.append((category, name, argument))
            continue
        aggregates.append(F.expr(expression).cast("double").alias(f"__value_{position}"))
        value = finite(F.col(f"__value_{position}"), name)
        rows.append(_row(category, name, value, F.lit(None)))

    one_row = df.groupBy(*[quoted(k) for k in keys]).agg(*aggregates)
    if not medians:
        return one_row.select(*keys, F.inline(F.array(*rows)))
    one_row = cut_lineage(one_row)
    bounds = F.array(*[F.struct(
        F.lit(i).alias("measure"), F.col(f"__bounds_{i}")[0].alias("lo"), F.col(f"__bounds_{i}")[1].alias("hi"))
        for i in range(len(medians))])
    brackets = one_row.select(*keys, F.inline(bounds))  # a few numbers per group of a written table
    middles = medians_in_brackets(df, [argument for *_, argument in medians], brackets, keys)

    def named(position: int) -> Column:
        return F.element_at(F.array(*[F.lit(m[position]) for m in medians]), F.col("measure") + 1)

    return one_row.select(*keys, F.inline(F.array(*rows))).unionByName(middles.select(
        *keys, named(0).alias("category"), named(1).alias("metric"), finite(F.col("median"), "MEDIAN").alias("num_value"),
        F.lit(None).cast("string").alias("text_value")))
