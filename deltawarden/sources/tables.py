"""Typed tables from rows, DataFrames and CSV files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from deltawarden.functions.sqltext import none_if_empty, trim_spaces
from deltawarden.operators.profile import NAME, quoted

# --- fixed values: declarable column types and the Spark type that holds them ----------------
COLUMN_TYPES = {
    "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint",
    "HUGEINT": "decimal(38,0)", "UTINYINT": "smallint", "USMALLINT": "int", "UINTEGER": "bigint",
    "UBIGINT": "decimal(20,0)", "REAL": "float", "FLOAT": "float", "DOUBLE": "double", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "TIME": "string", "VARCHAR": "string",
}
UNSIGNED_MAX = {"UTINYINT": 2**8 - 1, "USMALLINT": 2**16 - 1, "UINTEGER": 2**32 - 1, "UBIGINT": 2**64 - 1}
INTEGER_TEXT = r"\A-?\d+\z"
INTEGERS = ("BIGINT", "INTEGER")
FLOATS = ("DOUBLE", "REAL", "FLOAT")
_VARCHAR = re.compile(r"VARCHAR\(\d{1,9}\)\Z")
_DECIMAL = re.compile(r"DECIMAL\((\d{1,3})\s*,\s*(\d{1,3})\)\Z")


def spark_type(declared: str) -> str:
    name = declared.strip().upper()
    if _VARCHAR.match(name):
        return "string"
    decimal = _DECIMAL.match(name)
    if decimal:
        return f"decimal({decimal[1]},{decimal[2]})"
    if name not in COLUMN_TYPES:
        raise ValueError(f"unsupported column type {declared}")
    return COLUMN_TYPES[name]


def table_schema(types: Mapping[str, str]) -> T.StructType:
    if not types:
        raise ValueError("a table needs at least one column")
    for name in types:
        if not NAME.match(name):
            raise ValueError(f"column name must be an identifier: {name}")
    return T.StructType([
        T.StructField(name, T._parse_datatype_string(spark_type(kind)), True) for name, kind in types.items()])


def table_from_rows(spark: SparkSession, rows: Iterable[Mapping], types: Mapping[str, str]) -> DataFrame:
    """Small hand-written tables: unknown keys are an error, missing keys NULL."""
    schema, names = table_schema(types), list(types)
    tuples = []
    for position, row in enumerate(rows):
        unknown = [key for key in row if key not in types]
        if unknown:
            raise ValueError(f"row {position} has unknown columns: {', '.join(unknown)}")
        tuples.append(tuple(row.get(name) for name in names))
    return conform_table(spark.createDataFrame(tuples, schema), types)


def conform_table(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """A DataFrame cast to declared types: unknown columns are an error, missing ones NULL, unsigned ranges checked."""
    schema = table_schema(types)
    unknown = [c for c in df.columns if c not in types]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")

    def column(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(quoted(field.name)).cast(field.dataType)
        bound = UNSIGNED_MAX.get(types[field.name].strip().upper())
        if bound is not None:
            complaint = F.raise_error(F.lit(f"{field.name} is outside its unsigned range")).cast(field.dataType)
            value = F.when((value < 0) | (value > F.lit(str(bound)).cast("decimal(20,0)")), complaint).otherwise(value)
        return value.alias(field.name)

    return df.select(*[column(field) for field in schema.fields])


def parse_typed_text(text_rows: DataFrame, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """String columns to declared types: trimmed, empty is NULL, whole numbers only for integers, finite floats.

    ``strict`` fails the job on a bad cell; otherwise ``violations`` lists the bad columns per row.
    """
    undeclared = [c for c in text_rows.columns if c not in types]
    if undeclared:
        raise ValueError(f"column {undeclared[0]} is not declared")
    columns, broken = [], []
    for name in text_rows.columns:
        kind = types[name].strip().upper()
        text = none_if_empty(trim_spaces(F.col(quoted(name))))
        value = F.expr("null")
        if kind in INTEGERS:
            value = F.when(text.rlike(INTEGER_TEXT), text.try_cast(spark_type(kind)))
        elif kind in FLOATS:
            number = text.try_cast(spark_type(kind))
            infinite = F.isnan(number) | (F.abs(number) == F.expr("double('Infinity')"))
            value = F.when(~infinite, number)
        else:
            value = text.try_cast(spark_type(kind))
        bad = text.isNotNull() & value.isNull()
        if strict:
            complaint = F.raise_error(F.concat(F.lit(f"column {name} cannot hold "), text)).cast(spark_type(kind))
            value = F.when(bad, complaint).otherwise(value)
        columns.append(value.alias(name))
        broken.append(F.when(bad, F.lit(name)))
    if strict:
        return text_rows.select(*columns)
    return text_rows.select(*columns, F.array_compact(F.array(*broken)).alias("violations"))


def read_typed_csv(spark: SparkSession, path: str, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """A CSV with a header row and plain, unquoted fields.

    The header line is read first (one line), every header column must be declared;
    rows are then read with a fixed schema, in parallel, and refused when their
    field count differs or they hold a quote character.
    """
    head = spark.read.option("wholetext", False).text(path).limit(1).collect()
    if not head:
        raise ValueError("a CSV needs a header and at least one row")
    header = [name.strip() for name in head[0][0].split(",")]
    undeclared = [name for name in header if name not in types]
    if undeclared:
        raise ValueError(f"column {undeclared[0]} is not declared")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = spark.read.schema(schema).options(
        header=True, mode="FAILFAST", enforceSchema=False, quote="", escape="",
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    ).csv(path)
    if rows.isEmpty():
        raise ValueError("a CSV needs a header and at least one row")
    # Texts go along beside the values, so that every cell of a row is judged in one filter: a filter is not pruned
    # when a query reads few columns, or only counts.
    texts = {f"text_{i}": F.col(quoted(name)) for i, name in enumerate(header)}
    parsed = parse_typed_text(rows.withColumns(texts), {**types, **dict.fromkeys(texts, "VARCHAR")}, strict=False)
    if not strict:
        return parsed.drop(*texts)
    has_quote = F.exists(F.array(*texts), lambda text: F.coalesce(text.contains('"'), F.lit(False)))
    problem = F.when(has_quote, "a CSV must not contain quoted fields").when(F.size("violations") > 0, F.concat(
        F.lit("values do not fit their columns: "), F.array_join("violations", ", ")))
    sound = F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    return parsed.filter(sound).select(*[quoted(name) for name in header])
