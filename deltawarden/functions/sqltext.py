"""Column functions over SQL text. All are built-in JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from deltawarden.functions import fixed as K

WS, START, END = K.WS, K.WORD_START, K.WORD_END

_ALTER = rf"(?i){START}alter{WS}+table{WS}+({K.QUOTED_TABLE}){WS}+"
RENAME_COLUMN = rf"{_ALTER}rename{WS}+column{WS}+({K.QUOTED_NAME}){WS}+to{WS}+({K.QUOTED_NAME})"
DROP_COLUMN = rf"{_ALTER}drop{WS}+column{WS}+({K.QUOTED_NAME})"
ALTER_TYPE = (
    rf"{_ALTER}alter{WS}+column{WS}+({K.QUOTED_NAME}){WS}+(?:set{WS}+data{WS}+)?type{WS}+([\w(),{K.SPACE_CHARS}]+)"
)
SOURCE_NAME = (
    rf"(?i){START}(?:from|join){WS}+(?:\{{\{{{WS}*(?:ref|source){WS}*\({WS}*)?['\"`]?([\w.-]+)['\"`]?"
    rf"(?:{WS}*,{WS}*['\"`]([\w.-]+)['\"`])?{WS}*\)?{WS}*\}}\}}?"
)
MODEL_REF = rf"\{{\{{{WS}*ref{WS}*\({WS}*['\"]([\w.-]+)['\"]{WS}*\){WS}*\}}\}}"
# Word edges are tested after the literal, so that most characters fail on the first comparison.
# A dot that takes every character is read many times faster than a class of them.
SELECT_LIST = rf"(?is)select(?<!\wselect){END}(.*?)from(?<!\wfrom){END}"
ALIAS = rf"(?i)as(?<!\was){WS}+[`\"\[]?([\w$]+)[`\"\]]?{WS}*\z"
BARE_NAME = rf"(?:\A|\.)[ `\"\[]?([\w$]+)[`\"\]]?{WS}*\z"
CAST_TYPE = rf"(?i){START}cast{WS}*\([^)]*{START}as{WS}+([\w() ,]+)"
WHERE_CLAUSE = (
    rf"(?is)where(?<!\wwhere){END}(.*?)"
    rf"(?={START}(?:group{WS}+by|order{WS}+by|having|limit){END}|\z)"
)


def none_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def trim_spaces(value: Column) -> Column:
    return F.btrim(value, F.lit(K.SPACES))


def without_comments(sql: Column, filler: str) -> Column:
    """Line comments, then block comments replaced.

    Texts without the marks skip the pattern. Each test reads the raw text, never an
    intermediate one, so no step is computed twice.
    """
    line = F.when(sql.contains("--"), F.regexp_replace(sql, K.LINE_COMMENT, filler)).otherwise(sql)
    return F.when(sql.contains("/*"), F.regexp_replace(line, K.BLOCK_COMMENT, filler)).otherwise(line)


def normalize_sql(sql: Column) -> Column:
    """Comments gone, white space collapsed, trimmed, lower case (literals included)."""
    text = without_comments(sql, "")
    # Pure ASCII text takes the cheaper white-space pattern.
    collapsed = F.when(
        F.octet_length(sql) == F.char_length(sql), F.regexp_replace(text, r"\s+", " ")
    ).otherwise(F.regexp_replace(text, rf"{WS}+", " "))
    return F.lower(F.trim(collapsed))


def strip_quotes(value: Column) -> Column:
    return F.regexp_replace(value, K.QUOTE_EDGES, "")


def clean_identifier(value: Column) -> Column:
    return trim_spaces(strip_quotes(value))


def normalize_column(value: Column) -> Column:
    return strip_quotes(F.lower(value))


def source_datasets(sql: Column) -> Column:
    """Templated names after FROM and JOIN, two-part sources joined by a dot."""
    first = F.regexp_extract_all(sql, F.lit(SOURCE_NAME), F.lit(1))
    second = F.regexp_extract_all(sql, F.lit(SOURCE_NAME), F.lit(2))
    names = F.zip_with(first, second, lambda a, b: F.when(b != "", F.concat(a, F.lit("."), b)).otherwise(a))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~F.lower(n).isin(*K.NOT_A_SOURCE)))


def model_refs(sql: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(MODEL_REF), F.lit(1)))


def select_list_text(sql: Column) -> Column:
    """Text between the first SELECT and the next FROM, line comments blanked."""
    return F.regexp_extract(F.regexp_replace(sql, K.LINE_COMMENT, " "), SELECT_LIST, 1)


# A quoted text (closed or not), a bracket, a comma, or what stands between such marks.
LIST_TOKEN = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)|`[^`]*(?:`|\z)|[(),]|[^'"`(),]+"""


def split_select_list(text: Column) -> Column:
    """The entries of a list: cut at commas outside brackets and quotes, trimmed, empty ones left out."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LIST_TOKEN), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("piece"),
                     F.array().cast("array<string>").alias("pieces"))

    def read(state: Column, token: Column) -> Column:
        depth, cuts = state["depth"], (token == ",") & (state["depth"] == 0)
        step = F.when(token == "(", 1).when((token == ")") & (depth > 0), -1).otherwise(0)
        return F.struct(
            (depth + step).alias("depth"),
            F.when(cuts, "").otherwise(F.concat(state["piece"], token)).alias("piece"),
            F.when(cuts, F.concat(state["pieces"], F.array(state["piece"]))).otherwise(state["pieces"]).alias("pieces"))

    entries = F.aggregate(tokens, start, read, lambda s: F.concat(s["pieces"], F.array(s["piece"])))
    return F.filter(F.transform(entries, lambda e: trim_spaces(e)), lambda e: e != "")


def output_name(expression: Column) -> Column:
    """Trailing alias, else a bare or qualified name, else NULL."""
    return F.coalesce(
        none_if_empty(F.regexp_extract(expression, ALIAS, 1)),
        none_if_empty(F.regexp_extract(expression, BARE_NAME, 1)),
    )


def source_columns(expression: Column, name: Column | None = None) -> Column:
    """Identifiers in order, without literals, key words and the expression's own output name."""
    if name is None:
        name = output_name(expression)
    scrubbed = F.when(expression.contains("'"), F.regexp_replace(expression, K.STRING_LITERAL, " ")).otherwise(
        expression)
    tokens = F.regexp_extract_all(scrubbed, F.lit(K.IDENTIFIER), F.lit(0))
    columns = F.array_distinct(F.filter(tokens, lambda t: ~F.lower(t).isin(*K.SQL_KEYWORDS)))
    own = F.coalesce(F.lower(name), F.lit(""))
    return F.filter(columns, lambda c: c != own)


def cast_type(expression: Column) -> Column:
    """Target type text of the cast, untrimmed; empty when there is none."""
    return F.regexp_extract(expression, CAST_TYPE, 1)


def where_clause(sql: Column) -> Column:
    return normalize_sql(F.regexp_extract(sql, WHERE_CLAUSE, 1))


def sql_identifiers(sql: Column) -> Column:
    """Distinct lower-case identifiers outside comments and string literals."""
    text = without_comments(F.coalesce(sql, F.lit("")), " ")
    text = F.regexp_replace(text, K.STRING_LITERAL, " ")
    tokens = F.regexp_extract_all(text, F.lit(K.IDENTIFIER), F.lit(0))
    return F.array_distinct(F.transform(tokens, lambda t: F.lower(t)))


def infer_dataset(path: Column, before: Column, after: Column, marker: str) -> Column:
    """``-- <marker>:dataset=x`` (after first, then before), else the file stem, else ``unknown``."""
    declared = F.regexp_extract(
        F.concat(after, F.lit("\n"), before), rf"(?i)--{WS}*{re.escape(marker)}:dataset{WS}*={WS}*([\w.-]+)", 1
    )
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), K.ANALYZABLE_FILE, "")
    return F.coalesce(none_if_empty(declared), none_if_empty(stem), F.lit("unknown"))


def is_analyzable(path: Column) -> Column:
    return path.rlike(K.ANALYZABLE_FILE)


def split_patch(patch: Column) -> Column:
    """struct(before, after) rebuilt from a unified diff."""
    lines = F.filter(F.split(patch, r"\r?\n"), lambda l: ~l.rlike(r"\A(?:diff --git|index |--- |\+\+\+ |@@)"))

    def side(sign: str) -> Column:
        kept = F.filter(lines, lambda l: l.startswith(sign) | l.startswith(" "))
        return F.array_join(F.transform(kept, lambda l: F.substring(l, 2, 2_000_000_000)), "\n")

    return F.struct(side("-").alias("before"), side("+").alias("after"))
