"""What changed between two revisions of SQL files.

One row per file goes in, one row per finding comes out. A file is judged from its
own row alone, so a repository or pull request of any size spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deltawarden.functions import sqltext as S
from deltawarden.session import settle

FILE_KEYS = ("analysis_id", "path", "file_status")
CHANGE_FIELDS = (
    ("kind", "string"), ("dataset", "string"), ("column", "string"), ("columns", "array<string>"),
    ("new_column", "string"), ("before_type", "string"), ("after_type", "string"),
    ("before_filter", "string"), ("after_filter", "string"), ("confidence", "double"),
)
NO_CHANGES = "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in CHANGE_FIELDS) + ">>"


def _change(**given: Column) -> Column:
    return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in CHANGE_FIELDS])


def _matches(text: Column, pattern: str, *groups: int) -> Column:
    """All matches of a pattern as array of structs g1, g2, ..."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])


def _ddl_changes(after: Column) -> Column:
    sure = F.lit(1.0)
    renamed = F.transform(_matches(after, S.RENAME_COLUMN, 1, 2, 3), lambda m: _change(
        kind=F.lit("column_renamed"), dataset=S.clean_identifier(m["g1"]), column=S.clean_identifier(m["g2"]),
        new_column=S.clean_identifier(m["g3"]), confidence=sure))
    dropped = F.transform(_matches(after, S.DROP_COLUMN, 1, 2), lambda m: _change(
        kind=F.lit("column_dropped"), dataset=S.clean_identifier(m["g1"]), column=S.clean_identifier(m["g2"]),
        confidence=sure))
    retyped = F.transform(_matches(after, S.ALTER_TYPE, 1, 2, 3), lambda m: _change(
        kind=F.lit("column_type_changed"), dataset=S.clean_identifier(m["g1"]), column=S.clean_identifier(m["g2"]),
        after_type=S.trim_spaces(m["g3"]), confidence=sure))
    # Every pattern begins with this word; few texts have it.
    return F.when(F.lower(after).contains("alter"), F.concat(renamed, dropped, retyped)).otherwise(
        F.array().cast(NO_CHANGES))


def _projection(entries: Column) -> Column:
    """Named select-list entries: name, key, normalised expression, joined source columns, cast target."""
    named = F.transform(entries, lambda e: F.struct(
        e.alias("raw"), S.output_name(e).alias("name"), S.normalize_sql(e).alias("expression")))
    return F.transform(F.filter(named, lambda x: x["name"].isNotNull()), lambda x: F.struct(
        x["name"].alias("name"), F.lower(x["name"]).alias("key"), x["expression"].alias("expression"),
        F.lower(F.array_join(S.source_columns(x["raw"], x["name"]), ",")).alias("inputs"),
        S.cast_type(x["expression"]).alias("cast_to")))


def _definitions(side: str) -> Column:
    return F.transform(F.col(side), lambda p: F.concat(p["key"], F.lit("\n"), p["expression"]))


def _last_wins(projection: Column, keys: Column) -> Column:
    """A repeated output name keeps its first place and its last definition."""
    rebuilt = F.transform(keys, lambda k: F.element_at(F.filter(projection, lambda p: p["key"] == k), -1))
    return F.when(F.size(keys) == F.size(projection), projection).otherwise(rebuilt)


def _dropped_or_renamed(dataset: Column) -> Column:
    """Columns missing after the change; the first changed entry with the same inputs may be a rename."""
    gone = F.filter(F.col("old"), lambda p: F.array_contains(F.col("gone_keys"), p["key"]))
    paired = F.transform(gone, lambda p: F.struct(
        p["name"].alias("name"),
        F.get(F.filter(F.col("new"), lambda c: (c["inputs"] == p["inputs"]) & (c["expression"] != p["expression"])),
              F.lit(0)).alias("twin")))

    def judge(pair: Column) -> Column:
        twin = pair["twin"]
        is_new = twin.isNotNull() & ~F.array_contains(F.col("old_keys"), F.coalesce(twin["key"], F.lit("")))
        return F.when(is_new, _change(
            kind=F.lit("column_renamed"), dataset=dataset, column=pair["name"], new_column=twin["name"],
            confidence=F.lit(0.9),
        )).otherwise(_change(
            kind=F.lit("column_dropped"), dataset=dataset, column=pair["name"], confidence=F.lit(0.95)))

    return F.transform(paired, judge)


def _changed_expressions(dataset: Column) -> Column:
    kept = F.filter(F.col("new"), lambda p: F.array_contains(F.col("moved"), F.concat(
        p["key"], F.lit("\n"), p["expression"])) & F.array_contains(F.col("old_keys"), p["key"]))
    paired = F.transform(kept, lambda p: F.struct(
        p["name"].alias("name"), p["cast_to"].alias("to"),
        F.get(F.filter(F.col("old"), lambda q: q["key"] == p["key"]), F.lit(0))["cast_to"].alias("was")))

    def judge(pair: Column) -> Column:
        has_cast = pair["to"] != ""
        return _change(
            kind=F.when(has_cast & (pair["to"] != pair["was"]), "column_type_changed")
            .otherwise("column_expression_changed"),
            dataset=dataset, column=pair["name"],
            before_type=F.when(pair["was"] != "", S.trim_spaces(pair["was"])),
            after_type=F.when(has_cast, S.trim_spaces(pair["to"])),
            confidence=F.when(has_cast, 0.9).otherwise(0.85))

    return F.transform(paired, judge)


def _filter_change(dataset: Column) -> Column:
    old, new = F.col("old_filter"), F.col("new_filter")
    change = _change(
        kind=F.lit("filter_changed"), dataset=dataset,
        columns=F.array_union(S.source_columns(old), S.source_columns(new)),
        before_filter=S.none_if_empty(old), after_filter=S.none_if_empty(new), confidence=F.lit(0.95))
    return F.when(old != new, F.array(change)).otherwise(F.array().cast(NO_CHANGES))


def changed_files(revisions: DataFrame) -> DataFrame:
    """Analysable files whose text differs beyond comments, white space and case."""
    return revisions.filter(
        S.is_analyzable(F.col("path")) & (S.normalize_sql(F.col("before")) != S.normalize_sql(F.col("after")))
    )


def projections(revisions: DataFrame) -> DataFrame:
    """Both select lists parsed, where they differ: ``old``/``new`` entries and ``old_keys``/``new_keys``."""
    lists = settle(revisions, {
        "old_list": S.select_list_text(F.col("before")), "new_list": S.select_list_text(F.col("after"))})
    # Equal lists hold no finding, so they are not even split.
    differ = F.col("old_list") != F.col("new_list")
    split = settle(lists, {
        "old_all": _projection(S.split_select_list(F.when(differ, F.col("old_list")))),
        "new_all": _projection(S.split_select_list(F.when(differ, F.col("new_list")))),
    }).drop("old_list", "new_list")
    keyed = settle(split, {
        "old_keys": F.array_distinct(F.transform(F.col("old_all"), lambda p: p["key"])),
        "new_keys": F.array_distinct(F.transform(F.col("new_all"), lambda p: p["key"])),
    })
    unique = settle(keyed, {
        "old": _last_wins(F.col("old_all"), F.col("old_keys")),
        "new": _last_wins(F.col("new_all"), F.col("new_keys")),
        "gone_keys": F.array_except(F.col("old_keys"), F.col("new_keys")),
    }).drop("old_all", "new_all")
    return settle(unique, {"moved": F.array_except(_definitions("new"), _definitions("old"))})


def detect_changes(revisions: DataFrame, marker: str = "deltawarden") -> DataFrame:
    """One row per finding over a ``file_revision`` table (``status`` becomes ``file_status``)."""
    texts = changed_files(revisions.select(
        "analysis_id", "path", F.col("status").alias("file_status"), "before", "after"))
    files = settle(texts, {
        "dataset": S.infer_dataset(F.col("path"), F.col("before"), F.col("after"), marker),
        "sources": F.array_union(S.source_datasets(F.col("before")), S.source_datasets(F.col("after"))),
        "old_filter": S.where_clause(F.col("before")), "new_filter": S.where_clause(F.col("after")),
        "ddl": _ddl_changes(F.col("after")),
    })
    dataset = F.col("dataset")
    findings = projections(files).select(
        *FILE_KEYS, "sources",
        F.concat("ddl", _dropped_or_renamed(dataset), _changed_expressions(dataset), _filter_change(dataset))
        .alias("changes"),
    )
    rows = findings.select(*FILE_KEYS, "sources", F.posexplode("changes").alias("ordinal", "c"))
    return dedupe_changes(rows.select(
        *FILE_KEYS, "ordinal", *[F.col(f"c.{name}").alias(name) for name, _ in CHANGE_FIELDS], "sources"))


def dedupe_changes(changes: DataFrame) -> DataFrame:
    """Per file and (kind, dataset, column, new column) the most confident finding, the first on ties."""
    identity = [*[F.col(k) for k in FILE_KEYS], F.col("kind"), F.col("dataset"),
                F.coalesce("column", F.lit("")).alias("_column"),
                F.coalesce("new_column", F.lit("")).alias("_new_column")]
    kept = changes.groupBy(*identity).agg(
        F.max_by(F.struct(*[c for c in changes.columns if c not in (*FILE_KEYS, "kind", "dataset", "ordinal")]),
                 F.struct("confidence", -F.col("ordinal"))).alias("best"),
        F.min("ordinal").alias("ordinal"),
    )
    inner = {c for c in changes.columns if c not in (*FILE_KEYS, "kind", "dataset", "ordinal")}
    return kept.select(*[F.col(f"best.{c}").alias(c) if c in inner else F.col(c) for c in changes.columns])


def detect_changes_in_patches(patches: DataFrame, marker: str = "deltawarden") -> DataFrame:
    """The same over ``(analysis_id, path, status, patch)`` with unified diffs."""
    sides = S.split_patch(F.col("patch"))
    return detect_changes(
        patches.withColumn("_sides", sides)
        .withColumns({"before": F.col("_sides.before"), "after": F.col("_sides.after")}).drop("_sides", "patch"),
        marker,
    )
