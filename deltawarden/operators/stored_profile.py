"""Profiles that are kept: one mergeable state per input file, so that only new files are ever read.

A state holds what adds up: rows, nulls by column, sums, counts, least and largest values, and for approximate medians
a KLL sketch. Refreshing lists the files, drops the states of files that went or were replaced, computes states of the
files that have none, and merges. The result has the rows of ``profile_table``; numbers are those of a whole profile,
medians have the rank error of the sketch: about 1.33 / 0.66 / 0.33 % of the rows for k of 200 / 400 / 800 at 99 %
confidence. ``profile_table`` stays the way to exact medians.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deltawarden.operators.profile import NAME, finite, quoted
from deltawarden.session import cut_lineage, with_key
from deltawarden.sources.pinned import bare_path, decoded_path
from deltawarden.sources.store import KeyedStore

# Fixed value: what a state can be, and how states are merged.
MERGES = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class State:
    """``kind`` of ``of`` (an SQL expression) over the rows that ``where`` holds for."""

    kind: str
    of: str
    where: str | None = None

    def aggregate(self) -> Column:
        if self.kind not in MERGES:
            raise ValueError(f"a state is one of {', '.join(MERGES)}, not {self.kind}")
        value = F.expr(self.of) if self.where is None else F.when(F.expr(self.where), F.expr(self.of))
        return getattr(F, self.kind)(value)


@dataclass(frozen=True)
class StoredMeasures:
    """states by name; metrics and distributions are SQL expressions over states; medians are of row expressions."""

    states: Mapping[str, State] = field(default_factory=dict)
    metrics: Mapping[str, str] = field(default_factory=dict)
    distributions: Mapping[str, str] = field(default_factory=dict)
    medians: Mapping[str, str] = field(default_factory=dict)
    k: int = 400

    def __post_init__(self) -> None:
        for name in (*self.states, *self.metrics, *self.distributions, *self.medians):
            if not NAME.match(name):
                raise ValueError(f"not an identifier: {name}")


def states(rows: DataFrame, measures: StoredMeasures, keys: Sequence[str] = ()) -> DataFrame:
    """One mergeable state per key, from one aggregate with partial sums on the map side."""
    columns = [c for c in rows.columns if c not in keys]
    nulls = F.array(*[F.count_if(F.col(quoted(c)).isNull()) for c in columns]) if columns else F.array().cast("array<bigint>")
    return rows.groupBy(*[quoted(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"),
        *[s.aggregate().alias(f"state_{n}") for n, s in measures.states.items()],
        *[F.kll_sketch_agg_double(F.expr(e).cast("double"), measures.k).alias(f"sketch_{n}") for n, e in measures.medians.items()])


def merged(parts: DataFrame, measures: StoredMeasures, n_columns: int, keys: Sequence[str] = ()) -> DataFrame:
    """States of all parts together, in the same layout."""
    nulls = F.array(*[F.sum(F.get("nulls", F.lit(i))) for i in range(n_columns)]) if n_columns else F.array().cast("array<bigint>")
    return parts.groupBy(*[quoted(k) for k in keys]).agg(
        F.sum("rows").alias("rows"), nulls.alias("nulls"),
        *[MERGES[s.kind](f"state_{n}").alias(f"state_{n}") for n, s in measures.states.items()],
        *[F.kll_merge_agg_double(f"sketch_{n}", measures.k).alias(f"sketch_{n}") for n in measures.medians])


def profile_of(total: DataFrame, types: Sequence[tuple[str, str]], measures: StoredMeasures,
               keys: Sequence[str] = ()) -> DataFrame:
    """The long profile ``(*keys, category, metric, num_value, text_value)`` of merged states."""
    def row(category: str, metric: str, number: Column, text: str | None = None) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(metric).alias("metric"),
                        number.cast("double").alias("num_value"), F.lit(text).cast("string").alias("text_value"))

    count = F.coalesce(F.col("rows"), F.lit(0))
    rate = lambda i: F.coalesce(F.try_divide(F.get("nulls", F.lit(i)) * F.lit(100.0), F.col("rows")), F.lit(0.0))
    named = total.withColumnsRenamed({f"state_{n}": n for n in measures.states})
    found = [row("schema", name, F.lit(None), kind) for name, kind in types]
    found += [row("volume", "rowCount", count)]
    found += [row("null_rate", name, rate(i)) for i, (name, _) in enumerate(types)]
    for category, expressions in (("metric", measures.metrics), ("distribution", measures.distributions)):
        found += [row(category, n, finite(F.expr(e).cast("double"), n)) for n, e in expressions.items()]
    for n in measures.medians:
        sketch = F.col(f"sketch_{n}")
        some = F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(0.5)))
        found.append(row("distribution", n, some))
    return named.select(*keys, F.inline(F.array(*found)))


def approximate_profile(rows: DataFrame, measures: StoredMeasures, keys: Sequence[str] = ()) -> DataFrame:
    """A whole profile in one pass, with approximate medians."""
    types = [(n, t) for n, t in rows.dtypes if n not in keys]
    return profile_of(states(rows, measures, keys), types, measures, keys)


@dataclass(frozen=True)
class StoredProfile:
    """The profile of the files below ``location``; their states are kept in a store at ``store_path``.

    ``select`` are the SQL expressions of the profiled columns, by default the columns of the files.
    """

    spark: SparkSession
    location: str
    store_path: str
    measures: StoredMeasures
    select: Sequence[str] = ("*",)
    buckets: int = 16

    def _store(self) -> KeyedStore:
        return KeyedStore(self.spark, self.store_path, "file", self.buckets)

    def _listing(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "*.parquet").load(self.location)
        return files.select("path", bare_path(F.col("path")).alias("file"), F.col("length").alias("size"),
                            F.col("modificationTime").alias("modified"))

    def _states_of(self, rows: DataFrame, listing: DataFrame) -> DataFrame:
        file = bare_path(decoded_path(F.col("_metadata.file_path")))
        shown = rows.select(file.alias("file"), F.struct(*[F.expr(e) for e in self.select] if tuple(self.select) != ("*",)
                                                          else [F.col(quoted(c)) for c in rows.columns]).alias("row"))
        found = states(shown.select("file", "row.*"), self.measures, ["file"])
        empty = listing.join(found, "file", "left_anti").select("file")  # files without a row have a state, too
        return found.unionByName(empty, allowMissingColumns=True).join(
            listing.select("file", "size", "modified"), "file")

    def refresh(self) -> DataFrame:
        """The profile of the files as they are now; reads only those that have no state yet."""
        listing = cut_lineage(self._listing())
        whole = self.spark.read.parquet(self.location)
        types = whole.selectExpr(*self.select).dtypes
        store = self._store()
        version = store.version()
        if version.folders:
            known = store.rows(version=version)
            current = known.join(listing.select("file", "size", "modified"), ["file", "size", "modified"], "left_semi")
            fresh = cut_lineage(listing.join(known.select("file", "size", "modified"), ["file", "size", "modified"], "left_anti"))
            paths = [r["path"] for r in fresh.select("path").toLocalIterator()]  # names of new files
            new = self._states_of(self.spark.read.schema(whole.schema).parquet(*paths), fresh) if paths else None
            gone = known.select("file").join(listing.select("file"), "file", "left_anti")
        else:
            current, new, gone = None, self._states_of(whole, listing), None
        if new is not None:
            new = cut_lineage(new)
            current = new if current is None else current.unionByName(new)
            self._put(store, new)
        if gone is not None and not gone.isEmpty():
            store.update(cut_lineage(gone), lambda stored, left: stored.join(left, "file", "left_anti"), known.schema)
        total = merged(current, self.measures, len(types))
        return profile_of(total, types, self.measures)

    def _put(self, store: KeyedStore, new: DataFrame) -> None:
        store.update(new, lambda stored, fresh: stored.join(fresh.select("file"), "file", "left_anti").unionByName(fresh))


def with_model(profile: DataFrame, analysis_id: str, model: str, side: str) -> DataFrame:
    """A stored profile as one side of a comparison."""
    return with_key(profile, {"analysis_id": analysis_id, "model": model, "side": side})
