"""Models as DataFrames: building a chain, its reference edges, and what a change reaches."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, functions as F

from deltawarden.functions.sqltext import model_refs
from deltawarden.operators.lineage import downstream_lineage
from deltawarden.session import cut_lineage

Model = Callable[[Mapping[str, DataFrame]], DataFrame]


def build_models(
    sources: Mapping[str, DataFrame], models: Mapping[str, tuple[tuple[str, ...], Model]], share: bool = False
) -> dict[str, DataFrame]:
    """Build every model from the models and sources it names.

    ``models[name] = (inputs, build)`` where ``build`` receives ``{input: DataFrame}``.
    Nothing runs here: Catalyst sees the whole chain as one plan. With ``share`` a model that others read is written
    once and read by all of them and by whoever reads the model itself, so its sources are scanned once.
    """
    graph = {}
    for name, (inputs, _) in models.items():
        unknown = [i for i in inputs if i not in models and i not in sources]
        if unknown:
            raise ValueError(f"model {name} refers to unknown input {unknown[0]}")
        graph[name] = {i for i in inputs if i in models}
    try:
        order = list(TopologicalSorter(graph).static_order())
    except CycleError as error:
        raise ValueError(f"model dependency cycle at {error.args[1][0]}") from error
    built: dict[str, DataFrame] = {}
    for name in order:
        inputs, build = models[name]
        rows = build({i: built[i] if i in built else sources[i] for i in inputs})
        built[name] = cut_lineage(rows) if share and any(name in other for other in graph.values()) else rows
    return built


def model_ref_edges(model_sql: DataFrame) -> DataFrame:
    """``(src, dst)``: dst reads src, from the ref() calls in ``model_sql(name, sql)``."""
    return model_sql.select(F.explode(model_refs(F.col("sql"))).alias("src"), F.col("name").alias("dst"))


def affected_models(ref_edges: DataFrame, changed: DataFrame, **options) -> DataFrame:
    """Per analysis its changed models and everything that transitively refers to one of them, once:
    ``(analysis_id, name, degree)``, degree being the distance to the nearest changed model.

    ``changed(analysis_id, name)``; the reader orders by its own manifest position.
    """
    starts = changed.select(F.col("analysis_id").alias("root"), F.col("name").alias("start"))
    reach = downstream_lineage(ref_edges, starts, depth=None, with_hops=False, **options)
    own = changed.select("analysis_id", "name", F.lit(0).alias("degree")).distinct()
    return own.unionByName(reach.nodes.select(F.col("root").alias("analysis_id"), F.col("urn").alias("name"), "degree"))


def skipped_models(affected: DataFrame, replayable: DataFrame) -> DataFrame:
    """``(analysis_id, reason)`` for affected models that no replay covers; ``replayable(name)``."""
    return affected.join(replayable.select("name").distinct(), "name", "left_anti").select(
        "analysis_id", F.concat(F.lit("Model was not replayed: "), "name").alias("reason")).distinct()
