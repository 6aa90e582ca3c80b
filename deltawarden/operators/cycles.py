"""Cycles among references, over an edge table of any size.

Vertices without a way in or a way out lie on no cycle and are trimmed, again and again, which takes all of an acyclic
graph away. For the rest every vertex learns the first of all vertices that lead to it, in a hashed order; those that
share a first one and lead back to it make a strongly connected component. Edges between vertices with different first
ones are on no cycle, so the rest falls apart into pieces, in about a logarithmic number of rounds. Every step is a
join and an aggregate over what is left, written before the next step reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltawarden.functions.sqltext import model_refs
from deltawarden.session import cut_lineage, grows


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges on paths between vertices that have both a way in and a way out, and how many are left."""
    left = edges.count()
    while left:
        ways_in = edges.select(F.col("dst").alias("src")).distinct()
        ways_out = edges.select(F.col("src").alias("dst")).distinct()
        edges = cut_lineage(edges.join(grows(ways_in), "src", "left_semi").join(
            grows(ways_out), "dst", "left_semi").select("src", "dst"))
        before, left = left, edges.count()
        if left == before:
            break
    return edges, left


def _firsts(edges: DataFrame) -> DataFrame:
    """``(vertex, first)``: the first of all vertices from which a vertex can be reached, itself included."""
    place = lambda name: F.struct(F.xxhash64(name).alias("hash"), F.col(name).alias("name"))
    now = cut_lineage(edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct().select(
        "vertex", place("vertex").alias("first")))
    moved = now
    while not moved.isEmpty():
        # Only what changed last time can change anything now.
        offered = edges.join(grows(moved), F.col("src") == F.col("vertex")).groupBy(F.col("dst").alias("at")).agg(
            F.min("first").alias("offer"))
        now = cut_lineage(now.join(grows(offered), F.col("vertex") == F.col("at"), "left").select(
            "vertex", F.least("first", F.coalesce("offer", "first")).alias("first"),
            (F.col("offer") < F.col("first")).alias("moved")))
        moved = now.where("moved").select("vertex", "first")
        now = now.select("vertex", "first")
    return now.select("vertex", F.col("first.name").alias("first"))


def _led_back(edges: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(vertex, first)`` of the vertices that lead back to their own first one; edges stay within equal firsts."""
    reached = cut_lineage(firsts.where("vertex = first"))
    fresh = reached
    while not fresh.isEmpty():
        step = edges.join(grows(fresh), F.col("dst") == F.col("vertex")).select(F.col("src").alias("vertex"), "first").distinct()
        fresh = cut_lineage(step.join(grows(reached.select("vertex")), "vertex", "left_anti"))
        reached = reached.unionByName(fresh)
    return cut_lineage(reached)


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``(component, vertex)`` of all vertices on a cycle; a component is named by its smallest vertex.

    A vertex that refers to itself alone is a component of one. Repeated edges and edges without an end count for nothing.
    """
    edges = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    found = cut_lineage(edges.where("src = dst").select(F.col("src").alias("first"), F.col("src").alias("vertex")))
    left, n = _trimmed(edges.where("src <> dst"))
    while n:
        firsts = _firsts(left)
        ends = left.join(grows(firsts.withColumnsRenamed({"vertex": "src", "first": "of_src"})), "src").join(
            grows(firsts.withColumnsRenamed({"vertex": "dst", "first": "of_dst"})), "dst")
        within = cut_lineage(ends.where("of_src = of_dst").select("src", "dst"))
        members = _led_back(within, firsts)
        whole = members.groupBy(F.col("first").alias("of_first")).agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(cut_lineage(members.join(grows(whole), F.col("first") == F.col("of_first"), "left_semi").select(
            "first", "vertex")))
        done = members.select("vertex")
        left, n = _trimmed(cut_lineage(within.join(grows(done.withColumnRenamed("vertex", "src")), "src", "left_anti").join(
            grows(done.withColumnRenamed("vertex", "dst")), "dst", "left_anti").select("src", "dst")))
    # A vertex with an edge to itself may be in a larger component as well: that one counts.
    sizes = found.groupBy("first").agg(F.min("vertex").alias("component"), F.count("*").alias("n"))
    named = found.join(grows(sizes), "first").groupBy("vertex").agg(F.max_by("component", "n").alias("component"))
    return named.select("component", "vertex")


def model_problems(models: DataFrame) -> DataFrame:
    """``(name, problem, detail)`` of models that cannot be built: ``cycle`` (the smallest model on it), ``unknown_ref``
    (what is referred to), ``missing_text``, ``repeated_name``.

    ``models(name, sql)``; whole projects of any number of models, none of it on the driver.
    """
    none = F.lit(None).cast("string")
    names = models.groupBy("name").agg(F.count("*").alias("n"))
    edges = cut_lineage(models.select(F.explode(model_refs(F.col("sql"))).alias("src"), F.col("name").alias("dst")).distinct())
    cycles = strongly_connected(edges).select(F.col("vertex").alias("name"), F.lit("cycle").alias("problem"),
                                              F.col("component").alias("detail"))
    unknown = edges.join(names.select(F.col("name").alias("src")), "src", "left_anti").select(
        F.col("dst").alias("name"), F.lit("unknown_ref").alias("problem"), F.col("src").alias("detail"))
    empty = models.where(F.coalesce(F.trim("sql"), F.lit("")) == "").select(
        "name", F.lit("missing_text").alias("problem"), none.alias("detail")).distinct()
    repeated = names.where("n > 1").select("name", F.lit("repeated_name").alias("problem"), none.alias("detail"))
    return cycles.unionByName(unknown).unionByName(empty).unionByName(repeated)
