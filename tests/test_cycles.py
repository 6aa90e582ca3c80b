"""Strongly connected components against brute force, and the problems of a project."""

import random

import pytest

from deltawarden.operators.cycles import model_problems, strongly_connected


def brute(edges):
    reach = {}
    out = {}
    for a, b in edges:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    for start in out:
        seen, waiting = set(), list(out[start])
        while waiting:
            v = waiting.pop()
            if v not in seen:
                seen.add(v)
                waiting += out.get(v, ())
        reach[start] = seen
    return {(min(w for w in {v, *reach[v]} if w == v or v in reach.get(w, ())), v) for v in reach if v in reach[v]}


def found(spark, edges):
    rows = strongly_connected(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert len({r["vertex"] for r in rows}) == len(rows)
    return {(r["component"], r["vertex"]) for r in rows}


@pytest.mark.parametrize("n, m, seed", [(12, 14, 1), (30, 40, 2), (40, 120, 3)])
def test_random_graphs(spark, n, m, seed):
    r = random.Random(seed)
    edges = [(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(m)]
    assert found(spark, edges) == brute(edges)


def test_a_row_of_rings_and_odd_edges(spark):
    edges = [(f"r{k:02d}_{i}", f"r{k:02d}_{(i + 1) % 3}") for k in range(8) for i in range(3)]
    edges += [(f"r{k:02d}_0", f"r{k + 1:02d}_2") for k in range(7)]  # each ring leads to the next
    edges += [("a", "b"), ("b", "c"), ("x", "x"), ("r01_0", "r01_0"), (None, "a"), ("c", None), ("a", "b")]
    got = found(spark, edges)
    assert got == brute(edges) and len(got) == 25
    assert found(spark, []) == set() and found(spark, [("a", "b")]) == set()


def test_problems_of_models(spark):
    ref = "select * from {{{{ ref('{}') }}}}".format
    rows = [("a", ref("b")), ("b", ref("a")), ("c", ref("a")), ("d", ref("nobody")), ("e", " "), ("f", None),
            ("g", "select 1"), ("g", "select 2"), ("h", ref("h"))]
    got = {tuple(r) for r in model_problems(spark.createDataFrame(rows, "name string, sql string")).collect()}
    assert got == {("a", "cycle", "a"), ("b", "cycle", "a"), ("h", "cycle", "h"), ("d", "unknown_ref", "nobody"),
                   ("e", "missing_text", None), ("f", "missing_text", None), ("g", "repeated_name", None)}
