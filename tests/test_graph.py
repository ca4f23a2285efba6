"""Strongly connected components and cycles against plain walks."""

import random

import pytest

from quillspar.operators import graph


def plain_components(pairs):
    nodes = {x for p in pairs for x in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}

    def reach(n):
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    ahead = {n: reach(n) for n in nodes}
    parts = {n: {m for m in ahead[n] if n in ahead[m]} for n in nodes}
    return {(n, min(p), len(p)) for n, p in parts.items() if p}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_plain_reach(spark, seed):
    rng = random.Random(seed)
    n = (8, 30, 60)[seed]
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * (1.6, 1.2, 1.05)[seed]))}
    found = graph.strong_components(spark.createDataFrame([*sorted(pairs), (None, 1), (2, None)], "src long, dst long")).collect()
    assert {(r.node, r.root, r.size) for r in found} == plain_components(pairs)
    assert len(found) == len({r.node for r in found})


def test_a_long_path_that_ends_in_a_ring(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(60, 55)]
    found = graph.strong_components(spark.createDataFrame(pairs, "src long, dst long"), trims=0).collect()
    assert {(r.node, r.root, r.size) for r in found} == {(i, 55, 6) for i in range(55, 61)}


def test_cycles_are_walked_inside_components(spark):
    rows = [("r", "in", "b", 0), ("r", "b", "c", 1), ("r", "c", "a", 2), ("r", "a", "b", 3), ("r", "c", "out", 4), ("r", "x", "y", 5), ("r", "y", "x", 6), ("s", "b", "c", 0), ("s", "z", "z", 1)]
    found = {(r.repo, r.n, r.cycle) for r in graph.cycles(spark.createDataFrame(rows, "repo string, src string, dst string, ord int")).collect()}
    assert found == {("r", 0, "b > c > a > b"), ("r", 1, "x > y > x"), ("s", 0, "z > z")}


def test_no_edges(spark):
    assert graph.strong_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    assert graph.strong_components(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).collect() == []


def test_structural_patterns(spark):
    from quillspar.operators import context

    def found(pairs):
        return [tuple(r) for r in context.structural_patterns(spark.createDataFrame(pairs, "src string, dst string")).collect()]

    chain = [(f"n{i}", f"n{i + 1}") for i in range(11)]
    assert found(chain + chain) == [("layered", 11)]
    assert found(chain[:10]) == [] and found([]) == []
    assert found([*chain, ("n3", "n1"), ("n9", "n8")]) == [("cyclic", 2)]


def test_components_broadcast_nothing(spark, monkeypatch):
    plans = []
    write = graph.write_table

    def written(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(graph, "write_table", written)
    pairs = [(i, i + 1) for i in range(40)] + [(40, 20), (7, 7), (10, 5)]
    found = graph.strong_components(spark.createDataFrame(pairs, "src long, dst long"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {(r.node, r.root, r.size) for r in found.collect()} == {*((i, 5, 6) for i in range(5, 11)), *((i, 20, 21) for i in range(20, 41))}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
