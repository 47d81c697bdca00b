"""Closures of deep graphs: chains and cycles of many hops, forks between them, several seeds."""

import random

import pytest

from ripple.operators import graph


def brute(edges, seeds):
    out = {(s, k): 0 for s, k in seeds}
    level = list(out)
    hop = 0
    while level:
        hop += 1
        found = {(src, k) for x, k in level for src, dst in edges if dst == x} - out.keys()
        out |= dict.fromkeys(found, hop)
        level = list(found)
    return out


def _made(kind):
    r = random.Random(kind)
    chain = [(f"a{k + 1}", f"a{k}") for k in range(48)]
    if kind == 1:  # a cycle, entered twice
        return [*chain, ("a0", "a48")], [("a5", "x"), ("a30", "x"), ("a44", "y")]
    if kind == 2:  # shortcuts and side branches
        return [*chain, *((f"a{r.randrange(48)}", f"a{r.randrange(48)}") for _ in range(4)), *((f"b{k}", f"a{9 * k}") for k in range(5)), *((f"c{k}", f"b{k}") for k in range(5)), *chain[:9]], [("a0", "x"), ("a33", "y")]
    return [*chain[:30], *((f"b{k + 1}", f"b{k}") for k in range(30)), ("b0", "a20"), ("a30", "b30"), ("d", "a30")], [("a0", "x")]


@pytest.mark.parametrize(("kind", "deep", "most"), [(1, 12, None), (2, 12, None), (3, 2, 30)])
def test_deep(spark, monkeypatch, kind, deep, most):
    monkeypatch.setattr(graph, "DEEP", deep)
    edges, seeds = _made(kind)
    e = spark.createDataFrame([("r", *x) for x in edges], "repo string, src string, dst string")
    got = graph.closure(e, spark.createDataFrame([("r", *x) for x in seeds], "repo string, path string, seed string"), by=("seed",), max_hops=most)
    assert sorted((x.path, x.seed, x.hops) for x in got.collect()) == sorted((*k, h) for k, h in brute(edges, seeds).items() if h <= (most or h))


def test_few_rounds(spark, monkeypatch):
    """A chain's length costs rounds by its logarithm: each hop had two checkpoints before."""
    n, cut = [0], graph.cut_lineage

    def counted(df):
        n[0] += 1
        return cut(df)

    monkeypatch.setattr(graph, "cut_lineage", counted)
    e = spark.range(1000).selectExpr("'r' AS repo", "concat('a', id + 1) AS src", "concat('a', id) AS dst")
    got = graph.rings(e, spark.createDataFrame([("r", "a0")], "repo string, path string"))
    assert got.selectExpr("count(*)", "sum(hops)").first() == (1000, 500500)
    assert n[0] < 80
