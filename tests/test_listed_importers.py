"""Importers in one shuffle, hubs apart, against importers_of and plain Python."""

from ripple.operators import resolve

ROWS = [("r", f"s{k}", f"d{k % 4}") for k in range(12)] + [("r", f"s{k:02d}", "hub") for k in range(40)] * 2 + [("r", "s1", "d1")] * 3 + [("q", "x", "d1"), ("q", "x", None), ("r", None, "d2")]


def test_listed_importers(spark, monkeypatch):
    edges = spark.createDataFrame(ROWS, "repo string, src string, dst string")
    order = lambda df: sorted(((r["repo"], r["path"] or "", list(r["importers"]["first"]), r["importers"]["n"]) for r in df.collect()))
    want = order(resolve.importers_of(edges))
    pairs = {}
    for repo, src, dst in set(ROWS):
        pairs.setdefault((repo, dst), []).append(src)
    for most in (20, 100_000):
        monkeypatch.setattr(resolve, "HUB", most)
        got = order(resolve.listed_importers(edges))
        assert [x for x in got if x[1]] == [x for x in want if x[1]]
        assert all(n == len(pairs[repo, path or None]) for repo, path, _, n in got) and ("q", "", ["x"], 1) in got


def test_edges_meet_once(spark):
    """Nodes that are no hubs need no distinct pairs: nothing is dealt by both ends of an edge before the importers are ranked."""
    edges = spark.createDataFrame(ROWS, "repo string, src string, dst string")
    plan = resolve.listed_importers(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" in plan and plan.count("Window ") <= 2
