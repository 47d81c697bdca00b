"""Containment through the index of parts against a product of all names and entries."""

from hypothesis import given, settings
from hypothesis import strategies as st

from ripple.operators import grounding

_words = st.lists(st.tuples(st.sampled_from("xy"), st.one_of(st.none(), st.text("abA_é", max_size=6))), max_size=25)


def brute(names, entries):
    low = lambda rows: {(k, v.lower()) for k, v in rows if v is not None}
    e = low(entries)
    part = lambda a, b: len(a) > 2 and len(b) > 2 and (a in b or b in a)
    return sorted((k, n, any(g == k and (n == x or part(n, x)) for g, x in e)) for k, n in low(names))


@settings(max_examples=12, deadline=None)
@given(_words, _words)
def test_supported(spark, names, entries):
    n, e = spark.createDataFrame(names, "repo string, name string"), spark.createDataFrame(entries, "repo string, entry string")
    got = grounding.supported(n, e, ("repo",))
    assert sorted(map(tuple, got.select("repo", "name", "supported").collect())) == brute(names, entries)


def test_no_product(spark):
    """Names that share only common parts with the entries do not meet them all: the join is on a part, and the plan has no product."""
    n = spark.createDataFrame([(f"name_{k:05d}_end",) for k in range(2000)], "name string")
    e = spark.createDataFrame([(f"{k:05d}_e",) for k in range(0, 4000, 7)], "entry string")
    got = grounding.supported(n, e)
    assert got.where("supported").count() == len(range(0, 2000, 7))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
