"""What a task holds does not grow with a table, and sorts do not begin with what all rows share."""

from pyspark.sql import functions as F

from ripple import adapters
from ripple.operators import uses
from ripple.plans import lenses


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_lines_by_splits(spark, sf_dir):
    made = adapters.order_definitions(spark, sf_dir)
    assert "SortAggregate" not in _plan(made)
    assert made.rdd.getNumPartitions() == adapters.PER_SPLIT * adapters.read(spark, sf_dir, "lineitem").rdd.getNumPartitions()


def test_greatest_flag(spark, tmp_path):
    rows = [(1, 1, "R", 1.0), (1, 1, "N", 2.0), (1, 2, "R", 1.0), (1, 2, "S", 1.0), (1, 3, None, 1.0), (1, 4, "R", 1.0), (1, 4, None, 1.0), (1, 5, "A", 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(x.line for x in adapters.order_definitions(spark, str(tmp_path)).collect()) == [1, 4]


def test_annotations_in_given_tasks(spark):
    symbols = spark.createDataFrame([("r", f"p{k}", 1, f"d{k}") for k in range(50)], "repo string, path string, line int, detail string")
    seeds, impact = symbols.select("repo", "path"), symbols.select("repo", "path", F.lit(True).alias("is_danger"), F.lit("x").alias("reason"))
    got = lenses.annotations(symbols, symbols, seeds, impact, 7)
    assert got.rdd.getNumPartitions() == 7
    assert {(x.kind, x.text) for x in got.collect()} == {("symbol", f"d{k}") for k in range(50)}


def test_users_sorted_by_path(spark):
    row = spark.createDataFrame([("r", "a.py", "f", "function")], "repo string, path string, name string, kind string")
    edges = spark.createDataFrame([("r", "b.py", "a.py")], "repo string, src string, dst string")
    imports = spark.createDataFrame([("r", "b.py", 0, "a", ["f"], 1)], "repo string, path string, ordinal int, module string, symbols array<string>, line int")
    calls = spark.createDataFrame([("r", "b.py", 0, "f", 2)], "repo string, path string, ordinal int, callee string, line int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        users = uses.symbol_users(row, edges, imports, calls)
        assert any(x in _plan(users) for x in ("Sort [path", "Sort [name")) and "Sort [repo" not in _plan(users)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [tuple(x) for x in users.collect()] == [("r", "a.py", "f", "function", "b.py", 1, [2])]
