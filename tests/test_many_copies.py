"""A content that very many files share does not bring all of them into one task."""

from pyspark.sql import functions as F

from ripple.plans.engine import Tables
from ripple.sources import facts


def test_copies_in_parts(spark, monkeypatch):
    monkeypatch.setattr(facts, "COPIES", 5)
    rows = [("r", f"p{k}.py", b"import os\n") for k in range(200)] + [("q", "x.py", b"def f():\n    pass\n"), ("q", "y.py", b"import os\n"), ("q", "y.js", b"")]
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        made = facts.facts_of(facts.from_contents(spark.createDataFrame(rows, "repo string, path string, content binary")))
        got = made.select("repo", "path", F.size("imports").alias("i"), F.size("definitions").alias("d"), F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r["repo"], r["path"], r["i"], r["d"]) for r in got) == sorted((repo, path, int(b"import" in c), int(b"def" in c)) for repo, path, c in rows)
    share = [sum(r["at"] == k for r in got) for k in range(8)]
    assert max(share) < 100


def test_kept_facts_are_dealt(spark):
    """Facts that an engine keeps do not stay in the task of their input's split."""
    made = facts.from_contents(spark.range(400).coalesce(1).select(F.lit("r").alias("repo"), F.format_string("p%d.py", "id").alias("path"), F.encode(F.lit("import os\n"), "UTF-8").alias("content")))
    kept = Tables.of(made).facts
    share = [r["n"] for r in kept.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    kept.unpersist()
    assert sum(share) == 400 and len(share) > 1
