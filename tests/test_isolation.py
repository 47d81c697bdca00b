"""Sources that kill or hold their parser cost themselves only."""

import os
import time

from ripple.sources import facts
from ripple.sources.isolation import Isolated


def _odd(x):
    if x == "die":
        os.kill(os.getpid(), 9)
    if x == "hang":
        time.sleep(60)
    if x == "raise":
        raise ValueError(x)
    return x * 2


def test_isolated():
    with Isolated(_odd, 1.0) as f:
        assert [f(x) for x in ("a", "die", "b", "hang", "c", "raise", "d")] == ["aa", None, "bb", None, "cc", None, "dd"]
        assert f.started == 4 and f(b"x" * 5_000_000) == b"x" * 10_000_000
    assert f.child is None


def test_parse_contents(spark):
    def parse(content, language):
        if content == b"import killer":
            os.kill(os.getpid(), 9)
        return facts.parse_one(content, language)

    rows = [(str(k), "python", b"import killer" if k % 10 == 3 else b"import os\ndef f():\n    return g()\n") for k in range(50)] + [("bad", "python", b"def ("), ("none", "javascript", b"")]
    df = spark.createDataFrame(rows, "digest string, language string, content binary")
    got = {r["digest"]: r for r in facts.parse_contents(df, parse).collect()}
    assert len(got) == len(rows) and {k for k, r in got.items() if not r["parse_ok"]} == {"3", "13", "23", "33", "43", "bad"}
    assert all(r["imports"][0]["module"] == "os" and r["calls"][0]["callee"] == "g" for k, r in got.items() if r["parse_ok"] and k != "none")


def test_many_calls():
    """Calls that are sent at once: each death or time limit costs its own answer, and the rest go to a new child."""
    with Isolated(_odd, 1.0) as f:
        assert f.each([(x,) for x in ("a", "die", "b", "hang", "c", "raise")]) == ["aa", None, "bb", None, "cc", None]
        assert f.started == 3 and f.each([]) == [] and f.each([(b"x" * 3_000_000,)] * 3) == [b"x" * 6_000_000] * 3


def test_parsing_is_dealt(spark):
    """Small sources are not merged into one task by their bytes, and facts that are read several times are parsed once."""
    df = spark.range(64).selectExpr("cast(id AS string) AS digest", "'python' AS language", "cast('import os' AS binary) AS content")
    assert facts.parse_contents(df.groupBy("digest", "language").agg({"content": "any_value"}).toDF("digest", "language", "content")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
