"""Keyed state with timers: edits within the delay are one, late ones none, and what was pending survives a restart."""

import time

from ripple.streaming import debounce, overlays


def _put(spark, folder, *rows):
    spark.createDataFrame(rows, overlays.SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _until(test, seconds=60):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.1)
    return test()


def test_debounced(spark, tmp_path):
    folder, state, check = (str(tmp_path / x) for x in ("in", "state", "check"))
    _put(spark, folder, ("r", "a.py", "one", 1), ("r", None, "no path", 1))
    edits = spark.readStream.schema(overlays.SCHEMA).parquet(folder)
    seen = []

    def settled(df, k):
        seen.extend((r["path"], r["text"], r["version"], r["generation"]) for r in df.collect())

    def run(delay):
        return debounce.debounced(edits, delay).writeStream.outputMode("append").foreachBatch(settled).option("checkpointLocation", check).trigger(processingTime="100 milliseconds").start()

    q = run(60_000)
    try:
        assert _until(lambda: sum(p["numInputRows"] for p in q.recentProgress) >= 2)
        _put(spark, folder, ("r", "a.py", "two", 2), ("r", "a.py", "late", 1), ("r", "b.py", "other", 7))
        assert _until(lambda: sum(p["numInputRows"] for p in q.recentProgress) >= 5)
    finally:
        q.stop()
    assert seen == []  # nothing has settled yet
    q = run(300)  # after the restart a newer edit of one path settles; the other's state is still there
    try:
        _put(spark, folder, ("r", "a.py", "three", 3), ("r", "b.py", "late", 6))
        assert _until(lambda: ("a.py", "three", 3, 1) in seen)
        _put(spark, folder, ("r", "a.py", "old", 3), ("r", "a.py", "four", 4))
        assert _until(lambda: len(seen) >= 2 and ("a.py", "four", 4, 2) in seen)
        assert _until(lambda: ("b.py", "other", 7, 1) in seen, 90)  # by the deadline of its first run
    finally:
        q.stop()
    assert sorted(seen) == [("a.py", "four", 4, 2), ("a.py", "three", 3, 1), ("b.py", "other", 7, 1)]


def test_start(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    _put(spark, folder, ("r", "a.py", "one", 1), ("r", "a.py", "two", 2))
    calls = []
    q = debounce.start(spark.readStream.schema(overlays.SCHEMA).parquet(folder), state, str(tmp_path / "check"), lambda df, k: calls.append(sorted((r["path"], r["text"]) for r in df.collect())), delay_ms=200)
    try:
        assert _until(lambda: calls)
    finally:
        q.stop()
    assert calls == [[("a.py", "two")]] == [[(r["path"], r["text"]) for r in overlays.newest(spark, state).collect()]]


def test_current(spark):
    results = spark.createDataFrame([("r", "a", 1, "x"), ("r", "a", 2, "y"), ("r", "b", 1, "z"), ("r", "c", 1, "unknown")], "repo string, path string, generation long, report string")
    settled = spark.createDataFrame([("r", "a", "", 5, 1), ("r", "a", "", 6, 2), ("r", "b", "", 1, 1)], debounce.SETTLED.replace("version long", "version long"))
    assert sorted(r["report"] for r in debounce.current(results, settled).collect()) == ["y", "z"]
