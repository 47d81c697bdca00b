"""
Debounced edits: keyed state with a timer for each path, so that an audit sees a text once it has settled.

Each edit of (repo, path, text, version) replaces the pending text of its path and starts the delay anew; when it has passed without another edit, the text is given
away once, with a generation number that counts the settled texts of its path. Edits that are not newer than what is known are late and change nothing. State is
keyed by path in Spark's state store, so it is partitioned, checkpointed, and restored after a restart; a settled text is dropped from it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship
from .overlays import KEY, apply_batch

DELAY_MS = 400
SETTLED = "repo string, path string, text string, version long, generation long"
STATE = "text string, version long, generation long, deadline long"


def settle(delay_ms: int) -> Callable:
    """The function of one path's state: new edits in, its settled text out."""

    def run(key, edits, state: GroupState):
        text, version, generation, deadline = state.get if state.exists else (None, None, 0, 0)
        if state.hasTimedOut:
            state.update((None, version, generation + 1, 0))
            yield pd.DataFrame([(*key, text, version, generation + 1)], columns=["repo", "path", "text", "version", "generation"])
            return
        now = state.getCurrentProcessingTimeMs()
        for df in edits:
            newest = df.loc[df["version"].idxmax()]
            if version is None or newest["version"] > version:
                text, version, deadline = newest["text"], int(newest["version"]), now + delay_ms
        state.update((text, version, generation, deadline))
        if deadline:  # a late edit does not prolong the delay
            state.setTimeoutDuration(max(1, deadline - now))

    return run


def debounced(edits: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """
    ``edits`` (a stream of repo, path, text, version) as a stream of SETTLED. Edits without path or version are left out; a null text is one like any other (the
    file was closed). Of edits with equal versions the first that arrives counts.
    """
    rows = edits.where("repo is not null and path is not null and version is not null").select("repo", "path", "text", "version")
    return ship(rows).groupBy(*KEY).applyInPandasWithState(settle(delay_ms), SETTLED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def current(results: DataFrame, settled: DataFrame) -> DataFrame:
    """``results`` (repo, path, generation, ...) of audits without the stale ones: those for which ``settled`` has a newer generation of the path."""
    newest = settled.groupBy(*KEY).agg(F.max("generation").alias("generation"))
    return results.join(newest, [*KEY, "generation"], "left_semi")


def start(edits: DataFrame, state: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, delay_ms: int = DELAY_MS, every: str = "100 milliseconds"):
    """Applies settled texts to the table of ``overlays`` and calls ``on_change`` for batches that have any."""

    def batch(df: DataFrame, k: int) -> None:
        df = df.persist()
        try:
            if not df.isEmpty():
                apply_batch(df, k, state, on_change)
        finally:
            df.unpersist()

    return debounced(edits, delay_ms).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
