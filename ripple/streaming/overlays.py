"""
Live edits: a stream of (repo, path, text, version) keeps the newest text of each path, and an audit runs on each batch.

Micro-batches take the place of debouncing; foreachBatch runs one at a time, so audits never overlap, and a batch that
was already applied is skipped. The state is a Parquet table below ``state`` in buckets of paths: a batch rewrites only the buckets that it
touches, as a new generation of each, and removes the one before the last, so work follows the batch and disk follows the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.overlay import latest

SCHEMA = "repo string, path string, text string, version long"
KEY = ["repo", "path"]
#: Buckets of the state; a fixed property of its folder.
BUCKETS = 256


def _listing(spark: SparkSession, state: str):
    """(file system, {bucket: its generations, ascending}, ids of applied batches). A generation counts once its batch is marked as applied."""
    jvm = spark._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{state}/{name}")
    system = at("x").getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda where, head: [s.getPath().getName()[len(head) :] for s in system.listStatus(where) if s.getPath().getName().startswith(head)] if system.exists(where) else []
    done = set(map(int, names(at("applied"), "batch=")))
    buckets: dict[int, list[int]] = {}
    for g in sorted(done & set(map(int, names(jvm.org.apache.hadoop.fs.Path(state), "g=")))):
        for k in names(at(f"g={g}"), "bucket="):
            buckets.setdefault(int(k), []).append(g)
    return system, buckets, done


def _read(spark: SparkSession, state: str, held: dict[int, list[int]]) -> DataFrame:
    folders = [f"{state}/g={g[-1]}/bucket={k}" for k, g in held.items()]
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def newest(spark: SparkSession, state: str) -> DataFrame:
    """The newest text of each path that has been applied."""
    return _read(spark, state, _listing(spark, state)[1])


def apply_batch(batch: DataFrame, batch_id: int, state: str, on_change: Callable[[DataFrame, int], None] | None = None) -> None:
    spark = batch.sparkSession
    system, held, done = _listing(spark, state)
    if batch_id in done:
        return
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")
    batch = batch.select("repo", "path", "text", "version").persist()
    touched = {r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()}  # BUCKETS at most
    merged = latest(_read(spark, state, {k: g for k, g in held.items() if k in touched}).unionByName(batch), KEY, "version").withColumn("bucket", bucket)
    merged.select("repo", "path", "text", "version", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/g={batch_id}")
    mark = spark._jvm.org.apache.hadoop.fs.Path
    system.mkdirs(mark(f"{state}/applied/batch={batch_id}"))
    for k in touched:
        for g in held.get(k, [])[:-1]:  # readers may still hold the last one
            system.delete(mark(f"{state}/g={g}/bucket={k}"), True)
    batch.unpersist()
    if on_change:
        on_change(newest(spark, state), batch_id)


def payload(texts: DataFrame, active: str | None = None, most: int = 3) -> DataFrame:
    """What an editor sends: the active file first, then the newest, three files at most."""
    first = F.when(F.col("path") == F.lit(active), 0).otherwise(1)
    return texts.orderBy(first, F.desc("version"), "path").limit(most)


def start(edits: DataFrame, state: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, every: str = "400 milliseconds", available_now: bool = False):
    writer = edits.writeStream.foreachBatch(lambda df, k: apply_batch(df, k, state, on_change)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
