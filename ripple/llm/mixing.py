"""
Mixing sources to target weights by weighted fair queueing.

Every source is a queue that is served at a rate in proportion to its target. A shuffled document has
the virtual finish time (tokens of its source up to and with it) / target; pass p of a source follows
pass p - 1. All events are range-sorted by finish time over all sources and truncated at the total budget.

Scale: a source's queue is cut into hash ranges, so that no task ever holds a whole source. Each range is
summed, the sums are added up over the ranges of a block and over the blocks of a source, and only rows of one range are sorted together.
The sorted events are narrow (size, time) and dealt out by time; sums of the parts say in which the budget runs out, only this
part is sorted into smaller ones, and so on, until one of a fixed size is added up event by event.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of one hash range that are sorted together, about, and ranges (as a power of two) of a block.
RANGE_ROWS, BLOCK_BITS = 256, 10
#: Events that one task adds up one by one, about, and parts that a queue is cut into at once.
PART_EVENTS, PARTS = 1 << 14, 4096
SEED = 17


@dataclass(frozen=True)
class Mix:
    """docs: row (the kept columns), size, source_size, target, taken, finish (a double for each pass)."""

    docs: DataFrame
    budget: float
    cut: float


def shuffle_key(seed: int = SEED) -> Column:
    """63 bits by id and text, so that a much repeated id is spread over all ranges."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 1)


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) by code point of ``source``, null last; no task sorts all sources."""
    order = ["no_source", "source_key"]
    # the partition's number is only stable once written: a checkpoint keeps it
    parts = sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    parts = common.written(parts, "sources")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["n"] for r in parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, total = {}, 0
    for k in sorted(counts):
        before[k], total = total, total + counts[k]
    if not before:
        return parts.withColumn("rank", F.lit(0).cast("long")).drop("at")
    offsets = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    return parts.withColumn("rank", F.element_at(offsets, part.cast("int")).cast("long") + row).drop("at")


def with_targets(sources: DataFrame, budget: float, passes: int) -> DataFrame:
    """
    Adds ``target``: shares of ``budget`` by ``weight``, none above passes * source_size; what is above
    is shared again by weight among the others until none is above. Each round adds up the sources once
    and gives the driver two sums.
    """
    cap = F.lit(float(passes)) * F.col("source_size")
    level = 0.0
    while True:
        full = F.lit(level) * F.col("weight") >= cap
        got = sources.agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        weights, rest = got["weights"] or 0, budget - (got["full"] or 0.0)
        if not weights:
            break
        new = max(level, rest / weights)
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), passes: int = 2, seed: int = SEED, keep: list[str] | None = None) -> Mix:
    """
    The mix of ``docs`` (doc_id, text, source): sources by code point (null last) take ``weights`` in turn and
    share ``share`` (a fraction) of all words; no document is taken more than ``passes`` times.

    keep: columns of ``docs`` in ``row`` (doc_id only, if not given); they may have any names. Null texts have no words, null sources are one
    source. Repeated rows and equal ids are ordered by id, then text hash; rows that agree in both are alike,
    so which of them comes first does not matter. An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    narrow = docs.select(
        F.struct(*keep).alias("row"), F.col("doc_id").alias("id"), F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), shuffle_key(seed).alias("h"), F.xxhash64("text").alias("h2"),
    )
    narrow = common.written(narrow, "mix")
    n = narrow.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / RANGE_ROWS)))
    narrow = narrow.withColumn("range", F.shiftright("h", 63 - bits))
    source = ["no_source", "source_key"]
    ranges = common.written(narrow.groupBy(*source, "range").agg(F.sum("size").alias("range_size")), "ranges", n)
    sources = ranked(ranges.groupBy(*source).agg(F.sum("range_size").alias("source_size")))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", turn.cast("long"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = total * share[0] / share[1]
    sources = common.written(with_targets(sources, budget, passes), "targets", n)
    # Sums come first, of ranges, then of blocks of ranges; a hot source's rows are many small groups here, so no side is broadcast.
    ranges = ranges.withColumn("block", F.shiftright("range", BLOCK_BITS))
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranges.groupBy(*source, "block").agg(F.sum("range_size").alias("block_size")).withColumn("base", F.coalesce(F.sum("block_size").over(upto(source, "block")), F.lit(0)))
    blocks = blocks.join(sources.select(*source, "source_size", "target"), source).drop("block_size")
    before = F.coalesce(F.sum("range_size").over(upto([*source, "block"], "range")), F.lit(0))
    ranges = ranges.withColumn("before", before).join(blocks, [*source, "block"]).withColumn("before", F.col("before") + F.col("base")).drop("range_size", "block", "base")
    order = Window.partitionBy(*source, "range").orderBy("h", "id", "h2", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = narrow.join(ranges, [*source, "range"]).withColumn("until", F.col("before") + F.sum("size").over(order))
    finish = [F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("until") + p * F.col("source_size")) / F.col("target")) for p in range(passes)]
    queue = queue.select("row", "size", "source_size", "target", F.array(*finish).alias("finish"))
    # only sizes and times are sorted for the cut: the rows themselves may hold texts
    cut = budget_cut(queue.select("size", F.explode("finish").alias("f")).where("f is not null"), budget, passes * n)
    taken = F.aggregate("finish", F.lit(0).cast("long"), lambda n, f: n + F.when(f <= cut, F.col("size")).otherwise(0))
    out = queue.select("row", "size", "source_size", "target", taken.alias("taken"), "finish")
    return Mix(out, budget, cut)


def budget_cut(events: DataFrame, budget: float, n: int) -> float:
    """
    The finish time at which ``events`` (size, f; ``n`` at most), range-sorted by ``f``, are truncated: the largest up to which the sizes add up to at most
    ``budget``. Events with equal times are taken together. 0 if not even the first fits.
    """
    spent, last = 0, 0.0  # all events up to ``last`` fit, and add up to ``spent``
    while True:
        parts = min(PARTS, max(1, -(-n // PART_EVENTS)))
        queue = events.repartitionByRange(parts, "f").sortWithinPartitions("f").withColumn("part", F.spark_partition_id())
        queue = common.written(queue, "queue")
        over = None
        sums = queue.groupBy("part").agg(F.sum("size").alias("size"), F.min("f").alias("first"), F.max("f").alias("last"), F.count("*").alias("n"))
        for part in sorted(sums.collect()):  # PARTS rows at most
            if spent + part["size"] > budget:
                over = part
                break
            spent, last = spent + part["size"], part["last"]
        if over is None or over["first"] == over["last"]:
            return last
        events, stuck = queue.where(F.col("part") == over["part"]).select("size", "f"), over["n"] == n  # a few times that many events share
        n = over["n"]
        if n <= 2 * PART_EVENTS or stuck:
            break
    times = events.groupBy("f").agg(F.sum("size").alias("size"))
    until = times.withColumn("until", F.sum("size").over(Window.orderBy("f")))  # 2 * PART_EVENTS rows at most
    fits = until.where(F.col("until") <= F.lit(float(budget - spent))).agg(F.max("f")).first()[0]
    return last if fits is None else fits


def in_order(mix: Mix, columns: list[str]) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, range-partitioned and sorted by finish time."""
    events = mix.docs.select("row", F.posexplode("finish").alias("pass", "at")).where(F.col("at") <= mix.cut)
    return events.repartitionByRange("at").sortWithinPartitions("at", "pass").select(*[F.col("row")[c].alias(c) for c in columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return fair_mix(docs).docs.select("row.doc_id", "size", "source_size", "target", "taken")
