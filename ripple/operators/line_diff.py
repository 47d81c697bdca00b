"""
Line comparison of many texts: lines are rows, grouped and ordered by windows, no row or task holds a text besides the row that it came in.

Lines that are unique on both sides of a segment are paired and are its candidates; of those the longest chain that ascends on both sides are its anchors, and the
gaps between anchors are the segments of the next round. Where no unique line is common, lines that occur equally often are paired in order, and where there are none,
the first occurrences. A segment without common lines is finished, and so is one whose sides are equal, so each round either matches a line of a segment or ends it.

Scale: a round deals its rows once, by a hash of their file, and each of its windows and groups keeps to that, in sorts that may spill; what comes back from Python are
the numbers of anchors, a row for each segment. The first round's lines are read from the texts, which are what is shuffled; a round keeps only lines of segments that are still
open and those found unmatched, as Parquet.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..shipping import ship
from .graph import written
from .intervals import line_runs

FILE = ["repo", "path"]
#: A segment: the hash of its file, by which rows are dealt, then what sorts should look at first. A repository's rows share its name.
DEALT = ["file", "segment", "path", "repo"]
#: Lines that a task should have, of both sides: callers that know how many there are ask for so many tasks.
TASK_LINES = 1 << 19


def _tasks(df: DataFrame, tasks: int | None) -> int:
    """At least those of a shuffle, which are not merged by their few bytes: the time goes by rows."""
    return max(tasks or 0, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    return df.where("repo is not null and path is not null").withColumn("file", F.xxhash64(*FILE)).repartition(tasks, "file")


def lines(pairs: DataFrame, tasks: int) -> DataFrame:
    """(file, repo, path, side, line, h): the lines of ``base`` (side 0) and ``text`` (1) from 1 and 128 bits of each, dealt by file. A null text has none."""
    side = lambda k, column: F.struct(F.lit(k).alias("side"), F.col(column).alias("text"))
    texts = _dealt(pairs.select(*FILE, "base", "text"), tasks).select("file", *FILE, F.explode(F.array(side(0, "base"), side(1, "text"))).alias("x"))
    # without outer, what is empty is looked for before, which splits each text again
    rows = texts.select("file", *FILE, "x.side", F.posexplode_outer(s.lines_of("x.text")).alias("at", "text")).where("at is not null")
    return rows.select("file", *FILE, "side", (F.col("at") + 1).alias("line"), F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("h"))


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` (new, base; ascending by new, no number twice on a side) that ascends by base too."""
    ends: list[int] = []  # least base that a chain of each length ends with
    last: list[int] = []  # its pair
    before: list[int] = []
    for i, (_, base) in enumerate(pairs):
        k = bisect_left(ends, base)
        ends[k : k + 1] = [base]
        last[k : k + 1] = [i]
        before.append(last[k - 1] if k else -1)
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _anchors(candidates: DataFrame, tasks: int | None = None) -> DataFrame:
    """
    (DEALT, at, base, new): the chain of each segment's candidates (..., rank, base, new) of least rank, its pairs numbered from 0, dealt by file. Candidates that tell no ``file`` are
    dealt before. Segments go to Python and back as rows of numbers, many to a batch.
    """

    @F.arrow_udf("array<struct<base:int,new:int>>")
    def chained(base: pa.Array, new: pa.Array) -> pa.Array:
        old, to, at, found, ends = base.flatten().to_numpy(), new.flatten().to_numpy(), 0, [np.zeros((0, 2), np.int32)], [0]
        for size in base.value_lengths().to_pylist():  # a segment's numbers at a time are Python's
            found.append(np.array(chain(list(zip(to[at : at + size].tolist(), old[at : at + size].tolist()))), np.int32).reshape(-1, 2))
            at += size
            ends.append(ends[-1] + len(found[-1]))
        numbers = np.concatenate(found)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(numbers[:, k]) for k in (1, 0)], ["base", "new"]))

    tasks = _tasks(candidates, tasks)
    if "file" not in candidates.columns:
        candidates = _dealt(candidates, tasks)
    pairs = candidates.groupBy(*DEALT).agg(F.array_sort(F.collect_list(F.struct("rank", "new", "base"))).alias("x"))
    least = pairs.select(*DEALT, F.filter("x", lambda y: y["rank"] == F.col("x")[0]["rank"]).alias("x"))
    found = ship(least).select(*DEALT, chained(F.col("x.base"), F.col("x.new")).alias("found"))
    # a chain has a pair; posexplode() would look for empty ones, which calls the function twice
    dealt = found.repartition(tasks, "file").select(*DEALT, F.posexplode_outer("found").alias("at", "pair"))
    return dealt.select(*DEALT, "at", "pair.base", "pair.new")


def _candidates(rows: DataFrame) -> DataFrame:
    """(DEALT, rank, base, new): the equal lines of both sides of a segment, paired in order."""
    same = [*DEALT, "h"]
    nth = F.row_number().over(Window.partitionBy(*same, "side").orderBy("line"))
    counts = Window.partitionBy(*same)
    rows = rows.withColumn("nth", nth).withColumn("n", F.sum("side").over(counts)).withColumn("b", F.count("*").over(counts) - F.col("n"))
    rank = F.when((F.col("b") == 1) & (F.col("n") == 1), 0).when(F.col("b") == F.col("n"), 1).otherwise(2)
    rows = rows.where("b > 0 and n > 0 and nth <= b and nth <= n").withColumn("rank", rank)
    number = lambda k: F.max(F.when(F.col("side") == k, F.col("line")))
    return rows.groupBy(*same, "nth", "rank").agg(number(0).alias("base"), number(1).alias("new")).select(*DEALT, "rank", "base", "new")


def _left(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """
    The lines that are not matched or may still be: ``rows`` without anchors, each in its gap as segment. ``open``: its gap has both sides, which are not equal; the others are
    new and unmatched.
    """
    # a gap is named by the anchor before it: its number on the new side is the same for no other gap of the file. The first keeps the segment's name, by marks before all lines
    mark = lambda k, line, gap: F.struct(F.lit(k).alias("side"), line.alias("line"), gap.alias("gap"))
    both = F.array(mark(0, F.col("base"), F.col("new")), mark(1, F.col("new"), F.col("new")))
    start = F.array(*[mark(k, F.lit(0), F.col("segment")) for k in (0, 1)])
    marks = anchors.select(*DEALT, F.inline(F.when(F.col("at") == 0, F.concat(start, both)).otherwise(both)))
    left = rows.withColumn("gap", F.lit(None).cast("int")).unionByName(marks.withColumn("h", F.lit(None).cast("binary")))
    so_far = Window.partitionBy(*DEALT, "side").orderBy("line")  # the range of equal lines: a line and its mark
    is_mark = F.col("gap").isNotNull()
    left = left.withColumns({"mark": F.max(F.when(is_mark, F.col("line"))).over(so_far), "first": F.min(F.when(~is_mark, F.col("line"))).over(so_far), "in": F.max("gap").over(so_far)})
    left = left.where("gap is null and (mark is null or mark < line)")
    # lines without marks are of a segment without common lines; ``nth``: a line's place in its gap
    left = left.select("file", *FILE, F.coalesce("in", "segment").alias("segment"), "side", "line", "h", F.col("in").isNotNull().alias("hit"), (F.col("line") - F.greatest("mark", F.col("first") - 1)).alias("nth"))
    # sides are equal if as many lines are on both, and each of side 1 has an equal one in its place
    gap = Window.partitionBy(*DEALT)
    place = gap.orderBy("nth", "side")
    same = (F.lag("side").over(place) == 0) & (F.lag("nth").over(place) == F.col("nth")) & (F.lag("h").over(place) == F.col("h"))
    left = left.withColumn("same", F.when(F.col("side") == 1, F.coalesce(same, F.lit(False))))
    left = left.withColumns({"n": F.sum("side").over(gap), "all": F.count("*").over(gap), "equal": F.min("same").over(gap)})
    equal = F.col("hit") & F.col("equal") & (2 * F.col("n") == F.col("all"))
    # a gap with one side only has nothing to compare
    left = left.where(~F.coalesce(equal, F.lit(False))).withColumn("open", F.col("hit") & F.col("n").between(1, F.col("all") - 1)).where("open or side = 1")
    return left.select(*FILE, "segment", "side", "line", F.when(F.col("open"), F.col("h")).alias("h"), "open")


def unmatched(rows: DataFrame, tasks: int) -> DataFrame:
    """
    (repo, path, line): of ``lines`` those of side 1 that the comparison with side 0 finds inserted or replaced. Paths that only one side has are all
    new, or have no such line. Line numbers are unique on a side and ascend; rows with null keys are left out.
    """
    rows = rows.withColumn("segment", F.lit(0))
    done: list[DataFrame] = []
    while True:
        left = written(_left(rows, _anchors(_candidates(rows), tasks)), "lines")
        done.append(left.where("not open").select(*FILE, "line"))
        open_ = left.where("open").drop("open")
        n = open_.count()
        if not n:
            return _union(done)
        tasks = _tasks(open_, n // TASK_LINES)
        rows = _dealt(open_, tasks)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def text_spans(pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """
    pairs: repo, path, base, text -> spans (repo, path, start, stop) of the lines of ``text`` that are inserted or replaced, merged where they touch. ``tasks``: if
    more than those of a shuffle are wanted.
    """
    tasks = _tasks(pairs, tasks)
    return line_runs(unmatched(lines(pairs, tasks), tasks)).select(*FILE, "start", "stop")
