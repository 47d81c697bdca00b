"""Line intervals (1-based, inclusive) per (repo, path): merging, runs, definition bodies, overlaps, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EOF_LINE

KEY = ["repo", "path"]


def coalesce_spans(spans: DataFrame) -> DataFrame:
    """Merges spans that overlap or touch (start <= last stop + 1). Spans with stop < start are dropped."""
    order = Window.partitionBy(*KEY).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("stop >= start").withColumn("new", (reach.isNull() | (F.col("start") > reach + 1)).cast("int"))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*KEY, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def line_runs(lines: DataFrame) -> DataFrame:
    """(repo, path, line) -> maximal runs of consecutive lines: start, stop, n_lines."""
    order = Window.partitionBy(*KEY).orderBy("line")
    islands = lines.select(*KEY, "line").distinct().withColumn("island", F.col("line") - F.row_number().over(order))
    return islands.groupBy(*KEY, "island").agg(F.min("line").alias("start"), F.max("line").alias("stop"), F.count("*").alias("n_lines")).drop("island")


def span_lines(spans: DataFrame) -> DataFrame:
    """Every line of the spans, once."""
    return spans.where("stop >= start").select(*KEY, F.explode(F.sequence("start", "stop")).alias("line")).distinct()


def changed_line_count(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of span lengths; spans that end before they start count nothing."""
    size = F.when(F.col("stop") >= F.col("start"), F.col("stop") - F.col("start") + 1).otherwise(0)
    return spans.groupBy(*(by or [])).agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("n_lines"))


def body_spans(definitions: DataFrame, order_by: str = "ordinal") -> DataFrame:
    """Adds start and stop: from a definition's line to the line before the next definition (to the end for the last)."""
    order = Window.partitionBy(*KEY).orderBy("line", order_by)
    return definitions.withColumns({"start": F.col("line"), "stop": F.lead("line", 1, EOF_LINE + 1).over(order) - 1})


def changed_symbols(definitions: DataFrame, spans: DataFrame) -> DataFrame:
    """Definitions whose body overlaps a changed span, with changed_lines (sorted, distinct). The range test is a residual of the equi-join on (repo, path)."""
    bodies = body_spans(definitions)
    s = coalesce_spans(spans).select(*KEY, F.col("start").alias("s0"), F.col("stop").alias("s1"))
    hit = bodies.join(s, KEY).where((F.col("s0") <= F.col("stop")) & (F.col("s1") >= F.col("start")))
    touched = F.explode(F.sequence(F.greatest("start", "s0"), F.least("stop", "s1")))
    keys = [*KEY, "ordinal", "name", "kind", "line"]
    return hit.select(*keys, touched.alias("changed")).groupBy(*keys).agg(F.array_sort(F.collect_set("changed")).alias("changed_lines"))


def orphan_runs(definitions: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs of changed lines in no definition's body. Bodies tile the file, so these lie before its first definition."""
    first = definitions.groupBy(*KEY).agg(F.min("line").alias("first_line"))
    outside = span_lines(spans).join(first, KEY, "left").where(F.col("first_line").isNull() | (F.col("line") < F.col("first_line")))
    return line_runs(outside)


def next_to(lines: DataFrame, wanted: DataFrame, reach: int = 12) -> DataFrame:
    """
    For each wanted line the nearest that is not blank: itself, else up to ``reach`` lines after, else before, else itself. lines: repo,
    path, line, text. Two range frames over each file's lines find both neighbours in one pass.
    """
    order = Window.partitionBy(*KEY).orderBy("line")
    full = F.when(F.trim("text") != "", F.col("line"))
    after, before = F.min(full).over(order.rangeBetween(0, reach)), F.max(full).over(order.rangeBetween(-reach, -1))
    near = lines.select(*KEY, "line", F.coalesce(after, before).alias("code_line"))
    return wanted.join(near, [*KEY, "line"], "left").withColumn("code_line", F.coalesce("code_line", "line"))
