"""Per-line annotations of a report, as an editor shows them; titles, anchors, and an HTML page."""

from __future__ import annotations

import html as html_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.predicates import col
from ..functions.scalars import collapse, risk_emoji
from ..operators import intervals

KEY = ["repo", "path"]
ANCHORS = 6


def strip_markdown(text: Column | str) -> Column:
    """Without code ticks, emphasis and link targets; one line."""
    x = F.regexp_replace(col(text), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return collapse(F.regexp_replace(x, r"[`*_]{1,3}(?=\S)|(?<=\S)[`*_]{1,3}", ""))


def title(detail: Column | str, implication: Column | str) -> Column:
    """The risk line first, then what the edit does."""
    return F.concat_ws(" · ", *[F.when(strip_markdown(x) != "", strip_markdown(x)) for x in (implication, detail)])


def annotations(symbols: DataFrame, orphans: DataFrame, seeds: DataFrame, impact: DataFrame, tasks: int | None = None) -> DataFrame:
    """
    (repo, path, line, kind, text): one annotation for each line, chosen by so many ``tasks`` (the session's shuffle partitions if none are given). Symbols (repo, path, line, detail) and orphan lines come before what is said of the whole
    file on its first line: a changed file before a danger zone before one that is only downstream (impact: repo, path, hops, is_danger, reason).
    """
    part = lambda df, rank, kind, line, text: df.select(*KEY, line.cast("int").alias("line"), F.lit(rank).alias("rank"), kind.alias("kind"), text.alias("text"))
    first = F.lit(1)
    every = part(symbols, 0, F.lit("symbol"), F.col("line"), F.col("detail")).unionByName(part(orphans, 1, F.lit("line"), F.col("line"), F.col("detail")))
    every = every.unionByName(part(seeds, 2, F.lit("seed"), first, F.lit("You changed this file.")))
    every = every.unionByName(part(impact.where("is_danger"), 3, F.lit("danger"), first, F.col("reason"))).unionByName(part(impact.where("not is_danger"), 4, F.lit("downstream"), first, F.col("reason")))
    best = F.min_by(F.struct("kind", "text"), F.struct("rank", "text")).alias("best")
    every, on = every.where("text != ''"), ["path", "line", "repo"]
    every = every.repartition(tasks, *on) if tasks else every.repartition(*on)  # rows of a line are few: aggregating before the shuffle would sort all of a task's rows for little
    return every.groupBy(*on).agg(best).select(*KEY, "line", "best.*")


def anchors(lines: DataFrame, most: int = ANCHORS) -> DataFrame:
    """First lines of the first runs of changed lines of each file."""
    order = Window.partitionBy(*KEY).orderBy("start")
    return intervals.line_runs(lines).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def touched(spans: DataFrame, tiers: DataFrame) -> DataFrame:
    """(repo, path, line, risk_tier): each changed line once; tiers: repo, risk_tier."""
    return intervals.span_lines(spans).join(tiers, "repo")


def proofs(impact: DataFrame) -> DataFrame:
    """Import proofs that can be opened: with a path and a line."""
    return impact.select(*KEY, F.posexplode("import_evidence").alias("nth", "x")).select("repo", F.col("path").alias("file"), "nth", "x.*").where("path != '' AND line > 0")


def tier_icon(tier: Column | str) -> Column:
    return risk_emoji(tier)


def page(report: dict) -> str:
    """The report as an HTML page; all its texts are escaped."""
    e = lambda x: html_.escape(str(x or ""))
    rows = lambda items, f: "".join(f"<li>{f(x)}</li>" for x in items) or "<li>none</li>"
    node = lambda n: f"<code>{e(n['path'])}</code> {e(n['reason'])}"
    symbols = rows(report["changed_symbols"][: rules.REPORT_SYMBOLS], lambda x: f"<code>{e(x['path'])}</code> <b>{e(x['name'])}</b> {e(x['detail'])}")
    body = f"<h1>Change impact</h1><p>{e(report['summary'])}</p><h2>Your changes</h2><ul>{symbols}</ul><h2>Danger zones</h2><ul>{rows(report['danger_zones'], node)}</ul><h2>Also affected</h2><ul>{rows(report['downstream'], node)}</ul>"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Change impact</title></head><body>{body}<pre class='mermaid'>{e(report['mermaid'])}</pre></body></html>"
