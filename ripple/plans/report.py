"""
Reports: tables of many repositories' reports, with Markdown and diagrams made by Spark from rows that are cut by rank before they meet; one
report as a dict, with Markdown and JSON made from it, for a command that answers for one repository.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import rules
from ..functions import scalars as s
from ..operators import graph, topk

MARKER = "<!-- ripple-report -->"

# The texts of the format.
TITLE, CHANGES, IMPACT, BLAST = "## Change impact", "### Your changes", "### Architecture impact", "### Blast radius"
LEGEND = "Legend: each box is a **file**; an arrow means **change flows to** (that file imports / depends on the previous one)."
DANGER = "🔴 **Danger Zones** *(risky if wrong — shared or API/schema/config)*"
AFFECTED = "🟡 **Also affected** *(these files depend on what you changed)*"
QUIET = "🟢 **Not pulled in** *(no dependents found for this change)*"
NONE, MORE, MORE_SYMBOLS = "- (none for this change)", "- …and {} more", "- …and {} more changed symbols (see the JSON report)"


@dataclass
class Reports:
    """
    Reports of many repositories. heads: repo, mode, seed, summary, risk_tier, mermaid, a row for each. The rows of the others have no bound and stay apart:
    nodes (danger zones and files downstream; changed danger zones have hops 0): repo, path, hops, is_danger, reason, import_evidence; isolated: repo,
    path; symbols and lines as the engine explains them. ``reports[repo]`` brings one repository's report to the driver.
    """

    heads: DataFrame
    nodes: DataFrame
    isolated: DataFrame | None = None
    symbols: DataFrame | None = None
    lines: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def __enter__(self) -> Reports:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()

    def get(self, repo: str) -> dict | None:
        mine = F.col("repo") == repo
        head = self.heads.where(mine).first()
        if head is None:
            return None
        nodes = [r.asDict(True) for r in self.nodes.where(mine).select("path", "hops", "reason", "import_evidence", "is_danger").orderBy(*node_order()).collect()]
        danger, down = ([{k: v for k, v in n.items() if k != "is_danger"} for n in nodes if n["is_danger"] is side] for side in (True, False))
        isolated = [r["path"] for r in self.isolated.where(mine).orderBy(F.split("path", "/")).collect()] if self.isolated is not None else []
        lines = [r.asDict() for r in self.lines.where(mine).drop("repo").orderBy("path", "changed_lines").collect()] if self.lines is not None else []
        symbols = symbol_rows(self.symbols.where(mine)) if self.symbols is not None else []
        head = head.asDict()
        return nothing(head["seed"], head["summary"]) | {k: head[k] for k in ("mode", "risk_tier", "mermaid")} | {"danger_zones": danger, "downstream": down, "isolated": isolated, "changed_symbols": symbols, "line_explanations": lines}

    def __getitem__(self, repo: str) -> dict:
        got = self.get(repo)
        if got is None:
            raise KeyError(repo)
        return got


def nothing(seed: str, summary: str) -> dict:
    """A report that has nothing to show."""
    return {"mode": "pass_through", "seed": seed, "summary": summary, "risk_tier": "LOW", "mermaid": None, "danger_zones": [], "downstream": [], "isolated": [], "changed_symbols": [], "line_explanations": [], "caveat": None}


def symbol_rows(symbols: DataFrame) -> list[dict]:
    """One repository's explained symbols."""
    return [r.asDict(True) for r in symbols.orderBy("path", "line", "name").drop("repo").collect()]


def node_order() -> list[Column]:
    """Changed danger zones first, from the last path to the first, then by distance and path."""
    return [F.col("hops").asc(), F.when(F.col("hops") == 0, F.split("path", "/")).desc(), F.col("path").asc()]


def change_sets(changed: DataFrame) -> DataFrame:
    """repo, first (five changed paths), sources (all changed source files, in order: a title names them all)."""
    source = F.collect_list(F.when(p.is_source_path("path"), F.col("path")))
    first = changed.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).where("nth <= 5")
    return changed.groupBy("repo").agg(F.array_sort(source).alias("sources")).join(first.groupBy("repo").agg(F.array_sort(F.collect_list("path")).alias("first")), "repo")


def titles(seeds: DataFrame) -> DataFrame:
    """repo, seeds: the paths by folders."""
    return seeds.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.split("path", "/").alias("parts"), "path"))), lambda x: x["path"]).alias("seeds"))


def first_zones(nodes: DataFrame) -> DataFrame:
    """repo, zones: the first three danger zones."""
    first = nodes.where("is_danger").withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy(*node_order()))).where("nth <= 3")
    return first.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("zones"))


def full_summary(verb: str, seed: Column, tier: Column) -> Column:
    """Of columns n, hops and zones."""
    c, lit = F.col, F.lit
    zones = F.concat(lit(" Danger Zones: "), F.array_join(F.transform("zones", lambda x: F.concat(lit("`"), x, lit("`"))), ", "), lit("."))
    counted = lambda x, one: F.concat(c(x).cast("string"), F.when(c(x) == 1, f" {one}").otherwise(f" {one}s"))
    files = F.concat(c("n").cast("string"), lit(" downstream "), F.when(c("n") == 1, "file").otherwise("files"))
    return F.concat(lit(f"{verb} `"), seed, lit("`. **"), tier, lit("** risk — "), files, lit(", up to "), counted("hops", "hop"), lit(" away."), F.coalesce(zones, lit("")))


def markdowns(reports: Reports) -> DataFrame:
    """
    (repo, text): what ``markdown`` says of each report. Symbols, files downstream and isolated files are cut by rank before they are shuffled; the format
    lists every danger zone, so that part of a text is as long as a repository has danger zones.
    """
    c, lit = F.col, F.lit

    def section(rows: DataFrame, line: Column, order: list, most: int | None, more: str, name: str) -> DataFrame:
        if most is None:
            cut = rows.withColumns({"nth": F.row_number().over(Window.partitionBy("repo").orderBy(*order)), "n_more": lit(0)})
        else:
            cut = topk.top_with_overflow(rows, ["repo"], order, most)
        shown = cut.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("x"), F.max("n_more").alias("n_more"))
        before, after = more.split("{}")
        rest = F.when(c("n_more") > 0, F.concat(lit("\n" + before), c("n_more").cast("string"), lit(after))).otherwise("")
        return shown.select("repo", F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), rest).alias(name))

    zones = reports.nodes.where("is_danger")
    marked = reports.symbols.join(zones.select("repo", "path", lit(True).alias("is_danger")).distinct(), ["repo", "path"], "left").na.fill({"is_danger": False})
    said = F.coalesce(*[F.when(s.clip_bullet(x) != "", F.concat(lit(" — "), s.clip_bullet(x))) for x in ("detail", "summary", "explanation")], lit(""))
    symbol = F.concat(lit("- `"), "path", lit("` → **`"), "name", lit("`** ("), "kind", lit(", line "), c("line").cast("string"), lit(")"), said)
    node = F.concat(lit("- `"), "path", lit("` — "), "reason")
    parts = [
        section(marked, symbol, topk.symbol_order(), rules.REPORT_SYMBOLS, MORE_SYMBOLS, "changes"), section(zones, node, node_order(), None, MORE, "danger"),
        section(reports.nodes.where("not is_danger"), node, node_order(), rules.REPORT_BULLETS, MORE, "affected"),
        section(reports.isolated, F.concat(lit("- `"), "path", lit("`")), [F.split("path", "/")], rules.REPORT_BULLETS, MORE, "quiet"),
    ]
    rows = reports.heads
    for part in parts:
        rows = rows.join(part, "repo", "left")
    changes = F.when(c("changes").isNotNull(), F.concat(lit(f"{CHANGES}\n\n"), "changes", lit("\n\n"))).otherwise("")
    listed = lambda head, name: F.concat(lit(head + "\n"), F.coalesce(name, lit(NONE)))
    full = F.concat(
        lit(f"{TITLE}\n\n"), "summary", lit("\n\n"), changes, lit(f"{IMPACT}\n\n{LEGEND}\n\n```mermaid\n"), F.coalesce("mermaid", lit("")), lit(f"\n```\n\n{BLAST}\n\n"),
        listed(DANGER, "danger"), lit("\n\n"), listed(AFFECTED, "affected"), lit("\n\n"), listed(QUIET, "quiet"),
    )
    return rows.select("repo", F.when(c("mode") == "full", full).otherwise(c("summary")).alias("text"))


def diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """
    (repo, mermaid): a flowchart of seeds (hops 0) and rings, at most 15 nodes beyond the seeds, grouped by top folder; arrows go from a
    file to its importers. Identifiers that two paths share get a number, so each names one file.
    """
    chosen = topk.select_nodes(nodes).select("repo", "path", "hops")
    twin = Window.partitionBy("repo", s.node_id("path")).orderBy("path")
    named = chosen.withColumn("nth", F.row_number().over(twin)).withColumn("id", F.concat(s.node_id("path"), F.when(F.col("nth") > 1, F.concat(F.lit("_"), F.col("nth").cast("string"))).otherwise("")))
    named = named.withColumn("layer", s.layer("path"))
    node = F.concat(F.lit("    "), F.col("id"), F.lit('["'), F.col("path"), F.lit('"]'), F.when(F.col("hops") == 0, ":::seed").otherwise(""))
    groups = named.groupBy("repo", "layer").agg(F.array_sort(F.collect_list(F.struct("path", node.alias("text")))).alias("n"))
    block = F.concat(F.lit("  subgraph "), s.safe_id("layer"), F.lit('["'), s.layer_label("layer"), F.lit('"]\n'), F.array_join(F.transform("n", lambda x: x["text"]), "\n"), F.lit("\n  end"))
    blocks = groups.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("layer", block.alias("text")))).alias("b"))
    drawn = graph.induced_edges(edges, chosen)
    a, b = named.select("repo", F.col("path").alias("origin"), F.col("id").alias("from")), named.select("repo", F.col("path").alias("target"), F.col("id").alias("to"))
    lines = drawn.join(a, ["repo", "origin"]).join(b, ["repo", "target"]).withColumn("text", F.concat(F.lit("  "), F.col("from"), F.lit(" --> "), F.col("to")))
    arrows = lines.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("origin", "target", "text"))), lambda x: x["text"]).alias("e"))
    text = F.array_join(F.concat(F.array(F.lit("flowchart TD")), F.transform("b", lambda x: x["text"]), F.coalesce("e", F.array().cast("array<string>")), F.array(F.lit("  classDef seed stroke-width:3px"))), "\n")
    return blocks.join(arrows, "repo", "left").select("repo", text.alias("mermaid"))


def capped(lines: list[str], most: int | None, more: str = MORE) -> list[str]:
    if not lines:
        return [NONE]
    return lines if most is None or len(lines) <= most else [*lines[:most], more.format(len(lines) - most)]


def bullet(text: str) -> str:
    plain = " ".join(text.split())
    return plain if len(plain) <= rules.BULLET_CHARS else plain[: rules.BULLET_CHARS - 1].rstrip() + "…"


def symbol_bullet(x: dict) -> str:
    said = next((t for k in ("detail", "summary", "explanation") if (t := (x.get(k) or "").strip())), "")
    return f"- `{x['path']}` → **`{x['name']}`** ({x['kind']}, line {x['line']})" + (f" — {bullet(said)}" if said else "")


def markdown(report: dict) -> str:
    if report["mode"] == "pass_through":
        return report["summary"]
    danger = {n["path"] for n in report["danger_zones"]}
    symbols = sorted(report["changed_symbols"], key=lambda x: (x["path"] not in danger, x["name"].startswith("_"), x["path"], x["name"]))
    node = lambda n: f"- `{n['path']}` — {n['reason']}"
    parts = [TITLE, "", report["summary"], ""]
    if symbols:
        parts += [CHANGES, "", *capped([symbol_bullet(x) for x in symbols], rules.REPORT_SYMBOLS, MORE_SYMBOLS), ""]
    parts += [IMPACT, "", LEGEND, "", "```mermaid", report["mermaid"] or "", "```", "", BLAST, ""]
    parts += [DANGER, *capped([node(n) for n in report["danger_zones"]], None), ""]
    parts += [AFFECTED, *capped([node(n) for n in report["downstream"]], rules.REPORT_BULLETS), ""]
    parts += [QUIET, *capped([f"- `{x}`" for x in report["isolated"]], rules.REPORT_BULLETS)]
    return "\n".join(parts + (["", report["caveat"]] if report.get("caveat") else []))


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def explanations(items: list[dict], why: bool, form: str = "markdown") -> str:
    """Explanations of symbols; with ``why`` the evidence of each clause, grouped by confidence."""
    if form == "json":
        return json.dumps([x if why else {k: v for k, v in x.items() if k != "clauses"} for x in items], indent=2, ensure_ascii=False)
    out = []
    for x in items:
        out += [f"### `{x['name']}` — {x['path']}:{x['line']}", "", x["text"], ""]
        for c in x.get("clauses", []) if why else []:
            for level in ("proven", "heuristic"):
                some = [e for e in c["evidence"] if e["confidence"] == level]
                if some:
                    out += [f"**{c['role'].capitalize()} — {level}**", *[f"- {e['fact']} ({e['location']})" for e in some], ""]
    return "\n".join(out).rstrip() + "\n" if out else ""


def pull_request_comment(text: str) -> str:
    """The report with a marker by which a later one finds and replaces it; adding it twice changes nothing."""
    return text if text.startswith(MARKER) else f"{MARKER}\n{text}\n\n---\n*Import facts only; no code was run.*"


def upsert_comment(client, text: str) -> str:
    """client: list() -> [{id, body}], create(body), update(id, body). Updates the oldest comment with the marker, else makes one."""
    body, found = pull_request_comment(text), marked_comments(client)
    if found:
        client.update(found[0], body)
        return "updated"
    client.create(body)
    return "created"


def marked_comments(client) -> list[int]:
    """Ids of the comments with the marker, the oldest first."""
    return sorted(c["id"] for c in client.list() if MARKER in c["body"])


def keep_oldest(client) -> int:
    """Deletes all comments with the marker but the oldest, as attempts side by side may each have made one. Every attempt keeps the same one."""
    late = marked_comments(client)[1:]
    for comment in late:
        client.delete(comment)
    return len(late)
