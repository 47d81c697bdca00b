"""
The engine: scan, trace, audit and explain over files, or over tables of facts.

Everything up to the reports, and these too, is one set of DataFrames with the repository in every key: each repository's branch is a column. Only
``trace``, ``audit`` and ``explain``, which answer for one repository, bring that one's rows to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import rules
from ..functions import scalars as s
from ..operators import graph, intervals, resolve, scoring, uses
from ..sources import facts as facts_
from . import blocks, captions, report

KEY = ["repo", "path"]


@dataclass
class Tables:
    """Facts of one or more repositories."""

    files: DataFrame
    imports: DataFrame
    definitions: DataFrame
    calls: DataFrame
    edges: DataFrame
    contents: DataFrame = field(default=None)
    facts: DataFrame = field(default=None)

    @classmethod
    def of(cls, files: DataFrame, cache: str | None = None) -> Tables:
        # dealt by file: the files of one input split, or of one content, would else stay in one task
        tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        facts = facts_.facts_of(files, cache).repartition(tasks, "path", "repo").persist()
        imports, definitions, calls = facts_.tables(facts)
        names = facts.select("repo", "path", "language")
        edges = resolve.build_edges(resolve.resolve_imports(imports, names)).persist()
        return cls(names, imports, definitions, calls, edges, files, facts)


class Engine:
    def __init__(self, spark: SparkSession, tables: Tables, fan_out: int = rules.FAN_OUT):
        self.spark, self.t, self.fan_out = spark, tables, fan_out

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str, fan_out: int | None = None, cache: str | None = None, git: bool = False) -> Engine:
        """A folder that all executors can read, as the repository ``r``; with ``git`` what git ignores is left out. ``Tables.of`` takes many repositories."""
        from ..sources import config, git as git_

        raw = git_.read(spark, root).withColumn("repo", F.lit("r")) if git else None
        files = facts_.from_contents(raw) if git else facts_.read_files(spark, root)
        return cls(spark, Tables.of(files, cache), fan_out if fan_out is not None else config.load(root).fan_out)

    def close(self) -> None:
        """Gives up the facts and edges that are kept for all reports."""
        for df in (self.t.edges, self.t.facts):
            if df is not None:
                df.unpersist()

    # scan

    def scan(self) -> DataFrame:
        """repo, path, n_imports, n_defs, n_calls of each file; null path: the repository's totals."""
        parts = [t.groupBy(*KEY).agg(F.count("*").alias(n)) for t, n in ((self.t.imports, "n_imports"), (self.t.definitions, "n_defs"), (self.t.calls, "n_calls"))]
        out = self.t.files.select(*KEY)
        for x in parts:
            out = out.join(x, KEY, "left")
        names = ("n_imports", "n_defs", "n_calls")
        return out.na.fill(0, list(names)).groupBy("repo", "path").agg(*[F.sum(n).alias(n) for n in names]).rollup("repo", "path").agg(*[F.sum(n).alias(n) for n in names]).where("repo is not null")

    # trace

    def trace(self, path: str, repo: str = "r") -> dict:
        """The report of one file: who depends on it, through how many steps."""
        seeds = self._paths([path], repo)
        if self.t.files.join(seeds, KEY, "left_semi").isEmpty():
            raise ValueError(f"{path} is not a scanned file of {repo}")
        rings = graph.rings(self.t.edges, seeds)
        impact = scoring.classify(rings, self.t.edges, seeds, self.fan_out).persist()
        sized = seeds.select("repo", F.col("path").alias("seed")).join(self._sizes(impact), "repo", "left")
        all_ = sized.join(report.first_zones(impact), "repo", "left").join(self._diagrams(seeds, rings), "repo", "left").withColumn("full", F.col("n").isNotNull())
        tier = scoring.risk_tier(F.col("n"), F.col("hops"), F.col("n_danger"))
        text = F.when(F.col("full"), report.full_summary("Traced", F.col("seed"), tier)).otherwise(F.concat(F.lit("No files depend on `"), F.col("seed"), F.lit("`.")))
        with report.Reports(self._heads(all_, text, tier), impact, kept=[impact]) as got:
            return got[repo]

    # audit

    def audit(self, changed: DataFrame, spans: DataFrame, overlays: bool = False, repo: str = "r") -> dict:
        """The report of one repository's change set; see ``audits``."""
        mine = F.col("repo") == repo
        return self.audits(changed.where(mine), spans.where(mine), overlays).get(repo) or report.nothing("(none)", "No changed files.")

    def audits(self, changed: DataFrame, spans: DataFrame, overlays: bool = False) -> report.Reports:
        """
        The reports of many repositories' change sets as tables with the repository in every key, from one pass over all of them; none of their rows comes
        to the driver. changed: repo, path of all changed files; spans: changed lines of source files, a deletion as a span that ends before it starts.
        Branches, for each repository: no source changed; only comments or blank lines; no scanned file; no diagram due; full. Repositories
        without changed files have no report.
        """
        # plans are cut where a table is read more than once: each report's table has a short plan, and a lost executor costs one step
        kept, changed = graph.cut_lineage, changed.select(*KEY).distinct()
        c = F.col
        sources = changed.where(p.is_source_path("path"))
        with_source = sources.select("repo").distinct()
        spans = spans.join(with_source, "repo", "left_semi")
        loud = kept(with_source if overlays else self._loud(spans))
        spans = kept(spans.join(loud, "repo", "left_semi"))
        seeds = kept(self.t.files.join(sources.join(loud, "repo", "left_semi"), KEY, "left_semi").select(*KEY))
        ordered = seeds.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy(F.split("path", "/"))) - 1)
        symbols = kept(intervals.changed_symbols(self.t.definitions, spans).join(seeds.select("repo").distinct(), "repo", "left_semi"))
        users = kept(uses.symbol_users(symbols, self.t.edges, self.t.imports, self.t.calls))
        rings = graph.rings(self.t.edges, seeds)
        with_symbols = symbols.select("repo").distinct()
        filtered = graph.filter_rings(rings.join(with_symbols, "repo", "left_semi"), self.t.edges, uses.proven_importers(rings, users))
        rings = kept(filtered.unionByName(rings.join(with_symbols, "repo", "left_anti")))
        impact = kept(scoring.classify(rings, self.t.edges, ordered, self.fan_out))
        # what each repository's branch and risk depend on
        size = seeds.select("repo").distinct().join(self._sizes(impact), "repo", "left").join(intervals.changed_line_count(spans, ["repo"]), "repo", "left").na.fill(0)
        size = kept(size.select("repo", "n", "hops", "n_danger", "n_lines"))
        degrees = seeds.join(scoring.in_degree(self.t.edges), KEY, "left")
        asked = changed.join(size.select("repo", (c("n") > 0).alias("has_downstream"), c("n").alias("n_downstream"), "n_lines"), "repo")
        asked = asked.join(degrees.withColumn("is_seed", F.lit(True)), KEY, "left").na.fill({"is_seed": False, "in_degree": 0})
        emit = kept(scoring.trigger(asked).where("emit").select("repo"))
        own = degrees.join(emit, "repo", "left_semi").withColumn("in_degree", F.coalesce("in_degree", F.lit(0))).where(p.is_danger_zone("path", "in_degree", self.fan_out)).join(resolve.importers_of(self.t.edges), KEY, "left")
        importers = resolve.importers_or_none()
        reason = F.when(p.is_danger_path("path"), s.danger_reason("path", F.lit(0), importers)).otherwise(s.hub_reason(importers, changed=True))
        none = F.array().cast(impact.schema["import_evidence"].dataType)
        own = kept(own.select(*KEY, F.lit(0).alias("hops"), F.lit(True).alias("is_danger"), reason.alias("reason"), none.alias("import_evidence")))
        nodes = own.unionByName(impact.join(emit, "repo", "left_semi").drop("in_degree"))
        linked = resolve.edge_evidence(self.t.edges, ordered).join(rings.where("hops = 1").select("repo", c("path").alias("importer")), ["repo", "importer"], "left_semi").select("repo", c("seed").alias("path"))
        isolated = seeds.join(own.select(*KEY).unionByName(linked.join(emit, "repo", "left_semi")), KEY, "left_anti")
        # one row for each repository
        flag = lambda df, name: df.select("repo", F.lit(True).alias(name))
        base = report.change_sets(changed).join(flag(loud, "loud"), "repo", "left").join(report.titles(seeds), "repo", "left").join(size, "repo", "left").join(flag(emit, "full"), "repo", "left")
        base = base.join(own.groupBy("repo").agg(F.count("*").alias("n_own")), "repo", "left").na.fill(0, ["n_own"]).na.fill(False, ["loud", "full"])
        zones = c("n_danger") + c("n_own")
        least = lambda x: F.when(zones > 0, F.greatest(c(x), F.lit(1))).otherwise(c(x))
        base = kept(base.withColumn("tier", F.when(c("full"), scoring.risk_tier(least("n"), least("hops"), zones)).otherwise("LOW")))
        drawn = self._diagrams(seeds.join(emit, "repo", "left_semi"), rings)
        joined = lambda x: F.array_join(x, ", ")
        texts = [
            (F.size("sources") == 0, F.lit("(non-source)"), F.concat(F.lit("Only files that are not source changed: "), joined(F.transform("first", lambda x: F.concat(F.lit("`"), x, F.lit("`")))), F.lit("."))),
            (~c("loud"), joined("sources"), F.lit("Only comments or blank lines changed.")),
            (c("seeds").isNull(), F.lit("(unscanned)"), F.lit("No changed file is in the graph.")),
            (c("full"), joined("seeds"), report.full_summary("Changed", joined("seeds"), c("tier"))),
            ((c("n_lines") <= rules.TINY_LINES) & (c("n") > 0), joined("seeds"), F.lit("Tiny change with little downstream.")),
            (F.lit(True), joined("seeds"), F.lit("No downstream files use this change.")),
        ]
        seed, text = (F.coalesce(*[F.when(t[0], t[k]) for t in texts]) for k in (1, 2))
        whole = base.join(report.first_zones(nodes), "repo", "left").join(drawn, "repo", "left")
        heads = self._heads(whole.withColumns({"seed": seed, "text": text}), c("text"), c("tier"))
        explained = self._symbols(symbols, users, base.where("seeds is not null").select("repo", c("n").cast("int").alias("n_down"), "tier"), kept)
        return report.Reports(heads, nodes, isolated, explained, self._orphans(spans, kept))

    def explain(self, changed: DataFrame, spans: DataFrame, symbol: str | None = None, path: str | None = None, repo: str = "r") -> list[dict]:
        """Explanations of one repository's changed symbols with their evidence; the filters are applied before captions are made."""
        mine = F.col("repo") == repo
        symbols = intervals.changed_symbols(self.t.definitions, spans.where(mine))
        for column, wanted in (("name", symbol), ("path", path)):
            symbols = symbols if wanted is None else symbols.where(F.col(column) == wanted)
        symbols = symbols.persist()
        users = uses.symbol_users(symbols, self.t.edges, self.t.imports, self.t.calls).persist()
        seeds = self.t.files.join(changed.where(mine).select(*KEY).distinct(), KEY, "left_semi").select(*KEY)
        rings = scoring.with_danger(graph.rings(self.t.edges, seeds), self.t.edges, self.fan_out)
        total = rings.agg(F.count("*").alias("n"), F.coalesce(F.max("hops"), F.lit(0)).alias("hops"), F.count_if("is_danger").alias("z"))
        scale = total.select(F.lit(repo).alias("repo"), F.col("n").cast("int").alias("n_down"), scoring.risk_tier(F.col("n"), F.col("hops"), F.col("z")).alias("tier"))
        proofs: dict = {}
        for r in uses.user_evidence(users).orderBy("seed", "name", "path").collect():
            proofs.setdefault((r["seed"], r["name"]), []).extend(e.asDict() for e in r["evidence"])
        named = {(r["path"], r["name"]): r["rule"] for r in symbols.select("path", "name", captions.name_rule().alias("rule")).where("rule is not null").collect()}
        out = []
        made: list[DataFrame] = []
        for x in report.symbol_rows(self._symbols(symbols, users, scale, lambda df: made.append(df.persist()) or df)):
            at = x["path"], x["name"]
            shown = [{"confidence": "proven", "kind": "diff_overlap", "location": f"{x['path']}:{x['line']}", "fact": f"changed lines {', '.join(map(str, x['changed_lines']))}"}]
            if at in named and x["summary"]:
                shown.append({"confidence": "heuristic", "kind": "heuristic_name", "location": x["name"], "fact": named[at]})
            why = [{"role": "purpose", "text": x["summary"], "evidence": shown}]
            if x["explanation"]:
                why.append({"role": "impact", "text": x["explanation"], "evidence": proofs.get(at, [])})
            out.append(x | {"text": " ".join(filter(None, (x["summary"], x["explanation"])))[: rules.EXPLANATION_CHARS], "clauses": why})
        for df in (*made, users, symbols):
            df.unpersist()
        return out

    # parts

    def _paths(self, paths: list[str], repo: str) -> DataFrame:
        return self.spark.createDataFrame([(repo, x, k) for k, x in enumerate(paths)], "repo string, path string, ord int")

    @staticmethod
    def _sizes(impact: DataFrame) -> DataFrame:
        """repo, n, hops, n_danger of impact rows."""
        return impact.groupBy("repo").agg(F.count("*").alias("n"), F.max("hops").alias("hops"), F.count_if("is_danger").alias("n_danger"))

    @staticmethod
    def _heads(rows: DataFrame, text: Column, tier: Column) -> DataFrame:
        """rows: repo, full, seed, mermaid and what ``text`` and ``tier`` read."""
        full = F.col("full")
        return rows.select("repo", F.when(full, "full").otherwise("pass_through").alias("mode"), "seed", text.alias("summary"), F.when(full, tier).otherwise("LOW").alias("risk_tier"), F.when(full, F.col("mermaid")).alias("mermaid"))

    def _lines(self, spans: DataFrame) -> DataFrame:
        """repo, path, line, text of the files that have spans."""
        some = self.t.contents.join(spans.select(*KEY).distinct(), KEY, "left_semi")
        return some.select(*KEY, F.posexplode(s.lines_of(F.decode("content", "UTF-8"))).alias("n", "text")).select(*KEY, (F.col("n") + 1).alias("line"), "text")

    def _loud(self, spans: DataFrame) -> DataFrame:
        """Repositories in which a changed line is neither blank nor a comment, or a line was deleted, or no line is known."""
        touched = self._lines(spans).join(intervals.span_lines(spans), [*KEY, "line"], "left_semi").where(~p.is_comment_or_blank("text"))
        return spans.where("stop < start").select("repo").unionByName(touched.select("repo")).distinct()

    def _symbols(self, symbols: DataFrame, users: DataFrame, scale: DataFrame, kept=lambda df: df) -> DataFrame:
        """Explained symbols. scale: repo, n_down (files downstream), tier. ``kept`` may persist what is read twice."""
        key = [*KEY, "name", "kind", "line"]
        c = F.col
        docs = uses.definition_docstrings(symbols, self.t.definitions).join(scale, "repo")
        used = users.groupBy("repo", c("seed").alias("path"), "name", "kind").agg(F.array_sort(F.collect_set("path")).alias("users"))
        local = uses.same_file_callers(symbols, intervals.body_spans(self.t.definitions), self.t.calls)
        internal = uses.has_internal_calls(symbols, self.t.calls).select(*KEY, "name").distinct().withColumn("internal", F.lit(True))
        helps = facts_.command_helps(self.t.contents, symbols) if self.t.contents is not None else self.spark.createDataFrame([], "repo string, path string, name string, line int, help string")
        degree = scoring.in_degree(self.t.edges)
        rows = docs.join(used, [*KEY, "name", "kind"], "left").join(resolve.importers_of(self.t.edges), KEY, "left").join(local, [*KEY, "name"], "left").join(internal, [*KEY, "name"], "left").join(degree, KEY, "left").join(helps, [*KEY, "name", "line"], "left")
        none = F.array().cast("array<string>")
        rows = rows.withColumns({x: F.coalesce(x, none) for x in ("users", "callers")} | {"importers": resolve.importers_or_none(), "internal": F.coalesce("internal", F.lit(False)), "is_danger": p.is_danger_zone("path", "in_degree", self.fan_out)})
        clean = lambda text: captions.without_own_file(s.expand_acronyms(text), c("path"))
        rows = kept(rows.withColumns({
            "purpose": clean(captions.purpose(help_text=c("help"))), "impact": captions.impact(c("name"), c("kind"), c("path"), c("users"), c("importers"), c("internal"), c("is_danger"), c("n_down"), c("tier")),
            "implication": captions.implication(c("name"), c("path"), c("users"), c("callers"), c("is_danger"), c("n_down"), c("tier")),
        }))
        # edit blocks: runs of changed lines with their text and the call that each is about
        touched = symbols.select(*key, F.explode("changed_lines").alias("line_no"))
        text = self._lines(symbols).withColumnRenamed("line", "line_no")
        island = c("line_no") - F.row_number().over(Window.partitionBy(*key).orderBy("line_no"))
        parts = touched.withColumn("hunk", island).join(text, [*KEY, "line_no"])
        call = uses.primary_call(uses.calls_in_hunks(parts.select(*KEY, F.concat_ws(":", "name", "line", "hunk").alias("hunk"), c("name").alias("symbol"), c("line_no").alias("line")), self.t.calls))
        block = parts.groupBy(*key, "hunk").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x"))
        block = block.withColumn("tag", F.concat_ws(":", "name", "line", "hunk")).join(call.select(*KEY, c("hunk").alias("tag"), "callee"), [*KEY, "tag"], "left")
        item = F.struct(F.transform("x", lambda y: y["line_no"]).alias("lines"), F.transform("x", lambda y: y["text"]).alias("text"), c("callee").alias("call"))
        listed = block.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("blocks"))
        details = blocks.symbol_details(rows.select(*key, "purpose").join(listed, key))

        rows = rows.join(details, key, "left")
        hunks = F.coalesce("hunk_details", F.array().cast(details.schema["hunk_details"].dataType))
        only_blank = (F.size(hunks) > 0) & F.forall(hunks, lambda h: h["detail"].startswith("Added "))
        shown = {"confidence": F.lit("proven"), "kind": F.lit("diff_overlap"), "location": F.concat("path", F.lit(":"), "line"), "fact": F.concat(F.lit("changed lines "), F.array_join(c("changed_lines").cast("array<string>"), ", "))}
        overlap = F.array(F.struct(*[x.alias(n) for n, x in shown.items()]))
        return rows.select(
            *key, "changed_lines", F.when(c("tier") == "LOW", "").otherwise(F.substring("purpose", 1, rules.EXPLANATION_CHARS)).alias("summary"), F.coalesce(F.get(hunks, F.lit(0))["detail"], F.lit("")).alias("detail"),
            c("impact").alias("explanation"), F.when(only_blank, "").otherwise(c("implication")).alias("implication"), hunks.alias("hunk_details"), F.filter(overlap, lambda _: ~only_blank).alias("evidence"),
        )

    def _orphans(self, spans: DataFrame, kept=lambda df: df) -> DataFrame:
        """repo, path, line, changed_lines, detail: captions of changed lines outside a file's definitions."""
        run = [*KEY, "start", "stop"]
        runs = intervals.orphan_runs(self.t.definitions, spans).select(*run)
        text = self._lines(spans)
        numbered = runs.withColumn("line", F.explode(F.sequence("start", "stop")))  # a line number is a key, a range is none
        rows = numbered.join(text, [*KEY, "line"]).groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("x"))
        # the first assignment that each run overlaps, and who reads or imports it
        files = self.t.contents.join(runs.select(*KEY).distinct(), KEY, "left_semi")
        made = facts_.assignments(files).select(*KEY, "name", "rhs", F.col("start").alias("a"), F.col("stop").alias("b"))
        hit = runs.join(made, KEY).where((F.col("a") <= F.col("stop")) & (F.col("b") >= F.col("start"))).groupBy(*run).agg(F.min(F.struct("a", "name", "rhs")).alias("set")).select(*run, "set.name", "set.rhs")
        hit = kept(hit)
        names = hit.select(*KEY, "name").distinct()
        readers = facts_.readers(files, names).groupBy(*KEY, "name").agg(F.transform(F.array_sort(F.collect_set(F.struct("line", "reader"))), lambda x: x["reader"]).alias("readers"))
        asked = names.select("repo", F.col("path").alias("changed"), "name")
        importers = uses.importers_of_name(asked, self.t.imports).groupBy("repo", F.col("changed").alias("path"), "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("importers"))
        found = rows.join(hit, run, "left").join(readers, [*KEY, "name"], "left").join(importers, [*KEY, "name"], "left")

        return blocks.orphan_details(found)

    def _diagrams(self, seeds: DataFrame, rings: DataFrame) -> DataFrame:
        nodes = seeds.select(*KEY).withColumn("hops", F.lit(0)).unionByName(rings.join(seeds.select("repo").distinct(), "repo", "left_semi").select(*KEY, "hops"))
        return report.diagram(nodes, self.t.edges)
