"""Command line: python -m ripple.cli {version,scan,trace,audit,explain} ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import line_diff
from .plans import clients, report
from .plans.engine import Engine, Tables
from .sources import comments, facts, git, overlay


def session() -> SparkSession:
    return SparkSession.builder.appName("ripple").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ripple")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("scan", "trace", "audit", "explain"):
        one = sub.add_parser(name)
        if name == "trace":
            one.add_argument("file")
        one.add_argument("--path", default=".")
        one.add_argument("--cache")
        if name != "scan":
            one.add_argument("--out")
            one.add_argument("--format", choices=("markdown", "json"), default="markdown")
        if name in ("audit", "explain"):
            one.add_argument("--base", default="main")
            one.add_argument("--local", action="store_true")
            one.add_argument("--overlay-file")
        if name == "audit":
            one.add_argument("--comment", action="store_true", help="also make or replace the report's comment on the pull request of this workflow run")
        if name == "explain":
            one.add_argument("--symbol")
            one.add_argument("--file")
            one.add_argument("--why", action="store_true")
    a = parser.parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    try:
        return _run(a)
    except (git.GitError, ValueError) as e:
        print(f"ripple: {e}", file=sys.stderr)
        return 1


def _run(a) -> int:
    spark, root = session(), str(Path(a.path).resolve())
    if a.command == "scan":
        rows = Engine.from_folder(spark, root, cache=a.cache, git=True).scan().orderBy(F.col("path").asc_nulls_last()).collect()
        for r in rows:
            print(f"{r['path'] or 'total'}: {r['n_imports']} imports · {r['n_defs']} defs · {r['n_calls']} calls")
        return 0
    if a.command == "trace":
        file = Path(a.file)
        rel = file.resolve().relative_to(root).as_posix() if file.is_absolute() else file.as_posix()
        return _emit(a, Engine.from_folder(spark, root, cache=a.cache, git=True).trace(rel))
    mode = "local" if a.local else "range"
    git.require_repository(root)
    base = git.resolve_base(root, a.base)
    changed = git.read(spark, root, "changed", base, mode).select(F.lit("r").alias("repo"), "path").distinct()
    spans = git.read(spark, root, "spans", base, mode).withColumn("repo", F.lit("r"))
    files = facts.from_contents(git.read(spark, root).withColumn("repo", F.lit("r")))
    texts = None
    if a.overlay_file:
        raw = spark.read.text(a.overlay_file, wholetext=True)
        texts = overlay.parse_overlays(raw, "value", []).withColumn("path", overlay.overlay_path("path")).where("path is not null").withColumn("repo", F.lit("r"))
        bases = git.read(spark, root, "blobs", base).select(F.lit("r").alias("repo"), "path", F.col("text").alias("base"))
        new = line_diff.text_spans(texts.join(bases, ["repo", "path"], "left"))
        spans = spans.join(texts.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(new)
        changed = changed.unionByName(texts.select("repo", "path")).distinct()
        files = overlay.upsert(files, facts.from_contents(texts.select("repo", "path", F.encode("text", "UTF-8").alias("content"))), ["repo", "path"])
    engine = Engine(spark, Tables.of(files, a.cache))
    if a.command == "audit":
        to = clients.PullRequestComments.from_env() if a.comment else None  # before the work, so that what is not set is told at once
        got = engine.audit(changed, spans, overlays=texts is not None)
        if to:
            comments.write(spark.createDataFrame([(to.repository, to.number, report.markdown(got))], comments.SCHEMA), to.api, to.token)
        return _emit(a, got)
    found = engine.explain(changed, spans, a.symbol, a.file)
    if not found and (a.symbol or a.file):
        raise ValueError("no changed symbol matches")
    text = report.explanations(found, a.why, a.format)
    _write(a, text)
    return 0


def _emit(a, got: dict) -> int:
    _write(a, report.to_json(got) if a.format == "json" else report.markdown(got))
    return 0


def _write(a, text: str) -> None:
    print(text)
    if a.out:
        Path(a.out).write_text(text + "\n")


if __name__ == "__main__":
    sys.exit(main())
