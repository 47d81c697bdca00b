"""
Git as a source: ``spark.read.format("ripple_git")`` with options path (a working tree that all executors can read), base, mode
(local or range) and table: files, changed, spans or blobs. One partition for each repository; names are relative and not quoted.
"""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.rules import SOURCE_SUFFIXES
from ..shipping import ship
from .overlay import changed_spans

SCHEMAS = {
    "files": "repo string, path string, content binary",
    "changed": "repo string, path string, origin string",
    "spans": "repo string, path string, start int, stop int",
    "blobs": "repo string, path string, text string",
}


class GitError(RuntimeError):
    """Not a repository, or no base to compare with."""


def run(root: str, *args: str, ok: tuple[int, ...] = (0,)) -> str:
    done = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True)
    if done.returncode not in ok:
        raise GitError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout.decode("utf-8", "replace")


def names(root: str, *args: str) -> list[str]:
    return [x for x in run(root, *args).split("\0") if x]


def require_repository(root: str) -> None:
    if run(root, "rev-parse", "--is-inside-work-tree", ok=(0, 128)).strip() != "true":
        raise GitError(f"{root} is not in a git repository")


def resolve_base(root: str, preferred: str = "main") -> str:
    """The first of ``preferred``, main and master that names a commit."""
    for ref in dict.fromkeys((preferred, "main", "master")):
        if run(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}", ok=(0, 1, 128)).strip():
            return ref
    raise GitError(f"no base: {preferred}, main and master do not exist")


def is_source(path: str) -> bool:
    return Path(path).suffix.lower() in SOURCE_SUFFIXES


def list_sources(root: str) -> list[str]:
    """Tracked and untracked files that are not ignored, sorted by path parts; outside of git, all files."""
    try:
        found = names(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    except GitError:
        found = [p.relative_to(root).as_posix() for p in Path(root).rglob("*")]
    return sorted({p for p in found if is_source(p) and (Path(root) / p).is_file()}, key=lambda p: p.split("/"))


def changed_files(root: str, base: str = "main", mode: str = "local") -> list[tuple[str, str]]:
    """(path, origin): range: base...HEAD; local: the working tree, the index and untracked files."""
    require_repository(root)
    only = ("diff", "-z", "--name-only", "--relative", "--diff-filter=ACMR")
    if mode == "range":
        return [(p, "range") for p in names(root, *only, f"{resolve_base(root, base)}...HEAD")]
    return [(p, "worktree") for p in names(root, *only)] + [(p, "index") for p in names(root, *only, "--cached")] + [(p, "untracked") for p in names(root, "ls-files", "-z", "--others", "--exclude-standard")]


_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple[str, int, int]]:
    """(path, start, stop) of the new side of each hunk; a pure deletion is a span that ends before it starts, just after the deleted lines."""
    out, path = [], None
    for line in text.split("\n"):
        if line.startswith("+++ "):
            path = line[6:].rstrip("\t") if line.startswith("+++ b/") else None
        elif path is not None and (m := _HUNK.match(line)):
            start, n = int(m[1]), int(m[2] or 1)
            out.append((path, start, start + n - 1) if n else (path, start + 1, start))
    return out


def line_spans(root: str, base: str = "main", mode: str = "local") -> list[tuple[str, int, int]]:
    """New-side spans of changed source files; an untracked file is one span."""
    require_repository(root)
    diff = ("diff", "-U0", "--relative", "--no-color", "--no-ext-diff", "--diff-filter=ACMR")
    if mode == "range":
        found = parse_diff(run(root, *diff, f"{resolve_base(root, base)}...HEAD"))
    else:
        found = parse_diff(run(root, *diff)) + parse_diff(run(root, *diff, "--cached"))
        for p in names(root, "ls-files", "-z", "--others", "--exclude-standard"):
            if is_source(p):
                found.append((p, 1, max(1, len((Path(root) / p).read_text(errors="replace").splitlines()))))
    return [x for x in found if is_source(x[0])]


def blob_text(root: str, base: str, path: str) -> str:
    """The file's text at ``base``; '' where it does not exist."""
    done = subprocess.run(["git", "-C", root, "show", f"{base}:./{path}"], capture_output=True)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def blob_texts(root: str, base: str, paths: list[str]) -> list[str]:
    """The files' texts at ``base``, '' where one does not exist: one process for all of them."""
    asked = "".join(f"{base}:./{p}\n" for p in paths)  # a path with a line feed is no name that this protocol can carry
    done = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=asked.encode(), capture_output=True)
    out, at, data = [], 0, done.stdout
    for p in paths:
        if "\n" in p:
            out.append(blob_text(root, base, p))
            at = data.find(b"\n", at) + 1
            for _ in range(p.count("\n")):
                at = data.find(b"\n", at) + 1
            continue
        head, _, _ = data[at:].partition(b"\n")
        at += len(head) + 1
        if not head.endswith(b" missing") and len(head.split()) == 3:
            size = int(head.split()[2])
            out.append(data[at : at + size].decode("utf-8", "replace"))
            at += size + 1
        else:
            out.append("")
    return out


#: Files that one partition reads.
PART_FILES = 512


class _Part(InputPartition):
    """Some files of a repository, or one of its lists as a whole (paths: None)."""

    def __init__(self, root: str, paths: list[str] | None):
        self.root, self.paths = root, paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        roots = self.options["path"].split(",")
        if self.options.get("table", "files") not in ("files", "blobs"):
            return [_Part(root, None) for root in roots]
        listed = ((root, list_sources(root)) for root in roots)
        return [_Part(root, paths[lo : lo + PART_FILES]) for root, paths in listed for lo in range(0, len(paths), PART_FILES)]

    def read(self, partition):
        root, paths, o = partition.root, partition.paths, self.options
        table, base, mode = o.get("table", "files"), o.get("base", "main"), o.get("mode", "local")
        if table == "files":
            for p in paths:
                yield (root, p, (Path(root) / p).read_bytes())
        elif table == "changed":
            for p, origin in changed_files(root, base, mode):
                yield (root, p, origin)
        elif table == "spans":
            for p, start, stop in line_spans(root, base, mode):
                yield (root, p, start, stop)
        else:
            base = resolve_base(root, base)
            for lo in range(0, len(paths), 64):
                some = paths[lo : lo + 64]
                yield from zip([root] * len(some), some, blob_texts(root, base, some), strict=True)


class GitSource(DataSource):
    @classmethod
    def name(cls):
        return "ripple_git"

    def schema(self):
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema):
        if self.options.get("table", "files") not in SCHEMAS:
            raise ValueError(f"table is one of {sorted(SCHEMAS)}")
        return _Reader(dict(self.options))


def read(spark: SparkSession, root: str, table: str = "files", base: str = "main", mode: str = "local"):
    ship(spark.range(0))
    spark.dataSource.register(GitSource)
    return spark.read.format("ripple_git").option("path", root).option("table", table).option("base", base).option("mode", mode).load()


__all__ = ["GitError", "GitSource", "blob_text", "changed_files", "changed_spans", "line_spans", "list_sources", "parse_diff", "read", "resolve_base"]
