"""Files to facts: one pass parses each distinct content once; a digest-keyed Parquet table remembers what was parsed."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import language_of
from ..functions.rules import SOURCE_SUFFIXES
from ..shipping import ship
from . import js_parser, py_parser
from .isolation import Isolated

VERSION = 2
#: Seconds that one file may take.
PARSE_SECONDS = 45.0
#: Contents that are sent to a parser at once: so many, or so many bytes and one more.
CALLS, CALL_BYTES = 64, 1 << 20
FACTS = "digest string, language string, parse_ok boolean, imports array<struct<module:string,symbols:array<string>,alias:string,line:int>>, definitions array<struct<name:string,kind:string,line:int,docstring:string>>, calls array<struct<callee:string,line:int>>"
_PARTS = {"imports": ("module", "symbols", "alias", "line"), "definitions": ("name", "kind", "line", "docstring"), "calls": ("callee", "line")}


def read_files(spark: SparkSession, root: str, repo: str = "r") -> DataFrame:
    """(repo, path, language, digest, content, n_lines): source files below ``root``, by a recursive scan of a folder that executors can read."""
    glob = "*{" + ",".join(SOURCE_SUFFIXES) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    return from_contents(raw.select(F.lit(repo).alias("repo"), F.substring_index("path", base + "/", -1).alias("path"), "content"))


def from_contents(raw: DataFrame) -> DataFrame:
    """raw: repo, path, content (binary)."""
    text = F.decode("content", "ISO-8859-1")
    n = F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n") | (F.octet_length("content") == 0), 0).otherwise(1)
    return raw.select("repo", "path", language_of("path").alias("language"), F.sha2("content", 256).alias("digest"), "content", n.cast("int").alias("n_lines")).where("language is not null")


@contextmanager
def time_limit(seconds: float):
    """TimeoutError after so many seconds, where the code runs in its process's main thread, as it does in a Python worker."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parse_one(content: bytes, language: str, seconds: float = PARSE_SECONDS) -> dict | None:
    """None for what does not parse, or not in time: one bad file must not take a worker."""
    try:
        with time_limit(seconds):
            return py_parser.parse(content) if language == "python" else js_parser.parse(content)
    except (RecursionError, TimeoutError, MemoryError):
        return None


def portions(calls: list[tuple[bytes, str]]) -> Iterator[list[tuple[bytes, str]]]:
    """``calls`` in portions of CALLS or of CALL_BYTES, whichever comes first."""
    part, size = [], 0
    for call in calls:
        part.append(call)
        size += len(call[0] or b"")
        if len(part) >= CALLS or size >= CALL_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def parse_contents(contents: DataFrame, parse: Callable[[bytes, str], dict | None] = parse_one, seconds: float = 2 * PARSE_SECONDS) -> DataFrame:
    """
    contents: digest, language, content -> FACTS. A source that does not parse has empty facts and parse_ok false, and so has one that kills the process of ``parse``
    or keeps it for ``seconds``: each task parses in a child process. Contents are few bytes and much work, so they are dealt over as many tasks as a shuffle has
    rather than over as few as their bytes would fill.
    """
    contents = contents.repartition(int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "digest", "language")

    def run(batches):
        with Isolated(parse, seconds) as isolated:
            for batch in batches:
                yield parsed(batch, isolated)

    def parsed(batch, isolated):
        rows, (digests, languages, contents) = [], (batch.column(c).to_pylist() for c in ("digest", "language", "content"))
        answers = [got for calls in portions(list(zip(contents, languages, strict=True))) for got in isolated.each(calls)]
        for digest, language, got in zip(digests, languages, answers, strict=True):
            row = {"digest": digest, "language": language, "parse_ok": got is not None}
            rows.append(row | {k: [dict(zip(names, x, strict=True)) for x in (got or {}).get(k, [])] for k, names in _PARTS.items()})
        return pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"line": pa.int32(), "symbols": pa.list_(pa.string())}
    schema = pa.schema([("digest", pa.string()), ("language", pa.string()), ("parse_ok", pa.bool_()), *((k, pa.list_(pa.struct([(n, kinds.get(n, pa.string())) for n in names]))) for k, names in _PARTS.items())])
    return ship(contents).mapInArrow(run, FACTS)


#: Files of one content that meet its facts in one task.
COPIES = 10_000


def facts_of(files: DataFrame, cache: str | None = None, skip: DataFrame | None = None) -> DataFrame:
    """
    Facts of all files: repo, path, language, digest, n_lines and the three lists. Equal contents of one language are parsed once. With ``cache`` (a
    folder), only contents that are not in its table are parsed, and those that parsed are added; failures are tried again. ``skip`` (repo, path):
    files known to be trouble, which are not parsed and have no facts.
    """
    spark = files.sparkSession
    if skip is not None:
        bad = files.join(skip.select("repo", "path").distinct(), ["repo", "path"], "left_semi").drop("content")
        none = [F.array().cast(t.split(" ", 1)[1]).alias(t.split(" ", 1)[0]) for t in FACTS.split(", ", 3)[3].replace(", definitions ", "|definitions ").replace(", calls ", "|calls ").split("|")]
        good = facts_of(files.join(skip.select("repo", "path").distinct(), ["repo", "path"], "left_anti"), cache)
        return good.unionByName(bad.select("*", F.lit(False).alias("parse_ok"), *none).select(*good.columns))
    distinct = files.groupBy("digest", "language").agg(F.any_value("content").alias("content"))
    if cache:
        path = f"{cache.rstrip('/')}/v{VERSION}"
        try:
            known = spark.read.schema(FACTS).parquet(path).dropDuplicates(["digest", "language"])
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], FACTS)
        missing = distinct.join(known, ["digest", "language"], "left_anti")
        parse_contents(missing).where("parse_ok").write.mode("append").parquet(path)
        known = spark.read.schema(FACTS).parquet(path).dropDuplicates(["digest", "language"])
        facts = known.unionByName(parse_contents(distinct.join(known, ["digest", "language"], "left_anti")))
    else:
        facts = parse_contents(distinct)
    # a content with very many files is joined in parts; there is one for COPIES files at most, so these are broadcast
    key = ["digest", "language"]
    many = F.broadcast(files.groupBy(*key).agg(F.ceil(F.count("*") / COPIES).alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = files.drop("content").join(many, key, "left").withColumn("part", F.pmod(F.xxhash64("repo", "path"), parts)).drop("parts")
    copied = facts.join(many, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return dealt.join(copied, [*key, "part"]).drop("part")


def tables(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """imports, definitions, calls: a row for each fact, with its ordinal in the file."""
    part = lambda k: facts.select("repo", "path", F.posexplode(k).alias("ordinal", "x")).select("repo", "path", "ordinal", "x.*")
    return part("imports"), part("definitions"), part("calls")


def assignments(files: DataFrame) -> DataFrame:
    """(repo, path, name, rhs, start, stop, class_name) of Python files: assignments at module level and in top-level classes."""
    names = ("repo", "path", "name", "rhs", "start", "stop", "class_name")

    def run(batches):
        for df in batches:
            rows = [(r, p, *a) for r, p, c in zip(df["repo"], df["path"], df["content"], strict=True) for a in py_parser.assignments(c.decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=list(names))

    return ship(files).where("language = 'python'").select("repo", "path", "content").mapInPandas(run, "repo string, path string, name string, rhs string, start int, stop int, class_name string")


def readers(files: DataFrame, names: DataFrame) -> DataFrame:
    """names: repo, path, name -> with reader (the innermost definition) and line of each read of the name in its own file."""

    def run(batches):
        for df in batches:
            rows = [(r, p, n, *x) for r, p, n, c in zip(df["repo"], df["path"], df["name"], df["content"], strict=True) for x in py_parser.readers(c.decode("utf-8", "replace"), n)]
            yield pd.DataFrame(rows, columns=["repo", "path", "name", "reader", "line"])

    asked = files.where("language = 'python'").select("repo", "path", "content").join(names.select("repo", "path", "name").distinct(), ["repo", "path"])
    return ship(asked).select("repo", "path", "name", "content").mapInPandas(run, "repo string, path string, name string, reader string, line int")


def command_helps(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, name, line, help) of the ``symbols`` (repo, path, name, line) that are commands of a command line with a help text."""

    def run(batches):
        for df in batches:
            found = [(r, p, n, int(k), py_parser.command_help(c.decode("utf-8", "replace"), n, int(k))) for r, p, n, k, c in zip(df["repo"], df["path"], df["name"], df["line"], df["content"], strict=True) if b".command" in c]
            yield pd.DataFrame([x for x in found if x[4]], columns=["repo", "path", "name", "line", "help"])

    asked = files.where("language = 'python'").select("repo", "path", "content").join(symbols.select("repo", "path", "name", "line").distinct(), ["repo", "path"])
    return ship(asked).select("repo", "path", "name", "line", "content").mapInPandas(run, "repo string, path string, name string, line int, help string")
