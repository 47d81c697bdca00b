"""Import resolution: candidates of each import, joined with an index of module names and paths; edges with proofs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import NAMED_IMPORTERS
from ..functions.predicates import base_name, col, is_script_path, let, uses_script_resolution
from ..functions.rules import SCRIPT_SUFFIXES

KEY = ["repo", "path"]
#: Edges of a node from which its importers are not sorted by one task.
HUB = 100_000
_SUFFIX = r"\.[^./]+$"


def dotted(path: Column | str) -> Column:
    """a/b.py -> a.b; a package's __init__ is the package; a root __init__ is ''."""
    stem = F.regexp_replace(col(path), r"(?<=[^/])\.[^./]+$", "")
    return F.replace(F.regexp_replace(stem, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def scan_order(path: Column | str) -> Column:
    return F.split(col(path), "/")


def module_index(files: DataFrame) -> DataFrame:
    """
    (repo, key, target): dotted names of all files, the last in scan order for a name that several have; names below src/
    also without it (the first file), where no file has the short name itself.
    """
    named = files.select("repo", F.col("path").alias("target"), dotted("path").alias("key"))
    direct = named.where("key != ''").groupBy("repo", "key").agg(F.max_by("target", scan_order("target")).alias("target"))
    short = named.where(F.col("target").startswith("src/")).withColumn("key", F.regexp_replace("key", r"^src\.?", "")).where("key != ''")
    short = short.groupBy("repo", "key").agg(F.min_by("target", scan_order("target")).alias("target")).join(direct, ["repo", "key"], "left_anti")
    return direct.unionByName(short)


def script_index(files: DataFrame) -> DataFrame:
    """(repo, key, target) of script files: the path, the path without suffix, and for index files the folder; the path wins, then the first file in scan order."""
    f = files.where(is_script_path("path")).select("repo", F.col("path").alias("target"))
    bare = F.regexp_replace("target", _SUFFIX, "")
    keys = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("target").alias("key")),
        F.struct(F.lit(1).alias("rank"), bare.alias("key")),
        F.struct(F.lit(2).alias("rank"), F.when(base_name(bare) == "index", F.regexp_replace(bare, r"/?index$", "")).alias("key")),
    )
    rows = f.select("*", F.explode(keys).alias("k")).select("repo", "target", "k.*").where("key is not null")
    return rows.groupBy("repo", "key").agg(F.min_by("target", F.struct("rank", scan_order("target"))).alias("target"))


def normalized(path: Column | str) -> Column:
    """Without . and .. segments; null where it climbs above the root."""

    def step(parts: Column, seg: Column) -> Column:
        up = F.when(F.size(parts) > 0, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.lit(None))
        return F.when(parts.isNull() | seg.isin("", "."), parts).when(seg == "..", up).otherwise(F.concat(parts, F.array(seg)))

    return F.array_join(F.aggregate(F.split(col(path), "/"), F.array().cast("array<string>"), step), "/")


def parent(path: Column | str) -> Column:
    return F.when(F.contains(col(path), F.lit("/")), F.regexp_replace(col(path), r"/[^/]*$", "")).otherwise("")


def absolute_module(module: Column | str, importer: Column | str) -> Column:
    """Leading dots stand for the importer's package and its parents; null above the root."""
    dots = F.length(F.regexp_extract(col(module), r"^\.+", 0))
    package = F.filter(F.split(parent(importer), "/"), lambda x: x != "")
    keep = F.size(package) - (dots - 1)
    rest = F.regexp_replace(col(module), r"^\.+", "")
    base = F.slice(package, F.lit(1), F.greatest(keep, F.lit(0)))
    joined = F.concat_ws(".", base, F.when(rest != "", rest))
    return F.when(dots == 0, col(module)).when(keep >= 0, joined)


def candidates(imports: DataFrame) -> DataFrame:
    """imports with script (resolved by path), rank and key: each name under which the imported file may be indexed."""
    i = imports.withColumn("script", uses_script_resolution("module", "path"))
    base = absolute_module("module", "path")
    symbols = F.filter(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: s != "*")
    modules = F.array_distinct(F.filter(F.concat(F.array(base), F.transform(symbols, lambda s: F.when(base == "", s).otherwise(F.concat_ws(".", base, s)))), lambda k: k.isNotNull() & (k != "")))
    where = normalized(F.concat_ws("/", parent("path"), F.col("module")))
    relative = F.col("module").startswith("./") | F.col("module").startswith("../")
    tries = lambda w: F.array(w, *[F.concat(w, F.lit(s)) for s in SCRIPT_SUFFIXES], *[F.concat(w, F.lit(f"/index{s}")) for s in SCRIPT_SUFFIXES])
    none = F.array().cast("array<string>")
    paths = F.when(relative, let(where, lambda w: F.when(w.isNotNull(), tries(w)).otherwise(none))).otherwise(none)  # normalized once, not for each try
    return i.select("*", F.posexplode(F.when(F.col("script"), paths).otherwise(modules)).alias("rank", "key"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """
    (repo, path, ordinal, module, line, target), one row for each file that an import statement refers to. A script's
    import has at most one target: the first candidate that exists. Imports of one's own file are dropped.
    """
    tries = candidates(imports).select("repo", "path", "ordinal", "module", "line", "script", "rank", "key")
    both = module_index(files).withColumn("script", F.lit(False)).unionByName(script_index(files).withColumn("script", F.lit(True)))
    hit = tries.join(both, ["repo", "script", "key"]).where(F.col("path") != F.col("target"))
    best = Window.partitionBy(*KEY, "ordinal").orderBy("rank")
    chosen = hit.withColumn("nth", F.row_number().over(best)).where(~F.col("script") | (F.col("nth") == 1))
    return chosen.select("repo", "path", "ordinal", "module", "line", "target").dropDuplicates([*KEY, "ordinal", "target"])


def build_edges(resolved: DataFrame) -> DataFrame:
    """Edges (repo, src, dst, imports): the proofs (line, module) of an edge in the order of its import statements."""
    proof = F.struct("ordinal", "line", "module")
    ordered = F.transform(F.array_sort(F.collect_list(proof)), lambda x: F.struct(x["line"].alias("line"), x["module"].alias("module")))
    return resolved.groupBy("repo", F.col("path").alias("src"), F.col("target").alias("dst")).agg(ordered.alias("imports"))


def importers_of(edges: DataFrame, most: int = NAMED_IMPORTERS, name: Callable[[str], Column] = F.col) -> DataFrame:
    """
    (repo, path, importers): a struct of the first ``most`` distinct in-neighbours in path order and n, how many there are. A hub's importers are
    never one row: the first are kept before the shuffle, the count is combinable. ``name``: the path that a src stands for, if edges have ids.
    """
    pairs = edges.select("repo", F.col("dst").alias("path"), "src").distinct()
    order = Window.partitionBy("path", "repo").orderBy("named")
    first = pairs.select("repo", "path", name("src").alias("named")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    first = first.groupBy("path", "repo").agg(F.array_sort(F.collect_list("named")).alias("first"))
    counts = pairs.groupBy("path", "repo").agg(F.count("*").alias("n"))
    return first.join(counts, ["path", "repo"]).select("repo", "path", F.struct("first", "n").alias("importers"))


def listed_importers(edges: DataFrame, most: int = NAMED_IMPORTERS, name: Callable[[str], Column] = F.col) -> DataFrame:
    """
    ``importers_of`` for tables in which few nodes are hubs: a node's edges meet in one shuffle and repeats are told by their rank. Nodes with more than HUB
    edges, of which there is one for HUB edges at most, are left to ``importers_of``.
    """
    e = edges.select("repo", F.col("dst").alias("path"), "src", "dst")
    hubs = F.broadcast(e.groupBy("path", "repo").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("path", "repo"))
    order = Window.partitionBy("path", "repo").orderBy(name("src"))
    ranked = e.join(hubs, ["path", "repo"], "left_anti").withColumn("nth", F.dense_rank().over(order))
    firsts = [F.min(F.when(F.col("nth") == k, F.col("src"))).alias(f"first_{k}") for k in range(1, most + 1)]
    few = ranked.groupBy("path", "repo").agg(*firsts, F.max("nth").cast("long").alias("n"))
    first = F.filter(F.array(*[name(f"first_{k}") for k in range(1, most + 1)]), lambda x: x.isNotNull()).alias("first")
    return few.select("repo", "path", F.struct(first, "n").alias("importers")).unionByName(importers_of(e.join(hubs, ["path", "repo"], "left_semi"), most, name))


def importers_or_none(importers: str = "importers") -> Column:
    return F.coalesce(F.col(importers), F.struct(F.array().cast("array<string>").alias("first"), F.lit(0).cast("long").alias("n")))


def edge_evidence(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Proofs of edges into ``seeds`` (repo, path, ord): (repo, importer, seed, nth, line, module) in seed order."""
    s = seeds.select("repo", F.col("path").alias("dst"), "ord")
    return edges.join(s, ["repo", "dst"]).select("repo", F.col("src").alias("importer"), F.col("dst").alias("seed"), "ord", F.posexplode("imports").alias("nth", "proof")).select("repo", "importer", "seed", "ord", "nth", "proof.*")
