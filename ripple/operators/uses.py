"""Who uses a changed symbol: imports that name it, proven by calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import base_name, col
from ..functions.rules import BUILTINS, CALL_PROOFS, IMPORTER_LIMIT
from ..functions.scalars import bare_callee

KEY = ["repo", "path"]


def seed_stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def from_module(module: Column, stem: Column) -> Column:
    """The module has the stem as a dotted part or ends with it, or is empty."""
    return F.coalesce(module.endswith(stem) | (module == "") | F.array_contains(F.split(module, r"\."), stem), F.lit(False))


def imported_names(imports: DataFrame) -> DataFrame:
    """imports with a row for each name that they import, in ``symbol``; * is a name."""
    return imports.withColumn("symbol", F.explode(F.array_distinct("symbols"))).drop("symbols")


def symbol_users(symbols: DataFrame, edges: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """
    (repo, seed, name, kind, path, import_line, call_lines): importers of ``seed`` that import the symbol (symbols: repo, path, name, kind)
    and call it; a class needs the import alone. The name is part of every key: imports are matched by the names that they list (those of * by the file alone,
    which are few), calls by the last part of what they call, so a file with many symbols is no product of its lines.
    """
    key = ["path", "name", "seed", "kind", "repo"]  # joins sort by the first column before all else, and a repository's rows share theirs
    asked = symbols.select("repo", F.col("path").alias("seed"), "name", "kind").distinct().withColumn("stem", seed_stem("seed"))  # once a symbol, not once an import
    pair = asked.join(edges.select("repo", F.col("dst").alias("seed"), F.col("src").alias("path")).distinct(), ["seed", "repo"])
    i = imported_names(imports.select("repo", "path", "ordinal", "module", "symbols", F.col("line").alias("import_line")))
    by_name = pair.join(i.where("symbol != '*'").withColumnRenamed("symbol", "name"), ["path", "name", "repo"])
    by_star = pair.join(i.where("symbol = '*'").drop("symbol"), ["path", "repo"])
    named = by_name.select(*by_star.columns).unionByName(by_star).where(from_module(F.col("module"), F.col("stem")))
    first = named.groupBy(*key).agg(F.min_by("import_line", "ordinal").alias("import_line"))
    last_part = F.substring_index("callee", ".", -1)
    # a callee is the name itself or ends with a dot and the name; names have no dots, so the last part is the key
    c = calls.select("repo", "path", last_part.alias("name"), F.col("line").alias("call_line"), F.col("ordinal").alias("call_ordinal"))
    called = first.select(*key).join(c, ["path", "name", "repo"])
    lines = called.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("call_line", "call_ordinal"))), lambda x: x["call_line"]).alias("call_lines"))
    users = first.join(lines, key, "left").where(F.col("call_lines").isNotNull() | (F.col("kind") == "class"))
    return users.select("repo", "seed", "name", "kind", "path", "import_line", "call_lines")


def user_evidence(users: DataFrame) -> DataFrame:
    """Evidence rows (confidence, kind, location, fact) of each user: the edge, the import, the first calls, and how many more."""
    item = lambda kind, line, fact: F.struct(F.lit("proven").alias("confidence"), F.lit(kind).alias("kind"), F.concat_ws(":", "path", line.cast("string")).alias("location"), fact.alias("fact"))
    calls = F.coalesce("call_lines", F.array().cast("array<int>"))
    shown = F.transform(F.slice(calls, 1, CALL_PROOFS), lambda n: item("call", n, F.concat(F.lit("calls `"), F.col("name"), F.lit("`"))))
    rest = F.slice(calls, F.lit(CALL_PROOFS + 1), F.greatest(F.size(calls) - CALL_PROOFS, F.lit(0)))
    more = F.when(F.size(rest) > 0, F.array(item("call", F.get(rest, F.lit(0)), F.concat(F.lit("+"), F.size(rest).cast("string"), F.lit(" more on lines "), F.array_join(F.transform(rest, lambda n: n.cast("string")), ", ")))))
    empty = F.filter(shown, lambda x: F.lit(False))
    edge = F.array(item("graph_importer", F.lit(None).cast("int"), F.concat(F.lit("imports `"), F.col("seed"), F.lit("`"))), item("import", F.col("import_line"), F.concat(F.lit("imports `"), F.col("name"), F.lit("`"))))
    return users.withColumn("evidence", F.concat(edge, shown, F.coalesce(more, empty)))


def proven_importers(ring_rows: DataFrame, users: DataFrame) -> DataFrame:
    """Files of hop 1 that use at least one changed symbol."""
    return ring_rows.where("hops = 1").join(users.select(*KEY).distinct(), KEY, "left_semi")


def importers_of_name(names: DataFrame, imports: DataFrame, limit: int = IMPORTER_LIMIT) -> DataFrame:
    """names: repo, changed (path), name. The first files in path order that import the name from the changed module, itself excluded."""
    keyed = names.withColumn("symbol", F.explode(F.array("name", F.lit("*"))))
    hit = keyed.join(imported_names(imports.select("repo", "path", "module", "symbols")), ["repo", "symbol"]).where((F.col("path") != F.col("changed")) & from_module(F.col("module"), seed_stem("changed")))
    order = Window.partitionBy("repo", "changed", "name").orderBy(F.split("path", "/"))
    return hit.select("repo", "changed", "name", "path").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def same_file_callers(symbols: DataFrame, bodies: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, path, name, callers): other definitions of the file whose body holds a call of the symbol, in line order. bodies: definitions with start, stop."""
    c = calls.select(*KEY, "callee", F.col("line").alias("call_line"))
    b = bodies.select(*KEY, F.col("name").alias("caller"), F.col("line").alias("caller_line"), "start", "stop")
    s = symbols.select(*KEY, "name").distinct()
    hit = s.join(c, KEY).where(bare_callee("callee") == F.col("name")).join(b, KEY).where(F.col("call_line").between(F.col("start"), F.col("stop")) & (F.col("caller") != F.col("name")))
    first = hit.groupBy(*KEY, "name", "caller").agg(F.min("caller_line").alias("at"))
    return first.groupBy(*KEY, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "caller"))), lambda x: x["caller"]).alias("callers"))


def calls_in_hunks(hunks: DataFrame, calls: DataFrame) -> DataFrame:
    """hunks: repo, path, hunk, symbol, line (a row for each line). Calls on those lines that are not of the symbol itself or a builtin."""
    c = calls.select(*KEY, "line", "callee", F.col("ordinal").alias("call_ordinal")).withColumn("bare", bare_callee("callee"))
    return hunks.join(c, [*KEY, "line"]).where((F.col("bare") != F.col("symbol")) & ~F.lower("bare").isin(*BUILTINS))


def primary_call(calls: DataFrame) -> DataFrame:
    """The call that a hunk is about: project functions before constructors, never plumbing; the later one of equals."""
    from ..functions.predicates import is_plumbing_callee

    rank = F.when(is_plumbing_callee("bare"), -1).when(F.substring("bare", 1, 1).rlike(r"\p{Lu}"), 0).otherwise(1)
    ranked = calls.withColumn("rank", rank).where("rank >= 0")
    return ranked.groupBy(*KEY, "hunk").agg(F.max_by("bare", F.struct("rank", "line", "call_ordinal")).alias("callee"))


def has_internal_calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols that are called in their own file."""
    c = calls.select(*KEY, bare_callee("callee").alias("name")).distinct()
    return symbols.join(c, [*KEY, "name"], "left_semi")


def definition_docstrings(symbols: DataFrame, definitions: DataFrame) -> DataFrame:
    """symbols with docstring and definition_line: of the definition with the same name, kind and line, else the first of that name with one."""
    d = definitions.select(*KEY, "name", "kind", "line", "docstring")
    exact = d.groupBy(*KEY, "name", "kind", "line").agg(F.max("docstring").alias("exact"), F.lit(True).alias("found"))
    named = definitions.where("docstring is not null").groupBy(*KEY, "name").agg(F.min_by("docstring", F.struct("line", "ordinal")).alias("named"))
    out = symbols.join(exact, [*KEY, "name", "kind", "line"], "left").join(named, [*KEY, "name"], "left")
    return out.withColumn("docstring", F.coalesce("exact", "named")).drop("exact", "named", "found")


def has_named_import(col_module: Column | str) -> Column:
    return col(col_module) != ""
