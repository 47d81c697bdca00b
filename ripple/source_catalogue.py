"""
Queries that begin with source text: files are rendered from the driver's tables, parsed, resolved, captioned, labelled and reported,
and compared with SQL for what was put into them.

Every customer is a Python module (``customer/<key>.py``) and a script (``customer/<key>.ts``) that imports its nation's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import adapters as a
from .catalogue import query
from .operators import intervals, line_diff, resolve, uses
from .plans import blocks, captions, labels
from .plans.engine import Engine, Tables
from .sources import facts

_PYTHON = '''from nation_{n} import find
from segments.{m} import buy, sell as trade

LIMIT_{n} = {k}

def load_{k}(x):
    """Returns customer number {k} when asked."""
    return find(LIMIT_{n}, trade(x))

class Box{k}:
    def open(self):
        return load_{k}(self)
'''
_SCRIPT = """import {{ find, top as t }} from '../nation_{n}';
const m = require('./lib/{m}');

/** Loads number {k}. */
export function load{k}(x) {{
  return find(`a ${{trade(x)}} b`);
}}
export class Box{k} {{}}
const open{k} = (x) => load{k}(x);
"""
_NATION = "def find(a, b):\n    return a\n"


def _filled(template: str, **columns) -> F.Column:
    parts, out = template.replace("{{", "\x01").replace("}}", "\x02"), F.lit("")
    while "{" in parts:
        text, _, rest = parts.partition("{")
        name, _, parts = rest.partition("}")
        out = F.concat(out, F.lit(text.replace("\x01", "{").replace("\x02", "}")), columns[name])
    return F.concat(out, F.lit(parts.replace("\x01", "{").replace("\x02", "}")))


def _files(spark, sf_dir) -> DataFrame:
    c = a.read(spark, sf_dir, "customer")
    values = {"k": F.col("c_custkey").cast("string"), "n": F.col("c_nationkey").cast("string"), "m": F.lower("c_mktsegment")}
    name = lambda end: F.concat(a.node("customer", "c_custkey"), F.lit(end)).alias("path")
    rows = c.select(a.repo(), name(".py"), _filled(_PYTHON, **values).alias("text")).unionByName(c.select(a.repo(), name(".ts"), _filled(_SCRIPT, **values).alias("text")))
    nation = a.read(spark, sf_dir, "nation").select(a.repo(), F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.lit(_NATION).alias("text"))
    return facts.from_contents(rows.unionByName(nation).select("repo", "path", F.encode("text", "UTF-8").alias("content")))


def _tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """imports, definitions, calls: the facts are kept, so that each file is parsed once however many of them are read, and how often."""
    return facts.tables(facts.facts_of(_files(spark, sf_dir)).persist())


_P = "'customer/' || c_custkey || '.py'"
_S = "'customer/' || c_custkey || '.ts'"


# Scan and parse


@query(f"""SELECT {_P} AS path, 0 AS ordinal, 'nation_' || c_nationkey AS module, 'find' AS symbols, 1 AS line FROM customer UNION ALL SELECT {_P}, 1, 'segments.' || lower(c_mktsegment), 'buy,sell', 2 FROM customer
  UNION ALL SELECT {_S}, 0, '../nation_' || c_nationkey, 'find,top', 1 FROM customer UNION ALL SELECT {_S}, 1, './lib/' || lower(c_mktsegment), '', 2 FROM customer""")
def parsed_imports(spark, sf_dir):
    return _tables(spark, sf_dir)[0].select("path", "ordinal", "module", F.array_join("symbols", ",").alias("symbols"), "line")


@query(f"""SELECT {_P} AS path, 'load_' || c_custkey AS name, 'function' AS kind, 6 AS line, 'Returns customer number ' || c_custkey || ' when asked.' AS docstring FROM customer UNION ALL SELECT {_P}, 'Box' || c_custkey, 'class', 10, NULL FROM customer
  UNION ALL SELECT {_P}, 'open', 'function', 11, NULL FROM customer UNION ALL SELECT {_S}, 'load' || c_custkey, 'function', 5, 'Loads number ' || c_custkey || '.' FROM customer
  UNION ALL SELECT {_S}, 'Box' || c_custkey, 'class', 8, NULL FROM customer UNION ALL SELECT 'nation_' || n_nationkey || '.py', 'find', 'function', 1, NULL FROM nation""")
def parsed_definitions(spark, sf_dir):
    return _tables(spark, sf_dir)[1].select("path", "name", "kind", "line", "docstring")


@query(f"""SELECT {_P} AS path, unnest(['find', 'trade', 'load_' || c_custkey]) AS callee, unnest([8, 8, 12]) AS line FROM customer UNION ALL SELECT {_S}, unnest(['find', 'trade', 'load' || c_custkey]), unnest([6, 6, 9]) FROM customer""")
def parsed_calls(spark, sf_dir):
    """Calls inside a script's template literal are calls as well."""
    return _tables(spark, sf_dir)[2].select("path", "callee", "line")


@query(f"""SELECT {_P} AS path, 'python' AS language, 12 AS n_lines, true AS parse_ok FROM customer UNION ALL SELECT {_S}, 'typescript', 9, true FROM customer UNION ALL SELECT 'nation_' || n_nationkey || '.py', 'python', 2, n_nationkey % 2 = 1 FROM nation""")
def parsed_files(spark, sf_dir):
    """Files on the skip list (those of even nations) are listed and not parsed."""
    skip = a.read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(a.repo(), F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"))
    return facts.facts_of(_files(spark, sf_dir), skip=skip).select("path", "language", "n_lines", "parse_ok")


@query(f"""SELECT {_P} AS path, 2 AS n_imports, 3 AS n_defs, 3 AS n_calls FROM customer UNION ALL SELECT {_S}, 2, 2, 3 FROM customer UNION ALL SELECT 'nation_' || n_nationkey || '.py', 0, 1, 0 FROM nation
  UNION ALL SELECT NULL, CAST(4 * count(*) AS BIGINT), 5 * count(*) + (SELECT count(*) FROM nation), 6 * count(*) FROM customer""")
def scan_sources(spark, sf_dir):
    return Engine(spark, Tables.of(_files(spark, sf_dir))).scan().select("path", "n_imports", "n_defs", "n_calls")


@query(f"""SELECT {_P} AS src, 'nation_' || c_nationkey || '.py' AS dst, '1:nation_' || c_nationkey AS proofs FROM customer""")
def source_edges(spark, sf_dir):
    """Scripts import their nation's module, which is no script: they have no edge."""
    files = _files(spark, sf_dir)
    imports, _, _ = _tables(spark, sf_dir)
    edges = resolve.build_edges(resolve.resolve_imports(imports, files.select("repo", "path", "language")))
    return edges.select("src", "dst", F.array_join(F.transform("imports", lambda x: F.concat_ws(":", x["line"].cast("string"), x["module"])), ",").alias("proofs"))


# Uses


@query(f"SELECT {_P} AS path, 'nation_' || c_nationkey || '.py' AS seed, 'find' AS name, 1 AS import_line, '8' AS call_lines FROM customer")
def source_users(spark, sf_dir):
    files = _files(spark, sf_dir)
    imports, definitions, calls = _tables(spark, sf_dir)
    edges = resolve.build_edges(resolve.resolve_imports(imports, files.select("repo", "path", "language")))
    users = uses.symbol_users(definitions.where("name = 'find'"), edges, imports, calls)
    return users.select("path", "seed", "name", "import_line", F.array_join(F.col("call_lines").cast("array<string>"), ",").alias("call_lines"))


@query(f"""WITH u AS (SELECT {_P} AS path, 'nation_' || c_nationkey || '.py' AS seed FROM customer)
  SELECT path, 'graph_importer' AS kind, path AS location, 'imports `' || seed || '`' AS fact FROM u UNION ALL SELECT path, 'import', path || ':1', 'imports `find`' FROM u UNION ALL SELECT path, 'call', path || ':8', 'calls `find`' FROM u""")
def source_evidence(spark, sf_dir):
    files = _files(spark, sf_dir)
    imports, definitions, calls = _tables(spark, sf_dir)
    edges = resolve.build_edges(resolve.resolve_imports(imports, files.select("repo", "path", "language")))
    found = uses.user_evidence(uses.symbol_users(definitions.where("name = 'find'"), edges, imports, calls))
    return found.select("path", F.explode("evidence").alias("e")).select("path", "e.kind", "e.location", "e.fact")


@query("""WITH r AS (SELECT 'customer/' || c_custkey || '.py' AS path, 'nation_' || c_nationkey || '.py' AS changed FROM customer UNION ALL SELECT 'customer/' || c_custkey || '.ts', 'nation_' || c_nationkey || '.py' FROM customer),
  n AS (SELECT *, row_number() OVER (PARTITION BY changed ORDER BY string_split(path, '/')) AS nth FROM r) SELECT changed, path, CAST(nth AS INT) AS nth FROM n WHERE nth <= 8""")
def name_importers(spark, sf_dir):
    imports = _tables(spark, sf_dir)[0]
    names = a.read(spark, sf_dir, "nation").select(a.repo(), F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("changed"), F.lit("find").alias("name"))
    return uses.importers_of_name(names, imports).select("changed", "path", "nth")


@query(f"SELECT {_P} AS path, 'load_' || c_custkey AS name, 'open' AS callers, 'Returns customer number ' || c_custkey || ' when asked.' AS docstring FROM customer")
def local_callers(spark, sf_dir):
    _, definitions, calls = _tables(spark, sf_dir)
    symbols = uses.has_internal_calls(definitions.where("path like '%.py'"), calls)
    told = uses.definition_docstrings(symbols, definitions)
    local = uses.same_file_callers(symbols, intervals.body_spans(definitions), calls)
    return local.join(told, ["repo", "path", "name"]).select("path", "name", F.array_join("callers", ",").alias("callers"), "docstring")


@query(f"SELECT {_P} AS path, 'trade' AS callee FROM customer UNION ALL SELECT {_P}, 'load_' || c_custkey FROM customer")
def hunk_calls(spark, sf_dir):
    """The calls that lines 8 and 12 are about."""
    _, definitions, calls = _tables(spark, sf_dir)
    hunks = definitions.where("path like '%.py' and kind = 'function' and line in (6, 11)").select("repo", "path", (F.when(F.col("line") == 6, 8).otherwise(12)).alias("line"), F.col("name").alias("symbol"))
    found = uses.calls_in_hunks(hunks.withColumn("hunk", F.col("line").cast("string")), calls)
    return uses.primary_call(found).select("path", "callee")


# Definitions and reads


@query(f"SELECT {_P} AS path, 'LIMIT_' || c_nationkey AS name, CAST(c_custkey AS VARCHAR) AS rhs, 4 AS start, 'load_' || c_custkey AS reader, 8 AS line FROM customer")
def source_ledger(spark, sf_dir):
    files = _files(spark, sf_dir)
    made = facts.assignments(files)
    read = facts.readers(files, made)
    return made.join(read, ["repo", "path", "name"]).select("path", "name", "rhs", "start", "reader", "line")


@query("""SELECT 's' || s_suppkey || '.py' AS path, 'run_' || s_suppkey AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Starts supplier ' || s_suppkey ELSE 'Which supplier' END AS help FROM supplier WHERE s_suppkey % 3 < 2""")
def command_helps(spark, sf_dir):
    """Commands with a help text of their own, with one on an option, and functions that are no commands."""
    k, key = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    head = F.when(k == 0, F.concat(F.lit('@app.command(help="Starts supplier '), key, F.lit('")\n'))).when(k == 1, F.lit("@app.command()\n")).otherwise(F.lit("@cached\n"))
    args = F.when(k == 1, F.lit('x: int = Option(1, help="Which supplier")')).otherwise(F.lit("x: int = 1"))
    text = F.concat(head, F.lit("def run_"), key, F.lit("("), args, F.lit("):\n    return x\n"))
    raw = a.read(spark, sf_dir, "supplier").select(a.repo(), F.concat(F.lit("s"), key, F.lit(".py")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    files = facts.from_contents(raw)
    definitions = facts.tables(facts.facts_of(files))[1]
    return facts.command_helps(files, definitions).select("path", "name", "help")


_BREAK = "'\\r\\n|[\\n\\r' || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233) || ']'"


@query(f"""WITH x AS (SELECT doc_id, string_split_regex(text, {_BREAK}) AS l FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, CAST(l[-1] = '' AS INT) AS e, len(l) - CAST(l[-1] = '' AS INT) AS m FROM x)
  SELECT 'doc/' || doc_id AS path, CAST(CASE WHEN doc_id % 2 = 0 OR e = 1 THEN m + 1 ELSE m END AS INT) AS start, CAST(CASE WHEN doc_id % 2 = 0 THEN m + 2 + e WHEN e = 1 THEN m + 2 ELSE m + 1 END AS INT) AS stop FROM y""")
def text_spans(spark, sf_dir):
    """Texts that get two more lines, or whose last line is replaced and gets one more: what a line comparison of the whole texts finds."""
    d = a.read(spark, sf_dir, "documents")
    new = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n%% new\n%% newer"))).otherwise(F.concat("text", F.lit(" %% other\n%% newer")))
    pairs = d.select(a.repo(), a.node("doc", "doc_id").alias("path"), F.col("text").alias("base"), new.alias("text"))
    return line_diff.text_spans(pairs, a.PER_SPLIT * d.rdd.getNumPartitions()).select("path", "start", "stop")


@query("""SELECT 'customer/' || o_custkey AS path, CAST(4 * count(*) - 3 AS INT) AS start, CAST(4 * count(*) AS INT) AS stop FROM orders GROUP BY o_custkey HAVING count(*) >= 3
  UNION ALL SELECT 'customer/' || o_custkey, 2, 2 FROM orders GROUP BY o_custkey HAVING count(*) >= 3""")
def moved_blocks(spark, sf_dir):
    """Each customer's orders as blocks of four lines, two of which all blocks share; the first block is moved to the end and a line of the second replaced."""
    o = a.read(spark, sf_dir, "orders")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey"))).alias("blocks")).where("size(blocks) >= 3")
    block = lambda b: F.concat(F.lit("order "), b["o_orderkey"], F.lit("\n{\nof "), b["o_orderkey"], F.lit("\n}\n"))
    text = lambda blocks: F.array_join(F.transform(blocks, block), "")
    moved = text(F.concat(F.slice("blocks", F.lit(2), F.size("blocks") - 1), F.slice("blocks", 1, 1)))
    edited = F.regexp_replace(moved, r"^(order \d+\n)\{", "$1(")
    pairs = rows.select(a.repo(), a.node("customer", "o_custkey").alias("path"), text(F.col("blocks")).alias("base"), edited.alias("text"))
    return line_diff.text_spans(pairs, 8 * o.count() // line_diff.TASK_LINES).select("path", "start", "stop")


# Captions and labels


_BLOCK_SQL = """CASE l_linenumber % 7 WHEN 0 THEN 'Returns `total_' || l_partkey || '`.' WHEN 1 THEN 'Sets `qty` to `' || l_suppkey || '`.' WHEN 2 THEN 'Adds imports for `part_' || l_partkey || '` and 1 more.'
  WHEN 3 THEN 'Adds a new item to `rows`.' WHEN 4 THEN 'Calls `ship_' || l_suppkey || '(…)` here.' WHEN 5 THEN 'Added 2 blank lines.' ELSE 'Updates `qty` here.' END"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_BLOCK_SQL} AS detail FROM lineitem")
def block_captions(spark, sf_dir):
    """A block of source for every line item, captioned."""
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    texts = (
        F.concat(F.lit("    return total_"), part), F.concat(F.lit("    qty = "), supplier), F.concat(F.lit("from part_"), part, F.lit(" import x\nimport os")), F.concat(F.lit("    rows.append("), part, F.lit(")")),
        F.concat(F.lit("    ship_"), supplier, F.lit("(a)")), F.lit("\n"), F.concat(F.lit("    qty = f(g("), part, F.lit("))")),
    )
    text = F.element_at(F.array(*texts), (F.col("l_linenumber") % 7 + 1).cast("int"))
    rows = a.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.split(text, "\n").alias("lines"))
    return blocks.captioned(rows, "lines", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("""WITH u AS (SELECT n_nationkey, n_name, list_sort(list(DISTINCT 'c/' || c_custkey || '.py') FILTER (WHERE c_custkey IS NOT NULL)) AS l FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY ALL)
  SELECT n_nationkey, CASE WHEN l IS NULL THEN 'Part of a HIGH blast radius — ' || n_nationkey || CASE WHEN n_nationkey = 1 THEN ' downstream file may be affected.' ELSE ' downstream files may be affected.' END
    WHEN len(l) = 1 THEN '`' || l[1] || '` calls `load`.' WHEN len(l) = 2 THEN '`' || l[1] || '` and `' || l[2] || '` call `load`.' WHEN len(l) = 3 THEN '`' || l[1] || '`, `' || l[2] || '`, and `' || l[3] || '` call `load`.'
    ELSE '`' || l[1] || '`, `' || l[2] || '`, `' || l[3] || '`, and ' || (len(l) - 3) || ' more call `load`.' END AS impact,
    '🟠 HIGH — ' || CASE WHEN l IS NULL THEN 'Downstream dependents of this seed — a bad change can break code outside this file' WHEN len(l) = 1 THEN '`c/' || substr(l[1], 3) || '` — breaks if `load` misbehaves' ELSE len(l) || ' files call it — each breaks if `load` misbehaves' END AS implication
  FROM u WHERE l IS NOT NULL OR n_nationkey > 0""")
def impact_captions(spark, sf_dir):
    """Nations as changed symbols, their rich customers as proven users."""
    rich = a.read(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_set(F.concat(F.lit("c/"), F.col("c_custkey").cast("string"), F.lit(".py")))).alias("users"))
    rows = a.read(spark, sf_dir, "nation").join(rich, "n_nationkey", "left").where("users is not null or n_nationkey > 0").withColumn("users", F.coalesce("users", F.array().cast("array<string>"))).withColumn("importers", F.lit(None).cast("struct<first:array<string>,n:bigint>"))
    name, path, users, none, tier = F.lit("load"), F.lit("x/mod.py"), F.col("users"), F.array().cast("array<string>"), F.lit("HIGH")
    impact = captions.impact(name, F.lit("function"), path, users, resolve.importers_or_none(), F.lit(False), F.lit(False), F.col("n_nationkey"), tier)
    return rows.select("n_nationkey", impact.alias("impact"), captions.implication(name, path, users, none, F.lit(False), F.col("n_nationkey"), tier).alias("implication"))


class _Client:
    """Answers every pack with one sentence about its name."""

    def label(self, pack: dict) -> str:
        return f"Stores the value so that `{pack['name']}` can reuse it."


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(api[_-]?key|secret|token|password|passwd|authorization)\\s*[:=]\\s*[''"][^''"]{8,}') OR regexp_matches(text, '(?i)bearer\\s+[a-z0-9\\-._~+/]+=*') OR regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----')
  OR regexp_matches(text, '(?i)sk-[a-z0-9]{20,}') OR doc_id % 5 = 0 THEN NULL ELSE 'Stores the value so that `save_' || doc_id || '` can reuse it.' END AS label FROM documents""")
def pack_labels(spark, sf_dir):
    """A pack for every document: those with secrets in their lines, and those of tests, are not asked about."""
    key = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("tests/test_"), key, F.lit(".py"))).otherwise(F.concat(F.lit("a/"), key, F.lit(".py")))
    lines = F.array(F.struct(F.lit(1).alias("line"), F.coalesce("text", F.lit("")).alias("text")))
    none = F.array().cast("array<string>")
    values = {"path": path, "name": F.concat(F.lit("save_"), key), "kind": F.lit("function"), "risk_tier": F.lit("HIGH"), "who": F.lit("api"), "what": F.lit("fails"), "edit_lines": lines, "caption": F.lit("Calls `put(…)` here."), "purpose": F.lit(""), "readers": none, "importers": none}
    wanted: T.StructType = T.StructType.fromDDL(f"pack {labels.PACK}")["pack"].dataType
    pack = F.struct(*[values[f.name].alias(f.name) for f in wanted.fields])
    return labels.label_table(a.read(spark, sf_dir, "documents").select("doc_id", pack.alias("pack")), _Client).select("doc_id", "label")


# Reports


@query("""WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) SELECT 'n' || n_nationkey AS repo, CASE WHEN coalesce(n, 0) > 0 THEN 'full' ELSE 'pass_through' END AS mode,
  CASE WHEN coalesce(n, 0) >= 3 THEN 'CRITICAL' WHEN coalesce(n, 0) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier, CAST(coalesce(n, 0) AS BIGINT) AS n_downstream, CASE WHEN coalesce(n, 0) >= 3 THEN 1 ELSE 0 END AS n_danger,
  CASE WHEN n IS NULL THEN 'Edited' ELSE 'Returns `a + b`.' END AS detail FROM nation LEFT JOIN g ON c_nationkey = n_nationkey WHERE n IS NOT NULL""")
def audits(spark, sf_dir):
    """Every nation is a repository whose customers import one hub; its return was changed. All are audited in one call."""
    hub = "def find(a, b):\n    return a + b\n"
    repo = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo")
    c = a.read(spark, sf_dir, "customer")
    users = c.select(repo, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.lit("from hub import find\n\ndef use(x):\n    return find(x, 1)\n").alias("text"))
    hubs = c.select(repo).distinct().select("repo", F.lit("hub.py").alias("path"), F.lit(hub).alias("text"))
    files = facts.from_contents(users.unionByName(hubs).select("repo", "path", F.encode("text", "UTF-8").alias("content")))
    changed = hubs.select("repo", "path")
    spans = changed.select("repo", "path", F.lit(2).alias("start"), F.lit(2).alias("stop"))
    reports = Engine(spark, Tables.of(files)).audits(changed, spans)
    nodes = reports.nodes.groupBy("repo").agg(F.count_if(F.col("hops") > 0).alias("n_downstream"), F.count_if(F.col("hops") == 0).cast("int").alias("n_danger"))
    details = reports.symbols.groupBy("repo").agg(F.min_by("detail", F.struct("path", "line", "name")).alias("detail"))
    rows = reports.heads.select("repo", "mode", "risk_tier").join(nodes, "repo", "left").join(details, "repo", "left")
    return rows.select("repo", "mode", "risk_tier", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_downstream", "n_danger")], "detail")
