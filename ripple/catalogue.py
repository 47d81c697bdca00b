"""
Queries of the engine's own operators over the driver's tables, with DuckDB SQL for each that SQL can express.

Each query applies one operator to whole tables (see ``adapters``); the SQL computes the same rows in another way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as a
from .functions import predicates as p
from .functions import rules
from .functions import scalars as s
from .operators import graph, grounding, intervals, resolve, scoring, topk, uses

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import source_catalogue  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import source_catalogue  # noqa: F401

    return dict(_SQL)


def _seeds(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.createDataFrame([("r", x, k) for k, x in enumerate(paths)], "repo string, path string, ord int")


def _ids(spark: SparkSession, *seeds: tuple[str, int]) -> DataFrame:
    """Seeds of ``entity_ids``."""
    rows = spark.createDataFrame([("r", kind, key) for kind, key in seeds], "repo string, kind string, key long")
    return rows.select("repo", F.coalesce(*[F.when(F.col("kind") == k, a.entity_id(k, "key")) for k in a.KINDS[:-1]]).alias("path"))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("path", a.entity_path("path"))


def _closure_sql(view: str, name: str, seeds: str, extra: str = "", hops: int = 40) -> str:
    """Rings by a recursive union that is cut off at ``hops``; the least hop of each node."""
    return f"""WITH RECURSIVE {extra} {view}, w(path, hops) AS (SELECT path, 0 FROM ({seeds}) UNION SELECT e.src, w.hops + 1 FROM w JOIN {name} e ON e.dst = w.path WHERE w.hops < {hops}),
  m AS (SELECT path, CAST(min(hops) AS INT) AS hops FROM w GROUP BY path)"""


_TWO = "SELECT 'region/0' AS path UNION SELECT 'region/1'"


# Graph


@query(_closure_sql(a.ENTITY_SQL, "e", "SELECT 'region/0' AS path") + " SELECT path, hops FROM m WHERE hops > 0")
def rings_single(spark, sf_dir):
    return _named(graph.rings(a.entity_ids(spark, sf_dir), _ids(spark, ("region", 0)))).select("path", "hops")


@query(_closure_sql(a.ENTITY_SQL, "e", _TWO) + " SELECT path, hops FROM m WHERE hops > 0")
def rings_multi(spark, sf_dir):
    return _named(graph.rings(a.entity_ids(spark, sf_dir), _ids(spark, ("region", 0), ("region", 1)))).select("path", "hops")


@query(_closure_sql(a.CYCLIC_SQL, "c", "SELECT 'c/10' AS path", hops=200) + " SELECT path, hops FROM m WHERE hops > 0")
def rings_cyclic(spark, sf_dir):
    return graph.rings(a.cyclic_edges(spark, sf_dir), _seeds(spark, "c/10")).select("path", "hops")


def _kept_sql() -> str:
    """Level by level: kept files of a ring are those from which a path of any length leads to a kept file of the ring before."""
    out = _closure_sql(a.ENTITY_SQL, "e", "SELECT 'region/0' AS path") + ", k1 AS (SELECT path FROM m WHERE hops = 1 AND path IN (SELECT 'nation/' || c_nationkey FROM customer WHERE c_acctbal > 9900))"
    for n in (2, 3, 4):
        out += f", u{n}(path) AS (SELECT e.src FROM e JOIN k{n - 1} k ON e.dst = k.path UNION SELECT e.src FROM e JOIN u{n} u ON e.dst = u.path), k{n} AS (SELECT m.path FROM m WHERE hops = {n} AND path IN (SELECT path FROM u{n}))"
    return out + "".join(f"{' UNION ALL' * (n > 1)} SELECT path, CAST({n} AS INT) AS hops FROM k{n}" for n in (1, 2, 3, 4))


@query(_kept_sql())
def rings_minus_seeds_filtered(spark, sf_dir):
    edges = a.entity_ids(spark, sf_dir)
    steps = graph.prepared(edges)
    rings = graph.rings(edges, _ids(spark, ("region", 0)), steps=steps)
    rich = a.read(spark, sf_dir, "customer").where("c_acctbal > 9900").select(a.repo(), a.entity_id("nation", "c_nationkey").alias("path"))
    proven = rings.where("hops = 1").join(rich.distinct(), graph.ON, "left_semi")
    kept = graph.filter_rings(rings, edges, proven, steps=steps)
    steps.unpersist()
    return _named(kept).select("path", "hops")


@query(_closure_sql(a.ENTITY_SQL, "e", "SELECT 'nation/3' AS path UNION SELECT 'nation/7'") + " SELECT path FROM m WHERE hops > 0 AND path LIKE 'order/%'")
def reach_any(spark, sf_dir):
    edges = a.entity_ids(spark, sf_dir)
    orders = a.read(spark, sf_dir, "orders").select(a.repo(), a.entity_id("order", "o_orderkey").alias("path")).distinct()
    return _named(graph.reaches_any(edges, orders, _ids(spark, ("nation", 3), ("nation", 7)))).select("path")


_SMALL = "path LIKE 'region/%' OR path LIKE 'nation/%' OR path LIKE 'supplier/%'"


def _small_nodes(edges: DataFrame) -> DataFrame:
    every = edges.select("repo", F.col("src").alias("path")).unionByName(edges.select("repo", F.col("dst").alias("path"))).distinct()
    return every.where(F.col("path").rlike("^(region|nation|supplier)/"))


@query(f"WITH {a.ENTITY_SQL}, k AS (SELECT path FROM (SELECT src AS path FROM e UNION SELECT dst FROM e) WHERE {_SMALL}) SELECT dst AS origin, src AS target FROM e WHERE src IN (SELECT path FROM k) AND dst IN (SELECT path FROM k)")
def induced_edges(spark, sf_dir):
    edges = a.entity_edges(spark, sf_dir)
    return graph.induced_edges(edges, _small_nodes(edges)).select("origin", "target")


@query(f"WITH {a.ENTITY_SQL} SELECT 'nation/' || n_nationkey AS origin, 'supplier/' || s_suppkey AS target FROM nation, supplier WHERE s_suppkey % 25 = n_nationkey EXCEPT SELECT dst, src FROM e")
def edge_violations(spark, sf_dir):
    supplier = a.read(spark, sf_dir, "supplier")
    drawn = supplier.join(a.read(spark, sf_dir, "nation"), F.col("s_suppkey") % 25 == F.col("n_nationkey")).select(a.repo(), a.node("nation", "n_nationkey").alias("origin"), a.node("supplier", "s_suppkey").alias("target"))
    return graph.edge_violations(drawn, a.entity_edges(spark, sf_dir)).select("origin", "target")


# Joins


@query(f"WITH {a.LINKS_SQL} SELECT 'page/' || page_id AS src, module AS dst, string_agg(CAST(ordinal + 1 AS VARCHAR), ',' ORDER BY ordinal) AS lines FROM h GROUP BY ALL")
def edge_proofs(spark, sf_dir):
    links = a.page_links(spark, sf_dir).withColumn("target", F.col("module"))
    edges = resolve.build_edges(links)
    return edges.select("src", "dst", F.array_join(F.transform("imports", lambda x: x["line"].cast("string")), ",").alias("lines"))


def _customer_imports(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = a.read(spark, sf_dir, "customer")
    imports = c.select(a.repo(), F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.lit(0).alias("ordinal"), F.concat(F.lit("nation."), F.col("c_nationkey").cast("string")).alias("module"), F.array("c_mktsegment").alias("symbols"), F.lit(1).alias("line"))
    nations = a.read(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"))
    rich = c.where("c_acctbal > 9000").select(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_mktsegment"), F.lit(".py")).alias("path")).distinct()
    return imports, nations.unionByName(rich).withColumn("repo", a.repo())


@query("""WITH x AS (SELECT DISTINCT 'nation/' || c_nationkey || '/' || c_mktsegment AS f FROM customer WHERE c_acctbal > 9000)
  SELECT 'customer/' || c_custkey || '.py' AS path, 'nation/' || c_nationkey || '.py' AS target FROM customer
  UNION ALL SELECT 'customer/' || c_custkey || '.py', f || '.py' FROM customer JOIN x ON f = 'nation/' || c_nationkey || '/' || c_mktsegment""")
def import_resolution(spark, sf_dir):
    return resolve.resolve_imports(*_customer_imports(spark, sf_dir)).select("path", "target")


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*[^/?#])', 1) || '.js' AS path FROM pages), k AS (
    SELECT path, 0 AS r, path AS key FROM p UNION ALL SELECT path, 1, regexp_replace(path, '[.][^./]+$', '') FROM p)
  SELECT key, arg_min(path, struct_pack(r := r, o := string_split(path, '/'))) AS target FROM k GROUP BY key""")
def js_path_index(spark, sf_dir):
    pages = a.read(spark, sf_dir, "pages")
    files = pages.select(a.repo(), F.concat(F.regexp_extract("url", r"^[a-z]+://([^?#]*[^/?#])", 1), F.lit(".js")).alias("path")).distinct()
    return resolve.script_index(files).select("key", "target")


@query(f"""WITH {a.LINKS_SQL}, t AS (SELECT page_id, ordinal, list_concat([''], string_split('sub/x/../../' || CASE WHEN page_id % 3 = 0 THEN '../' ELSE './' END || module, '/')) AS l FROM h),
  r AS (SELECT page_id, ordinal, list_reduce(l, lambda x, p: CASE WHEN starts_with(x, '!') THEN x WHEN p IN ('', '.') THEN x WHEN p <> '..' THEN x || '/' || p WHEN x = '' THEN '!' ELSE regexp_replace(x, '/[^/]*$', '') END) AS x FROM t)
  SELECT page_id, CAST(ordinal AS INT) AS ordinal, CASE WHEN starts_with(x, '!') THEN NULL ELSE substr(x, 2) END AS target FROM r""")
def relative_norm(spark, sf_dir):
    """Every href of every page, below folders that are left again; a third climbs out of the repository."""
    links = a.page_links(spark, sf_dir).withColumn("page_id", F.substring_index("path", "/", -1).cast("long"))
    up = F.when(F.col("page_id") % 3 == 0, "../").otherwise("./")
    return links.select("page_id", F.col("ordinal").cast("int").alias("ordinal"), resolve.normalized(F.concat(F.lit("sub/x/../../"), up, F.col("module"))).alias("target"))


@query("""WITH i AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), c AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40)
  SELECT 'part' || p_partkey AS name, count(*) AS n_users FROM part JOIN i ON i.l_partkey = p_partkey WHERE EXISTS (SELECT 1 FROM c WHERE c.l_partkey = i.l_partkey AND c.l_suppkey = i.l_suppkey) GROUP BY ALL""")
def symbol_uses(spark, sf_dir):
    """Parts are the symbols of one module; suppliers import them by their lines and call them by their large ones."""
    line = a.read(spark, sf_dir, "lineitem")
    path, name = F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string"), F.lit(".py")), F.concat(F.lit("part"), F.col("l_partkey").cast("string"))
    rows = line.select(a.repo(), path.alias("path"), name.alias("name"), F.col("l_orderkey").cast("int").alias("ordinal"), F.col("l_linenumber").alias("line"), "l_quantity")
    per_part = rows.select("repo", "path", "name").distinct()
    module = lambda: F.concat(F.lit("parts."), F.col("name"))  # noqa: E731  one module for each part: the edge then is the equi-key
    seed = F.concat(F.lit("parts/"), F.col("name"), F.lit(".py"))
    edges = per_part.select("repo", F.col("path").alias("src"), seed.alias("dst"))
    imports = rows.groupBy("repo", "path", "name").agg(F.min("ordinal").alias("ordinal"), F.min("line").alias("line")).select("repo", "path", "ordinal", module().alias("module"), F.array("name").alias("symbols"), "line")
    calls = rows.where("l_quantity > 40").groupBy("repo", "path", "name").agg(F.min("ordinal").alias("ordinal"), F.min("line").alias("line")).select("repo", "path", "ordinal", F.col("name").alias("callee"), "line")
    symbols = a.read(spark, sf_dir, "part").select(a.repo(), F.concat(F.lit("parts/part"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), F.lit("function").alias("kind"))
    return uses.symbol_users(symbols, edges, imports, calls).groupBy("name").agg(F.count("*").alias("n_users"))


# Aggregation and scoring


@query(f"WITH {a.ENTITY_SQL} SELECT dst AS path, count(*) AS in_degree FROM e GROUP BY dst")
def in_degree(spark, sf_dir):
    return scoring.in_degree(a.entity_edges(spark, sf_dir)).select("path", "in_degree")


@query(f"WITH {a.ENTITY_SQL}, g AS (SELECT dst, count(*) AS n FROM e GROUP BY dst) SELECT path, CAST(coalesce(n, 0) AS BIGINT) AS in_degree, coalesce(n, 0) >= 20 AS is_danger FROM (SELECT src AS path FROM e UNION SELECT dst FROM e) LEFT JOIN g ON dst = path")
def hub_flag(spark, sf_dir):
    return scoring.marked(scoring.degrees(a.entity_edges(spark, sf_dir)), 20).select("path", "in_degree", "is_danger")


_PAGE_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/', '')"


@query(f"SELECT page_id, {_PAGE_PATH} AS path, ('/' || {_PAGE_PATH}) LIKE '%/api/%' OR ('/' || {_PAGE_PATH}) LIKE '%/routes/%' OR ('/' || {_PAGE_PATH}) LIKE '%/routers/%' OR ('/' || {_PAGE_PATH}) LIKE '%/migrations/%' OR ('/' || {_PAGE_PATH}) LIKE '%/models/%' OR regexp_extract({_PAGE_PATH}, '[^/]*$') IN ('models.py', 'schema.prisma', 'settings.py', 'config.py') AS is_danger FROM pages")
def danger_path(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    return a.read(spark, sf_dir, "pages").select("page_id", path.alias("path"), p.is_danger_path(path).alias("is_danger"))


@query(_closure_sql(a.ENTITY_SQL, "e", "SELECT 'region/0' AS path", "") + """, g AS (SELECT dst, count(*) AS n FROM e GROUP BY dst)
  SELECT hops, coalesce(n, 0) >= 3 AS is_danger, count(*) AS n FROM m LEFT JOIN g ON dst = path WHERE hops > 0 GROUP BY ALL""".replace("coalesce(n, 0)", "coalesce(g.n, 0)"))
def classify_split(spark, sf_dir):
    edges = a.entity_edges(spark, sf_dir).withColumn("imports", F.array(F.struct(F.lit(1).alias("line"), F.col("dst").alias("module"))))
    rings = graph.rings(edges, _seeds(spark, "region/0"))
    return scoring.classify(rings, edges, _seeds(spark, "region/0")).groupBy("hops", "is_danger").agg(F.count("*").alias("n"))


def _with_danger(edges: DataFrame, seeds: DataFrame, fan_out: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rings over ``entity_ids`` with is_danger; the steps of the fixpoint give the in-degrees as well, of which only those of hubs matter."""
    steps = graph.prepared(edges)
    rings = graph.rings(edges, seeds, by=by, steps=steps)
    hubs = graph.cut_lineage(scoring.hubs(steps, fan_out))
    steps.unpersist()
    return scoring.marked(_named(rings.join(graph.small(hubs), graph.ON, "left")), fan_out)


_TRACE_SQL = _closure_sql(a.ENTITY_SQL, "e", "SELECT 'region/0' AS path") + """, g AS (SELECT dst, count(*) AS n FROM e GROUP BY dst),
  f AS (SELECT hops, coalesce(n, 0) >= 3 AS is_danger FROM m LEFT JOIN g ON dst = path WHERE hops > 0), t AS (SELECT count(*) AS d, max(hops) AS h, count_if(is_danger) AS z FROM f)
  SELECT hops, is_danger, count(*) AS n, CASE WHEN d = 0 AND z = 0 THEN 'LOW' WHEN z > 0 AND (d >= 3 OR h >= 2) THEN 'CRITICAL' WHEN z > 0 OR d >= 3 OR h >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_tier FROM f, t GROUP BY hops, is_danger, d, h, z"""


@query(_TRACE_SQL)
def trace_region(spark, sf_dir):
    """Rings of a region, danger zones among them, and the risk: the flagship query."""
    rows = _with_danger(a.entity_ids(spark, sf_dir), _ids(spark, ("region", 0)), rules.FAN_OUT).persist()
    tier = scoring.risk(rows).select("repo", "risk_tier")
    return rows.groupBy("repo", "hops", "is_danger").agg(F.count("*").alias("n")).join(F.broadcast(tier), "repo").select("hops", "is_danger", "n", "risk_tier")


@query(f"""WITH RECURSIVE {a.ENTITY_SQL}, w(seed, path, hops) AS (SELECT 'region/' || r_regionkey, 'region/' || r_regionkey, 0 FROM region UNION SELECT w.seed, e.src, w.hops + 1 FROM w JOIN e ON e.dst = w.path WHERE w.hops < 40),
  m AS (SELECT seed, path, min(hops) AS hops FROM w GROUP BY ALL HAVING min(hops) > 0), g AS (SELECT dst, count(*) AS n FROM e GROUP BY dst),
  t AS (SELECT seed, count(*) AS n_downstream, CAST(max(hops) AS INT) AS max_hops, CAST(count_if(coalesce(n, 0) >= 20) AS BIGINT) AS n_danger FROM m LEFT JOIN g ON dst = path GROUP BY seed)
  SELECT *, CASE WHEN n_danger > 0 AND (n_downstream >= 3 OR max_hops >= 2) THEN 'CRITICAL' WHEN n_danger > 0 OR n_downstream >= 3 OR max_hops >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_tier FROM t""")
def risk_by_seed(spark, sf_dir):
    """All regions at once: the seed is part of the frontier's key, so one fixpoint serves every seed."""
    region = a.entity_id("region", "r_regionkey")
    seeds = a.read(spark, sf_dir, "region").select(a.repo(), region.alias("path"), region.alias("seed"))
    rings = _with_danger(a.entity_ids(spark, sf_dir), seeds, 20, ("seed",))
    return scoring.risk(rings, ("seed",)).select(a.entity_path("seed").alias("seed"), "n_downstream", "max_hops", "n_danger", "risk_tier")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS q, max(l_quantity) > 40 AS seed, max(l_suppkey) AS s FROM lineitem GROUP BY ALL), y AS (
    SELECT l_orderkey, count_if(seed) AS n_seeds, count(*) - count_if(seed) AS n_down, CAST(count_if(seed) AS BIGINT) AS lines, coalesce(bool_or(seed AND s % 10 = 0), false) AS by_path, coalesce(bool_and(CASE WHEN seed THEN s % 3 = 0 AND s % 10 <> 0 END), true) AS tests FROM x GROUP BY ALL)
  SELECT l_orderkey, CASE WHEN n_seeds = 0 OR tests THEN false WHEN by_path THEN true WHEN lines <= 5 AND n_down < 2 THEN false ELSE n_down >= 2 OR n_down > 0 END AS emit FROM y""")
def trigger_decision(spark, sf_dir):
    """Orders as change sets: large lines are seeds, the others are downstream; supplier numbers stand for api and test paths."""
    x = a.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity") > 40).alias("is_seed"), F.max("l_suppkey").alias("s"))
    path = F.when(F.col("s") % 10 == 0, F.concat(F.lit("x/api/"), F.col("s").cast("string"), F.lit(".py"))).when(F.col("s") % 3 == 0, F.concat(F.lit("tests/"), F.col("s").cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("x/"), F.col("s").cast("string"), F.lit(".py")))
    n = x.groupBy("l_orderkey").agg(F.count_if(~F.col("is_seed")).alias("n_downstream"), F.count_if("is_seed").alias("n_lines"))
    rows = x.select("l_orderkey", path.alias("path"), "is_seed", F.lit(0).alias("in_degree")).join(n, "l_orderkey").withColumn("has_downstream", F.col("n_downstream") > 0)
    return scoring.trigger(rows, ("l_orderkey",))


@query(f"WITH {a.SPANS_SQL} SELECT path, CAST(sum(CASE WHEN stop >= start THEN stop - start + 1 ELSE 0 END) AS BIGINT) AS n_lines FROM v GROUP BY path")
def changed_line_count(spark, sf_dir):
    return intervals.changed_line_count(a.event_spans(spark, sf_dir), ["path"])


@query(f"""WITH {a.LINKS_SQL}, {a.LINES_SQL}, f AS (SELECT 'page/' || page_id AS path, count(*) AS n_imports, 0 AS n_defs, 0 AS n_calls FROM h GROUP BY ALL
  UNION ALL SELECT path, 0, count(*), count_if(trim(text) <> '') FROM n GROUP BY path)
  SELECT path, CAST(sum(n_imports) AS BIGINT) AS n_imports, CAST(sum(n_defs) AS BIGINT) AS n_defs, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM f GROUP BY ROLLUP (path)""")
def scan_totals(spark, sf_dir):
    zero = F.lit(0).cast("long")
    links = a.page_links(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n_imports"), zero.alias("n_defs"), zero.alias("n_calls"))
    lines = a.document_lines(spark, sf_dir).groupBy("path").agg(zero.alias("n_imports"), F.count("*").alias("n_defs"), F.count_if(F.trim("text") != "").alias("n_calls"))
    return scoring.scan_totals(links.unionByName(lines))


# Intervals


@query(f"""WITH {a.SPANS_SQL}, x AS (SELECT *, CASE WHEN start <= 1 + max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM v WHERE stop >= start),
  y AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM x) SELECT path, min(start) AS start, max(stop) AS stop FROM y GROUP BY path, island""")
def coalesce_spans(spark, sf_dir):
    return intervals.coalesce_spans(a.event_spans(spark, sf_dir)).select("path", "start", "stop")


@query(f"WITH {a.LINES_SQL}, k AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS i FROM n WHERE contains(text, ',')) SELECT path, CAST(min(line) AS INT) AS start, CAST(max(line) AS INT) AS stop, count(*) AS n_lines FROM k GROUP BY path, i")
def line_runs(spark, sf_dir):
    lines = a.document_lines(spark, sf_dir).where(F.contains("text", F.lit(",")))
    return intervals.line_runs(lines).select("path", "start", "stop", "n_lines")


@query(f"WITH {a.BODIES_SQL} SELECT path, line, CAST(stop AS INT) AS stop FROM d")
def body_spans(spark, sf_dir):
    return intervals.body_spans(a.order_definitions(spark, sf_dir)).select("path", "line", "stop")


@query(f"WITH {a.BODIES_SQL} SELECT d.path, 'def_' || d.line AS name, string_agg(CAST(s.line AS VARCHAR), ',' ORDER BY s.line) AS changed_lines FROM d JOIN s ON s.path = d.path AND s.line BETWEEN d.start AND d.stop GROUP BY d.path, d.line")
def touched_symbols(spark, sf_dir):
    got = intervals.changed_symbols(a.order_definitions(spark, sf_dir), a.order_spans(spark, sf_dir))
    return got.select("path", "name", F.array_join(F.col("changed_lines").cast("array<string>"), ",").alias("changed_lines"))


@query(f"""WITH {a.BODIES_SQL}, o AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = s.path AND s.line BETWEEN d.start AND d.stop)),
  k AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS i FROM o) SELECT path, min(line) AS start, max(line) AS stop, count(*) AS n_lines FROM k GROUP BY path, i""")
def orphan_lines(spark, sf_dir):
    return intervals.orphan_runs(a.order_definitions(spark, sf_dir), a.order_spans(spark, sf_dir)).select("path", "start", "stop", "n_lines")


@query(f"WITH {a.LINES_SQL} SELECT path, bool_and(trim(text, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) = '' OR regexp_matches(trim(text), '^(#|//|/\\*|\\*)')) AS comment_only FROM n GROUP BY path")
def comment_only(spark, sf_dir):
    return a.document_lines(spark, sf_dir).groupBy("path").agg(F.bool_and(p.is_comment_or_blank("text")).alias("comment_only"))


@query(f"""WITH {a.LINES_SQL}, f AS (SELECT path, line AS at_line FROM n WHERE trim(text, ' ') <> ''), w AS (SELECT path, line FROM n),
  j AS (SELECT w.path, w.line, at_line, CASE WHEN at_line >= w.line THEN at_line - w.line ELSE 12 + w.line - at_line END AS r FROM w JOIN f ON f.path = w.path AND abs(at_line - w.line) <= 12),
  b AS (SELECT path, line, arg_min(at_line, r) AS c FROM j GROUP BY ALL) SELECT w.path, CAST(w.line AS INT) AS line, CAST(coalesce(c, w.line) AS INT) AS code_line FROM w LEFT JOIN b ON b.path = w.path AND b.line = w.line""")
def code_lines(spark, sf_dir):
    lines = a.document_lines(spark, sf_dir)
    return intervals.next_to(lines, lines.select("repo", "path", "line")).select("path", "line", "code_line")


# Top k, caps


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
  SELECT o_custkey, o_orderkey, CAST(nth AS INT) AS nth, CAST(greatest(n - 8, 0) AS BIGINT) AS n_more FROM r WHERE nth <= 8""")
def top8_overflow(spark, sf_dir):
    o = a.read(spark, sf_dir, "orders")
    return topk.top_with_overflow(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], rules.REPORT_BULLETS).select("o_custkey", "o_orderkey", "nth", "n_more")


@query(_closure_sql(a.ENTITY_SQL, "e", _TWO) + ", k AS (SELECT path, hops, row_number() OVER (ORDER BY hops, path) AS nth FROM m) SELECT path, hops, CAST(nth AS INT) AS nth FROM k WHERE nth <= 15 OR hops = 0")
def select15(spark, sf_dir):
    reached = graph.closure(a.entity_ids(spark, sf_dir), _ids(spark, ("region", 0), ("region", 1)))
    return topk.select_nodes(_named(reached)).select("path", "hops", "nth")


@query(f"""WITH {a.ENTITY_SQL}, g AS (SELECT dst, list_sort(list(src)) AS l FROM e GROUP BY dst)
  SELECT dst AS path, CASE WHEN len(l) = 1 THEN '`' || l[1] || '`' WHEN len(l) = 2 THEN '`' || l[1] || '` and `' || l[2] || '`' WHEN len(l) = 3 THEN '`' || l[1] || '`, `' || l[2] || '`, and `' || l[3] || '`'
  ELSE '`' || l[1] || '`, `' || l[2] || '`, `' || l[3] || '`, and ' || (len(l) - 3) || ' more' END AS importers FROM g""")
def path_list(spark, sf_dir):
    return resolve.listed_importers(a.entity_ids(spark, sf_dir), name=a.entity_path).select(a.entity_path("path").alias("path"), s.path_list(F.col("importers.first"), n=F.col("importers.n")).alias("importers"))


@query("""WITH i AS (SELECT user_id, event_id AS pos, CASE event_type WHEN 'view' THEN 'graph_importer' WHEN 'click' THEN 'docstring' WHEN 'purchase' THEN 'heuristic_name' ELSE 'call' END AS kind, CASE WHEN value > 50 THEN 'proven' ELSE 'heuristic' END AS confidence FROM events),
  o AS (SELECT user_id, kind, pos, row_number() OVER (PARTITION BY user_id ORDER BY (CASE kind WHEN 'docstring' THEN 1 WHEN 'heuristic_name' THEN 6 ELSE 5 END) + CASE WHEN confidence = 'proven' THEN 0 ELSE 10 END, pos) AS slot FROM i WHERE kind <> 'graph_importer'),
  u AS (SELECT user_id, least(count(*), 2) AS used FROM o GROUP BY ALL), h AS (SELECT user_id, count(*) AS n, min(pos) AS p FROM i WHERE kind = 'graph_importer' GROUP BY ALL)
  SELECT user_id, kind, CAST(pos AS VARCHAR) AS fact, CAST(slot AS INT) AS slot FROM o WHERE slot <= 2
  UNION ALL SELECT h.user_id, 'graph_importer', CASE WHEN n = 1 THEN CAST(p AS VARCHAR) ELSE n || ' files import this module — open the report for the map' END, CAST(coalesce(used, 0) + 1 AS INT) FROM h LEFT JOIN u ON u.user_id = h.user_id WHERE coalesce(used, 0) < 2""")
def evidence_topk(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "view", "graph_importer").when(t == "click", "docstring").when(t == "purchase", "heuristic_name").otherwise("call")
    items = a.read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), kind.alias("kind"), F.when(F.col("value") > 50, "proven").otherwise("heuristic").alias("confidence"), F.lit("x").alias("location"), F.col("event_id").cast("string").alias("fact"))
    return topk.compact_evidence(items, ["user_id"]).select("user_id", "kind", "fact", "slot")


@query(f"WITH {a.LINES_SQL}, k AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS nth, sum(length(text)) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) AS chars FROM n) SELECT path, CAST(line AS INT) AS line, CAST(chars AS BIGINT) AS chars FROM k WHERE nth <= 20 AND chars <= 1500")
def capped_lines(spark, sf_dir):
    return topk.capped_lines(a.document_lines(spark, sf_dir), ["path"]).select("path", "line", "chars")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedupe_first(spark, sf_dir):
    e = a.read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.lit("proven").alias("confidence"), F.lit("").alias("fact"), F.col("event_id").alias("pos"))
    return topk.dedupe_evidence(e, ["user_id"]).select("user_id", F.col("kind").alias("event_type"), F.col("pos").alias("event_id"))


@query(f"""WITH {a.ENTITY_SQL}, k AS (SELECT path, split_part(path, '/', 1) AS layer FROM (SELECT src AS path FROM e UNION SELECT dst FROM e)), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY path) AS nth FROM k)
  SELECT layer, count(*) AS n, string_agg(path, ',' ORDER BY path) FILTER (WHERE nth <= 15) AS paths FROM r GROUP BY layer""")
def layer_groups(spark, sf_dir):
    edges = a.entity_edges(spark, sf_dir)
    every = edges.select("repo", F.col("src").alias("path")).unionByName(edges.select("repo", F.col("dst").alias("path")))
    return topk.layer_groups(every).select("layer", "n", F.array_join("paths", ",").alias("paths"))


# Sets and scalars


@query("SELECT o_orderkey AS key FROM orders WHERE o_totalprice > 100000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08")
def union_changed(spark, sf_dir):
    from .sources.overlay import changed_paths

    o, line = a.read(spark, sf_dir, "orders"), a.read(spark, sf_dir, "lineitem")
    own = lambda df, key, origin: df.select(a.repo(), F.col(key).cast("string").alias("path"), F.lit(origin).alias("origin"))
    got = changed_paths(own(o.where("o_totalprice > 100000"), "o_orderkey", "worktree"), own(line.where("l_quantity > 45"), "l_orderkey", "index"), own(line.where("l_discount > 0.08"), "l_orderkey", "untracked"))
    return got.select(F.col("path").cast("long").alias("key"))


@query("""WITH l AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY ALL) SELECT coalesce(l.conv_id, d.doc_id) AS doc_id, coalesce(l.text, d.text) AS text FROM documents d FULL JOIN l ON l.conv_id = d.doc_id""")
def overlay_upsert(spark, sf_dir):
    from .sources.overlay import latest, upsert

    talk = latest(a.read(spark, sf_dir, "conversations"), ["conv_id"], "turn").select(F.col("conv_id").alias("doc_id"), "text")
    return upsert(a.read(spark, sf_dir, "documents").select("doc_id", "text"), talk, ["doc_id"])


@query("SELECT event_id, unnest(json_keys(props)) AS path, json_extract_string(props, '$.' || unnest(json_keys(props))) AS text FROM events")
def props_json(spark, sf_dir):
    from .sources.overlay import parse_overlays

    return parse_overlays(a.read(spark, sf_dir, "events"), "props", keep=["event_id"])


@query("""SELECT doc_id, regexp_matches(text, '(?i)(api[_-]?key|secret|token|password|passwd|authorization)\\s*[:=]\\s*[''"][^''"]{8,}') OR regexp_matches(text, '(?i)bearer\\s+[a-z0-9\\-._~+/]+=*')
  OR regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----') OR regexp_matches(text, '(?i)sk-[a-z0-9]{20,}') AS has_secret FROM documents""")
def secrets(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").select("doc_id", p.looks_like_secret("text").alias("has_secret"))


@query("""SELECT doc_id, string_agg(w, ',' ORDER BY w) AS ids FROM (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]*')), '[.]+$', '') AS x FROM documents) t, (VALUES (0), (1)) k(i), LATERAL (SELECT CASE WHEN i = 0 THEN x ELSE regexp_extract(x, '[^.]*$') END AS w) WHERE w NOT IN ('if', 'else', 'for', 'return', 'def', 'class')) GROUP BY doc_id""")
def identifiers(spark, sf_dir):
    ids = s.identifiers("text")
    some = F.filter(F.array(F.array_join(ids, ",")), lambda x: x != "")  # exploded: a condition on the column would compute it twice
    return a.read(spark, sf_dir, "documents").select("doc_id", F.explode(some).alias("ids"))


@query("SELECT conv_id, turn, CAST(greatest(1, len(regexp_extract_all(trim(text), '[.!?](\\s+|$)'))) AS INT) AS n_sentences FROM conversations")
def sentence_counts(spark, sf_dir):
    return a.read(spark, sf_dir, "conversations").select("conv_id", "turn", s.sentence_count("text").cast("int").alias("n_sentences"))


def _acronym_sql() -> str:
    t = "replace(replace(text, 'the', 'AST'), '(', '[')"
    for short, full in rules.ACRONYMS:
        t = f"(SELECT CASE WHEN strpos(x, '{short} ({full})') = 0 THEN regexp_replace(x, '\\b{short}\\b', '{short} ({full})') ELSE x END FROM (SELECT {t} AS x))"
    return f"SELECT doc_id, {t} AS text FROM documents"


@query(_acronym_sql())
def acronym_first(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit("the"), F.lit("AST")), F.lit("("), F.lit("["))
    return a.read(spark, sf_dir, "documents").select("doc_id", s.expand_acronyms(text).alias("text"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 110 THEN t ELSE rtrim(substr(t, 1, 109)) || '…' END AS bullet FROM c""")
def clip_bullets(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").select("doc_id", s.clip_bullet("text").alias("bullet"))


@query("SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', 'X'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, trim(regexp_replace(lower(regexp_replace(replace(p_name, ' ', 'X'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_+', ' ', 'g'), ' ') AS human FROM part")
def snake_humanize(spark, sf_dir):
    name = F.translate("p_name", " ", "X")
    return a.read(spark, sf_dir, "part").select("p_partkey", s.snake(name).alias("snake"), s.humanize(name).alias("human"))


@query("SELECT page_id, 'n_' || regexp_replace(url, '[^\\pL\\pN]', '_', 'g') AS node FROM pages")
def node_ids(spark, sf_dir):
    return a.read(spark, sf_dir, "pages").select("page_id", s.node_id("url").alias("node"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").select("doc_id", s.content_hash("text").alias("digest"))


@query("""SELECT doc_id, sha256('{"model":"m","revision":"1","pack":{"doc_id":' || doc_id || ',"source":"' || source || '"}}') AS key FROM documents""")
def fingerprint(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").select("doc_id", s.fingerprint(F.struct("doc_id", "source"), F.lit("m")).alias("key"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(replace(text, '`', '')), '[^\\pL\\pN\\pM_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM conversations")
def normalize_compare(spark, sf_dir):
    return a.read(spark, sf_dir, "conversations").select("conv_id", "turn", s.normalize_compare("text").alias("plain"))


@query(_closure_sql(a.ENTITY_SQL, "e", _TWO) + " SELECT path, CASE WHEN hops <= 0 THEN ' (this is one of the files you changed)' WHEN hops = 1 THEN ' — it directly imports a file you changed' ELSE ' — ' || hops || ' import steps away from a file you changed' END AS phrase FROM m")
def distance_phrases(spark, sf_dir):
    reached = graph.closure(a.entity_edges(spark, sf_dir), _seeds(spark, "region/0", "region/1"))
    return reached.select("path", s.distance_phrase(F.col("hops")).alias("phrase"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_wins(spark, sf_dir):
    """The best order of each day, as the newest version of each path is chosen."""
    from .sources.overlay import latest

    rows = a.read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")).alias("version"))
    return latest(rows, ["day"], "version").select("day", "o_orderkey")


@query(f"""WITH {a.BODIES_SQL}, sy AS (SELECT path, line, 'symbol' AS kind, 'def_' || line AS text FROM d), o AS (SELECT path, line, 'line' AS kind, 'changed' AS text FROM s),
  se AS (SELECT DISTINCT path, 1 AS line, 'seed' AS kind, 'You changed this file.' AS text FROM s), im AS (SELECT 'order/' || o_orderkey AS path, 1 AS line, CASE WHEN o_totalprice > 200000 THEN 'danger' ELSE 'downstream' END AS kind, o_orderpriority AS text FROM orders),
  x AS (SELECT *, 0 AS r FROM sy UNION ALL SELECT *, 1 FROM o UNION ALL SELECT *, 2 FROM se UNION ALL SELECT *, CASE kind WHEN 'danger' THEN 3 ELSE 4 END FROM im)
  SELECT path, line, kind, text FROM (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY r, text) AS n FROM x) WHERE n = 1""")
def line_annotations(spark, sf_dir):
    from .plans import lenses

    symbols = a.order_definitions(spark, sf_dir).withColumn("detail", F.col("name"))
    spans = a.order_spans(spark, sf_dir)
    impact = a.read(spark, sf_dir, "orders").select(a.repo(), a.node("order", "o_orderkey").alias("path"), (F.col("o_totalprice") > 200000).alias("is_danger"), F.col("o_orderpriority").alias("reason"))
    orphans = spans.select("repo", "path", F.col("start").alias("line"), F.lit("changed").alias("detail"))
    tasks = a.PER_SPLIT * a.read(spark, sf_dir, "lineitem").rdd.getNumPartitions()
    return lenses.annotations(symbols, orphans, spans.select("repo", "path").distinct(), impact, tasks).select("path", "line", "kind", "text")


@query(f"WITH {a.LINES_SQL}, k AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS i FROM n WHERE contains(text, ',')), r AS (SELECT path, min(line) AS start FROM k GROUP BY path, i) SELECT path, CAST(start AS INT) AS start, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start) AS nth FROM r) WHERE nth <= 6")
def run_anchors(spark, sf_dir):
    from .plans import lenses

    return lenses.anchors(a.document_lines(spark, sf_dir).where(F.contains("text", F.lit(",")))).select("path", "start", "nth")


_CAPTION_SQL = "SELECT p_partkey, '`' || split_part(p_name, ' ', 1) || '` of `' || lower(split_part(p_type, ' ', 1)) || '(x)` ' || CASE p_size % 4 WHEN 0 THEN 'is defined here.' WHEN 1 THEN 'See implementation.' ELSE 'is ' || p_brand END AS t, string_split(lower(p_type), ' ') AS c FROM part"


@query(f"""WITH x AS ({_CAPTION_SQL}), k AS (SELECT p_partkey, t, c, list_transform(regexp_extract_all(t, '`([^`]+)`', 1), lambda z: lower(split_part(z, '(', 1))) AS names FROM x)
  SELECT p_partkey, len(list_filter(names, lambda z: NOT list_contains(c, z) AND len(list_filter(c, lambda y: len(z) > 2 AND len(y) > 2 AND (contains(y, z) OR contains(z, y)))) = 0)) > 0 AS unknown, regexp_matches(lower(t), 'is defined here|see implementation') AS weak FROM k""")
def caption_flags(spark, sf_dir):
    """Captions that name things the evidence does not know, and those that say nothing."""
    first = lambda c: F.substring_index(c, " ", 1)
    end = F.when(F.col("p_size") % 4 == 0, F.lit("is defined here.")).when(F.col("p_size") % 4 == 1, F.lit("See implementation.")).otherwise(F.concat(F.lit("is "), "p_brand"))
    text = F.concat(F.lit("`"), first("p_name"), F.lit("` of `"), F.lower(first("p_type")), F.lit("(x)` "), end)
    rows = a.read(spark, sf_dir, "part").select("p_partkey", text.alias("t"), F.split(F.lower("p_type"), " ").alias("c"))
    return rows.select("p_partkey", p.has_unknown_backticks("t", "c").alias("unknown"), p.is_weak_caption("t").alias("weak"))


@query("""WITH b AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^()\\[\\]{}]', '', 'g'), ''), lambda c: c <> '') AS l, text FROM documents)
  SELECT doc_id, CASE WHEN text IS NOT NULL THEN list_reduce(list_concat([''], l), lambda x, c: CASE WHEN starts_with(x, 'x') THEN x WHEN c IN ('(', '[', '{') THEN x || c WHEN right(x, 1) = translate(c, ')]}', '([{') THEN left(x, -1) ELSE 'x' END) = '' END AS balanced FROM b""")
def balanced_brackets(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").select("doc_id", p.brackets_balanced("text").alias("balanced"))


def _purpose_rules() -> list[tuple[str, str, str]]:
    """(kind, name with # for what it is about, phrase with {rest}) for every rule of a name."""
    from .functions import phrases as c

    return [*(("class", f"#{e}", t) for e, t in c.CLASS_SUFFIXES), *(("function", f"{b}#", t) for b, t in c.PREFIXES), *(("function", f"#{e}", t) for e, t in c.SUFFIXES)]


def _purposes_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {q(kind)}, {q(name)}, {q(text)})" for k, (kind, name, text) in enumerate(_purpose_rules()))
    return f"""WITH r(k, kind, name, phrase) AS (VALUES {rows}), n AS (SELECT p_partkey, kind, replace(name, '#', CASE WHEN kind = 'class' THEN 'Part' || p_partkey ELSE 'part' || p_partkey END) AS name, phrase, 'part' || p_partkey AS rest
  FROM part JOIN r ON k = p_partkey % {len(_purpose_rules())}) SELECT p_partkey, name, '`' || name || '` ' || replace(phrase, '{{rest}}', rest) AS purpose FROM n"""


@query(_purposes_sql())
def symbol_purposes(spark, sf_dir):
    """Each rule of names in turn, over all parts."""
    from .plans import captions

    table = spark.createDataFrame([(k, kind, name) for k, (kind, name, _) in enumerate(_purpose_rules())], "k int, kind string, pattern string")
    rows = a.read(spark, sf_dir, "part").withColumn("k", (F.col("p_partkey") % len(_purpose_rules())).cast("int")).join(F.broadcast(table), "k")  # a row for each rule
    about = F.concat(F.when(F.col("kind") == "class", "Part").otherwise("part"), F.col("p_partkey").cast("string"))
    rows = rows.select("p_partkey", F.replace("pattern", F.lit("#"), about).alias("name"), "kind", F.lit("a/b.py").alias("path"), F.lit("").alias("docstring"))
    return rows.select("p_partkey", "name", captions.purpose().alias("purpose"))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS l FROM conversations)
  SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN '' ELSE list_reduce(l, lambda x, w: CASE WHEN len(regexp_extract(x, '[^\n]*$')) + 1 + len(w) <= 40 THEN x || ' ' || w ELSE x || chr(10) || w END) END AS lines FROM t""")
def word_wrap(spark, sf_dir):
    return a.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(s.wrap("text", 40), "\n").alias("lines"))


def _docstrings_sql() -> str:
    from .functions import words as w

    many = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    stem = "lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN left(x, -1) ELSE x END"
    own = ["explain", "symbol", *w.SYNONYMS["explain"], *w.SYNONYMS["symbol"]]
    follow = [k for k, v in w.INFERABLE.items() if set(v) & set(own)]
    return f"""WITH d AS (SELECT doc_id, regexp_replace(string_split(trim(text, ' '), chr(10))[1], '\\.+$', '') AS t FROM documents WHERE text IS NOT NULL),
      x AS (SELECT doc_id, t, list_distinct(list_transform(regexp_extract_all(lower(t), '[a-z0-9]+'), {stem})) AS said FROM d),
      n AS (SELECT doc_id, t, len(list_filter(said, lambda x: NOT list_contains({many(w.STOP_WORDS)}, x))) AS spoken, len(list_filter(said, lambda x: list_contains({many(own)}, x))) AS named,
        len(list_filter(said, lambda x: NOT list_contains({many([*w.STOP_WORDS, *w.GENERIC_VERBS, *w.SURFACE_WORDS, *own, *follow])}, x))) AS news FROM x)
      SELECT doc_id, t <> '' AND (length(t) > {w.TELLING_CHARS} OR regexp_matches(lower(t), '{w.TELLING}') OR regexp_matches(t, '["''`]|[0-9]|::|->')
        OR (news > 0 AND NOT (named >= {w.OVERLAP} * greatest(spoken, 1) AND length(t) < {w.BRIEF_CHARS}))) AS adds FROM n"""


@query(_docstrings_sql())
def docstrings(spark, sf_dir):
    """Whether each document's first line, as the docstring of a function explain_symbol, says more than its name."""
    from .plans import captions

    first = F.split(F.btrim("text"), "\n")[0]
    return a.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", captions.doc_adds_value(F.lit("explain_symbol"), first).alias("adds"))


_NAME = "[A-Za-z_][A-Za-z0-9_]*"


@query(f"""WITH e AS (SELECT DISTINCT lower(x) AS e FROM (SELECT p_name AS x FROM part UNION ALL SELECT unnest(regexp_extract_all(text, '{_NAME}')) FROM benchmark) WHERE x IS NOT NULL),
  d AS (SELECT DISTINCT doc_id, lower(w) AS t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_NAME}')) AS w FROM documents)), t AS (SELECT DISTINCT t FROM d),
  s AS (SELECT DISTINCT t FROM t JOIN e ON t = e OR (length(t) > 2 AND length(e) > 2 AND (contains(t, e) OR contains(e, t))))
  SELECT doc_id, count(*) AS n_names, count(*) FILTER (WHERE s.t IS NULL) AS n_unsupported, min(d.t) FILTER (WHERE s.t IS NULL) AS first_unsupported FROM d LEFT JOIN s ON s.t = d.t GROUP BY doc_id""")
def grounded_names(spark, sf_dir):
    """Of each document's names those that neither the parts' names nor the benchmark's words support."""
    entries = a.read(spark, sf_dir, "part").select(F.col("p_name").alias("entry"))
    entries = entries.unionByName(a.read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_NAME), 0)).alias("entry")))
    docs = a.read(spark, sf_dir, "documents").select("doc_id", "text")
    known = graph.cut_lineage(grounding.name_set(docs))
    # a name's rank has the order of names: the least is found among whole numbers, without sorting all names of all documents
    told = grounding.supported(known, graph.cut_lineage(entries.distinct()))
    told = graph.cut_lineage(told.orderBy("name").withColumn("rank", F.monotonically_increasing_id()))
    names = grounding.names_of(docs, "doc_id").repartition("name")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # several texts of one document may have a name in common
        names = names.distinct()
    lacking = F.when(~F.col("supported"), F.col("rank"))
    found = names.join(told.hint("shuffle_hash"), "name").groupBy("doc_id").agg(F.count("*").alias("n_names"), F.count(lacking).alias("n_unsupported"), F.min(lacking).alias("rank"))
    return found.join(told.select("rank", F.col("name").alias("first_unsupported")), "rank", "left").select("doc_id", "n_names", "n_unsupported", "first_unsupported")
