"""The driver's tables as the engine's inputs: entity edges, cyclic edges, links, lines, spans, definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def repo() -> Column:
    """The one repository that the tables stand for."""
    return F.lit("r").alias("repo")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


#: (referencing kind, its table, its key, referenced kind, foreign key)
KEYS = (
    ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
    ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    ("order", "orders", "o_orderkey", "customer", "o_custkey"),
    ("line", "lineitem", None, "order", "l_orderkey"),
    ("line", "lineitem", None, "supplier", "l_suppkey"),
)


def entity_edges(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None) -> DataFrame:
    """(repo, src, dst): an entity imports the one that its foreign key names. Lines that a table repeats repeat their edges, which every operator allows."""
    out = None
    for kind, table, key, to, foreign in KEYS:
        if tables is not None and table not in tables:
            continue
        src = node(kind, key) if key else F.concat(F.lit("line/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        some = read(spark, sf_dir, table).select(repo(), src.alias("src"), node(to, foreign).alias("dst"))
        out = some if out is None else out.unionByName(some)
    return out


#: Kinds of entities, in the lowest bits of their ids.
KINDS = ("region", "nation", "customer", "supplier", "order", "line")
#: Bits of a line's number in its id, before its order's key.
LINE_BITS = 16


def entity_id(kind: str, key: Column | str, line: Column | str | None = None) -> Column:
    """A node of the entity graph as a whole number, no two alike: null for a null key, an error for one beyond its bits."""
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    n, bits = col(key), 60 if line is None else 60 - LINE_BITS
    fits = n.between(-(1 << bits), (1 << bits) - 1)
    if line is not None:
        fits = fits & col(line).between(0, (1 << LINE_BITS) - 1)
        n = F.shiftleft(n, LINE_BITS) + col(line)
    given = F.shiftleft(n, 3) + KINDS.index(kind)
    return F.when(fits, given).when(~fits, F.raise_error(F.lit(f"a {kind}'s key is beyond its bits")).cast("long"))


def entity_path(entity: Column | str) -> Column:
    """The path that an id stands for."""
    x = F.col(entity) if isinstance(entity, str) else entity
    kind, n = x.bitwiseAND(7), F.shiftright(x, 3)
    names = F.element_at(F.array(*[F.lit(f"{k}/") for k in KINDS]), (kind + 1).cast("int"))
    line = F.concat(F.lit("line/"), F.shiftright(n, LINE_BITS).cast("string"), F.lit("-"), n.bitwiseAND((1 << LINE_BITS) - 1).cast("string"))
    return F.when(kind == KINDS.index("line"), line).otherwise(F.concat(names, n.cast("string")))


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_edges`` with ids for paths: a fixpoint moves and sorts whole numbers, its result is named by ``entity_path``."""
    out = None
    for kind, table, key, to, foreign in KEYS:
        src = entity_id(kind, key) if key else entity_id(kind, "l_orderkey", "l_linenumber")
        some = read(spark, sf_dir, table).select(repo(), src.alias("src"), entity_id(to, foreign).alias("dst"))
        out = some if out is None else out.unionByName(some)
    return out


ENTITY_SQL = """e AS (
  SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst FROM nation
  UNION SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
  UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier
  UNION SELECT 'order/' || o_orderkey, 'customer/' || o_custkey FROM orders
  UNION SELECT 'line/' || l_orderkey || '-' || l_linenumber, 'order/' || l_orderkey FROM lineitem
  UNION SELECT 'line/' || l_orderkey || '-' || l_linenumber, 'supplier/' || l_suppkey FROM lineitem)"""


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer imports customer (7 * key + 3) mod n: a graph of cycles."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    n = c.agg(F.count("*").alias("n"))
    rows = c.join(F.broadcast(n))  # one row
    return rows.select(repo(), node("c", "c_custkey").alias("src"), node("c", (F.col("c_custkey") * 7 + 3) % F.col("n")).alias("dst"))


CYCLIC_SQL = "c AS (SELECT 'c/' || c_custkey AS src, 'c/' || ((c_custkey * 7 + 3) % (SELECT count(*) FROM customer)) AS dst FROM customer)"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, ordinal, module, line): the hrefs of a page in order, as its imports."""
    p = read(spark, sf_dir, "pages").select(node("page", "page_id").alias("path"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("ordinal", "module"))
    return p.select(repo(), "path", "ordinal", "module", (F.col("ordinal") + 1).alias("line"))


LINKS_SQL = """h AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS ordinal, unnest(l) AS module
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages))"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, line, text): lines of documents, from 1."""
    d = read(spark, sf_dir, "documents").select(node("doc", "doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    return d.select(repo(), "path", (F.col("n") + 1).alias("line"), "text")


LINES_SQL = "n AS (SELECT 'doc/' || doc_id AS path, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, start, stop): a user's events as spans of hours."""
    start = F.hour("ts") + 1
    return read(spark, sf_dir, "events").select(repo(), node("user", "user_id").alias("path"), start.alias("start"), (start + (F.floor("value") % 3).cast("int")).alias("stop"))


SPANS_SQL = "v AS (SELECT 'user/' || user_id AS path, CAST(hour(ts) + 1 AS INT) AS start, CAST(hour(ts) + 1 + CAST(floor(value) AS BIGINT) % 3 AS INT) AS stop FROM events)"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table dealt by ``keys`` over tasks in proportion to its splits, so that a task's share does not grow with the table."""
    return df.repartition(PER_SPLIT * df.rdd.getNumPartitions(), *keys)


#: Tasks for each split of an input.
PER_SPLIT = 8


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of fixed size: the greatest flag is R if there is an R and none above."""
    line = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), "l_orderkey", "l_linenumber")
    is_r = F.bool_or(F.col("l_returnflag") == "R") & ~F.bool_or(F.col("l_returnflag") > "R")
    line = line.groupBy("l_orderkey", "l_linenumber").agg(is_r.alias("is_r"), F.max("l_quantity").alias("quantity"))
    return line.select(repo(), node("order", "l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), "is_r", "quantity")


def order_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order with flag R stand for definitions."""
    rows = _order_lines(spark, sf_dir).where("is_r")
    return rows.select("repo", "path", F.col("line").alias("ordinal"), F.concat(F.lit("def_"), F.col("line").cast("string")).alias("name"), F.lit("function").alias("kind"), "line", F.lit(None).cast("string").alias("docstring"))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order with a quantity over 40 stand for changed lines."""
    return _order_lines(spark, sf_dir).where("quantity > 40").select("repo", "path", F.col("line").alias("start"), F.col("line").alias("stop"))


BODIES_SQL = """b AS (SELECT 'order/' || l_orderkey AS path, l_linenumber AS line, max(l_returnflag) AS flag, max(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
  d AS (SELECT path, line, line AS start, lead(line, 1, 1000000001) OVER (PARTITION BY path ORDER BY line) - 1 AS stop FROM b WHERE flag = 'R'),
  s AS (SELECT path, line FROM b WHERE quantity > 40)"""
