"""Capped, ordered outputs: top k with overflow, node selection, evidence, running caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import rules


def ranked(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Adds nth (from 1) and n_all for each group."""
    w = Window.partitionBy(*by)
    return df.withColumns({"nth": F.row_number().over(w.orderBy(*order)), "n_all": F.count("*").over(w)})


def top_with_overflow(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """
    The first ``most`` rows of each group with nth and n_more, the number of rows that are not shown. Spark keeps only ``most``
    rows of a group before the shuffle (window group limit); the counts are a separate, combinable aggregation.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    first = df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    counts = df.groupBy(*by).agg(F.count("*").alias("n_all"))
    return first.join(counts, by).withColumn("n_more", F.greatest(F.col("n_all") - most, F.lit(0))).drop("n_all")


def symbol_order(path: Column | str = "path", name: Column | str = "name", is_danger: Column | str = "is_danger") -> list[Column]:
    """Danger zones first, public names first, then path and name."""
    return [p.col(is_danger).desc(), p.col(name).startswith("_").asc(), p.col(path).asc(), p.col(name).asc()]


def select_nodes(nodes: DataFrame, most: int = rules.DIAGRAM_NODES) -> DataFrame:
    """nodes: repo, path, hops (0 for seeds). Seeds, all of them, then ring order up to ``most``. Of the rings only ``most`` are kept before they are shuffled."""
    order = Window.partitionBy("repo").orderBy("hops", "path")
    seeds = nodes.where("hops = 0").withColumn("nth", F.row_number().over(order))
    others = nodes.where("hops != 0").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    before = seeds.groupBy("repo").agg(F.count("*").cast("int").alias("n_seeds"))
    others = others.join(before, "repo", "left").withColumn("nth", F.col("nth") + F.coalesce("n_seeds", F.lit(0))).drop("n_seeds")
    return seeds.unionByName(others.where(F.col("nth") <= most))


def evidence_rank(kind: Column | str = "kind", confidence: Column | str = "confidence") -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.EVIDENCE_RANKS.items() for x in kv])
    base = F.coalesce(F.try_element_at(table, p.col(kind)), F.lit(rules.EVIDENCE_DEFAULT))
    return base + F.when(p.col(confidence) != "proven", rules.EVIDENCE_HEURISTIC).otherwise(0)


def compact_evidence(items: DataFrame, by: list[str], most: int = rules.INLINE_EVIDENCE) -> DataFrame:
    """The ``most`` best items of each group (stable by pos); importers make one summary if a place is left. Adds slot."""
    rank = Window.partitionBy(*by).orderBy(evidence_rank(), "pos")
    others = items.where("kind != 'graph_importer'").withColumn("slot", F.row_number().over(rank)).where(F.col("slot") <= most)
    used = others.groupBy(*by).agg(F.count("*").alias("used"))
    hubs = items.where("kind = 'graph_importer'").groupBy(*by).agg(F.count("*").alias("n"), F.min_by(F.struct("confidence", "kind", "location", "fact"), "pos").alias("one"))
    text = F.concat(F.col("n").cast("string"), F.lit(" files import this module — open the report for the map"))
    many = F.struct(F.lit("proven").alias("confidence"), F.lit("graph_importer").alias("kind"), F.lit("graph").alias("location"), text.alias("fact"))
    summary = hubs.join(used, by, "left").where(F.coalesce("used", F.lit(0)) < most).withColumn("item", F.when(F.col("n") == 1, F.col("one")).otherwise(many))
    summary = summary.select(*by, "item.*", (F.coalesce("used", F.lit(0)) + 1).cast("int").alias("slot"))
    return others.select(*by, "confidence", "kind", "location", "fact", "slot").unionByName(summary)


def dedupe_evidence(items: DataFrame, by: list[str]) -> DataFrame:
    """The first item (by pos) of each (confidence, kind, fact)."""
    w = Window.partitionBy(*by, "confidence", "kind", "fact").orderBy("pos")
    return items.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def capped_lines(lines: DataFrame, by: list[str], most: int = rules.PACK_LINES, chars: int = rules.PACK_CHARS) -> DataFrame:
    """The first ``most`` lines (by line), up to the first with which the total would exceed ``chars``."""
    w = Window.partitionBy(*by).orderBy("line")
    first = lines.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    total = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("chars", total).where(F.col("chars") <= chars)


def layer_groups(nodes: DataFrame, most: int = rules.DIAGRAM_NODES) -> DataFrame:
    """(repo, layer, n, paths): how many nodes each top folder has, and the first ``most`` of them, sorted."""
    from ..functions.scalars import layer

    rows = nodes.select("repo", layer("path").alias("layer"), "path").distinct()
    by = ["repo", "layer"]
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("path"))).where(F.col("nth") <= most)
    first = first.groupBy(*by).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return first.join(rows.groupBy(*by).agg(F.count("*").alias("n")), by)
