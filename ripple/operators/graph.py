"""
Reachability over edges (repo, src, dst), where src imports dst.

The fixpoint keeps three things small: each hop joins only the frontier with the edges, which were hashed and sorted once (a frontier of a
few rows, which the last hop has counted, is broadcast instead); what was seen is dropped by an anti join; and every hop is checkpointed to the session's shared folder, so plans do not grow with the depth and a lost
executor costs one hop at most. A closure that is still open after DEEP hops goes on along chains, nodes with one step each, whose jumps are doubled: a chain costs the
logarithm of its length.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

KEY = ["repo", "path"]
#: The same in the order that joins sort by: a sort compares the first column's leading bytes before all else, and one repository's rows share theirs.
ON = KEY[::-1]
#: Frontiers of at most so many bytes are broadcast.
SMALL = 8 << 20
#: Hops after which a closure goes on along chains.
DEEP = 12


def _shared(df: DataFrame) -> str:
    """The session's folder of checkpoints; only a local session (tests) that names none gets a folder of its own."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="ripple-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into spark.checkpoint.dir"""
    _shared(df)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in spark.checkpoint.dir: a checkpoint whose rows take a fraction of the bytes."""
    path = f"{_shared(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _extent(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of their keys and as much again)"""
    keys = [F.octet_length(c) if kind == "string" else F.lit(8) for c, kind in df.dtypes if c != "hops"]
    n, size = df.agg(F.count("*"), F.sum(sum(keys, F.lit(32)))).first()
    return n, size or 0


def prepared(edges: DataFrame, reverse: bool = True) -> DataFrame:
    """(repo, path, next): the steps of a fixpoint, hashed and sorted by their start and kept so for all hops; several fixpoints may share them. Edges may be repeated."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select("repo", F.col(near).alias("path"), F.col(far).alias("next")).where(F.col("path") != F.col("next"))
    return steps.repartition(*ON).sortWithinPartitions(*ON).persist(StorageLevel.MEMORY_AND_DISK)


def closure(edges: DataFrame, seeds: DataFrame, *, reverse: bool = True, max_hops: int | None = None, steps: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """
    (repo, path, by..., hops) of every node reached from ``seeds`` (repo, path, by...), seeds at hop 0: the shortest distance. Against the edges
    if ``reverse`` (importers), along them otherwise. Seeds need not occur in ``edges``; cycles and self edges are harmless. ``by``: columns of the seeds that
    tell closures apart; one fixpoint carries them all, and the edges are not copied.
    """
    own, state = steps is None, [*ON, *by]
    steps = prepared(edges, reverse) if own else steps
    frontier = seen = cut_lineage(seeds.select(*state).distinct().withColumn("hops", F.lit(0)))
    (n, size), total, hop = _extent(seen), 0, 0
    while n and hop < DEEP and (max_hops is None or hop < max_hops):
        hop, total = hop + 1, total + size
        new = steps.join(_small(frontier.select(*state), size), ON).select("repo", F.col("next").alias("path"), *by).distinct()
        frontier = cut_lineage(new.join(_small(seen.select(*state), total), state, "left_anti").withColumn("hops", F.lit(hop)))
        n, size = _extent(frontier)
        if n:
            seen = seen.unionByName(frontier)
    if n and (max_hops is None or hop < max_hops):
        seen = _along_chains(steps, seen, frontier, max_hops, state)
    if own:
        steps.unpersist()
    return seen.select(*KEY, *by, "hops")


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= SMALL else df


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is SMALL. It is read for that, so its lineage should be cut."""
    return _small(df, _extent(df)[1])


def _along_chains(steps: DataFrame, seen: DataFrame, changed: DataFrame, max_hops: int | None, state: list[str]) -> DataFrame:
    """
    ``seen`` (state, hops), complete up to the hops of ``changed``, its last hop, with all that is reached from there. Each round labels the chains after what the last one changed, then
    the nodes one step after those with several steps; labels that are no improvement are dropped, so it ends with the shortest distances.

    Labels along chains: those of fewer than 2^k steps and a jump of 2^k steps give those of fewer than 2^(k+1). When a doubling improves nothing, no later one does.
    """
    single = F.min("next") == F.max("next")
    one = steps.groupBy(*ON).agg(F.min("next").alias("end"), single.alias("single")).where("single").drop("single")
    forks = steps.join(one, ON, "left_anti")
    jumps = [cut_lineage(one)]
    fewest = lambda df: df.groupBy(*state).agg(F.min("hops").alias("hops"))

    def better(new: DataFrame, old: DataFrame, size: int) -> DataFrame:
        if max_hops is not None:
            new = new.where(F.col("hops") <= max_hops)
        known = _small(old.withColumnRenamed("hops", "known"), size)
        return cut_lineage(fewest(new).join(known, state, "left").where("known is null or hops < known").select(*state, "hops"))

    seen = cut_lineage(fewest(seen))
    n, size = _extent(changed)
    total = _extent(seen)[1]
    while n:
        ahead, last, k = changed, changed, 0
        while n:
            if k == len(jumps):
                far = jumps[-1].select("repo", F.col("path").alias("end"), F.col("end").alias("further"))
                jumps.append(cut_lineage(jumps[-1].join(far, ["end", "repo"]).select(*KEY, F.col("further").alias("end"))))
            moved = jumps[k].join(_small(ahead, size), ON).select("repo", F.col("end").alias("path"), *state[2:], (F.col("hops") + (1 << k)).alias("hops"))
            new = better(moved, ahead, size)
            n = _extent(new)[0]
            if n:
                ahead, k = cut_lineage(fewest(ahead.unionByName(new))), k + 1
                size = _extent(ahead)[1]
        # those that the round began with are in seen already, but their steps are not taken yet
        chained = better(ahead, seen, total)
        seen = cut_lineage(fewest(seen.unionByName(chained)))
        from_ = chained.unionByName(last).join(seen, [*state, "hops"], "left_semi").distinct()
        total = _extent(seen)[1]
        stepped = forks.join(_small(from_, total), ON).select("repo", F.col("next").alias("path"), *state[2:], (F.col("hops") + 1).alias("hops"))
        changed = better(stepped, seen, total)
        n, size = _extent(changed)
        if n:
            seen = cut_lineage(fewest(seen.unionByName(changed)))
            total = _extent(seen)[1]
    return seen


def rings(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, by: tuple[str, ...] = (), steps: DataFrame | None = None) -> DataFrame:
    """(repo, path, by..., hops): importers at distance 1, 2, ... of any seed (with the same ``by``); seeds are in no ring."""
    return closure(edges, seeds, max_hops=max_hops, by=by, steps=steps).where(F.col("hops") > 0)


def reaches_any(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The ``sources`` (repo, path) from which at least one import path of one or more steps leads to a target: one fixpoint for all."""
    steps = prepared(edges)
    up = closure(edges, targets, steps=steps)
    # a target counts as a source only over a path that leads back to a target
    ends = targets.select("repo", F.col("path").alias("next")).distinct()
    back = steps.join(small(ends), ["next", "repo"], "left_semi").join(up.select(*KEY), ON, "left_semi").select("repo", F.col("next").alias("path"))
    out = cut_lineage(sources.join(up.where("hops > 0").select(*KEY).unionByName(back), ON, "left_semi"))
    steps.unpersist()
    return out


def filter_rings(ring_rows: DataFrame, edges: DataFrame, proven: DataFrame, any_symbols: bool = True, steps: DataFrame | None = None) -> DataFrame:
    """
    Rings without files that use no changed symbol: hop 1 keeps the ``proven`` files (repo, path); hop n keeps files with an
    import path to a kept file of hop n - 1. No kept file at a level ends it. Without changed symbols nothing is dropped.

    One fixpoint for all levels: its states are (file, level), a file that reaches a kept file of the level; a state whose file is in the ring
    above is a kept file itself and starts the next level.
    """
    if not any_symbols:
        return ring_rows
    own, state = steps is None, [*ON, "level"]
    ring_rows = cut_lineage(ring_rows)
    steps = prepared(edges) if own else steps
    ring = ring_rows.select(*KEY, "hops")
    kept = cut_lineage(ring_rows.where("hops = 1").join(proven.select(*KEY).distinct(), ON, "left_semi"))
    frontier = done = kept.select(*KEY, F.lit(1).alias("level"))
    n, size = _extent(frontier)
    while n:
        reached = steps.join(_small(frontier, size), ON).select("repo", F.col("next").alias("path"), "level").distinct()
        risen = reached.join(ring, ON).where(F.col("hops") == F.col("level") + 1).select(*KEY, "hops")
        risen = cut_lineage(risen.join(kept.select(*KEY), ON, "left_anti"))
        kept = kept.unionByName(ring_rows.join(risen.select(*KEY), ON, "left_semi"))
        new = reached.unionByName(risen.select(*KEY, F.col("hops").alias("level"))).distinct()
        frontier = cut_lineage(new.join(done, state, "left_anti"))
        n, size = _extent(frontier)
        done = done.unionByName(frontier)
    if own:
        steps.unpersist()
    return kept


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges within ``nodes`` (repo, path), drawn from the imported file to its importer: (repo, origin, target)."""
    n = nodes.select(*KEY).distinct()
    inside = edges.join(n.withColumnRenamed("path", "src"), ["repo", "src"], "left_semi").join(n.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi")
    return inside.select("repo", F.col("dst").alias("origin"), F.col("src").alias("target")).distinct()


def edge_violations(drawn: DataFrame, edges: DataFrame) -> DataFrame:
    """Drawn edges (repo, origin, target) that are not in the graph."""
    real = edges.select("repo", F.col("dst").alias("origin"), F.col("src").alias("target"))
    return drawn.join(real, ["repo", "origin", "target"], "left_anti")
