"""
SimHash near-duplicates with bit-sliced comparison.

Fingerprints (64 bits over word shingles) that differ in at most ``radius`` bits are linked; documents in one connected
component are near-duplicates. Equal fingerprints count once, whatever the number of their documents.

Candidates come from the pigeonhole principle: with the bits cut into ``blocks`` blocks, two fingerprints within the
radius agree in at least blocks - radius whole blocks, so each choice of that many blocks is a table that is
grouped by their bits, and no link is lost. Within a group the fingerprints are stored vertically: word j of
a plane row holds bit j of 64 fingerprints. A query's mismatches with 64 others are one xor; carry-save adders
count them bit by bit, and what has only lanes beyond the radius is abandoned before the later planes are read.
A group hands on a spanning forest of its links, never all pairs; groups beyond ``CHUNK`` are compared as pairs
of chunks by different tasks. Components are joined by min-label propagation with pointer jumping.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

BITS = 64
#: Fingerprints of a group that one task compares with each other at once.
CHUNK = 2048
#: Bytes of the sets of shingles in one chunk, about; pairs of one set that are dealt to one salt, about.
CHUNK_BYTES, STAR = 32 << 20, 1024
#: Distinct fingerprints up to which blocks are of the least number (fewer, larger groups); then blocks are added.
DENSE = 1 << 22
#: MinHash bands and the least values in each: of pairs with similarity 0.8, all but (1 - 0.8**7)**48 = 1.3e-5 share a band, whatever the number of texts.
BANDS, BAND_ROWS = 48, 7
#: Bins of the sketch by which the similarity of two sets of shingles is told.
BINS = 256
#: Estimated similarity below which a pair is not counted in full: six standard errors under 0.8.
SCREEN = 0.65
#: (query, word) pairs compared at once.
PAIRS = 1 << 14

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bit set where over half of the shingles' XXH64 (seed 42) have it; 0 without words."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return _majority(np.array(h, np.uint64))


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _hashes(text: str, words: int) -> np.ndarray:
    w = text.encode().translate(_LOWER).split()
    return np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else [], np.uint64)


def sketch(h: np.ndarray) -> np.ndarray:
    """The least value (16 bits, 1 at least) of the shingles in each bin, 0 for an empty bin."""
    out = np.full(BINS, 65536, np.int64)
    np.minimum.at(out, (h % np.uint64(BINS)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) % 65535 + 1)
    out[out == 65536] = 0
    return out.astype(np.uint16)


_RNG = np.random.default_rng(11)
_MULTIPLY = (_RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)[:, None]
_MIX = _RNG.integers(0, 1 << 64, BAND_ROWS, np.uint64) | np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band: its least values over the shingles, mixed. The order of shingles and their repeats do not count."""
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(x), 1 << 11):
        least = np.minimum(least, (x[None, lo : lo + (1 << 11)] * _MULTIPLY + _ADD).min(1))
    return (least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64).view(np.int64)


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of sketches (rows): the share of bins in use by either that agree, an estimate of their sets' Jaccard similarity."""
    used = ((x | y) != 0).sum(1)
    return np.where(used > 0, ((x == y) & (x != 0)).sum(1) / np.maximum(used, 1), 1.0)


def banded(docs: DataFrame, words: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` as row, bands over shingles of ``words`` words, and fp, the fingerprint of the set of shingles (each once)."""
    inner = docs.select(F.struct(*keep).alias("row"), common.text_of().alias("text"))
    schema = inner.select("row").schema.simpleString()[7:-1].replace("row:", "row ", 1)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [np.unique(_hashes(t, words)) for t in batch.column("text").to_pylist()]
            fp = np.array([_majority(h) if len(h) else 0 for h in hashes], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([bands(h) for h in hashes], pa.list_(pa.int64())), pa.array(fp.view(np.int64))], ["row", "bands", "fp"])

        return run

    return common.map_texts(inner, make, f"{schema}, bands array<long>, fp long")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """id and shingles (their hashes, each once, in order) of ``texts`` (id, text)."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            h = [np.unique(_hashes(t, words)) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.view(np.int64) for x in h], pa.list_(pa.int64()))], ["id", "shingles"])

        return run

    return common.map_texts(texts, make, "id long, shingles array<long>")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """
    The ``pairs`` (a, b) whose sets of shingles have a Jaccard similarity of ``least`` or more, counted in full; two empty sets are alike.
    ``sets``: id, shingles, size.

    An end may be the centre of a family of any size: its pairs are dealt to salts of about STAR, and its set goes to each salt once, not to each
    pair. ``pairs`` should be a table.
    """
    total, dealt, copied = pairs.count(), pairs, {}
    for end, other in (("a", "b"), ("b", "a")):
        stars = common.written(pairs.groupBy(end).agg(F.count("*").alias("n"), F.ceil(F.count("*") / STAR).cast("int").alias("salts")), "stars", total)
        dealt = common.join_split(dealt, stars, [end], "n", total).withColumn(f"{end}_salt", F.pmod(F.xxhash64(other, F.lit(11)), F.col("salts")).cast("int")).drop("salts")
        copies = sets.select(F.col("id").alias(end), F.col("shingles").alias(f"{end}_set")).join(stars.select(end, "salts"), end)
        copied[end] = copies.withColumn(f"{end}_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    both, size = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
    for end in ("b", "a"):
        dealt = dealt.join(copied[end], [end, f"{end}_salt"])
    return dealt.where(both >= F.lit(least) * (size - both)).select("a", "b")


def fingerprints(docs: DataFrame, words: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` (as row) and fp, the fingerprint as a signed long. Null texts have no words: fingerprint 0."""
    inner = docs.select(F.struct(*keep).alias("row"), common.text_of().alias("text"))
    schema = inner.select("row").schema.simpleString()[7:-1].replace("row:", "row ", 1)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fp.view(np.int64))], ["row", "fp"])

        return run

    return common.map_texts(inner, make, f"{schema}, fp long")


def planes_of(fp: np.ndarray, word: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """(64, words): bit ``lane`` of planes[j, word] is bit j of that fingerprint."""
    planes = np.zeros((BITS, words), np.uint64)
    order = np.lexsort((lane, word))
    fp, word, lane = fp[order], word[order], lane[order]
    if not len(fp):
        return planes
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    for j in range(BITS):
        bit = ((fp >> np.uint64(j)) & np.uint64(1)) << lane.astype(np.uint64)
        planes[j, word[starts]] = np.bitwise_or.reduceat(bit, starts)
    return planes


def within(query: np.ndarray, word: np.ndarray, planes: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """
    For pairs (query fingerprint, word of planes): (index of the pair, its lanes within the radius as a mask), without
    pairs that have none. lanes: the lanes in use of each word.
    """
    found_at, found = [], []
    depth = max(1, (radius + 1).bit_length())
    for lo in range(0, len(query), PAIRS):
        at = np.arange(lo, min(lo + PAIRS, len(query)))
        alive = lanes[word[at]].copy()
        count = [np.zeros(len(at), np.uint64) for _ in range(depth)]
        q, w = query[at], word[at]
        for j in range(0, BITS, 2):
            a = planes[j, w] ^ (np.uint64(0) - ((q >> np.uint64(j)) & np.uint64(1)))
            b = planes[j + 1, w] ^ (np.uint64(0) - ((q >> np.uint64(j + 1)) & np.uint64(1)))
            # a full adder takes both mismatch bits and the lowest counter bit, half adders carry on
            x = a ^ b
            carry = (a & b) | (count[0] & x)
            count[0] ^= x
            for k in range(1, depth):
                count[k], carry = count[k] ^ carry, count[k] & carry
            alive &= ~carry  # the counter ran over: far beyond the radius
            alive &= ~_above(count, radius)
            if j % 8 == 6:
                on = alive != 0
                kept = int(on.sum())
                if not kept:
                    break  # abandoned: every lane of the block is beyond the radius
                if kept < 0.75 * len(at):
                    at, alive, q, w = at[on], alive[on], q[on], w[on]
                    count = [c[on] for c in count]
        on = alive != 0
        if on.any():
            found_at.append(at[on])
            found.append(alive[on])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found_at), np.concatenate(found)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            above |= equal & count[k]
            equal = equal & ~count[k]
    return above


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component for edges (a, b): hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        on = ra != rb
        if not on.any():
            break
        a, b, ra, rb = a[on], b[on], ra[on], rb[on]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def group_links(group: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """
    Links within each group of sorted ``group``, as places (a, b): for each row that has another in its local component
    the component's first row. Rows with side 1 are queries only against rows with side 0 (pairs of chunks); with side 0 alone, all are compared.
    """
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    which = np.repeat(np.arange(len(starts)), sizes)
    zero = side == 0
    zeros = np.bincount(which, zero, len(starts)).astype(np.int64)
    crossed = (zeros < sizes)[which]
    rank = np.cumsum(zero) - zero - (np.cumsum(zeros) - zeros)[which]  # place among the group's rows of side 0
    words_of = -(-zeros // BITS)
    word_start = np.cumsum(words_of) - words_of
    total_words = int(words_of.sum())
    member = np.flatnonzero(zero)
    word = word_start[which[member]] + rank[member] // BITS
    lane = rank[member] % BITS
    row_of = np.full(total_words * BITS, -1, np.int64)
    row_of[word * BITS + lane] = member
    planes = planes_of(fp[member], word, lane, total_words)
    lanes = np.zeros(total_words, np.uint64)
    np.bitwise_or.at(lanes, word, np.uint64(1) << lane.astype(np.uint64))
    queries = np.flatnonzero((~crossed & zero) | (crossed & ~zero))
    # a query of its own chunk needs only the words from its own on
    from_word = np.where(crossed[queries], 0, rank[queries] // BITS)
    n_words = words_of[which[queries]] - from_word
    roots = np.arange(n)
    ends = np.cumsum(n_words)
    at = 0
    while at < len(queries):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 64 * PAIRS, "right")))
        some, reps = queries[at:to], n_words[at:to]
        q = np.repeat(some, reps)
        w = np.repeat(word_start[which[some]] + from_word[at:to], reps) + np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
        pair, mask = within(fp[q], w, planes, lanes, radius)
        for lo in range(0, len(pair), 1 << 14):
            bits = np.unpackbits(mask[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, ln = np.nonzero(bits)
            p = pair[lo : lo + (1 << 14)][k]
            a, b = q[p], row_of[w[p] * BITS + ln]
            on = a != b
            a, b = roots[a[on]], roots[b[on]]
            if len(a):
                more = _roots(n, a, b)
                roots = more[roots]
        at = to
    linked = np.flatnonzero(roots != np.arange(n))
    return linked, roots[linked]


def tables(n: int, radius: int) -> list[int]:
    """
    Masks of the bits that the tables are grouped by: every choice of blocks - radius blocks. More blocks make more
    tables with longer keys; as many are taken as keep groups small (n / 2**key bits) without growing tables needlessly.
    """
    blocks = radius + 1
    while blocks < radius + 4 and n > DENSE << (8 * (blocks - radius - 1)):
        blocks += 1
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(c) for c in itertools.combinations(masks, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """a, b: ids of a spanning forest of the links in each group of each table, over ``distinct`` (id, fp). No link is lost."""
    masks = tables(n, radius)
    keyed = distinct.select("id", "fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("t", "mask")).select("id", "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # a group's chunk is given by a hash, and a row goes to each pair of chunks that its own is in
    some = keyed.join(large, ["t", "key"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    some = some.withColumn("c", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    some = some.select("t", "key", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), (F.col("c") > F.col("o")).cast("int").alias("side"), "id", "fp")
    group = ["t", "key", "c1", "c2"]
    dealt = some.repartition(*group).sortWithinPartitions(*group)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def compare(table: pa.Table, last: bool):
            cols = [np.asarray(table.column(c)) for c in group]
            if not len(cols[0]):
                return None, table
            change = np.zeros(len(cols[0]), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            ids = np.cumsum(change)
            to = len(ids) if last else int(np.searchsorted(ids, ids[-1]))  # the last group may go on
            fp = np.asarray(table.column("fp")).astype(np.int64).view(np.uint64)[:to]
            own = np.asarray(table.column("id")).astype(np.int64)[:to]
            a, b = group_links(ids[:to], fp, np.asarray(table.column("side"))[:to], radius) if to else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(own[x]) for x in (a, b)], ["a", "b"]), table.slice(to)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 15:
                out, rest = compare(pa.Table.from_batches(held), False)
                held, rows = rest.combine_chunks().to_batches(), rest.num_rows
                if out is not None and out.num_rows:
                    yield out
        if rows:
            out, _ = compare(pa.Table.from_batches(held), True)
            if out is not None:
                yield out

    return ship(dealt).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """
    node, label: the smallest node of its component, for every node of ``edges`` (a, b). Each round takes the least label
    among neighbours, then the label's label; it ends when nothing changes. Counts are all that the driver sees.
    """
    spark, n = edges.sparkSession, 2 * edges.count()
    path = common.new_path(spark, name)
    both = common.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges", n)
    now = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), name, n, path)
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = now.select(F.col("node").alias("new"), F.col("label").alias("up"))
        step = step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("label"), (F.least("new", F.coalesce("up", "new")) != F.col("label")).alias("changed"))
        old, path = path, common.new_path(spark, name)
        step = common.written(step, name, n, path)
        now = step.select("node", "label")
        common.remove(spark, old)  # a round is all that the next one needs
        if step.where("changed").isEmpty():
            return now


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """
    ``keep`` of every row of ``docs`` as row, with fp (a signed long) and component_id: the smallest doc_id that is reached over
    links of at most ``radius`` differing bits, its own included.

    Null and empty texts have fingerprint 0 and are linked like others. A null doc_id is never a component's id unless all
    of its component's are null. Repeated rows stay repeated. An empty table gives an empty one.
    """
    return _near_duplicates(docs, words, radius, keep).select("row", "fp", F.col("least.doc_id").alias("component_id"))


def band_groups(nodes: DataFrame, n: int) -> DataFrame:
    """
    t, key, id, centre (the least id) and n for every group of two or more that share a band, over ``nodes`` (id, bands), a table of ``n`` rows.
    Groups of the same members in several bands are one. A band that many share is joined apart.
    """
    keyed = nodes.select("id", F.posexplode("bands").alias("t", "key"))
    mark = F.xxhash64("id", F.lit(3))
    groups = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("id").alias("centre"), F.max("id").alias("last"), F.bit_xor(mark).alias("mark")).where("n > 1")
    once = groups.groupBy("n", "centre", "last", "mark").agg(F.min(F.struct("t", "key")).alias("at")).select("at.*", "n", "centre")
    once = common.written(once.withColumn("rows", F.col("n")), "groups", BANDS * n)
    return common.join_split(keyed, once, ["t", "key"], "rows", BANDS * n).where("n is not null")


def unjoined(held: DataFrame, label: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """
    a, b: links that join the labels within each group of ``held`` (see ``band_groups``). Each pair of a group whose texts are not yet
    joined is compared (by sketches, and in full from ``SCREEN`` on); those of ``least`` or more that join something are given, so a
    group gives fewer links than rows. Groups of two were compared already. Large groups are compared as pairs of chunks, which have
    CHUNK rows and CHUNK_BYTES of shingles, about, so that a task's two fit into memory however long the texts are. ``sets``: id, shingles, size.
    """
    group = ["t", "key", "c1", "c2"]
    named = held.where("n > 2").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    chunks = F.ceil(F.greatest(F.max("n") / CHUNK, F.sum("size") * 8 / CHUNK_BYTES)).cast("int").alias("chunks")
    mixed = named.join(sets.select("id", "size"), "id").groupBy("t", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), chunks).where("lo != hi").select("t", "key", "chunks")
    some = named.join(mixed, ["t", "key"])
    some = some.withColumn("c", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    some = some.select("t", "key", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), (F.col("c") > F.col("o")).cast("int").alias("side"), "id", "label")
    # a given number of tasks: adaptive execution would merge them by bytes, but their work goes with the square of a group's rows
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = some.join(sets.drop("size"), "id").repartition(tasks, *group).sortWithinPartitions(*group)

    def joins(ids, side, label, sets):
        label, sketches, sizes = label.copy(), np.stack([sketch(x) for x in sets]), np.array([len(x) for x in sets])
        crossed = side.any()
        for k in range(len(ids)):
            on = np.flatnonzero((label != label[k]) & (side != side[k] if crossed else ids > ids[k]))
            if (crossed and side[k]) or not len(on):
                continue
            on = on[(similarity(sketches[k : k + 1], sketches[on]) >= SCREEN) & (np.minimum(sizes[on], sizes[k]) > 0)]
            for lo in range(0, len(on), 256):
                some = on[lo : lo + 256]
                shared = np.isin(np.concatenate([sets[x] for x in some]), sets[k])
                both = np.add.reduceat(shared, np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
                for x in some[both >= least * (sizes[some] + sizes[k] - both)]:
                    if label[x] != label[k]:
                        yield ids[k], ids[x]
                        label[label == label[x]] = label[k]

    def run(batches):
        held = None

        def compare(table: pa.Table, last: bool):
            cols = [np.asarray(table.column(c)) for c in group]
            change = np.zeros(len(table), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.r_[0, np.flatnonzero(change), len(table)]
            if not last:
                starts = starts[:-1]  # the last group may go on
            ids, side, label = (np.asarray(table.column(c)) for c in ("id", "side", "label"))
            found = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                sets = [np.asarray(x.values).view(np.uint64) for x in table.column("shingles").slice(lo, hi - lo)]
                found += joins(ids[lo:hi], side[lo:hi], label[lo:hi], sets)
            a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]), table.slice(int(starts[-1]))

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.nbytes >= 1 << 25:
                out, held = compare(held, False)
                yield out
        if held is not None and len(held):
            yield compare(held, True)[0]

    return ship(dealt).mapInArrow(run, "a long, b long")


def first_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """
    One row of each group of near-duplicates: texts whose sets of ``words``-word shingles have a similarity of ``least`` or more,
    and what is reached over such texts. The first by doc_id (null last), then by the text's hash, stays; repeated rows become one.

    Candidates are the links of ``radius`` bits that the bit-sliced comparison finds between the texts' fingerprints. Texts of similarity ``least`` may
    differ in more bits than tables of whole blocks could find, so those that share a MinHash band are candidates as well, with no bound
    on bits. The whole sets of shingles decide. First come the links, and each text with the first of its band's group; then all pairs of a group
    that these have not joined, so none is left out but those within a component. Equal texts are one node, so copies cost nothing.
    """
    key = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64(common.text_of()).alias("_hash"))
    printed = common.written(banded(key, words, ("doc_id", "_hash")), "printed")
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("null_id"), F.col("row.doc_id").alias("doc_id"), F.col("row._hash").alias("h")))
    nodes = common.written(printed.groupBy(F.col("row._hash").alias("id")).agg(first.alias("first"), F.any_value("bands").alias("bands"), F.any_value("fp").alias("fp")), "nodes", 4 * printed.count())  # the bands are as wide as some rows
    n = nodes.count()
    held = common.written(band_groups(nodes, n), "bands")
    linked = links(nodes.select("id", "fp"), n, radius).select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    pairs = held.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).unionByName(linked.repartition(max(8, n // common.FILE_ROWS)))
    pairs = common.written(pairs.distinct(), "pairs", n)
    asked = held.select("id").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    texts = key.select(F.col("_hash").alias("id"), common.text_of().alias("text")).join(asked, "id", "left_semi").dropDuplicates(["id"])
    sets = common.written(shingle_sets(texts, words).withColumn("size", F.size("shingles")), "sets")
    edges = common.written(alike(pairs, sets, least), "alike", n)
    label = components(edges).withColumnRenamed("node", "id")
    more = common.written(unjoined(held, label, sets, least), "joins", n)
    label = components(edges.unionByName(more)).withColumnRenamed("node", "id")
    joined = nodes.select("id", "first").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    kept = joined.groupBy("label").agg(F.min("first").alias("least")).select(F.col("least.doc_id").alias("_id"), F.col("least.h").alias("_h"))
    # representatives are joined by id and hash of the text, so that a text with a repeated id is not taken for another
    rows = key.join(kept, key["doc_id"].eqNullSafe(kept["_id"]) & (key["_hash"] == kept["_h"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_hash"]).select("row.*")


def _near_duplicates(docs: DataFrame, words: int, radius: int, keep: tuple[str, ...]) -> DataFrame:
    """row, fp, least (struct of null_id, doc_id): the first id of the component."""
    keep = tuple(dict.fromkeys(("doc_id", *keep)))
    printed = common.written(fingerprints(docs, words, keep), "fingerprints")
    first = F.struct(F.col("row.doc_id").isNull().alias("null_id"), F.col("row.doc_id").alias("doc_id"))
    total = printed.count()
    distinct = common.written(printed.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("rows")), "distinct", total)
    n = distinct.count()
    # the comparison keeps its own tasks; its few links are dealt out anew for few files
    edges = common.written(links(distinct.select(F.col("fp").alias("id"), "fp"), n, radius).repartition(max(8, n // common.FILE_ROWS)), "links")
    label = components(edges)
    joined = distinct.select("fp", "first").join(label.withColumnRenamed("node", "fp"), "fp")
    least = joined.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("fps"))
    linked = common.join_split(joined.select("fp", "label"), least, ["label"], "fps", n).select("fp", "least")
    ids = distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"), "rows")
    return common.join_split(printed, common.written(ids, "ids", n), ["fp"], "rows", total)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(common.table(spark, sf_dir, "documents"))
    return got.select("row.doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
