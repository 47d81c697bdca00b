"""
Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the SEED-word sequences in each window of LENGTH words the one with the least hash. Two equal windows choose the same anchor,
so documents that share a window share an anchor. An anchor is extended both ways as far as neighbouring windows choose it: a run. Documents are joined on
runs: all windows of a run that also is in a document with a smaller id are repeats. What remains, the first of each set of equal runs, is joined on anchors; runs
with a shared anchor are cut into stretches at windows that their words choose, and treated likewise, and what remains of those is compared window by window. Equal
words meet by a 128-bit hash. Matching windows that touch are one maximal repeat. An anchor is extended against all its partners at once: the smallest doc_id
decides, pairs are never listed.

Scale: runs are one row in about 13 words and summed before they are shuffled; of equal runs and stretches only one is taken further, so copies cost a row for each
run; what many rows share is a hot key of the joins back, which are split. Texts are shuffled three times, by row, of which two join only those with shared anchors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

#: Words of a window, and of a seed in it.
LENGTH, SEED = 50, 26
#: Windows of a stretch, on average.
STRETCH = 6
#: Bytes of text looked at together; windows of a task that are given away together.
STEP_BYTES, OUT_ROWS = 1 << 20, 1 << 16

_RANDOM = np.random.default_rng(13)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | _RANDOM.integers(0, 2, 256, dtype=np.uint64)
#: Odd bases of the polynomial hashes modulo 2^64: of bytes in a word, of words in a seed, of words in a window (two).
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no linear structure."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _ranges(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hashes of ``values[start:stop]``, equal for equal runs of values wherever they are."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(_BASES[which], n), out=sums[1:])
    return (sums[stops] - sums[starts]) * _powers(_INVERSES[which], n + 1)[starts]


@dataclass(frozen=True)
class Words:
    """Words of several texts: byte range of each, hash of each, and where each text's words begin (one more than texts)."""

    raw: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray


def words_of(column: pa.Array) -> Words:
    raw, offsets = common.array_bytes(column)
    raw = raw[: offsets[-1]]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    solid = np.append(~_SPACE[raw], False)
    before = np.append(False, solid[:-1])
    starts = np.nonzero(solid & (~before | edge))[0]
    stops = np.nonzero(before & (~solid | edge))[0]
    hashes = _ranges(_BYTES[raw], starts, stops, 0) + (stops - starts).astype(np.uint64)
    return Words(raw, starts, stops, _mixed(hashes), np.searchsorted(starts, offsets))


def windows_of(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``length`` words inside a text: (text, first word, hash of the anchor that each chooses)."""
    n = len(words.hashes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - length + 1)
    text = np.searchsorted(words.texts, at, "right") - 1
    inside = at + length <= words.texts[text + 1]
    grams = np.arange(n - seed + 1)
    seeds = _mixed(_ranges(words.hashes, grams, grams + seed, 1))
    least = seeds[at]
    for i in range(1, length - seed + 1):
        np.minimum(least, seeds[i : i + len(at)], out=least)
    return text[inside], at[inside], least[inside].view(np.int64)


def row_keys() -> list[Column]:
    """128 bits that tell a document's row: by id and text."""
    return [F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k2")]


def runs(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """
    k1, k2, doc_id, anchor, start, n, h1, h2: each anchor of the rows of ``docs`` (k1, k2, doc_id, text), extended both ways as far as neighbouring windows chose it:
    the first word, the number of windows, and the hash of all their words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["k1", "k2", "doc_id", "anchor", "start", "n", "h1", "h2"]

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, most=STEP_BYTES):
                words = words_of(part.column("text"))
                text, at, anchor = windows_of(words, length, seed)
                first = np.nonzero(np.append(True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]))[: len(text)])[0]
                n = np.diff(np.append(first, len(text)))
                text, at, anchor = text[first], at[first], anchor[first]
                h1, h2 = word_hashes(words, at, at + n + (length - 1))
                which = pa.array(text)
                numbers = [anchor, (at - words.texts[text]).astype(np.int32), n.astype(np.int32), h1, h2]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(which) for c in names[:3]], *map(pa.array, numbers)], names)

    return ship(docs).mapInArrow(run, f"k1 long, k2 long, doc_id {kind}, anchor long, start int, n int, h1 long, h2 long")


def word_hashes(words: Words, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words of each range."""
    return _ranges(words.hashes, starts, stops, 2).view(np.int64), _ranges(_mixed(words.hashes), starts, stops, 3).view(np.int64)


def pieces(docs: DataFrame, every: int, length: int = LENGTH) -> DataFrame:
    """
    p1, p2, start, n, h1, h2, doc_id, k1, k2, at: the ranges (h1, h2, at, n, doc_id) of windows that the rows of ``docs`` (k1, k2, text, ranges) list, cut after each
    window whose hash divides by ``every``: the hash of the range, the first window in it, windows, the hash of their words, and where they are.
    """
    kind = docs.schema["ranges"].dataType.elementType["doc_id"].dataType.simpleString()
    names = ["p1", "p2", "start", "n", "h1", "h2", "doc_id", "k1", "k2", "at"]

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, most=STEP_BYTES):
                words = words_of(part.column("text"))
                lists = part.column("ranges")
                flat = lists.flatten()
                row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
                begin, size = (np.asarray(flat.field(c)).astype(np.int64) for c in ("at", "n"))
                ends = np.cumsum(size)
                for i, j in _groups(ends, OUT_ROWS):
                    which = np.repeat(np.arange(i, j), size[i:j])
                    offset = np.arange(len(which)) - np.repeat(ends[i:j] - size[i:j] - (ends[i - 1] if i else 0), size[i:j])
                    at = words.texts[row[which]] + begin[which] + offset
                    cut = _ranges(words.hashes, at, at + length, 2) % np.uint64(every) == 0
                    cut |= offset == size[which] - 1
                    last = np.nonzero(cut)[0]
                    first = np.append(0, last[:-1] + 1)
                    h1, h2 = word_hashes(words, at[first], at[last] + length)
                    item, owner = pa.array(which[first]), pa.array(row[which[first]])
                    place = (at[first] - words.texts[row[which[first]]]).astype(np.int32)
                    numbers = [offset[first].astype(np.int32), (last - first + 1).astype(np.int32), h1, h2]
                    columns = [*[flat.field(c).take(item) for c in ("h1", "h2")], *map(pa.array, numbers), flat.field("doc_id").take(item), *[part.column(c).take(owner) for c in ("k1", "k2")], pa.array(place)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return ship(docs).mapInArrow(run, f"p1 long, p2 long, start int, n int, h1 long, h2 long, doc_id {kind}, k1 long, k2 long, at int")


def _groups(ends: np.ndarray, most: int):
    """Ranges of items whose sizes add up to about ``most``; ``ends``: the running sum of the sizes."""
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _least(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Of each key: the smallest id, the number of rows, and whether other ids have it. Null ids are larger than any other."""
    others = (F.min("doc_id") < F.max("doc_id")) | (F.max(F.col("doc_id").isNull()) & F.min("doc_id").isNotNull())
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.coalesce(others, F.lit(False)).alias("others"), F.count("*").alias("n_rows"), *more)


_WORDS = ["h1", "h2"]


def _spans(members: DataFrame, equal: DataFrame, inner: DataFrame | None, by: list[str]) -> DataFrame:
    """
    ``by`` and ``spans``, the repeated windows of the ``members`` (``by``, start, n, h1, h2, doc_id): all of a member if equal ones (``equal``: of ``_least``) have
    a smaller id, else those that ``inner`` (h1, h2, spans) has for its words. Members are of one text, run or stretch, so ``spans`` is bounded by its words.
    """
    parts = equal.where("others").select(*_WORDS, "least", "n_rows")
    if inner is None:
        parts = parts.withColumn("spans", F.expr("cast(null as array<struct<start:int,stop:int>>)"))
    else:
        parts = parts.join(inner, _WORDS, "full").withColumn("n_rows", F.coalesce("n_rows", F.lit(1)))
    parts = common.written(parts.withColumn("has", F.lit(True)), "parts")
    rows = common.join_split(members, parts, _WORDS, "n_rows", members.count()).where("has")
    span = lambda a, b: F.struct((F.col("start") + a).alias("start"), (F.col("start") + b).alias("stop"))
    later = F.expr("least < doc_id or (doc_id is null and least is not null)")
    spans = F.when(later, F.array(span(F.lit(0), F.col("n")))).otherwise(F.transform("spans", lambda x: span(x["start"], x["stop"])))
    return rows.select(*by, spans.alias("spans")).where("size(spans) > 0").groupBy(*by).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _heads(members: DataFrame, *more: Column) -> DataFrame:
    """``_least`` by words, with n and the place (k1, k2, at) of the first."""
    place = F.min_by(F.struct("k1", "k2", "at"), F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2", "at")).alias("place")
    return _least(members, _WORDS, F.any_value("n").alias("n"), place, *more)


def _cut(docs: DataFrame, heads: DataFrame, every: int, length: int) -> DataFrame:
    """``pieces`` of ``heads``, each with the smallest id that its words have."""
    lists = heads.groupBy("place.k1", "place.k2").agg(F.collect_list(F.struct(*_WORDS, "place.at", "n", F.col("least").alias("doc_id"))).alias("ranges"))  # a text's own
    return pieces(docs.select("k1", "k2", "text").join(lists, ["k1", "k2"]), every, length)


def _with_shared(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose anchor has different ids in ``ids`` (anchor, doc_id; a row for each of ``rows``)."""
    shared = common.written(_least(ids, ["anchor"]).where("others").select("anchor", "n_rows", F.lit(True).alias("both")), "anchors")
    return common.join_split(rows, shared, ["anchor"], "n_rows", rows.count()).where("both").drop("both")


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """
    k1, k2 and ``spans``: ranges of windows (by first word; start and the one after the last) of each row of ``docs`` (k1, k2, doc_id, text) whose words are also in a
    document with a smaller doc_id. Rows without such windows are left out.
    """
    all_runs = common.written(runs(docs, length, seed), "runs")
    found = common.written(_with_shared(all_runs, all_runs.select("anchor", "doc_id")), "shared-runs")
    equal = common.written(_heads(found.withColumn("at", F.col("start")), F.any_value("anchor").alias("anchor")), "equal-runs")
    heads = _with_shared(equal.withColumnRenamed("n_rows", "members"), equal.select("anchor", F.col("least").alias("doc_id")))
    stretches = common.written(_cut(docs, heads, STRETCH, length), "stretches")
    equal_stretches = common.written(_heads(stretches), "equal-stretches")
    single = common.written(_cut(docs, equal_stretches, 1, length).drop("k1", "k2", "at"), "windows")
    windows = _spans(single, _least(single, _WORDS), None, ["p1", "p2"])
    parent = [F.col("p1").alias("h1"), F.col("p2").alias("h2"), "spans"]
    within = _spans(stretches, equal_stretches, windows.select(*parent), ["p1", "p2"])
    return _spans(found, equal, within.select(*parent), ["k1", "k2"])


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """
    Each row of ``docs`` (doc_id, text) without the words that a repeated window covers: row (the kept columns), n_words, n_removed, spans (maximal repeats: first
    word and the one after the last), kept (the other words, joined by one space).

    Windows are judged on the input. Null texts have no words, texts shorter than a window lose none. Equal ids are one document: they do not
    remove from each other. Null ids come after all others and remove nothing from each other. Repeated rows have the same result each. ``keep``
    may name columns of any names (doc_id, if not given). An empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    base = docs.select(F.struct(*keep).alias("row"), "doc_id", common.text_of().alias("text"))
    narrow = base.select(*row_keys(), "doc_id", "text")
    found = repeats(narrow, length, seed)
    joined = base.select("row", "text", *row_keys()).join(found, ["k1", "k2"], "left").select("row", "text", F.col("spans").alias("repeats"))
    ddl = f"row {joined.schema['row'].dataType.simpleString()}, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept string"

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, most=STEP_BYTES):
                words = words_of(part.column("text"))
                out = [_cleaned(words, i, part.column("repeats")[i].values, length) for i in range(part.num_rows)]
                n, gone, spans, kept = zip(*out)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "spans", "kept"])

    return ship(joined).mapInArrow(run, ddl)


def _cleaned(words: Words, i: int, repeats: pa.StructArray | None, length: int) -> tuple[int, int, list[dict], str]:
    first, last = int(words.texts[i]), int(words.texts[i + 1])
    n = last - first
    change = np.zeros(n + 1, np.int64)
    if repeats is not None:
        np.add.at(change, np.asarray(repeats.field("start")), 1)
        np.add.at(change, np.asarray(repeats.field("stop")) + (length - 1), -1)
    covered = np.cumsum(change)[:n] > 0
    edges = np.nonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))[0].tolist()
    stay = np.nonzero(~covered)[0] + first
    kept = b" ".join(words.raw[a:b].tobytes() for a, b in zip(words.starts[stay].tolist(), words.stops[stay].tolist()))
    return n, int(covered.sum()), [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])], kept.decode()


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated windows of 50 words. Odd inputs are handled as ``without_repeats`` says."""
    out = without_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
     windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM words)),
     least AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
     starts AS (SELECT doc_id, i FROM windows JOIN least USING (h) WHERE least < doc_id),
     each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
     marked AS (SELECT e.doc_id, e.i, e.word, max(s.i) OVER (PARTITION BY e.doc_id ORDER BY e.i) AS last FROM each e LEFT JOIN starts s ON e.doc_id = s.doc_id AND e.i = s.i)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(m.i) FILTER (WHERE m.last > m.i - 50)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE m.last IS NULL OR m.last <= m.i - 50), '')) AS kept_sha256
FROM words d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id
"""
