"""
Vector codes: product quantisation in whole numbers, nearest entries by partial-distance search.

Vectors are scaled to integers and cut into parts; each part has a codebook that a few rounds of k-means settle. The nearest entry is searched by dimensions
in descending variance over the codebook: after the first few, the entry that leads is measured in full, and entries whose sum so far strictly
exceeds the least full distance known are masked out; the rest go on to the next dimensions. Sums are integers, so the result is exact and the same
at every partitioning.

Scale: vectors are read once a round; each task adds up its own vectors by part and entry, and Spark adds the sums. The driver holds the codebooks only:
ENTRIES * dimension integers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components are below this in magnitude: squared distances of 2^12 dimensions then fit 64 bits. Vectors beyond are left out.
MOST = 1 << 24
#: Dimensions that are added before each masking, and vectors searched together.
STEP, ROWS = 4, 2048


def scaled(vectors: DataFrame, keep: list[str], column: str = "embedding") -> DataFrame:
    """``row`` (the kept columns) and ``v``, floor(SCALE * x) of each component, of the vectors without null, non-finite or overlarge components."""
    v = F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(x * SCALE))
    good = F.forall(F.col(column).cast("array<double>"), lambda x: x.isNotNull() & (F.abs(x) * SCALE < MOST))  # false for NaN too, which is larger than all
    return vectors.where(F.col(column).isNotNull() & F.coalesce(good, F.lit(False))).select(F.struct(*keep).alias("row"), v.cast("array<int>").alias("v"))


def first_codebooks(ints: DataFrame) -> list[np.ndarray]:
    """The parts of the vectors with the ENTRIES smallest ids (of equal ids the least vector first; null ids are no entries), ascending."""
    rows = ints.where("row.vec_id is not null").orderBy("row.vec_id", "v").limit(ENTRIES).select("v").collect()  # ENTRIES rows at most
    if not rows:
        return []
    books = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), -1)
    width = books.shape[1] // PARTS
    return [books[:, p * width : (p + 1) * width] for p in range(PARTS)]


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` for each row of ``vectors``; of equally near ones the lowest index."""
    n, width = vectors.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    top = int(max(np.abs(vectors).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * top * top * width < 1 << 31 else np.int64
    order = np.argsort(-book.var(axis=0), kind="stable")
    v, b = np.ascontiguousarray(vectors[:, order].astype(kind)), np.ascontiguousarray(book[:, order].astype(kind))
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in range(0, n, ROWS):
        some = v[at : at + ROWS]
        index[at : at + ROWS], distance[at : at + ROWS] = _nearest(some, b)
    return index, distance


def _full(v: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((v - b) ** 2).sum(axis=1, dtype=v.dtype)


def _nearest(v: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, width = v.shape
    sums = np.zeros((n, len(b)), v.dtype)
    for d in range(min(STEP, width)):
        gap = v[:, d, None] - b[None, :, d]
        sums += gap * gap
    best = _full(v, b[sums.argmin(axis=1)])  # a complete distance for each vector
    row, entry = np.nonzero(sums <= best[:, None])
    part = sums[row, entry]
    for d in range(STEP, width, STEP):
        gap = v[row, d : d + STEP] - b[entry, d : d + STEP]
        part = part + (gap * gap).sum(axis=1, dtype=v.dtype)
        if d + STEP < width:
            # the entry that leads now is measured in full too
            starts = np.searchsorted(row, np.arange(n))
            lead = np.minimum.reduceat(part, starts)
            first = np.nonzero(part == lead[row])[0]
            first = first[np.unique(row[first], return_index=True)[1]]
            best = np.minimum(best, _full(v, b[entry[first]]))
            stay = part <= best[row]
            row, entry, part = row[stay], entry[stay], part[stay]
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(part, starts)
    first = np.nonzero(part == least[row])[0]  # by row, then entry
    first = first[np.unique(row[first], return_index=True)[1]]
    return entry[first], part[first]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims).astype(np.int64)


def next_codebooks(ints: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the componentwise floor of the mean of the parts assigned to it; entries without any stay."""
    k, width = books[0].shape

    def run(batches):
        sums, counts = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), PARTS * width)
            for p in range(PARTS):
                mine = v[:, p * width : (p + 1) * width]
                index, _ = nearest(mine, books[p])
                np.add.at(sums[p], index, mine)
                counts[p] += np.bincount(index, minlength=k)
        part, entry = np.nonzero(counts)
        if len(part):
            flat = np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1)
            dim = np.tile(np.arange(width + 1, dtype=np.int32), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part * k + entry, width + 1).astype(np.int32)), pa.array(dim), pa.array(flat.reshape(-1))], ["slot", "dim", "total"])

    sums = ship(ints.select("v")).mapInArrow(run, "slot int, dim int, total long").groupBy("slot", "dim").agg(F.sum("total").alias("total"))
    totals: dict[int, list[int]] = {}
    for r in sums.collect():  # PARTS * ENTRIES * (width + 1) rows at most
        totals.setdefault(r["slot"], [0] * (width + 1))[r["dim"]] = r["total"]
    out = [b.copy() for b in books]
    for slot, (count, *total) in totals.items():
        out[slot // k][slot % k] = [t // count for t in total]
    return out


def encoded(ints: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``row``, ``code`` (index of each part, two hex digits) and ``error`` (squared distances summed over the parts)."""
    width = books[0].shape[1]
    kind = ints.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), PARTS * width)
            found = [nearest(v[:, p * width : (p + 1) * width], books[p]) for p in range(PARTS)]
            indexes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            text = [bytes(i).hex() for i in indexes]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string()), pa.array(sum(d.astype(np.int64) for _, d in found), pa.int64())], ["row", "code", "error"])

    return ship(ints).mapInArrow(run, f"row {kind}, code string, error long")


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def compress(vectors: DataFrame, keep: list[str], rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """
    Codes of ``vectors`` (vec_id, embedding; ``keep``: columns in ``row``, of any names) and the codebooks.

    Vectors that are null or hold nulls, NaN, infinities, or components beyond MOST / SCALE are left out, and so are vectors whose length is not
    that of the table: that of the smallest vec_id among those with a length that divides by PARTS. Equal ids start the codebooks in the order of
    their vectors; null ids are encoded but start no entry. Fewer vectors than ENTRIES give fewer entries. A table without vectors gives no codes.
    """
    spark = vectors.sparkSession
    ints = common.written(scaled(vectors, sorted({*keep, "vec_id"})), "vectors")
    ints = ints.where(F.size("v") % PARTS == 0)
    dims = ints.where("row.vec_id is not null").agg(F.min_by(F.size("v"), F.struct("row.vec_id", "v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], f"row {ints.schema['row'].dataType.simpleString()}, code string, error long"), []
    ints = ints.where(F.size("v") == dims)
    books = first_codebooks(ints)
    for _ in range(rounds):
        books = next_codebooks(ints, books)
    return encoded(ints, books), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over the rows with that label, null labels together), codebooks_sha256."""
    codes, books = compress(vectors, ["vec_id", "label"])
    label = F.col("row.label")
    rows = codes.select("row.vec_id", F.coalesce(label.cast("string"), F.lit("")).alias("label"), label.isNull().alias("none"), "code", "error")
    rows = common.written(rows, "codes")
    sums = rows.groupBy("label", "none").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = common.join_split(rows, common.written(sums, "label-errors"), ["label", "none"], "n", rows.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of four bytes. Odd inputs are handled as ``compress`` says."""
    return vector_codes(common.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """k-means in SQL: each round assigns all parts to all entries of their codebook."""
    width = "len(v) // 4"
    out = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS k, vec_id, label, v FROM (
              SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
            parts AS (SELECT k, p, v[p * ({width}) + 1 : (p + 1) * ({width})] AS v FROM kept, (SELECT unnest(range(4)) AS p)),
            book0 AS (SELECT p, k - 1 AS e, v FROM parts WHERE k <= 256)"""
    ]
    for r in range(ROUNDS + 1):
        out.append(
            f"""near{r} AS (SELECT k, p, min(d) AS d, arg_min(e, d * 256 + e) AS e FROM (
                  SELECT a.k, a.p, b.e, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d FROM parts a JOIN book{r} b USING (p)) GROUP BY k, p)"""
        )
        if r < ROUNDS:
            out.append(
                f"""sums{r} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS c FROM (
                      SELECT p, n.e, unnest(a.v) AS x, generate_subscripts(a.v, 1) AS i FROM parts a JOIN near{r} n USING (k, p)) GROUP BY p, e, i),
                    new{r} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS v FROM sums{r} GROUP BY p, e),
                    book{r + 1} AS (SELECT p, e, coalesce(n.v, b.v) AS v FROM book{r} b LEFT JOIN new{r} n USING (p, e))"""
            )
    out.append(
        f"""coded AS (SELECT k, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY k),
            digest AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(v, ',') AS x FROM book{ROUNDS}))"""
    )
    return f"""WITH {", ".join(out)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
               FROM kept JOIN coded USING (k), digest"""


ORACLE_SQL = _sql()
