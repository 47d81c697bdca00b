"""Helpers that the corpus operators share: tables, shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step of a Python operator looks at together (a longer text is a step of its own).
STEP_BYTES = 1 << 20

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none (tests) gets a temporary one; on a cluster that would be lost."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = "file://" + tempfile.mkdtemp(prefix="ripple-")
    return _own_dir["dir"]


_kept = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/ripple/{name}-{uuid.uuid4().hex}"
    for made in getattr(_kept, "made", [])[-1:]:
        made.append(path)
    return path


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of each data file of a table that ``written`` wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return [(f.getPath().toString(), f.getLen()) for f in found if f.getPath().getName().startswith("part-")]


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """
    Removes, at its end, all folders that ``new_path`` names in it. Results that are read lazily have to be written before, and outside:
    ``with scratch(spark): near_duplicates(docs).write.parquet(path)``.
    """
    stack = _kept.made = getattr(_kept, "made", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            remove(spark, path)


#: Rows of a narrow table in one file.
FILE_ROWS = 200_000


def written(df: DataFrame, name: str, rows: int | None = None, path: str | None = None, codec: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """
    ``df`` written to the shared folder and read again: short lineage, and lost executors lose nothing. ``rows``: a bound on
    a narrow table's rows; it is then written as few files, not as one for each shuffle partition. ``path``: of ``new_path``, if not a new one.
    ``codec``: of Parquet, if not the session's. ``group_bytes``: of its row groups, which are what readers may split a file into.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // FILE_ROWS)))
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more than 1 / HOT of all rows are hot; such a key's columns may have so many bytes.
HOT, HOT_BYTES = 1000, 4096


def join_split(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """
    ``rows`` left-joined with ``table`` (one row for each key, without null keys; ``weight``: the key's rows, dropped), where a key may hold any share of the
    ``total`` rows: those with more than 1 / HOT of them are HOT at most, so they are broadcast, HOT * HOT_BYTES bytes of keys at most.
    A longer key is left to the shuffled join, which adaptive execution may split. Both inputs are read twice and should be tables.
    """
    short = sum((F.octet_length(k) for k in keys), F.lit(0)) <= HOT_BYTES
    is_hot = (F.col(weight) * HOT > max(1, total)) & short
    hot, rest = table.where(is_hot).drop(weight), table.where(~is_hot).drop(weight)
    names = [c for c in table.columns if c not in (*keys, weight)]
    columns = [*rows.columns, *names]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    easy = marked.where("_hot").select(*columns)
    return easy.unionByName(marked.where("_hot is null").select(*rows.columns).join(rest, keys, "left").select(*columns))


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold_of(col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(folds)), F.lit(0)).cast("int")


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``most`` bytes of text each, none without rows."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).cast("int64"))
    ends = np.cumsum(sizes)
    at, n = 0, len(sizes)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``make`` builds the function once in each task."""

    def run(batches):
        f = make()
        for batch in batches:
            for part in steps(batch, column):
                yield f(part)

    return ship(df).mapInArrow(run, schema)


def array_bytes(column: pa.Array):
    """(bytes as uint8, offsets as int64) of a string column without nulls, offsets from 0."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, fold: Column) -> DataFrame:
    """
    About ``bound`` documents of each label value, whatever the length of their texts, as columns doc_id, text, label.

    The labels come first: candidates are the ``1.25 * bound`` smallest of xxhash64(doc_id) for each value,
    so the sample is the same at every partitioning and its size never depends on the corpus.
    A doc_id with several labels takes the largest, one with several texts the least; null ids or labels are no examples.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & fold).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("label = 1").orderBy(*order).limit(bound + bound // 4).unionByName(known.where("label = 0").orderBy(*order).limit(bound + bound // 4))
    # at most 2.5 * bound ids: a proven size for the broadcast
    got = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id")
    return got.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def collected_features(sample: DataFrame, make: Callable[[pa.Array], list[bytes]], bound: int, most_bytes: int | None = None) -> list:
    """
    Rows (doc_id, label, features) of a ``labelled_sample``, ``bound`` of each label at most. Features are made by the tasks, so the driver never
    sees a text.

    Features that grow with their text need ``most_bytes``, the bytes of each label's together: rows are taken whole, in the order of a hash of
    doc_id, and one that no longer fits is left out of the sample, never shortened. The features are then a table of the shared folder, of which
    the driver reads the sizes, and then the rows chosen. Without ``most_bytes`` each row's are of a fixed size.
    """

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(make(part.column("text")), pa.binary())], ["doc_id", "label", "features"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    made = ship(sample).mapInArrow(run, f"doc_id {kind}, label int, features binary")
    if most_bytes is None:
        chosen = _first(made.collect(), bound)  # 2.5 * bound rows at most, each of a fixed size
    else:
        made = written(made, "features")
        sizes = made.select("doc_id", "label", F.octet_length("features").alias("size")).collect()  # 2.5 * bound rows at most
        ids = [(r["doc_id"],) for r in _first(sizes, bound, most_bytes)]
        chosen = made.join(F.broadcast(made.sparkSession.createDataFrame(ids, f"doc_id {kind}")), "doc_id").collect()  # 2 * most_bytes at most
    return sorted(chosen, key=lambda r: (zlib.crc32(f"x{r['doc_id']}".encode()), str(r["doc_id"])))


def _first(rows: list, bound: int, most_bytes: int | None = None) -> list:
    """Of each label the first ``bound`` rows in the order of a hash of doc_id; with ``most_bytes``, of those whose sizes still fit."""
    kept: list = []
    for value in (0, 1):
        mine, left = sorted((r for r in rows if r["label"] == value), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]))), most_bytes
        for r in mine[:bound]:
            if left is not None:
                if r["size"] > left:
                    continue
                left -= r["size"]
            kept.append(r)
    return kept
