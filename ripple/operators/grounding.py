"""
Which names are backed by evidence: equal to an entry of a corpus, or one part of the other (P42-P44), for tables of both.

Containment is found by an index of three-character parts, never by holding each name against each entry: what is to be
found goes under its rarest part only, what is searched under all of its parts, and the pairs that meet are verified.
"""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: A name, lower-cased, in the bytes of a text; names that a task remembers as given already.
NAME, REMEMBERED = rb"[a-z_][a-z0-9_]*", 500_000
#: Characters of a part; names and entries of fewer are only equal or not.
GRAM = 3


def names_of(texts: DataFrame, key: str) -> DataFrame:
    """``key`` and name: the distinct lower-cased names (letters A to Z, digits and _) of each row's text. Null texts have none."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        find = re.compile(NAME).findall
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                found = [set(find(t.lower())) for t in part.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()]
                at = pa.array(chain.from_iterable([k] * len(x) for k, x in enumerate(found)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(chain.from_iterable(found), pa.binary()).cast(pa.string())], [key, "name"])

    return ship(texts.select(key, F.col("text").cast("string"))).mapInArrow(run, f"{key} {kind}, name string")


def name_set(texts: DataFrame) -> DataFrame:
    """name: the distinct names of all texts; see ``names_of``. A task does not give a name again that it remembers."""

    def run(batches):
        find, seen = re.compile(NAME).findall, set()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                texts = batch.column(0).slice(lo, 256).cast(pa.large_binary()).fill_null(b"").to_pylist()
                found = set(chain.from_iterable(find(t.lower()) for t in texts)) - seen
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen |= found
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], ["name"])

    return ship(texts.select(F.col("text").cast("string"))).mapInArrow(run, "name string").distinct()


def grams(text: Column) -> Column:
    """Each part of GRAM characters once."""
    last = F.length(text) - (GRAM - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))


def contained(needles: DataFrame, hays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """
    ``by``, needle, hay: each needle of GRAM characters or more with every hay that it is a part of, within equal ``by``. needles: by, needle; hays:
    by, hay; both distinct. A needle with a part that no hay has meets nothing.
    """
    key = [*by, "gram"]
    parts = hays.where(F.length("hay") >= GRAM).select(*by, "hay", F.explode(grams(F.col("hay"))).alias("gram"))
    often = parts.groupBy(*key).agg(F.count("*").alias("n"))
    asked = needles.where(F.length("needle") >= GRAM).select(*by, "needle", F.explode(grams(F.col("needle"))).alias("gram")).join(often, key, "left")
    rarest = asked.groupBy(*by, "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("at")).where("at.n > 0")
    return parts.join(rarest.select(*by, "needle", "at.gram"), key).where(F.contains("hay", "needle")).select(*by, "needle", "hay")


def supported(names: DataFrame, entries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """
    ``by``, name and supported for each distinct lower-cased name of ``names`` (by, name): whether an entry of ``entries`` (by, entry)
    with equal ``by`` is the name, holds it, or is held by it (names and entries of GRAM characters or more). Null names are left out; without entries nothing is supported.
    """
    n = names.select(*by, F.lower("name").alias("name")).where("name is not null").distinct()
    e = entries.select(*by, F.lower("entry").alias("entry")).where("entry is not null").distinct()
    equal = n.join(e.withColumnRenamed("entry", "name"), [*by, "name"], "left_semi")
    within = contained(n.withColumnRenamed("name", "needle"), e.withColumnRenamed("entry", "hay"), by).select(*by, F.col("needle").alias("name"))
    around = contained(e.withColumnRenamed("entry", "needle"), n.withColumnRenamed("name", "hay"), by).select(*by, F.col("hay").alias("name"))
    found = equal.unionByName(within).unionByName(around).distinct().withColumn("supported", F.lit(True))
    return n.join(found, [*by, "name"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))
