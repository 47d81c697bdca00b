"""
Conversation structure repair by signature deduplication.

A conversation's rows, in order, become one letter each (role and fault): its signature. Each distinct signature is solved once, the audit
(one letter for each edit) is joined back, and the edits are replayed over the rows.

The cheapest audit comes from a recursion over halves: the table of a piece holds, for each pair of states of the role grammar, the cheapest
(cost, audit) that leads from one to the other; two tables are combined over the state between them, and tables of short pieces are memoised.
All audits of a piece have one letter a row, so the least of two joined audits is that of the least halves. That needs audits without
insertions, and cheapest audits have none: a pair with an inserted turn can be left out, which saves INSERT, costs at most DELETE for the other turn
and DELETE for a system turn that is left alone, and 2 * DELETE < INSERT. The tests hold that against a search that may insert.

Scale: rows that agree are counted before they are dealt by conversation; the rest is streamed in order, nothing is grouped in memory but a
letter a row. A signature that many conversations share is a hot key of the join back, which is split. SHA-256 has no parallel form,
so the text of one conversation runs through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

#: Costs of the edits; TRUNCATED is added for a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: White space, and characters that end a sentence.
SPACE, ENDS = " \t\n\x0b\f\r", ".!?"
#: Role grammar (s?(ua)+)?: next state by state and role. 0: nothing yet, 1: system, 2: user, 3: assistant. A conversation may end in FINAL.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Letters of a piece whose table is remembered, such pieces, and rows or bytes of an output batch.
PIECE, PIECES, ROWS, BYTES = 32, 1 << 15, 4096, 1 << 22

Table = dict[int, dict[int, tuple[int, str]]]


def letter_table(letter: str) -> Table:
    """Edits of one row. Letters: s, u, a, x (another role), upper case if truncated, d for a row that has to go."""
    table: Table = {i: {i: (DELETE, "D")} for i in range(4)}
    if letter != "d":
        more = TRUNCATED if letter.isupper() else 0
        for cost, edit, roles in ((KEEP, "K", letter.lower()), (REROLE, "R", "ua")):
            for (i, role), j in NEXT.items():
                if role in roles:
                    table[i][j] = min(table[i].get(j, (cost + more, edit)), (cost + more, edit))
    return table


def combined(left: Table, right: Table) -> Table:
    out: Table = {}
    for i, ways in left.items():
        best: dict[int, tuple[int, str]] = {}
        for k, (cost, audit) in ways.items():
            for j, (more, rest) in right[k].items():
                if j not in best or (cost + more, audit + rest) < best[j]:
                    best[j] = (cost + more, audit + rest)
        out[i] = best
    return out


@lru_cache(maxsize=PIECES)
def _piece(signature: str) -> Table:
    return _halves(signature)


def _halves(signature: str) -> Table:
    if len(signature) == 1:
        return letter_table(signature)
    half = 1 << (len(signature) - 1).bit_length() - 1  # powers of two: long signatures share their pieces
    left, right = signature[:half], signature[half:]
    return combined(*(_piece(p) if len(p) <= PIECE else _halves(p) for p in (left, right)))


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; of equally cheap ones the ASCII-least audit."""
    if not signature:
        return 0, ""
    table = _piece(signature) if len(signature) <= PIECE else _halves(signature)
    return min(table[0][j] for j in FINAL if j in table[0])


def faults(rows: DataFrame) -> DataFrame:
    """
    Rows (conv_id, turn, role, text) with their faults: conv_id, pos (1, 2, ... by turn, nulls first, then role and text), turn, role, text, n (equal rows), letter
    (of the first of the n; the others are duplicates), initial. Null roles and texts are one space.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    equal = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    equal = equal.repartition("conv_id")  # serves both windows
    turn = F.col("turn").asc_nulls_first()
    once = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(turn))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(turn, "role", "text")).cast("long")
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(bare == "", "b").when(F.col("once") > 1, "d").when(F.substring(bare, -1, 1).isin(*ENDS), known).otherwise(F.upper(known))
    return equal.withColumn("once", once).withColumn("pos", pos).select("conv_id", "pos", "turn", "role", "text", "n", letter.alias("letter"), initial.alias("initial"))


def _streamed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, start, take, finish) -> Iterator[pa.RecordBatch]:
    """
    Runs over rows sorted by conv_id: ``start(conv_id)`` gives the state of a conversation, ``take(state, row)`` and ``finish(state)`` yield output rows.
    Output rows are given away in batches of ROWS rows or BYTES bytes of text.
    """
    out: list[tuple] = []
    size, state, current = 0, None, None

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def rows():
        nonlocal state, current
        for part in batches:
            for i in range(0, part.num_rows, ROWS):
                for row in part.slice(i, ROWS).to_pylist():
                    if state is None or row["conv_id"] != current:
                        if state is not None:
                            yield from finish(state)
                        current = row["conv_id"]
                        state = start(current)
                    yield from take(state, row)
        if state is not None:
            yield from finish(state)

    for row in rows():
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= ROWS or size >= BYTES:
            yield batch()
            out.clear()
            size = 0
    if out:
        yield batch()


def _id_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _arrow(ddl_of: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_of.schema)


def signatures(marked: DataFrame) -> DataFrame:
    """One row a conversation of ``faults``: conv_id, signature, gaps, blank, duplicate, truncated, illegal."""
    ddl = f"conv_id {_id_type(marked)}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
    schema = _arrow(marked.sparkSession.createDataFrame([], ddl))
    legal = {"su", "ua", "au"}

    def start(conv):
        return {"conv": conv, "letters": [], "turns": None, "counts": [0, 0, 0, 0], "last": None}

    def take(s, row):
        n, letter, turn = row["n"], row["letter"], row["turn"]
        blank, dead = letter == "b", letter in "bd"
        counts = s["counts"]
        counts[0] += n if blank else 0
        counts[1] += 0 if blank else n if dead else n - 1
        counts[2] += letter.isupper()
        counts[3] += n - 1 + (s["last"] is not None and s["last"] + row["initial"] not in legal)
        s["last"] = row["initial"]
        s["letters"].append("d" * n if dead else letter + "d" * (n - 1))
        if turn is not None:
            least, most, known = s["turns"] or (turn, turn, 0)
            s["turns"] = (least, turn, known + (not known or turn != most))
        return ()

    def finish(s):
        least, most, known = s["turns"] or (0, -1, 0)
        yield (s["conv"], "".join(s["letters"]), most - least + 1 - known, *s["counts"])

    def run(batches):
        return _streamed(batches, schema, start, take, finish)

    rows = marked.select("conv_id", "pos", "turn", "n", "letter", "initial").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ship(rows).mapInArrow(run, ddl)


def solved(found: DataFrame) -> DataFrame:
    """Adds cost and audit to the rows of ``signatures``, a table: each distinct signature is solved once."""
    ddl = "signature string, n long, cost long, audit string"

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [solve(s) for s in part.column("signature").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())], ["signature", "n", "cost", "audit"])

    known = ship(found.groupBy("signature").agg(F.count("*").alias("n"))).mapInArrow(run, ddl)
    return common.join_split(found, common.written(known, "audits"), ["signature"], "n", found.count())


def replayed(marked: DataFrame, audits: DataFrame) -> DataFrame:
    """
    The repaired rows of ``faults`` by ``audits`` (conv_id, audit): conv_id, at (1, 2, ...), role, text, edit (K, R or I). All rows of a conversation are in
    one partition, in order. An audit travels once, as the row before its conversation's rows.
    """
    ddl = f"conv_id {_id_type(marked)}, at long, role string, text string, edit string"
    schema = _arrow(marked.sparkSession.createDataFrame([], ddl))

    def start(conv):
        return {"conv": conv, "audit": "", "i": 0, "state": 0, "at": 0}

    def put(s, role, text, edit):
        s["state"] = NEXT[s["state"], role[:1]]
        s["at"] += 1
        return (s["conv"], s["at"], role, text, edit)

    def wanted(s):
        return ROLES["a" if s["state"] == 2 else "u"]

    def inserted(s):
        while s["audit"][s["i"] : s["i"] + 1] == "I":
            s["i"] += 1
            yield put(s, wanted(s), "", "I")

    def take(s, row):
        if row["pos"] == 0:
            s["audit"] = row["audit"]
            return
        for _ in range(row["n"]):
            yield from inserted(s)
            edit = s["audit"][s["i"]]
            s["i"] += 1
            if edit != "D":
                yield put(s, row["role"] if edit == "K" else wanted(s), row["text"], edit)

    def run(batches):
        return _streamed(batches, schema, start, take, inserted)

    rows = marked.select("conv_id", "pos", "role", "text", "n", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    return ship(rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "pos")).mapInArrow(run, ddl)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the newline-joined ``role:text`` of the rows that ``replayed`` gives, in their partitions."""
    ddl = f"conv_id {_id_type(repaired)}, repaired_sha256 string"
    schema = _arrow(repaired.sparkSession.createDataFrame([], ddl))

    def start(conv):
        return conv, hashlib.sha256()

    def take(s, row):
        s[1].update(f"{chr(10) if row['at'] > 1 else ''}{row['role']}:{row['text']}".encode())
        return ()

    def finish(s):
        yield s[0], s[1].hexdigest()

    return ship(repaired).mapInArrow(lambda batches: _streamed(batches, schema, start, take, finish), ddl)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """
    Structure repair of conversations ``rows`` (conv_id, turn, role, text, any other columns): (one row a conversation with signature, gaps, blank, duplicate,
    truncated, illegal, cost, audit; the repaired rows of ``replayed``).

    A null conv_id is a conversation of its own; null turns come first and make no gaps; null roles and texts are one space, so blank. Rows with equal
    turns are ordered by role and text, equal rows are one and its duplicates. Roles other than s..., u... and a... can only be reroled or
    deleted. An empty table gives empty tables.
    """
    marked = common.written(faults(rows), "faults")
    found = common.written(signatures(marked), "signatures")
    audits = common.written(solved(found), "conversations")
    return audits, replayed(marked, audits)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one row in five damaged, by crc32 of ``conv_id:turn``: dropped, emptied, its sentence ends removed, repeated or made a user's."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    out = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.expr("array_repeat(0, copies)"))).drop("copy", "copies")


def repaired_digests(rows: DataFrame) -> DataFrame:
    """The contract's columns for ``rows`` before damage; a conversation without rows after it has zeros, an empty audit and the hash of nothing."""
    audits, repaired = repair(damaged(rows))
    ids = rows.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = ids.alias("i").join(audits.alias("a"), F.col("i.conv_id").eqNullSafe(F.col("a.conv_id")), "left").join(digests(repaired).alias("d"), F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    return out.select(
        "i.conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired. Odd inputs are handled as ``repair`` says."""
    return repaired_digests(common.table(spark, sf_dir, "conversations"))
