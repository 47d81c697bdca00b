"""Repair of conversations against a search over all edits, insertions included, and the whole query against plain loops."""

import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripple.llm import common, conversations, queries

SPACE = " \t\n\x0b\f\r"


def searched(signature: str) -> tuple[int, str]:
    """The least (cost, audit) over keeping, reroling, deleting and up to three insertions, by plain recursion from the left."""

    @lru_cache(None)
    def best(i: int, state: int, inserts: int):
        found = []
        if i == len(signature) and state in (0, 3):
            found.append((0, ""))
        if inserts:
            for role in "ua":
                if (state, role) in conversations.NEXT:
                    cost, rest = best(i, conversations.NEXT[state, role], inserts - 1)
                    found.append((cost + 5, "I" + rest))
        if i < len(signature):
            c = signature[i]
            cost, rest = best(i + 1, state, inserts)
            found.append((cost + 2, "D" + rest))
            if c != "d":
                more = 5 if c.isupper() else 0
                for edit, price, roles in (("K", 0, c.lower()), ("R", 1, "ua")):
                    for role in roles:
                        if (state, role) in conversations.NEXT:
                            cost, rest = best(i + 1, conversations.NEXT[state, role], inserts)
                            found.append((cost + price + more, edit + rest))
        return min(found, default=(10**9, ""))

    return best(0, 0, 3)


@given(st.text("suaxdSUAX", max_size=9))
@settings(max_examples=400, deadline=None)
def test_solve(signature):
    assert conversations.solve(signature) == searched(signature)


def test_solve_long():
    """Pieces of all sizes; a signature of a hundred thousand letters."""
    for n in (31, 32, 33, 64, 65, 200):
        text = ("suaauudxaUsA" * 20)[:n]
        assert conversations.solve(text) == searched(text)
    assert conversations.solve("ua" * 50_000) == (0, "KK" * 50_000)


def brute(rows):
    """The contract in loops: rows of (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, letters, counts = set(), "", [0, 0, 0]
        for _, role, text in got:
            bare = text.strip(SPACE)
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not bare:
                counts[0] += 1
                c = "d"
            elif (role, text) in seen:
                counts[1] += 1
                c = "d"
            elif bare[-1] not in ".!?":
                counts[2] += 1
                c = c.upper()
            seen.add((role, text))
            letters += c
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        turns = [t for t, _, _ in got if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = searched(letters)
        state, lines = 0, []
        for (_, role, text), edit in zip(got, audit):
            if edit != "D":
                role = role if edit == "K" else "assistant" if state == 2 else "user"
                state = conversations.NEXT[state, role[:1]]
                lines.append(f"{role}:{text}")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_op11(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()["op11_conversations"](spark, sf).collect()
    want = brute([tuple(r) for r in common.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == len(want) and {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_conversations_odd(spark):
    """Nulls in every column, blank and long texts, ties, repeated rows, unknown and empty roles, clashing columns, an empty table."""
    ddl = "conv_id long, turn long, role string, text string"
    long = "word " * 50_000 + "end."
    rows = [(c, t, r, x) for c in (None, *range(40)) for t, r, x in [
        (None, "system", "Rules."), (0, "user", "Hello there."), (0, "user", "Hello there."), (1, "assistant", "Yes!"), (1, None, "no role"), (2, "", "empty role."), (3, "tool", "odd role."),
        (4, "user", None), (5, "assistant", "\n\t "), (6, "user", "no end"), (9, "assistant", "Ends with a separator. "), (9, "assistant", "Yes!"), (11, "user", long), (None, None, None)]]
    df = spark.createDataFrame(rows, ddl)
    for name in ("pos", "n", "letter", "audit", "signature", "copies", "once"):
        df = df.withColumn(name, F.lit("x"))
    got = conversations.repaired_digests(df).collect()
    want = brute(rows)
    assert len(got) == len(want) and {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert conversations.repaired_digests(spark.createDataFrame([], ddl)).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert tuple(conversations.repaired_digests(spark.createDataFrame([(dropped, 0, "user", "Hi.")], ddl)).first())[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_hot_conversation(spark):
    """One conversation with many equal and many different rows."""
    rows = [(7, i // 2, "ua"[i % 2].replace("u", "user").replace("a", "assistant"), f"Line {i % 500}.") for i in range(20_000)] + [(7, 3, "user", "Same.")] * 3000
    audits, repaired = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    row = audits.first()
    assert len(row["audit"]) == len(rows) and row["duplicate"] == len(rows) - 501 and row["gaps"] == 0
    kept = repaired.orderBy("at").collect()
    assert len(kept) == len(row["audit"].replace("D", "")) and re.fullmatch("(ua)+", "".join(r["role"][0] for r in kept))
