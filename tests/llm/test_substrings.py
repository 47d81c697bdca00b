"""Removal of repeated windows against plain loops and SQL."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripple.llm import common, queries, substrings


def brute(rows, length):
    """(n_words, n_removed, kept) of each row (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = lambda d: (d is None, d or 0)
    least = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            least[key] = min(least.get(key, rank(doc)), rank(doc))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < rank(doc):
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def cleaned(df, length=substrings.LENGTH, seed=substrings.SEED):
    return [(r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(df, length, seed).collect()]


@pytest.mark.parametrize("length,seed", [(50, 26), (6, 3), (3, 1), (4, 4)])
def test_repeats(spark, length, seed):
    """Passages at any place, one within another, of exactly the length or one word less, few different words, and a third of all rows with one passage."""
    r = random.Random(length)
    vocabulary = [f"w{i}" for i in range(5 if length < 10 else 3000)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [some(n) for n in (length, length, length - 1, 2 * length, 3 * length + 5)]
    hot = some(length + 7)
    rows = []
    for i in range(240):
        text = some(r.randrange(0, 3 * length))
        for p in r.sample(passages, r.randrange(3)):
            text = f"{text} {p} {some(r.randrange(0, length))}"
        rows.append((r.randrange(200), f"{text}\n{hot}" if i % 3 == 0 else text))
    got = cleaned(spark.createDataFrame(rows, "doc_id long, text string"), length, seed)
    assert Counter(got) == Counter((d, *x) for (d, _), x in zip(rows, brute(rows, length)))


def test_op13(spark, sf_dir, duck):
    got = queries.queries()["op13_substrings"](spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, sf_dir, "documents").collect()]
    want = sorted((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for (d, _), (n, g, k) in zip(rows, brute(rows, 50)))
    assert sorted(map(tuple, got)) == want
    assert sorted(duck.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({queries.oracle_sql()['op13_substrings']})").fetchall()) == want


def test_substrings_odd(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows and ids, other characters, clashing columns, an empty table."""
    passage = " ".join(f"naïve{i}日本" for i in range(60))
    long = "word " * 30_000 + passage
    rows = [(1, None), (2, ""), (3, " \n\t\x0b\f\r "), (4, passage), (4, passage + " and more"), (5, long), (6, long), (6, long), (7, "x" * 70_000), (None, passage), (None, long), (None, None), (8, "a b " * 60), (9, "a b " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "k1", "k2", "anchor", "n", "least", "start", "h1", "p1", "at", "ranges", "spans", "repeats", "kept"):
        df = df.withColumn(name, F.lit("x"))
    assert Counter(cleaned(df)) == Counter((d, *x) for (d, _), x in zip(rows, brute(rows, 50)))
    spans = {(r["row"]["doc_id"], r["n_words"]): [tuple(s) for s in r["spans"]] for r in substrings.without_repeats(df).collect()}
    assert spans[6, 30_060] == [(0, 30_060)] and spans[4, 60] == [] and spans[None, 60] == [(0, 60)]
    assert cleaned(spark.createDataFrame([], "doc_id long, text string")) == []


@given(st.lists(st.text("ab \n", max_size=12), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_of(texts):
    """Words of texts that touch in memory, and equal hashes for equal words only."""
    words = substrings.words_of(pa.array(texts, pa.string()))
    got = [[bytes(words.raw[a:b]).decode() for a, b in zip(words.starts[i:j], words.stops[i:j])] for i, j in zip(words.texts[:-1], words.texts[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    flat = [w for ws in got for w in ws]
    assert len(set(flat)) == len(set(words.hashes.tolist()))
