"""Vector codes against k-means in plain whole-number loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripple.llm import queries, vector_codes


@pytest.mark.parametrize("seed,n,k,width,top", [(0, 500, 256, 16, 300), (1, 40, 7, 16, 3), (2, 100, 256, 5, 2), (3, 60, 30, 16, 1 << 23), (4, 9, 1, 1, 5), (5, 5000, 16, 4, 1), (6, 30, 9, 33, 4)])
def test_nearest(seed, n, k, width, top):
    """All widths, ties, and numbers that need 64 bits."""
    r = np.random.default_rng(seed)
    v, b = r.integers(-top, top + 1, (n, width)), r.integers(-top, top + 1, (k, width))
    index, distance = vector_codes.nearest(v, b)
    full = ((v[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def brute(rows):
    """rows: (vec_id, embedding, label), without odd ids."""
    kept = sorted(((i, [math.floor(1024 * x) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:2])
    width = len(kept[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in part[:256]] for part in parts]

    def assign(p):
        d = ((np.array(parts[p])[:, None, :] - np.array(books[p])[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1).tolist(), d.min(axis=1).tolist()

    for _ in range(4):
        for p in range(4):
            index, _ = assign(p)
            for e in set(index):
                mine = [x for x, i in zip(parts[p], index) if i == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [assign(p) for p in range(4)]
    codes = ["".join(f"{found[p][0][i]:02x}" for p in range(4)) for i in range(len(kept))]
    errors = [sum(found[p][1][i] for p in range(4)) for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    labels = {}
    for (_, _, la), e in zip(kept, errors):
        labels[la] = labels.get(la, 0) + e
    return sorted((i, c, e, labels[la], digest) for (i, _, la), c, e in zip(kept, codes, errors))


COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_op12(spark, sf_dir, duck):
    got = queries.queries()["op12_vector_codes"](spark, sf_dir).select(*COLUMNS).collect()
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()])
    assert sorted(map(tuple, got)) == want
    assert sorted(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_vector_codes']})").fetchall()) == want


def test_vectors_odd(spark):
    """Null and broken vectors, vectors of other lengths, null labels and ids, repeated rows, ties, fewer vectors than entries, clashing columns, nothing at all."""
    ddl = "vec_id long, embedding array<float>, label int"
    r = np.random.default_rng(5)
    good = [(i, [float(np.float32(x)) for x in r.normal(size=8)], None if i % 3 == 0 else i % 3) for i in range(30)]
    good += [good[7], good[7], (40, [0.0] * 8, 1), (41, [0.0] * 8, 1), (42, [-1e-3] * 8, 2)]
    bad = [(50, None, 1), (51, [1.0] * 7 + [None], 1), (52, [float("nan")] * 8, 1), (53, [1.0] * 7 + [float("inf")], 1)]
    df = spark.createDataFrame(good + bad, ddl)
    for name in ("row", "v", "code", "error", "n", "none", "slot"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, vector_codes.vector_codes(df).select(*COLUMNS).collect())) == brute(good)
    more = spark.createDataFrame([*good, (60, [1.0] * 4, 1), (61, [1.0] * 7, 1), (62, [], 1), (63, [3e38] * 8, 1), (None, [9.0] * 8, 9)], ddl)
    rows = vector_codes.vector_codes(more).select(*COLUMNS).collect()
    assert len(rows) == len(good) + 1 and {r["vec_id"] for r in rows} == {i for i, _, _ in good} | {None}
    for nothing in ([], bad[:1], [(None, [1.0] * 8, 1)]):
        assert vector_codes.vector_codes(spark.createDataFrame(nothing, ddl)).collect() == []
