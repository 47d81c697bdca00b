"""The relational line comparison against the same rule in one process, and what any comparison has to keep."""

import random
from collections import Counter

from ripple.operators import line_diff
from ripple.sources.overlay import changed_spans


def matched(base, new):
    """Pairs (base, new) of the rule, by recursion over the gaps of each segment's anchors."""
    if not base or not new:
        return []
    cb, cn = Counter(x for _, x in base), Counter(x for _, x in new)
    for rank in range(3):
        pairs = []
        for x in cb.keys() & cn.keys():
            if rank == (0 if cb[x] == cn[x] == 1 else 1 if cb[x] == cn[x] else 2):
                pairs += zip([i for i, y in new if y == x], [i for i, y in base if y == x])
        if pairs:
            break
    else:
        return []
    got = [(b, n) for n, b in line_diff.chain(sorted(pairs))]
    out, edges = list(got), [(-1, -1), *got, (10**9, 10**9)]
    for (b0, n0), (b1, n1) in zip(edges, edges[1:]):
        out += matched([x for x in base if b0 < x[0] < b1], [x for x in new if n0 < x[0] < n1])
    return sorted(out)


def test_chain():
    r = random.Random(0)
    for _ in range(200):
        n = r.randrange(9)
        pairs = list(enumerate(r.sample(range(n), n)))
        best = max((len(c) for c in _chains(pairs)), default=0)
        got = line_diff.chain(pairs)
        assert len(got) == best and got == sorted(got) and all(a[1] < b[1] for a, b in zip(got, got[1:]))


def _chains(pairs):
    if not pairs:
        yield []
        return
    for rest in _chains(pairs[1:]):
        yield rest
        if not rest or rest[0][1] > pairs[0][1]:
            yield [pairs[0], *rest]


def test_text_spans(spark):
    """Moved, repeated, replaced, deleted and inserted blocks, few different lines, all Unicode line ends, empty and null texts, paths on one side only."""
    r = random.Random(3)
    pairs = [("a\nb\n", "a\nb\n\n\n\n"), ("a\nb\nc\n", "a\nc\n"), ("", "x\ny"), (None, "x"), ("x", None), (None, None), ("", ""), ("a\r\nb\x0bc", "a\r\nd\x0bc"), ("s\n" * 50, "s\n" * 53), ("\n" * 400 + "a", "a" + "\n" * 400)]
    for k in range(40):
        few = [f"line {i}" for i in range(2 if k % 4 == 0 else 40)]
        base = [r.choice(few) for _ in range(r.randrange(60))]
        new = list(base)
        for _ in range(r.randrange(5)):
            i, j = sorted((r.randrange(len(new) + 1), r.randrange(len(new) + 1)))
            what = r.randrange(4)
            block = new[i:j]
            if what == 0:
                del new[i:j]
            elif what == 1:
                new[i:i] = [r.choice([*few, "fresh"]) for _ in range(3)]
            else:
                if what == 2:
                    del new[i:j]
                at = r.randrange(len(new) + 1)
                new[at:at] = block
        pairs.append(("\n".join(base), "\n".join(new)))
    df = spark.createDataFrame([("r", f"f{k}", b, t) for k, (b, t) in enumerate(pairs)], "repo string, path string, base string, text string")
    got = {}
    for row in line_diff.text_spans(df).collect():
        got.setdefault(row["path"], []).append((row["start"], row["stop"]))
    for k, (base, text) in enumerate(pairs):
        old, new = (list(enumerate((x or "").splitlines(), 1)) for x in (base, text))
        pairs_ = matched(old, new)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs_, pairs_[1:])) and all(old[b - 1][1] == new[n - 1][1] for b, n in pairs_)
        want = sorted({n for n, _ in new} - {n for _, n in pairs_})
        lines = [n for a, b in sorted(got.get(f"f{k}", [])) for n in range(a, b + 1)]
        assert lines == want, (base, text)
    assert sorted(got["f0"]) == [(3, 5)] == changed_spans(*pairs[0]) and "f1" not in got and got["f8"] == [(51, 53)]
    assert line_diff.text_spans(df.where("false")).collect() == []


def test_many_rounds_and_equal_lines(spark):
    """A text of one line many times over, and one whose halves are swapped."""
    n = 3000
    swapped = [f"x{i}" for i in range(n)]
    rows = [("r", "same", "a\n" * n, "a\n" * (n + 7)), ("r", "swap", "\n".join(swapped), "\n".join(swapped[n // 3 :] + swapped[: n // 3]))]
    df = spark.createDataFrame(rows, "repo string, path string, base string, text string")
    assert sorted(map(tuple, line_diff.text_spans(df).select("path", "start", "stop").collect())) == [("same", n + 1, n + 7), ("swap", n - n // 3 + 1, n)]


def test_anchors_of_many_segments(spark):
    """Segments are dealt over all tasks of a shuffle, and many share a batch; each gave a batch of its own before, in one or two tasks."""
    rows = spark.range(3000).selectExpr("'r' AS repo", "concat('f', id % 1000) AS path", "0 AS segment", "0 AS rank", "CAST(id div 1000 AS int) + 1 AS base", "CAST(id div 1000 AS int) + 1 AS new")
    got = line_diff._anchors(rows)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.selectExpr("count(*)", "count(distinct path)", "sum(base)", "sum(new)").first() == (3000, 1000, 6000, 6000)
    count = lambda batches: (b.slice(0, 1).select(["repo"]) for b in batches)  # noqa: E731  a row for each batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        assert got.mapInArrow(count, "repo string").count() <= 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_disk(spark):
    """Moved blocks leave little on disk: a round keeps what is open or unmatched, and gaps with equal sides are neither."""
    from pathlib import Path

    n, k = 1000, 20
    block = lambda f, b: f"order {f} {b}\n{{\nof {f} {b}\n}}\n"
    rows = [("r", f"f{f}", "".join(block(f, b) for b in range(k)), "".join(block(f, b) for b in [*range(1, k), 0]).replace("{", "(", 1)) for f in range(n)]
    df = spark.createDataFrame(rows, "repo string, path string, base string, text string")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(x.stat().st_size for x in shared.rglob("*") if x.is_file())
    before = size()
    got = line_diff.text_spans(df)
    assert size() - before < 4 * 2 * 4 * k * n  # bytes for each line of both sides
    assert got.selectExpr("count(*)", "sum(start)", "sum(stop)").first() == (2 * n, n * (2 + 4 * k - 3), n * (2 + 4 * k))


def test_paths_of_many_repositories(spark):
    """Equal paths are dealt by repository, and keys that are null are left out."""
    rows = [(f"r{k}", "a.py", "x\ny\nz", "x\nz\n" + "n\n" * (k % 3)) for k in range(50)] + [(None, "a.py", "x", "y"), ("r", None, "x", "y")]
    df = spark.createDataFrame(rows, "repo string, path string, base string, text string")
    assert sorted(map(tuple, line_diff.text_spans(df).select("repo", "path", "start", "stop").collect())) == sorted((f"r{k}", "a.py", 3, 2 + k % 3) for k in range(50) if k % 3)
