"""Corpus operators against brute force, the libraries, exact round trips and held-out labels; and their odd inputs."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripple.llm import common, jpeg, media, mixing, pieces, quality_mil, quality_rules, queries, simhash, token_codec, token_file, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "the end. " + "x" * 70_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty, blank and very long texts, null sources, repeated rows, and columns with clashing names."""
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "  \n\t", "en", "a", 4), (4, LONG, "en", "b", len(LONG)), (5, "one two three four five. six\nseven", "en", "a", 3), (5, "one two three four five. six\nseven", "en", "a", 3), (5, "another text with the same id", "en", "b", 9), (None, "no id here, is there", "en", None, 1), (None, None, None, None, None), (9, "naïve ▁ 日本語\x00 \u2028 end", "en", "c", 2)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("row", "fp", "size", "score", "target", "taken", "finish", "h", "_hash", "least", "component_id", "kept", "media", "at"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return common.table(spark, sf_dir, "labels")


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


# 1, 2, 7: classifiers


@pytest.mark.parametrize("name,label,threshold,folds,out", [("op1_quality", "quality", 0.3, 5, 0), ("op2_toxicity", "toxic", 0.7, 3, 1)])
def test_classifiers(spark, duck, name, label, threshold, folds, out):
    big = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.queries()[name](spark, big).collect()}
    want = {r["doc_id"]: r[label] for r in common.table(spark, big, "labels").collect()}
    assert len(rows) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % folds == out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for k, r in rows.items())
    held = [(want[k], rows[k]["predicted"]) for k in want if rows[k]["held_out"]]
    right = Counter(held)
    assert (right[1, 1] + right[0, 0]) / len(held) > 0.97
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.8 and right[0, 0] / (right[0, 0] + right[0, 1]) > 0.9


def test_toxic_sentences():
    clean = [(f"calm words number {k} go on. and then more of them come", 0) for k in range(60)]
    # only one word is common to the offending sentences
    toxic = [(f"calm words number {k} go on. q{k * 7919:x} grumblefoot z{k * 104729:x}. and then more of them come", 1) for k in range(60)]
    model = toxicity.fit([(toxicity.bag(t), y) for t, y in clean + toxic])
    total, p, sents = toxicity.scorer(model)("first it is calm. what a grumblefoot he is. and then more")
    assert total > 0.7 and int(p.argmax()) == 1 and b"grumblefoot" in sents[1]
    assert toxicity.scorer(model)("it is calm. " * 2000)[0] < 0.7
    assert abs(total - (1 - np.prod(1 - p))) < 1e-9
    assert toxicity.scorer(toxicity.fit([]))("some text")[0] < 0.7 and toxicity.scorer(model)("")[0] == 0


def test_toxic_length(spark):
    """Length alone makes nothing toxic: clean documents joined to one of tens of thousands of sentences, and one line many times; one offending sentence among them still counts."""
    big = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, big, "documents"), common.table(spark, big, "labels")
    score = toxicity.scorer(toxicity.fit_on(docs, labels))
    marked = [(r["text"] or "", r["toxic"]) for r in docs.join(labels.where("toxic is not null"), "doc_id").orderBy("doc_id").collect()]
    clean = [t for t, y in marked if not y and score(t)[0] < 0.3]
    joined = "\n".join(clean)
    assert len(toxicity.sentences(joined)) > 20_000 and score(joined)[0] < 0.7
    assert score("it is a calm day. " * 50_000)[0] < 0.7 and score(clean[0] * 1000)[0] == pytest.approx(score(clean[0])[0], abs=0.05)
    toxic = next(t for t, y in marked if y and score(t)[0] > 0.95)
    assert score(joined + "\n" + toxic)[0] > 0.7


def test_attention_gradient():
    """One step of fitting lowers the loss, and attention weights of a text sum to 1."""
    rng = np.random.default_rng(0)
    x, counts = rng.random((60, quality_mil.FEATURES)).astype(np.float32), np.full(20, 3)
    y = (np.arange(20) % 2).astype(np.float32)
    x[:, 0] += np.repeat(y, 3) * 2
    m = quality_mil.fit(x, counts, y, epochs=60)
    score, a = m.score(x, counts)
    assert ((score > 0.5) == y).mean() > 0.9 and np.allclose(a.reshape(20, 3).sum(1), 1, atol=1e-5)


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té#|\x0b\x1c\u2028", max_size=60))
def test_base_counts(text):
    assert quality_rules.base_counts(text) == brute_counts(text)


def test_quality_rules(spark, sf_dir, docs, labels):
    rows = {r["doc_id"]: r for r in queries.queries()["op7_quality_rules"](spark, sf_dir).collect()}
    for k, t in texts(docs).items():
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    good = [r for r in labels.where("quality = 1").collect() if not rows[r["doc_id"]]["base_failed"]]
    assert sum(rows[r["doc_id"]]["kept"] for r in good) / len(good) > 0.97


def test_quality_rules_held_out(spark):
    """On rows that fitting has not seen: bad ones go, good ones stay, and scores are probabilities."""
    big = "/root/testdata/sf0.1"
    scored = quality_rules.op7_quality_rules(spark, big)
    truth = common.table(spark, big, "labels").where(common.fold_of("doc_id", 5) == 0)
    rows = scored.join(truth, "doc_id").where("not base_failed").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert len(bad) > 40 and sum(r["kept"] for r in bad) / len(bad) < 0.05 and sum(r["kept"] for r in good) / len(good) > 0.98
    assert all(r["kept"] == (r["score"] >= quality_rules.KEEP) for r in rows)
    assert abs(sum(r["score"] for r in rows) - len(good)) / len(rows) < 0.02
    assert sum(r["n"] for r in quality_rules.reliability(scored, common.table(spark, big, "labels")).collect()) == len(rows)


def test_quality_rules_odd(odd, none, labels):
    model = quality_rules.fit_on(none, labels)
    rows = quality_rules.judge_documents(odd, model, keep=odd.columns).collect()
    assert len(rows) == 10 and all(r["base_failed"] for r in rows if not (r["row"]["text"] or "").split()) and quality_rules.judge_documents(none, model).count() == 0
    assert len({(r["score"], r["kept"]) for r in rows if r["row"]["doc_id"] == 5 and r["row"]["n_chars"] == 3}) == 1
    assert [r["base_failed"] for r in rows if r["row"]["doc_id"] == 4] == [True]  # one word 30,000 times


def brute_rules(model, text):
    """The score of op7: byte trigrams, words and pairs of words, hashed and counted one by one."""
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    x = np.zeros(quality_rules.FEATURES)
    for i in range(len(b)):
        at = [b[i - k] + 1 if i >= k else 0 for k in range(3)]
        h = at[0]
        for k in (1, 2):
            h = (h * 0x01000193 + at[k] * (2 * k + 7)) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        x[(h >> 12) % quality_rules.CHARS] += 1 / len(b)
    words = []
    for w in b.split():
        h = sum((c + 1) * pow(0x9E3779B97F4A7C15, j, 2**64) for j, c in enumerate(w)) % 2**64
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        words.append(h ^ h >> 32)
    pairs = [(v * 0x9E3779B97F4A7C15 + u) % 2**64 for u, v in zip(words, words[1:])]
    grams = words + [p ^ p >> 31 for p in pairs]
    for h in grams:
        x[quality_rules.CHARS + (h >> 40) % quality_rules.WORDS] += 1 / len(grams)
    z = model.slope * (np.sqrt(x) @ model.w + model.b) + model.shift
    return 1 / (1 + np.exp(-z))


def test_rules_by_brute_force(spark, sf_dir, docs, labels):
    """Score and verdict of op7's table, row by row from the definition."""
    model, t = quality_rules.fit_on(docs, labels), texts(docs)
    rows = [r for r in queries.queries()["op7_quality_rules"](spark, sf_dir).collect() if len(t[r["doc_id"]]) < 3000]
    assert len(rows) > 100
    for r in rows:
        want = brute_rules(model, t[r["doc_id"]])
        assert r["score"] == pytest.approx(want, abs=1e-4)
        assert r["kept"] == (not r["base_failed"] and want >= quality_rules.KEEP) or abs(want - quality_rules.KEEP) < 1e-4


def test_whole_rows_fit(spark):
    """The sample's features are those of whole texts, of any number of passages; a row beyond the bytes is left out, not cut."""
    long, short = "some words of a long text go on. " * 9000, "a short text"
    docs = spark.createDataFrame([(k, long if k == 0 else f"{short} {k}", "en", "s", 0) for k in range(12)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    sample = common.labelled_sample(docs, labels, "quality", 100, F.lit(True))
    _, counts = quality_mil.passages(*common.array_bytes(pa.array([long], pa.large_string())))
    assert counts[0] > 500
    seen = []
    make = lambda t: [x.encode() for x in t.to_pylist()]
    for most in (1 << 20, 1000):
        rows = common.collected_features(sample, make, 100, most)
        seen.append({r["doc_id"]: len(r["features"]) for r in rows})
    assert seen[0][0] == len(long) and len(seen[0]) == 12
    assert seen[1] == {k: n for k, n in seen[0].items() if k}
    small = common.collected_features(sample, make, 100, 30)
    assert {r["label"]: sum(len(x["features"]) for x in small if x["label"] == r["label"]) <= 30 for r in small} == {0: True, 1: True}
    assert common.collected_features(sample.where("false"), make, 100, 30) == []
    every = quality_mil.fit_on(docs, labels)
    assert not np.allclose(every.mean, quality_mil.fit_on(docs, labels, most_bytes=100 * 4 * quality_mil.FEATURES).mean)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="a \né", max_size=1500), min_size=1, max_size=4))
def test_passages(texts_):
    """Passages end at white space and lose no byte; one text's do not depend on its company."""
    data, off = common.array_bytes(pa.array(texts_, pa.large_string()))
    at, counts = quality_mil.cuts(data, off)
    first = np.cumsum(counts) - counts
    for k, t in enumerate(texts_):
        b = t.encode()
        want, marks = [], [m for m in range(quality_mil.PASSAGE, len(b), quality_mil.PASSAGE)]
        for m in marks:
            to = next((i for i in range(m, len(b)) if b[i] in b" \n"), len(b))
            if to < len(b) and to not in want:
                want.append(to)
        mine = at[off[k] : off[k + 1]] - first[k]
        assert counts[k] == len(want) + 1 and [int(i) for i in np.flatnonzero(np.diff(mine)) + 1] == want and (len(b) == 0 or mine[0] == 0)


def test_scores_by_brute_force(spark, sf_dir, docs, labels):
    """The tables that op1 and op2 return, row by row from the definition."""
    quality, toxic = quality_mil.fit_on(docs, labels), toxicity.fit_on(docs, labels)
    t = texts(docs)
    for r in queries.queries()["op1_quality"](spark, sf_dir).collect():
        assert r["score"] == pytest.approx(brute_quality(quality, t[r["doc_id"]]), abs=1e-4)
    for r in queries.queries()["op2_toxicity"](spark, sf_dir).collect():
        assert r["score"] == pytest.approx(brute_toxic(toxic, t[r["doc_id"]]), abs=1e-9)


def test_vectors_alone():
    """A text's features do not depend on the texts beside it."""
    some = ["", "one two three", "é b", "a" * 1200 + " x", "#", "two two two"]
    data, off = common.array_bytes(pa.array(some, pa.large_string()))
    rules_, (bags, counts) = quality_rules.vectors(data, off), quality_mil.passages(data, off)
    first = np.cumsum(counts) - counts
    for k, t in enumerate(some):
        own = common.array_bytes(pa.array([t], pa.large_string()))
        assert np.allclose(rules_[k], quality_rules.vectors(*own)[0], atol=1e-6) and np.allclose(bags[first[k] : first[k] + counts[k]], quality_mil.passages(*own)[0], atol=1e-6)


def test_scores_odd(odd, none, labels):
    for module in (quality_mil, toxicity):
        model = module.fit_on(odd, labels)
        rows = module.score_documents(odd, model, keep=odd.columns).collect()
        empty = {r["score"] for r in rows if not r["row"]["text"]}
        assert len(rows) == 10 and len(empty) == 1 and all(0 <= r["score"] <= 1 for r in rows) and module.score_documents(none, model).count() == 0
        assert len({r["score"] for r in rows if r["row"]["text"] and r["row"]["text"].startswith("one two")}) == 1


# 3: mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, rest, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        level = rest / sum(w[s] for s in left)
        full = [s for s in left if level * w[s] >= 2 * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in left}
        for s in full:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
            left.discard(s)
    return out


def test_mixing(spark, docs):
    got = mixing.fair_mix(docs)
    rows = [r.asDict(recursive=True) for r in got.docs.collect()]
    again = {(r["row"]["doc_id"], r["taken"]) for r in mixing.fair_mix(docs.repartition(7)).docs.collect()}
    assert again == {(r["row"]["doc_id"], r["taken"]) for r in rows}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {k: len(t.encode().split()) for k, t in texts(docs).items()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        k = r["row"]["doc_id"]
        assert r["size"] == size[k] and r["taken"] in (0, size[k], 2 * size[k])
        sizes[source[k]] += size[k]
        taken[source[k]] += r["taken"]
    want = brute_targets(sizes)
    for r in rows:
        s = source[r["row"]["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    largest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= 2 * largest for s in sizes) and sum(taken.values()) <= got.budget
    # the cut, by brute force: events in order of finish time, equal times together
    events = sorted((f, r["size"]) for r in rows for f in r["finish"] if f is not None)
    total, cut = 0, 0.0
    for f in sorted({f for f, _ in events}):
        total += sum(n for g, n in events if g == f)
        if total > got.budget:
            break
        cut = f
    assert got.cut == cut
    assert mixing.in_order(got, ["doc_id"]).count() == sum(f is not None and f <= cut for r in rows for f in r["finish"])


def test_queue(spark, docs):
    """Finish times by a plain queue for each source, in the order of the seeded hashes."""
    rows = {r["row"]["doc_id"]: r for r in mixing.fair_mix(docs).docs.collect()}
    hashed = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text")).alias("h")).collect()
    until, source_of = {}, {r["doc_id"]: r["source"] for r in hashed}
    total = Counter()
    for r in sorted(hashed, key=lambda r: (r["h"] % 2**64 >> 1, r["doc_id"])):
        total[r["source"]] += len((r["text"] or "").encode().split())
        until[r["doc_id"]] = total[r["source"]]
    for k, r in rows.items():
        if r["size"]:
            assert r["finish"] == pytest.approx([(until[k] + p * total[source_of[k]]) / r["target"] for p in (0, 1)], rel=1e-12)


@pytest.mark.parametrize("part,parts", [(4, 3), (16, 4096), (1, 2)])
def test_cut_by_parts(spark, monkeypatch, part, parts):
    """Queues of several levels of parts, with ties, are truncated where a plain sum says."""
    monkeypatch.setattr(mixing, "PART_EVENTS", part)
    monkeypatch.setattr(mixing, "PARTS", parts)
    rng = np.random.default_rng(part)
    events = [(int(n), float(f)) for n, f in zip(rng.integers(1, 50, 300), rng.integers(0, 120, 300) / 7 + 1, strict=True)]
    df = spark.createDataFrame(events, "size long, f double")
    for budget in (0.0, 30.0, 2500.5, 7000.0, 1e9):
        total, want = 0, 0.0
        for f in sorted({f for _, f in events}):
            total += sum(n for n, g in events if g == f)
            if total > budget:
                break
            want = f
        assert mixing.budget_cut(df, budget, len(events)) == want
    assert mixing.budget_cut(df.where("false"), 5.0, 0) == 0.0


def test_mixing_odd(odd, none):
    rows = mixing.fair_mix(odd, keep=odd.columns).docs.collect()
    assert len(rows) == 10 and sum(r["taken"] for r in rows) > 0 and mixing.fair_mix(none).docs.count() == 0
    assert mixing.in_order(mixing.fair_mix(odd, keep=odd.columns), odd.columns).columns == odd.columns


# 4: near-duplicates


def brute_fingerprint(text, n=4):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + n]), seed=42).intdigest() for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.queries()["op4_simhash"](spark, sf_dir).collect()}
    t = texts(docs)
    ids = sorted(t)
    fps = [brute_fingerprint(t[k]) for k in ids]
    comp = brute_components(fps, 4)
    assert all(rows[k]["fingerprint"] == f"{f:016x}" and rows[k]["component_id"] == ids[c] for k, f, c in zip(ids, fps, comp, strict=True))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.integers(30, 200))
def test_bit_sliced_links(seed, radius, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fp = np.unique(base[rng.integers(0, 8, n)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, n)).astype(np.uint64)))
    want = brute_components([int(x) for x in fp], radius)
    a, b = simhash.group_links(np.zeros(len(fp), np.int64), fp, np.zeros(len(fp), np.int64), radius)
    root = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert [root.get(k, k) for k in range(len(fp))] == want


def test_chunks_and_blocks(spark, monkeypatch):
    """Small chunks and other block counts lose no link."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fp = np.unique(base[rng.integers(0, 5, 300)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 300)).astype(np.uint64)))
    want = brute_components([int(x) for x in fp], 4)
    df = spark.createDataFrame([(int(x), int(x)) for x in fp.view(np.int64)], "id long, fp long")
    monkeypatch.setattr(simhash, "CHUNK", 16)
    for dense in (1 << 22, 4):
        monkeypatch.setattr(simhash, "DENSE", dense)
        label = {r["node"]: r["label"] for r in simhash.components(simhash.links(df, len(fp), 4)).collect()}
        got = [label.get(int(x), int(x)) for x in fp.view(np.int64)]
        groups = {}
        for w, g in zip(want, got, strict=True):
            groups.setdefault(w, set()).add(g)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(got))


def test_first_of_each_recall(spark):
    """Near copies (similarity 0.8 or more) by brute force: nine of ten groups at least become one row, and no clean text goes."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, groups = [], {}
    for k in range(150):
        base = [word() for _ in range(int(rng.integers(60, 300)))]
        groups[k] = 0
        for c in range(1 + k % 3):
            w = list(base)
            for i in rng.choice(len(w), max(1, len(w) // 80) if c else 0, replace=False):
                w[i] = word()
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, w))
            if len(a & b) / len(a | b) >= 0.85:
                groups[k] += 1
                rows.append((len(rows), " ".join(w), "en", "s", k))
    df = spark.createDataFrame(rows, DOCS)
    left = [r["n_chars"] for r in simhash.first_of_each(df).collect()]
    assert set(left) == set(groups)
    extra = sum(n - 1 for n in groups.values())
    assert len(left) - len(groups) <= 0.1 * extra


@pytest.mark.parametrize("size", [40, 300, 3000])
def test_bands_recall(size):
    """Sets of similarity 0.8 share a band, however many there are; those of 0.1 do not."""
    rng = np.random.default_rng(size)
    same = lambda x, y: bool((simhash.bands(x) == simhash.bands(y)).any())
    for _ in range(200):
        h = rng.integers(0, 1 << 64, 12 * size // 10, np.uint64)
        k = size // 10  # 8 of 10 parts are common
        assert same(h[: 9 * k], np.r_[rng.permutation(h[: 8 * k]), h[:k], h[9 * k : 10 * k]])
        assert not same(h[: 4 * k], np.r_[h[:k], h[5 * k : 11 * k]])


def test_first_of_each_repeats(spark):
    """A text and itself with one line many times over have nearly the same shingles, however many bits of a count of all differ."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for k in range(20):
        lines = [" ".join(word() for _ in range(8)) for _ in range(40)]
        for text in (lines, lines[:20] + lines[20:21] * 200 + lines[21:]):
            rows.append((len(rows), "\n".join(text), "en", "s", k))
    left = simhash.first_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["n_chars"] for r in left) == list(range(20))


def brute_first(texts, least=0.8):
    """Places of the first text of each component of pairs with similarity ``least`` or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and both >= least * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return sorted(set(root))


def test_first_of_each_threshold(spark):
    """Pairs of similarity 0.75 to 0.85: those of 0.8 or more, and no others, become one row."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for k in range(150):
        w = [word() for _ in range(300)]
        cut = 22 + k % 20  # words replaced at the end: similarity 0.76 to 0.86
        texts += [" ".join(w), " ".join(w[:-cut] + [word() for _ in range(cut)])]
    left = simhash.first_of_each(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)).collect()
    want = brute_first(texts)
    assert 0 < len(texts) - len(want) < 150
    assert sorted(r["doc_id"] for r in left) == want


def test_first_of_each_split(spark, monkeypatch):
    """A family around one text, another of long texts, and single ones: the same rows when centres are salted and chunks are cut by bytes."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for size, copies in ((200, 90), (3000, 25), (80, 1), (120, 1)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w, at = list(base), int(rng.integers(0, size - size // 14))
            w[at : at + size // 15] = [word() for _ in range(size // 15)]
            texts.append(" ".join(w))
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    want = brute_first(texts)
    assert sorted(r["doc_id"] for r in simhash.first_of_each(df).collect()) == want
    monkeypatch.setattr(simhash, "STAR", 7)
    monkeypatch.setattr(simhash, "CHUNK_BYTES", 1 << 16)
    assert sorted(r["doc_id"] for r in simhash.first_of_each(df).collect()) == want


def test_alike_salted(spark, monkeypatch):
    """Pairs of one centre at either end, over several salts, and empty sets."""
    monkeypatch.setattr(simhash, "STAR", 5)
    sets = {k: sorted({(k * 7 + j * (1 + k % 3)) % 40 for j in range(k % 30)}) for k in range(60)}
    pairs = [(0, k) for k in range(1, 60)] + [(k, 59) for k in range(1, 59)] + [(29, 28), (30, 60)]
    sets[60] = []
    table = spark.createDataFrame([(k, v, len(v)) for k, v in sets.items()], "id long, shingles array<long>, size int")
    got = simhash.alike(spark.createDataFrame(pairs, "a long, b long"), table, 0.5)
    same = lambda x, y: len(x & y) >= 0.5 * len(x | y)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(p for p in pairs if same(set(sets[p[0]]), set(sets[p[1]])))


@pytest.mark.parametrize("chunk", [2048, 8])
def test_first_of_each_families(spark, monkeypatch, chunk):
    """Families of many edited copies: every pair of 0.8 or more links, whatever lies between."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(300)]
        for _ in range(40):
            w, at = list(base), int(rng.integers(0, 240))
            w[at : at + 20] = [word() for _ in range(20)]
            texts.append(" ".join(w))
    left = simhash.first_of_each(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)).collect()
    want = brute_first(texts)
    assert 6 < len(want) < len(texts)
    assert sorted(r["doc_id"] for r in left) == want


def test_simhash_odd(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10 and {r["component_id"] for r in rows if r["fp"] == 0} == {1}
    assert simhash.near_duplicates(none).count() == 0
    first = simhash.first_of_each(odd)
    assert first.columns == odd.columns and first.where("doc_id = 5").count() == 2 and first.where("doc_id = 1").count() == 1 and first.where("doc_id = 3").count() == 0


# 5: SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_path())


def test_normalising_model_is_refused(monkeypatch):
    import unicodedata

    import sentencepiece

    class Normalising(sentencepiece.SentencePieceProcessor):
        def encode(self, text, **kw):
            return super().encode(unicodedata.normalize("NFKC", text) if isinstance(text, str) else text, **kw)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Normalising)
    with pytest.raises(ValueError, match="normalises"):
        pieces.Pieces(pieces.model_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ▁\n\r\t\x00ab.é\u0301ﬁＡ\xa0\u3000日😀<s>0xA,;(){}", max_size=24))
def test_pieces(model, text):
    (got,) = model.texts([text])
    ids = model.model.encode(text)
    assert pieces.Pieces.ids(got) == ids and pieces.Pieces.decoded(got) == model.model.decode(ids)


def test_op5(spark, sf_dir, docs, model):
    rows = {r["doc_id"]: r for r in queries.queries()["op5_pieces"](spark, sf_dir).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in texts(docs).items():
        ids = model.model.encode(t)
        assert (rows[k]["n_tokens"], rows[k]["ids_sha256"], rows[k]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(model.model.decode(ids)))


def test_pieces_odd(odd, none):
    rows = pieces.encode_documents(odd, keep=("doc_id",)).collect()
    assert len(rows) == 10 and rows[0]["ids"] == [] and pieces.encode_documents(none).count() == 0


# 6: urls


def brute_urls(urls):
    """host, path, rule, template and share of each url, by plain loops over dictionaries."""
    rules = sorted(url_filter.RULES, key=lambda r: len(str(r)), reverse=True)

    def split(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def form(x):
        if re.fullmatch("[0-9]+", x):
            return "{n}"
        if m := re.fullmatch(r"[0-9]+\.([A-Za-z]{2,5})", x):
            return "{n}." + m[1].lower()
        return x

    at = [split(u) for u in urls]
    rule = [next((r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)), None) for h, p in at]
    per_host = Counter(h for h, _ in at)
    names = [()] * len(at)
    parts = [[form(x) for x in p.split("/") if x] for _, p in at]
    for level in range(max(map(len, parts))):
        seen = Counter((h, names[k], parts[k][level]) for k, (h, _) in enumerate(at) if len(parts[k]) > level)
        for k, (h, _) in enumerate(at):
            if len(parts[k]) > level:
                x, n = parts[k][level], seen[h, names[k], parts[k][level]]
                names[k] += (x if x == "{n}" or n >= url_filter.LEAST and n >= url_filter.SHARE * per_host[h] else "*",)
    count = lambda key: (Counter(key(k) for k in range(len(at)) if rule[k]), Counter(key(k) for k in range(len(at)) if rule[k] and rule[k].verdict == "block"))
    w = url_filter.PRIOR_WEIGHT
    every, domain, own = (count(f) for f in (lambda k: names[k], lambda k: (".".join(at[k][0].split(".")[-2:]), names[k]), lambda k: (at[k][0], names[k])))
    evidence = {}
    for k, (h, _) in enumerate(at):
        d = (".".join(h.split(".")[-2:]), names[k])
        wide = (every[1][names[k]] + w * url_filter.PRIOR) / (every[0][names[k]] + w)
        wide = (domain[1][d] + w * wide) / (domain[0][d] + w)
        evidence[h, names[k]] = (own[0][h, names[k]] + w, own[1][h, names[k]] + w * wide)
    branch = {key: (key,) for key in evidence}
    families = {}
    for h, t in sorted(evidence, key=lambda e: (e[0], "/" + "/".join(e[1]))):
        for k, x in enumerate(t):
            if x[0] not in "{*":
                families.setdefault((h, "/" + "/".join(t[:k] + ("*",) + t[k + 1 :])), []).append((h, t))
    for family in sorted(families):
        run = []
        for key in sorted((x for x in families[family] if len(branch[x]) == 1), key=lambda x: (evidence[x][1] / evidence[x][0], "/" + "/".join(x[1]))):
            if run:
                n1, b1 = (sum(evidence[x][i] for x in run) for i in (0, 1))
                n2, b2 = evidence[key]
                p = (b1 + b2 + 1) / (n1 + n2 + 2)
                if abs(b1 / n1 - b2 / n2) >= url_filter.DIFFERENT * math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)):
                    run = []
            run.append(key)
            for x in run:
                branch[x] = tuple(run)
    out = []
    for k, (h, p) in enumerate(at):
        n, b = (sum(evidence[x][i] for x in branch[h, names[k]]) for i in (0, 1))
        verdict = rule[k].verdict if rule[k] else "block" if b / n >= url_filter.REJECT else "allow"
        out.append((h, p, str(rule[k]) if rule[k] else None, "".join("/" + x for x in names[k]), round(b / n, 9), verdict))
    return out


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01", "sf0.1"])
def test_op6(spark, where):
    """All pages; the tree decides those that no rule does."""
    sf = f"/root/testdata/{where}"
    got = {r["page_id"]: r for r in queries.queries()["op6_urls"](spark, sf).collect()}
    pages = common.table(spark, sf, "pages").select("page_id", "url").collect()
    for p, want in zip(pages, brute_urls([p["url"] for p in pages]), strict=True):
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["template"], round(r["bad_share"], 9), r["verdict"]) == want
    if where == "sf0.1":
        unruled = Counter(r["verdict"] for r in got.values() if r["rule"] is None)
        n, agree = url_filter.held_out_agreement(common.table(spark, sf, "pages"))
        assert min(unruled["block"], unruled["allow"]) > 50 and n > 100 and agree > 0.9


def test_urls_odd(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://A.Net"), (6, "http://a.net/" + "x/" * 100_000), (7, "http://h.org/{n}/*"), (8, "http://h.org/1"), (8, "http://h.org/1"), (None, "http://h.org/1?x#y")]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in rows], "page_id long, url string, verdict string, template string")
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == 10 and all(r["verdict"] in ("allow", "block") for r in got)
    by = {r["page_id"]: r for r in got if r["page_id"] != 8}
    assert [(by[k]["host"], by[k]["path"]) for k in (1, 2, 3, 4)] == [("", "")] * 4 and (by[5]["host"], by[5]["path"], by[5]["rule"]) == ("a.net", "", None)
    assert by[6]["path"].count("/x") == 100_000 and by[7]["template"] == "/*/*" and len({r["verdict"] for r in got if r["page_id"] in (8, None)}) == 1
    assert url_filter.judge_urls(pages.where("false")).count() == 0 and url_filter.held_out_agreement(pages.where("false"))[0] == 0


def test_urls(spark):
    cases = [
        ("http://a.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net/de/2", "example.net", "/de/2", "net/", "block"), ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"), ("http://q.org/fr/1", "q.org", "/fr/1", "org/fr/", "allow"), ("http://a.net", "a.net", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://h?q=/x", "h", "", None, "allow"),
    ]
    df = spark.createDataFrame([(k, c[0], "clash") for k, c in enumerate(cases)], "page_id int, url string, template string")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    for k, c in enumerate(cases):
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"], rows[k]["verdict"]) == c[1:]
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_templates(spark):
    urls = [(k, f"http://h.com/spam/{k}/x", True) for k in range(40)] + [(100 + k, f"http://h.com/junk/{k}/x", True) for k in range(40)] + [(200 + k, f"http://h.com/news/{k}.html", False) for k in range(40)] + [(300, "http://h.com/spam/999/x", None), (301, "http://h.com/news/999.html", None)] + [(400 + k, f"http://h.com/u{k}/p", None) for k in range(300)]
    df = spark.createDataFrame(urls, "page_id int, url string, bad boolean")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(df, rules=(), label=F.col("bad")).collect()}
    assert rows[300]["template"] == "/spam/{n}/x" and rows[300]["verdict"] == "block" and rows[301]["template"] == "/news/{n}.html" and rows[301]["verdict"] == "allow"
    assert rows[300]["merged"] == "/junk/{n}/x|/spam/{n}/x" and rows[400]["template"] == "/*/p" and rows[400]["verdict"] == "allow"


# 8: token files


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=400), st.integers(1, 30))
def test_codec(ids, repeat):
    a = np.array(ids * repeat, np.int64).astype(np.uint16)
    assert (token_codec.decode(token_codec.encode(a)) == a).all()


def test_codec_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    a = (rng.zipf(1.4, 70_000) % 50_000).astype(np.uint16)
    monkeypatch.setattr(token_codec, "BLOCK", 1000)
    monkeypatch.setattr(token_codec, "LANES", 16)
    data = token_codec.encode(a)
    assert (token_codec.decode(data) == a).all() and len(data) < 2 * len(a)
    for at in (2, 40, len(data) // 2):
        broken = bytearray(data)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            token_codec.decode(bytes(broken))


def test_op8(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_file.tokenizer_path())
    rows = queries.queries()["op8_tokens"](spark, sf_dir).orderBy("doc_id").collect()
    at = 0
    for r, (k, t) in zip(rows, sorted(texts(docs).items()), strict=True):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_tokens_odd(spark, odd, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_file.tokenizer_path())
    rows = token_file.read_tokens(spark, token_file.write_tokens(odd, common.new_path(spark, "t"), 3), with_ids=True).collect()
    want = Counter(tuple([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in odd.collect())
    assert Counter(tuple(r["ids"]) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered if r["doc_id"] is not None] == sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert token_file.read_tokens(spark, token_file.write_tokens(none, common.new_path(spark, "t"), 3)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB'sé\u0301Σ 12\n\t\x1c\x85\u2028<|endoftext|>.", max_size=30))
def test_words(text):
    from tokenizers import Tokenizer

    w = token_file.worker_words(token_file.tokenizer_path())
    assert np.frombuffer(w.texts([text.encode()])[0], "<u2").tolist() == Tokenizer.from_file(token_file.tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_words_end_marks():
    """Marks of any kind at the end of a simple word are learnt apart, and the word once; ids are the tokenizer's."""
    from tokenizers import Tokenizer

    words, plain = token_file.Words(token_file.tokenizer_path()), Tokenizer.from_file(token_file.tokenizer_path())
    text = "lichzube&&& Lichzube*** lichzube### | xqzñ%%%. xqzñ$ wo|rd #tag& élan<| it's* a0#b% ÷# × &|\n" + " ".join(f"zqk{m}" for m in "#$%&*|.,;:!?")
    assert np.frombuffer(words.texts([text.encode()])[0], "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert words.splits and {b"lichzube", b"&&&", "xqzñ".encode(), b"%%%.", b"zqk"} <= words.table.keys()


def test_codec_cells_side_by_side():
    """Blocks that have met the same ids look up neighbouring cells."""
    model = token_codec._Model(8, token_codec.Shares.of(np.arange(4, dtype=np.uint16)))
    model.last[:], model.before[:] = 2, 3
    model.predict(8)
    assert (np.diff(model.at, axis=1) == 1).all() and (np.diff(model.case) == 1).all()


# 9: media


def test_jpeg_round_trip():
    rng = np.random.default_rng(5)
    counts = np.array([1, 3, 16, 17, 6, 100, 14_000])
    m = rng.integers(-1023, 1024, (counts.sum(), 64)) * (rng.random((counts.sum(), 64)) < 0.3)
    m[2:12] = 0
    m[16:40, 20:] = 0
    reader = jpeg.Reader(jpeg.encode(m, counts))
    at = 0
    for k, n in enumerate(counts):
        got = reader.stored(k)
        assert (got[:n] == m[at : at + n]).all() and not got[n:].any()
        assert [(c.h, c.v) for c in reader.images[k].components.values()] == [(2, 2), (1, 1), (1, 1)]
        at += n


def test_jpeg_against_another_decoder(spark):
    """The JVM's image library decodes the encoder's files to the same colours, but for rounding. It smooths chroma, so each image has one."""
    jvm = spark._jvm
    rng = np.random.default_rng(8)
    m = np.zeros((36, 64), np.int64)  # 6 MCUs in a row
    m[:24, 0] = rng.integers(-300, 300, 24)
    m[:24, 1:20] = rng.integers(-40, 40, (24, 19))
    m[24:30, 0], m[30:, 0] = 150, -90
    (data,) = jpeg.encode(m, np.array([36]))
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    rgb = jpeg.Reader([data]).rgb(0)
    assert (image.getHeight(), image.getWidth(), 3) == rgb.shape == (16, 96, 3)
    other = np.array([[[image.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(96)] for y in range(16)])
    assert np.abs(other - rgb.astype(int)).max() <= 3


def test_jpeg_of_another_encoder(spark):
    """A progressive grey image by the JVM's library (whose AC refinements have runs of ended blocks, and no restart intervals) gives that library's pixels, but for rounding."""
    jvm, rng = spark._jvm, np.random.default_rng(4)
    h, w = 40, 56
    grey = np.zeros((h, w), int) + 90
    grey[:24, :24] = rng.integers(0, 256, (24, 24))
    grey[24:, 30:] = np.add.outer(np.arange(16) * 3, np.arange(26) * 4)
    image = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    for y in range(h):
        for x in range(w):
            image.getRaster().setSample(x, y, 0, int(grey[y, x]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    writer.getOutput().flush()
    data = bytes(out.toByteArray())
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data)).getRaster()
    want = np.array([[raster.getSample(x, y, 0) for x in range(w)] for y in range(h)])
    got = jpeg.Reader([data, data])
    assert data.count(b"\xff\xda") > 3 and any(s[7] and s[5] for scans in got.steps for s in scans)
    assert all(np.abs(got.rgb(k)[..., 0].astype(int) - want).max() <= 2 for k in (0, 1))


def test_jpeg_refinement_by_symbols(monkeypatch):
    """A refining scan takes a step for each symbol of a lane, not for each coefficient; images of one size share the order of their blocks."""
    m = np.zeros((2 * 96, 64), np.int64)  # 16 MCUs: Cr is one lane of 16 blocks
    m[:, 60] = 3
    steps, peek, refine = [], jpeg.Reader._peek, jpeg.Reader._ac_refine

    def refined(self):
        monkeypatch.setattr(jpeg.Reader, "_peek", lambda self, pos: steps.append(1) or peek(self, pos))
        refine(self)
        monkeypatch.setattr(jpeg.Reader, "_peek", peek)

    monkeypatch.setattr(jpeg.Reader, "_ac_refine", refined)
    reader = jpeg.Reader(jpeg.encode(m, np.array([96, 96])))
    assert (reader.coefficients == m).all() and 0 < len(steps) <= 2 * 16 + 1 and len(reader.orders) == 4


def test_jpeg_upsampling():
    """Flat blocks: each chroma block covers 16 x 16 pixels, each luma block 8 x 8; colours by the definition of the format."""
    rng = np.random.default_rng(3)
    m = np.zeros((2 * 6, 64), np.int64)
    m[:, 0] = rng.integers(-400, 400, 12)
    (data,) = jpeg.encode(m, np.array([12]))
    rgb = jpeg.Reader([data]).rgb(0)
    assert rgb.shape == (16, 32, 3)
    y, cb, cr = (m[:8, 0].reshape(2, 4) / 8 + 128).repeat(8, 0).repeat(8, 1), (m[8:10, 0] / 8).repeat(16), (m[10:, 0] / 8).repeat(16)
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    assert np.abs(np.clip(want, 0, 255) - rgb).max() <= 2.5


def test_inverse_transform():
    """Against the definition."""
    rng = np.random.default_rng(2)
    c = rng.integers(-200, 200, 64)
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = c
    natural = natural.reshape(8, 8)
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    want = np.clip(np.floor(basis @ natural @ basis.T + 128.5), 0, 255)
    assert np.abs(jpeg.samples(c[None])[0].reshape(8, 8).astype(int) - want).max() <= 1


def test_op9(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.queries()["op9_media"](spark, sf_dir).collect()}
    for k, t in texts(docs).items():
        b = t.encode()
        payload = b.ljust(max(1, -(-len(b) // 192)) * 192)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    same = {}
    for k, t in texts(docs).items():
        assert same.setdefault(t, (rows[k]["media_sha256"], rows[k]["feature"])) == (rows[k]["media_sha256"], rows[k]["feature"])


def test_media_odd(spark, odd, none):
    made = media.decode_media(media.encode_texts(odd, keep=("*",)))
    path = common.new_path(spark, "tensors")
    tensors = media.stored_tensors(media.encode_texts(odd, keep=("*",)), path)
    rows = spark.read.parquet(path).collect()
    by_text = lambda r: (r["payload_sha256"], str(r["kept"]))
    assert sorted(rows, key=by_text) == sorted(made.collect(), key=by_text) and tensors.schema == made.schema
    assert len(rows) == 10 and all(len(r["rgb"]) == 3 * r["width"] * r["height"] for r in rows) and media.decode_media(media.encode_texts(none)).count() == 0
    assert {r["payload_sha256"] for r in rows if not r["kept"]["row"]["text"]} == {hashlib.sha256(b" " * 192).hexdigest()}
    assert sorted(r["feature"] for r in media.described(tensors).collect()) == sorted(media.feature(np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)) for r in rows)
    with pytest.raises(ValueError):
        jpeg.Reader([b"\xff\xd8\xff\xe0"])


def test_media_in_waves(spark, sf_dir, docs, monkeypatch):
    """Never are more tensors stored than a wave's, none are left; the images stay, and the rows are those of all tensors at once."""
    monkeypatch.setattr(media, "WAVE_BYTES", 1, raising=False)
    shared = Path(common.shared_dir(spark).removeprefix("file://"), "ripple")
    tensors, seen, describe = lambda: {*shared.glob("tensors-*")}, [], media.described
    before, images = tensors(), {*shared.glob("media-*")}

    def described(table, *args, **kw):
        seen.append([spark.read.parquet(str(p)).count() for p in tensors() - before])
        return describe(table, *args, **kw)

    monkeypatch.setattr(media, "described", described)
    rows = queries.queries()["op9_media"](spark, sf_dir).collect()
    assert tensors() == before and len({*shared.glob("media-*")} - images) == 1 and sorted(r["doc_id"] for r in rows) == sorted(texts(docs))
    path, seen[:] = common.new_path(spark, "media"), []
    stored = media.stored_images(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5), path)
    got = media.described_in_waves(stored, path, ("kept.row.doc_id", "media_sha256"))
    assert len(seen) == 5 and all(len(s) == 1 and s[0] for s in seen) and sum(s[0] for s in seen) == len(rows) and tensors() == before
    assert {(r["kept"]["doc_id"], r["kept"]["media_sha256"], r["feature"]) for r in got.collect()} == {(r["doc_id"], r["media_sha256"], r["feature"]) for r in rows}


def test_media_in_waves_empty(spark, none):
    path = common.new_path(spark, "media")
    assert media.described_in_waves(media.stored_images(none, path), path, ("kept.row.doc_id", "media_sha256")).collect() == []


# 10: WARC

PAGES = "page_id long, url string, html string, type string"


def test_op10(spark, sf_dir, duck):
    got = queries.queries()["op10_warc"](spark, sf_dir)
    sql = duck.execute(queries.oracle_sql()["op10_warc"])
    names = [d[0] for d in sql.description]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(sql.fetchall())


def test_warc_transactions(spark):
    rows = [(1, "http://a/1", "same", "x"), (2, "http://a/2", "same", "x"), (2, "http://a/2", "same", "x"), (3, None, None, None), (4, "http://a/\r\nX: y", "", "x"), (None, "u", "same", "x"), (7, "http://b", "é" * 100_000, "x")]
    pages = spark.createDataFrame(rows, PAGES)
    manifest = warc.write_archives(warc.with_roles(pages), common.new_path(spark, "w"))
    records = warc.read_archives(spark, manifest)
    kinds = Counter(r["type"] for r in records.select("type").collect())
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == 7 and kinds["response"] == 3
    assert sorted(a["start"] for a in records.collect() if a["type"] == "warcinfo") == [0] * manifest.count()
    nested = warc.with_payloads(warc.transactions(records), 3)
    got = nested.collect()
    assert len(got) == 7 and all(r["request"] and r["metadata"] for r in got)
    bodies = sorted(bytes(r["response"]["payload"]).decode() for r in got if r["capture"]["type"] == "response")
    assert bodies == sorted(["same", "", "é" * 100_000]) and all(r["response"]["found_digest"] == r["capture"]["payload_digest"] for r in got if r["capture"]["type"] == "response")
    assert all(r["response"] is None for r in got if r["capture"]["type"] == "revisit") and warc.with_payloads(warc.transactions(records.where("false")), 0).count() == 0
    damaged = warc.with_payloads(warc.transactions(records.where("type != 'response'").unionByName(records.where("type = 'response'").withColumn("payload_digest", F.lit("X")))), 2)
    assert {r["response"]["found_digest"] for r in damaged.collect() if r["response"]} == {r["capture"]["payload_digest"] for r in got if r["capture"]["type"] == "response"}
    assert warc.read_archives(spark, warc.write_archives(warc.with_roles(pages.where("false")), common.new_path(spark, "w"))).count() == 0
    small = warc.with_roles(pages, least_bytes=5).where("is_response").count()
    assert small == 7


def test_warc_request():
    assert warc.request("http://A.b/p/q?x=1#f") == b"GET /p/q?x=1 HTTP/1.1\r\nHost: A.b\r\n\r\n"
    assert warc.request("http://a?x") == b"GET /?x HTTP/1.1\r\nHost: a\r\n\r\n"
    assert warc.request(None) == warc.request("no scheme") == b"GET / HTTP/1.1\r\n\r\n"
    assert warc.request("http://a/\r\nX: \u00e9") == b"GET /%0D%0AX:%20%C3%A9 HTTP/1.1\r\nHost: a\r\n\r\n"


# the pipeline


def brute_toxic(model, text):
    clean = 1.0
    for words in {frozenset(x) for x in toxicity.sentences(text)}:
        z = model.bias + sum(float(model.weights[k]) for w in words for k in toxicity.features(w))
        clean *= min(1.0, (1 + math.exp(toxicity.FLOOR)) / (1 + math.exp(min(z, 700))))
    return 1 - clean


def brute_quality(m, text):
    """Gated attention over the passages of one text, in loops."""
    x, _ = quality_mil.passages(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    hidden, logits = [], []
    for row in x.astype(np.float64):
        h = np.maximum(0, (row - m.mean) / m.scale @ m.e[:-1] + m.e[-1])
        hidden.append(h)
        logits.append(float((np.tanh(h @ m.v) / (1 + np.exp(-(h @ m.u)))) @ m.w))
    a = np.exp(np.array(logits) - max(logits))
    z = sum(w * h for w, h in zip(a / a.sum(), hidden, strict=True))
    return 1 / (1 + math.exp(-float(z @ m.c[:-1] + m.c[-1])))


def brute_unlike(rows):
    """Of documents whose sets of five-word shingles are 0.8 alike, over any number of steps, the first by id."""
    sets = []
    for r in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (both >= 0.8 * all_) if all_ else True:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [r for k, r in enumerate(rows) if root[k] == k]


def brute_mix(spark, rows, names):
    """Every source a queue in the order of the seeded hashes; all events by finish time, up to the budget."""
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    key = {r["doc_id"]: r["h"] % 2**64 >> 1 for r in df.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in rows}
    total, until = Counter(), {}
    for r in rows:
        total[r["source"]] += size[r["doc_id"]]
    target, seen, events = brute_targets(total), Counter(), []
    for r in sorted(rows, key=lambda r: (key[r["doc_id"]], r["doc_id"])):
        seen[r["source"]] += size[r["doc_id"]]
        until[r["doc_id"]] = seen[r["source"]]
        if size[r["doc_id"]] and target[r["source"]]:
            events += [((until[r["doc_id"]] + p * total[r["source"]]) / target[r["source"]], r["doc_id"]) for p in (0, 1)]
    spent, out, budget = 0, [], 1.5 * sum(total.values())
    for _, k in sorted(events):
        spent += size[k]
        if spent > budget:
            break
        out.append(k)
    return out


def test_pipeline_by_brute_force(spark, sf_dir, docs, labels):
    """Every stage again by plain loops over rows, with the models that the stages fit."""
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline as cp

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    fitted = toxicity.fit_on(docs, labels)
    rows = [r for r in rows if brute_toxic(fitted, r["text"] or "") < 0.7]
    kept = docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    scorer = quality_mil.fit_on(kept, labels)
    rows = [r for r in rows if brute_quality(scorer, r["text"] or "") >= 0.3]
    rows = brute_unlike(rows)
    by_id = {r["doc_id"]: r for r in rows}
    want = Counter()
    for k in brute_mix(spark, rows, docs.columns):
        ids = model.encode(by_id[k]["text"] or "")
        want[k, by_id[k]["source"], tuple(ids), model.decode(ids)] += 1
    got = Counter((r["doc_id"], r["source"], tuple(r["ids"]), r["decoded"]) for r in cp.run(spark, sf_dir).collect())
    assert got == want and 0 < len(rows) < docs.count()


def test_scratch(spark, docs, tmp_path):
    """What a stage wrote is gone once its result is written; nested uses keep apart."""
    import os

    where = common.shared_dir(spark).removeprefix("file://") + "/ripple"
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    with common.scratch(spark):
        simhash.near_duplicates(docs).write.parquet(str(tmp_path / "out"))
        with common.scratch(spark):
            common.written(docs.limit(1), "inner")
    assert set(os.listdir(where)) == before and spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as cp

    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "quality", "near-duplicates", "mixing", "sentencepiece"]
    now = docs
    for name, stage in cp.STAGES:
        out = common.written(stage(spark, now, sf_dir), "t")
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name in ("toxicity", "quality"):
            assert out.join(now, out.columns, "left_anti").count() == 0 and 0 < out.count() < now.count()
        if name == "near-duplicates":
            assert out.select("text").distinct().count() == out.count()
        now = out
    run = cp.run(spark, sf_dir)
    assert Counter(json.dumps(r.asDict(), sort_keys=True) for r in run.collect()) == Counter(json.dumps(r.asDict(), sort_keys=True) for r in now.collect())


def test_pieces_stage_odd(spark, odd, none, sf_dir):
    """The last stage: each row once, null and empty texts without ids, the others' texts given back."""
    import corpus_pipeline as cp

    stage = cp.STAGES[4][1]
    want = Counter((r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in odd.select("doc_id", "text").collect())
    rows = stage(spark, odd, sf_dir).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in rows) == want
    assert all(bool(r["ids"]) == bool(r["decoded"]) for r in rows) and stage(spark, none, sf_dir).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_odd(spark, odd, none, sf_dir, k):
    import corpus_pipeline as cp

    name, stage = cp.STAGES[k]
    out = common.written(stage(spark, odd, sf_dir), "odd")
    assert out.columns == odd.columns and stage(spark, none, sf_dir).count() == 0
    count = lambda df: Counter((r["doc_id"], r["text"], r["row"]) for r in df.select("doc_id", "text", "row").collect())
    before, after = count(odd), count(out)
    most = 2 if name == "mixing" else 1
    assert after and all(n <= most * before[r] for r, n in after.items())
    if name == "toxicity":
        assert after == before  # none of them is toxic
    if name == "near-duplicates":  # empty and blank texts are one text, repeated rows another
        assert len(after) == len({(t or "").split() and t or "" for _, t, _ in before}) and max(after.values()) == 1
    if name == "mixing":
        assert all(t and t.split() for _, t, _ in after)  # only words are mixed
