"""
Quality rules: counts of each whole text, and a hashed n-gram logistic regression with calibrated probabilities.

The model sees relative frequencies (square roots) of hashed character triples, words and word pairs. It is fitted on a
bounded sample of labelled rows in numpy on the driver, its scores are turned into probabilities by a
logistic curve fitted on examples that the weights have not seen, and rows are judged in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

CHARS, WORDS = 1024, 1024
FEATURES = CHARS + WORDS
#: Labelled rows of each label that the model is fitted on, at most.
BOUND = 2500
#: Calibrated probability of good quality from which a row that passes the base rules is kept: rows that are more likely bad than good go.
KEEP = 0.5
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = text.encode()
    words = data.split()
    spaces = len(data) - sum(map(len, words))
    seen, dup = set(), 0
    lines = data.split(b"\n")
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += 1
            elif line.strip():
                seen.add(line)
    return len(words), len(text) - spaces, len(data) - len(data.translate(None, SYMBOLS)), dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that are found twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + WINDOW - max(i, until)
            until = i + WINDOW
    return total


def vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, FEATURES): square roots of relative frequencies, for characters and words apart."""
    n = len(off) - 1
    x = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return x
    low = textvec.LOWER[data]
    sizes = np.diff(off)
    text = np.repeat(np.arange(n), sizes)
    x[:, :CHARS] = textvec.histogram(text, textvec.chars_hashed(low, off, 3, CHARS), n, CHARS) / np.maximum(1, sizes)[:, None]
    _, _, h, owner = textvec.word_hashes(low, off)
    if len(h):
        pair = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
        same = owner[1:] == owner[:-1]
        ids = np.r_[h >> np.uint64(40), (pair ^ pair >> np.uint64(31))[same] >> np.uint64(40)].astype(np.int64) & (WORDS - 1)
        who = np.r_[owner, owner[1:][same]]
        x[:, CHARS:] = textvec.histogram(who, ids, n, WORDS) / np.maximum(1, np.bincount(who, minlength=n))[:, None]
    return np.sqrt(x)


@dataclass(frozen=True)
class Model:
    w: np.ndarray
    b: float
    slope: float
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * (x @ self.w + self.b) + self.shift)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on the log loss, examples counting by ``weight``."""
    weight = weight / weight.sum()
    x, w, b = x.astype(np.float32), np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, rounds + 1):
        d = ((_sigmoid(x @ w + b) - y) * weight).astype(np.float32)
        g = np.r_[d @ x + decay * w, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray, share: float | None = None) -> Model:
    """
    Weights from four fifths of the examples, both labels counting equally; the calibration (a logistic curve over the score) from the other fifth, which
    counts as the labels are met: ``share`` is that of label 1 among all labelled rows, if the examples are not in that proportion.
    With one label only, or none, nothing can be held back and the score is that label's.
    """
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(FEATURES), 0.0, 1.0, 8.0 if len(y) == 0 or y[0] else -8.0)
    held = np.arange(len(y)) % 5 == 4
    if y[~held].min() == y[~held].max() or y[held].size == 0 or y[held].min() == y[held].max():
        held[:] = False
    rest, test = ~held, held if held.any() else ~held
    as_met = lambda of, p: np.where(of == 1, p / of.mean(), (1 - p) / (1 - of.mean()))
    w, b = _logistic(x[rest], y[rest], as_met(y[rest], 0.5), 300, 0.3, 1e-5)
    z = (x[test] @ w + b)[:, None]
    slope, shift = _logistic(z / 10, y[test], as_met(y[test], min(max(share or y.mean(), 1e-6), 1 - 1e-6)), 600, 0.1, 1e-4)
    return Model(w, b, float(slope[0]) / 10, shift)


def fit_on(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) mod 5 is not 0, which leaves rows to test it on."""
    fold = common.fold_of("doc_id", 5) != 0
    rows = common.collected_features(common.labelled_sample(docs, labels, "quality", bound, fold), lambda texts: [x.tobytes() for x in vectors(*common.array_bytes(texts))], bound)
    x = np.stack([np.frombuffer(r["features"], np.float32) for r in rows]) if rows else np.zeros((0, FEATURES), np.float32)
    share = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & fold).groupBy("doc_id").agg(F.max("quality").alias("q")).agg(F.avg("q")).first()[0]
    return fit(x, np.array([r["label"] for r in rows], np.float64), share)


def reliability(scored: DataFrame, labels: DataFrame, bins: int = 10) -> DataFrame:
    """Of rows that fitting has not seen: for each tenth of the score how many there are, their mean score, and the share that is good."""
    truth = labels.where(common.fold_of("doc_id", 5) == 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seen = scored.join(truth, "doc_id").where("quality is not null and not base_failed")
    return seen.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("quality").alias("good")).orderBy("bin")


def judge_documents(docs: DataFrame, model: Model, keep_at: float = KEEP, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """
    Every row of ``docs`` (its columns ``keep`` as ``row``) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    score (the model's probability of good quality), base_failed and kept.

    base_failed: n_words < 10, or more than 20 % of the words repeated. Null and empty texts have no words, so they fail. Rows are judged one by
    one: repeated rows have equal results, a score of exactly ``keep_at`` is kept, an empty table gives no rows.
    """
    inner = docs.select(F.struct(*keep).alias("row"), common.text_of().alias("text"))
    schema = inner.select("row").schema.simpleString()[7:-1].replace("row:", "row ", 1)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [base_counts(t) for t in batch.column("text").to_pylist()]
            score = model.probability(vectors(*common.array_bytes(batch.column("text"))))
            cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("row"), *cols, pa.array(score.astype(np.float64))], ["row", *names, "score"])

        return run

    got = common.map_texts(inner, make, f"{schema}, {', '.join(f'{n} long' for n in names)}, score double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_at))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit_on(docs, common.table(spark, sf_dir, "labels"))
    return judge_documents(docs, model, keep=("doc_id",)).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
