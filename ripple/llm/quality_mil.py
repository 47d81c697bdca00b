"""
Quality by attention-based multiple-instance learning.

A document is a bag of passages (whole words, about ``PASSAGE`` bytes). A passage is encoded by a layer over its hashed character
pairs, character classes and word repetitions. Gated attention, softmax(w . (tanh(V h) * sigmoid(U h))), learned
from document labels alone, weighs the passages; a logistic layer scores the weighted passage representation.

Fitting uses a bounded sample of labelled rows (a parameter) in numpy on the driver; scoring is one pass
over all whole texts in Arrow batches without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

#: Bytes of a passage, about: it ends with the word in which they are reached.
PASSAGE = 512
PAIRS = 128
FEATURES = PAIRS + textvec.CLASSES + 4
HIDDEN, ATTENTION = 32, 16
#: Labelled rows of each label that the model is fitted on, at most, and bytes of the features of all their passages (about 110 MB of text).
BOUND, MOST_BYTES = 2500, 128 << 20


def cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each byte, number of passages of each text): cut at the first white space at or after every PASSAGE bytes; a text has one at least."""
    n, sizes = len(off) - 1, np.diff(off)
    text = np.repeat(np.arange(n), sizes)
    space = np.append(np.flatnonzero(textvec.SPACE[data]), len(data))
    marks = np.arange(len(data)) - off[text]
    at = np.flatnonzero((marks % PASSAGE == 0) & (marks > 0))
    to = np.minimum(space[np.searchsorted(space, at)], off[text[at] + 1]) if len(at) else at
    begins = np.zeros(len(data) + 1, bool)
    begins[to] = True
    begins[off] = True  # an empty text begins where the next one does
    counts = np.maximum(1, np.add.reduceat(np.append(begins[:-1], False), np.minimum(off[:-1], len(data))) * (sizes > 0)) if n else np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    within = np.cumsum(begins[:-1])
    return (first[text] + within - within[off[text]]) if len(data) else text, counts


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each text); a text without bytes has one passage of zeros."""
    at, counts = cuts(data, off)
    total = int(counts.sum())
    low = textvec.LOWER[data]
    size = np.maximum(1, np.bincount(at, minlength=total)).astype(np.float32)[:, None]
    x = np.zeros((total, FEATURES), np.float32)
    if len(data):
        x[:, :PAIRS] = np.sqrt(textvec.histogram(at, textvec.chars_hashed(low, off, 2, PAIRS), total, PAIRS) / size)
        x[:, PAIRS : PAIRS + textvec.CLASSES] = np.sqrt(textvec.histogram(at, textvec.CLASS[data], total, textvec.CLASSES) / size)
        begin, stop, h, owner = textvec.word_hashes(low, off)
        if len(begin):
            where = at[begin]
            words = np.maximum(1, np.bincount(where, minlength=total)).astype(np.float32)
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
            after = np.zeros(len(h), bool)
            after[2:] = (h[2:] == h[:-2]) & (owner[2:] == owner[:-2])
            x[:, -4] = np.bincount(where, again, total) / words
            x[:, -3] = np.bincount(where, after, total) / words
            x[:, -2] = np.log1p(np.bincount(where, stop - begin, total) / words) / 4
        x[:, -1] = np.log(size[:, 0]) / 6
    return x, counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray  # features + 1, hidden
    v: np.ndarray  # hidden, attention
    u: np.ndarray
    w: np.ndarray  # attention
    c: np.ndarray  # hidden + 1

    def attend(self, x: np.ndarray, counts: np.ndarray):
        h = np.maximum(0, ((x - self.mean) / self.scale) @ self.e[:-1] + self.e[-1])
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        a = (t * g) @ self.w
        starts = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(counts)), counts)
        a = np.exp(a - np.maximum.reduceat(a, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, z, starts, owner

    def score(self, x: np.ndarray, counts: np.ndarray):
        """(score of each text, attention of each passage)"""
        if not len(counts):
            return np.zeros(0), np.zeros(0)
        _, _, _, a, z, _, _ = self.attend(x, counts)
        return 1 / (1 + np.exp(-np.clip(z @ self.c[:-1] + self.c[-1], -30, 30))), a


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, seed: int = 5) -> Model:
    """Adam on the log loss of the documents. Without examples of both labels the score is the label's share (0.5 for none)."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0) if len(x) else np.zeros(FEATURES, np.float32)
    scale = x.std(0) + 1e-2 if len(x) else np.ones(FEATURES, np.float32)
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = Model(mean, scale, normal(FEATURES + 1, HIDDEN), normal(HIDDEN, ATTENTION), normal(HIDDEN, ATTENTION), normal(ATTENTION), np.zeros(HIDDEN + 1, np.float32))
    m.e[-1] = 0
    if len(y) == 0 or y.min() == y.max():
        m.c[-1] = 0.0 if len(y) == 0 else 8.0 * (2 * y[0] - 1)
        return m
    names = ("e", "v", "u", "w", "c")
    first = {k: np.zeros_like(getattr(m, k)) for k in names}
    second = {k: np.zeros_like(getattr(m, k)) for k in names}
    starts_all = np.cumsum(counts) - counts
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            some = order[lo : lo + batch]
            rows = np.concatenate([np.arange(starts_all[i], starts_all[i] + counts[i]) for i in some])
            xs, cs = (x[rows] - mean) / scale, counts[some]
            h, t, g, a, z, starts, owner = m.attend(x[rows], cs)
            p = 1 / (1 + np.exp(-np.clip(z @ m.c[:-1] + m.c[-1], -30, 30)))
            d = (p - y[some]) * weight[some] / len(some)
            grad = {"c": np.r_[z.T @ d, d.sum()]}
            dz = d[:, None] * m.c[:-1]
            da = (dz[owner] * h).sum(1)
            da = a * (da - np.add.reduceat(a * da, starts)[owner])  # through the softmax
            grad["w"] = (t * g).T @ da
            dt, dg = da[:, None] * m.w * g * (1 - t * t), da[:, None] * m.w * t * g * (1 - g)
            grad["v"], grad["u"] = h.T @ dt, h.T @ dg
            dh = (a[:, None] * dz[owner] + dt @ m.v.T + dg @ m.u.T) * (h > 0)
            grad["e"] = np.vstack([xs.T @ dh, dh.sum(0)]) + 1e-4 * m.e
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-5
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                getattr(m, k)[...] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def fit_on(docs: DataFrame, labels: DataFrame, bound: int = BOUND, most_bytes: int = MOST_BYTES) -> Model:
    """
    Fits on all passages of labelled rows whose crc32(doc_id as text) mod 5 is not 0: ``bound`` rows of each label at most, and as many as have
    ``most_bytes`` of features together. A row is in the sample with its whole text, or not at all.
    """

    def make(texts) -> list[bytes]:
        x, counts = passages(*common.array_bytes(texts))
        return [part.tobytes() for part in np.split(x, np.cumsum(counts)[:-1])][: len(counts)]

    rows = common.collected_features(common.labelled_sample(docs, labels, "quality", bound, common.fold_of("doc_id", 5) != 0), make, bound, most_bytes)
    xs = [np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate([np.zeros((0, FEATURES), np.float32), *xs]), np.array([len(x) for x in xs], np.int64), np.array([r["label"] for r in rows], np.float32))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """
    Every row of ``docs`` (its columns ``keep`` as ``row``) with score, predicted (1 if score >= threshold), n_passages, and top_passage, the
    number of the passage with the most attention (the first of several). A null or empty text is one empty passage, and is scored as such. Rows
    are scored one by one: repeated rows have equal results, and an empty table gives no rows.
    """
    inner = docs.select(F.struct(*keep).alias("row"), common.text_of().alias("text"))
    schema = inner.select("row").schema.simpleString()[7:-1].replace("row:", "row ", 1)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, counts = passages(*common.array_bytes(batch.column("text")))
            score, attention = model.score(x, counts)
            starts = np.cumsum(counts) - counts
            top = np.array([int(attention[s : s + c].argmax()) for s, c in zip(starts, counts, strict=True)], np.int32)
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score.astype(np.float64)), pa.array(counts.astype(np.int32)), pa.array(top)], ["row", "score", "n_passages", "top_passage"])

        return run

    got = common.map_texts(inner, make, f"{schema}, score double, n_passages int, top_passage int")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit_on(docs, common.table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, keep=("doc_id",))
    return scored.select("row.doc_id", (common.fold_of("row.doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_passages", "top_passage")
