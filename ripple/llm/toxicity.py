"""
Toxicity by multiple-instance learning.

A document is a bag of its distinct sentences. Each sentence has a probability (a logistic model over hashed words and word beginnings, less what the
model says of any sentence below FLOOR); the document's is their noisy-or, 1 - prod(1 - p). Only documents have labels: the gradient of the bag's loss
reaches every sentence through the noisy-or, so the model finds the offending sentences by itself. Sentences below the floor add nothing and
repeated ones count once, in fitting and scoring alike, so a text is not toxic for its length.

Fitting uses a bounded sample of labelled rows (``bound`` of each label, a parameter) in numpy on the driver;
scoring is one pass over all texts in Arrow batches, with no shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashed features, as a power of two.
BITS = 18
#: Words of a sentence; what is longer is cut into several.
SENTENCE_WORDS = 40
#: Labelled rows of each label that the model is fitted on, at most, and bytes of all their bags.
BOUND, MOST_BYTES = 2000, 128 << 20
#: Log-odds of a sentence without offending words, at most: thousands of them must not add up to a toxic document.
HARMLESS = -9.0
#: Log-odds up to which a sentence counts as harmless: its probability is 0.
FLOOR = -1.5
#: Distinct words whose weights a task remembers.
MEMO = 250_000

# ASCII letters, digits and bytes of longer characters make words; these end a sentence; all else is space.
_ENDS = b".!?\n"
_MAP = bytes(10 if c in _ENDS else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def sentences(text: str) -> list[list[bytes]]:
    """The words (lower case) of each sentence; no sentence is empty."""
    out = []
    for line in text.lower().encode().translate(_MAP).split(b"\n"):
        words = line.split()
        out += [words[i : i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS)]
    return out


def features(word: bytes) -> list[int]:
    """Buckets of the word and, as inflected forms share their stem, of its first 4 and 5 bytes (if it has more)."""
    keys = [b"w" + word, *(b"%d" % k + word[:k] for k in (4, 5) if len(word) > k)]
    return [zlib.crc32(k) & ((1 << BITS) - 1) for k in keys]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def bag(text: str) -> bytes:
    """The sentences of a text, a number each: its features' buckets, each once and in order, then -1. Sentences that a text repeats are one of its bag."""
    sents = dict.fromkeys(tuple(sorted({k for w in set(words) for k in features(w)})) for words in sentences(text))
    return np.array([k for ids in sents for k in (*ids, -1)], np.int32).tobytes()


def mass(z: np.ndarray) -> np.ndarray:
    """-log(1 - p) of sentences by log-odds: that of the logistic model less that at the floor, 0 below it."""
    return np.maximum(0, np.logaddexp(0, z) - np.logaddexp(0, FLOOR))


def fit(rows, rounds: int = 400, rate: float = 0.3, decay: float = 0.03) -> Model:
    """
    rows: (bag, label). Adam on the bags' log loss under the noisy-or, with an L1 step in the
    first half, which chooses features, and none in the second, which fits those kept; the floor holds in the second half, as below it nothing is learnt; weights
    are at least 0, so no number of harmless words makes up for an offending one, and the bias carries what is usual. Features in fewer than
    1 % of the toxic bags (and fewer than 3) have no weight: they could only learn single documents by heart.
    No rows, or one label only: a model that scores every sentence by that label's share.
    """
    labels = np.array([y for _, y in rows], np.float64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), 10.0 if share else -30.0)
    parts, per_sentence, per_bag = [], [], []
    for data, _ in rows:
        ids = np.frombuffer(data, np.int32)
        ends = np.flatnonzero(ids < 0)
        parts.append(ids[ids >= 0])
        per_sentence.append(np.diff(np.r_[-1, ends]) - 1)
        per_bag.append(len(ends))
    cols = np.concatenate(parts)
    bag_of = np.repeat(np.arange(len(rows)), per_bag)
    sent = np.repeat(np.arange(len(bag_of), dtype=np.int32), np.concatenate(per_sentence).astype(np.int64))
    pairs = np.unique(bag_of[sent] << BITS | cols)  # (bag, feature)
    seen = np.bincount(pairs & ((1 << BITS) - 1), labels[pairs >> BITS], 1 << BITS)
    least = max(3, 0.01 * labels.sum())
    kept = seen[cols] >= least
    used, inverse = np.unique(cols[kept], return_inverse=True)
    sent = sent[kept]
    del pairs, cols, parts
    n_sent, n_bag, n = len(bag_of), len(rows), len(used)
    w, b = np.zeros(n), HARMLESS
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.clip(np.bincount(sent, w[inverse], n_sent) + b, -40, 40)
        p = 1 / (1 + np.exp(-z))  # d mass / d z
        if late := step >= rounds // 2:
            p *= z > FLOOR
        log_clean = np.bincount(bag_of, -(mass(z) if late else np.logaddexp(0, z)), n_bag)  # log prod(1 - p)
        clean = np.exp(log_clean)
        # d loss / d z of a sentence: p for clean bags, -p * clean / (1 - clean) for toxic ones
        pull = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-12), 1.0)
        g = p * pull[bag_of] / n_bag
        gw, gb = np.bincount(inverse, g[sent], n) * ((w > 0) | (step < rounds // 2)), g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr, c1, c2 = rate / (1 + step / 100), 1 - 0.9**step, 1 - 0.99**step
        w -= lr * (m / c1) / (np.sqrt(v / c2) + 1e-7)
        b -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
        b = min(b, HARMLESS)
        w = np.maximum(0, w - decay * lr) if step < rounds // 2 else np.where(w > 0, np.maximum(w, 1e-6), 0)
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return Model(full, float(b))


class Weights(dict):
    """Weight of each word met, at most MEMO of them."""

    def __init__(self, weights: np.ndarray):
        self.of = weights.tolist()

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = sum(self.of[k] for k in features(word))
        return value


def scorer(model: Model):
    weight = Weights(model.weights).__getitem__
    bias = model.bias

    def score(text: str):
        """Score, and each sentence's: (probabilities, sentences)."""
        sents = sentences(text)
        if not sents:
            return 0.0, np.zeros(0), sents
        keys = [frozenset(s) for s in sents]
        known = {k: sum(map(weight, k)) for k in keys}
        each = dict(zip(known, mass(np.fromiter(known.values(), np.float64, len(known)) + bias)))
        return float(-np.expm1(-sum(each.values()))), -np.expm1(-np.array([each[k] for k in keys])), sents

    return score


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """
    Every row of ``docs`` (its columns ``keep`` as ``row``) with score, predicted (1 if score >= threshold), n_sentences, and worst, the sentence
    with the highest probability (its number from 0, probability and words; null without words), and
    n_offending, the number of sentences that alone reach the threshold.

    Null and empty texts, and those without words, score 0. Of equally bad sentences the first is the worst. Rows are scored one by one: repeated
    rows have equal results, and an empty table gives no rows.
    """
    inner = docs.select(F.struct(*keep).alias("row"), common.text_of().alias("text"))
    schema = inner.select("row").schema.simpleString()[7:-1].replace("row:", "row ", 1)

    def make():
        score = scorer(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {k: [] for k in ("score", "n_sentences", "n_offending", "worst", "worst_p", "worst_words")}
            for text in batch.column("text").to_pylist():
                total, p, sents = score(text)
                k = int(p.argmax()) if len(p) else None
                for name, value in zip(out, (total, len(sents), int((p >= threshold).sum()), k, None if k is None else float(p[k]), None if k is None else b" ".join(sents[k]).decode(errors="replace")), strict=True):
                    out[name].append(value)
            types = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["row", *out])

        return run

    got = common.map_texts(inner, make, f"{schema}, score double, n_sentences int, n_offending int, worst int, worst_p double, worst_words string")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_on(docs: DataFrame, labels: DataFrame, bound: int = BOUND, most_bytes: int = MOST_BYTES) -> Model:
    """
    Fits on whole labelled texts whose crc32(doc_id as text) mod 3 is not 1: ``bound`` of each label at most, and as many as have ``most_bytes``
    of bags together. A text that does not fit is left out of the sample, never shortened.
    """
    sample = common.labelled_sample(docs, labels, "toxic", bound, common.fold_of("doc_id", 3) != 1)
    rows = common.collected_features(sample, lambda texts: [bag(t) for t in texts.to_pylist()], bound, most_bytes)
    return fit([(r["features"], r["label"]) for r in rows])


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit_on(docs, common.table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, keep=("doc_id",))
    return scored.select("row.doc_id", (common.fold_of("row.doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_sentences", "n_offending", "worst", "worst_words")
