"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Positives are trusted rows (``labels.quality`` = 1), the unlabelled rows are a sample of the
web text itself; rows of label 0 are not told from others. With class prior p the risk is
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)) (Kiryo et al., 2017). The prior is estimated from the same two samples
by the best bin (Garg et al., 2021): the least ratio, with a margin for the sample's size, of the shares of unlabelled and of positive rows that
a classifier of the one against the other, trained on the other halves, puts above a threshold.

The model is linear in shape statistics of the whole text. Defined cases: null text is empty text and gets a score;
repeated rows get equal scores; null labels are not learned from; of texts that share a doc_id the one of the least hash is learned from; without
a positive, or without unlabelled rows, every score is 1/2.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_text
from .langid import held_out

#: At most so many trusted and so many unlabelled documents, those of the least hash of doc_id, are learned from, each with one text.
SAMPLE = 5000

_CLASSES = np.full(256, 9, np.int64)  # of bytes; 9: other marks
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b"#*$%&|<>", b".,", b"!?", b"'\"-:;()")):
    _CLASSES[np.frombuffer(_chars, np.uint8)] = _k
_CLASSES[128:] = 8


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, and of repeated words and lines, of a whole text; on plain and log scales."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.zeros(10)
    for k in range(0, len(raw), 1 << 20):
        counts += np.bincount(_CLASSES[np.frombuffer(raw[k:k + (1 << 20)], np.uint8)], minlength=10)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, chars = len(words), max(1.0, counts.sum() - counts[3])
    shares = np.array([
        *(counts / chars)[[0, 1, 2, 4, 5, 6, 7, 9]],
        len(set(words)) / (n + 1), sum(map(eq, words, words[1:])) / (n + 1),
        (len(lines) - len(set(lines))) / (len(lines) + 1), chars / (n + 1) / 20, len(lines) / (n + 1)])
    return np.concatenate([shares, np.log(shares + 0.003), [np.log1p(n) / 8, min(1.0, n / 50)]])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4,
        supervised: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimise the non-negative risk with the logistic loss; supervised: that of the one sample against the other, in equal parts.

    Returns mean, scale and weights (bias last).
    """
    everything = np.vstack([positive, unlabelled])
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-6
    p = np.hstack([np.clip((positive - mean) / scale, -6, 6), np.ones((len(positive), 1))])
    u = np.hstack([np.clip((unlabelled - mean) / scale, -6, 6), np.ones((len(unlabelled), 1))])
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    soft = lambda x: np.logaddexp(0, x)
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        negative = soft(gu).mean() - prior * soft(gp).mean()
        minus = (u * sigmoid(gu)[:, None]).mean(axis=0) - prior * (p * sigmoid(gp)[:, None]).mean(axis=0)
        plus = -prior * (p * (1 - sigmoid(gp))[:, None]).mean(axis=0)
        grad = plus + minus if negative >= 0 else -minus
        if supervised:
            grad = (u * sigmoid(gu)[:, None]).mean(axis=0) / 2 - (p * (1 - sigmoid(gp))[:, None]).mean(axis=0) / 2
        grad = grad + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return mean, scale, w


def predict(x: np.ndarray, model: tuple) -> np.ndarray:
    mean, scale, w = model
    z = np.clip((x - mean) / scale, -6, 6) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = 0.1) -> float:
    """The share of positives among unlabelled rows, by the best bin."""
    p, u = (predict(x[1::2], fit(positive[::2], unlabelled[::2], 0.5, supervised=True)) for x in (positive, unlabelled))
    if not len(p) or not len(u):
        return 0.5
    at = np.unique(p)
    above = [1 - np.searchsorted(np.sort(x), at, "left") / len(x) for x in (p, u)]
    slack = np.sqrt(np.log(4 / margin) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((above[1] + 1.01 * slack) / above[0]))
    return float(min(0.95, max(0.05, above[1][best] / above[0][best])))


def _vectors(docs: DataFrame, name: str = "x") -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(x, pa.list_(pa.float64()))], ["kind", name])

    return docs.select("kind", "text").mapInArrow(run, f"kind int, {name} array<double>")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple | float:
    """A model from training rows only, or 1/2 where nothing can be learned."""
    train = ~held_out(3, 1)
    known = labels.filter((F.col("quality").cast("int") == 1) & train & F.col("doc_id").isNotNull())
    trusted = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = docs.select("doc_id").filter(train & F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample)
    texts = [one_text(docs, picked).withColumn("kind", F.lit(kind)) for kind, picked in ((1, trusted), (0, ids))]
    rows = sorted((r["kind"], tuple(r["x"])) for r in _vectors(texts[0].unionByName(texts[1])).collect())  # at most 2 * sample short vectors
    positive = np.array([x for k, x in rows if k == 1])
    unlabelled = np.array([x for k, x in rows if k == 0])
    if not len(positive) or not len(unlabelled):
        return 0.5
    return fit(positive, unlabelled, estimated_prior(*(np.random.default_rng(0).permutation(x) for x in (positive, unlabelled))))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(clean, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), sample)

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("text")])
            s = (np.full(len(b), model) if isinstance(model, float) else predict(x, model)) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    got = clean.mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
