"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of the most frequent character 1- to 3-grams of a language's training
texts, by rank (Cavnar and Trenkle, 1994). A text's own most frequent n-grams are held against
each profile; an n-gram that is missing costs the profile's length.

Texts are lower-cased; each run of characters that are no letters is one mark between words.
Defined cases: null texts, and texts without letters, are ``und`` with score 0; ties between
languages go to the first by name; equally frequent n-grams rank by code; null labels are not learned from;
without any label all texts are ``und``; repeated rows give repeated results, and of contrary labels of a doc_id the first by name is learned from.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import one_text, released

#: At most so many labelled documents, those of the least hash of doc_id, are learned from, each with one text.
SAMPLE = 4000
PROFILE = 400
LONGEST = 1 << 17  # characters counted at a time


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a whole text, as codes of 21 bits a character in ascending order, and their counts."""
    codes, counts = [], []
    text = text.lower()  # as a whole: the case of a letter may hang on its neighbours
    tail = np.array([32])
    for k in range(0, len(text) + 1, LONGEST):  # the last two characters go on to the next part, which counts what ends in it
        c = np.frombuffer(text[k:k + LONGEST].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        c = np.concatenate([tail, np.where(_letters()[c], c, 32), [32] if k + LONGEST > len(text) else np.zeros(0, np.int64)])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        n = len(tail)
        one, two = c[n:], (c[:-1] << 21 | c[1:])[n - 1:]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[max(0, n - 2):]
        three = three[(three >> 21 & 0x1FFFFF) != 32]
        tail = c[-2:]
        if len(c) > n and len(found := np.concatenate([one[one != 32], two, three])):
            x, n = np.unique(found, return_counts=True)
            codes.append(x)
            counts.append(n)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    x, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return x, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def most_frequent(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    if len(codes) > 4 * k:
        at = np.flatnonzero(counts >= np.partition(counts, len(counts) - k)[len(counts) - k])
        codes, counts = codes[at], counts[at]
    return codes[np.lexsort((codes, -counts))[:k]]


def learn(docs: DataFrame, may_learn: Column, sample: int = SAMPLE, k: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language: its k most frequent n-grams over whole texts of the sample."""
    rows = docs.select("doc_id", "lang").filter(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ids = rows.groupBy("doc_id").agg(F.min("lang").alias("__lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    mine = one_text(docs.filter("text is not null"), ids).select("__lang", "text")

    def count(batches):
        for b in released(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes, n = gram_counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    grams = mine.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = grams.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).orderBy("lang", "r").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], k: int = PROFILE):
        self.k, self.langs = k, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how much nearer than the second it is: 1 - best / second."""
        codes, counts = gram_counts(text or "")
        if not len(codes) or not self.langs:
            return "und", 0.0
        top = most_frequent(codes, counts, self.k)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        theirs = self.rank[np.where(self.codes[at] == top, at, len(self.codes))]
        away = np.where(theirs < 0, self.k, np.minimum(np.abs(theirs - np.arange(len(top))[:, None]), self.k))
        d = away.sum(axis=0) / (self.k * len(top))
        best = int(np.argmin(d))
        second = np.partition(d, 1)[1] if len(d) > 1 else 1.0
        return self.langs[best], float(1 - d[best] / second) if second > 0 else 0.0


def predict(docs: DataFrame, profiles: dict[str, list[int]], k: int = PROFILE, keep: str = "doc_id") -> DataFrame:
    """``keep``, lang_pred and score of every row. One narrow pass; a row's other columns play no part."""
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches):
        model = Profiles(profiles, k)
        for whole in released(batches):
            got = [model.predict(t.as_py()) for t in whole.column("text")]
            yield pa.RecordBatch.from_arrays([whole.column(keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [keep, "lang_pred", "score"])

    return docs.select(keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{keep}` {kind}, lang_pred string, score double")


def held_out(mod: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; what is held out is not learned from."""
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = predict(clean, learn(clean, ~held_out(4, 2)))
    return got.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.02) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that stands out, with all their columns."""
    profiles = learn(docs.select("doc_id", "text", "lang"), F.lit(True))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches):
        model = Profiles(profiles)
        for b in released(batches):
            got = [model.predict(t.as_py()) for t in b.column("text")]
            kept = pa.array([lang != "und" and score >= min_score for lang, score in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("row").filter(kept)], ["row"])

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
