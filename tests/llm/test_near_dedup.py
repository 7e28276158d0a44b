"""The near-duplicate stage against brute force over exact shingle sets."""

import random

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import jaccard, simhash

BOOK = [f"w{k}" for k in range(3000)]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    """The least doc_id of the component of each doc_id, over all pairs of similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    lead = {i: i for i in sets}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                lead[b] = a
    return {i: find(i) for i in sets}


def changed(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = rng.choice(BOOK)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    """Bases, each with copies of a few to many changed words: similarities on both sides of 0.8, chains among them."""
    rng, out = random.Random(5), []
    for _ in range(30):
        base = " ".join(rng.choice(BOOK) for _ in range(rng.choice((60, 200, 700))))
        out += [base] + [changed(rng, base, max(1, len(base.split()) * c // 1000)) for c in (5, 10, 18, 22, 25, 30, 45)]
        out.append(changed(rng, out[-4], 2))
    rng.shuffle(out)
    return [*enumerate(out), (1000, None), (1001, " \t"), (1002, "one two"), (1003, "One  two"), (None, out[0]), (0, out[0])]


@pytest.mark.parametrize("block", [jaccard.BLOCK, 300])
def test_stage_is_brute_force(spark, texts, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = cp.near_dedup(spark, docs, "").select("doc_id").collect()
    want = groups(texts)
    assert 30 < len(set(want.values())) < len(want) - 60
    assert {r["doc_id"] for r in got} == {*want.values(), None}
    assert cp.near_dedup(spark, docs.limit(0), "").collect() == [] and cp.near_dedup(spark, docs.withColumn("node", F.lit(1)).withColumn("__gone", F.lit(1)), "").columns == ["doc_id", "text", "node", "__gone"]


def test_most_pairs_of_exactly_eight_tenths_are_met(spark):
    """Similarity 0.8 is where most pairs are lost: at least 0.97 of them are candidates (0.995 expected)."""
    rng, rows = np.random.default_rng(0), []
    for k in range(300):
        x = rng.integers(0, 2**64, 100, np.uint64)
        for half, own in enumerate((x[:90], x[10:])):
            rows.append((2 * k + half, *(int(v) for v in simhash.fingerprint_of(own, jaccard.WORDS).view(np.int64))))
    reps = spark.createDataFrame(rows, "node long, " + ", ".join(f"fp{w} long" for w in range(jaccard.WORDS)))
    got = {(r["b"], r["a"]) for r in simhash.search(reps, jaccard.TAU, jaccard.WORDS, jaccard.LIMIT, pairs=True).collect()}
    assert sum((2 * k, 2 * k + 1) in got for k in range(300)) >= 291
