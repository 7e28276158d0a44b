"""The pipeline on the smallest tables, each stage held against a plain reading of its own input."""

import os

import pytest

import corpus_pipeline as cp

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    run_through(spark, docs, columns, tmp_path)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and white texts, repeated rows and an empty table pass through all stages."""
    some = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, " \n ", None, "s", 3)], some.schema)
    for k, docs in enumerate((some.union(some.limit(5)).union(odd), some.limit(0))):
        for name, stage in cp.STAGES:
            stage(spark, docs, DATA).write.parquet(f"{tmp_path}/odd-{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/odd-{k}-{name}")
        assert docs.columns[:2] == ["doc_id", "piece"] and (docs.count() > 0) == (k == 0)


def run_through(spark, docs, columns, tmp_path):
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs
        stage(spark, before, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "best_fit_packing":
            assert docs.columns == columns and 0 < docs.count() <= before.count()
            assert docs.join(before, columns, "left_anti").count() == 0
        texts = {r["doc_id"]: r["text"] for r in before.collect()}
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                key = "".join(t.split())
                best[key] = min(best.get(key, (-len(t), i)), (-len(t), i))
            assert left == {i for _, i in best.values()}
        if name == "near_dedup":
            words = {i: t.lower().split() for i, t in texts.items()}
            sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
            lead = {i: i for i in sets}

            def find(i):
                while lead[i] != i:
                    i = lead[i]
                return i

            for i in sets:
                for j in sets:
                    if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                        one, two = sorted((find(i), find(j)))
                        lead[two] = one
            assert left == {find(i) for i in sets}
        if name == "best_fit_packing":
            assert left == set(texts)
