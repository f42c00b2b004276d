"""The pipeline's stages on the smallest tables, each judged on its own input by brute force."""

import os

import pytest

from tests.llm.test_operators import closure, shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, sides = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sides.append((name, before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    after = {name: ({r["doc_id"]: r["text"] for r in out.collect()} if "text" in out.columns else {}) for name, _, out in sides}
    start = {name: before for name, before, _ in sides}
    kept = after["quality_classifier"]
    good = [i for i in labels if labels[i] == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i not in kept for i in labels if labels[i] == 0) >= 0.6 * (len(labels) - len(good))
    ids = sorted(start["minhash_near_dedup"])
    group = closure([shingles(start["minhash_near_dedup"][i], 5) for i in ids], 80)
    assert sorted(after["minhash_near_dedup"]) == [ids[k] for k, g in enumerate(group) if g == k]
    clean = after["benchmark_decontamination"]
    assert not any(item in (t or "") for t in clean.values() for item in items)
    assert all(i in clean for i, t in start["benchmark_decontamination"].items() if not any(" ".join(item.split()[k : k + 5]) in " ".join((t or "").split()) for item in items for k in range(0, len(item.split()) - 4)))
    packed = sides[-1][2].collect()
    assert {r["doc_id"] for r in packed} == set(clean) and sum(r["n_tokens"] for r in packed) == sum(len((t or "").encode().split()) for t in clean.values())
