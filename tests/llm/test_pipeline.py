"""Stages of the corpus pipeline."""

import numpy as np

import corpus_pipeline


def test_near_dedup_takes_similarity_of_eighty_per_cent(spark):
    # a changed word inside takes 5 of n shingles: similarity (n - 5) / (n + 5)
    rng = np.random.default_rng(4)
    rows, copies = [], set()
    for k in range(400):
        n = (45, 50, 40)[k % 3]  # 0.80, 0.818 and 0.778
        words = [f"w{x}" for x in rng.integers(1 << 40, size=n + 4)]
        other = [*words]
        other[20] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if n != 40:
            copies.add(2 * k + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i, _ in rows} - copies
