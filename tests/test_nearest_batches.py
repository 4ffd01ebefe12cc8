"""Nearest neighbours by batches: no pairs as rows, ties by id, scores rounded as Spark rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.operators import pivots, search


@pytest.mark.parametrize("measure", ["l2", "cosine"])
def test_pairs_are_no_rows_and_ties_go_to_smaller_ids(spark, measure):
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (700, 4)).astype(float)  # few different vectors, many ties
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id long, vector array<double>").repartition(3)
    q = v.where("id % 50 = 0").selectExpr("id AS query_id", "vector AS qvector")
    want = search.top(pivots.scored(v.crossJoin(q), measure), 9)
    for few in (0, 1 << 40):
        got = search.knn(v, q, 9, measure, few_pairs=few)
        assert "Join" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "score", "rank").collect()))


def test_millionths_are_rounded_as_spark_does(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=2_000) * 3, (rng.integers(-(10**7), 10**7, 4_000) + 0.5) / 1e6, [0.0, 2.5e-7, -1.0000005]])
    got = spark.createDataFrame([(i, float(y)) for i, y in enumerate(x)], "i int, x double").select("i", F.round("x", 6).alias("r"))
    want = {r.i: round(r.r * 1e6) for r in got.collect()}
    assert pivots._millionths(x).astype(int).tolist() == [want[i] for i in range(len(x))]
