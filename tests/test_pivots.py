"""Nearest neighbours by pivots against all pairs scored."""

import numpy as np
import pytest

from corpusq.operators import pivots, search


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select("query_id", "id", "score", "rank").collect()))


def odd():
    rng = np.random.default_rng(1)
    v = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 6)))]
    return v + [(300 + i, v[5][1]) for i in range(15)] + [(400, None), (401, [1.0]), (402, [0.0] * 6), (403, [float("nan")] + [0.0] * 5), (404, [0.0] * 6), (405, [1.0, 2.0])]


@pytest.mark.parametrize("measure", ["l2", "cosine"])
def test_pivots_give_the_rows_of_all_pairs(spark, measure):
    v = spark.createDataFrame(odd(), "id int, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, x) for i, x in odd() if i % 40 == 0 or i in (310, 401, 402, 405)], "query_id int, qvector array<double>")
    assert rows(search.knn(v, q, 12, measure, few_pairs=0)) == rows(search.knn(v, q, 12, measure))


def test_pivots_rule_out_most_pairs_of_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(50, 16)) * 4
    x = centres[rng.integers(0, 50, 4_000)] + rng.normal(size=(4_000, 16)) * 0.05
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id int, vector array<double>").repartition(4)
    q = v.where("id % 100 = 0").selectExpr("id AS query_id", "vector AS qvector")
    own = pivots.ringed(v, "l2")
    assert pivots.pairs_left(own, q, 10, "l2").count() < 0.1 * 40 * 4_000
    assert rows(search.knn(v, q, 10, few_pairs=0)) == rows(search.knn(v, q, 10))
