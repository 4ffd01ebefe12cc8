"""Joins of similar token sets against all pairs."""

import random

import pytest

from corpusq.operators import compile

SCHEMA = "board string, id int, tokens array<string>"


def sets(seed: int, n: int):
    """Boards of sets that hold parts of each other, with common and rare words, and sets of one word and of none."""
    r = random.Random(seed)
    out = []
    for board in "xy":
        held = []
        for i in range(n):
            own = set(r.sample([f"c{k}" for k in range(6)] + [f"r{k}" for k in range(60)], r.choice([0, 1, 3, 8, 25])))
            if held and r.random() < 0.5:
                base = sorted(r.choice(held))
                own = set(r.sample(base, r.randint(0, len(base)))) | set(list(own)[: r.randint(0, 3)])
            held.append(own)
            out.append((board, i, sorted(own)))
    return out


@pytest.mark.parametrize("split", [4096, 3])
@pytest.mark.parametrize("measure, threshold", [("jaccard", 0.72), ("jaccard", 0.4), ("overlap", 0.7), ("overlap", 0.5), ("overlap", 1.0)])
def test_pairs_equal_all_pairs(spark, monkeypatch, measure, threshold, split):
    monkeypatch.setattr(compile, "SPLIT", split)
    rows = sets(int(threshold * 100) + split, 70)
    want = set()
    for board, a, x in rows:
        for other, b, y in rows:
            if board == other and a < b and x and y:
                shared = len({*x} & {*y})
                if shared >= threshold * (len({*x} | {*y}) if measure == "jaccard" else min(len(x), len(y))) - 1e-12:
                    want.add((board, a, b))
    got = [tuple(r) for r in compile.similar_pairs(spark.createDataFrame(rows, SCHEMA), threshold, measure).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_larger_sets_send_few_tokens(spark):
    """Sets of 200 words with 10 small sets: only words of small sets' prefixes are sent, not every word."""
    r = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    rows = [("x", i, r.sample(words, 200)) for i in range(40)] + [("x", 100 + i, r.sample(words, 10)) for i in range(10)]
    left, right = compile._sides(spark.createDataFrame(rows, SCHEMA), 0.9, "overlap", "board")
    assert right.count() < sum(len(x) for _, _, x in rows) / 2
    # a hot word's sets lie in several parts
    hot = spark.createDataFrame([("x", i, ["a"]) for i in range(9000)], SCHEMA)
    left, right = compile._sides(hot, 0.9, "overlap", "board")
    assert left.groupBy("part").count().count() == 3 and right.count() == 27000
