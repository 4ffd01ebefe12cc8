"""The n-gram join against all pairs compared, and its pigeonhole by itself."""

import itertools
import re

import numpy as np
import pytest

from corpusq.llm import common, queries, setjoin

DATA = "/root/testdata/sf0.001"
NAMES = ("doc_id", "n_shingles", "component_id")


def shingles(text, length=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1))} if w else set()


def similar(x, y, threshold):
    both = len(x & y)
    return both and 100 * both >= threshold * (len(x) + len(y) - both)


def brute(rows, threshold=85, length=4):
    own = [shingles(t, length) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        if None not in (rows[i][0], rows[j][0]) and (rows[i][0] == rows[j][0] or similar(own[i], own[j], threshold)):
            root[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i, (d, _) in enumerate(rows):
        if d is None:
            continue
        least = min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(i))
        n, _ = out.get(d, (0, 0))
        out[d] = (max(n, len(own[i])), least)
    return sorted((d, *x) for d, x in out.items())


def variants(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        k = int(rng.integers(0, len(out)))
        how = rng.integers(0, 3)
        if how == 0:
            out[k] = f"new{rng.integers(0, 10**9)}"
        elif how == 1:
            del out[k]
        else:
            out.insert(k, f"new{rng.integers(0, 10**9)}")
        if not out:
            out = ["left"]
    return " ".join(out)


@pytest.mark.parametrize("threshold", [70, 80, 85, 95])
def test_bands_hold_every_partner(threshold):
    bands = setjoin.Bands(threshold)
    for n in [*range(1, 400), 5_000, 123_457]:
        mine = bands.kept(n)
        for m in {n, n + 1, (n + 100 * n // threshold) // 2, 100 * n // threshold}:
            most = bands.differences(n + m)
            if 100 * n < threshold * m or n > m or not most:
                continue
            k, segments, deep, keep, _ = mine[0]
            theirs = {x[0]: x for x in bands.kept(m)}
            # the partner keeps the same segments of the band, and values can sum to more than the differences
            assert theirs[k][1:3] == (segments, deep) and theirs[k][3] >= keep and keep <= segments
            assert keep + deep - bands.spare(n) == bands.need(n) > most


def test_sets_in_which_few_differ_meet_whatever_the_allocation():
    """Without Spark: of two similar sets, the smaller finds the other by any values that sum to its need."""
    rng, bands = np.random.default_rng(2), setjoin.Bands(85)
    for _ in range(400):
        n = int(rng.integers(2, 300))
        both = common.mix(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        small = np.unique(both[:n])
        partner = np.unique(np.concatenate([small[: len(small) - int(rng.integers(0, 1 + n // 12))], both[n : n + int(rng.integers(0, 1 + n // 8))]]))
        small, partner = sorted([small, partner], key=len)
        common_ = len(np.intersect1d(small, partner))
        if 100 * common_ < 85 * (len(small) + len(partner) - common_) or np.array_equal(small, partner):
            continue
        k, m, deep, keep, _ = bands.kept(len(small))[0]
        theirs = next(x for x in bands.kept(len(partner)) if x[0] == k)
        mine = dict(zip(*(x.tolist() for x in setjoin.signatures(small, common.mix(small), k, m, deep, keep, 0))))
        place, signature = setjoin.signatures(partner, common.mix(partner), *theirs)
        place -= 2 * theirs[4]
        whole, less = set(signature[place % 4 == 0].tolist()), set(signature[place % 4 == 1].tolist())
        own_place, own_signature = setjoin.signatures(small, common.mix(small), k, m, deep, keep, 0)
        need, values = bands.need(len(small)), np.zeros(keep, int)
        while values.sum() < need:
            i = int(rng.integers(0, keep))
            values[i] = min(values[i] + 1, 2 if i < deep else 1)
        hit = False
        for p, s in zip(own_place.tolist(), own_signature.tolist()):
            v = values[p // 4]
            hit |= (p % 4 == 0 and v >= 1 and s in whole) or (p % 4 == 0 and v == 2 and s in less) or (p % 4 == 1 and v == 2 and s in whole)
        assert hit and mine


def test_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 900, 50_000):
        x = common.mix(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.concatenate([x[: n - n // 5], common.mix(rng.integers(0, 2**63, n // 4, dtype=np.uint64))])
        d = setjoin.distances([setjoin.sketch(x), setjoin.sketch(y)], np.array([0]), np.array([1]))[0]
        assert d <= n // 5 + n // 4 and (d > 0 or n < 5)


def cases(seed=6):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "two one"), (8, "one two"), (9, "same " * 50), (10, "same " * 60), (None, "one"), (None, None)]
    at = 20
    for size in (5, 8, 11, 14, 20, 33, 50, 90, 160, 300):
        base = list(rng.choice(vocabulary, size))
        for _ in range(14):
            out.append((at, variants(rng, base, int(rng.integers(0, 1 + size // 12 + 1)))))
            at += 1
    passage = " ".join(rng.choice(vocabulary, 60))
    out += [(at + k, f"{passage} " + " ".join(rng.choice(vocabulary, int(rng.integers(5, 60))))) for k in range(30)]
    long = list(rng.choice(vocabulary, 6_000))
    out += [(500, " ".join(long)), (501, variants(rng, long, 40)), (502, variants(rng, long, 900))]
    return out + [(20, "another text of this id, which is linked with nothing else"), (40, "one two"), out[30], out[30], (None, out[31][1])]


@pytest.mark.parametrize(("threshold", "length"), [(85, 4), (80, 3)])
def test_components_are_those_of_all_pairs(spark, threshold, length):
    rows = cases()
    df = spark.createDataFrame([(i, t, 1, "x", [2]) for i, t in rows], "doc_id long, text string, c int, bucket string, pieces array<int>").repartition(3)
    got = sorted(tuple(r) for r in setjoin.linked(df, threshold, length).where("doc_id is not null").select(*NAMES).collect())
    assert got == brute(rows, threshold, length)


def test_a_row_without_doc_id_shows_its_class(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "A b c d e"), (None, "else"), (8, "f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in setjoin.linked(df).collect()), key=str)
    assert got == [(7, 2, 7), (8, 1, 8), (None, 2, 7)]


def test_joins_of_hot_signatures(spark, monkeypatch):
    """Hundreds of variants of one text, about as far apart as the threshold: tiles of a few, nothing is lost."""
    monkeypatch.setattr(setjoin, "PART", 16)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 120)]
    rows = [(k, variants(rng, base, int(rng.integers(1, 6)))) for k in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in setjoin.linked(df).select(*NAMES).collect())
    assert got == brute(rows)
    assert 1 < len({r[2] for r in got}) < 250


def test_the_join_of_an_empty_table(spark):
    assert setjoin.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_low_thresholds_are_refused():
    with pytest.raises(ValueError):
        setjoin.Bands(60)


def test_op11_ngram_join(spark):
    got = sorted(tuple(r) for r in queries.queries()["op11_ngram_join"](spark, DATA).select(*NAMES).collect())
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(docs)
