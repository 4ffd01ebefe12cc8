"""Periodic runs against a brute-force version, and Lyndon arrays against their definition."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusq.llm import common, queries, runs

DATA = "/root/testdata/sf0.001"


def brute_lyndon(text):
    out = []
    for i in range(len(text)):
        out.append(max(j - i for j in range(i + 1, len(text) + 1) if all(text[i:j] < text[k:j] for k in range(i + 1, j))))
    return out


def brute_runs(w, least, periods):
    """For every period the stretches in which words so far apart are the same; smallest periods only."""
    n, found = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, periods * q):
                stretch = w[s : i + q]
                if not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                    found.append((s, i + q - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, least=24, periods=3):
    w = (text or "").encode().split()
    found = brute_runs(w, least, periods)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def brute_planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n)).decode()


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_lyndon_arrays_are_those_of_the_definition(text):
    assert runs.lyndon(text) == brute_lyndon(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_all_runs_are_found(parts):
    w = [x for part, often in parts for x in part * often]
    text = " ".join("abc"[x] for x in w).encode()
    data, rows = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    hashes, _, _, at = common.words(data, rows, common.NOT_SPACE, lower=False)
    want = brute_runs(w, 24, 3)
    assert runs.runs_of(np.array(w, np.int64), None, 24, 3) == want
    assert runs.runs_of(np.array(w, np.int64), runs.stretches_of(hashes, at).get(0, []), 24, 3) == want


def cases():
    rng = np.random.default_rng(5)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a " * 23), (6, "a " * 24), (7, "A a " * 12), (8, "A\x1ca " * 13), (9, "x " * 30 + "y " * 30), (None, "p q r " * 9), (None, None)]
    for i in range(40):
        line = " ".join(rng.choice(["u", "v", "w", "Ü"], int(rng.integers(1, 12))))
        some = " ".join(rng.choice([f"w{k}" for k in range(30)], int(rng.integers(0, 60))))
        out.append((100 + i, f"{some} " + f"{line}\n" * int(rng.integers(1, 12)) + some))
    long = " ".join(rng.choice([f"w{k}" for k in range(500)], 6_000))
    return out + [(200, long), (201, f"{long} {long} {long}"), (202, (long[:3000] + " ") * 4), out[20], out[20], (103, "another text of this id " * 9)]


def test_runs_of_a_table(spark):
    df = spark.createDataFrame([(i, t, "en", 3, [1]) for i, t in cases()], "doc_id long, text string, runs string, n_words int, w array<int>").coalesce(2)
    got = sorted((tuple(r) for r in runs.digest(runs.detected(df)).select(*NAMES).collect()), key=str)
    assert got == sorted((brute(*c) for c in cases()), key=str)
    assert max(r[2] or 0 for r in got) >= 0 and sum(r[1] for r in got) > 20
    texts = {r["doc_id"]: r["collapsed"] for r in runs.detected(df).collect()}
    assert texts[9] == "x y" and texts[6] == "a" and texts[201] == texts[200] and texts[1] == ""


def test_runs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert runs.digest(runs.detected(runs.planted(df))).count() == 0


def test_runs_are_long_and_periodic(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        runs.detected(df, least=23)
    with pytest.raises(ValueError):
        runs.detected(df, periods=2)


def test_words_of_a_tenth_of_the_documents_are_repeated(spark):
    rows = [(i, t) for i, (_, t) in enumerate(cases() * 4)] + [(None, "a b c"), (-5, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in runs.planted(df).collect()), key=str)
    assert got == sorted(((i, brute_planted(i, t)) for i, t in rows), key=str)
    assert any(t != u for (_, t), (_, u) in zip(sorted(rows, key=str), got))


def test_op13_periodic_runs(spark):
    got = sorted((tuple(r) for r in queries.queries()["op13_periodic_runs"](spark, DATA).select(*NAMES).collect()), key=str)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((brute(d, brute_planted(d, t)) for d, t in docs), key=str)
    assert sum(r[1] for r in got)
