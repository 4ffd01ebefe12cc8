"""Shapes of arms: sizes counted by blocks against the sequential packer, and what is staged for them."""

import os

import pytest
from test_chunk_packing import SCHEMA, book, sequential

from corpusq.operators import chunk
from corpusq.sources import store


@pytest.mark.parametrize("block", [16, 150, 1 << 17])
def test_sizes_by_blocks_are_those_of_the_sequential_packer(spark, monkeypatch, block):
    monkeypatch.setattr(chunk, "BLOCK", block)
    rows = [(b, p, t, c) for b, n in (("a", 30), ("b", 7), (None, 3)) for p, t, c in book(n + block, n, 41)]
    df = spark.createDataFrame(rows, SCHEMA)
    grid = [(s, m, o) for s in chunk.STRATEGIES for m, o in ((12, 4), (30, 0))] + [("sentence", 5, 8)]
    want = {}
    for strategy, (atoms_of, group) in chunk.STRATEGIES.items():
        by_book = {}
        for r in atoms_of(df).orderBy("book", "ord").collect():
            by_book.setdefault(r.book, []).append((r.page, r.chapter, r.is_head, r.atom.split()))
        for s, m, o in [g for g in grid if g[0] == strategy]:
            for arm, overlap in ((f"{s}/{m}/{o}", o), (f"-{s}/{m}/{o}", 0)):
                want[arm] = sorted(len(c[2].split()) for own in by_book.values() for c in sequential(own, m, overlap, group))
    got = {r.arm: r for r in chunk.run_arms(df, grid).collect()}
    assert len(got) == len(grid)
    for arm, r in got.items():
        w = want[arm]
        assert (r.n_chunks, r.total_words, r.max_words, r.source_words) == (len(w), sum(w), w[-1], sum(want[f"-{arm}"]))
        assert r.p90_words == w[int(0.9 * len(w))] and r.median_words == (w[(len(w) - 1) // 2] + w[len(w) // 2]) // 2


def test_arms_stage_no_texts(spark, monkeypatch):
    """Texts of 400 KB of random words, in seven arms: what is staged is less than a quarter of the texts."""
    paths = []
    monkeypatch.setattr(store, "new_path", lambda s, name: paths.append(f"{store.shared_dir(s)}/corpusq/arms-{os.urandom(8).hex()}") or paths[-1])
    df = spark.createDataFrame([("a", p, " ".join(os.urandom(8).hex() for _ in range(240)), "c") for p in range(100)], SCHEMA)
    assert chunk.run_arms(df, chunk.arms([60, 30], [10, 0])).count() == 7
    staged = sum(os.path.getsize(os.path.join(at, f)) for p in paths for at, _, files in os.walk(p) for f in files)
    assert 0 < staged < 100 * 240 * 17 / 4
