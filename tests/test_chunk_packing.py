"""The packer of chunks against a sequential one."""

import random

import pytest

from corpusq.operators import chunk
from pyspark.sql import functions as F

SCHEMA = "book string, page int, text string, chapter string"


def sequential(atoms, most, overlap, group):
    """[(page, chapter, text)] of one book's (page, chapter, is_head, words) in order, chunk by chunk."""
    step = max(1, most - overlap)

    def windows(words):
        last = 0 if len(words) <= most else -(-(len(words) - most) // step)
        return [words[k * step : k * step + most] for k in range(last + 1)]

    out, held, at, before = [], [], None, None
    for n, (page, chapter, head, words) in enumerate(atoms):
        key = {"page": page, "chapter": chapter}.get(group)
        if held and ((group == "heading" and head) or (group in ("page", "chapter") and n and key != before)):
            out.append((at, held))
            held = []
        before = key
        if not held:
            at = (page, chapter)
        if len(held) + len(words) <= most:
            held = held + words
        elif not held:
            out += [(at, w) for w in windows(words)]
        else:
            out.append((at, held))
            *whole, held = windows((held[-overlap:] if overlap else []) + words)
            at = (page, chapter)
            out += [(at, w) for w in whole]
    if held:
        out.append((at, held))
    return [(*a, " ".join(w)) for a, w in out]


def book(seed: int, pages: int, longest: int):
    r = random.Random(seed)
    out = []
    for p in range(pages):
        lines = []
        for _ in range(r.randint(0, 5)):
            words = [f"w{r.randint(0, 99)}" for _ in range(r.choice([1, 2, 5, longest]))]
            lines.append(r.choice(["", "2 Methods\n", "\n\n"]) + " ".join(words) + r.choice([".", "", "?"]))
        out.append((p, "\n".join(lines) or r.choice([None, "", " "]), r.choice(["one", "one", "two", None])))
    return out


@pytest.mark.parametrize("most, overlap, longest", [(12, 4, 9), (12, 0, 40), (10, 9, 30), (5, 8, 17), (300, 40, 900)])
def test_packing_equals_the_sequential_packer(spark, most, overlap, longest):
    rows = [(b, p, t, c) for b, n in (("a", 40), ("b", 7), (None, 3)) for p, t, c in book(most * 31 + longest + n, n, longest)]
    df = spark.createDataFrame(rows, SCHEMA)
    want, arms = {}, []
    for strategy, (atoms_of, group) in chunk.STRATEGIES.items():
        atoms = atoms_of(df)
        arms.append(chunk._arm(atoms, strategy, most, overlap, group))
        by_book = {}
        for r in atoms.orderBy("book", "ord").collect():
            by_book.setdefault(r.book, []).append((r.page, r.chapter, r.is_head, r.atom.split()))
        for b, own in by_book.items():
            for i, c in enumerate(sequential(own, most, overlap, group)):
                want[strategy, b, i] = c
    packed = arms[0]
    for a in arms[1:]:
        packed = packed.unionByName(a)
    got = chunk.pack_arms(packed).collect()
    assert len(got) == len(want)
    assert {(r.arm, r.book, r.i): (r.page, r.chapter, r.text) for r in got} == want


def test_a_long_book_of_short_sentences(spark):
    """One book, 3 000 sentences and some 500 chunks in one chain."""
    r = random.Random(3)
    rows = [("a", p, " ".join(" ".join(f"v{r.randint(0, 9)}" for _ in range(r.randint(1, 14))) + "." for _ in range(30)), "c") for p in range(100)]
    atoms = chunk.sentence_atoms(spark.createDataFrame(rows, SCHEMA))
    own = [(x.page, x.chapter, x.is_head, x.atom.split()) for x in atoms.orderBy("ord").collect()]
    got = chunk.pack(atoms, 50, 8).orderBy("i").collect()
    assert [(x.page, x.chapter, x.text) for x in got] == sequential(own, 50, 8, None)


def test_packing_of_nothing_and_of_repeated_pages(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chunk.chunk(df, "sentence", 5, 1).count() == 0
    twice = spark.createDataFrame([("a", 1, "x y. z.", "c"), ("a", 1, "x y. z.", "c")], SCHEMA)
    assert [x.text for x in chunk.chunk(twice, "sentence", 4, 0).orderBy("i").collect()] == ["x y. x y.", "z. z."]
    with pytest.raises(ValueError):
        chunk.chunk(df, "page", 0, 0)


def test_no_python_in_the_packer(spark):
    df = spark.createDataFrame([("a", 1, "x y. z.", "c")], SCHEMA).where(F.col("page") > 0)
    plan = chunk.chunk(df, "sentence", 4, 0)._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Python" not in plan
