"""Tables in versions, the purge over them, digests, and the full-text index in segments."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.operators import clean, purge, search, textindex
from corpusq.sources import store
from corpusq.sources.versions import Conflict, Versions


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def pages(spark, *some):
    return spark.createDataFrame(list(some), "book string, page int")


# --- versions ---------------------------------------------------------------------------------------------------------


def test_versions_replace_remove_and_go_back(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/t")
    assert v.latest() == 0 and v.read("a") is None
    v.overwrite(a=pages(spark, ("x", 1), ("x", 2), ("y", 1)), b=pages(spark, ("x", 9)))
    v.replace(a=pages(spark, ("x", 7), ("z", 1)), removed={"a": pages(spark, ("y", 0), ("x", 0))})
    assert rows(v.read("a")) == [("x", 7), ("z", 1)] and rows(v.read("b")) == [("x", 9)]
    assert rows(v.read("a", 1)) == [("x", 1), ("x", 2), ("y", 1)]
    v.replace(a=pages(spark, ("y", 5)))
    assert rows(v.read("a")) == [("x", 7), ("y", 5), ("z", 1)]
    before = v.read("a")
    assert v.compact("a", at_least=9) == 3 and v.compact("a", at_least=2) == 4
    assert rows(v.read("a")) == rows(before) and len(v.entry()["tables"]["a"]) == 1
    assert v.rollback(1) == 5 and rows(v.read("a")) == [("x", 1), ("x", 2), ("y", 1)]
    gone = v.vacuum([])
    assert len(gone) == 3 and rows(v.read("a")) == [("x", 1), ("x", 2), ("y", 1)] and rows(v.read("b")) == [("x", 9)]


def test_a_writer_that_is_lost_changes_nothing(spark, tmp_path, monkeypatch):
    v = Versions(spark, f"{tmp_path}/t")
    v.overwrite(a=pages(spark, ("x", 1)))

    def lost(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:  # after its part is written
        m.setattr(Versions, "commit", lost)
        with pytest.raises(OSError):
            v.replace(a=pages(spark, ("x", 2)))
    bad = pages(spark, ("x", 1)).withColumn("page", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):  # while it is written
        v.replace(a=bad)
    assert v.latest() == 1 and rows(v.read("a")) == [("x", 1)]
    v.replace(a=pages(spark, ("x", 3)))
    assert rows(v.read("a")) == [("x", 3)] and len(v.vacuum([])) >= 1 and rows(v.read("a")) == [("x", 3)]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/t")
    v.overwrite(a=pages(spark, ("x", 1)))
    part = v.write_part(pages(spark, ("x", 2)), 2)
    v.commit(1, {"a": [*v.entry(1)["tables"]["a"], part]})
    with pytest.raises(Conflict):
        v.commit(1, {"a": [part]})
    assert v.latest() == 2 and rows(v.read("a")) == [("x", 2)]


# --- purge --------------------------------------------------------------------------------------------------------------


def tables(spark, path, books):
    v = Versions(spark, path)
    chunk = [(b, p, f"text {'foreign' if p > 20 and b != 'clean' else ''} {'marker' if p == 30 and b != 'unmarked' else ''}", "own" if p <= 20 or b == "impure" and p == 25 else "") for b in books for p in range(1, 41)]
    figures = [(b, p, f"{b}::{p}") for b in books for p in (5, 22, 35)]
    lines = [(b, f'{{"id": "{b}::{p}"}}') for b, p, _ in figures] + [("", "{torn")]
    v.overwrite(chunks=spark.createDataFrame(chunk, "book string, page int, text string, chapter string"), figures=spark.createDataFrame(figures, "book string, page int, id string"), captions=spark.createDataFrame(lines, "book string, line string"))
    return v


def audit(c):
    return clean.contaminated_books(c, ["foreign"], "^own$", ["marker"])


def test_purge_deletes_pure_parts_from_all_tables(spark, tmp_path):
    v = tables(spark, f"{tmp_path}/t", ["pure", "impure", "clean"])
    state = purge.purge(v, audit)
    assert state == {"backup": 1, "version": 2, "chunks": 20, "figures": 2, "captions": 2, "impure": 1, "state": "purged"}
    assert v.read("chunks").groupBy("book").count().collect().__len__() == 3
    assert {(r.book, r["count"]) for r in v.read("chunks").groupBy("book").count().collect()} == {("pure", 20), ("impure", 40), ("clean", 40)}
    assert rows(v.read("figures").where("book = 'pure'"), "page") == [(5,)]
    assert {r.line for r in v.read("captions").collect()} == {f'{{"id": "{b}::{p}"}}' for b in ("impure", "clean") for p in (5, 22, 35)} | {'{"id": "pure::5"}', "{torn"}
    # again: nothing to do, no version
    assert purge.purge(v, audit) | {"captions": 0} == {"backup": 2, "version": 2, "chunks": 0, "figures": 0, "captions": 0, "impure": 1, "state": "impure"}
    assert v.latest() == 2
    # the backup is whole
    v.rollback(state["backup"])
    assert v.read("chunks").count() == 120 and v.read("captions").count() == 10


def test_purge_of_clean_books_writes_nothing(spark, tmp_path):
    v = tables(spark, f"{tmp_path}/t", ["clean"])
    assert purge.purge(v, audit)["state"] == "clean" and v.latest() == 1


def test_a_purge_that_is_lost_leaves_all_tables(spark, tmp_path, monkeypatch):
    v = tables(spark, f"{tmp_path}/t", ["pure"])
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            purge.purge(v, audit)
    assert [v.read(t).count() for t in ("chunks", "figures", "captions")] == [40, 3, 4]
    assert purge.purge(v, audit)["state"] == "purged"


# --- digests ------------------------------------------------------------------------------------------------------------


def test_digests_see_content_and_not_order(spark):
    d = lambda *r: rows(store.digest(spark.createDataFrame(list(r), "b string, id int, text string"), "b", "id", "text"))
    one = d(("x", 1, "abc"), ("x", 2, "de"), ("y", 3, None))
    assert one == d(("y", 3, None), ("x", 2, "de"), ("x", 1, "abc"))
    for other in ([("x", 1, "abd"), ("x", 2, "de")], [("x", 1, "de"), ("x", 2, "abc")], [("x", 1, "abc"), ("x", 2, "de"), ("x", 2, "de")], [("x", 1, "abc")], [("x", 12, "abc"), ("x", 2, "de")]):
        assert d(*other)[0] != one[0]
    assert d(("y", 3, ""))[0] != one[1]
    c = lambda t: store.book_fingerprint(spark.createDataFrame([("x", "1", t), ("y", "2", "b")], "book string, id string, text string"), "m").first().fingerprint
    assert c("abc") != c("abd") and c("abc") == c("abc")
    s = store.fingerprint(spark.createDataFrame([("1", 2)], "id string, a int")).first()
    assert s.schema == "a,id"


# --- the index ----------------------------------------------------------------------------------------------------------


def brute_bm25(docs, queries, k):
    terms = lambda t: [w for w in re.findall("[a-z][a-z0-9-]{2,}", (t or "").lower()) if w not in T.STOP]
    own = {i: collections.Counter(terms(t)) for i, t in docs.items()}
    length = {i: sum(c.values()) for i, c in own.items()}
    df = collections.Counter(t for c in own.values() for t in c)
    mean = sum(length.values()) / len(own)
    out = []
    for q, text in queries.items():
        asked = list(dict.fromkeys(terms(text)))[:14]
        scores = {}
        for i, c in own.items():
            if any(t in c for t in asked):
                scores[i] = (sum(math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for t in asked if t in c))
        out += [(q, i, pytest.approx(s, abs=2e-6)) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
    return out


def corpus(n, seed=1):
    import random

    r = random.Random(seed)
    words = [f"term{i}" for i in range(60)]
    return {i: "common " + " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.randint(1, 40))) for i in range(n)}


def source(spark, docs, size=10):
    df = spark.createDataFrame([(i, f"b{i // size}", t) for i, t in docs.items()], "id int, key string, text string")
    return df, store.digest(df, "key", "id", "text")


def refreshed(spark, path, docs, **more):
    df, digests = source(spark, docs)
    return textindex.refresh(spark, path, digests, lambda keys: df.join(keys, "key", "left_semi"), **more)


def found(spark, index, queries, k=5):
    q = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    return [(r.query_id, r.id, r.score) for r in search.bm25(index, q, k).orderBy("query_id", "rank").collect()]


QUERIES = {1: "term1 term40", 2: "common term7 term9 term30", 3: "common", 4: "nowhere", 5: "term59 term58 and the term57"}


@pytest.fixture()
def small(monkeypatch):
    for name, value in (("RANGE", 8), ("GROUP", 4), ("FIRST", 2)):
        monkeypatch.setattr(textindex, name, value)


def test_the_index_finds_what_a_whole_search_does(spark, tmp_path, small):
    docs = corpus(150)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks as they would be at a size that is worth it
    try:
        index = refreshed(spark, f"{tmp_path}/i", docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found(spark, index, QUERIES) == brute_bm25(docs, QUERIES, 5)
    # a term that every document has is in many blocks, in several files
    b = index.dataset("blocks").where("term = 'common'")
    assert b.agg(F.sum("n"), F.max("n")).first()[0] == 150 and b.count() == 18
    assert b.select(F.input_file_name()).distinct().count() > 1


def test_an_index_follows_texts_of_the_same_length(spark, tmp_path, small):
    docs = corpus(60)
    path = f"{tmp_path}/i"
    refreshed(spark, path, docs)
    edited = {i: t.translate(str.maketrans("aeiou", "eioua")) if i % 3 else t for i, t in docs.items()}
    assert {i: len(t) for i, t in edited.items()} == {i: len(t) for i, t in docs.items()}
    index = refreshed(spark, path, edited)
    queries = QUERIES | {6: "cummun", 7: "tirm1 term1"}
    assert found(spark, index, queries) == brute_bm25(edited, queries, 5)


def test_segments_equal_an_index_written_anew(spark, tmp_path, small):
    path, docs = f"{tmp_path}/i", corpus(80)
    index = refreshed(spark, path, docs)
    assert refreshed(spark, path, docs).version == index.version == 1  # nothing has changed
    for step in range(3):
        docs = {i: t for i, t in docs.items() if i // 10 != step} | {i: f"term{step} {t}" for i, t in corpus(100, 7 + step).items() if 40 + 10 * step <= i}
        index = refreshed(spark, path, docs)
        assert len(index.parts) == step + 2 and index.documents == len(docs)
        assert found(spark, index, QUERIES) == brute_bm25(docs, QUERIES, 5)
        q = spark.createDataFrame([(1, "term1 term2 common")], "query_id int, query string")
        whole = spark.createDataFrame(list(docs.items()), "id int, text string")
        assert rows(search.all_terms(index, q)) == rows(search.all_terms(whole, q))
    one = textindex.compact(index, 2)
    assert len(one.parts) == 1 and found(spark, one, QUERIES) == brute_bm25(docs, QUERIES, 5)
    assert found(spark, textindex.open_index(spark, path, index.version), QUERIES) == brute_bm25(docs, QUERIES, 5)
    # other settings: anew
    assert len(refreshed(spark, path, docs, settings="x").parts) == 1


def test_an_append_that_is_lost_leaves_the_index(spark, tmp_path, small, monkeypatch):
    path, docs = f"{tmp_path}/i", corpus(30)
    refreshed(spark, path, docs)
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            refreshed(spark, path, corpus(30, 2))
    assert found(spark, textindex.open_index(spark, path), QUERIES) == brute_bm25(docs, QUERIES, 5)


def test_bounds_rule_out_ranges(spark, tmp_path, small):
    docs = corpus(400, 3) | {i: "rare " * (i - 399) + "common" for i in range(400, 412)}
    index = refreshed(spark, f"{tmp_path}/i", docs)
    q = search.query_terms(spark.createDataFrame([(1, "rare common")], "query_id int, query string"))
    every = textindex.bounds(index, q, search.K1, search.B).agg(F.sum("postings")).first()[0]
    read = textindex.needed(index, q, 5, search.K1, search.B).agg(F.sum("postings")).first()[0]
    assert read < every / 2
    assert found(spark, index, {1: "rare common"}) == brute_bm25(docs, {1: "rare common"}, 5)


def test_a_search_reads_buckets_of_its_terms_only(spark, tmp_path):
    index = refreshed(spark, f"{tmp_path}/i", corpus(50))
    q = search.query_terms(spark.createDataFrame([(1, "term1")], "query_id int, query string"))
    files = index.of_terms("blocks", q).select(F.input_file_name().alias("f")).distinct().count()
    assert files == 1 and index.dataset("blocks").select(F.input_file_name()).distinct().count() > 1


def test_an_index_of_nothing(spark, tmp_path):
    assert found(spark, refreshed(spark, f"{tmp_path}/i", {0: ""}), QUERIES) == []
    assert found(spark, textindex.open_index(spark, f"{tmp_path}/none"), QUERIES) == []
