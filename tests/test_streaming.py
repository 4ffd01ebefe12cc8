"""Streaming jobs that are lost midway and start again."""

import datetime
import difflib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq.functions import fuzzy
from corpusq.operators import search, textindex, verify
from corpusq.sources.versions import Versions
from corpusq.streaming import jobs


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def arrive(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def lost(monkeypatch, owner, name, when):
    """owner.name raises once when() says so, after it has done its work."""
    real, state = getattr(owner, name), {"left": True}

    def once(*a, **k):
        out = real(*a, **k)
        if state["left"] and when(*a, **k):
            state["left"] = False
            raise OSError("lost")
        return out

    monkeypatch.setattr(owner, name, once)


def grades(n, day):
    return [(q, f"arm{q % 2}", float(day * 10 + q), 1.0, day * 100 + q, at(24 * day)) for q in range(n)]


def test_the_monitor_starts_again_after_a_batch_was_written(spark, tmp_path, monkeypatch):
    for day in range(3):
        arrive(spark, grades(4 + day, day), jobs.RUNS, f"{tmp_path}/in")
    writer, calls = jobs._by_batch, []

    def failing(path):
        def each(batch, n):
            writer(path)(batch, n)
            calls.append(n)
            if calls == [0, 1]:  # written, but not yet known to be
                raise OSError("lost")

        return each

    monkeypatch.setattr(jobs, "_by_batch", failing)
    with pytest.raises(Exception, match="lost"):
        jobs.monitor(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", per_batch=1).awaitTermination()
    jobs.monitor(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", per_batch=1).awaitTermination()
    assert calls == [0, 1, 1, 2]
    got = rows(jobs.records(spark, f"{tmp_path}/out"), "question_id", "arm", "score")
    assert got == sorted([(q, f"arm{q % 2}", 20.0 + q) for q in range(6)], key=str)
    assert jobs.monitor_report(jobs.records(spark, f"{tmp_path}/out"), 10).first().done == 6


def test_an_older_record_does_not_replace_a_newer_one(spark, tmp_path):
    for day in (2, 0, 1):
        arrive(spark, grades(3, day), jobs.RUNS, f"{tmp_path}/in")
    jobs.monitor(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", per_batch=1).awaitTermination()
    assert {r.score for r in jobs.records(spark, f"{tmp_path}/out").collect()} == {20.0, 21.0, 22.0}


def test_windows_close_with_the_watermark(spark, tmp_path):
    g = lambda hour, n: [(i, "arm0", 1.0, 2.0, i, at(hour)) for i in range(n)]
    for hour, n in ((0, 2), (1, 3), (40, 1), (2, 9), (80, 1)):  # what comes at hour 2 after hour 40 is later than a day
        arrive(spark, g(hour, n), jobs.RUNS, f"{tmp_path}/in")
        jobs.windows(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", "1 hour", "1 day").awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out").select(F.date_format("start", "dd HH"), "n"))
    assert got == [("01 00", 2), ("01 01", 3), ("02 16", 1)]


def test_feedback_counts_once_also_after_a_batch_that_was_not_noted(spark, tmp_path):
    e = lambda ids, hour: [(i, "p", "wrong", "some words", "t", at(hour)) for i in ids]
    arrive(spark, e([1, 2, 2], 0), jobs.FEEDBACK, f"{tmp_path}/in")
    run = lambda: jobs.feedback(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", "1 day").awaitTermination()
    run()
    arrive(spark, e([2, 3], 1), jobs.FEEDBACK, f"{tmp_path}/in")
    run()
    # as if the driver had been lost after the batch's files were written and before the batch was noted as done
    done = sorted((f for f in os.listdir(f"{tmp_path}/c/commits") if f.isdigit()), key=int)
    for name in (done[-1], f".{done[-1]}.crc"):
        if os.path.exists(f"{tmp_path}/c/commits/{name}"):
            os.remove(f"{tmp_path}/c/commits/{name}")
    arrive(spark, e([3, 4], 2), jobs.FEEDBACK, f"{tmp_path}/in")
    run()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "event_id") == [(1,), (2,), (3,), (4,)]


@pytest.mark.parametrize("step", ["table", "index"])
def test_the_index_starts_again_between_its_two_tables(spark, tmp_path, monkeypatch, step):
    page = lambda b, text: [(b, 1, f"{text} " * 30, "c", False)]
    for b, text in (("x", "apple"), ("y", "pear"), ("x", "plum")):
        arrive(spark, page(b, text), jobs.PAGES, f"{tmp_path}/in")
    start = lambda: jobs.index(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", 20, 0)
    if step == "table":
        lost(monkeypatch, Versions, "replace", lambda self, *a, **k: self.latest() == 2)
    else:
        lost(monkeypatch, textindex, "append", lambda index, *a, **k: index.version == 1)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    assert {(r.book, r.text.split()[0]) for r in Versions(spark, f"{tmp_path}/out/chunks").read("chunks").collect()} == {("x", "plum"), ("y", "pear")}
    index = textindex.open_index(spark, f"{tmp_path}/out/index")
    q = spark.createDataFrame([(1, "apple"), (2, "pear"), (3, "plum")], "query_id int, query string")
    assert sorted({(r.query_id, r.id[0]) for r in search.bm25(index, q).collect()}) == [(2, "y"), (3, "x")]
    assert index.documents == 4 and len(index.parts) == 3


def test_an_issue_is_written_once(spark, tmp_path):
    anchors = spark.createDataFrame([(1, "a", ["alpha"]), (2, "a", ["alpha"])], "case_id long, item string, terms array<string>")
    base = spark.createDataFrame([(1, 1.0), (2, 1.0)], "case_id long, coverage double")
    for board in ("nothing", "alpha", "nothing"):
        arrive(spark, [(1, 1, board), (2, 1, "alpha")], jobs.BOARDS, f"{tmp_path}/in")
        jobs.detect(spark, f"{tmp_path}/in", anchors, base, f"{tmp_path}/found", f"{tmp_path}/c").awaitTermination()
        jobs.issues(spark, f"{tmp_path}/found", f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "case_id") == [(1,)]


# --- quotes -------------------------------------------------------------------------------------------------------------


def brute_run(q, t):
    return max((j - i for i in range(len(q)) for j in range(i + 1, len(q) + 1) if q[i:j] in t), default=0)


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", max_size=30), st.text("abc ", max_size=60))
def test_the_longest_run_is_found(q, t):
    assert fuzzy.longest_run(*fuzzy.automaton(q), t) == brute_run(q, t)


@pytest.mark.parametrize("size", [200, 584, 5_000, 20_000])
def test_quotes_in_long_premises(spark, size):
    import random

    r = random.Random(size)
    premise = "".join(r.choices("abcdefgh ", k=size))
    premise = " ".join(premise.split())
    quote = "zz" + premise[len(premise) // 2 : len(premise) // 2 + 40]
    want = difflib.SequenceMatcher(None, quote, premise, autojunk=False).find_longest_match().size
    assert want >= 40 and fuzzy.longest_run(*fuzzy.automaton(quote), premise) == want
    got = verify.matched_quotes(spark.createDataFrame([(quote, premise)], "quote string, premise string")).first()
    assert got.matched and got.score == want / len(quote)
