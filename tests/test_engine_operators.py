"""Operators on small tables with known results, where SQL has no say or a case deserves one of its own."""

import pytest
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.operators import chunk, clean, compile, evaluate, rank, search, tag, verify
from corpusq.sources import store


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


# --- cleaning and chunks ----------------------------------------------------------------------------------------------


def test_references_go_line_by_line(spark):
    page = "Prose.\n12. Smith JD, Jones AB. A paper.\nMore prose.\n references \nafter"
    df = spark.createDataFrame([("b", 1, page), ("b", 2, "Bibliography"), ("b", 3, None), ("b", 4, "1. not a Citation")], "book string, page int, text string")
    got = {r.page: (r.clean_text, r.removed_chars) for r in clean.without_references(df).collect()}
    assert got[1] == ("Prose.\nMore prose.", len(page) - 18) and got[2] == ("", 12) and got[3] == ("", 0) and got[4][1] == 0
    with pytest.raises(Exception, match="took too much"):
        clean.refuse(df.where("page = 2")).collect()




def test_plates_merge_transitively(spark):
    boxes = [("b", 1, 0.0, 0.0, 100.0, 100.0, 1e5), ("b", 1, 110.0, 0.0, 200.0, 100.0, 1e5), ("b", 1, 210.0, 50.0, 300.0, 200.0, 1e5), ("b", 1, 0.0, 400.0, 10.0, 410.0, 1e5), ("b", 1, 0.0, 300.0, 100.0, 380.0, 1e5)]
    df = spark.createDataFrame(boxes, "book string, page int, x0 double, y0 double, x1 double, y1 double, page_area double")
    got = [tuple(r)[2:] for r in clean.plates(df, gap=12.0).orderBy("ord").collect()]
    assert got == [(0, 0.0, 0.0, 300.0, 200.0), (1, 0.0, 300.0, 100.0, 380.0)]


def test_corpus_invariants_are_all_there(spark):
    long = "w " * 30
    pages = [("b", "junk.pdf", long, 1), ("b", "\t", long, 2), ("c", None, "et al " * 6, None), ("c", "9 - Title", None, 4)]
    df = spark.createDataFrame(pages, "book string, chapter string, text string, printed_page int")
    want = [("bibliography", 0.25, 0.05, False), ("books", 2.0, 1.0, True), ("folio", 0.75, 0.9, False), ("junk", 0.25, 0.05, False), ("short", 0.5, 0.0, False)]
    assert rows(clean.invariants(df), "check", "value", "target", "ok") == want
    assert rows(clean.invariants(df.limit(0)), "check", "value", "ok") == [("books", 0.0, False)]


def test_verdicts_of_invariants_are_not_rounded(spark):
    df = spark.range(30000).selectExpr("'b' AS book", "'x' AS chapter", "repeat('w ', if(id = 7, 3, 30)) AS text", "if(id < 3001, NULL, 1) AS printed_page")
    got = {r["check"]: (r["value"], r["ok"]) for r in clean.invariants(df).collect()}
    assert got["short"] == (0.0, False) and got["folio"] == (0.9, False)


def test_sections_of_plain_text(spark):
    text = "A lead of more than twenty letters.\nMETHODS\nWe did this and that at length.\nResults:\nshort\n"
    df = spark.createDataFrame([(1, text), (2, None)], "work_id int, text string")
    assert rows(clean.sections(df, ["methods", "results"]), "work_id", "section", "content") == [(1, "methods", "We did this and that at length."), (1, "other", "A lead of more than twenty letters.")]
    label = spark.createDataFrame([("Materials and Methods",), ("x",), (None,)], "l string")
    assert [r[0] for r in label.select(clean.canonical_section(F.col("l"), {"materials and methods": "methods"})).collect()] == ["methods", "other", "other"]


def window(words, most, overlap):
    step, out, i = max(1, most - overlap), [], 0
    while i < len(words):
        out.append(" ".join(words[i : i + most]))
        if i + most >= len(words):
            break
        i += step
    return out


@pytest.mark.parametrize("n", [0, 5, 19, 20, 30, 31, 50, 55])
def test_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([("b", 3, " \n ".join(words), False, None), ("c", 1, "few words", True, "A plate")], "book string, page int, text string, has_figure boolean, cap string")
    got = chunk.chunk_pages(df, 30, 10, caption="cap").orderBy("book", "i").collect()
    assert [r.text for r in got if r.book == "b"] == (window(words, 30, 10) if n >= 20 else [])
    assert [(r.id, r.text) for r in got if r.book == "c"] == [("c::p1::0", "few words\n\nA plate")]


def test_packing(spark):
    pages = [("b", 1, "a b c. d e. f g h i j k l m.", "x"), ("b", 2, "n o. p", "x"), ("b", 3, "q", "y")]
    df = spark.createDataFrame(pages, "book string, page int, text string, chapter string")
    texts = lambda s, m, o: [r.text for r in chunk.chunk(df, s, m, o).orderBy("i").collect()]
    assert texts("page", 20, 0) == ["a b c. d e. f g h i j k l m.", "n o. p", "q"]
    assert texts("sentence", 5, 1) == ["a b c. d e.", "e. f g h i", "i j k l m.", "m. n o. p q"]
    assert texts("chapter", 100, 0) == ["a b c. d e. f g h i j k l m. n o. p", "q"]
    assert [len(t.split()) for t in texts("page", 4, 1)] == [4, 4, 4, 4, 3, 1] or all(len(t.split()) <= 4 for t in texts("page", 4, 1))
    with pytest.raises(ValueError):
        chunk.chunk(df, "none", 5, 0)


def test_headings(spark):
    df = spark.createDataFrame([("b", 1, "Intro text.\nMETHODS USED\nwe did.\n2.1 Results\nfine.\nNot A Heading.", "c")], "book string, page int, text string, chapter string")
    assert [r.atom for r in chunk.heading_atoms(df).orderBy("ord").collect()] == ["Intro text.", "METHODS USED we did.", "2.1 Results fine. Not A Heading."]


# --- search -----------------------------------------------------------------------------------------------------------


def test_fusion_breaks_ties_by_lane(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id int, id int, rank int")
    assert [r.id for r in search.fuse(a, b).orderBy("rank").collect()] == [11, 10, 12]


def test_knn_skips_odd_vectors_and_splits_queries(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, 0.1]) for i in range(5)], "query_id int, qvector array<double>")
    monkeypatch.setattr(search, "MOST_QUERY_BYTES", 16)
    got = search.knn(v, q, 1).collect()
    assert len(got) == 5 and {r.id for r in got} == {1}


def test_card_figures_take_each_path_once(spark):
    offers = [("b", 1, "x", 1), ("b", 1, "y", 2), ("b", 2, "x", 1), ("b", 2, "z", 2), ("b", 3, "x", 1), ("c", 1, "x", 1)]
    df = spark.createDataFrame(offers, "board string, card_ord int, path string, rank int")
    assert rows(rank.card_figures(df)) == [("b", 1, "x"), ("b", 2, "z"), ("c", 1, "x")]


# --- verification -----------------------------------------------------------------------------------------------------


def test_verification(spark):
    answers = spark.createDataFrame([(1, "The tumour was removed by open surgery [1]. Nothing cited here! The moon is made of green cheese [L2]. Glioma grows in frontal lobe tissue [1]."), (2, None), (3, "No premise at all [9].")], "answer_id int, answer string")
    premises = spark.createDataFrame([(1, "1", "The frontal lobe tumour was removed by open surgery last year."), (1, "L2", "Patients received careful medical treatment during several weeks.")], "answer_id int, marker string, premise string")
    v = verify.verified(answers, premises)
    got = {(r.answer_id, r.ord): (r.supported, r.bleed_terms) for r in v.collect()}
    assert got == {(1, 0): (True, []), (1, 1): (True, []), (1, 2): (False, []), (1, 3): (False, ["glioma"]), (3, 0): (True, [])}
    g = {r.answer_id: r for r in verify.groundedness(v).collect()}
    assert (g[1].n_cited, g[1].n_unsupported, g[1].unsupported_markers, g[1].bleed_terms) == (3, 2, ["L2", "1"], ["glioma"])
    assert g[3].groundedness == 1 and g[3].notice == ""


def test_quotes(spark):
    premise = "The quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(1, "quick  BROWN fox", premise), (2, "quick brown fax", premise), (3, "", premise), (4, "x", None), (5, "jumps over the lazy dot", premise)], "id int, quote string, premise string")
    got = {r.id: (round(r.score, 3), r.matched) for r in verify.matched_quotes(df).collect()}
    assert got == {1: (1.0, True), 2: (round(13 / 15, 3), False), 3: (0.0, False), 4: (0.0, False), 5: (round(22 / 23, 3), True)}


def test_staleness(spark):
    df = spark.createDataFrame([("newest", None, True), ("newest", 2017, False), ("newest", 2016, True), ("currently", None, False), ("currently", 2015, False), ("currently", 2014, True), ("plain", 1900, False)], "c string, y int, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", verify.is_stale(verify.currency_cue(F.col("c")), F.col("y"), 2020)).collect())


# --- compiling --------------------------------------------------------------------------------------------------------


def sequential(claims, threshold):
    seen, out = [], {}
    for i, section, text, status in sorted(claims):
        t = set(text.lower().split())
        hit = None if status == "quarantine" else next((s for s, u in seen if s != section and t and u and len(t & u) / len(t | u) >= threshold), None)
        out[i] = hit
        if hit is None and status != "quarantine":
            seen.append((section, t))
    return out


def test_collapse_is_the_sequential_rule(spark):
    import random

    r = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    claims = [(i, f"s{i % 3}", " ".join(r.sample(words, r.randint(3, 8))), "quarantine" if i % 17 == 0 else "open") for i in range(120)]
    df = spark.createDataFrame([(1, *c) for c in claims], "board int, id int, section string, text string, status string")
    want = sequential(claims, 0.5)
    got = {x.id: (x.kept, x.see) for x in compile.collapsed(df, 0.5).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: h is None for i, h in want.items()}
    assert all(got[i][1] == h for i, h in want.items())
    assert any(h for h in want.values())


def test_a_long_chain_takes_few_writes(spark, monkeypatch):
    n, writes = 10_000, []
    real = compile.written
    monkeypatch.setattr(compile, "written", lambda df, *a: (writes.append(1), real(df, *a))[1])
    chain = spark.range(n).selectExpr("1 AS board", "id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(2, 5, 7), (2, 5, 6), (2, 6, 7)], "board int, a long, b long"))
    marks = compile.greedy(spark.range(n + 1).selectExpr("1 AS board", "id"), chain).collect()
    assert len(marks) == n + 1 and all(m.kept == (m.id % 2 == 0) and m.of == (None if m.kept else m.id - 1) for m in marks)
    assert len(writes) <= 20
    # where no board is small, rounds go on
    monkeypatch.setattr(compile, "SMALL", 0)
    short = compile.greedy(spark.range(13).selectExpr("1 AS board", "id"), chain.where("a < 12 and board = 1")).collect()
    assert all(m.kept == (m.id % 2 == 0) for m in short)


def test_merge_is_the_sequential_rule(spark):
    import random

    r = random.Random(5)
    cards = [(i, " ".join(r.sample([f"w{k}" for k in range(12)], r.randint(2, 7)))) for i in range(100)] + [(100, " ")]
    kept = []
    for i, t in cards:
        w = set(t.split())
        if w and not any(len(w & u) / min(len(w), len(u)) > 0.7 for _, u in kept):
            kept.append((i, w))
    df = spark.createDataFrame([(1, *c) for c in cards], "board int, id int, text string")
    assert sorted(x.id for x in compile.merged(df).where("kept").collect()) == [i for i, _ in kept]


def test_feedback_adds_to_what_exists(spark):
    old = spark.createDataFrame([("p", "suppress", "bleeding risk", "old", 2, ["t0"])], "profile string, action string, pattern string, text string, weight long, sources array<string>")
    new = spark.createDataFrame([("p", "wrong", "The risk of bleeding", "t1", 1), ("p", "wrong", "risk, bleeding", "t0", 2), ("p", "other", "x y z", "t", 3), ("p", "missing", "of the", "t", 4)], "profile string, mark string, text string, topic string, ord int")
    r = compile.distilled(new, old).collect()
    assert [tuple(x) for x in r] == [("p", "suppress", "bleeding risk", "old", 4, ["t0", "t1"])]


# --- evaluation -------------------------------------------------------------------------------------------------------


def test_paired_statistics(spark):
    df = spark.createDataFrame([(i, float(i % 5 - 1)) for i in range(100)], "question int, delta double")
    r = evaluate.paired(df).collect()[0]
    assert (r.n, r.mean_delta, r.improved, r.worsened, r.unchanged) == (100, 1.0, 60, 20, 20)
    assert r.low < 1.0 < r.high and r.high - r.low < 1.0 and abs(r.t - 1.0 / (1.4213381 / 10)) < 0.01


def test_gate_fails_what_is_missing(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("a", 1.0, "min"), ("b", 1.0, "max"), ("c", 0.0, "min")], "metric string, baseline double, direction string")
    assert rows(evaluate.quality_gate(m, b), "metric", "ok") == [("a", True), ("b", False), ("c", False)]


# --- tables -----------------------------------------------------------------------------------------------------------


def test_books_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "book string, x int")
    store.write_books(first, path)
    for _ in range(2):
        store.write_books(spark.createDataFrame([("a", 9), ("c", 1)], "book string, x int"), path)
    assert rows(spark.read.parquet(path), "book", "x") == [("a", 9), ("b", 1), ("c", 1)]
    assert store.read_columns(spark, path, "book string, x long, y string").where("y is null").count() == 3
    assert store.read_columns(spark, str(tmp_path / "none"), "x int").count() == 0


def test_torn_lines_and_lists(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id"')
    assert sorted(r.id for r in store.read_lines(spark, str(tmp_path / "r.jsonl"), "id int").collect() if r.id) == [1, 2]
    (tmp_path / "h.csv").write_text("pmid,year,chapter,folder\n1,1999,3,x\n2,n.d.,,Ch12_title\n")
    assert rows(store.have_list(spark, str(tmp_path / "h.csv")), "pmid", "year", "chapter") == [("1", 1999, 3), ("2", None, 12)]


def test_an_unknown_id_is_an_error(spark):
    m = spark.createDataFrame([("a", 1, True), ("b", 2, True)], "id string, ord int, enabled boolean")
    assert rows(store.id_range(m, "a", "a"), "id") == [("a",)]
    with pytest.raises(Exception, match="unknown id"):
        store.id_range(m, "a", "z").collect()


def test_caption_head(spark):
    long = "A caption that goes on for quite some time, past sixty letters. " + "word " * 80
    df = spark.createDataFrame([(long,), ("short  one",), ("x" * 400,), (None,)], "t string")
    got = [r[0] for r in df.select(T.caption_head("t")).collect()]
    assert got == ["A caption that goes on for quite some time, past sixty letters.", "short one", "x" * 320, ""]


def test_levels(spark):
    df = spark.createDataFrame([("C5-6",), ("T12–L1 and s1",), (None,)], "t string")
    assert [r[0] for r in df.select(tag.levels("t")).collect()] == [["c5", "c6"], ["l1", "s1", "t12"], []]
