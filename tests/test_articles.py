"""Article XML and the defects of runs."""

import pytest

from corpusq.functions.articles import sections_of
from corpusq.operators import evaluate, gate, structure


def labels(xml):
    return [(s["kind"] or s["title"], s["text"]) for s in sections_of(xml)]


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ("<a><body><sec><title>T</title>x<sec><title>U</title>y</sec></sec></body></a>", [("T", "TxUy")]),
        ("<a><body><sec><title>A <i>b</i> c</title></sec></body></a>", [("A ", "A b c")]),
        ("<a><body><sec/><sec sec-type=' X '/></body></a>", [("", ""), ("x", "")]),
        ("<a><body><sec>&#65;&#x42;&amp;<!-- <sec>no --><![CDATA[<sec>]]></sec></body></a>", [("", "AB&<sec>")]),
        ("<a><abstract>one</abstract><abstract>two</abstract></a>", [("abstract", "one")]),
        ("<a><body><p><sec>not on top</sec></p><sec><p>x</p></sec></body><body><sec>second</sec></body></a>", [("", "x")]),
        ("<a><body><sec><abstract>within</abstract></sec></body></a>", [("abstract", "within"), ("", "within")]),
        ("<a><body><sec><p><title>deep</title></p><title>own</title><title>again</title></sec></body></a>", [("own", "deepownagain")]),
        ("<a>text</a>", []),
    ],
)
def test_sections(xml, want):
    assert labels(xml) == want


@pytest.mark.parametrize("xml", ["<a><body>", "no xml", "", "<a>&nosuch;</a>", "<a></b>", "<a>\x01</a>"])
def test_what_does_not_parse_has_none(xml):
    assert sections_of(xml) is None


def test_sections_of_a_table(spark):
    body = "<a><body><sec sec-type='methods'>We did the following things.</sec><sec sec-type='funding'>Money came from somewhere.</sec><sec><title>odd</title>Something else of some length.</sec><sec>short</sec></body></a>"
    df = spark.createDataFrame([(1, body), (2, None), (3, "<bad")], "work_id int, xml string")
    got = [tuple(r) for r in structure.article_sections(df, {"methods": "methods"}).orderBy("sequence").collect()]
    assert got == [(1, 0, "methods", "We did the following things."), (1, 1, "other", "oddSomething else of some length.")]


def test_defects_of_runs_and_statuses(spark):
    runs = spark.createDataFrame([(1, " An  answer ", 3, 2, ["1", "L2"]), (2, "fine", 3, 0, []), (3, None, None, 1, None), (4, "x", 1, None, [])], "question_id int, answer string, n_cited int, n_unsupported int, unsupported_markers array<string>")
    got = {r.question_id: (r.excerpt, r.basis, r.confidence) for r in evaluate.verification_defects(runs).collect()}
    assert got == {1: ("An answer", "verification: 2/3 cited claims not entailed by cited source (markers: 1, L2)", 0.5), 3: ("", "verification: 1/0 cited claims not entailed by cited source (markers: )", 0.5)}
    grades = spark.createDataFrame([(1, "Not gradable", "x", "why"), (2, "B", "not gradable", None), (3, "B", "usable", "z")], "question_id int, letter string, usability string, reason string")
    assert {r.question_id: r.excerpt for r in evaluate.status_defects(grades).collect()} == {1: "why", 2: "engine returned an empty/None answer after disambiguation"}


def test_the_gate_without_cases_is_all_zero(spark):
    e = lambda s: spark.createDataFrame([], s)
    m = gate.gate_metrics(e("case_id int, laterality string, level string, goal string"), e("case_id int, laterality string, level string, goal string"), e("case_id int, context string, section string, slot string, id int, text string"), e("case_id int, section string, pmid string"), e("case_id int, phrase string"), e("archetype_ok boolean, side_ok boolean, guard_ok boolean"), ["a"], {"a": ["f"]}, ["a"], ["a"], e("pmid string"))
    got = {r.metric: r.value for r in m.collect()}
    assert set(got) == set(gate.DIRECTIONS) and set(got.values()) == {0.0}


def test_a_case_counts_only_with_all_it_needs(spark):
    truth = spark.createDataFrame([(1, "left", "C5", "fuse"), (2, "right", "", "open")], "case_id int, laterality string, level string, goal string")
    read = spark.createDataFrame([(1, "left", "C5", "Fuse it"), (2, "left", "", None)], "case_id int, laterality string, level string, goal string")
    claims = spark.createDataFrame([(1, "gt", "a", "f", 1, "cited [1]"), (1, "gt", "b", "f", 2, "only [L1]"), (2, "gt", "a", "f", 1, "x [2]"), (1, "det", "a", "f", 1, "bad Word")], "case_id int, context string, section string, slot string, id int, text string")
    literature = spark.createDataFrame([(1, "a", "p1"), (2, "a", "made up")], "case_id int, section string, pmid string")
    flags = spark.createDataFrame([(1, "BAD word"), (2, "absent"), (1, "bad word")], "case_id int, phrase string")
    figures = spark.createDataFrame([(True, False, True)], "archetype_ok boolean, side_ok boolean, guard_ok boolean")
    m = gate.gate_metrics(read, truth, claims, literature, flags, figures, ["a", "b"], {"a": ["f"]}, ["a"], ["a", "b"], spark.createDataFrame([("p1",)], "pmid string"))
    got = {r.metric: r.value for r in m.collect()}
    assert got == {"section_coverage_det": 0, "section_coverage_gt": 0.5, "facet_coverage": 1, "intake_side_acc": 0.5, "intake_level_acc": 1, "intake_goal_acc": 0.5, "lit_coverage": 0.5, "corpus_n_coverage": 0, "attribution_precision": round(2 / 3, 6), "near_dup_rate": 0, "red_flag_contamination": 1, "figure_archetype_acc": 1, "figure_side_acc": 0, "figure_guard_reject": 1}
