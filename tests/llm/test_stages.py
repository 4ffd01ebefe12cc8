"""Stages of the pipeline on nulls, empty and repeated rows, empty tables, long texts and clashing names."""

import collections

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, _found int, _mix int, kept boolean"
DATA = "/root/testdata/sf0.001"
PROSE = {"en": "the house and the garden of the old man were near the river and the wood ", "fr": "la maison et le jardin du vieil homme furent loin de la ville et du bois "}


def rows():
    out = [(i, PROSE["en" if i % 2 else "fr"] * (3 + i % 4) + f"own{i} word{i * 7} more{i * 11}", "en" if i % 2 else "fr", f"s{i % 3}", 9, "x", 1, 2, True) for i in range(40)]
    return out + [(100, None, "en", "s1", None, None, None, None, None), (101, "", "en", "s1", 0, "", 0, 0, False), (102, "1 2 3", "fr", None, 5, "", 0, 0, False), (103, PROSE["en"] * 500, "en", "s2", 9, "", 0, 0, True), out[5], out[5], *[(104, "the only text of its kind that comes twice under one number and is like no other", "en", "s1", 9, "", 1, 1, True)] * 2, (None, PROSE["en"] + "of none", "en", None, 9, "", 1, 1, True)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).coalesce(2)


@pytest.mark.parametrize("name", ["language", "near_dedup", "decontaminated", "mix"])
def test_a_stage_keeps_columns_and_takes_an_empty_table(spark, name):
    stage = getattr(corpus_pipeline, name)
    out = stage(spark, spark.createDataFrame([], COLUMNS), DATA)
    assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")] and out.count() == 0


def test_language_keeps_what_has_one(spark, docs):
    out = corpus_pipeline.language(spark, docs, DATA)
    ids = collections.Counter(r.doc_id for r in out.collect())
    assert out.columns == docs.columns and not {100, 101, 102} & set(ids) and ids[5] == 3 and ids[None] == 1 and ids[103] == 1
    assert set(range(40)) <= set(ids)


def test_decontamination_leaves_clean_rows_as_they_are(spark, docs):
    out = corpus_pipeline.decontaminated(spark, docs, DATA)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_near_dedup_keeps_one_row_of_an_id(spark, docs):
    ids = collections.Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect())
    assert ids[104] == 1 and ids[None] == 1 and {100, 101} <= set(ids) and ids[5] <= 1


def test_token_ids_of_every_row(spark, docs):
    out = corpus_pipeline.token_ids(spark, docs, DATA).orderBy("start").collect()
    assert len(out) == len(rows()) and out[0].doc_id is None and out[0].start == 0
    assert {r.n_tokens for r in out if r.doc_id in (100, 101)} == {1}
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
    assert corpus_pipeline.token_ids(spark, spark.createDataFrame([], COLUMNS), DATA).count() == 0
