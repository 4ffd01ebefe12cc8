"""A search over the index stages what it asks for once, so that postings are not moved for each query; results stay those of all texts."""

from corpusq.operators import search, textindex
from corpusq.sources import store


def test_asked_terms_are_staged_once(spark, monkeypatch, tmp_path):
    names, written = [], store.written
    monkeypatch.setattr(store, "written", lambda df, name="step": names.append(name) or written(df, name))
    monkeypatch.setattr(textindex, "RANGE", 4)
    docs = spark.createDataFrame([(f"d{i}", f"b{i % 3}", f"common word{i % 7} other{i % 5}") for i in range(90)], "id string, key string, text string")
    q = spark.createDataFrame([(1, "common word3"), (2, "other1 word2 missing")], "query_id long, query string")
    index = textindex.refresh(spark, str(tmp_path / "i"), store.digest(docs, "key", "id", "text"), lambda keys: docs.join(keys, "key", "left_semi"))
    got = sorted(map(tuple, search.bm25(index, q, 5).select("query_id", "id", "score", "rank").collect()))
    assert got == sorted(map(tuple, search.bm25(docs, q, 5).select("query_id", "id", "score", "rank").collect()))
    assert names == ["asked"]
