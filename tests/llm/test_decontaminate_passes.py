"""Decontamination by a benchmark of several parts: the same rows as in one pass, and passes that write no texts."""

from corpusq.llm import common, decontaminate


def test_passes_write_hits_only(spark, monkeypatch):
    texts = ["aa bb cc dd", "ee ff gg hh ii", "nothing here", None, "aa bb cc dd ee ff gg hh", "nothing here", ""]
    # repeated rows, no ids, and names that the search uses itself
    docs = spark.createDataFrame([(k % 4 if k else None, t, k, k) for k, t in enumerate(texts)], "doc_id long, text string, _row int, _found int")
    items = spark.createDataFrame([(1, "aa bb cc"), (2, "gg hh"), (3, "zz"), (4, "cc dd"), (5, "ee ff")], "item_id long, text string")
    staged = []
    real = common.stage

    def stage(df, name):
        out = real(df, name)
        staged.append((name, out))
        return out

    monkeypatch.setattr(decontaminate, "stage", stage)
    one = decontaminate.search(docs, items, "hit", 2)
    assert not staged
    parts = decontaminate.search(docs, items, "hit", 2, part_bytes=8)
    assert parts.columns == one.columns == [*docs.columns, "hit"]
    assert sorted(map(str, parts.collect())) == sorted(map(str, one.collect()))
    names = [n for n, _ in staged]
    assert names.count("decontaminate") == 1 and names.count("words") == 1 and names.count("hits") >= 2
    for name, out in staged:
        if name in ("words", "hits"):
            assert out.columns == ["_row", "n_words", "spans", "items"]
        if name == "hits":
            assert out.count() <= 3 and all(r.spans for r in out.collect())
    kept = decontaminate.clean(docs.where("false"), items, 2)
    assert kept.columns == docs.columns and kept.count() == 0
