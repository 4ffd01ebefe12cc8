"""Queries: full-text and vector search, fusion, reranking."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, search, textindex
from ..sources import adapters as A
from ..sources import store as S
from .base import Plan
from .pages import _WINDOWS_SQL, CHUNKS, chunks

plan = Plan()

_STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)
_TERMS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z][a-z0-9-]{{2,}}'), lambda t: t NOT IN (" + _STOP_SQL + "))"
#: Queries are the benchmark's passages; what a hit holds is a passage's first 8 words.
_QUERIES_SQL = "queries0 AS (SELECT item_id AS query_id, text AS query, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:8], ' ') AS needle FROM benchmark)"
_BM25_SQL = (
    "terms0 AS (SELECT query_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:14]) AS term FROM (SELECT query_id, " + _TERMS.format("query") + " AS l FROM queries0)), "
    "d0 AS (SELECT id, " + _TERMS.format("text") + " AS t FROM docs0), n0 AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d0), "
    "tf0 AS (SELECT term, id, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d0) WHERE term IN (SELECT term FROM terms0) GROUP BY ALL), "
    "df0 AS (SELECT term, count(*) AS df FROM tf0 GROUP BY term), "
    "bm0 AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf0 JOIN df0 USING (term) JOIN terms0 USING (term), n0 GROUP BY query_id, id), "
    "text0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm0 QUALIFY rank <= {k})"
)


def text_queries(spark, sf_dir):
    """query_id, query (a whole passage) and needle (its first 8 words)."""
    return A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array_join(F.slice(T.words("text"), 1, 8), " ").alias("needle"))


def text_index(spark, sf_dir, kind: str) -> textindex.Index:
    """The index of the chunks or of the documents of a folder, in the shared folder. Books are runs of documents; those whose
    documents' content has changed since the index was written are indexed again, the others stay as they are."""
    d = A.table(spark, sf_dir, "documents").withColumn("book", A.book())
    if kind == "chunks":
        rows = lambda keys: chunks(spark, sf_dir).select("id", F.col("book").alias("key"), "text").join(keys, "key", "left_semi")
    else:
        rows = lambda keys: d.select(F.col("doc_id").alias("id"), F.col("book").alias("key"), "text").join(keys, "key", "left_semi")
    path = f"{S.shared_dir(spark)}/corpusq/index-{kind}-{hashlib.sha1(sf_dir.rstrip('/').encode()).hexdigest()}"
    return textindex.refresh(spark, path, S.digest(d, "book", *A.COLUMNS), rows, f"{kind}:{CHUNKS}")


@plan.query("fulltext_topk", f"{_WINDOWS_SQL}, docs0 AS (SELECT id, text FROM chunks0), {_QUERIES_SQL}, {_BM25_SQL.replace("{k}", "10")} SELECT query_id, id, score, rank FROM text0")
def fulltext_topk(spark, sf_dir):
    return search.bm25(text_index(spark, sf_dir, "chunks"), text_queries(spark, sf_dir), 10)


@plan.query("postings", f"{_WINDOWS_SQL}, d AS (SELECT id, {_TERMS.format('text')} AS t FROM chunks0), p AS (SELECT id, len(t) AS length, unnest(t) AS term FROM d) SELECT id, length, term, count(*) AS tf FROM p GROUP BY ALL")
def postings(spark, sf_dir):
    return search.postings(chunks(spark, sf_dir).select("id", "text"))


@plan.query(
    "all_terms",
    f"""{_WINDOWS_SQL}, {_QUERIES_SQL}, t AS (SELECT query_id, unnest(list_distinct({_TERMS.format("query")})[1:3]) AS term FROM (SELECT * FROM queries0)),
    o AS (SELECT query_id, unnest(o3) AS term FROM (SELECT query_id, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL)[1:3] AS o3 FROM (SELECT query_id, {_TERMS.format("query")} AS l FROM queries0))),
    p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TERMS.format("text")}) AS term FROM chunks0) GROUP BY ALL),
    h AS (SELECT query_id, id, count(*) AS have, sum(tf) AS score FROM p JOIN o USING (term) GROUP BY ALL), n AS (SELECT query_id, count(*) AS need FROM o GROUP BY ALL)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h JOIN n USING (query_id) WHERE have = need QUALIFY rank <= 10""",
)
def all_terms(spark, sf_dir):
    return search.all_terms(text_index(spark, sf_dir, "chunks"), text_queries(spark, sf_dir), 10, most=3)


_VECTORS_SQL = "v0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q0 AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label FROM embeddings WHERE vec_id % 100 = 0)"


def vectors(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, sf_dir):
    """The stated queries: every hundredth vector."""
    return A.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvector"), F.col("label").alias("wanted"))


@plan.query("knn_l2", f"WITH {_VECTORS_SQL}, s AS (SELECT query_id, id, round(-list_distance(v, q), 6) AS score FROM v0, q0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10")
def knn_l2(spark, sf_dir):
    return search.knn(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10)


@plan.query("knn_pruned", plan.sql["knn_l2"])
def knn_pruned(spark, sf_dir):
    """The same, with pairs ruled out by pivots at any size."""
    return search.knn(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, few_pairs=0)


@plan.query("knn_cosine", f"WITH {_VECTORS_SQL}, s AS (SELECT query_id, id, round(list_cosine_similarity(v, q), 6) AS score FROM v0, q0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10")
def knn_cosine(spark, sf_dir):
    return search.knn(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, "cosine")


@plan.query("knn_cosine_pruned", plan.sql["knn_cosine"])
def knn_cosine_pruned(spark, sf_dir):
    return search.knn(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, "cosine", few_pairs=0)


@plan.query("normalised", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), n AS (SELECT *, list_transform(v, lambda x: x * (label + 1) / sqrt(list_inner_product(list_transform(v, lambda y: y * (label + 1)), list_transform(v, lambda y: y * (label + 1))))) AS u FROM e) SELECT vec_id, round(list_sum(u), 5) AS total, round(list_inner_product(u, u), 5) AS square FROM n")
def normalised(spark, sf_dir):
    v = A.table(spark, sf_dir, "embeddings").select("vec_id", search.normalised(F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))).alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(search.dot("u", "u"), 5).alias("square"))


# Documents with vectors: the vector of the document's number. Queries have the text and the vector of the passage's number.
_HYBRID_SQL = (
    f"WITH docs0 AS (SELECT doc_id AS id, text FROM documents), {_QUERIES_SQL}, {_BM25_SQL.replace("{k}", "40")}, "
    "s0 AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(-list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings v), "
    "vec0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s0 QUALIFY rank <= 40), "
    "lanes0 AS (SELECT query_id, id, 0 AS lane, rank FROM vec0 UNION ALL SELECT query_id, id, 1, rank FROM text0), "
    "f0 AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score, min(lane * 1000 + rank) AS first FROM lanes0 GROUP BY ALL), "
    "fused0 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f0 QUALIFY rank <= 40)"
)


def hybrid_inputs(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    q = text_queries(spark, sf_dir).join(A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvector")), "query_id")
    return docs, vectors(spark, sf_dir).select("id", "vector"), q


@plan.query("hybrid_search", _HYBRID_SQL + " SELECT query_id, id, score, rank, length(text) AS chars FROM fused0 JOIN docs0 USING (id)")
def hybrid_search(spark, sf_dir):
    return search.hybrid(*hybrid_inputs(spark, sf_dir), index=text_index(spark, sf_dir, "documents")).select("query_id", "id", "score", "rank", F.length("text").alias("chars"))


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN (" + _STOP_SQL + ")))"
_ASK_SQL = (
    _HYBRID_SQL
    + f", rr0 AS (SELECT f.query_id, f.id, lang, round(coalesce(len(list_intersect({_CONTENT.format('query')}, {_CONTENT.format('d.text')})) / nullif(len({_CONTENT.format('query')}), 0), 0), 6) AS score FROM fused0 f JOIN documents d ON d.doc_id = f.id JOIN queries0 USING (query_id)), "
    "rk0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM rr0), "
    "ask0 AS (SELECT query_id, id, score, lang <> 'en' AS off, row_number() OVER (PARTITION BY query_id ORDER BY lang <> 'en', r, id) AS rank FROM rk0 QUALIFY rank <= 12)"
)


@plan.query("ask", _ASK_SQL + " SELECT * FROM ask0")
def ask(spark, sf_dir):
    docs, v, q = hybrid_inputs(spark, sf_dir)
    return search.ask(docs, v, q, F.col("lang") != "en", index=text_index(spark, sf_dir, "documents")).select("query_id", "id", "score", "off", "rank")


@plan.query(
    "recall_mrr",
    f"""{_WINDOWS_SQL}, docs0 AS (SELECT id, text FROM chunks0), {_QUERIES_SQL}, {_BM25_SQL.replace("{k}", "40")},
    h AS (SELECT query_id, min(rank) FILTER (contains(lower(text), lower(needle))) AS hit FROM text0 JOIN docs0 USING (id) JOIN queries0 USING (query_id) GROUP BY query_id),
    a AS (SELECT hit FROM queries0 LEFT JOIN h USING (query_id))
    SELECT count(*) AS queries, round(avg((coalesce(hit, 99) <= 12)::INT), 4) AS recall_12, round(avg((coalesce(hit, 99) <= 40)::INT), 4) AS recall_40, round(avg(coalesce(1 / hit, 0)), 4) AS mrr FROM a""",
)
def recall_mrr(spark, sf_dir):
    c, q = chunks(spark, sf_dir).select("id", "text"), text_queries(spark, sf_dir)
    ranked = search.bm25(text_index(spark, sf_dir, "chunks"), q, 40).join(c, "id")
    return evaluate.recall(evaluate.first_hits(ranked, q.select("query_id", F.array("needle").alias("any_of"))), [12, 40])


@plan.query(
    "caption_search",
    f"""WITH f AS (SELECT doc_id AS id, text AS caption FROM documents), {_QUERIES_SQL},
    r AS (SELECT id, t AS term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(caption), '[a-z0-9]+')) AS t FROM f) WHERE length(t) > 2 GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM r GROUP BY ALL),
    q AS (SELECT DISTINCT query_id, t AS term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS t FROM queries0) WHERE length(t) > 2),
    s AS (SELECT query_id, id, count(*) AS m, sum(tf * ln(((SELECT count(*) FROM f) + 1) / (df + 1))) AS s FROM r JOIN q USING (term) JOIN df USING (term) GROUP BY ALL HAVING count(*) >= 2),
    p AS (SELECT query_id, id, round(s * CASE WHEN regexp_matches(caption, 'loweient') THEN 0.4 ELSE 1 END * CASE WHEN regexp_matches(lower(caption), 'the') THEN 0.35 ELSE 1 END, 6) AS score FROM s JOIN f USING (id))
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p WHERE score > 0 QUALIFY rank <= 8""",
)
def caption_search(spark, sf_dir):
    f = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS caption")
    return search.caption_search(f, text_queries(spark, sf_dir), 8, vignette="loweient", flowchart="(?i)the")


@plan.query(
    "lanes_fused",
    f"""WITH {_VECTORS_SQL}, s AS (SELECT query_id, id, round(-list_distance(v, q), 6) AS l2, round(list_cosine_similarity(v, q), 6) AS c FROM v0, q0),
    a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY l2 DESC, id) AS rank FROM s QUALIFY rank <= 10), b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id DESC) AS rank FROM s QUALIFY rank <= 10),
    f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score, min(lane * 1000 + rank) AS first FROM (SELECT *, 0 AS lane FROM b UNION ALL SELECT *, 1 FROM a) GROUP BY ALL)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f QUALIFY rank <= 8""",
)
def lanes_fused(spark, sf_dir):
    v, q = vectors(spark, sf_dir), vector_queries(spark, sf_dir)
    cosine = search.knn(v.withColumn("id", -F.col("id")), q, 10, "cosine").withColumn("id", -F.col("id"))
    return search.fuse(cosine, search.knn(v, q, 10), k=8)


@plan.query(
    "terms_expanded",
    f"""WITH {_QUERIES_SQL}, t AS (SELECT DISTINCT query_id, t AS term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS t FROM queries0)), syn AS (SELECT DISTINCT t AS term, reverse(t) AS synonym FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark) WHERE length(t) = 5)
    SELECT query_id, term FROM t UNION SELECT query_id, synonym FROM t JOIN syn USING (term)""",
)
def terms_expanded(spark, sf_dir):
    q = text_queries(spark, sf_dir).select("query_id", F.explode(F.array_distinct(T.tokens("query"))).alias("term"))
    words = A.table(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text")).alias("term")).where("length(term) = 5").distinct()
    return search.expanded(q, words.withColumn("synonym", F.reverse("term")))
