"""Full-text and vector search, rank fusion, and filters on ranked lists. A ranked list has query_id, id, rank (from 1)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import pivots, textindex
from .pivots import distance, dot, norm

K1, B = 1.2, 0.75
FUSION = 60


def top(scored: DataFrame, k: int, by: str = "query_id", ties: str = "id", score: str = "score") -> DataFrame:
    """The k best rows of each query, with rank. Spark cuts to k in each task before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), ties))).where(F.col("rank") <= k)


# --- full text --------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, stop: list[str] = T.STOP) -> DataFrame:
    """R3. (id, text) to (term, id, tf, length): the inverted index, one row for a term of a document."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z][a-z0-9-]{2,})"))
    terms = docs.select("id", F.filter(found, lambda t: ~t.isin(stop)).alias("terms")).withColumn("length", F.size("terms"))
    return terms.select("id", "length", F.explode("terms").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, stop: list[str] = T.STOP, most: int = 14) -> DataFrame:
    """R5. (query_id, query) to (query_id, term)."""
    return queries.select("query_id", F.explode(T.fulltext_terms("query", stop, most)).alias("term"))


def bm25(docs: DataFrame | textindex.Index, queries: DataFrame, k: int = 10, stop: list[str] = T.STOP) -> DataFrame:
    """R4. Top k of each query by BM25: k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); any term may match.
    From an index, see textindex. From documents (id, text), only postings of asked terms are kept before any shuffle. Texts
    are never carried along."""
    terms = query_terms(queries, stop)
    if isinstance(docs, textindex.Index):
        return textindex.bm25(docs, terms, k, K1, B)
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z][a-z0-9-]{2,})"))
    sized = docs.select("id", F.filter(found, lambda t: ~t.isin(stop)).alias("terms")).withColumn("length", F.size("terms"))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    tf = sized.select("id", "length", F.explode("terms").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))
    hits = tf.join(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").crossJoin(totals).join(terms, "term")
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return top(hits.withColumn("w", weight).groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score")), k)


def all_terms(docs: DataFrame | textindex.Index, queries: DataFrame, k: int = 10, most: int = 6, stop: list[str] = T.STOP) -> DataFrame:
    """R6. Documents that have all of a query's first terms, by the number of their occurrences."""
    terms = query_terms(queries, stop, most)
    need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    if isinstance(docs, textindex.Index):
        hits = textindex.all_terms(docs, terms, need)
    else:
        hits = postings(docs, stop).join(terms, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("have"), F.sum("tf").alias("score"))
    return top(hits.join(need, "query_id").where("have = need").select("query_id", "id", "score"), k)


# --- vectors ----------------------------------------------------------------------------------------------------------


def normalised(v) -> Column:
    """R2. A vector over its length; a zero vector stays."""
    n = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / n)


#: Bytes of query vectors that may be sent to every task; more queries are searched in several parts.
MOST_QUERY_BYTES = 64 << 20
#: Up to so many pairs are simply scored; beyond, pivots rule most of them out. The rows are the same.
FEW_PAIRS = 4_000_000


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, measure: str = "l2", few_pairs: int = FEW_PAIRS) -> DataFrame:
    """R1, R13. (id, vector) and (query_id, qvector): each query's k nearest, by distance or by cosine; vectors that are null
    or of another size are skipped. Queries go to the vectors in parts of a checked size, and each task keeps k."""
    size = queries.agg(F.count(F.lit(1)), F.max(F.size("qvector"))).first()
    parts = max(1, math.ceil((size[0] or 0) * (size[1] or 0) * 8 / MOST_QUERY_BYTES))
    whole = (size[0] or 0) * vectors.select("id").count() <= few_pairs
    ringed = vectors.where("vector is not null") if whole else pivots.ringed(vectors, measure)

    def part(i):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else queries
        if not whole:
            return pivots.knn(ringed, own, k, measure)
        return pivots.scanned(ringed.select("id", "vector"), pivots.asked(own), own, k, measure)

    return reduce(DataFrame.unionByName, [part(i) for i in range(parts)])


# --- fusion and filters -----------------------------------------------------------------------------------------------


def fuse(*lanes: DataFrame, k: int | None = None, c: int = FUSION) -> DataFrame:
    """R7. Reciprocal rank fusion: each lane adds 1 / (c + rank); ties by first lane, then rank there, then id."""
    each = [lane.select("query_id", "id", F.lit(i).alias("lane"), "rank") for i, lane in enumerate(lanes)]
    fused = reduce(DataFrame.unionByName, each).groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(c) + F.col("rank"))), 9).alias("score"), F.min(F.struct("lane", "rank")).alias("first"))
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "first", "id"))).drop("first")
    return ranked.where(F.col("rank") <= k) if k else ranked


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 40, measure: str = "l2", index: textindex.Index | None = None) -> DataFrame:
    """R8. k nearest by vector and k by text, fused; the payload is joined on at the end, by id."""
    lanes = knn(vectors, queries.select("query_id", "qvector"), k, measure), bm25(index or docs, queries.select("query_id", "query"), k)
    return fuse(*lanes, k=k).join(docs, "id")


def lexical_score(query, text) -> Column:
    """Share of a query's content tokens that a text has."""
    q = T.content_tokens(query)
    return F.round(F.coalesce(F.size(F.array_intersect(q, T.content_tokens(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)), 6)


def rerank(ranked: DataFrame, score: Column, k: int) -> DataFrame:
    """R9. The list in order of a pair score (a column over the list's query and text), cut to k."""
    return top(ranked.drop("rank", "score").withColumn("score", score), k)


def sink(ranked: DataFrame, off_domain: Column, k: int) -> DataFrame:
    """R10. Rows off the domain come after all others, in their order, and the list is cut to k."""
    return ranked.withColumn("off", F.coalesce(off_domain, F.lit(False))).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("off", "rank", "id"))).where(F.col("rank") <= k)


def ask(docs: DataFrame, vectors: DataFrame, queries: DataFrame, off_domain: Column, k: int = 40, rerank_k: int = 12, index: textindex.Index | None = None) -> DataFrame:
    """R11. Hybrid search, reranking, off-domain rows last, one job for all queries."""
    found = hybrid(docs, vectors, queries, k, index=index).join(queries.select("query_id", "query"), "query_id")
    return sink(rerank(found, lexical_score("query", "text"), k), off_domain, rerank_k)


def caption_search(figures: DataFrame, queries: DataFrame, k: int = 8, vignette: str = r"(?i)\bvignette\b", flowchart: str = r"(?i)algorithm|flow-? ?chart|decision tree") -> DataFrame:
    """R12. (id, caption) by tf times ln((N + 1) / (df + 1)) over at least two matched terms; vignettes and flowcharts less."""
    toks = F.filter(T.tokens("caption"), lambda t: F.length(t) > 2)
    rows = figures.select("id", F.explode(toks).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = figures.agg(F.count(F.lit(1)).alias("n"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.filter(T.tokens("query"), lambda t: F.length(t) > 2))).alias("term"))
    hits = rows.join(asked, "term").join(df, "term").crossJoin(n).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("matched"), F.sum(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("s")).where("matched >= 2")
    penal = F.when(F.col("caption").rlike(vignette), 0.4).otherwise(1.0) * F.when(F.col("caption").rlike(flowchart), 0.35).otherwise(1.0)
    scored = hits.join(figures.select("id", "caption"), "id").withColumn("score", F.round(F.col("s") * penal, 6)).where("score > 0")
    return top(scored.select("query_id", "id", "score"), k)


def expanded(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """R15. (query_id, term) with the synonyms of each term: (term, synonym)."""
    more = queries.join(synonyms, "term").select("query_id", F.col("synonym").alias("term"))
    return queries.select("query_id", "term").unionByName(more).distinct()
