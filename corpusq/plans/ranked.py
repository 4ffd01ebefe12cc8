"""Queries: guards, lanes, cards, corpora, literature, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank, search, tag
from ..sources import adapters as A
from ..sources import store as S
from .base import Plan
from .pages import _WINDOWS_SQL, chunks
from .searched import _ASK_SQL, _BM25_SQL, _QUERIES_SQL, ask, text_index, text_queries

plan = Plan()

_HIT = f"{_WINDOWS_SQL}, docs0 AS (SELECT id, text FROM chunks0), {_QUERIES_SQL}, " + _BM25_SQL.replace("{k}", "40")


def _hits(spark, sf_dir, k=40):
    """Each query's k chunks with their texts, staged: k rows a query, which are looked at several times. What they are joined to is
    then known to be small, and the chunks are not moved."""
    ranked = S.written(search.bm25(text_index(spark, sf_dir, "chunks"), text_queries(spark, sf_dir), k), "ranked")
    return S.written(ranked.join(chunks(spark, sf_dir), "id").join(text_queries(spark, sf_dir).select("query_id", "query"), "query_id"), "hits")


REGIONS = {"north": ["the", "and"], "south": ["der", "und"], "west": ["les", "que"]}
LEVELS = {"l1": ["ing"], "l2": ["sch"], "l3": ["tion"]}
_TAGS = lambda c, lex: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for t in terms) + f" THEN '{tag}' END" for tag, terms in lex.items()) + "], lambda x: x IS NOT NULL)"


@plan.query(
    "figures_off_target",
    f"""WITH f AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS caption, substr(text, length(text) // 2 + 1) AS topic FROM documents), t AS (SELECT *, {_TAGS('caption', REGIONS)} AS ct, {_TAGS('topic', REGIONS)} AS tt, {_TAGS('caption', LEVELS)} AS cl, {_TAGS('topic', LEVELS)} AS tl FROM f)
    SELECT doc_id, CASE WHEN contains(caption, 'license') THEN 'nonanatomical' WHEN len(tt) > 0 AND len(ct) > 0 AND NOT list_has_any(ct, tt) THEN 'region' WHEN len(tl) > 0 AND len(cl) > 0 AND len(list_filter(tl, lambda x: NOT list_contains(cl, x))) > 0 THEN 'level' END AS reason FROM t""",
)
def figures_off_target(spark, sf_dir):
    f = A.table(spark, sf_dir, "documents").selectExpr("doc_id", "substr(text, 1, length(text) div 2) AS caption", "substr(text, length(text) div 2 + 1) AS topic")
    return f.select("doc_id", rank.off_target("topic", "caption", REGIONS, LEVELS, "license").alias("reason"))


@plan.query(
    "figures_collected",
    _HIT
    + """, h AS (SELECT t.query_id, t.id, t.rank, c.book, c.page, concat(c.book, '/', c.doc_id % 50, '.png') AS path, c.text AS caption FROM text0 t JOIN chunks0 c ON c.id = t.id),
    a AS (SELECT query_id, path, min(rank) AS rank, arg_min({'b': book, 'p': page, 'c': caption}, rank) AS m, 0 AS lane FROM h WHERE rank <= 20 GROUP BY ALL), b AS (SELECT query_id, path, min(r2) AS rank, arg_min({'b': book, 'p': page, 'c': caption}, r2) AS m, 1 AS lane FROM (SELECT *, 41 - rank AS r2 FROM h WHERE rank > 10) GROUP BY query_id, path),
    f AS (SELECT query_id, path, round(sum(1 / (60 + rank)), 9) AS score, arg_max(m, lane) AS m FROM (SELECT query_id, path, rank, m, lane FROM a UNION ALL SELECT query_id, path, rank, m, lane FROM b) GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM f WHERE NOT contains(m.c, '%%%') QUALIFY rank <= 6),
    p AS (SELECT query_id, book, page, min(rank) AS n FROM h WHERE rank <= 5 GROUP BY ALL),
    j AS (SELECT t.query_id, t.path, t.score, t.rank, t.m.b AS book, t.m.p AS page, n FROM t LEFT JOIN p ON p.query_id = t.query_id AND p.book = t.m.b AND p.page = t.m.p)
    SELECT query_id, path, score, rank, book, page, coalesce(n, 12 + row_number() OVER (PARTITION BY query_id, n IS NULL ORDER BY rank)) AS number FROM j""",
)
def figures_collected(spark, sf_dir):
    h = _hits(spark, sf_dir).selectExpr("query_id", "rank", "book", "page", "concat(book, '/', doc_id % 50, '.png') AS path", "text AS caption")
    lanes = [h.where("rank <= 20"), h.where("rank > 10").withColumn("rank", 41 - F.col("rank"))]
    passages = h.where("rank <= 5").select("query_id", "book", "page", F.col("rank").alias("n"))
    return rank.collect_figures(lanes, passages, ~F.contains("caption", F.lit("%%%")), 6, 12).drop("caption")


@plan.query("page_context", _WINDOWS_SQL + " SELECT book, page, md5(left(string_agg(text, ' ' ORDER BY i), 6000)) AS context_md5 FROM chunks0 GROUP BY book, page")
def page_context(spark, sf_dir):
    return rank.page_context(chunks(spark, sf_dir)).select("book", "page", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@plan.query(
    "round_robin",
    "WITH r AS (SELECT user_id AS case_id, event_id % 7 AS path, event_id % 5 + 1 AS rank, length(event_type) AS intent_ord FROM events), o AS (SELECT case_id, path, min(rank * 100 + intent_ord) AS k FROM r GROUP BY ALL) SELECT case_id, path, k // 100 AS rank, k % 100 AS intent_ord, row_number() OVER (PARTITION BY case_id ORDER BY k, path) AS place FROM o QUALIFY place <= 4",
)
def round_robin(spark, sf_dir):
    r = A.table(spark, sf_dir, "events").selectExpr("user_id AS case_id", "event_id % 7 AS path", "event_id % 5 + 1 AS rank", "length(event_type) AS intent_ord")
    return rank.round_robin(r, 4)


@plan.query("card_figures")
def card_figures(spark, sf_dir):
    """Each choice depends on those before; tested on small boards."""
    return rank.card_figures(A.table(spark, sf_dir, "events").selectExpr("concat('b', user_id) AS board", "event_id % 12 AS card_ord", "concat('p', event_id % 9) AS path", "event_id % 5 AS rank"))


_CARDS = "card_ord, CASE WHEN card_ord % 5 = 0 THEN 'same question' WHEN card_ord % 7 = 0 THEN '' ELSE question END AS question, CASE WHEN card_ord % 5 = 0 THEN 'same answer' WHEN card_ord % 7 = 0 THEN NULL ELSE answer END AS answer, CASE WHEN card_ord % 3 = 0 THEN array(concat('i', card_ord % 4), 'j') ELSE array() END AS images, array(deck) AS tags"


@plan.query(
    "cards_prepared",
    f"""WITH {A.CARDS_SQL}, c AS (SELECT {_CARDS.replace("array(concat('i', card_ord % 4), 'j')", "[concat('i', card_ord % 4), 'j']").replace('array(deck)', '[deck]').replace('array()', '[]')} FROM cards0),
    k AS (SELECT *, concat('card-', left(sha1(concat(question, chr(9247), coalesce(answer, ''), CASE WHEN question = '' AND coalesce(answer, '') = '' THEN concat(chr(9247), array_to_string(list_sort(images), '|')) ELSE '' END)), 16)) AS id FROM c WHERE question <> '' OR coalesce(answer, '') <> '' OR len(images) > 0),
    g AS (SELECT id, arg_min(question, card_ord) AS question, arg_min(answer, card_ord) AS answer, flatten(list(images ORDER BY card_ord)) AS im, flatten(list(tags ORDER BY card_ord)) AS tg, count(*) AS merged FROM k GROUP BY id)
    SELECT id, md5(question) AS q, md5(answer) AS a, list_filter(im, lambda x, i: list_position(im, x) = i) AS images, list_filter(tg, lambda x, i: list_position(tg, x) = i) AS tags, merged FROM g""",
)
def cards_prepared(spark, sf_dir):
    c = A.cards(spark, sf_dir).selectExpr(*A._split(_CARDS))
    return rank.prepared_cards(c).select("id", F.md5(F.col("question").cast("binary")).alias("q"), F.md5(F.col("answer").cast("binary")).alias("a"), "images", "tags", "merged")


_STOPS = "'" + "', '".join(["the", "and", "for", "with", "that", "this", "are", "must", "its", "into", "from", "their", "which", "may", "can", "not", "but", "all", "any", "per"]) + "'"


@plan.query(
    "cards_refined",
    _HIT
    + f""", h AS (SELECT t.query_id, t.id, t.score, concat(q.query, CASE WHEN t.query_id % 3 = 0 THEN ' C5-6' ELSE '' END) AS query, concat(c.text, CASE WHEN c.doc_id % 2 = 0 THEN ' level c5' WHEN c.doc_id % 5 = 0 THEN ' C5-C6' ELSE '' END) AS text, c.doc_id FROM text0 t JOIN chunks0 c ON c.id = t.id JOIN queries0 q ON q.query_id = t.query_id),
    k AS (SELECT *, round(score + 0.05 * len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOPS}))), regexp_extract_all(lower(text), '[a-z0-9]+'))), 6) AS s FROM h WHERE NOT (query_id % 3 = 0 AND doc_id % 2 = 0)),
    b AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS m FROM k)
    SELECT query_id, id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM b WHERE m <= 0 OR s >= 0.5 * m QUALIFY rank <= 5""",
)
def cards_refined(spark, sf_dir):
    h = _hits(spark, sf_dir).withColumn("query", F.concat("query", F.when(F.col("query_id") % 3 == 0, " C5-6").otherwise(""))).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 2 == 0, " level c5").when(F.col("doc_id") % 5 == 0, " C5-C6").otherwise("")))
    return rank.refined_cards(h.select("query_id", "id", "query", "text", "score"), 5, keep_ratio=0.5).select("query_id", "id", "score", "rank")


DOMAINS = {"a": ["the ", "tion"], "b": ["sch"], "c": ["eau", "ai"], "d": ["zzzz"]}


@plan.query("queries_routed", f"WITH {_QUERIES_SQL}, t AS (SELECT query_id, {_TAGS('query', DOMAINS)} AS f FROM queries0) SELECT query_id, unnest(CASE WHEN len(f) > 0 THEN f ELSE ['a', 'b', 'c', 'd'] END) AS source_db FROM t")
def queries_routed(spark, sf_dir):
    return rank.routed(text_queries(spark, sf_dir), DOMAINS).select("query_id", "source_db")


_POOL_SQL = (
    _HIT
    + """, h AS (SELECT t.query_id, t.id, t.score, c.chapter AS source_db, c.source AS work_id, CASE WHEN c.i = 0 THEN 'Abstract' WHEN c.i % 2 = 1 THEN 'results' ELSE 'other' END AS section FROM text0 t JOIN chunks0 c ON c.id = t.id),
    d AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_db ORDER BY score DESC, id) AS r FROM h QUALIFY r <= 10), x AS (SELECT * REPLACE (round(score * CASE lower(section) WHEN 'abstract' THEN 1.2 WHEN 'results' THEN 1.1 ELSE 1 END, 6) AS score) FROM d),
    w AS (SELECT *, row_number() OVER (PARTITION BY query_id, work_id ORDER BY score DESC, id) AS r2 FROM x QUALIFY r2 <= 2), pool0 AS (SELECT query_id, id, work_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w QUALIFY rank <= 6)"""
)


def _pooled(spark, sf_dir):
    h = _hits(spark, sf_dir).selectExpr("query_id", "id", "score", "chapter AS source_db", "source AS work_id", "CASE WHEN i = 0 THEN 'Abstract' WHEN i % 2 = 1 THEN 'results' ELSE 'other' END AS section")
    return rank.pooled(h, {"abstract": 1.2, "results": 1.1}, 10, 2, 6).select("query_id", "id", "work_id", "score", "rank")


@plan.query("corpus_pooled", _POOL_SQL + ", ids AS (SELECT source AS work_id, min(doc_id) FILTER (doc_id % 3 = 0) AS pmid, min(doc_id) FILTER (doc_id % 3 = 1) AS doi FROM documents GROUP BY source) SELECT p.*, CAST(pmid AS VARCHAR) AS pmid, CAST(doi AS VARCHAR) AS doi FROM pool0 p LEFT JOIN ids USING (work_id)")
def corpus_pooled(spark, sf_dir):
    ids = A.table(spark, sf_dir, "documents").selectExpr("source AS work_id", "CASE doc_id % 3 WHEN 0 THEN 'pmid' WHEN 1 THEN 'doi' ELSE 'x' END AS scheme", "CAST(doc_id AS STRING) AS value", "doc_id AS ord")
    return rank.with_identifiers(_pooled(spark, sf_dir), ids, ["pmid", "doi"])


_LIT = "user_id AS query_id, event_type AS axis, CAST(event_id % 20 + 1 AS INT) AS rank, event_id % 9 AS pmid, CAST(event_id % 9 % 4 + 1 AS INT) AS tier, CASE WHEN event_id % 9 <> 4 THEN CAST(2000 + event_id % 9 * 3 AS INT) END AS year"
_LIT_SQL = f"""WITH l AS (SELECT {_LIT} FROM events), o AS (SELECT query_id, pmid, arg_min({{'r': rank, 't': tier, 'y': year, 'a': axis}}, (rank, axis)) AS m FROM l GROUP BY ALL),
lit0 AS (SELECT query_id, pmid, m.r AS rank, m.t AS tier, m.y AS year, m.a AS axis, row_number() OVER (PARTITION BY query_id ORDER BY (m.r - 1) // 5, m.t, CASE WHEN 2020 - m.y <= 5 THEN 0 ELSE 1 END, m.y DESC NULLS LAST, pmid) AS place FROM o QUALIFY place <= 6)"""


def _literature(spark, sf_dir):
    return rank.literature(A.table(spark, sf_dir, "events").selectExpr(*A._split(_LIT)), 2020, 6)


@plan.query("literature_ranked", _LIT_SQL + " SELECT * FROM lit0")
def literature_ranked(spark, sf_dir):
    return _literature(spark, sf_dir)


@plan.query("literature_floor", _LIT_SQL + ", g AS (SELECT *, bool_or(tier <= 1) OVER (PARTITION BY query_id) AS g FROM (SELECT query_id, pmid, place, tier - 1 AS tier FROM lit0)), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS p FROM (SELECT query_id, pmid, place, tier + 1 AS tier, bool_or(tier + 1 <= 2) OVER (PARTITION BY query_id) AS good FROM g) WHERE NOT good OR tier <= 2) SELECT query_id, pmid, place, CASE WHEN NOT good THEN 'no strong evidence found' END AS note FROM p WHERE p <= CASE WHEN good THEN 3 ELSE 1 END")
def literature_floor(spark, sf_dir):
    return rank.quality_floor(_literature(spark, sf_dir), 3).select("query_id", "pmid", "place", "note")


@plan.query("literature_topical", _LIT_SQL + ", c AS (SELECT *, CASE WHEN query_id % 4 = 0 THEN true ELSE contains(axis, 'e') AND (contains(axis, 'r') OR query_id % 4 = 1) END AS ok FROM lit0), a AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok, row_number() OVER (PARTITION BY query_id ORDER BY place) AS p FROM c) SELECT query_id, pmid, place FROM a WHERE ok OR (NOT any_ok AND p = 1)")
def literature_topical(spark, sf_dir):
    concepts = F.when(F.col("query_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("query_id") % 4 == 1, F.array(F.lit("E"))).otherwise(F.array(F.lit("er"), F.lit("re")))
    # an axis with an e and an r: "error", "purchase" has "r" and "e" apart, so the text spells them together
    spelled = F.when(F.contains("axis", F.lit("e")) & F.contains("axis", F.lit("r")), F.concat("axis", F.lit(" er"))).otherwise(F.col("axis"))
    return rank.topical(_literature(spark, sf_dir).withColumn("concepts", concepts).withColumn("text", spelled)).select("query_id", "pmid", "place")


@plan.query("record_fields", "WITH r AS (SELECT event_id AS pmid, CASE WHEN event_id % 2 = 0 THEN concat('doi: 10.1/', event_id) ELSE concat('x', event_id) END AS d, user_id % 5 AS n, CASE WHEN event_id % 4 > 0 THEN concat('abstract ', event_id) ELSE ' ' END AS abstract FROM events) SELECT pmid, CASE WHEN pmid % 2 = 0 THEN concat('10.1/', pmid) END AS doi, CASE WHEN n <= 3 THEN array_to_string(list_transform(range(0, n), lambda i: concat('A', i)), ', ') ELSE 'A0 et al.' END AS authors, CAST(CASE WHEN pmid % 3 = 0 THEN 1990 + pmid % 30 END AS INT) AS year, concat('pmid:', pmid) AS url FROM r WHERE trim(abstract) <> ''")
def record_fields(spark, sf_dir):
    r = A.table(spark, sf_dir, "events").selectExpr("event_id AS pmid", "CASE WHEN event_id % 2 = 0 THEN concat('doi: 10.1/', event_id) ELSE concat('x', event_id) END AS doi", "CASE WHEN user_id % 5 = 0 THEN cast(array() as array<string>) ELSE transform(sequence(0L, user_id % 5 - 1), i -> concat('A', i)) END AS authors", "CASE WHEN event_id % 3 = 0 THEN concat('Spring ', 1990 + event_id % 30, ' issue') ELSE 'n.d.' END AS year_text", "CASE WHEN event_id % 4 > 0 THEN concat('abstract ', event_id) ELSE ' ' END AS abstract")
    return rank.record_fields(r).select("pmid", "doi", "authors", "year", "url")


@plan.query(
    "evidence_pool",
    _HIT + ", h AS (SELECT t.query_id % 8 AS case_id, t.query_id AS intent_ord, t.rank, concat(c.book, ' p. ', c.page) AS citation, c.text FROM text0 t JOIN chunks0 c ON c.id = t.id), o AS (SELECT case_id, citation, arg_min({'i': intent_ord, 'r': rank, 't': text}, (intent_ord, rank)) AS m FROM h GROUP BY ALL) SELECT case_id, citation, m.i AS intent_ord, m.r AS rank, concat('T', row_number() OVER (PARTITION BY case_id ORDER BY m.i, m.r, citation)) AS ref, left(trim(regexp_replace(m.t, '\\s+', ' ', 'g')), 600) AS excerpt FROM o",
)
def evidence_pool(spark, sf_dir):
    h = _hits(spark, sf_dir).selectExpr("query_id % 8 AS case_id", "query_id AS intent_ord", "rank", "concat(book, ' p. ', page) AS citation", "text")
    return rank.evidence_pool(h)


@plan.query(
    "prompts_packed",
    _HIT + ", p AS (SELECT t.query_id, t.rank AS n, c.book, CAST(c.page AS VARCHAR) AS page, c.text FROM text0 t JOIN chunks0 c ON c.id = t.id WHERE t.rank <= 5) SELECT query_id, md5(concat('Sources', chr(10), string_agg(concat('[', n, '] ', book, ' p. ', page, chr(10), text), chr(10) || chr(10) ORDER BY n))) AS context_md5, count(*) AS n_sources FROM p GROUP BY query_id",
)
def prompts_packed(spark, sf_dir):
    cited = rank.citations(_hits(spark, sf_dir).where("rank <= 5").withColumn("printed_page", F.lit(None).cast("string")))
    return rank.packed(cited).select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), "n_sources")


@plan.query(
    "gap_audit",
    _HIT + ", t AS (SELECT query_id AS topic, query_id % 5 + 1 AS consequence, query_id % 3 + 1 AS frequency FROM queries0), b AS (SELECT query_id AS topic, max(score) AS top_score FROM text0 GROUP BY ALL), n AS (SELECT topic, top_score, count(*) FILTER (score >= 0.6 * top_score) AS n_strong FROM text0 JOIN b ON topic = query_id GROUP BY ALL) SELECT t.topic, consequence, frequency, coalesce(top_score, 0) AS top_score, coalesce(n_strong, 0) AS n_strong, CASE WHEN coalesce(top_score, 0) >= 20 AND coalesce(n_strong, 0) >= 2 THEN 'covered' WHEN coalesce(top_score, 0) >= 10 THEN 'weak' ELSE 'absent' END AS status, consequence * frequency AS priority FROM t LEFT JOIN n USING (topic)",
)
def gap_audit(spark, sf_dir):
    topics = text_queries(spark, sf_dir).selectExpr("query_id AS topic", "query_id % 5 + 1 AS consequence", "query_id % 3 + 1 AS frequency")
    scored = S.written(search.bm25(text_index(spark, sf_dir, "chunks"), text_queries(spark, sf_dir), 40).select(F.col("query_id").alias("topic"), "score"), "ranked")
    return rank.gap_audit(scored, topics, 20.0, 10.0)


@plan.query("evidence_rows", _ASK_SQL + " SELECT a.query_id, a.id, concat(d.source, ' p. ', d.doc_id) AS citation, CASE WHEN d.doc_id % 2 = 0 THEN concat('f', d.doc_id) END AS figure_path FROM ask0 a JOIN documents d ON d.doc_id = a.id WHERE d.doc_id % 7 > 0")
def evidence_rows(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "source AS book", "CASE WHEN doc_id % 7 > 0 THEN doc_id END AS page", "concat('f', doc_id) AS figure_path", "CAST(NULL AS STRING) AS printed_page")
    assets = A.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").selectExpr("concat('f', doc_id) AS figure_path")
    return rank.evidence_rows(ask(spark, sf_dir).join(d, "id"), assets).select("query_id", "id", "citation", "figure_path")


@plan.query("levels_named", "WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'at C5-6 and L4' WHEN 1 THEN 'T12 - L1 fused' WHEN 2 THEN 'S1; c7' WHEN 3 THEN 'none' WHEN 4 THEN 'L4–5' ELSE 'C5, C5' END AS t FROM events) SELECT event_id, CASE event_id % 6 WHEN 0 THEN ['c5', 'c6', 'l4'] WHEN 1 THEN ['l1', 't12'] WHEN 2 THEN ['c7', 's1'] WHEN 3 THEN []::VARCHAR[] WHEN 4 THEN ['l4', 'l5'] ELSE ['c5'] END AS levels FROM t")
def levels_named(spark, sf_dir):
    t = A.table(spark, sf_dir, "events").selectExpr("event_id", "CASE event_id % 6 WHEN 0 THEN 'at C5-6 and L4' WHEN 1 THEN 'T12 - L1 fused' WHEN 2 THEN 'S1; c7' WHEN 3 THEN 'none' WHEN 4 THEN 'L4–5' ELSE 'C5, C5' END AS t")
    return t.select("event_id", tag.levels("t").alias("levels"))
