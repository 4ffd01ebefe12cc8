"""Queries: build sets, resumption, merges, fingerprints, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, purge
from ..sources import adapters as A
from ..sources import store as S
from ..sources.versions import Versions
from .base import Plan
from .pages import _WINDOWS_SQL, chunks

plan = Plan()

CHUNK_COLUMNS = ["book", "page", "chapter", "i", "id", "text"]


@plan.query("new_books", f"WITH {A.PAGES_SQL} SELECT book, count(*) AS pages FROM pages0 WHERE book NOT IN (SELECT DISTINCT book FROM pages0 WHERE source = 'src1' AND book = 'b0') GROUP BY book")
def new_books(spark, sf_dir):
    p = A.pages(spark, sf_dir)
    return S.build_set(p, p.where("source = 'src1' and book = 'b0'"), new_only=True)[0].groupBy("book").agg(F.count(F.lit(1)).alias("pages"))


@plan.query("figure_rows", f"WITH {A.PAGES_SQL} SELECT book, page, CAST(k AS INT) AS ord, concat('a/b', doc_id, '.', k, '.png') AS figure_path, concat(book, '::b', doc_id, '.', k) AS id FROM pages0, (SELECT unnest(range(0, 2)) AS k) WHERE has_figure")
def figure_rows(spark, sf_dir):
    p = A.pages(spark, sf_dir).where("has_figure").withColumn("figures", F.expr("transform(sequence(0, 1), k -> named_struct('figure_path', concat('a/b', doc_id, '.', k, '.png'), 'caption', 'c'))"))
    return S.figure_rows(p).drop("caption")


@plan.query("figures_first_seen", _WINDOWS_SQL + " SELECT book, concat('f', doc_id % 60) AS figure_path, min(page) AS page FROM chunks0 WHERE doc_id % 4 > 0 GROUP BY ALL")
def figures_first_seen(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("figure_path", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("f"), (F.col("doc_id") % 60).cast("string"))))
    return S.distinct_figures(c)


@plan.query("undone", "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def undone(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return S.undone(e, e.where("event_type = 'view'"), "event_id").select("event_id", "user_id")


@plan.query("manifest_range", "WITH m AS (SELECT max(o_orderkey) AS m FROM orders), r AS (SELECT min(o_orderkey) FILTER (o_orderkey * 10 >= m) AS a, max(o_orderkey) FILTER (o_orderkey * 10 <= 9 * m) AS z FROM orders, m) SELECT o_orderkey AS id FROM orders, r WHERE o_orderkey BETWEEN a AND z AND o_custkey % 3 > 0")
def manifest_range(spark, sf_dir):
    m = A.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey AS ord", "o_custkey % 3 > 0 AS enabled")
    last = m.agg(F.max("id")).first()[0]  # from a tenth of the ids on, to nine tenths
    a, z = m.agg(F.min(F.when(F.col("id") * 10 >= last, F.col("id"))), F.max(F.when(F.col("id") * 10 <= 9 * last, F.col("id")))).first()
    return S.id_range(m, a, z).select("id")


@plan.query(
    "captions_applied",
    "WITH f AS (SELECT DISTINCT user_id AS id, concat('own ', user_id) AS caption FROM events), c AS (SELECT user_id AS id, event_id AS line, CASE WHEN event_id % 3 = 0 THEN concat('cap ', event_id) ELSE ' ' END AS caption FROM events WHERE user_id % 2 = 0), l AS (SELECT id, arg_max(caption, line) AS new FROM c WHERE trim(caption) <> '' GROUP BY id) SELECT f.id, coalesce(new, caption) AS caption, CASE WHEN new IS NOT NULL THEN 'captioned' ELSE 'kept' END AS status FROM f LEFT JOIN l USING (id)",
)
def captions_applied(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    f = e.selectExpr("user_id AS id", "concat('own ', user_id) AS caption").distinct()
    return S.captions_applied(f, e.where("user_id % 2 = 0").selectExpr("user_id AS id", "event_id AS line", "CASE WHEN event_id % 3 = 0 THEN concat('cap ', event_id) ELSE ' ' END AS caption"))


@plan.query("caption_candidates", "SELECT event_id, event_type AS book FROM events WHERE event_id % 2 = 0 AND (contains(event_type, 'e') OR contains(event_type, 'c')) AND NOT contains(event_type, 'pur')")
def caption_candidates(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS book", "concat('f', event_id) AS figure_path")
    return S.caption_candidates(e, e.where("event_id % 2 = 0"), ["E", "c"], ["pur"]).select("event_id", "book")


@plan.query("works_merged", "SELECT doc_id AS work_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents")
def works_merged(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS work_id", "lang")
    return S.works_merged(d, d.where("work_id % 3 = 0").withColumn("lang", F.lit("new")))


@plan.query("passages", "WITH d AS (SELECT doc_id AS work_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL) SELECT work_id, CAST(k AS INT) AS sequence, md5(p[k + 1]) AS content_md5, concat(work_id, '-', k) AS id FROM d, LATERAL (SELECT unnest(range(0, len(p))) AS k)")
def passages(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("work_id"), F.split("text", "\n").alias("parts"))
    return S.passages_of(d).select("work_id", "sequence", F.md5(F.col("content").cast("binary")).alias("content_md5"), "id")


@plan.query("corpus_built", "SELECT doc_id AS work_id, CASE WHEN doc_id % 2 = 0 THEN 'have' WHEN doc_id % 3 = 0 THEN 'copied' WHEN doc_id % 5 = 0 THEN 'xml' WHEN doc_id % 7 = 0 THEN 'plain' ELSE 'skipped' END AS outcome, CASE WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'T|b' WHEN doc_id % 5 = 0 THEN 'T|x' WHEN doc_id % 7 = 0 THEN 'T|p' END AS parts FROM documents")
def corpus_built(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS work_id", "'T' AS title")
    own = lambda n, x: d.where(f"work_id % {n} = 0").withColumn("parts", F.array(F.lit(x)))
    return S.corpus_built(d, own(2, "h"), own(3, "b"), own(5, "x"), own(7, "p")).withColumn("parts", F.array_join("parts", "|"))


@plan.query("cache_hits", "SELECT conv_id * 1000 + turn AS query_id, CAST(turn AS VARCHAR) AS result FROM conversations WHERE text IN (SELECT text FROM conversations WHERE turn = 0) AND false UNION ALL SELECT c.query_id, m.result FROM (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations) c JOIN (SELECT text, arg_max(CAST(turn AS VARCHAR), conv_id * 100 + turn) AS result FROM conversations WHERE 50000 - (conv_id * 100 + turn) <= 45000 GROUP BY text) m ON c.text = m.text")
def cache_hits(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    q = c.selectExpr("conv_id * 1000 + turn AS query_id", "text AS query")
    cache = c.select(F.sha2("text", 256).alias("key"), (F.col("conv_id") * 100 + F.col("turn")).alias("ts"), F.col("turn").cast("string").alias("result"))
    return S.cached(q, cache, F.lit(50000), 45000)[0].select("query_id", "result")


_HASHED_SQL = "e AS (SELECT g, b, count(*) AS n, sha256(string_agg(k, chr(10) ORDER BY k)) AS h FROM b GROUP BY g, b), s AS (SELECT g, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM e GROUP BY g), hashed AS (SELECT sum(n) AS rows, sha256(string_agg(h, chr(10) ORDER BY g)) AS hash FROM s)"


@plan.query("fingerprint", _WINDOWS_SQL + ", b AS (SELECT id AS k, left(md5(id), 3) AS g, left(md5(id), 6) AS b FROM chunks0), " + _HASHED_SQL + f" SELECT rows, '{','.join(sorted(CHUNK_COLUMNS))}' AS schema, hash AS fingerprint FROM hashed")
def fingerprint(spark, sf_dir):
    return S.fingerprint(chunks(spark, sf_dir).select(*CHUNK_COLUMNS))


#: What stands for a value in a row's hash: + or - for null, its bytes, its text.
_PIECE = "concat(CASE WHEN {0} IS NULL THEN '-' ELSE '+' END, strlen(coalesce(CAST({0} AS VARCHAR), '')), ':', coalesce(CAST({0} AS VARCHAR), ''))"
_DIGEST = "concat_ws('.', " + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)" for i in range(4)) + ")"


def digest_sql(table: str, key: str, *columns: str) -> str:
    """The digests of a table's rows by key: key, rows, digest."""
    return f"SELECT {key} AS key, count(*) AS rows, {_DIGEST} AS digest FROM (SELECT {key}, md5(concat({', '.join(_PIECE.format(c) for c in columns)})) AS h FROM {table}) GROUP BY ALL"


@plan.query("content_digest", _WINDOWS_SQL + " " + digest_sql("chunks0", "book", "id", "chapter", "text"))
def content_digest(spark, sf_dir):
    return S.digest(chunks(spark, sf_dir), "book", "id", "chapter", "text")


@plan.query("book_fingerprint", _WINDOWS_SQL + f", dg AS ({digest_sql('chunks0', 'book', 'id', 'text')}), c AS (SELECT concat_ws(':', key, digest, rows) AS k FROM dg), b AS (SELECT k, left(md5(k), 3) AS g, left(md5(k), 6) AS b FROM c), " + _HASHED_SQL + " SELECT rows AS books, sha256(concat(hash, chr(10), 'model')) AS fingerprint FROM hashed")
def book_fingerprint(spark, sf_dir):
    return S.book_fingerprint(chunks(spark, sf_dir), "model")


@plan.query("text_fingerprint", f"SELECT rows, sha256(digest) AS fingerprint FROM ({digest_sql("(SELECT *, 'all' AS a FROM benchmark)", 'a', 'item_id', 'text')})")
def text_fingerprint(spark, sf_dir):
    return S.text_fingerprint(A.table(spark, sf_dir, "benchmark"), "item_id", "text")


@plan.query("citations_exported", "SELECT 'run1' AS run_id, event_id AS question_id, CAST(k AS INT) AS ord, concat('b', k) AS book, event_id + k AS page FROM events, (SELECT unnest(range(0, 3)) AS k)")
def citations_exported(spark, sf_dir):
    r = A.table(spark, sf_dir, "events").selectExpr("event_id AS question_id", "transform(sequence(0, 2), k -> named_struct('book', concat('b', k), 'page', event_id + k)) AS citations")
    return S.exported(r, "citations", "run1")


@plan.query("paths_rerooted", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('assets/x/', event_id, '.png') ELSE concat('/other/', event_id) END AS path FROM events")
def paths_rerooted(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 2 = 0 THEN concat('/home/assets/old/assets/x/', event_id, '.png') ELSE concat('/other/', event_id) END AS p")
    return e.select("event_id", S.rerooted("p", "assets").alias("path"))


# Books of even number have foreign pages from the 101st on, with a signature; each third one has a marker, and of each sixth
# book a page of the foreign part has a chapter of the book's own, so that its part is not pure.
_FOREIGN = "page > 100 AND CAST(substr(book, 2) AS INT) % 2 = 0"
_BOOK_ROWS = f"book, page, concat(text, CASE WHEN {_FOREIGN} THEN ' foreign part' ELSE '' END, CASE WHEN {_FOREIGN} AND page % 3 = 0 THEN ' foreign marker' ELSE '' END) AS text, CASE WHEN NOT ({_FOREIGN}) OR (page = 150 AND CAST(substr(book, 2) AS INT) % 6 = 4) THEN 'own' ELSE '' END AS chapter, doc_id"


def _purged_tables(spark, sf_dir):
    """Chunks, figures and caption lines of books in versions, and their audit."""
    v = Versions(spark, S.new_path(spark, "versions"))
    rows = A.pages(spark, sf_dir).selectExpr(*A._split(_BOOK_ROWS))
    figures = A.pages(spark, sf_dir).where("has_figure").selectExpr("book", "page", "concat(book, '::f', doc_id) AS id")
    lines = figures.selectExpr("book", "CASE WHEN page % 10 = 0 THEN '{torn' ELSE to_json(named_struct('id', id, 'caption', 'c')) END AS line")
    v.overwrite(chunks=rows, figures=figures, captions=lines)
    return v, lambda c: clean.contaminated_books(c, ["foreign part"], "^own$", ["foreign marker"])


@plan.query(
    "purged",
    f"""WITH {A.PAGES_SQL}, c AS (SELECT {_BOOK_ROWS}, has_figure FROM pages0),
    f AS (SELECT book, min(page) FILTER (contains(text, 'foreign part')) AS s FROM c GROUP BY book HAVING count(*) FILTER (contains(text, 'foreign part')) >= 15),
    b AS (SELECT book, coalesce(max(page) FILTER (chapter = 'own' AND page < s), 0) + 1 AS boundary FROM c JOIN f USING (book) GROUP BY book),
    p AS (SELECT book, boundary FROM c JOIN b USING (book) WHERE page >= boundary GROUP BY ALL HAVING NOT bool_or(chapter = 'own') AND bool_or(contains(text, 'foreign marker'))),
    k AS (SELECT c.*, p.boundary IS NULL OR c.page < p.boundary AS kept FROM c LEFT JOIN p USING (book))
    SELECT 'chunks' AS tab, book, count(*) AS n FROM k WHERE kept GROUP BY ALL UNION ALL SELECT 'figures', book, count(*) FROM k WHERE kept AND has_figure GROUP BY ALL UNION ALL SELECT 'captions', book, count(*) FROM k WHERE has_figure AND (kept OR page % 10 = 0) GROUP BY ALL""",
)
def purged(spark, sf_dir):
    v, audit = _purged_tables(spark, sf_dir)
    purge.purge(v, audit)
    return reduce(DataFrame.unionByName, [v.read(t).groupBy(F.lit(t).alias("tab"), "book").agg(F.count(F.lit(1)).alias("n")) for t in ("chunks", "figures", "captions")])


@plan.query("purge_report", plan.sql["purged"].split("SELECT 'chunks' AS tab")[0] + "SELECT CASE WHEN count(*) FILTER (NOT kept) > 0 THEN 'purged' WHEN EXISTS (SELECT 1 FROM b WHERE book NOT IN (SELECT book FROM p)) THEN 'impure' ELSE 'clean' END AS state, count(*) FILTER (NOT kept) AS chunks, count(*) FILTER (NOT kept AND has_figure) AS figures, count(*) FILTER (NOT kept AND has_figure AND page % 10 > 0) AS captions, (SELECT count(*) FROM b WHERE book NOT IN (SELECT book FROM p)) AS impure, CASE WHEN EXISTS (SELECT 1 FROM b WHERE book NOT IN (SELECT book FROM p)) THEN 'impure' ELSE 'clean' END AS again FROM k")
def purge_report(spark, sf_dir):
    v, audit = _purged_tables(spark, sf_dir)
    first, again = purge.purge(v, audit), purge.purge(v, audit)
    names = ("state", "chunks", "figures", "captions", "impure")
    return spark.createDataFrame([(*[first[n] for n in names], again["state"])], "state string, chunks long, figures long, captions long, impure long, again string")


@plan.query("rolled_back", f"WITH {A.PAGES_SQL} SELECT book, count(*) AS pages, sum(length(text))::BIGINT AS letters FROM pages0 GROUP BY book")
def rolled_back(spark, sf_dir):
    """Books replaced, compacted, and put back."""
    v = Versions(spark, S.new_path(spark, "versions"))
    p = A.pages(spark, sf_dir).select("book", "page", "text")
    first = v.overwrite(pages=p)
    v.replace(pages=p.where("book = 'b0'").withColumn("text", F.lit("other")))
    v.compact("pages", at_least=2)
    v.rollback(first)
    return v.read("pages").groupBy("book").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("letters"))


@plan.query("replaced_books", f"WITH {A.PAGES_SQL} SELECT book, count(*) AS pages, count(*) FILTER (page % 2 = 0 AND CAST(substr(book, 2) AS INT) % 3 = 1) AS changed FROM pages0 WHERE CAST(substr(book, 2) AS INT) % 3 < 2 GROUP BY book")
def replaced_books(spark, sf_dir):
    """Some books replaced and some removed, read as one table after the parts are put together."""
    v = Versions(spark, S.new_path(spark, "versions"))
    p = A.pages(spark, sf_dir).select("book", "page", F.lit("old").alias("state"))
    v.overwrite(pages=p)
    number = F.expr("CAST(substr(book, 2) AS INT) % 3")
    v.replace(pages=p.where(number == 1).withColumn("state", F.expr("CASE WHEN page % 2 = 0 THEN 'new' ELSE 'old' END")), removed={"pages": p.where(number == 2)})
    v.compact("pages", at_least=2)
    return v.read("pages").groupBy("book").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("state") == "new").alias("changed"))


@plan.query("media_resolved", "WITH c AS (SELECT event_id AS id, [concat('a/i', event_id % 5), concat('i', event_id % 9)] AS im FROM events), e AS (SELECT id, regexp_extract(n, '([^/]+)$', 1) AS base FROM (SELECT id, unnest(im) AS n FROM c)) SELECT id, count(*) FILTER (base < 'i5') AS resolved, count(*) FILTER (base >= 'i5') AS missing, count(DISTINCT base) FILTER (base < 'i5') AS blobs FROM e GROUP BY id")
def media_resolved(spark, sf_dir):
    c = A.table(spark, sf_dir, "events").selectExpr("event_id AS id", "array(concat('a/i', event_id % 5), concat('i', event_id % 9)) AS images")
    m = A.table(spark, sf_dir, "events").selectExpr("concat('i', event_id % 5) AS name", "concat('blob', event_id % 5) AS blob").distinct()
    return S.media_resolved(c, m)


@plan.query("lines_kept", "SELECT count(*) AS lines, count(*) FILTER (user_id % 5 = 0) AS torn FROM events WHERE NOT (user_id % 5 > 0 AND user_id % 7 = 0)")
def lines_kept(spark, sf_dir):
    lines = A.table(spark, sf_dir, "events").selectExpr("CASE WHEN user_id % 5 = 0 THEN concat('{torn', user_id) ELSE to_json(named_struct('id', cast(user_id AS STRING))) END AS line")
    gone = A.table(spark, sf_dir, "events").where("user_id % 7 = 0").selectExpr("cast(user_id AS STRING) AS id").distinct()
    return S.kept_lines(lines, gone).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").startswith("{torn")).alias("torn"))
