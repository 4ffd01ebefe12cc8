"""Queries over pages of books: cleaning, structure, audits, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, clean
from ..sources import adapters as A
from .base import Plan

plan = Plan()

_CLEAN_SQL = f"""WITH {A.PAGES_SQL},
lines0 AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM pages0),
cut0 AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^\\s*(REFERENCES|BIBLIOGRAPHY)\\s*$')), true) AS h FROM lines0),
clean0 AS (SELECT *, regexp_replace(array_to_string(list_filter(CASE WHEN h > 0 THEN l[1:h - 1] ELSE l END, lambda x: NOT regexp_matches(x, '^\\s*[0-9]{{1,3}}\\.\\s+[A-Z][a-z]+\\s+[A-Z]{{1,3}}[,.]')), chr(10)), '^\\s+|\\s+$', '', 'g') AS clean_text FROM cut0)
"""


@plan.query("strip_references", _CLEAN_SQL + "SELECT doc_id, md5(clean_text) AS clean_md5, length(coalesce(text, '')) - length(clean_text) AS removed_chars FROM clean0")
def strip_references(spark, sf_dir):
    return clean.without_references(A.pages(spark, sf_dir)).select("doc_id", F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"), "removed_chars")


@plan.query("reference_share", _CLEAN_SQL + ", s AS (SELECT book, sum(length(coalesce(text, '')) - length(clean_text)) AS removed, sum(length(clean_text)) AS kept FROM clean0 GROUP BY book) SELECT book, removed, kept, round(coalesce(removed / nullif(removed + kept, 0), 0), 4) AS share, coalesce(removed / nullif(removed + kept, 0), 0) > 0.4 AS refused FROM s")
def reference_share(spark, sf_dir):
    return clean.reference_share(A.pages(spark, sf_dir))


_TITLE = "CASE WHEN page % 70 = 0 THEN 'Chapter 3: foreign' WHEN page % 35 = 0 THEN 'PREFACE to all' WHEN page % 21 = 0 THEN concat(page, ' - ', replace(substr(text, 1, 20), chr(10), ' ')) WHEN page % 14 = 0 THEN concat('x', page, 'abcdefghijklmnopqrstuvwxyz') ELSE replace(substr(text, 1, 30), chr(10), ' ') END"
_TOC_SQL = f"WITH {A.PAGES_SQL}, toc0 AS (SELECT book, page, {_TITLE} AS title FROM pages0)"
_TRIM = "regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')"
_FRONT = f"(lower({_TRIM}) IN ('cover', 'cover page') OR regexp_matches(lower({_TRIM}), '^({'|'.join(clean.FRONT_PREFIXES)})'))"
_NUMBERED = "regexp_matches(coalesce(title, ''), '^\\s*[0-9]+\\s*[-–]\\s*\\S')"
_RANDOM = f"(NOT contains({_TRIM}, ' ') AND NOT contains({_TRIM}, '/') AND NOT {_NUMBERED} AND length({_TRIM}) > 25 AND regexp_matches({_TRIM}, '[0-9]'))"
_JUNK = f"({_TRIM} = '' OR length({_TRIM}) > 60 OR regexp_matches({_TRIM}, '(?i)\\.pdf|p\\.[0-9]+-[0-9]+|^[A-Za-z0-9]{{40,}}$') OR lower({_TRIM}) IN ('copyright', 'dedication', 'contributor', 'contributors', 'preface', 'index', 'front matter'))"


def _toc(spark, sf_dir):
    return A.pages(spark, sf_dir).selectExpr("book", "page", f"{_TITLE} AS title")


@plan.query("label_kinds", f"{_TOC_SQL} SELECT book, count(*) FILTER ({_JUNK}) AS junk, count(*) FILTER ({_NUMBERED}) AS numbered, count(*) FILTER ({_FRONT}) AS front, count(*) FILTER ({_RANDOM}) AS random FROM toc0 GROUP BY book")
def label_kinds(spark, sf_dir):
    return clean.label_counts(_toc(spark, sf_dir))


_BOUNDARY_SQL = f"""{_TOC_SQL}, last0 AS (SELECT book, max(page) FILTER ({_NUMBERED}) AS last_chapter FROM toc0 GROUP BY book),
end0 AS (SELECT book, min(page) AS content_end FROM toc0 JOIN last0 USING (book) WHERE regexp_matches({_TRIM}, '^Chapter [0-9]+:') AND page > last_chapter GROUP BY book)"""


@plan.query("toc_boundary", f"{_BOUNDARY_SQL} SELECT book, last_chapter, content_end FROM last0 LEFT JOIN end0 USING (book)")
def toc_boundary(spark, sf_dir):
    return clean.toc_boundary(_toc(spark, sf_dir))


@plan.query(
    "page_labels",
    f"""{_BOUNDARY_SQL}, labels0 AS (SELECT book, page, title FROM toc0 LEFT JOIN end0 USING (book) WHERE (content_end IS NULL OR page < content_end) AND NOT {_FRONT} AND NOT {_RANDOM}),
    kept0 AS (SELECT book, page FROM pages0 LEFT JOIN end0 USING (book) WHERE content_end IS NULL OR page < content_end)
    SELECT k.book, k.page, CASE WHEN k.page - l.page <= 120 THEN l.title END AS label FROM kept0 k ASOF LEFT JOIN labels0 l ON k.book = l.book AND k.page >= l.page""",
)
def page_labels(spark, sf_dir):
    toc = _toc(spark, sf_dir)
    return clean.labelled(clean.before_boundary(A.pages(spark, sf_dir), clean.toc_boundary(toc)), clean.toc_labels(toc))


@plan.query(
    "book_probe",
    f"""WITH {A.PAGES_SQL}, c AS (SELECT book, count(*) AS pages, count(*) FILTER (length(coalesce(text, '')) > 50) AS pages_with_text, round(count(*) FILTER (length(coalesce(text, '')) > 50) / count(*), 3) AS coverage, count(*) FILTER (has_figure) AS pages_with_figures, count(DISTINCT chapter) AS chapters FROM pages0 GROUP BY book)
    SELECT *, coverage >= 0.6 AS ok, CASE WHEN coverage < 0.6 THEN concat('text coverage ', printf('%.2f', coverage), ' is too low') ELSE concat('text coverage ', printf('%.2f', coverage)) END AS reason FROM c""",
)
def book_probe(spark, sf_dir):
    return clean.probed(A.pages(spark, sf_dir))


_SPANS = "book, page, pos, token, pos < 4 AS is_top"


def _spans(spark, sf_dir):
    """The first four words of a page stand at its top, its number, every third time, at its foot."""
    p = A.pages(spark, sf_dir)
    top = F.concat(F.when(F.col("page") % 11 == 0, F.array((F.col("page") % 40).cast("string"))).otherwise(F.array().cast("array<string>")), F.slice(T.words("text"), 1, 3))
    foot = F.when(F.col("page") % 3 != 0, F.array(F.lit("-"), F.col("page").cast("string"))).otherwise(F.array(F.lit("-")))
    return p.select("book", "page", F.posexplode(F.concat(F.slice(F.concat(top, F.array_repeat(F.lit("."), 4)), 1, 4), foot)).alias("pos", "token")).selectExpr(*A._split(_SPANS))


_SPANS_SQL = f"""WITH {A.PAGES_SQL},
w0 AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM pages0),
t0 AS (SELECT book, page, list_concat(list_concat(CASE WHEN page % 11 = 0 THEN [CAST(page % 40 AS VARCHAR)] ELSE [] END, list_concat(w[1:3], ['.', '.', '.', '.']))[1:4], CASE WHEN page % 3 <> 0 THEN ['-', CAST(page AS VARCHAR)] ELSE ['-'] END) AS t FROM w0),
spans0 AS (SELECT book, page, pos - 1 AS pos, t[pos] AS token, pos <= 4 AS is_top FROM t0, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS pos)),
folio0 AS (SELECT book, page, min_by(token, pos) FILTER (regexp_matches(token, '^[0-9]{{1,4}}(\\.e[0-9]+)?$')) AS folio FROM spans0 GROUP BY book, page),
bare0 AS (SELECT s.book, s.page, min_by(CAST(token AS INT), pos) AS bare FROM spans0 s JOIN folio0 f ON s.book = f.book AND s.page = f.page WHERE is_top AND regexp_matches(token, '^[0-9]{{1,3}}$') AND token IS DISTINCT FROM folio AND CASE WHEN regexp_matches(token, '^[0-9]{{1,3}}$') THEN CAST(token AS INT) > 1 AND CAST(token AS INT) <= 470 END GROUP BY s.book, s.page),
number0 AS (SELECT p.*, folio, coalesce(TRY_CAST(nullif(regexp_extract(array_to_string(string_split(coalesce(text, ''), chr(10))[1:10], chr(10)), 'CHAPTER\\s+([0-9]{{1,3}})\\b', 1), '') AS INT), bare) AS chapter_number FROM pages0 p LEFT JOIN folio0 f ON p.book = f.book AND p.page = f.page LEFT JOIN bare0 b ON p.book = b.book AND p.page = b.page)
"""


@plan.query(
    "chapters_filled",
    _SPANS_SQL
    + "SELECT doc_id, folio, chapter_number, CASE WHEN bool_or(page <= 400 AND chapter_number IS NOT NULL) OVER (PARTITION BY book) THEN CAST(last_value(chapter_number IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS UNBOUNDED PRECEDING) AS VARCHAR) ELSE chapter END AS filled FROM number0",
)
def chapters_filled(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    numbered = clean.chapter_numbers(A.pages(spark, sf_dir), spans)
    return clean.filled_chapters(numbered.join(clean.folios(spans), ["book", "page"], "left")).select("doc_id", "folio", "chapter_number", "filled")


_CAPTION_SQL = "regexp_replace(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '(?i)^\\s*(fig(ure)?|plate)\\b[\\s.:]*\\S'))[1], '^\\s+|\\s+$', '', 'g')"


def _head_sql(c: str, most: int) -> str:
    t = f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
    h = f"left({t}, {most})"
    cut = f"(length({h}) - instr(reverse({h}), ' .') - 1)"
    return f"CASE WHEN length({t}) <= {most} THEN {t} WHEN instr(reverse({h}), ' .') > 0 AND {cut} >= 60 THEN substr({h}, 1, {cut} + 1) WHEN instr({h}, ' ') > 0 THEN substr({h}, 1, length({h}) - instr(reverse({h}), ' ')) ELSE {h} END"


@plan.query("captions", f"WITH {A.PAGES_SQL} SELECT doc_id, {_CAPTION_SQL} AS caption, {_head_sql('text', 320)} AS head FROM pages0")
def captions(spark, sf_dir):
    return A.pages(spark, sf_dir).select("doc_id", clean.first_caption().alias("caption"), T.caption_head("text").alias("head"))


@plan.query(
    "effective_captions",
    f"WITH {A.PAGES_SQL}, f AS (SELECT *, concat('b/', doc_id, '.png') AS figure_path, CASE WHEN doc_id % 2 = 0 THEN text ELSE '  ' END AS curated FROM pages0 WHERE has_figure AND book <> 'b1') SELECT doc_id, CASE WHEN nullif(regexp_replace(curated, '^\\s+|\\s+$', '', 'g'), '') IS NOT NULL THEN {_head_sql('curated', 700)} ELSE {_head_sql('text', 320)} END AS effective FROM f WHERE doc_id % 4 <> 1",
)
def effective_captions(spark, sf_dir):
    p = A.pages(spark, sf_dir).where("has_figure").selectExpr("*", "concat('b/', doc_id, '.png') AS figure_path", "CASE WHEN doc_id % 2 = 0 THEN text ELSE '  ' END AS curated").withColumn("caption", F.col("text"))
    assets = A.table(spark, sf_dir, "documents").where("doc_id % 4 <> 1").selectExpr("concat('b/', doc_id, '.png') AS figure_path")
    return clean.effective_caption(p, ["b1"], assets).select("doc_id", "effective")


_HTML = """concat(html, CASE WHEN page_id % 3 = 0 THEN '<img src="a.png" alt="x y"><br/>end' ELSE '' END)"""
_HTML_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '(?i)<(br|p|div|li)(\s[^>]*)?/?>', chr(10), 'g'), '(?i)<img\b[^>]*?\balt="([^"]+)"[^>]*>', ' \1 ', 'g'), '<[^>]*>', '', 'g')"""
for _name, _value in clean.ENTITIES.items():
    _HTML_SQL = f"replace({_HTML_SQL}, '{_name}', '{_value.replace(chr(39), chr(39) * 2)}')"
_HTML_SQL = rf"regexp_replace(regexp_replace(regexp_replace({_HTML_SQL}, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@plan.query("html_text", f"WITH p AS (SELECT page_id, {_HTML} AS h FROM pages) SELECT page_id, md5({_HTML_SQL}) AS text_md5, len(regexp_extract_all(h, '(?i)<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1)) AS images FROM p")
def html_text(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").selectExpr("page_id", f"{_HTML} AS h")
    return p.select("page_id", F.md5(clean.html_text(F.col("h")).cast("binary")).alias("text_md5"), F.size(clean.html_images(F.col("h"))).cast("long").alias("images"))


_BOXES = "concat('e', user_id % 10) AS book, CAST(user_id AS INT) AS page, value AS x0, event_id % 700 AS y0, value + event_id % 150 AS x1, event_id % 700 + event_id % 90 AS y1, 480000.0 AS page_area"


@plan.query("figure_area", f"WITH b AS (SELECT {_BOXES} FROM events) SELECT book, page, sum(CAST(abs((x1 - x0) * (y1 - y0)) AS DECIMAL(24, 6)))::DOUBLE / max(page_area) AS area, sum(CAST(abs((x1 - x0) * (y1 - y0)) AS DECIMAL(24, 6)))::DOUBLE / max(page_area) >= 0.1 AS has_figure FROM b GROUP BY book, page")
def figure_area(spark, sf_dir):
    return clean.figure_area(A.table(spark, sf_dir, "events").selectExpr(*A._split(_BOXES)))


@plan.query("figure_plates")
def figure_plates(spark, sf_dir):
    """Transitive merging has no plain SQL; tested on small boxes."""
    return clean.plates(A.table(spark, sf_dir, "events").selectExpr(*A._split(_BOXES)))


@plan.query(
    "box_captions",
    f"""WITH e AS (SELECT *, {_BOXES} FROM events), b AS (SELECT * FROM e WHERE event_type = 'click'), k AS (SELECT *, CASE WHEN event_type = 'view' THEN concat('Figure ', event_id) ELSE concat('text ', event_id) END AS block FROM e WHERE event_type <> 'click'),
    j AS (SELECT b.book, b.page, b.x0, b.y0, b.x1, b.y1, k.y0 AS by0, k.y1 AS by1, block, regexp_matches(block, '^Figure') AS lab FROM b JOIN k ON b.book = k.book AND b.page = k.page AND k.x0 < b.x1 AND k.x1 > b.x0),
    r AS (SELECT *, row_number() OVER (PARTITION BY book, page, x0, y0, x1, y1 ORDER BY CASE WHEN lab THEN 0 WHEN by0 - y1 >= -2 THEN 1 END NULLS LAST, CASE WHEN lab THEN greatest(by0 - y1, y0 - by1, 0) ELSE by0 - y1 END, by0, block) AS rn FROM j)
    SELECT book, page, x0, y0, x1, y1, CASE WHEN lab OR by0 - y1 >= -2 THEN block END AS caption FROM r WHERE rn = 1""",
)
def box_captions(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").selectExpr("event_type", "event_id", *A._split(_BOXES))
    blocks = e.where("event_type <> 'click'").withColumn("text", F.when(F.col("event_type") == "view", F.concat(F.lit("Figure "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("text "), F.col("event_id").cast("string"))))
    return clean.box_captions(e.where("event_type = 'click'").select("book", "page", "x0", "y0", "x1", "y1").withColumns({c: F.col(c).cast("double") for c in ("y0", "y1")}), blocks.withColumns({c: F.col(c).cast("double") for c in ("y0", "y1")}))


@plan.query(
    "corpus_invariants",
    f"""WITH {A.PAGES_SQL}, c AS (SELECT book, chapter AS title, text, CASE WHEN page % 20 > 0 THEN page END AS printed_page,
      len(regexp_extract_all(coalesce(text, ''), 'et al')) AS e, len(regexp_extract_all(coalesce(text, ''), '[0-9]{{4}};[0-9]+')) + len(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+ [A-Z]{{1,3}}[,.]')) AS o, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS w FROM pages0),
    a AS (SELECT avg((e >= 6 OR (e + o) / (greatest(w, 1) / 100) >= 40)::INT) AS bibliography, avg(({_JUNK} AND {_TRIM} <> '')::INT) AS junk, avg((printed_page IS NOT NULL)::INT) AS folio, avg((w < 20)::INT) AS short, count(DISTINCT book)::DOUBLE AS books FROM c),
    u AS (UNPIVOT a ON bibliography, junk, folio, short, books INTO NAME "check" VALUE value)
    SELECT "check", round(value, 4) AS value, CASE WHEN "check" IN ('bibliography', 'junk') THEN 0.05 WHEN "check" = 'folio' THEN 0.9 WHEN "check" = 'short' THEN 0.0 ELSE 1.0 END::DOUBLE AS target,
      CASE WHEN "check" = 'folio' THEN value >= 0.9 WHEN "check" = 'books' THEN value >= 1 WHEN "check" = 'short' THEN value <= 0 ELSE value < 0.05 END AS ok FROM u""",
)
def corpus_invariants(spark, sf_dir):
    return clean.invariants(A.pages(spark, sf_dir).withColumn("printed_page", F.when(F.col("page") % 20 > 0, F.col("page"))))


_STRONG, _MARK = "%%%", "!!"


@plan.query(
    "contamination_audit",
    f"""WITH {A.PAGES_SQL}, c AS (SELECT *, contains(lower(text), '{_STRONG}') AS strong, contains(lower(text), '{_MARK}') AS marked, chapter = 'de' AS legit FROM pages0),
    f AS (SELECT book, count(*) FILTER (strong) AS n_strong, min(page) FILTER (strong) AS first_strong FROM c GROUP BY book HAVING count(*) FILTER (strong) >= 15),
    b AS (SELECT book, n_strong, first_strong, coalesce(max(page) FILTER (legit AND page < first_strong), 0) + 1 AS boundary FROM c JOIN f USING (book) GROUP BY ALL),
    i AS (SELECT book, count(*) AS deletable, NOT bool_or(legit) AND bool_or(marked) AS pure FROM c JOIN b USING (book) WHERE page >= boundary GROUP BY book)
    SELECT book, n_strong, first_strong, boundary, coalesce(deletable, 0) AS deletable, coalesce(pure, false) AS pure FROM b LEFT JOIN i USING (book)""",
)
def contamination_audit(spark, sf_dir):
    return clean.contaminated_books(A.pages(spark, sf_dir), [_STRONG], "^de$", [_MARK])


#: Words of a chunk, and of its overlap with the one before.
CHUNKS = (120, 20)


def chunks(spark, sf_dir):
    return chunk.chunk_pages(A.pages(spark, sf_dir), *CHUNKS)


_WINDOWS_SQL = f"""WITH {A.PAGES_SQL}, w0 AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM pages0),
chunks0 AS (SELECT book, page, chapter, doc_id, source, k AS i, array_to_string(w[k * 100 + 1:k * 100 + 120], ' ') AS text, concat(book, '::p', page, '::', k) AS id FROM w0, LATERAL (SELECT unnest(range(0, CASE WHEN len(w) <= 120 THEN 1 ELSE CAST(ceil((len(w) - 120) / 100) AS BIGINT) + 1 END)) AS k) WHERE len(w) >= 20 OR (len(w) > 0 AND has_figure))"""


@plan.query("chunk_pages", _WINDOWS_SQL + " SELECT id, doc_id, i, md5(text) AS text_md5 FROM chunks0")
def chunk_pages(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", "doc_id", "i", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_SIZES_SQL = "s AS (SELECT source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM chunks0)"


@plan.query(
    "chunk_shape",
    _WINDOWS_SQL + ", " + _SIZES_SQL + " SELECT source, count(*) AS n_chunks, round(avg(w), 1) AS mean_words, CAST(floor(median(w)) AS INT) AS median_words, max(w) AS max_words, round(100 * avg((w < 50)::INT), 1) AS frag_pct_lt50w, sum(w) AS total_words, list_sort(list(w))[CAST(floor(0.9 * count(*)) AS INT) + 1] AS p90_words FROM s GROUP BY source",
)
def chunk_shape(spark, sf_dir):
    return chunk.shape(chunks(spark, sf_dir), ["source"])


@plan.query("chunk_boundaries", _WINDOWS_SQL + " SELECT source, round(100 * avg(regexp_matches(text, '^[A-Z0-9(]')::INT), 1) AS clean_start_pct, round(100 * avg(regexp_matches(text, '[.!?]$')::INT), 1) AS clean_end_pct FROM chunks0 GROUP BY source")
def chunk_boundaries(spark, sf_dir):
    return chunk.boundaries(chunks(spark, sf_dir), ["source"])


@plan.query(
    "sentence_atoms",
    f"""WITH {A.PAGES_SQL}, n AS (SELECT book, page, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM pages0),
    s AS (SELECT book, page, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM n)
    SELECT book, page, CAST(i - 1 AS INT) AS i, md5(l[i]) AS atom_md5 FROM s, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)""",
)
def sentence_atoms(spark, sf_dir):
    return chunk.sentence_atoms(A.pages(spark, sf_dir)).select("book", "page", "ord.i", F.md5(F.col("atom").cast("binary")).alias("atom_md5"))


@plan.query(
    "paragraph_atoms",
    f"""WITH {A.PAGES_SQL}, s AS (SELECT book, page, string_split(regexp_replace(coalesce(text, ''), '\\n\\s*\\n', chr(1), 'g'), chr(1)) AS l FROM pages0),
    a AS (SELECT book, page, CAST(i - 1 AS INT) AS i, trim(regexp_replace(l[i], '\\s+', ' ', 'g')) AS atom FROM s, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)) SELECT book, page, i, md5(atom) AS atom_md5 FROM a WHERE atom <> ''""",
)
def paragraph_atoms(spark, sf_dir):
    return chunk.paragraph_atoms(A.pages(spark, sf_dir)).select("book", "page", "ord.i", F.md5(F.col("atom").cast("binary")).alias("atom_md5"))


@plan.query(
    "chapter_atoms",
    f"""WITH {A.PAGES_SQL}, r AS (SELECT *, CASE WHEN chapter IS NOT DISTINCT FROM lag(chapter) OVER (PARTITION BY book ORDER BY page) AND row_number() OVER (PARTITION BY book ORDER BY page) > 1 THEN 0 ELSE 1 END AS c FROM pages0),
    g AS (SELECT *, sum(c) OVER (PARTITION BY book ORDER BY page) AS run FROM r), a AS (SELECT book, min(page) AS page, min(chapter) AS chapter, trim(regexp_replace(coalesce(string_agg(text, ' ' ORDER BY page), ''), '\\s+', ' ', 'g')) AS atom FROM g GROUP BY book, run)
    SELECT book, page, chapter, md5(atom) AS atom_md5 FROM a WHERE atom <> ''""",
)
def chapter_atoms(spark, sf_dir):
    return chunk.chapter_atoms(A.pages(spark, sf_dir)).select("book", "page", "chapter", F.md5(F.col("atom").cast("binary")).alias("atom_md5"))


@plan.query("packed_sections")
def packed_sections(spark, sf_dir):
    """Packing goes through a book's atoms in order, which plain SQL cannot; tested on small books."""
    return chunk.chunk(A.pages(spark, sf_dir), "heading", 120, 20)


@plan.query("chunk_arms")
def chunk_arms(spark, sf_dir):
    """Shapes of several strategies and sizes side by side; as packed_sections."""
    return chunk.run_arms(A.pages(spark, sf_dir), chunk.arms([120, 60], [20, 0]))
