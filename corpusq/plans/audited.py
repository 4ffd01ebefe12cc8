"""Queries: files read and written, guards and their reasons, invariants and audits, saved runs, sheets and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk, clean, evaluate, gate, rank, structure, tag, verify
from ..sources import adapters as A
from ..sources import store as S
from .base import Plan
from .pages import _WINDOWS_SQL, chunks
from .searched import _CONTENT, _HYBRID_SQL, _STOP_SQL, hybrid_inputs, text_index
from .verified import _CLAIMS_SQL, _GROUNDED_SQL, SUFFIX

plan = Plan()


# --- files ------------------------------------------------------------------------------------------------------------


@plan.query("columns_read", "SELECT doc_id, CAST(NULL AS VARCHAR) AS license, n_chars FROM documents")
def columns_read(spark, sf_dir):
    """A table that was written without a column, and one that is not there."""
    path = S.new_path(spark, "columns")
    A.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").write.parquet(path)
    schema = "doc_id long, license string, n_chars long"
    return S.read_columns(spark, path, schema).unionByName(S.read_columns(spark, f"{path}-none", schema))


@plan.query("lines_read", "SELECT event_id, user_id FROM events WHERE event_id % 5 <> 0")
def lines_read(spark, sf_dir):
    """Every fifth line is torn."""
    path = S.new_path(spark, "lines")
    whole = "to_json(named_struct('event_id', event_id, 'user_id', user_id))"
    A.table(spark, sf_dir, "events").selectExpr(f"CASE WHEN event_id % 5 = 0 THEN left({whole}, length({whole}) - 3) ELSE {whole} END AS value").write.text(path)
    return S.read_lines(spark, path, "event_id long, user_id long")


@plan.query("have_list", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CAST(1990 + doc_id % 30 AS INT) END AS year, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 12 AS INT) WHEN doc_id % 8 = 0 THEN CAST(doc_id % 7 AS INT) END AS chapter, lang FROM documents")
def have_list(spark, sf_dir):
    path = S.new_path(spark, "have")
    rows = A.table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "CASE WHEN doc_id % 3 = 0 THEN 'n.d.' ELSE cast(1990 + doc_id % 30 AS string) END AS year", "CASE WHEN doc_id % 4 > 0 THEN cast(doc_id % 12 AS string) END AS chapter", "CASE WHEN doc_id % 8 = 0 THEN concat('Ch', doc_id % 7, '_x') ELSE 'misc' END AS folder")
    rows.write.option("header", True).csv(path)
    return S.have_list(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "year", "chapter", "lang")


@plan.query("cards_written", f"WITH {A.CARDS_SQL}, t AS (SELECT deck, question, answer, concat_ws(chr(10), nullif(regexp_replace(coalesce(question, ''), '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g'), '')) AS text FROM cards0) SELECT concat(deck, '::', left(sha1(coalesce(question, '')), 16)) AS id, deck, length(text) AS chars FROM t WHERE text <> ''")
def cards_written(spark, sf_dir):
    path = S.new_path(spark, "cards")
    cards = A.cards(spark, sf_dir).select("deck", "question", "answer", F.array().cast("array<string>").alias("images"), F.array("deck").alias("tags"))
    for _ in range(2):  # written anew, so a second run changes nothing
        S.write_cards(cards, path, 4)
    return spark.read.parquet(path).select("id", "deck", F.length("text").alias("chars"))


# --- sections and labels ----------------------------------------------------------------------------------------------

_LINE = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
_HEAD = f"({_LINE} <> '' AND len(list_filter(regexp_split_to_array({_LINE}, '\\s+'), lambda w: w <> '')) <= 8 AND NOT ends_with({_LINE}, '.') AND (regexp_matches({_LINE}, '^\\s*([0-9]+(\\.[0-9]+)*)\\s+[A-Z]') OR (regexp_matches({_LINE}, '\\p{{L}}') AND NOT regexp_matches({_LINE}, '\\p{{Ll}}') AND upper({_LINE}) = {_LINE})))"


@plan.query(
    "heading_sections",
    f"""WITH {A.PAGES_SQL}, l AS (SELECT book, page, string_split(coalesce(text, ''), chr(10)) AS l FROM pages0),
    e AS (SELECT book, page, i, l[i] AS x FROM l, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
    s AS (SELECT *, sum(CASE WHEN i > 1 AND {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY book, page ORDER BY i) AS section FROM e),
    g AS (SELECT book, page, section, string_agg(x, chr(10) ORDER BY i) AS t FROM s GROUP BY ALL)
    SELECT book, page, count(*) AS sections, sum(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM g WHERE regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY book, page""",
)
def heading_sections(spark, sf_dir):
    atoms = chunk.heading_atoms(A.pages(spark, sf_dir))
    return atoms.groupBy("book", "page").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.size(F.filter(F.split("atom", r"\s+"), lambda w: w != ""))).alias("words"))


_ARTICLE = "concat(text, chr(10), 'Methods', chr(10), text, chr(10), 'RESULTS:', chr(10), CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE reverse(text) END)"


@plan.query(
    "plain_sections",
    "WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE reverse(coalesce(text, '')) END, '^\\s+|\\s+$', '', 'g') AS r FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, 0 AS k, 'other' AS section, a AS c FROM t UNION ALL SELECT doc_id, 1, 'methods', a FROM t UNION ALL SELECT doc_id, 2, 'results', r FROM t) SELECT doc_id AS work_id, section, length(c) AS chars FROM p WHERE length(c) >= 20",
)
def plain_sections(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id AS work_id", f"{_ARTICLE} AS text")
    return clean.sections(d, ["methods", "results", "discussion"]).select("work_id", "section", F.length("content").alias("chars"))


@plan.query("low_confidence_tags", "SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w IN ('the', 'der', 'que', '?'))) AS flagged FROM documents")
def low_confidence_tags(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(rank.low_confidence("text", ["the", "der", "que", "?"])).alias("flagged"))


@plan.query("evidence_tiers", "SELECT doc_id, CASE WHEN source = 'web' THEN 1 WHEN lang = 'de' THEN 2 WHEN lang = 'en' THEN 4 ELSE 3 END AS tier, CAST(nullif(regexp_extract(coalesce(text, ''), '\\b((?:19|20)[0-9]{2})\\b', 1), '') AS INT) AS year FROM documents")
def evidence_tiers(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    types = F.array_compact(F.array(F.initcap("source"), F.upper("lang")))
    return d.select("doc_id", rank.publication_tier(types, {"web": 1, "de": 2, "en": 4}).alias("tier"), rank.year_of("text").alias("year"))


# --- guards and cards -------------------------------------------------------------------------------------------------

GUARDS = rank.Guards(
    not_content=r"(?i)licensed under|\bno\b[^.]*\bshown\b",
    scans=["token"],
    angles=["@"],
    sides={"north": (["the ", "tion"], ["src1"]), "south": (["der ", "sch"], ["src3"])},
    own=[["zzz", "ñ"]],
    own_of={"north": [["hand"]]},
    opposed={"north": [(["ing"], ["ble"])], "south": [(["heit"], ["keit"])]},
    levels={"l1": ["ung"], "l2": ["lich"], "l3": ["ver"]},
    level_of="south",
    blocked=["l1", "l2"],
)


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _guard_sql() -> str:
    only = lambda c, yes, no: f"({_any(c, yes)} AND NOT {_any(c, no)})"
    (n, nb), (s, sb) = GUARDS.sides.values()
    on_n, on_s = only("top", n, s), only("top", s, n)
    across = f"(({on_n}) AND ({only('cap', s, n)} OR {_any('shelf', sb)})) OR (({on_s}) AND ({only('cap', n, s)} OR {_any('shelf', nb)}))"
    own = " OR ".join(f"({_any('cap', g)} AND NOT {_any('top', g)})" for g in GUARDS.own)
    own += f" OR ({_any('top', n)} AND {_any('cap', ['hand'])} AND NOT {_any('top', ['hand'])})"
    pair = lambda a, b: f"(({only('top', a, b)} AND {only('cap', b, a)}) OR ({only('top', b, a)} AND {only('cap', a, b)}))"
    compartment = f"({_any('top', n)} AND {pair(['ing'], ['ble'])}) OR ({_any('top', s)} AND {pair(['heit'], ['keit'])})"
    level = f"{_any('top', s)} AND (" + " OR ".join(f"({_any('page', GUARDS.levels[k])} AND NOT {_any('top', GUARDS.levels[k])})" for k in GUARDS.blocked) + ")"
    first = f"WHEN regexp_matches(caption, '{GUARDS.not_content}') THEN 'no content'"
    strict = f"CASE {first} WHEN {_any('cap', GUARDS.angles)} THEN 'angle' WHEN {across} THEN 'side' END"
    full = f"CASE {first} WHEN {_any('cap', GUARDS.scans)} THEN 'scan' WHEN {_any('cap', GUARDS.angles)} THEN 'angle' WHEN {across} THEN 'side' WHEN {own} THEN 'own' WHEN {compartment} THEN 'compartment' WHEN {level} THEN 'level' END"
    return f"WITH d AS (SELECT doc_id, coalesce(substr(text, 1, length(text) // 2), '') AS caption, lower(coalesce(substr(text, length(text) // 2 + 1), '')) AS top, lower(coalesce(source, '')) AS shelf, coalesce(lang, '') AS lang FROM documents), e AS (SELECT *, lower(caption) AS cap, concat(lower(caption), ' ', lang, 'lich') AS page FROM d) SELECT doc_id, {full} AS reason, {strict} AS strict_reason FROM e"


@plan.query("figures_guarded", _guard_sql())
def figures_guarded(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").selectExpr("doc_id", "substr(text, 1, length(text) div 2) AS caption", "substr(text, length(text) div 2 + 1) AS topic", "source AS book", "concat(coalesce(lang, ''), 'lich') AS context")
    return d.select("doc_id", rank.off_topic("topic", "caption", GUARDS, "book", "context").alias("reason"), rank.off_topic("topic", "caption", GUARDS, "book", strict=True).alias("strict_reason"))


@plan.query(
    "cards_retrieved",
    _HYBRID_SQL
    + f""", h0 AS (SELECT f.query_id, f.id, q.query, d.text, round(coalesce(len(list_intersect({_CONTENT.format('q.query')}, {_CONTENT.format('d.text')})) / nullif(len({_CONTENT.format('q.query')}), 0), 0), 6) AS score FROM fused0 f JOIN documents d ON d.doc_id = f.id JOIN queries0 q USING (query_id)),
    s0 AS (SELECT query_id, id, round(score + 0.05 * len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP_SQL}))), regexp_extract_all(lower(text), '[a-z0-9]+'))), 6) AS score FROM h0 WHERE NOT regexp_matches(lower(text), '\\b[ctls][0-9]') OR NOT regexp_matches(lower(query), '\\b[ctls][0-9]')),
    b0 AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM s0)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b0 WHERE m <= 0 OR score >= 0.5 * m QUALIFY rank <= 8""".replace("s0 AS (SELECT query_id, id, round(score", "rs0 AS (SELECT query_id, id, round(score").replace("FROM s0)", "FROM rs0)"),
)
def cards_retrieved(spark, sf_dir):
    docs, v, q = hybrid_inputs(spark, sf_dir)
    return rank.retrieved_cards(docs, v, q, 8, index=text_index(spark, sf_dir, "documents"), keep_ratio=0.5).select("query_id", "id", "score", "rank")


@plan.query("axis_queries", "SELECT item_id AS query_id, a.axis AS axis, regexp_replace(concat_ws(' ', text, nullif(a.suffix, '')), '^\\s+|\\s+$', '', 'g') AS query FROM benchmark, (SELECT unnest([{'axis': 'plain', 'suffix': ''}, {'axis': 'therapy', 'suffix': 'AND therapy[filter]'}, {'axis': 'outcome', 'suffix': 'AND outcome[filter]'}]) AS a)")
def axis_queries(spark, sf_dir):
    q = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rank.by_axis(q, {"plain": "", "therapy": "AND therapy[filter]", "outcome": "AND outcome[filter]"})


@plan.query(
    "literature_boosted",
    "WITH h AS (SELECT user_id % 40 AS query_id, event_type AS axis, event_id % 23 + 1 AS rank, event_id % 97 AS pmid, event_id % 97 % 4 + 1 AS tier, 2000 + event_id % 97 % 25 AS year FROM events), o AS (SELECT query_id, pmid, min(rank) AS rank, any_value(tier) AS tier, any_value(year) AS year FROM h GROUP BY ALL), b AS (SELECT *, greatest(1, rank - CASE WHEN pmid % 10 = 0 THEN 5 ELSE 0 END) AS r FROM o) SELECT query_id, pmid, row_number() OVER (PARTITION BY query_id ORDER BY (r - 1) // 5, tier, CASE WHEN 2020 - year <= 5 THEN 0 ELSE 1 END, year DESC NULLS LAST, pmid) AS place FROM b QUALIFY place <= 12",
)
def literature_boosted(spark, sf_dir):
    h = A.table(spark, sf_dir, "events").selectExpr("user_id % 40 AS query_id", "event_type AS axis", "event_id % 23 + 1 AS rank", "event_id % 97 AS pmid", "event_id % 97 % 4 + 1 AS tier", "2000 + event_id % 97 % 25 AS year")
    return rank.literature(h, 2020, 12, boost=F.when(F.col("pmid") % 10 == 0, 1).otherwise(0)).select("query_id", "pmid", "place")


# --- invariants and audits --------------------------------------------------------------------------------------------


@plan.query(
    "chapter_agreement",
    f"WITH {A.PAGES_SQL}, n AS (SELECT nullif(regexp_extract(coalesce(text, ''), 'CHAPTER ([0-9]{{1,3}})\\b', 1), '') AS said, nullif(regexp_extract(concat('Chapter ', doc_id % 41 + 2), '(?:Chapter |^)([0-9]{{1,3}})\\b', 1), '') AS lab FROM pages0 WHERE regexp_matches(book, '^b[0-9]+$')) SELECT count(*) AS labelled, round(avg((said = lab)::INT), 4) AS agreement FROM n WHERE said IS NOT NULL AND lab IS NOT NULL",
)
def chapter_agreement(spark, sf_dir):
    p = A.pages(spark, sf_dir).withColumn("chapter", F.concat(F.lit("Chapter "), (F.col("doc_id") % 41 + 2).cast("string")))
    return clean.label_agreement(p, "^b[0-9]+$")


@plan.query("weak_folios", f"WITH {A.PAGES_SQL}, c AS (SELECT book, CASE WHEN (page % 8 > 0) = (doc_id // 500 % 2 = 0) THEN page END AS f FROM pages0 WHERE book <> 'b3'), g AS (SELECT book, round(avg((f IS NOT NULL)::INT), 4) AS folio FROM c GROUP BY book) SELECT * FROM g WHERE folio < 0.9")
def weak_folios(spark, sf_dir):
    p = A.pages(spark, sf_dir).withColumn("printed_page", F.expr("CASE WHEN (page % 8 > 0) = (doc_id div 500 % 2 = 0) THEN page END"))
    return clean.weak_folios(p, ["b3"])


@plan.query("short_chunks", f"{_WINDOWS_SQL} SELECT count(*) AS short FROM chunks0 WHERE doc_id % 3 > 0 AND doc_id % 4 > 0 AND length(text) < 400")
def short_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("caption", F.when(F.col("doc_id") % 4 == 0, "a caption"))
    return clean.short_chunks(c, 400)


_MARKERS = ["zzz", "chapter 12"]


@plan.query(
    "audit_verdict",
    f"""WITH {A.PAGES_SQL}, a AS (SELECT book AS b, 5 AS boundary, count(*) AS deletable, book <> 'b1' AS pure FROM pages0 WHERE page >= 5 GROUP BY book),
    h AS (SELECT DISTINCT book, page FROM pages0 WHERE (contains(lower(text), 'zzz') OR contains(lower(text), 'chapter 12')) AND page < 5)
    SELECT coalesce(sum(deletable) FILTER (pure), 0)::BIGINT AS deletable, count(*) FILTER (pure AND deletable > 0) AS books, count(*) FILTER (NOT pure) AS impure, (SELECT count(*) FROM h) AS marker_hits, CASE WHEN coalesce(sum(deletable) FILTER (pure), 0) > 0 OR count(*) FILTER (NOT pure) > 0 THEN 'dirty' ELSE 'clean' END AS verdict FROM a""",
)
def audit_verdict(spark, sf_dir):
    p = A.pages(spark, sf_dir)
    audit = p.where("page >= 5").groupBy("book").agg(F.count(F.lit(1)).alias("deletable")).select("book", F.lit(5).alias("boundary"), "deletable", (F.col("book") != "b1").alias("pure"))
    return clean.audit_verdict(audit, clean.marker_hits(p, audit, _MARKERS))


# --- saved runs, sheets and logs --------------------------------------------------------------------------------------


@plan.query("runs_rescored", _GROUNDED_SQL + ", a0 AS (SELECT answer_id FROM answers0 WHERE answer_id % 4 <> 0 AND regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g') <> ''), t0 AS (SELECT count(*) AS answers, coalesce(sum(n_cited), 0)::BIGINT AS cited, coalesce(sum(n_unsupported), 0)::BIGINT AS unsupported FROM a0 LEFT JOIN g1 USING (answer_id)) SELECT answers, cited, unsupported, round(1 - unsupported / nullif(cited, 0), 4) AS groundedness, round(unsupported / nullif(cited, 0), 4) AS unsupported_rate FROM t0")
def runs_rescored(spark, sf_dir):
    runs = A.answers(spark, sf_dir).withColumn("status", F.when(F.col("answer_id") % 4 == 0, "engine_error").otherwise("completed"))
    return verify.rescored(runs, A.premises(spark, sf_dir), SUFFIX)


@plan.query("sheet_order", "WITH q AS (SELECT DISTINCT user_id // 2 AS question FROM events), h AS (SELECT DISTINCT user_id // 2 AS question FROM events WHERE event_type = 'error' AND value > 60) SELECT question, CASE WHEN h.question IS NULL THEN 'easy' ELSE 'HARD' END AS tier, row_number() OVER (ORDER BY h.question IS NULL, CAST(q.question AS VARCHAR)) - 1 AS place FROM q LEFT JOIN h USING (question)")
def sheet_order(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").selectExpr("user_id div 2 AS question", "event_type", "value")
    return evaluate.pair_order(e, e.where("event_type = 'error' AND value > 60"))


@plan.query("grading_drift", "WITH g AS (SELECT user_id // 2 AS question, arg_max(CAST(floor(value) AS BIGINT) % 101, event_id) FILTER (user_id % 2 = 0) AS f, arg_max(CAST(floor(value) AS BIGINT) % 101, event_id) FILTER (user_id % 2 = 1) AS o FROM events GROUP BY 1), m AS (SELECT count(*) AS questions, round(avg(o), 4) AS original, round(avg(f), 4) AS fresh FROM g WHERE f IS NOT NULL AND o IS NOT NULL) SELECT *, round(fresh - original, 4) AS drift, coalesce(abs(round(fresh - original, 4)) > 5, false) AS warning FROM m")
def grading_drift(spark, sf_dir):
    last = evaluate.last_of(A.grades(spark, sf_dir), ["question", "arm"], "ordinal")
    return evaluate.drift(last.where("arm = 'arm0'"), last.where("arm = 'arm1'"))


_LOGS = "event_id AS question_id, event_type AS question, CASE WHEN event_type = 'error' THEN 'engine_error' ELSE 'completed' END AS status, event_id % 3 + 1 AS attempts, CASE WHEN user_id % 7 = 0 THEN concat('v', user_id % 3) END AS selected_variant"


@plan.query("error_log", f"WITH r AS (SELECT {_LOGS} FROM events) SELECT question_id, status, attempts FROM r WHERE status <> 'completed'")
def error_log(spark, sf_dir):
    return evaluate.run_logs(A.table(spark, sf_dir, "events").selectExpr(*A._split(_LOGS)))[0]


@plan.query("disambiguation_log", f"WITH r AS (SELECT {_LOGS} FROM events) SELECT question_id, question, selected_variant, status FROM r WHERE selected_variant IS NOT NULL")
def disambiguation_log(spark, sf_dir):
    return evaluate.run_logs(A.table(spark, sf_dir, "events").selectExpr(*A._split(_LOGS)))[1]


@plan.query(
    "gate_metric_set",
    _GROUNDED_SQL
    + """, b0 AS (SELECT conv_id AS case_id, count(DISTINCT role) AS sections, bool_or(contains(lower(text), 'license')) AS red FROM conversations GROUP BY conv_id)
    SELECT 'attribution_precision' AS metric, round(1 - sum(n_unsupported) / sum(n_cited), 6) AS value FROM g1 UNION ALL
    SELECT 'answers_grounded', round(avg((n_unsupported = 0)::INT), 6) FROM g1 WHERE n_cited > 0 UNION ALL
    SELECT 'section_coverage', round(avg(sections / 2), 6) FROM b0 UNION ALL
    SELECT 'red_flags', count(*) FILTER (red)::DOUBLE FROM b0 UNION ALL
    SELECT 'repeated_turns', round(1 - count(DISTINCT text) / count(*), 6) FROM conversations""",
)
def gate_metric_set(spark, sf_dir):
    """Attribution, groundedness, sections, red flags and repeats of the conversations, in the gate's long form."""
    c = A.table(spark, sf_dir, "conversations")
    g = verify.groundedness(verify.verified(A.answers(spark, sf_dir), A.premises(spark, sf_dir), SUFFIX))
    boards = c.groupBy("conv_id").agg(F.countDistinct("role").alias("sections"), F.max(F.contains(F.lower("text"), F.lit("license"))).alias("red"))
    return structure.metric_set(
        {
            "attribution_precision": (g, F.round(1 - F.sum("n_unsupported") / F.sum("n_cited"), 6)),
            "answers_grounded": (g.where("n_cited > 0"), F.round(F.avg((F.col("n_unsupported") == 0).cast("double")), 6)),
            "section_coverage": (boards, F.round(F.avg(F.col("sections") / 2), 6)),
            "red_flags": (boards, F.count_if("red")),
            "repeated_turns": (c, F.round(1 - F.countDistinct("text") / F.count(F.lit(1)), 6)),
        }
    )


# Cases are conversations. Their dictation is the first turn, with a side and a level by a rule; each sentence of a later turn is a
# claim, cited by place; a figure is asked of each.
_SIDE, _LEVEL = "CASE conv_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE '' END", "CASE WHEN conv_id % 2 = 0 THEN 'C5-6' ELSE '' END"
_CASE = f"conv_id AS case_id, concat(text, CASE WHEN conv_id % 3 < 2 THEN concat(' Seen on the ', {_SIDE}, ' side.') ELSE '' END, CASE WHEN conv_id % 2 = 0 THEN ' At C5-6.' ELSE '' END) AS dictation, CASE WHEN conv_id % 7 = 0 THEN 'bilateral' ELSE {_SIDE} END AS laterality, CASE WHEN conv_id % 11 = 0 THEN 'T1' ELSE {_LEVEL} END AS level, substr(text, 1, 12 + 30 * (conv_id % 2)) AS read_goal, substr(text, 3, 20) AS goal, substr(text, 5, 3) AS phrase"
_CLAIM = "case_id, (turn + k) % 4 AS n, concat('s', (turn + k) % 4) AS section, concat('f', k % 3) AS slot, turn * 1000 + k AS id, concat(s, CASE WHEN (turn + k) % 5 > 0 THEN ' [1]' ELSE ' [L2]' END) AS text, CASE WHEN k % 2 = 0 THEN concat('p', case_id % 10) END AS pmid, k"
_GATE_SQL = f"""WITH cases0 AS (SELECT {_CASE} FROM conversations WHERE turn = 0), claims00 AS (SELECT conv_id AS case_id, turn, string_split(text, '. ') AS p FROM conversations WHERE turn > 0),
  claims01 AS (SELECT {_CLAIM} FROM (SELECT case_id, turn, k, p[k + 1] AS s FROM claims00, LATERAL (SELECT unnest(range(0, len(p))) AS k))),
  claims0 AS (SELECT 'gt' AS context, * FROM claims01 UNION ALL SELECT 'det', * FROM claims01 WHERE k % 2 = 0)"""


def _gate_tables(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    cases = c.where("turn = 0").selectExpr(*A._split(_CASE))
    said = c.where("turn > 0").selectExpr("conv_id AS case_id", "turn", "posexplode(split(text, '[.] ')) AS (k, s)").selectExpr(*A._split(_CLAIM))
    claims = said.withColumn("context", F.lit("gt")).unionByName(said.where("k % 2 = 0").withColumn("context", F.lit("det")))
    return cases, claims


@plan.query(
    "gate_report",
    _GATE_SQL
    + """, n AS (SELECT count(*) AS n FROM cases0),
    side AS (SELECT case_id, CASE WHEN regexp_matches(lower(dictation), '\\bleft\\b') THEN 'left' WHEN regexp_matches(lower(dictation), '\\bright\\b') THEN 'right' ELSE '' END AS side, CASE WHEN contains(dictation, 'C5-6') THEN 'C5-6' ELSE '' END AS lev FROM cases0),
    det AS (SELECT case_id, count(DISTINCT section) = 4 AS ok FROM claims0 WHERE context = 'det' GROUP BY 1), gt AS (SELECT case_id, count(DISTINCT section) = 4 AS ok FROM claims0 WHERE context = 'gt' GROUP BY 1),
    facet AS (SELECT case_id, count(DISTINCT concat(section, slot)) FILTER (section IN ('s0', 's1') AND slot IN ('f0', 'f1')) = 4 AS ok FROM claims0 WHERE context = 'gt' GROUP BY 1),
    lit AS (SELECT case_id, count(DISTINCT section) FILTER (section IN ('s1', 's2')) = 2 AND bool_and(pmid <> 'p3') AS ok FROM claims0 WHERE context = 'gt' AND pmid IS NOT NULL GROUP BY 1),
    el AS (SELECT case_id, section, contains(text, '[1]') AS cites FROM claims0 WHERE context = 'gt' AND section IN ('s0', 's1', 's3')), cn AS (SELECT case_id, count(DISTINCT section) FILTER (cites) = 3 AS ok FROM el GROUP BY 1),
    tk AS (SELECT case_id, id, section, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM claims0 WHERE context = 'gt'),
    dup AS (SELECT count(*) AS pairs FROM tk a JOIN tk b ON a.case_id = b.case_id AND a.id < b.id AND a.section <> b.section WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.72),
    red AS (SELECT count(*) AS hits FROM (SELECT DISTINCT case_id, phrase FROM cases0 JOIN claims0 USING (case_id) WHERE contains(lower(concat(section, chr(10), text)), lower(phrase)))),
    share AS (SELECT 'section_coverage_det' AS metric, count(*) FILTER (ok) AS k FROM det UNION ALL SELECT 'section_coverage_gt', count(*) FILTER (ok) FROM gt UNION ALL SELECT 'facet_coverage', count(*) FILTER (ok) FROM facet UNION ALL SELECT 'lit_coverage', count(*) FILTER (ok) FROM lit UNION ALL SELECT 'corpus_n_coverage', count(*) FILTER (ok) FROM cn
      UNION ALL SELECT 'intake_side_acc', count(*) FILTER (side = laterality) FROM cases0 JOIN side USING (case_id) UNION ALL SELECT 'intake_level_acc', count(*) FILTER (lev = level) FROM cases0 JOIN side USING (case_id) UNION ALL SELECT 'intake_goal_acc', count(*) FILTER (trim(read_goal) <> '' AND contains(lower(read_goal), lower(goal))) FROM cases0 UNION ALL SELECT 'near_dup_rate', pairs FROM dup
      UNION ALL SELECT 'figure_archetype_acc', count(*) FILTER (case_id % 4 > 0) FROM cases0 UNION ALL SELECT 'figure_side_acc', count(*) FILTER (side = laterality) FROM cases0 JOIN side USING (case_id) UNION ALL SELECT 'figure_guard_reject', count(*) FROM cases0)
    SELECT metric, round(k / n, 6) AS value FROM share, n UNION ALL SELECT 'attribution_precision', round(avg(cites::INT), 6) FROM el UNION ALL SELECT 'red_flag_contamination', hits::DOUBLE FROM red""",
)
def gate_report(spark, sf_dir):
    """The gate's metrics over cases, boards and schematics made of the conversations."""
    cases, claims = _gate_tables(spark, sf_dir)
    read = tag.intake(cases.select("case_id", "dictation", F.col("read_goal").alias("goal")), "dictation")
    specs = structure.specifications(read.selectExpr("case_id", "'p' AS profile", "laterality AS side", "level"), {"p": "cross"}, {"p": "spine"})
    wanted = cases.selectExpr("case_id", "CASE WHEN case_id % 4 > 0 THEN 'cross' ELSE 'other' END AS archetype", "laterality AS side", "level")
    literature = claims.where("context = 'gt' AND pmid IS NOT NULL").select("case_id", "section", "pmid")
    known = spark.createDataFrame([(f"p{i}",) for i in range(10) if i != 3], "pmid string")
    facets = {"s0": ["f0", "f1"], "s1": ["f0", "f1"]}
    return gate.gate_metrics(read, cases.select("case_id", "laterality", "level", "goal"), claims, literature, cases.select("case_id", "phrase"), structure.conformance(specs, wanted), ["s0", "s1", "s2", "s3"], facets, ["s1", "s2"], ["s0", "s1", "s3"], known)


@plan.query("gate_passed", "SELECT metric, value, CASE WHEN metric IN ('near_dup_rate', 'red_flag_contamination') THEN value <= 0.25 ELSE value >= 0.25 END AS ok FROM (" + plan.sql["gate_report"] + ")")
def gate_passed(spark, sf_dir):
    """The gate over those metrics, each against a quarter."""
    baseline = spark.createDataFrame([(m, 0.25, d) for m, d in gate.DIRECTIONS.items()], "metric string, baseline double, direction string")
    return evaluate.quality_gate(gate_report(spark, sf_dir), baseline).select("metric", "value", "ok")


_CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(claim, '{p}') THEN '{name}'" for name, p in verify.CATEGORIES.items()) + " ELSE 'other' END"


@plan.query("claim_categories", _CLAIMS_SQL.replace("FROM conversations WHERE role = 'assistant')", "FROM conversations WHERE role = 'assistant')", 1) + f", k0 AS (SELECT concat(claim, CASE ord % 7 WHEN 1 THEN ' is contraindicated' WHEN 2 THEN ' was approved off-label' WHEN 3 THEN ' versus none' WHEN 4 THEN ' of 5 mg' WHEN 5 THEN ' is recommended' ELSE '' END) AS claim FROM claims0) SELECT {_CATEGORY_SQL} AS category, count(*) AS claims FROM k0 GROUP BY 1")
def claim_categories(spark, sf_dir):
    c = verify.claims(A.answers(spark, sf_dir)).selectExpr("concat(claim, CASE ord % 7 WHEN 1 THEN ' is contraindicated' WHEN 2 THEN ' was approved off-label' WHEN 3 THEN ' versus none' WHEN 4 THEN ' of 5 mg' WHEN 5 THEN ' is recommended' ELSE '' END) AS claim")
    return c.groupBy(verify.category(F.col("claim")).alias("category")).agg(F.count(F.lit(1)).alias("claims"))
