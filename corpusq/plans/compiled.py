"""Queries: compiling claims, near duplicates, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compile as C
from ..operators import verify
from ..sources import adapters as A
from .base import Plan
from .verified import _CLAIMS_SQL

plan = Plan()

# Claims of ten conversations are a board, so that boards do not grow with the data; every other turn is another section.
_BOARD_SQL = _CLAIMS_SQL + ", b0 AS (SELECT answer_id // 10000 AS board, answer_id * 100 + ord AS id, concat('s', answer_id % 3) AS section, plain AS text, CASE WHEN ord % 9 = 8 THEN 'quarantine' WHEN ord % 7 = 6 THEN 'off_target' ELSE 'open' END AS status FROM claims0)"


def board_claims(spark, sf_dir):
    c = verify.claims(A.answers(spark, sf_dir))
    return c.selectExpr("answer_id div 10000 AS board", "answer_id * 100 + ord AS id", "concat('s', answer_id % 3) AS section", "plain AS text", "CASE WHEN ord % 9 = 8 THEN 'quarantine' WHEN ord % 7 = 6 THEN 'off_target' ELSE 'open' END AS status")


_PAIRS_SQL = _BOARD_SQL + ", t0 AS (SELECT board, id, section, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM b0), p0 AS (SELECT a.board, a.id AS a, b.id AS b FROM t0 a JOIN t0 b ON a.board = b.board AND a.id < b.id AND a.section <> b.section AND len(a.t) > 0 AND len(b.t) > 0 WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.3)"


@plan.query("residual_pairs", _PAIRS_SQL + " SELECT board, count(*) AS pairs FROM p0 GROUP BY board")
def residual_pairs(spark, sf_dir):
    return C.residual_pairs(board_claims(spark, sf_dir), 0.3)


@plan.query("claims_collapsed")
def claims_collapsed(spark, sf_dir):
    """Whether a claim goes depends on whether earlier ones went; tested against the sequential rule."""
    return C.collapsed(board_claims(spark, sf_dir), 0.3)


@plan.query("cards_merged")
def cards_merged(spark, sf_dir):
    """As claims_collapsed."""
    return C.merged(board_claims(spark, sf_dir).selectExpr("board", "id", "text"), 0.5)


_COMPILED_SQL = (
    _BOARD_SQL
    + """, src AS (SELECT board, id, k AS s_ord, concat('t', (id + k * 7) % 11) AS title, (id + k) % 3 > 0 AS accepted, (id + k) % 5 > 0 AS good FROM b0, (SELECT unnest(range(0, 4)) AS k)),
    f AS (SELECT board, section, min(id) AS first FROM b0 GROUP BY ALL), c AS (SELECT b.*, row_number() OVER (PARTITION BY b.board ORDER BY CASE b.section WHEN 's2' THEN 1 WHEN 's0' THEN 2 ELSE 3 END, first, id) AS place FROM b0 b JOIN f ON f.board = b.board AND f.section = b.section),
    a AS (SELECT *, row_number() OVER (PARTITION BY board, id ORDER BY s_ord) AS r FROM src WHERE accepted), ok AS (SELECT a.*, place FROM a JOIN c USING (board, id) WHERE r <= 2 AND good),
    n AS (SELECT board, title, row_number() OVER (PARTITION BY board ORDER BY min(place * 10 + s_ord), title) AS n FROM ok GROUP BY board, title), ci AS (SELECT board, id, list_sort(list(DISTINCT n)) AS cites FROM ok JOIN n USING (board, title) GROUP BY ALL),
    comp0 AS (SELECT c.board, place, c.id, section, CASE WHEN status = 'off_target' THEN 'quarantine' WHEN len(coalesce(cites, [])) > 0 THEN 'supported' ELSE 'verify' END AS status, coalesce(cites, []) AS cites, text FROM c LEFT JOIN ci USING (board, id))"""
)


def _sources(spark, sf_dir):
    return board_claims(spark, sf_dir).select("board", "id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s_ord")).selectExpr("board", "id", "s_ord", "concat('t', (id + s_ord * 7) % 11) AS title", "(id + s_ord) % 3 > 0 AS accepted", "(id + s_ord) % 5 > 0 AS good")


def _compiled(spark, sf_dir):
    return C.compiled(board_claims(spark, sf_dir), _sources(spark, sf_dir), ["s2", "s0"], F.col("good"))


@plan.query("claims_compiled", _COMPILED_SQL + " SELECT board, place, id, section, status, cites FROM comp0")
def claims_compiled(spark, sf_dir):
    return _compiled(spark, sf_dir)


@plan.query("evidence_summary", _COMPILED_SQL + " SELECT board, count(*) AS total, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'verify') AS verify, count(*) FILTER (status = 'quarantine') AS quarantine FROM comp0 GROUP BY board")
def evidence_summary(spark, sf_dir):
    return C.evidence_summary(_compiled(spark, sf_dir))


@plan.query("source_titles", _COMPILED_SQL + " SELECT board, accepted, title, row_number() OVER (PARTITION BY board, accepted ORDER BY min(id * 10 + s_ord), title) AS n FROM src GROUP BY board, accepted, title QUALIFY n <= 5")
def source_titles(spark, sf_dir):
    return C.source_titles(_sources(spark, sf_dir), 5)


@plan.query("boards_rendered", _COMPILED_SQL + ", s AS (SELECT board, section, min(place) AS at0, concat('## ', section, chr(10), string_agg(concat(CASE WHEN status = 'supported' THEN '- [x] ' ELSE '- [ ] ' END, text), chr(10) ORDER BY place)) AS t FROM comp0 GROUP BY board, section) SELECT board, md5(concat('# board ', board, chr(10), chr(10), string_agg(t, chr(10) || chr(10) ORDER BY at0))) AS markdown_md5 FROM s GROUP BY board")
def boards_rendered(spark, sf_dir):
    rows = _compiled(spark, sf_dir).join(board_claims(spark, sf_dir).select("board", "id", "text"), ["board", "id"])
    return C.rendered(rows).select("board", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@plan.query(
    "references_assembled",
    "WITH c AS (SELECT user_id AS case_id, event_type AS section, concat(CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 'L' END, event_id % 9) AS ref FROM events), p AS (SELECT DISTINCT case_id, ref, concat('cite ', ref) AS citation FROM c WHERE right(ref, 1) <> '3') SELECT case_id, ref, citation, list_sort(list(DISTINCT section)) AS sections, row_number() OVER (PARTITION BY case_id ORDER BY left(ref, 1), CAST(substr(ref, 2) AS INT), ref) AS n FROM c JOIN p USING (case_id, ref) GROUP BY case_id, ref, citation",
)
def references_assembled(spark, sf_dir):
    c = A.table(spark, sf_dir, "events").selectExpr("user_id AS case_id", "event_type AS section", "concat(CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 'L' END, event_id % 9) AS ref")
    return C.references(c, c.where("right(ref, 1) <> '3'").selectExpr("case_id", "ref", "concat('cite ', ref) AS citation").distinct())


_FEEDBACK = "concat('p', user_id % 5) AS profile, CASE event_type WHEN 'click' THEN 'wrong' WHEN 'view' THEN 'important' WHEN 'purchase' THEN 'missing' ELSE 'other' END AS mark, concat('the ', event_type, ' of item', event_id % 6) AS text, CASE WHEN event_id % 4 > 0 THEN concat('topic', event_id % 3) END AS topic, event_id AS ord"
_PREFS_SQL = f"""WITH f AS (SELECT {_FEEDBACK} FROM events), t AS (SELECT *, CASE mark WHEN 'wrong' THEN 'suppress' WHEN 'important' THEN 'elevate' WHEN 'missing' THEN 'add' END AS action, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: length(w) >= 3 AND w <> 'the')), ' ') AS pattern FROM f),
prefs0 AS (SELECT profile, action, pattern, arg_min(text, ord) AS text, count(*) AS weight, list(topic ORDER BY ord) FILTER (topic IS NOT NULL) AS s FROM t WHERE action IS NOT NULL AND pattern <> '' GROUP BY ALL)"""


def feedback(spark, sf_dir):
    return A.table(spark, sf_dir, "events").selectExpr(*A._split(_FEEDBACK))


@plan.query("preferences", _PREFS_SQL + " SELECT profile, action, pattern, text, weight, list_filter(coalesce(s, []), lambda x, i: list_position(s, x) = i) AS sources FROM prefs0")
def preferences(spark, sf_dir):
    return C.distilled(feedback(spark, sf_dir))


@plan.query(
    "preferences_applied",
    _PREFS_SQL
    + """, c AS (SELECT user_id AS board, concat('p', user_id % 5) AS profile, event_id AS id, concat(event_type, ' seen of item', event_id % 4) AS text FROM events), pr AS (SELECT * REPLACE (CASE WHEN length(pattern) % 2 = 0 THEN 1 ELSE weight END AS weight) FROM prefs0),
    h AS (SELECT c.board, c.id, action, weight, pattern FROM c JOIN pr ON pr.profile = c.profile AND len(list_filter(string_split(pattern, ' '), lambda w: NOT list_contains(regexp_extract_all(lower(c.text), '[a-z0-9]+'), w))) = 0),
    g AS (SELECT board, id, bool_or(action = 'suppress' AND weight >= 2) AS gone, bool_or(action = 'suppress' AND weight < 2) AS last, bool_or(action = 'elevate') AS first FROM h GROUP BY ALL),
    k AS (SELECT c.*, coalesce(last, false)::INT AS last, coalesce(first, false) AS first, 0 AS new FROM c LEFT JOIN g USING (board, id) WHERE NOT coalesce(gone, false)),
    al AS (SELECT DISTINCT h.board, pattern FROM h JOIN g USING (board, id) WHERE NOT gone AND action = 'add'),
    ad AS (SELECT b.board, b.profile, 1099511627776 AS id, pr.text, 0 AS last, false AS first, 1 AS new FROM (SELECT DISTINCT board, profile FROM c) b JOIN pr ON pr.profile = b.profile AND action = 'add' WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.board = b.board AND al.pattern = pr.pattern)),
    u AS (SELECT board, profile, id, text, last, first, new FROM k UNION ALL SELECT * FROM ad)
    SELECT board, row_number() OVER (PARTITION BY board ORDER BY first DESC, new, last, id, text) AS place, id, text FROM u""",
)
def preferences_applied(spark, sf_dir):
    c = A.table(spark, sf_dir, "events").selectExpr("user_id AS board", "concat('p', user_id % 5) AS profile", "event_id AS id", "concat(event_type, ' seen of item', event_id % 4) AS text")
    p = C.distilled(feedback(spark, sf_dir)).withColumn("weight", F.expr("CASE WHEN length(pattern) % 2 = 0 THEN 1 ELSE weight END"))
    return C.preferred(c, p)


@plan.query("other_features", "WITH e AS (SELECT DISTINCT user_id AS key, event_type AS feature FROM events) SELECT e.key, e.feature, list_filter(a.f, lambda x: x <> e.feature) AS others FROM e JOIN (SELECT key, list_sort(list(feature)) AS f FROM e GROUP BY key) a USING (key)")
def other_features(spark, sf_dir):
    return C.other_features(A.table(spark, sf_dir, "events").selectExpr("user_id AS key", "event_type AS feature"))


@plan.query(
    "cards_patched",
    "WITH c AS (SELECT user_id AS board, event_id AS id, concat('Ask about ', event_type, ' ', event_id % 7) AS question FROM events), f AS (SELECT DISTINCT user_id AS board, k AS f_ord, concat('ASK ABOUT ', ['click', 'view', 'view'][k + 1]) AS match, concat('fixed ', k) AS fixed FROM events, (SELECT unnest(range(0, 3)) AS k)), a AS (SELECT c.board, f_ord, fixed, min(id) AS id FROM c JOIN f ON c.board = f.board AND contains(lower(question), lower(match)) GROUP BY ALL), l AS (SELECT board, id, arg_max(fixed, f_ord) AS fixed FROM a GROUP BY ALL) SELECT c.board, c.id, coalesce(fixed, question) AS question FROM c LEFT JOIN l USING (board, id)",
)
def cards_patched(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    c = e.selectExpr("user_id AS board", "event_id AS id", "concat('Ask about ', event_type, ' ', event_id % 7) AS question")
    f = e.selectExpr("user_id AS board").distinct().selectExpr("board", "explode(sequence(0, 2)) AS f_ord").selectExpr("board", "f_ord", "concat('ASK ABOUT ', element_at(array('click', 'view', 'view'), f_ord + 1)) AS match", "concat('fixed ', f_ord) AS question")
    return C.patched(c, f)


@plan.query("templates_first", "WITH t AS (SELECT user_id % 20 AS board, event_type AS slot, min(event_id) AS card FROM events WHERE event_id % 2 = 0 AND user_id % 3 = 0 GROUP BY ALL), g AS (SELECT user_id % 20 AS board, event_type AS slot, min(event_id) + 1000000 AS card FROM events GROUP BY ALL) SELECT g.board, g.slot, coalesce(t.card, g.card) AS card FROM g LEFT JOIN t USING (board, slot)")
def templates_first(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    t = e.where("event_id % 2 = 0 and user_id % 3 = 0").groupBy((F.col("user_id") % 20).alias("board"), F.col("event_type").alias("slot")).agg(F.min("event_id").alias("card"))
    g = e.groupBy((F.col("user_id") % 20).alias("board"), F.col("event_type").alias("slot")).agg((F.min("event_id") + 1000000).alias("card"))
    return C.with_templates(t, g, ["board", "slot"])


@plan.query("provenance", "WITH b AS (SELECT user_id AS board, user_id % 4 > 0 AS enabled, user_id % 5 = 0 AS failed, count(*) AS n_cards FROM events GROUP BY ALL), r AS (SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN failed THEN 'error' WHEN n_cards < 60 THEN 'under-produced' END AS reason FROM b) SELECT *, enabled AND reason IS NOT NULL AS degraded, CASE WHEN reason IS NULL THEN 'generated' ELSE 'templates' END AS source FROM r")
def provenance(spark, sf_dir):
    b = A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("board")).agg(F.count(F.lit(1)).alias("n_cards")).selectExpr("board", "board % 4 > 0 AS enabled", "board % 5 = 0 AS failed", "n_cards")
    return C.provenance(b, 60)
