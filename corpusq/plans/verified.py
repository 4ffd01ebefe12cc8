"""Queries: claims and their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, verify
from ..sources import adapters as A
from .base import Plan
from .searched import _CONTENT

plan = Plan()

# The data have no clinical words, so entities are words with endings that occur.
SUFFIX = r"(tion|heit|ción|ment)$"
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_CLAIMS_SQL = (
    f"WITH {A.ANSWERS_SQL}, {A.PREMISES_SQL}, s0 AS (SELECT answer_id, {_SENTENCES.format('answer')} AS l FROM answers0), "
    "claims0 AS (SELECT answer_id, CAST(i - 1 AS INT) AS ord, l[i] AS claim, regexp_extract_all(l[i], '\\[((?:L|D)?[0-9]+)\\]', 1) AS markers, regexp_replace(regexp_replace(l[i], '\\[((?:L|D)?[0-9]+)\\]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS plain FROM s0, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"
)


@plan.query("claims", _CLAIMS_SQL + " SELECT answer_id, ord, claim, markers, plain FROM claims0")
def claims(spark, sf_dir):
    return verify.claims(A.answers(spark, sf_dir))


_SING = "CASE WHEN ends_with({0}, 's') AND length({0}) > 3 THEN left({0}, length({0}) - 1) ELSE {0} END"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_ENT = "list_distinct(list_filter(" + _TOK + ", lambda t: length(t) >= 6 AND regexp_matches(t, '" + SUFFIX + "')))"
_VERIFIED_SQL = (
    _CLAIMS_SQL
    + ", m0 AS (SELECT answer_id, ord, k, markers[k] AS marker FROM claims0, LATERAL (SELECT unnest(range(1, len(markers) + 1)) AS k)), "
    "prem0 AS (SELECT m.answer_id, m.ord, string_agg(premise, ' ' ORDER BY k) AS premise FROM m0 m JOIN premises0 p ON m.answer_id = p.answer_id AND m.marker = p.marker WHERE premise IS NOT NULL AND premise <> '' GROUP BY ALL), "
    f"v0 AS (SELECT c.*, coalesce(p.premise, '') AS premise, {_CONTENT.format('c.plain')} AS h, {_CONTENT.format('p.premise')} AS p FROM claims0 c LEFT JOIN prem0 p ON c.answer_id = p.answer_id AND c.ord = p.ord), "
    f"w0 AS (SELECT *, CASE WHEN len(markers) > 0 AND len(p) >= 5 THEN list_sort(list_filter({_ENT.format('plain')}, lambda e: NOT list_contains(list_transform({_TOK.format('premise')}, lambda t: {_SING.format('t')}), {_SING.format('e')}))) ELSE [] END AS bleed_terms, "
    f"coalesce(list_max(list_transform({_SENTENCES.format('premise')}, lambda s: CASE WHEN len({_CONTENT.format('s')}) >= 5 THEN len(list_intersect(h, {_CONTENT.format('s')})) / len({_CONTENT.format('s')}) ELSE 0 END)), 0) AS best FROM v0), "
    "x0 AS (SELECT *, len(markers) = 0 OR ((len(p) < 5 OR len(h) = 0 OR (coalesce(len(list_intersect(p, h)) / nullif(len(h), 0), 0) >= 0.18 AND best >= 0.2)) AND len(bleed_terms) = 0) AS supported FROM w0)"
)


def _verified(spark, sf_dir):
    return verify.verified(A.answers(spark, sf_dir), A.premises(spark, sf_dir), SUFFIX)


@plan.query("verified_claims", _VERIFIED_SQL + " SELECT answer_id, ord, supported, length(premise) AS premise_chars, bleed_terms FROM x0")
def verified_claims(spark, sf_dir):
    return _verified(spark, sf_dir).select("answer_id", "ord", "supported", "premise_chars", "bleed_terms")


_GROUNDED_SQL = (
    _VERIFIED_SQL
    + ", g0 AS (SELECT answer_id, count(*) FILTER (len(markers) > 0) AS n_cited, count(*) FILTER (len(markers) > 0 AND NOT supported) AS n_unsupported, "
    "flatten(coalesce(list(markers ORDER BY ord) FILTER (len(markers) > 0 AND NOT supported), [])) AS um, flatten(coalesce(list(bleed_terms ORDER BY ord) FILTER (len(bleed_terms) > 0), [])) AS bt FROM x0 GROUP BY answer_id), "
    "g1 AS (SELECT *, list_filter(um, lambda x, i: list_position(um, x) = i) AS unsupported_markers, list_filter(bt, lambda x, i: list_position(bt, x) = i) AS bleed FROM g0)"
)


@plan.query("groundedness", _GROUNDED_SQL + " SELECT answer_id, n_cited, n_unsupported, unsupported_markers, bleed AS bleed_terms, round(1 - n_unsupported / nullif(n_cited, 0), 6) AS groundedness, concat_ws(chr(10), CASE WHEN n_unsupported > 0 THEN concat(n_unsupported, ' cited claim(s) need verification: ', array_to_string(list_transform(unsupported_markers, lambda m: concat('[', m, ']')), ', ')) END, CASE WHEN len(bleed) > 0 THEN concat('not in the cited source: ', array_to_string(bleed, ', ')) END) AS notice FROM g1")
def groundedness(spark, sf_dir):
    return verify.groundedness(_verified(spark, sf_dir))


@plan.query("groundedness_summary", _GROUNDED_SQL + " SELECT count(*) AS answers_scored, count(*) FILTER (n_unsupported > 0) AS with_unsupported, coalesce(sum(n_cited), 0) AS cited, coalesce(sum(n_unsupported), 0) AS unsupported, round(1 - coalesce(avg(n_unsupported / n_cited), 0), 4) AS mean_groundedness FROM g1 WHERE n_cited > 0")
def groundedness_summary(spark, sf_dir):
    return evaluate.groundedness_summary(verify.groundedness(_verified(spark, sf_dir)))


def _quotes(spark, sf_dir):
    """Quotes of a turn, one for each 60 letters of it: as they stand, with other letters at the end, or with the middle cut out."""
    q = A.table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS answer_id", "text AS premise", "posexplode(transform(sequence(1, greatest(1, length(text)), 60), i -> substr(text, i, 60))) AS (k, part)")
    return q.selectExpr("answer_id", "k", "premise", "CASE WHEN answer_id % 3 = 0 THEN replace(part, ' ', '  ') WHEN answer_id % 3 = 1 THEN concat(substr(part, 1, 50), 'zzz') ELSE concat(substr(part, 1, 15), 'qq', substr(part, 40)) END AS quote")


@plan.query("quote_matches")
def quote_matches(spark, sf_dir):
    """The longest common run follows Python's difflib, which SQL has not."""
    return verify.matched_quotes(_quotes(spark, sf_dir)).select("answer_id", "k", F.round("score", 4).alias("score"), "matched")


@plan.query(
    "quotes_verbatim",
    "WITH q0 AS (SELECT conv_id * 1000 + turn AS answer_id, text AS premise, unnest(list_transform(range(1, greatest(1, length(text)) + 1, 60), lambda i: substr(text, i, 60))) AS part FROM conversations), q AS (SELECT answer_id, premise, CASE answer_id % 3 WHEN 0 THEN part WHEN 1 THEN concat(substr(part, 1, 50), 'zzz') ELSE concat(substr(part, 1, 15), 'qq', substr(part, 40)) END AS part FROM q0), n AS (SELECT answer_id, lower(trim(regexp_replace(premise, '\\s+', ' ', 'g'))) AS p, lower(trim(regexp_replace(part, '\\s+', ' ', 'g'))) AS q FROM q) SELECT round(avg((q <> '' AND contains(p, q))::INT), 4) AS match_rate, count(*) AS spans FROM n",
)
def quotes_verbatim(spark, sf_dir):
    return verify.match_rate(verify.matched_quotes(_quotes(spark, sf_dir), 1.0))


_CAT = {"first": "(?i)tion", "second": "(?i)[aeo]n ", "threshold": "(?i)sch"}
_STRONG, _SOFT = "(?i)ing ", "(?i)er "
_REVIEW_SQL = (
    _CLAIMS_SQL
    + f", r0 AS (SELECT answer_id, ord, claim, ord % 4 <> 0 AS matched, CASE WHEN ord % 3 > 0 THEN 2010 + ord % 15 END AS year, CASE WHEN regexp_matches(claim, '{_CAT['first']}') THEN 'first' WHEN regexp_matches(claim, '{_CAT['second']}') THEN 'second' WHEN regexp_matches(claim, '{_CAT['threshold']}') THEN 'threshold' ELSE 'other' END AS category, "
    f"CASE WHEN regexp_matches(claim, '{_STRONG}') THEN 'strong' WHEN regexp_matches(claim, '{_SOFT}') THEN 'soft' END AS cue FROM claims0), "
    "r1 AS (SELECT *, CASE cue WHEN 'strong' THEN coalesce(2020 - year > 3, true) WHEN 'soft' THEN coalesce(2020 - year > 5, false) ELSE false END AS stale FROM r0), "
    "r2 AS (SELECT *, list_filter([CASE WHEN NOT matched THEN 'unmatched_span' END, CASE WHEN stale THEN 'stale_currency' END], lambda x: x IS NOT NULL) AS flags FROM r1)"
)


def _reviewed(spark, sf_dir):
    c = verify.claims(A.answers(spark, sf_dir)).selectExpr("answer_id", "ord", "claim", "ord % 4 <> 0 AS matched", "CASE WHEN ord % 3 > 0 THEN 2010 + ord % 15 END AS year")
    return verify.reviewed(c, 2020, _CAT, _STRONG, _SOFT)


@plan.query("reviewed_claims", _REVIEW_SQL + " SELECT answer_id, ord, category, flags, CASE WHEN len(flags) > 0 THEN 'uncertain' ELSE 'settled' END AS status FROM r2")
def reviewed_claims(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("answer_id", "ord", "category", "flags", "status")


@plan.query("decision_cards", _REVIEW_SQL + " SELECT answer_id, coalesce(list(claim ORDER BY ord) FILTER (len(flags) = 0 AND category IN ('first', 'second')), []) AS bottom_line, coalesce(list(claim ORDER BY ord) FILTER (len(flags) = 0 AND category = 'threshold'), []) AS furniture, coalesce(list(claim ORDER BY ord) FILTER (len(flags) > 0), []) AS uncertainties FROM r2 GROUP BY answer_id")
def decision_cards(spark, sf_dir):
    return verify.decision_cards(_reviewed(spark, sf_dir))


@plan.query(
    "evidence_grades",
    "WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 'supported' WHEN 'view' THEN 'needs_review' WHEN 'error' THEN 'off_target' ELSE 'no_evidence' END AS s, user_id % 3 AS n, event_id % 11 = 0 AS c, event_id % 13 = 0 AS p FROM events), g AS (SELECT CASE WHEN s = 'off_target' THEN 'unsupported' WHEN c THEN 'conflicting' WHEN p THEN 'attending-preference' WHEN s = 'supported' AND n >= 2 THEN 'multi-source' WHEN s = 'supported' THEN 'directly-supported' WHEN s = 'needs_review' THEN 'standard-practice' ELSE 'unsupported' END AS grade FROM e) SELECT grade, CASE WHEN grade IN ('directly-supported', 'multi-source') THEN 'supported' ELSE 'to_verify' END AS bucket, count(*) AS n FROM g GROUP BY ALL",
)
def evidence_grades(spark, sf_dir):
    status = F.expr("CASE event_type WHEN 'click' THEN 'supported' WHEN 'view' THEN 'needs_review' WHEN 'error' THEN 'off_target' ELSE 'no_evidence' END")
    g = A.table(spark, sf_dir, "events").withColumn("grade", verify.evidence_grade(status, F.col("user_id") % 3, F.col("event_id") % 11 == 0, F.col("event_id") % 13 == 0))
    return g.groupBy("grade", verify.grade_bucket(F.col("grade")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@plan.query(
    "verifier_confusion",
    "SELECT doc_id % 3 AS slice, count(*) AS n, count(*) FILTER (toxic = 1) AS flags, count(*) FILTER (toxic = 1 AND quality = 0) AS true_flags, count(*) FILTER (toxic <> 1 AND quality = 0) AS false_passes, round(count(*) FILTER (toxic = 1 AND quality = 0) / nullif(count(*) FILTER (toxic = 1), 0), 4) AS flag_precision, round(count(*) FILTER (toxic = 1 AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0), 4) AS bad_recall FROM labels GROUP BY ALL",
)
def verifier_confusion(spark, sf_dir):
    j = A.table(spark, sf_dir, "labels").selectExpr("doc_id % 3 AS slice", "toxic = 1 AS flagged", "quality = 0 AS bad")
    return verify.confusion(j, by=["slice"])


@plan.query(
    "threshold_sweep",
    "WITH s AS (SELECT user_id % 100 / 100 AS score, value < 100 AS bad FROM events), t AS (SELECT *, score < threshold AS flagged FROM s, (VALUES (0.1::DOUBLE), (0.2), (0.3)) v(threshold)) SELECT threshold, count(*) AS n, count(*) FILTER (flagged) AS flags, count(*) FILTER (flagged AND bad) AS true_flags, count(*) FILTER (NOT flagged AND bad) AS false_passes, round(count(*) FILTER (flagged AND bad) / nullif(count(*) FILTER (flagged), 0), 4) AS flag_precision, round(count(*) FILTER (flagged AND bad) / nullif(count(*) FILTER (bad), 0), 4) AS bad_recall FROM t GROUP BY threshold",
)
def threshold_sweep(spark, sf_dir):
    return verify.threshold_sweep(A.table(spark, sf_dir, "events").selectExpr("user_id % 100 / 100 AS score", "value < 100 AS bad"), [0.1, 0.2, 0.3])


@plan.query("judging_cost", "SELECT count(*) AS items, sum(CAST(floor(length(text) / 4) AS BIGINT) + 500) AS tokens_in, count(*) * 120 AS tokens_out FROM conversations")
def judging_cost(spark, sf_dir):
    return verify.cost_estimate(A.table(spark, sf_dir, "conversations"))


@plan.query("judging_budget", "WITH s AS (SELECT conv_id, turn, sum(CAST(floor(length(text) / 4) AS BIGINT) + 500) OVER (PARTITION BY conv_id ORDER BY turn) AS spent FROM conversations) SELECT * FROM s WHERE spent <= 1500")
def judging_budget(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    return verify.within_budget(c, "turn", F.floor(F.length("text") / 4) + 500, 1500, "conv_id").select("conv_id", "turn", "spent")


@plan.query("blind_sample")
def blind_sample(spark, sf_dir):
    """Which passed claims are drawn is a hash that SQL has not; all flagged ones are, as the tests check."""
    return verify.blind_sample(_verified(spark, sf_dir), 10).select("answer_id", "ord", "supported")
