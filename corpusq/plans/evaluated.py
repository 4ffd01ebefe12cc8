"""Queries: grades, latency, blinded comparison, gates, monitoring, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import search, verify
from ..sources import adapters as A
from ..sources import store as S
from .base import Plan
from .pages import _WINDOWS_SQL, chunks
from .searched import _BM25_SQL, _QUERIES_SQL, text_index, text_queries
from .verified import _GROUNDED_SQL, SUFFIX

plan = Plan()


@plan.query("score_stats", f"WITH {A.GRADES_SQL} SELECT domain, count(score) AS n, round(avg(score), 2) AS mean, round(median(score), 2) AS median, round(stddev_pop(score), 2) AS stddev FROM grades0 GROUP BY GROUPING SETS ((domain), ())")
def score_stats(spark, sf_dir):
    return E.score_stats(A.grades(spark, sf_dir))


_LETTER = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END"


@plan.query("letter_distribution", f"WITH {A.GRADES_SQL}, l AS (SELECT domain, {_LETTER} AS l FROM grades0) SELECT domain, " + ", ".join(f"count(*) FILTER (l = '{x}') AS \"{x}\"" for x in "ABCDF") + " FROM l GROUP BY domain")
def letter_distribution(spark, sf_dir):
    return E.letters(A.grades(spark, sf_dir).withColumn("letter", E.letter(F.col("score"))))


@plan.query("last_grades", f"WITH {A.GRADES_SQL} SELECT question, arm, arg_max(score, ordinal) AS score, arg_max(domain, ordinal) AS domain, max(ordinal) AS ordinal FROM grades0 GROUP BY question, arm")
def last_grades(spark, sf_dir):
    return E.last_of(A.grades(spark, sf_dir), ["question", "arm"], "ordinal")


@plan.query("completion", f"WITH {A.RUNS_SQL} SELECT count(*) AS runs, round(avg((status = 'completed')::INT), 4) AS completion_rate, round(1 - avg((status = 'completed')::INT), 4) AS error_rate FROM runs0")
def completion(spark, sf_dir):
    return E.completion(A.runs(spark, sf_dir))


@plan.query("latency_by_domain", f"WITH {A.RUNS_SQL} SELECT domain, min(latency) AS least, max(latency) AS most, round(avg(latency), 3) AS mean, round(median(latency), 3) AS median, list_sort(list(latency))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INT) + 1] AS p95 FROM runs0 GROUP BY domain")
def latency_by_domain(spark, sf_dir):
    return E.latency(A.runs(spark, sf_dir), ["domain"])


@plan.query("quantity_percentiles", "SELECT l_returnflag, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 3) AS mean, round(median(l_quantity), 3) AS median, list_sort(list(l_quantity))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INT) + 1] AS p95 FROM lineitem GROUP BY l_returnflag")
def quantity_percentiles(spark, sf_dir):
    """The same statistics over a larger table."""
    return E.latency(A.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("latency")), ["l_returnflag"])


@plan.query(
    "anchors_verified",
    "WITH a AS (SELECT CASE (event_id + k) % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'verification_unavailable' ELSE 'no' END AS status FROM events, (SELECT unnest(range(0, 2)) AS k)) SELECT count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'verification_unavailable') AS unavailable, round(coalesce(count(*) FILTER (status = 'verified') / nullif(count(*), 0), 0), 3) AS verified_fraction FROM a",
)
def anchors_verified(spark, sf_dir):
    g = A.table(spark, sf_dir, "events").selectExpr("transform(sequence(0, 1), k -> named_struct('status', CASE (event_id + k) % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'verification_unavailable' ELSE 'no' END)) AS anchors")
    return E.anchors_verified(g)


@plan.query("variant_chosen", "SELECT user_id AS question_id, arg_max(event_type, (length(event_type), -event_id)) AS variant FROM events GROUP BY user_id")
def variant_chosen(spark, sf_dir):
    return E.chosen_variant(A.table(spark, sf_dir, "events").selectExpr("user_id AS question_id", "event_id AS pos", "event_type AS variant"))


_LAST_SQL = f"WITH {A.GRADES_SQL}, l0 AS (SELECT question, arm, arg_max(score, ordinal) AS score FROM grades0 GROUP BY question, arm)"


def _last(spark, sf_dir):
    return E.last_of(A.grades(spark, sf_dir).select("question", "arm", "score", "ordinal"), ["question", "arm"], "ordinal")


@plan.query("blinded_slots", _LAST_SQL + ", b0 AS (SELECT question FROM l0 GROUP BY question HAVING count(DISTINCT arm) = 2), n0 AS (SELECT question, row_number() OVER (ORDER BY question) - 1 AS q FROM b0) SELECT question, arm, CAST(((CASE arm WHEN 'arm0' THEN 0 ELSE 1 END) - q % 2 + 2) % 2 AS BIGINT) AS slot FROM l0 JOIN n0 USING (question)")
def blinded_slots(spark, sf_dir):
    return E.blinded(_last(spark, sf_dir), ["arm0", "arm1"]).select("question", "arm", F.col("slot").cast("long").alias("slot"))


@plan.query("head_to_head", _LAST_SQL + ", w AS (SELECT question, max(score) FILTER (arm = 'arm0') AS x, max(score) FILTER (arm = 'arm1') AS y FROM l0 GROUP BY question) SELECT 'arm0' AS a, 'arm1' AS b, count(*) AS n, count(*) FILTER (x > y) AS wins_a, count(*) FILTER (x < y) AS wins_b, count(*) FILTER (x = y) AS ties, round(avg(x - y), 4) AS mean_delta FROM w WHERE x IS NOT NULL AND y IS NOT NULL")
def head_to_head(spark, sf_dir):
    g = E.blinded(_last(spark, sf_dir), ["arm0", "arm1"])
    return E.head_to_head(E.unblinded(g.select("question", "slot", "score"), g.select("question", "slot", "arm"), ["arm0", "arm1"]), ["arm0", "arm1"])


@plan.query("running_verdict", _LAST_SQL + ", w AS (SELECT question, max(score) FILTER (arm = 'arm0') AS x, max(score) FILTER (arm = 'arm1') AS y FROM l0 GROUP BY question), a AS (SELECT count(*) AS n, count(*) FILTER (y > x) AS wins, count(*) FILTER (y < x) AS losses, avg(y - x) AS d FROM w WHERE x IS NOT NULL AND y IS NOT NULL) SELECT n, wins, losses, round(d, 4) AS mean_delta, CASE WHEN n >= 100 THEN 'COMPLETE' WHEN n < 30 THEN 'EARLY' WHEN greatest(wins, losses) = n AND abs(d) >= 15 THEN 'CLEAR' WHEN greatest(wins, losses) / n >= 0.8 AND abs(d) >= 12 THEN 'LIKELY' ELSE 'OPEN' END AS verdict FROM a")
def running_verdict(spark, sf_dir):
    return E.clarity(_last(spark, sf_dir).groupBy("question").pivot("arm", ["arm0", "arm1"]).agg(F.first("score")), "arm1", "arm0", 100)


@plan.query("arms_compared", _LAST_SQL + " SELECT coalesce(a.question, b.question) AS question, a.score AS score_a, b.score AS score_b, b.score - a.score AS delta FROM (SELECT * FROM l0 WHERE arm = 'arm0' AND question % 5 > 0) a FULL JOIN (SELECT * FROM l0 WHERE arm = 'arm1' AND question % 7 > 0) b ON a.question = b.question")
def arms_compared(spark, sf_dir):
    g = _last(spark, sf_dir)
    return E.compared(g.where("arm = 'arm0' and question % 5 > 0"), g.where("arm = 'arm1' and question % 7 > 0"))


@plan.query("paired_delta")
def paired_delta(spark, sf_dir):
    """The bootstrap's draws come from a hash that SQL has not; the other figures are tested."""
    g = _last(spark, sf_dir)
    return E.paired(E.compared(g.where("arm = 'arm0'"), g.where("arm = 'arm1'")))


@plan.query("blinded_sides", "SELECT user_id AS question, CAST(instr('0123456789abcdef', left(sha256(concat('set|', user_id)), 1)) - 1 AS INT) % 2 AS side FROM (SELECT DISTINCT user_id FROM events)")
def blinded_sides(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select(F.col("user_id").alias("question")).distinct().withColumn("side", E.side(F.lit("set"), "question"))


_COVER_SQL = """WITH bo AS (SELECT conv_id AS case_id, turn AS run, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations), d AS (SELECT case_id, run, lower(array_to_string(list_filter(l, lambda x: NOT ends_with(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '?')), chr(10))) AS said FROM bo),
an AS (SELECT k AS item, ['the ', 'tion', 'sch', 'que', 'zzz'][k] AS term FROM (SELECT unnest(range(1, 6)) AS k)), c0 AS (SELECT case_id, run, count(*) AS items, count(*) FILTER (contains(said, term)) AS n_covered, coalesce(list_sort(list(concat('i', item)) FILTER (NOT contains(said, term))), []) AS missing FROM d, an GROUP BY ALL), cov0 AS (SELECT *, round(n_covered / items, 4) AS coverage FROM c0)""".replace("\\\\", "\\")


def _coverage(spark, sf_dir):
    b = A.table(spark, sf_dir, "conversations").selectExpr("conv_id AS case_id", "turn AS run", "text AS board")
    a = A.table(spark, sf_dir, "conversations").selectExpr("conv_id AS case_id").distinct().selectExpr("case_id", "explode(sequence(1, 5)) AS k").selectExpr("case_id", "concat('i', k) AS item", "array(element_at(array('the ', 'tion', 'sch', 'que', 'zzz'), k)) AS terms")
    return E.anchor_coverage(b, a)


@plan.query("anchor_coverage", _COVER_SQL + " SELECT * FROM cov0")
def anchor_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir)


_DROPS_SQL = (
    _COVER_SQL
    + """, w AS (SELECT case_id, arg_min({'c': coverage, 'm': missing}, (coverage, run)) AS m FROM cov0 GROUP BY case_id), b AS (SELECT DISTINCT conv_id AS case_id, 0.5 AS before FROM conversations WHERE conv_id % 2 = 0),
    dr0 AS (SELECT w.case_id, m.c AS after, m.m AS missing, before, CASE WHEN m.c < 0.3 THEN 'high' ELSE 'medium' END AS severity FROM w LEFT JOIN b USING (case_id) WHERE m.c < 0.3 OR coalesce(m.c < before - 0.05, false)),
    fp0 AS (SELECT *, left(sha1(concat_ws('|', 'coverage drop', CAST(case_id AS VARCHAR), trim(regexp_replace(array_to_string(missing, '|'), '[^a-z0-9]+', ' ', 'g')))), 16) AS fingerprint FROM dr0)"""
)


@plan.query("coverage_drops", _DROPS_SQL + " SELECT case_id, after, missing, before, severity, fingerprint FROM fp0 WHERE case_id % 6 > 0")
def coverage_drops(spark, sf_dir):
    base = A.table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").selectExpr("conv_id AS case_id", "0.5D AS coverage").distinct()
    drops = E.coverage_drops(_coverage(spark, sf_dir), base, floor=0.3)
    # every sixth case is suppressed; of the others' suppressions the day is past
    s = drops.select("fingerprint", F.when(F.col("case_id") % 6 == 0, F.lit("2030-01-01")).otherwise("2020-01-01").cast("date").alias("expires"))
    return E.unsuppressed(drops, s, F.lit("2025-01-01").cast("date"))


@plan.query(
    "quality_gate",
    "WITH m AS (SELECT event_type AS metric, avg(value) AS value FROM events WHERE event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS metric, median(value) AS baseline, CASE WHEN event_type < 'd' THEN 'min' ELSE 'max' END AS direction FROM events GROUP BY event_type) SELECT b.metric, round(baseline, 4) AS baseline, direction, round(value, 4) AS value, CASE WHEN value IS NULL THEN false WHEN direction = 'min' THEN value >= baseline - 1e-9 ELSE value <= baseline + 1e-9 END AS ok FROM b LEFT JOIN m USING (metric)",
)
def quality_gate(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    m = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    b = e.groupBy(F.col("event_type").alias("metric")).agg(F.median("value").alias("baseline")).withColumn("direction", F.when(F.col("metric") < "d", "min").otherwise("max"))
    return E.quality_gate(m, b).withColumns({"baseline": F.round("baseline", 4), "value": F.round("value", 4)})


@plan.query("retrieval_gate", f"{_WINDOWS_SQL}, docs0 AS (SELECT id, text FROM chunks0), {_QUERIES_SQL}, {_BM25_SQL.replace('{k}', '10')} SELECT q.query_id, bool_or(coalesce(c.book = 'b0' AND rank <= 5, false)) AS passed FROM queries0 q LEFT JOIN text0 t USING (query_id) LEFT JOIN chunks0 c USING (id) GROUP BY q.query_id")
def retrieval_gate(spark, sf_dir):
    c = chunks(spark, sf_dir)
    ranked = S.written(search.bm25(text_index(spark, sf_dir, "chunks"), text_queries(spark, sf_dir), 10), "ranked").join(c.select("id", "book"), "id")
    return E.gate(ranked, text_queries(spark, sf_dir).select("query_id", F.lit("b0").alias("book")), 5, ["book"])


@plan.query("disambiguation", "WITH c AS (SELECT event_type, user_id % 2 = 0 AS amb, user_id % 3 = 0 AS asked, 'v1' AS expected, CASE WHEN event_id % 5 > 0 THEN concat('v', event_id % 3) END AS chosen, event_id % 10 = 7 AS conf FROM events) SELECT event_type, count(*) AS cases, count(*) FILTER (conf) AS conflations, count(*) FILTER (amb AND chosen IS NOT NULL AND chosen <> expected) AS wrong_variants, count(*) FILTER (NOT amb AND asked) AS over_asks FROM c GROUP BY event_type")
def disambiguation(spark, sf_dir):
    c = A.table(spark, sf_dir, "events").selectExpr("event_type", "user_id % 2 = 0 AS expect_ambiguous", "user_id % 3 = 0 AS asked", "'v1' AS expected", "CASE WHEN event_id % 5 > 0 THEN concat('v', event_id % 3) END AS chosen", "CASE WHEN event_id % 10 = 7 THEN 'Not THAT' ELSE 'fine' END AS answer", "array('that') AS forbidden")
    return E.disambiguation(c, ["event_type"])


_KINDS = {"errors": ("incorrect_synthesis", "safety_critical", 0.6), "omissions": ("retrieval_omission", "material", 0.7)}
_LEDGER_SQL = """WITH g AS (SELECT event_id AS q, event_type AS t FROM events), e AS (SELECT q, k AS i, 'errors' AS list, concat('wrong  ', t, ' ', k) AS basis, 'incorrect_synthesis' AS c, 'safety_critical' AS severity, 0.6 AS confidence FROM g, (SELECT unnest(range(0, 2)) AS k) UNION ALL SELECT q, 0, 'omissions', concat('lacks trial ', t), 'retrieval_omission', 'material', 0.7 FROM g WHERE q % 2 = 0),
l0 AS (SELECT q AS question_id, CASE WHEN regexp_matches(basis, 'trial|view') THEN 'outdated_evidence' ELSE c END AS category, severity, left(trim(regexp_replace(basis, '\\s+', ' ', 'g')), 240) AS excerpt, confidence, list, i FROM e)""".replace("\\\\", "\\")


def _ledger(spark, sf_dir):
    g = A.table(spark, sf_dir, "events").selectExpr("event_id AS question_id", "transform(sequence(0, 1), k -> concat('wrong  ', event_type, ' ', k)) AS errors", "CASE WHEN event_id % 2 = 0 THEN array(concat('lacks trial ', event_type)) ELSE cast(array() as array<string>) END AS omissions")
    return E.defects(g, _KINDS, {"outdated_evidence": "trial|view"})


@plan.query("defect_ledger", _LEDGER_SQL + " SELECT question_id, category, severity, excerpt, confidence, concat_ws('-', question_id, category, list, i) AS defect_id FROM l0")
def defect_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)


@plan.query(
    "verification_defects",
    _GROUNDED_SQL
    + " SELECT g1.answer_id AS question_id, 'unsupported_claim' AS category, 'material' AS severity, left(trim(regexp_replace(a.answer, '\\s+', ' ', 'g')), 240) AS excerpt, 0.5::DOUBLE AS confidence, concat(g1.answer_id, '-unsupported_claim-0') AS defect_id, "
    "concat('verification: ', n_unsupported, '/', n_cited, ' cited claims not entailed by cited source (markers: ', array_to_string(unsupported_markers, ', '), ')') AS basis, 'model_synthesis' AS layer, 'hypothesis' AS causal_status FROM g1 JOIN answers0 a USING (answer_id) WHERE n_unsupported > 0",
)
def verification_defects(spark, sf_dir):
    answers = A.answers(spark, sf_dir)
    g = verify.groundedness(verify.verified(answers, A.premises(spark, sf_dir), SUFFIX))
    return E.verification_defects(g.join(answers, "answer_id").withColumnRenamed("answer_id", "question_id"))


@plan.query("status_defects", "SELECT event_id AS question_id, 'disambiguation_failure' AS category, 'material' AS severity, left(props, 240) AS excerpt, 0.7::DOUBLE AS confidence, concat(event_id, '-disambiguation_failure-0') AS defect_id, 'Not gradable: empty answer after disambiguation narrowed question scope' AS basis, 'query_decomposition' AS layer, 'supported' AS causal_status FROM events WHERE event_type = 'error' OR value < 5")
def status_defects(spark, sf_dir):
    g = A.table(spark, sf_dir, "events").selectExpr("event_id AS question_id", "CASE WHEN event_type = 'error' THEN 'Not gradable' ELSE 'B' END AS letter", "CASE WHEN value < 5 THEN 'not gradable' ELSE 'usable' END AS usability", "props AS reason")
    return E.status_defects(g)


@plan.query("defect_clusters", _LEDGER_SQL + " SELECT category, severity, count(*) AS n FROM l0 GROUP BY GROUPING SETS ((category), (severity))")
def defect_clusters(spark, sf_dir):
    return E.defect_clusters(_ledger(spark, sf_dir))


@plan.query("missed_by_arms", "WITH h AS (SELECT DISTINCT event_type AS arm, user_id AS query_id FROM events WHERE event_id % 7 = 0), a AS (SELECT arm, query_id FROM (SELECT DISTINCT event_type AS arm FROM events), (SELECT DISTINCT user_id AS query_id FROM events)) SELECT query_id, count(*) AS missed_by, list_sort(list(arm)) AS arms FROM a ANTI JOIN h USING (arm, query_id) GROUP BY query_id")
def missed_by_arms(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    each = e.groupBy(F.col("user_id").alias("query_id")).agg(*[F.max(F.when((F.col("event_id") % 7 == 0) & (F.col("event_type") == t), 1)).alias(t) for t in ("click", "error", "purchase", "signup", "view")])
    return E.missed(each.unpivot(["query_id"], ["click", "error", "purchase", "signup", "view"], "arm", "hit"))


@plan.query("judge_coverage", "SELECT user_id AS case_id, count(*) AS items, round(100 * (count(*) FILTER (event_type = 'click') + 0.5 * count(*) FILTER (event_type = 'view')) / count(*), 1) AS coverage_pct FROM events GROUP BY user_id")
def judge_coverage(spark, sf_dir):
    return E.judge_coverage(A.table(spark, sf_dir, "events").selectExpr("user_id AS case_id", "CASE event_type WHEN 'click' THEN 'covered' WHEN 'view' THEN 'partial' ELSE 'missing' END AS verdict"))
