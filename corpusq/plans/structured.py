"""Queries: captions over lines, article XML, specifications, manifests, boards, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from ..operators import tag
from ..sources import adapters as A
from .base import Plan

plan = Plan()


def _events(spark, sf_dir):
    return A.table(spark, sf_dir, "events")


@plan.query("captions_completed", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('Figure ', event_id, '. A plate that goes on for more than sixty letters in all of it.') WHEN 1 THEN 'Fig. 2 Short one' WHEN 2 THEN 'Plate 3 shows it' END AS caption FROM events")
def captions_completed(spark, sf_dir):
    e = _events(spark, sf_dir).selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN concat('x', chr(10), 'Figure ', event_id, '. A plate that goes on for more', chr(10), 'than sixty letters in all of it. Body text that follows it.') WHEN 1 THEN concat(' Fig. 2 Short one', chr(10), chr(10), 'body') WHEN 2 THEN concat('Plate 3 shows it', chr(10), '(courtesy of some Cor-', chr(10), 'Figure 4 next') ELSE 'no label' END AS t")
    return e.select("event_id", S.complete_caption("t").alias("caption"))


# Articles made of whole documents: entities, CDATA, comments, a section in a section, sections without content or of a kind to skip,
# numeric entities; one in seven does not parse, one in five has no abstract. Control characters are no XML.
_BARE = r"regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]', '')"
_ESCAPED = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_ARTICLE = f"""concat('<?xml version="1.0"?><article><front>',
  CASE WHEN doc_id % 5 > 0 THEN concat('<abstract><title>Abstract</title><p>', {_ESCAPED}, '</p></abstract>') ELSE '' END,
  '<abstract>a second one, which does not count</abstract></front><body><p>before any section</p><sec sec-type=" Methods "><title>named otherwise</title><p>', {_ESCAPED},
  '</p><sec sec-type="results"><title>Within</title><!-- <sec>no section, and no text </sec> --><p><![CDATA[', replace(t, ']]>', ']]]]><![CDATA[>'), ']]></p></sec></sec><sec/><sec><title>Results <i>of</i> it</title><p>&#65;&#x42;C and more of it ', {_ESCAPED},
  '</p></sec><sec sec-type="funding"><p>Money came from somewhere rich.</p></sec><sec><p>short</p></sec>', CASE WHEN doc_id % 7 = 3 THEN '' ELSE '</body>' END, '</article>')"""


@plan.query(
    "article_sections",
    rf"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFE}}\x{{FFFF}}]', '', 'g') AS t FROM documents),
    s AS (SELECT doc_id, 'abstract' AS section, 0 AS o, CASE WHEN doc_id % 5 > 0 THEN concat('Abstract', t) ELSE 'a second one, which does not count' END AS x FROM d
      UNION ALL SELECT doc_id, 'methods', 1, concat('named otherwise', t, 'Within', t) FROM d UNION ALL SELECT doc_id, 'results', 2, concat('Results of itABC and more of it ', t) FROM d),
    c AS (SELECT *, regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g') AS content FROM s WHERE doc_id % 7 <> 3)
    SELECT doc_id AS work_id, section, length(content) AS letters, md5(content) AS content_md5 FROM c WHERE length(content) >= 20""",
)
def article_sections(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_BARE} AS t").selectExpr("doc_id AS work_id", f"{_ARTICLE} AS xml")
    found = S.article_sections(d, {"abstract": "abstract", "methods": "methods", "results": "results"})
    return found.select("work_id", "section", F.length("content").cast("long").alias("letters"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@plan.query(
    "labelled_abstracts",
    """WITH t AS (SELECT conv_id AS pmid, CASE WHEN turn % 5 = 4 THEN 'TEXT' ELSE upper(role) END AS label, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE conv_id % 7 <> 3)
    SELECT pmid, label, length(string_agg(t, ' ' ORDER BY turn)) AS letters, md5(string_agg(t, ' ' ORDER BY turn)) AS text_md5 FROM t WHERE t <> '' GROUP BY ALL""",
)
def labelled_abstracts(spark, sf_dir):
    """Abstracts of which each turn of a conversation is a part, labelled by its role; one in seven does not parse."""
    c = A.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "replace(replace(text, '&', '&amp;'), '<', '&lt;') AS t", "CASE WHEN turn % 5 = 4 THEN '' ELSE concat(' Label=\"', initcap(role), ':\"') END AS label")
    whole = c.groupBy(F.col("conv_id").alias("pmid")).agg(F.array_sort(F.collect_list(F.struct("turn", "label", "t"))).alias("parts"))
    xml = F.concat(F.lit("<Abstract>"), F.array_join(F.transform("parts", lambda x: F.concat(F.lit("<AbstractText"), x["label"], F.lit(">"), x["t"], F.lit("</AbstractText>"))), ""), F.when(F.col("pmid") % 7 == 3, "").otherwise("</Abstract>"))
    return S.labelled_abstracts(whole.select("pmid", xml.alias("xml"))).select("pmid", "label", F.length("text").cast("long").alias("letters"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_ARCH, _REG = {"click": "cross", "view": "plan"}, {"click": "spine"}


def _cases(spark, sf_dir):
    return _events(spark, sf_dir).selectExpr("event_id AS case_id", "event_type AS profile", "CASE event_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE '' END AS side", "CASE WHEN event_id % 2 = 0 THEN 'C5-6' END AS level")


@plan.query("specifications", "SELECT event_id AS case_id, CAST(k AS INT) AS spec, CASE WHEN k = 1 THEN 'anatomy_map' WHEN event_type = 'click' THEN 'cross' WHEN event_type = 'view' THEN 'plan' ELSE 'corridor' END AS archetype, CASE WHEN event_type = 'click' THEN 'spine' ELSE 'cranial' END AS region FROM events, (SELECT unnest(range(0, 2)) AS k)")
def specifications(spark, sf_dir):
    return S.specifications(_cases(spark, sf_dir), _ARCH, _REG).select("case_id", "spec", "archetype", "region")


@plan.query("conformance", "SELECT count(*) FILTER (event_id % 4 > 0 AND event_type = 'click' OR event_id % 4 = 0 AND event_type NOT IN ('click', 'view')) AS archetype_ok, count(*) AS side_ok, count(*) AS level_ok, count(*) AS guard_ok FROM events")
def conformance(spark, sf_dir):
    specs = S.specifications(_cases(spark, sf_dir), _ARCH, _REG)
    truth = _cases(spark, sf_dir).withColumn("archetype", F.when(F.col("case_id") % 4 > 0, "cross").otherwise("corridor"))
    return S.conformance(specs, truth).agg(*[F.count_if(c).alias(c) for c in ("archetype_ok", "side_ok", "level_ok", "guard_ok")])


def _lines(spark, sf_dir):
    """A text a user: a heading before every fourth line, numbers that start anew."""
    e = _events(spark, sf_dir).selectExpr("user_id AS doc", "event_id AS ord", "event_type AS t")
    return e.selectExpr("doc", "ord", "CASE t WHEN 'click' THEN '## Spine' WHEN 'view' THEN '##  Skull base ' WHEN 'error' THEN '## Other' WHEN 'signup' THEN 'no question' ELSE concat(ord % 3 + 1, '.  What of ', ord, '? ') END AS line")


_MANIFEST_SQL = "WITH l AS (SELECT user_id AS doc, event_id AS ord, event_type AS t, CASE event_type WHEN 'click' THEN 'spine' WHEN 'view' THEN 'skull' WHEN 'error' THEN 'none' END AS h FROM events), f AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s FROM l), m0 AS (SELECT doc, ord, s, CAST(ord % 3 + 1 AS INT) AS source_number, concat('What of ', ord, '?') AS question, row_number() OVER (PARTITION BY doc, s ORDER BY ord) AS n FROM f WHERE t = 'purchase' AND s <> 'none')"


def _manifest(spark, sf_dir):
    return S.manifest(_lines(spark, sf_dir), {"Spine": ("spine", "SP"), "Skull base": ("skull", "SB")})


@plan.query("manifest", _MANIFEST_SQL + " SELECT doc, printf('%s-%02d', CASE s WHEN 'spine' THEN 'SP' ELSE 'SB' END, n) AS id, s AS domain, source_number, question FROM m0")
def manifest(spark, sf_dir):
    return _manifest(spark, sf_dir).drop("n")


@plan.query("manifest_errors", _MANIFEST_SQL + ", c AS (SELECT doc, CASE s WHEN 'spine' THEN 'SP' ELSE 'SB' END AS p, count(*) AS c FROM m0 GROUP BY ALL) SELECT doc, 'count' AS \"check\", p AS offender FROM c WHERE c <> CASE p WHEN 'SP' THEN 4 ELSE 3 END UNION ALL SELECT doc, 'number', printf('%s-%02d', CASE s WHEN 'spine' THEN 'SP' ELSE 'SB' END, n) FROM m0 WHERE source_number <> n")
def manifest_errors(spark, sf_dir):
    return S.manifest_errors(_manifest(spark, sf_dir), {"SP": 4, "SB": 3})


@plan.query(
    "board_cards",
    """WITH c AS (SELECT conv_id, turn, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS card, (turn % 3 = 2 OR turn % 3 = 0 AND NOT (turn = 0 AND conv_id % 4 = 0))::INT AS h FROM conversations),
    o AS (SELECT *, sum(h + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM c)
    SELECT conv_id AS board, CAST(ord AS INT) AS ord, CASE WHEN turn % 3 = 2 THEN 'risk' WHEN conv_id % 4 = 0 AND turn < 2 THEN 'intro' ELSE 'anat' END AS section, md5(card) AS card_md5 FROM o WHERE card <> '' AND NOT ends_with(card, '?')""",
)
def board_cards(spark, sf_dir):
    """Boards of conversations: turns are cards, under headings by place."""
    c = A.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "concat(CASE WHEN turn % 3 = 2 THEN concat('## Risks', chr(10)) WHEN turn % 3 = 0 AND NOT (turn = 0 AND conv_id % 4 = 0) THEN concat('## Anatomy', chr(10)) ELSE '' END, CASE turn % 2 WHEN 0 THEN '- \u2713 ' ELSE '  - [x] ' END, replace(text, chr(10), ' ')) AS line")
    b = c.groupBy(F.col("conv_id").alias("board")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("markdown"))
    return S.board_cards(b, {"Anatomy": "anat", "Risks": "risk"}, "intro").select("board", "ord", "section", F.md5(F.col("card").cast("binary")).alias("card_md5"))


_INTAKE = "conv_id AS case_id, concat(text, CASE conv_id % 3 WHEN 0 THEN ' Pain on the left.' WHEN 1 THEN ' The right arm.' ELSE '' END, CASE WHEN conv_id % 2 = 0 THEN ' Seen at C5-6.' ELSE '' END) AS dictation, CASE conv_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE '' END AS side, CASE WHEN conv_id % 2 = 0 THEN 'C5-6' ELSE '' END AS level"


@plan.query(
    "intake_accuracy",
    f"""WITH c AS (SELECT {_INTAKE}, text, conv_id FROM conversations WHERE turn = 0)
    SELECT count(*) AS cases, count(*) FILTER (conv_id % 7 > 0 OR side = 'left') AS laterality_ok, count(*) FILTER (conv_id % 11 > 0 OR level = 'T1') AS level_ok, count(*) FILTER (contains(lower(substr(text, 1, 30)), lower(substr(text, 1 + conv_id % 30, 9)))) AS goal_ok,
      count(*) FILTER ((contains(lower(substr(text, 1, 20)), lower(substr(text, 4, 8))) OR contains(lower(substr(text, 21)), lower(substr(text, 4, 8)))) AND (contains(lower(substr(text, 1, 20)), lower(substr(text, 18 + 9 * (conv_id % 3), 8))) OR contains(lower(substr(text, 21)), lower(substr(text, 18 + 9 * (conv_id % 3), 8))))) AS history_ok FROM c""",
)
def intake_accuracy(spark, sf_dir):
    """What the deterministic pass reads from first turns, and parts of them, against truths by a rule that is sometimes another."""
    c = A.table(spark, sf_dir, "conversations").where("turn = 0").selectExpr(*A._split(_INTAKE), "text", "conv_id")
    read = tag.intake(c.select("case_id", "dictation", F.expr("substr(text, 1, 30)").alias("goal"), F.expr("array(substr(text, 1, 20), substr(text, 21))").alias("history")), "dictation")
    truth = c.selectExpr("case_id", "CASE WHEN conv_id % 7 = 0 THEN 'left' ELSE side END AS laterality", "CASE WHEN conv_id % 11 = 0 THEN 'T1' ELSE level END AS level", "substr(text, 1 + conv_id % 30, 9) AS goal", "array(substr(text, 4, 8), substr(text, 18 + 9 * (conv_id % 3), 8)) AS history")
    return S.intake_accuracy(read, truth, ["laterality", "level"], ["goal"], ["history"])


@plan.query("section_coverage", "SELECT user_id AS case_id, count(*) FILTER (event_type IN ('click', 'view')) AS sections, count(*) FILTER (event_type IN ('click', 'view') AND event_id % 2 = 0) AS citing, NOT bool_or(event_id % 2 = 0 AND event_id % 100 = 0) AS no_fabrication FROM events GROUP BY user_id")
def section_coverage(spark, sf_dir):
    b = _events(spark, sf_dir).selectExpr("user_id AS case_id", "event_type AS section", "CASE WHEN event_id % 2 = 0 THEN array(CASE WHEN event_id % 100 = 0 THEN 'made up' ELSE 'r1' END) ELSE cast(array() as array<string>) END AS cited", "array('r1', 'r2') AS listed")
    return S.section_coverage(b, ["click", "view"])


@plan.query("run_statuses", "SELECT CASE WHEN event_type <> 'error' AND event_id % 4 = 0 THEN 'not_gradable' WHEN event_type = 'error' THEN 'engine_error' ELSE 'completed' END AS status, count(*) AS n FROM events GROUP BY 1")
def run_statuses(spark, sf_dir):
    r = A.runs(spark, sf_dir).withColumn("answer", F.when(F.col("question_id") % 4 > 0, "text").otherwise("  "))
    return S.normalised_status(r).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@plan.query("results_ledger", "WITH b AS (SELECT event_type AS run, user_id % 2 AS nw, event_id AS ts, value AS mean FROM events), l AS (SELECT run, arg_max(mean, (nw, ts)) AS mean, max(ts) AS ts FROM b GROUP BY run) SELECT run, ts, mean, round(mean - (SELECT mean FROM l WHERE run = 'view'), 4) AS delta FROM l")
def results_ledger(spark, sf_dir):
    e = _events(spark, sf_dir).selectExpr("user_id", "event_type AS run", "event_id AS ts", "value AS mean")
    return S.results_ledger(e.where("user_id % 2 = 0").drop("user_id"), e.where("user_id % 2 = 1").drop("user_id"), "view")


@plan.query("gate_metrics", "SELECT 'toxic_share' AS metric, round(avg(toxic), 6) AS value FROM labels UNION ALL SELECT 'mean_value', round(avg(value), 6) FROM events UNION ALL SELECT 'documents', count(*)::DOUBLE FROM documents")
def gate_metrics(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    return S.metric_set({"toxic_share": (t("labels"), F.round(F.avg("toxic"), 6)), "mean_value": (t("events"), F.round(F.avg("value"), 6)), "documents": (t("documents"), F.count(F.lit(1)))})
