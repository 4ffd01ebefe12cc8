"""The operators' input tables, made from the tables of a data folder, and the same as SQL.

Books are runs of 500 documents of one source group, so that no book grows with the data. Where the documents lack a shape
that an operator is for (a reference list, a heading, a caption), it is added by a rule that both versions state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_PER_BOOK = 500


#: The columns of documents that pages are made of.
COLUMNS = ["doc_id", "text", "lang", "source"]


def book():
    """The book of a document, as pages have it."""
    return F.expr(f"concat('b', doc_id div {PAGES_PER_BOOK})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TEXT = """concat(
  CASE WHEN doc_id % 7 = 0 THEN concat('CHAPTER ', doc_id % 40 + 2, chr(10), 'SURGICAL ANATOMY', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 4 = 0 THEN concat(substr(text, 1, 200), chr(10), chr(10), substr(text, 201)) ELSE text END,
  CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), 'Figure ', doc_id, '. Plate of ', substr(text, 1, 40)) ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), '12. Smith JD, Jones AB.', chr(10), 'REFERENCES', chr(10), '1. Smith JD, Jones AB. Of everything.') ELSE '' END)"""
_PAGES = f"concat('b', doc_id div {PAGES_PER_BOOK}) AS book, CAST(doc_id % {PAGES_PER_BOOK} + 1 AS INT) AS page, {_TEXT} AS text, lang AS chapter, doc_id, source, doc_id % 3 = 0 AS has_figure"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, page, text, chapter, has_figure; and doc_id and source of the document."""
    return table(spark, sf_dir, "documents").selectExpr(*_split(_PAGES))


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


#: The same in SQL, as the CTE pages0.
PAGES_SQL = f"pages0 AS (SELECT {_PAGES.replace(' div ', ' // ')} FROM documents)"

#: Claims with citation markers: each of a document's first three sentences cites documents by rule.
CLAIM_MARKERS = "[1] and [L2]"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of assistants, each sentence citing sources by number: answer_id, answer."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return said.selectExpr("conv_id * 1000 + turn AS answer_id", "regexp_replace(text, '([.!?])( |$)', ' [1][L2]$1$2') AS answer")


ANSWERS_SQL = r"answers0 AS (SELECT conv_id * 1000 + turn AS answer_id, regexp_replace(text, '([.!?])( |$)', ' [1][L2]\1\2', 'g') AS answer FROM conversations WHERE role = 'assistant')"


def premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the markers of answers cite: marker 1 is the turn before, L2 the benchmark item of the answer's number."""
    c = table(spark, sf_dir, "conversations")
    before = c.where("role <> 'assistant'").selectExpr("conv_id * 1000 + turn + 1 AS answer_id", "'1' AS marker", "text AS premise")
    n = table(spark, sf_dir, "benchmark").selectExpr("item_id", "text")
    own = c.where("role = 'assistant'").selectExpr("conv_id * 1000 + turn AS answer_id", "conv_id % 40 AS item")
    return before.unionByName(own.join(n, F.col("item") == F.col("item_id")).selectExpr("answer_id", "'L2' AS marker", "text AS premise"))


PREMISES_SQL = """premises0 AS (SELECT conv_id * 1000 + turn + 1 AS answer_id, '1' AS marker, text AS premise FROM conversations WHERE role <> 'assistant'
  UNION ALL SELECT conv_id * 1000 + turn, 'L2', b.text FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40 WHERE role = 'assistant')"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of a benchmark: question_id, domain, latency, status."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS question_id", "event_type AS domain", "value AS latency", "CASE WHEN event_type = 'error' THEN 'engine_error' ELSE 'completed' END AS status")


RUNS_SQL = "runs0 AS (SELECT event_id AS question_id, event_type AS domain, value AS latency, CASE WHEN event_type = 'error' THEN 'engine_error' ELSE 'completed' END AS status FROM events)"


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of two arms: question, arm, score, domain, ordinal."""
    return table(spark, sf_dir, "events").selectExpr("user_id div 2 AS question", "concat('arm', user_id % 2) AS arm", "CAST(floor(value) AS BIGINT) % 101 AS score", "event_type AS domain", "event_id AS ordinal")


GRADES_SQL = "grades0 AS (SELECT user_id // 2 AS question, concat('arm', user_id % 2) AS arm, CAST(floor(value) AS BIGINT) % 101 AS score, event_type AS domain, event_id AS ordinal FROM events)"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a deck: a user's turn is the question, the next turn the answer: card_ord, deck, question, answer."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").selectExpr("conv_id", "turn", "text AS question")
    a = c.where("role = 'assistant'").selectExpr("conv_id AS c", "turn - 1 AS t", "text AS answer")
    return q.join(a, F.expr("conv_id = c and turn = t")).selectExpr("conv_id * 1000 + turn AS card_ord", "concat('deck', conv_id div 20) AS deck", "question", "answer")


CARDS_SQL = "cards0 AS (SELECT q.conv_id * 1000 + q.turn AS card_ord, concat('deck', q.conv_id // 20) AS deck, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant')"
