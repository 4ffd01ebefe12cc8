"""The corpus pipeline: documents through five operators of corpusq.llm, each stage written and read again.

Every stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and but for the last returns
rows with the columns of documents:

language      documents whose language cannot be told go: no letter, or a profile unlike every language's
near-dedup    of each group of near duplicates (similarity of five-word shingles NEAR per cent or more), the document with
              the smallest id stays
decontaminate documents that benchmark passages make up a twentieth of go
mix           for each pass over a source a row for what the mix takes of each document, all of it or stretches of blocks, so that
              each source has the words of its target
tokens        token ids are written to binary files; the rows tell where each document stands

Defined cases, by stage. language: null and empty texts, and those without a letter, go; repeated rows are judged each by
itself; without any language learnt all documents go. near-dedup: null and empty texts stay, as they are like nothing; of rows
with one doc_id one stays, and rows without a doc_id stay. decontaminate: null and empty texts stay; repeated rows are
judged each by itself. mix: null and empty texts have no words and are never taken; repeated rows are documents of their own; a null
source is a source. tokens: null and empty texts have the end id alone; a null doc_id comes first. Very long texts are taken
whole by every stage; an empty table stays empty; columns of other names, also such as the stages use inside, are kept by all
but the last stage, whatever they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import decontaminate, langid, mixing, neardup, tokens
from corpusq.llm.common import held_out, ready, stage, table, tokenizer_path

#: A document less like every language than this has no language. Short texts of a language score 0.1 and more.
LEAST_SCORE = 0.05
#: Near duplicates share this per cent of their shingles, or more.
NEAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    prototypes = langid.learn(docs.where(~held_out(F.col("doc_id"))))
    prefix = decontaminate.free_name(docs, "_")
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = langid.predict(docs, prototypes, prefix)
    return found.where((F.col(f"{prefix}lang_pred") != langid.UNKNOWN) & (F.col(f"{prefix}score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return neardup.unique(docs, threshold=NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return tokens.write_and_read(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near-dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mix), ("tokens", token_ids)]
#: Language profiles and byte-pair encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
