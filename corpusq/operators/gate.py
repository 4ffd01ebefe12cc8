"""E10. The metrics of the quality gate, over tables of cases, boards and figures: each a (metric, value) row.

Shares are of all cases, rounded to six digits, and 0 without any. Inputs (all by case_id):
read       what the deterministic pass reads: laterality, level; and goal, as the full pass reads it
truth      laterality, level, goal
claims     a board's claims: context (det: from what the deterministic pass read; gt: from the truth), section, slot, id, text
literature the gt boards' citations: section, pmid
red_flags  phrase
figures    conformance() of the schematics
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .compile import residual_pairs

#: Which way a metric is good. Fixed values.
DIRECTIONS = {
    "section_coverage_det": "min",
    "section_coverage_gt": "min",
    "facet_coverage": "min",
    "intake_side_acc": "min",
    "intake_level_acc": "min",
    "intake_goal_acc": "min",
    "lit_coverage": "min",
    "corpus_n_coverage": "min",
    "figure_archetype_acc": "min",
    "figure_side_acc": "min",
    "figure_guard_reject": "min",
    "attribution_precision": "min",
    "near_dup_rate": "max",
    "red_flag_contamination": "max",
}


def cites_corpus(text: Column) -> Column:
    """Whether a claim cites a passage by number; literature markers do not count."""
    return F.regexp_replace(text, r"\[L[0-9]+\]", "").rlike(r"\[[0-9]+\]")


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6)


def intake_metrics(read: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.select("case_id", F.col("laterality").alias("t_side"), F.col("level").alias("t_level"), F.col("goal").alias("t_goal"))
    goal = F.coalesce((T.trimmed(F.coalesce("goal", F.lit(""))) != "") & F.contains(F.lower("goal"), F.lower("t_goal")), F.lit(False))
    n = F.count(F.lit(1))
    of = read.join(t, "case_id").agg(_share(F.count_if(F.col("laterality").eqNullSafe(F.col("t_side"))), n).alias("intake_side_acc"), _share(F.count_if(F.col("level").eqNullSafe(F.col("t_level"))), n).alias("intake_level_acc"), _share(F.count_if(goal), n).alias("intake_goal_acc"))
    return of


def board_metrics(cases: DataFrame, claims: DataFrame, literature: DataFrame, red_flags: DataFrame, sections: list[str], facets: dict[str, list[str]], lit_sections: list[str], corpus_sections: list[str], known: DataFrame, threshold: float) -> list[DataFrame]:
    """One row each: coverage of sections, facets and citations, attribution, near pairs, red flags. known: the pmids there are."""
    cases = cases.select("case_id")
    n = F.count(F.lit(1))
    gt = claims.where("context = 'gt'")

    def covered(rows: DataFrame, ok: Column, name: str) -> DataFrame:
        """The share of cases for which an aggregate of their rows holds."""
        return cases.join(rows.groupBy("case_id").agg(ok.alias("ok")), "case_id", "left").agg(_share(F.count_if(F.coalesce("ok", F.lit(False))), n).alias(name))

    has = lambda wanted, c: F.size(F.array_intersect(F.collect_set(c), F.array(*[F.lit(w) for w in wanted]))) == len(set(wanted))
    out = [covered(claims.where(F.col("context") == c), has(sections, F.col("section")), f"section_coverage_{c}") for c in ("det", "gt")]
    slots = [f"{s}\n{slot}" for s, every in facets.items() for slot in every]
    out.append(covered(gt, has(slots, F.concat_ws("\n", "section", "slot")), "facet_coverage"))
    cited = literature.join(known.select("pmid", F.lit(True).alias("is_known")).distinct(), "pmid", "left")
    out.append(covered(cited, has(lit_sections, F.col("section")) & F.min(F.coalesce("is_known", F.lit(False))), "lit_coverage"))
    eligible = gt.where(F.col("section").isin(corpus_sections)).withColumn("cites", cites_corpus(F.col("text")))
    out.append(covered(eligible.where("cites"), has(corpus_sections, F.col("section")), "corpus_n_coverage"))
    out.append(eligible.agg(_share(F.count_if("cites"), n).alias("attribution_precision")))
    pairs = residual_pairs(gt.select(F.col("case_id").alias("board"), "id", "section", "text"), threshold)
    total = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    out.append(total.crossJoin(cases.agg(n.alias("n"))).select(_share(F.col("pairs"), F.col("n")).alias("near_dup_rate")))
    # a phrase counts once a case; headings count as text
    said = claims.select("case_id", F.lower(F.concat_ws("\n", "section", "text")).alias("said"))
    hits = said.join(red_flags.select("case_id", F.lower("phrase").alias("phrase")).distinct(), "case_id").where(F.contains("said", "phrase"))
    out.append(hits.select("case_id", "phrase").distinct().agg(n.cast("double").alias("red_flag_contamination")))
    return out


def figure_metrics(conformance: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return conformance.agg(*[_share(F.count_if(c), n).alias(name) for c, name in (("archetype_ok", "figure_archetype_acc"), ("side_ok", "figure_side_acc"), ("guard_ok", "figure_guard_reject"))])


def long_form(rows: list[DataFrame]) -> DataFrame:
    """(metric, value) of tables of one row."""
    each = [r.unpivot([], r.columns, "metric", "value") if len(r.columns) > 1 else r.select(F.lit(r.columns[0]).alias("metric"), F.col(r.columns[0]).cast("double").alias("value")) for r in rows]
    return reduce(DataFrame.unionByName, each)


def gate_metrics(read: DataFrame, truth: DataFrame, claims: DataFrame, literature: DataFrame, red_flags: DataFrame, conformance: DataFrame, sections: list[str], facets: dict[str, list[str]], lit_sections: list[str], corpus_sections: list[str], known: DataFrame, threshold: float = 0.72) -> DataFrame:
    """E10. All of them; what the gate asks of each is in DIRECTIONS and a baseline (evaluate.quality_gate)."""
    return long_form([intake_metrics(read, truth), *board_metrics(truth, claims, literature, red_flags, sections, facets, lit_sections, corpus_sections, known, threshold), figure_metrics(conformance)])
