"""Evaluation of retrieval and answers: recall, grades, latency, blinded comparison, gates, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

LETTERS = ((90, "A"), (80, "B"), (65, "C"), (50, "D"))


# --- retrieval --------------------------------------------------------------------------------------------------------


def first_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """E1. (query_id, rank, text) and (query_id, any_of) to the rank of the first text that has any of the terms; else null."""
    hit = F.exists("any_of", lambda t: F.contains(F.lower("text"), F.lower(t)))
    found = ranked.join(gold, "query_id").groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("hit"))
    return gold.select("query_id").join(found, "query_id", "left")


def recall(hits: DataFrame, ks: list[int], by: list[str] = ()) -> DataFrame:
    """E2. Recall at each k and mean reciprocal rank; a miss counts 0."""
    at = [F.round(F.avg((F.coalesce("hit", F.lit(1 << 30)) <= k).cast("double")), 4).alias(f"recall_{k}") for k in ks]
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *at, F.round(F.avg(F.coalesce(1 / F.col("hit"), F.lit(0.0))), 4).alias("mrr"))


def gate(ranked: DataFrame, expected: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """E3. Per case, whether one of the first k results has the expected source (keys: book, or book and page)."""
    passed = ranked.where(F.col("rank") <= k).join(expected.select("query_id", *keys), ["query_id", *keys], "left_semi").select("query_id").distinct().withColumn("passed", F.lit(True))
    return expected.select("query_id").distinct().join(passed, "query_id", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def disambiguation(cases: DataFrame, by: list[str] = ()) -> DataFrame:
    """E4. (answer, expect_ambiguous, asked, expected, chosen, forbidden): rates of conflation, wrong variant, over-asking."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    conflated = F.exists("forbidden", lambda t: F.contains(low, F.lower(t)))
    wrong = F.col("expect_ambiguous") & F.col("chosen").isNotNull() & (F.col("chosen") != F.col("expected"))
    over = ~F.col("expect_ambiguous") & F.col("asked")
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(conflated).alias("conflations"), F.count_if(wrong).alias("wrong_variants"), F.count_if(over).alias("over_asks"))


def declarative(text) -> Column:
    """X24. The lines that state something: no questions, nor the indented reason below one."""
    marked = F.transform(T.lines(text), lambda x: F.struct(x.alias("x"), T.trimmed(x).endswith("?").alias("q"), x.rlike(r"^\s{2,}\S").alias("i")))
    return F.array_join(F.transform(F.filter(marked, lambda m, n: ~m["q"] & ~(m["i"] & (n > 0) & F.coalesce(F.try_element_at(marked, n)["q"], F.lit(False)))), lambda m: m["x"]), "\n")


def anchor_coverage(boards: DataFrame, anchors: DataFrame) -> DataFrame:
    """E5. (case_id, run, board) and (case_id, item, terms): share of a case's items of which any term stands in a board's
    declarative text, and the missing ones."""
    text = F.lower(declarative("board"))
    covered = F.exists("terms", lambda t: F.contains(F.col("said"), F.lower(t)))
    each = boards.withColumn("said", text).select("case_id", "run", "said").join(anchors, "case_id").withColumn("covered", covered)
    return each.groupBy("case_id", "run").agg(F.count(F.lit(1)).alias("items"), F.count_if("covered").alias("n_covered"), F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("item")))).alias("missing")).withColumn("coverage", F.round(F.col("n_covered") / F.col("items"), 4))


# --- monitoring -------------------------------------------------------------------------------------------------------


def is_regression(before: Column, after: Column, margin: float = 0.05, floor: float = 0.5) -> Column:
    """E6. Below the floor, or more than the margin below what was before (null: nothing was)."""
    return (after < floor) | F.coalesce(after < before - margin, F.lit(False))


def plain(c) -> Column:
    """Lowered, and all but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(T.col(c), F.lit(""))), "[^a-z0-9]+", " "))


def fingerprint(*parts) -> Column:
    """E8. The first 16 hexadecimal digits of the SHA-1 of the plain parts."""
    return F.left(F.sha1(F.concat_ws("|", *[plain(p) for p in parts]).cast("binary")), F.lit(16))


def coverage_drops(coverage: DataFrame, baseline: DataFrame, margin: float = 0.05, floor: float = 0.5) -> DataFrame:
    """E7. The worst of a case's runs against its baseline: an issue for each case that got worse, with what is missing."""
    worst = coverage.groupBy("case_id").agg(F.min_by(F.struct("coverage", "missing"), F.struct("coverage", "run")).alias("w")).select("case_id", F.col("w.coverage").alias("after"), F.col("w.missing").alias("missing"))
    found = worst.join(baseline.select("case_id", F.col("coverage").alias("before")), "case_id", "left").where(is_regression(F.col("before"), F.col("after"), margin, floor))
    return found.withColumn("severity", F.when(F.col("after") < floor, "high").otherwise("medium")).withColumn("fingerprint", fingerprint(F.lit("coverage_drop"), F.col("case_id").cast("string"), F.array_join("missing", "|")))


def unsuppressed(issues: DataFrame, suppressions: DataFrame, today) -> DataFrame:
    """E8. Issues whose fingerprint is not suppressed; a suppression past its day does not count."""
    active = suppressions.where(F.col("expires").isNull() | (F.col("expires") >= today)).select("fingerprint")
    return issues.join(active, "fingerprint", "left_anti")


def quality_gate(metrics: DataFrame, baseline: DataFrame, eps: float = 1e-9) -> DataFrame:
    """E9. (metric, value) against (metric, baseline, direction): a missing metric fails."""
    ok = F.when(F.col("value").isNull(), False).when(F.col("direction") == "min", F.col("value") >= F.col("baseline") - eps).otherwise(F.col("value") <= F.col("baseline") + eps)
    return baseline.join(metrics, "metric", "left").withColumn("ok", ok)


# --- grades and runs --------------------------------------------------------------------------------------------------


def last_of(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """E15. The last record of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def score_stats(grades: DataFrame, by: str = "domain", score: str = "score") -> DataFrame:
    """E14. n, mean, median and deviation of scores, for each domain and overall (null domain)."""
    s = F.col(score).cast("double")
    return grades.cube(by).agg(F.count(s).alias("n"), F.round(F.avg(s), 2).alias("mean"), F.round(F.median(s), 2).alias("median"), F.round(F.stddev_pop(s), 2).alias("stddev"))


def letter(score: Column) -> Column:
    """E24. Bands from 90, 80, 65 and 50."""
    out = F.when(score.isNull(), F.lit(None))
    for least, name in LETTERS:
        out = out.when(score >= least, F.lit(name))
    return out.otherwise("F")


def letters(grades: DataFrame, by: str = "domain") -> DataFrame:
    """E14. How many of each letter, by domain."""
    return grades.groupBy(by).pivot("letter", ["A", "B", "C", "D", "F"]).agg(F.count(F.lit(1))).na.fill(0)


def completion(runs: DataFrame) -> DataFrame:
    """E14, E19, E20. Shares of records that completed and that failed."""
    done = F.avg((F.col("status") == "completed").cast("double"))
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.round(done, 4).alias("completion_rate"), F.round(1 - done, 4).alias("error_rate"))


def latency(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """E18. min, max, mean, median and the 95th percentile by nearest rank: the value at place round(0.95 (n - 1)) from 0
    (a half to the even place), found through running counts of distinct values, so no group is collected."""
    counts = runs.groupBy(*by, "latency").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*by)
    at = counts.withColumn("upto", F.sum("c").over(w.orderBy("latency"))).withColumn("n", F.sum("c").over(w))
    p95 = at.where(F.col("upto") > F.bround(0.95 * (F.col("n") - 1))).groupBy(*by).agg(F.min("latency").alias("p95"))
    base = runs.groupBy(*by).agg(F.min("latency").alias("least"), F.max("latency").alias("most"), F.round(F.avg("latency"), 3).alias("mean"), F.round(F.median("latency"), 3).alias("median"))
    return base.join(p95, list(by)) if by else base.crossJoin(p95)


def groundedness_summary(verified: DataFrame, by: list[str] = ()) -> DataFrame:
    """E17. Over answers that cite something: how many, with unsupported claims, and the mean of their rates."""
    v = verified.where("n_cited > 0").withColumn("rate", F.col("n_unsupported") / F.col("n_cited"))
    return v.groupBy(*by).agg(F.count(F.lit(1)).alias("answers_scored"), F.count_if(F.col("n_unsupported") > 0).alias("with_unsupported"), F.coalesce(F.sum("n_cited"), F.lit(0)).alias("cited"), F.coalesce(F.sum("n_unsupported"), F.lit(0)).alias("unsupported"), F.round(1 - F.coalesce(F.avg("rate"), F.lit(0.0)), 4).alias("mean_groundedness"))


def anchors_verified(grades: DataFrame) -> DataFrame:
    """E16. Over evidence anchors of grades (array of structs): how many, verified, unavailable."""
    a = grades.select(F.explode("anchors").alias("a")).select("a.*")
    ok = F.count_if(F.col("status") == "verified")
    return a.agg(F.count(F.lit(1)).alias("total"), ok.alias("verified"), F.count_if(F.col("status") == "verification_unavailable").alias("unavailable"), F.round(F.coalesce(ok / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 3).alias("verified_fraction"))


def chosen_variant(cases: DataFrame) -> DataFrame:
    """E21. (question_id, pos, variant): the longest, the first of those."""
    return cases.groupBy("question_id").agg(F.max_by("variant", F.struct(F.length("variant"), -F.col("pos"))).alias("variant"))


# --- blinded comparison -----------------------------------------------------------------------------------------------


def blinded(answers: DataFrame, arms: list[str]) -> DataFrame:
    """E22. (question, arm, ...) of questions that all arms answered: a slot for each, rotated by the question's place."""
    n = len(arms)
    common = answers.where(F.col("arm").isin(arms)).groupBy("question").agg(F.countDistinct("arm").alias("n")).where(F.col("n") == n).select("question")
    number = numbered(common, "question").withColumnRenamed("n", "q_ord")
    arm = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col("arm")) - 1
    return answers.join(number, "question").where(F.col("arm").isin(arms)).withColumn("slot", F.pmod(arm - F.col("q_ord"), F.lit(n)))


def numbered(rows: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """The place (from 0) of each distinct key in their order, without ordering all in one task: keys are dealt by range,
    ordered within a part, and parts' sizes are added up."""
    dealt = rows.select(key).distinct().repartitionByRange(parts, key).withColumn("part", F.spark_partition_id())
    dealt = dealt.withColumn("in_part", F.row_number().over(W.partitionBy("part").orderBy(key)) - 1)
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("low"))
    starts = sizes.select(F.col("part"), F.coalesce(F.sum("c").over(W.orderBy("low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return dealt.join(starts, "part").select(key, (F.col("start") + F.col("in_part")).alias("n"))


def side(*keys) -> Column:
    """E23. 0 or 1 by a hash of the keys, even over many questions."""
    return F.conv(F.left(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]).cast("binary"), 256), F.lit(1)), 16, 10).cast("int") % 2


def pair_order(questions: DataFrame, hard: DataFrame, key: str = "question") -> DataFrame:
    """E23. Questions in the order of the sheet, from place 0: hard ones first, then by id as text."""
    marked = questions.select(key).distinct().join(hard.select(F.col(key).alias("_h")).distinct(), F.col(key) == F.col("_h"), "left")
    marked = marked.select(key, F.when(F.col("_h").isNotNull(), "HARD").otherwise("easy").alias("tier")).withColumn("_k", F.concat(F.col("tier"), F.col(key).cast("string")))
    return marked.join(numbered(marked, "_k"), "_k").select(key, "tier", F.col("n").alias("place"))


def drift(fresh: DataFrame, original: DataFrame, most: float = 5.0) -> DataFrame:
    """E24. (question, score) of the base arm, blinded, and as graded before: both means over the fresh questions that were
    graded before, their difference, and whether graders have drifted too far for arms to be compared."""
    both = fresh.select("question", F.col("score").alias("f")).join(original.select("question", F.col("score").alias("o")), "question").where("f is not null and o is not null")
    m = both.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("o"), 4).alias("original"), F.round(F.avg("f"), 4).alias("fresh"))
    return m.withColumn("drift", F.round(F.col("fresh") - F.col("original"), 4)).withColumn("warning", F.coalesce(F.abs("drift") > most, F.lit(False)))


def run_logs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E19. (question_id, question, status, attempts, selected_variant): the log of what failed, and that of variants chosen."""
    errors = runs.where(F.col("status") != "completed").select("question_id", "status", "attempts")
    return errors, runs.where("selected_variant is not null").select("question_id", "question", "selected_variant", "status")


def unblinded(scores: DataFrame, keymap: DataFrame, arms: list[str]) -> DataFrame:
    """E24. (question, slot, score) and (question, slot, arm): a row a question with each arm's score."""
    return scores.join(keymap, ["question", "slot"]).groupBy("question").pivot("arm", arms).agg(F.first("score"))


def head_to_head(wide: DataFrame, arms: list[str]) -> DataFrame:
    """E24. Of every two arms: wins, losses, ties and mean difference; a long drift between the halves is none of ours."""
    pairs = [(a, b) for i, a in enumerate(arms) for b in arms[i + 1 :]]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs]))
    return wide.select(each.alias("p")).select("p.*").where("x is not null and y is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("x > y")).alias("wins_a"), F.count_if(F.expr("x < y")).alias("wins_b"), F.count_if(F.expr("x = y")).alias("ties"), F.round(F.avg(F.expr("x - y")), 4).alias("mean_delta"))


def clarity(wide: DataFrame, treated: str, base: str, total: int) -> DataFrame:
    """E25. Whether the running comparison is decided: CLEAR, LIKELY, OPEN, EARLY or COMPLETE."""
    d = F.col(treated) - F.col(base)
    a = wide.where(d.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.avg(d).alias("mean_delta"))
    floor = F.greatest(F.lit(3), F.ceil(F.lit(0.3 * total)))
    size, most = F.abs("mean_delta"), F.greatest("wins", "losses")
    said = F.when(F.col("n") >= total, "COMPLETE").when(F.col("n") < floor, "EARLY").when((most == F.col("n")) & (size >= 15), "CLEAR").when((most / F.col("n") >= 0.8) & (size >= 12), "LIKELY").otherwise("OPEN")
    return a.withColumn("verdict", said).withColumn("mean_delta", F.round("mean_delta", 4))


def compared(a: DataFrame, b: DataFrame, key: str = "question") -> DataFrame:
    """E26. Two arms side by side, whoever lacks a question: scores and their difference."""
    return a.select(key, F.col("score").alias("score_a")).join(b.select(key, F.col("score").alias("score_b")), key, "full_outer").withColumn("delta", F.col("score_b") - F.col("score_a"))


def paired(both: DataFrame, seeds: int = 200) -> DataFrame:
    """E31. Mean difference, how many rose and fell, paired t, and a bootstrap interval: each seed weights a question by a
    Poisson draw from a hash, so resampling is a sum."""
    d = both.where("delta is not null").select("question", F.col("delta").cast("double").alias("d"))
    a = d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 4).alias("mean_delta"), F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("worsened"), F.count_if(F.col("d") == 0).alias("unchanged"), F.round(F.avg("d") / F.nullif(F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))), F.lit(0.0)), 4).alias("t"))
    u = F.pmod(F.xxhash64("question", "seed"), F.lit(1 << 30)) / (1 << 30)
    # cumulative probabilities of a Poisson count of mean 1
    cuts, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(1, 9):
        total += p
        cuts.append(total)
        p /= k
    weight = sum(((u > c).cast("int") for c in cuts), F.lit(0))
    means = d.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds)))).withColumn("w", weight).groupBy("seed").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return a.crossJoin(means.agg(F.round(F.expr("percentile(m, 0.025)"), 4).alias("low"), F.round(F.expr("percentile(m, 0.975)"), 4).alias("high")))


# --- ledgers ----------------------------------------------------------------------------------------------------------


def defects(grades: DataFrame, kinds: dict[str, tuple[str, str, float]], routes: dict[str, str]) -> DataFrame:
    """E27. One row for each entry of a grade's lists: kinds gives a list column's category, severity and confidence; an
    entry that a route's pattern matches gets the route's category."""
    out = None
    for column, (category, severity, confidence) in kinds.items():
        e = grades.select("question_id", F.posexplode(column).alias("i", "basis"))
        c = F.lit(None).cast("string")
        for name, pattern in routes.items():
            c = F.coalesce(c, F.when(F.col("basis").rlike(pattern), F.lit(name)))
        e = e.select("question_id", F.coalesce(c, F.lit(category)).alias("category"), F.lit(severity).alias("severity"), F.left(T.collapsed("basis"), F.lit(240)).alias("excerpt"), F.lit(confidence).alias("confidence"), F.lit(column).alias("list"), "i")
        out = e if out is None else out.unionByName(e)
    return out.withColumn("defect_id", F.concat_ws("-", F.col("question_id").cast("string"), "category", "list", F.col("i").cast("string"))).drop("list", "i")


#: The probable layer of a defect. Fixed values.
LAYERS = {"unsupported_claim": "model_synthesis", "disambiguation_failure": "query_decomposition"}


def verification_defects(runs: DataFrame) -> DataFrame:
    """E27. (question_id, answer, n_cited, n_unsupported, unsupported_markers): a defect for each answer some of whose cited claims
    their sources do not entail."""
    basis = F.concat(F.lit("verification: "), F.col("n_unsupported").cast("string"), F.lit("/"), F.coalesce("n_cited", F.lit(0)).cast("string"), F.lit(" cited claims not entailed by cited source (markers: "), F.array_join(F.coalesce("unsupported_markers", F.array().cast("array<string>")), ", "), F.lit(")"))
    return _single(runs.where("n_unsupported > 0"), "unsupported_claim", F.coalesce("answer", F.lit("")), basis, 0.5, "hypothesis")


def status_defects(grades: DataFrame) -> DataFrame:
    """E27. (question_id, letter, usability, reason): a defect for each answer that could not be graded."""
    reason = F.coalesce("reason", F.lit("engine returned an empty/None answer after disambiguation"))
    basis = F.lit("Not gradable: empty answer after disambiguation narrowed question scope")
    return _single(grades.where("letter = 'Not gradable' or usability = 'not gradable'"), "disambiguation_failure", reason, basis, 0.7, "supported")


def _single(rows: DataFrame, category: str, excerpt: Column, basis: Column, confidence: float, causal: str) -> DataFrame:
    """One defect of a question."""
    return rows.select("question_id", F.lit(category).alias("category"), F.lit("material").alias("severity"), F.left(T.collapsed(excerpt), F.lit(240)).alias("excerpt"), F.lit(confidence).alias("confidence"), F.concat_ws("-", F.col("question_id").cast("string"), F.lit(category), F.lit("0")).alias("defect_id"), basis.alias("basis"), F.lit(LAYERS[category]).alias("layer"), F.lit(causal).alias("causal_status"))


def defect_clusters(ledger: DataFrame) -> DataFrame:
    """E28. Counts by category and by severity."""
    return ledger.cube("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")).where("g in (1, 2)").drop("g")


def missed(hits: DataFrame) -> DataFrame:
    """E32. (arm, query_id, hit): queries by how many arms miss them."""
    return hits.groupBy("query_id").agg(F.count_if(F.col("hit").isNull()).alias("missed_by"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("arm")))).alias("arms")).where("missed_by > 0")


def judge_coverage(verdicts: DataFrame) -> DataFrame:
    """E13. (case_id, verdict): per cent covered, a partial counting half."""
    return verdicts.groupBy("case_id").agg(F.count(F.lit(1)).alias("items"), F.round(100 * (F.count_if(F.col("verdict") == "covered") + 0.5 * F.count_if(F.col("verdict") == "partial")) / F.count(F.lit(1)), 1).alias("coverage_pct"))
