"""Structured sources and records: captions over several lines, article XML, manifests, boards, specifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.articles import article_parts

LABEL = r"(?i)^\s*(fig(ure)?|plate)\b"


def complete_caption(page_text, most: int = 240) -> Column:
    """P17. The first caption line of a page with the lines that go on from it, until a blank line, another label or the
    limit; cut at the first sentence end past 60 letters; without an open bracket or a broken word at the end."""
    lines = F.transform(T.lines(page_text), T.trimmed)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(LABEL)), True)
    rest = F.slice(lines, F.greatest(at, F.lit(1)).cast("int") + 1, F.size(lines))
    start = F.struct(F.try_element_at(lines, F.greatest(at, F.lit(1)).cast("int")).alias("t"), F.lit(True).alias("open"))
    joined = F.aggregate(
        rest,
        start,
        lambda acc, x: F.when(~acc["open"] | (x == "") | x.rlike(LABEL), F.struct(acc["t"].alias("t"), F.lit(False).alias("open"))).otherwise(F.struct(F.concat(acc["t"], F.lit(" "), x).alias("t"), (F.length(acc["t"]) + F.length(x) + 2 < most).alias("open"))),
    )["t"]
    end = F.instr(F.substring(joined, F.lit(61), F.length(joined)), ". ")
    head = F.left(joined, F.lit(most))
    cut = F.when(end > 0, F.left(joined, end + 60)).when(F.length(joined) > most, F.concat(F.when(F.instr(head, " ") > 0, F.left(head, F.length(head) - F.instr(F.reverse(head), " "))).otherwise(head), F.lit(" …"))).otherwise(joined)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    closed = F.when(count(cut, "(") > count(cut, ")"), T.trimmed(F.left(cut, F.length(cut) - F.instr(F.reverse(cut), "(")))).otherwise(cut)
    return F.when(at > 0, T.trimmed(F.regexp_replace(closed, r"\s+\S*-$", "")))


#: Kinds of section without content. Fixed values.
SKIPPED_SECTIONS = ["coi-statement", "conflict-of-interest", "disclaimer", "funding-information", "funding", "data-availability", "supplementary-material", "author-contributions", "ethics-statement"]


def article_sections(articles: DataFrame, aliases: dict[str, str], least: int = 20) -> DataFrame:
    """P20. (work_id, xml) to the abstract and the body's top sections with all their text; those of a kind to skip go, a section's
    name is its kind or else its title; XML that does not parse has none, and neither has what is shorter than `least`."""
    from .clean import canonical_section

    parts = articles.where("xml is not null").select("work_id", article_parts("xml").alias("parts"))
    named = F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), F.coalesce(F.nullif(p["kind"], F.lit("")), p["title"]).alias("label"), T.collapsed(p["text"]).alias("text")))
    kept = F.filter(named, lambda n: ~n["kind"].isin(SKIPPED_SECTIONS) & (F.length(n["text"]) >= least))
    out = parts.select("work_id", F.posexplode(kept).alias("sequence", "n"))
    return out.select("work_id", "sequence", canonical_section(F.col("n.label"), aliases).alias("section"), F.col("n.text").alias("content"))


def labelled_abstracts(responses: DataFrame) -> DataFrame:
    """P26. (pmid, xml of an Abstract element) to (pmid, label, text): labels in capitals, TEXT without one, texts of one label
    joined in order. XML that does not parse has none."""
    parsed = responses.withColumn("x", F.from_xml(F.regexp_replace(F.coalesce("xml", F.lit("")), r"</?(i|b|sub|sup|u)>", ""), "AbstractText array<struct<_Label:string,_VALUE:string>>"))
    each = parsed.select("pmid", F.posexplode("x.AbstractText").alias("ord", "a"))
    label = F.coalesce(F.nullif(F.regexp_replace(F.upper(F.col("a._Label")), ":+$", ""), F.lit("")), F.lit("TEXT"))
    each = each.select("pmid", "ord", label.alias("label"), T.trimmed(F.col("a._VALUE")).alias("t")).where("t <> ''")
    return each.groupBy("pmid", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), " ").alias("text"))


# --- specifications of schematics --------------------------------------------------------------------------------------


def specifications(cases: DataFrame, archetypes: dict[str, str], regions: dict[str, str], default: tuple[str, str] = ("corridor", "cranial")) -> DataFrame:
    """X23. Two specifications a case: one by its profile's archetype, one map of its anatomy."""
    look = lambda m, d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("profile")), F.lit(d))
    kinds = F.array(look(archetypes, default[0]), F.lit("anatomy_map"))
    return cases.select("case_id", F.posexplode(kinds).alias("spec", "archetype"), F.col("side"), F.col("level"), look(regions, default[1]).alias("region"))


def contradiction(case_side, side, case_level, level, case_regions: Column | None = None, regions: Column | None = None) -> Column:
    """X23. Why a specification contradicts its case: side, level or region; null if it does not."""
    low = lambda c: F.lower(F.trim(F.coalesce(T.col(c), F.lit(""))))
    plain = lambda c: F.regexp_replace(low(c), "[^a-z0-9]", "")
    sides = ["left", "right"]
    out = F.when(low(case_side).isin(sides) & low(side).isin(sides) & (low(case_side) != low(side)), "side").when((plain(case_level) != "") & (plain(level) != "") & (plain(case_level) != plain(level)), "level")
    if regions is not None:
        out = out.when((F.size(case_regions) > 0) & (F.size(regions) > 0) & ~F.arrays_overlap(case_regions, regions), "region")
    return out


def conformance(specs: DataFrame, truth: DataFrame) -> DataFrame:
    """E33. Per case: do archetype, side and level fit, and is the flipped side refused."""
    j = specs.join(truth.select("case_id", F.col("archetype").alias("ta"), F.col("side").alias("ts"), F.col("level").alias("tl")), "case_id").where("spec = 0")
    flipped = F.when(F.col("side") == "left", "right").when(F.col("side") == "right", "left")
    return j.select("case_id", F.col("archetype").eqNullSafe(F.col("ta")).alias("archetype_ok"), F.col("side").eqNullSafe(F.col("ts")).alias("side_ok"), F.col("level").eqNullSafe(F.col("tl")).alias("level_ok"), (contradiction("side", flipped, "level", "level").isNotNull() | flipped.isNull()).alias("guard_ok"))


# --- manifests, boards, ledgers ----------------------------------------------------------------------------------------


def manifest(lines: DataFrame, sections: dict[str, tuple[str, str]]) -> DataFrame:
    """E30. (doc, ord, line) of Markdown to questions: numbered lines below a known heading, ids by the heading's prefix."""
    w = W.partitionBy("doc").orderBy("ord")
    head = F.nullif(F.regexp_extract("line", r"^##\s+(.*\S)\s*$", 1), F.lit(""))
    m = F.create_map(*[x for k, v in sections.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("domain"), F.lit(v[1]).alias("prefix")))])
    rows = lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).withColumn("s", F.try_element_at(m, F.col("section")))
    q = rows.where("s is not null").withColumn("source_number", F.expr(r"try_cast(nullif(regexp_extract(line, '^([0-9]+)\\.\\s+(.*\\S)\\s*$', 1), '') as int)")).where("source_number is not null")
    n = F.row_number().over(W.partitionBy("doc", "s.prefix").orderBy("ord"))
    return q.select("doc", F.format_string("%s-%02d", F.col("s.prefix"), n).alias("id"), F.col("s.domain").alias("domain"), "source_number", F.regexp_extract("line", r"^[0-9]+\.\s+(.*\S)\s*$", 1).alias("question"), n.alias("n"))


def manifest_errors(questions: DataFrame, expected: dict[str, int]) -> DataFrame:
    """E30. (check, offender): counts by prefix, repeated ids, numbers that do not go on from 1."""
    prefix = F.regexp_extract("id", r"^(.*)-[0-9]+$", 1)
    counts = questions.groupBy("doc", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("c"))
    m = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    wrong = counts.where(~F.coalesce(F.try_element_at(m, F.col("prefix")), F.lit(-1)).eqNullSafe(F.col("c").cast("int"))).select("doc", F.lit("count").alias("check"), F.col("prefix").alias("offender"))
    twice = questions.groupBy("doc", "id").count().where("count > 1").select("doc", F.lit("repeated").alias("check"), F.col("id").alias("offender"))
    gap = questions.where("source_number <> n").select("doc", F.lit("number").alias("check"), F.col("id").alias("offender"))
    return wrong.unionByName(twice).unionByName(gap)


def board_cards(boards: DataFrame, sections: dict[str, str], first: str) -> DataFrame:
    """E34. (board, markdown) to its statements with their section: marked lines that are no questions, under the last known
    heading."""
    lines = boards.select("board", F.posexplode(T.lines("markdown")).alias("ord", "line"))
    m = F.create_map(*[F.lit(x) for kv in sections.items() for x in kv])
    head = F.try_element_at(m, F.regexp_extract(T.trimmed("line"), r"^## (.+)$", 1))
    rows = lines.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(W.partitionBy("board").orderBy("ord")), F.lit(first)))
    card = F.regexp_extract(T.trimmed("line"), r"^- (?:[✓⚠✗]|\[.\])\s+(.*)$", 1)
    return rows.withColumn("card", T.trimmed(card)).where("card <> '' and not endswith(card, '?')").select("board", "ord", "section", "card")


def intake_accuracy(read: DataFrame, truth: DataFrame, fields: list[str], contains: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """E11. Cases whose fields are equal to the truth, contain it, or have all of its entries."""
    t = truth.select("case_id", *[F.col(c).alias(f"t_{c}") for c in (*fields, *contains, *lists)])
    j = read.join(t, "case_id")
    out = [F.count_if(F.col(c).eqNullSafe(F.col(f"t_{c}"))).alias(f"{c}_ok") for c in fields]
    out += [F.count_if(F.contains(F.lower(c), F.lower(f"t_{c}"))).alias(f"{c}_ok") for c in contains]
    has_all = lambda c: F.forall(f"t_{c}", lambda w: F.exists(c, lambda g: F.contains(F.lower(g), F.lower(w))))
    out += [F.count_if(has_all(c)).alias(f"{c}_ok") for c in lists]
    return j.agg(F.count(F.lit(1)).alias("cases"), *out)


def section_coverage(boards: DataFrame, wanted: list[str]) -> DataFrame:
    """E12. (case_id, section, cited, listed): how many wanted sections a case has, how many cite something, and whether all
    that is cited is listed."""
    made_up = F.size(F.array_except(F.flatten(F.collect_list("cited")), F.flatten(F.collect_list("listed"))))
    return boards.groupBy("case_id").agg(F.count_if(F.col("section").isin(wanted)).alias("sections"), F.count_if(F.col("section").isin(wanted) & (F.size("cited") > 0)).alias("citing"), (made_up == 0).alias("no_fabrication"))


def normalised_status(runs: DataFrame) -> DataFrame:
    """E20. A completed run with an empty answer cannot be graded."""
    empty = T.trimmed(F.coalesce("answer", F.lit(""))) == ""
    return runs.withColumn("status", F.when((F.col("status") == "completed") & empty, "not_gradable").otherwise(F.col("status")))


def results_ledger(existing: DataFrame, incoming: DataFrame, baseline: str) -> DataFrame:
    """E29. Rows by run, the newest of each; difference of means to the baseline run."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = both.groupBy("run").agg(F.max_by("mean", F.struct("_new", "ts")).alias("mean"), F.max("ts").alias("ts"))
    base = last.where(F.col("run") == baseline).select(F.col("mean").alias("b"))
    return last.join(base, how="left").select("run", "ts", "mean", F.round(F.col("mean") - F.col("b"), 4).alias("delta"))


def metric_set(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """E10. (metric, value) in long form: each metric is an aggregate over its table."""
    return reduce(DataFrame.unionByName, [df.agg(c.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value") for name, (df, c) in tables.items()])
