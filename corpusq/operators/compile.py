"""Compiling claims into sections, near-duplicate collapse, references, and what is learnt from feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import written


#: Sets that have one token in their prefix, before that token's sets are split over tasks.
SPLIT = 4096


def _sides(rows: DataFrame, threshold: float, measure: str, by: str) -> tuple[DataFrame, DataFrame]:
    """The tokens by which sets meet, rarest first: (board, t, part, a, an, ar) of a set as the smaller one, and (board, t, part, b,
    bn, br) as the larger one, with its size and the token's rank in it. A pair's first common token lies in the prefix of both under
    jaccard; for the overlap coefficient in that of the smaller set, and in the larger one early enough that what follows can hold the
    share asked for, so of a larger set only tokens go on that lie in some smaller set's prefix and leave room for the smallest of those."""
    sets = rows.where(F.size("tokens") > 0).select(by, "id", F.explode("tokens").alias("t"), F.size("tokens").alias("n"))
    frequency = sets.groupBy(by, "t").agg(F.count(F.lit(1)).alias("f"))
    ranked = sets.join(frequency, [by, "t"]).withColumn("r", F.row_number().over(W.partitionBy(by, "id").orderBy("f", "t"))).where("f > 1")
    early = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    met = early.groupBy(by, "t").agg(F.min("n").alias("least"), F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"))
    left = early.join(met, [by, "t"]).select(by, "t", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("a"), F.col("n").alias("an"), F.col("r").alias("ar"))
    later = (early if measure == "jaccard" else ranked).join(met, [by, "t"]).where(F.col("n") - F.col("r") + 1 >= threshold * F.col("least") - 1e-9)
    right = later.select(by, "t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("bn"), F.col("r").alias("br"))
    return left, right


def similar_pairs(rows: DataFrame, threshold: float, measure: str = "jaccard", by: str = "board") -> DataFrame:
    """D1, D2, D3. (board, id, tokens as an array) to pairs (board, a, b), a < b, of at least that similarity. Candidates share a
    token among each set's rarest; the number of those is such that similar sets must (for the overlap coefficient, of
    the smaller set), and what follows that token in both sets must be enough. Sets are compared once, on their sizes and
    what they share."""
    left, right = _sides(rows, threshold, measure, by)
    rest = F.least(F.col("an") - F.col("ar"), F.col("bn") - F.col("br")) + 1
    if measure == "jaccard":
        fits = (F.least("an", "bn") >= threshold * F.greatest("an", "bn") - 1e-9) & (rest >= threshold / (1 + threshold) * (F.col("an") + F.col("bn")) - 1e-9)
    else:
        fits = (F.col("an") <= F.col("bn")) & (rest >= threshold * F.col("an") - 1e-9)
    pairs = left.join(right, [by, "t", "part"]).where((F.col("a") != F.col("b")) & fits).select(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    s = rows.select(by, "id", "tokens")
    both = pairs.join(s.select(by, F.col("id").alias("a"), F.col("tokens").alias("x")), [by, "a"]).join(s.select(by, F.col("id").alias("b"), F.col("tokens").alias("y")), [by, "b"])
    shared = F.size(F.array_intersect("x", "y"))
    value = shared / F.size(F.array_union("x", "y")) if measure == "jaccard" else shared / F.least(F.size("x"), F.size("y"))
    return both.where(value >= threshold).select(by, "a", "b")


#: Rounds over all boards before small ones are finished by themselves, and the open pairs that make a board small.
ROUNDS, SMALL = 4, 1_000_000


def _finished(key, frame):
    """A board's open pairs, gone through in order: a row is kept unless an earlier kept one is paired with it. In time and
    memory in proportion to the pairs, of which there are SMALL at most."""
    import pandas as pd

    frame = frame.sort_values(["b", "a"], kind="stable")
    gone: set = set()
    for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
        # all pairs of a as the later one stand before this, so a is decided
        if a not in gone:
            gone.add(b)
    ids = pd.unique(pd.concat([frame["a"], frame["b"]]))
    return pd.DataFrame({"board": [key[0]] * len(ids), "id": ids, "kept": [i not in gone for i in ids.tolist()]})


def greedy(rows: DataFrame, pairs: DataFrame, by: str = "board") -> DataFrame:
    """D1, D3. Going through a board's rows in order of id, a row is kept unless it is paired with an earlier kept row. Done
    in rounds over all boards: rows without an undecided earlier neighbour are kept, and their later neighbours go. After ROUNDS
    of them only chains are left; boards of few open pairs are finished each in one task, whatever the length of their chains, and
    the rounds go on for others until they are small. Returns (board, id, kept, of): of is the earliest kept neighbour of a row that went."""
    pairs = written(pairs.select(by, "a", "b"))
    state = written(pairs.select(by, F.col("a").alias("id")).unionByName(pairs.select(by, F.col("b").alias("id"))).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    rounds = 0
    while True:
        open_ = state.where("kept is null").select(by, "id")
        if open_.isEmpty():
            break
        rounds += 1
        if rounds > ROUNDS:
            left = pairs.join(open_.withColumnRenamed("id", "a"), [by, "a"], "left_semi").join(open_.withColumnRenamed("id", "b"), [by, "b"], "left_semi").select(by, "a", "b")
            small = left.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= SMALL).select(by)
            kind = {f.name: f.dataType.simpleString() for f in state.schema.fields}
            done = left.join(small, by, "left_semi").groupBy(by).applyInPandas(_finished, f"board {kind[by]}, id {kind['id']}, kept boolean").withColumnRenamed("board", by).withColumnRenamed("kept", "now")
            # a row of a small board without an open pair has no earlier neighbour that is kept
            alone = open_.join(small, by, "left_semi").select(by, "id", F.lit(True).alias("alone"))
            state = written(state.join(done, [by, "id"], "left").join(alone, [by, "id"], "left").select(by, "id", F.coalesce("kept", "now", "alone").alias("kept")))
            open_ = state.where("kept is null").select(by, "id")
            if open_.isEmpty():
                break
        blocked = pairs.join(open_.withColumnRenamed("id", "a"), [by, "a"], "left_semi").select(by, F.col("b").alias("id")).distinct()
        winners = open_.join(blocked, [by, "id"], "left_anti").withColumn("won", F.lit(True))
        losers = pairs.join(winners.select(by, F.col("id").alias("a")), [by, "a"], "left_semi").select(by, F.col("b").alias("id")).distinct().withColumn("lost", F.lit(True))
        state = written(state.join(winners, [by, "id"], "left").join(losers, [by, "id"], "left").select(by, "id", F.coalesce("kept", F.when(F.col("won"), True), F.when(F.col("lost"), False)).alias("kept")))
    kept = state.where("kept").select(by, F.col("id").alias("a"))
    of = pairs.join(kept, [by, "a"], "left_semi").groupBy(by, F.col("b").alias("id")).agg(F.min("a").alias("of"))
    decided = rows.select(by, "id").join(state, [by, "id"], "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
    return decided.join(of, [by, "id"], "left").select(by, "id", "kept", F.when(~F.col("kept"), F.col("of")).alias("of"))


def collapsed(claims: DataFrame, threshold: float = 0.72) -> DataFrame:
    """D1. (board, id in order, section, text, status): a claim near an earlier kept one of another section goes, and its
    section refers there; quarantined claims neither go nor make others go."""
    open_ = claims.where(~F.coalesce(F.col("status") == "quarantine", F.lit(False)))
    tokens = open_.select("board", "id", "section", F.array_distinct(T.tokens("text")).alias("tokens"))
    pairs = similar_pairs(tokens, threshold)
    of = claims.select("board", "id", "section")
    other = pairs.join(of.select("board", F.col("id").alias("a"), F.col("section").alias("sa")), ["board", "a"]).join(of.select("board", F.col("id").alias("b"), F.col("section").alias("sb")), ["board", "b"]).where("sa <> sb")
    marks = greedy(claims, other)
    target = of.select("board", F.col("id").alias("of"), F.col("section").alias("see"))
    return marks.join(target, ["board", "of"], "left").select("board", "id", "kept", "see")


def merged(cards: DataFrame, threshold: float = 0.7) -> DataFrame:
    """D3. Cards of a board in order; one whose words lie over the threshold within an earlier kept one's goes, or one
    without words. (The threshold is passed when exceeded.)"""
    tokens = cards.select("board", "id", F.array_distinct(T.words(F.lower("text"))).alias("tokens"))
    marks = greedy(tokens, similar_pairs(tokens, threshold + 1e-9, "overlap"))
    return marks.join(tokens.where(F.size("tokens") > 0).select("board", "id"), ["board", "id"], "left_semi")


def residual_pairs(claims: DataFrame, threshold: float = 0.72) -> DataFrame:
    """D2. How many near pairs of different sections are left in each board."""
    tokens = claims.select("board", "id", "section", F.array_distinct(T.tokens("text")).alias("tokens"))
    of = claims.select("board", "id", "section")
    p = similar_pairs(tokens, threshold).join(of.select("board", F.col("id").alias("a"), F.col("section").alias("sa")), ["board", "a"]).join(of.select("board", F.col("id").alias("b"), F.col("section").alias("sb")), ["board", "b"]).where("sa <> sb")
    return p.groupBy("board").agg(F.count(F.lit(1)).alias("pairs"))


def compiled(claims: DataFrame, sources: DataFrame, sections: list[str], cite: Column, most: int = 2) -> DataFrame:
    """D4. (board, id, section, text, status) and (board, id, s_ord, title, body, accepted): sections in their set order, then
    as first seen; a claim cites its first accepted sources that support it (cite: a condition over text and body), which
    get dense numbers as first cited; claims left without one are to verify; off-target ones go to quarantine."""
    known = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    seen = claims.groupBy("board", "section").agg(F.min("id").alias("first"))
    c = claims.join(seen, ["board", "section"]).withColumn("s_rank", F.when(known > 0, known).otherwise(len(sections) + 1)).withColumn("place", F.row_number().over(W.partitionBy("board").orderBy("s_rank", "first", "id")))
    ok = c.join(sources.where("accepted"), ["board", "id"]).withColumn("r", F.row_number().over(W.partitionBy("board", "id").orderBy("s_ord"))).where((F.col("r") <= most) & cite)
    number = ok.groupBy("board", "title").agg(F.min(F.struct("place", "s_ord")).alias("at")).withColumn("n", F.row_number().over(W.partitionBy("board").orderBy("at", "title")))
    cites = ok.join(number, ["board", "title"]).groupBy("board", "id").agg(F.array_sort(F.collect_set("n")).alias("cites"))
    status = F.when(F.col("status") == "off_target", "quarantine").when(F.size(F.coalesce("cites", F.array().cast("array<int>"))) > 0, "supported").otherwise("verify")
    return c.join(cites, ["board", "id"], "left").select("board", "place", "id", "section", status.alias("status"), F.coalesce("cites", F.array().cast("array<int>")).alias("cites"))


def evidence_summary(board_claims: DataFrame) -> DataFrame:
    """D5. How many claims of a board are supported, to verify, in quarantine; the three add up."""
    return board_claims.groupBy("board").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "verify", "quarantine")])


def source_titles(sources: DataFrame, most: int = 15) -> DataFrame:
    """D6. Per board and verdict, the first distinct titles in order."""
    once = sources.groupBy("board", "accepted", "title").agg(F.min(F.struct("id", "s_ord")).alias("at")).withColumn("n", F.row_number().over(W.partitionBy("board", "accepted").orderBy("at", "title"))).where(F.col("n") <= most)
    return once.select("board", "accepted", "title", "n")


def references(cited: DataFrame, pool: DataFrame) -> DataFrame:
    """D7. (case_id, section, ref) of refs that the pool has: each once, with its sections, by kind and number."""
    r = cited.join(pool.select("case_id", "ref", "citation"), ["case_id", "ref"]).groupBy("case_id", "ref", "citation").agg(F.array_sort(F.collect_set("section")).alias("sections"))
    order = W.partitionBy("case_id").orderBy(F.left("ref", F.lit(1)), F.expr("try_cast(substr(ref, 2) as int)"), "ref")
    return r.withColumn("n", F.row_number().over(order))


def key_terms(text) -> Column:
    """D9. A text's distinct content tokens, sorted and joined."""
    return F.array_join(F.array_sort(T.content_tokens(text)), " ")


MARKS = {"wrong": "suppress", "important": "elevate", "missing": "add"}


def distilled(feedback: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """D9. (profile, mark, text, topic, ord) to preferences by (profile, action, pattern): weight counts marks, sources keep
    each topic once in order, the text is the first. Existing preferences come first and add their weight."""
    m = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    new = feedback.select("profile", F.try_element_at(m, F.col("mark")).alias("action"), key_terms("text").alias("pattern"), "text", F.lit(1).cast("long").alias("weight"), F.array_compact(F.array("topic")).alias("sources"), F.col("ord").cast("long").alias("ord")).where("action is not null and pattern <> ''")
    if existing is not None:
        new = existing.select("profile", "action", "pattern", "text", F.col("weight").cast("long").alias("weight"), "sources", F.lit(-1).cast("long").alias("ord")).unionByName(new)
    ordered = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sources"))), lambda x: x["sources"])))
    return new.groupBy("profile", "action", "pattern").agg(F.min_by("text", "ord").alias("text"), F.sum("weight").alias("weight"), ordered.alias("sources"))


def preferred(cards: DataFrame, preferences: DataFrame) -> DataFrame:
    """D10. (board, profile, id, text): cards that hold all of a pattern's terms go if it suppresses with weight 2 or more,
    else move last; missing ones are added; elevated ones come first. place is the order."""
    p = preferences.withColumn("terms", F.split("pattern", " ")).withColumnRenamed("text", "p_text").withColumnRenamed("profile", "p_profile")
    c = cards.withColumn("tokens", T.content_tokens("text"))
    hit = c.join(p, (F.col("p_profile") == "") | (F.col("p_profile") == F.col("profile"))).where(F.size(F.array_except("terms", "tokens")) == 0)
    flags = hit.groupBy("board", "id").agg(F.max((F.col("action") == "suppress") & (F.col("weight") >= 2)).alias("gone"), F.max((F.col("action") == "suppress") & (F.col("weight") < 2)).alias("last"), F.max(F.col("action") == "elevate").alias("first"))
    kept = c.drop("tokens").join(flags, ["board", "id"], "left").where(~F.coalesce("gone", F.lit(False)))
    alive = hit.join(flags.where("not gone"), ["board", "id"], "left_semi").where("action = 'add'").select("board", "pattern").distinct()
    adds = cards.select("board", "profile").distinct().join(p.where("action = 'add'"), (F.col("p_profile") == "") | (F.col("p_profile") == F.col("profile"))).join(alive, ["board", "pattern"], "left_anti")
    added = adds.select("board", "profile", F.lit(1 << 40).cast("long").alias("id"), F.col("p_text").alias("text"), F.lit(0).alias("last"), F.lit(False).alias("first"), F.lit(1).alias("new"))
    both = kept.select("board", "profile", F.col("id").cast("long").alias("id"), "text", F.coalesce("last", F.lit(False)).cast("int").alias("last"), F.coalesce("first", F.lit(False)).alias("first"), F.lit(0).alias("new")).unionByName(added)
    order = W.partitionBy("board").orderBy(F.desc("first"), "new", "last", "id", "text")
    return both.withColumn("place", F.row_number().over(order)).select("board", "place", "id", "text")


def other_features(evidence: DataFrame) -> DataFrame:
    """D11. (key, feature): for each, the other features that use the same evidence."""
    all_of = evidence.groupBy("key").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    return evidence.select("key", "feature").distinct().join(all_of, "key").withColumn("others", F.array_except("features", F.array("feature"))).drop("features")


def rendered(rows: DataFrame, title: str = "board") -> DataFrame:
    """D12. One Markdown text a board: its sections in order of place, with their claims."""
    s = rows.groupBy("board", "section").agg(F.min("place").alias("at"), F.array_sort(F.collect_list(F.struct("place", F.concat(F.when(F.col("status") == "supported", "- [x] ").otherwise("- [ ] "), F.col("text")).alias("t")))).alias("c"))
    body = F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.array_join(F.transform("c", lambda x: x["t"]), "\n")).alias("t"))))
    return s.groupBy("board").agg(F.concat(F.lit(f"# {title} "), F.col("board").cast("string"), F.lit("\n\n"), F.array_join(F.transform(body, lambda x: x["t"]), "\n\n")).alias("markdown"))


def patched(cards: DataFrame, fixes: DataFrame) -> DataFrame:
    """D13. (board, f_ord, match, question): each fix replaces the question of the first card that holds its text; of several
    fixes for one card the last holds."""
    at = cards.join(fixes.withColumnRenamed("question", "fixed"), "board").where(F.contains(F.lower("question"), F.lower("match"))).groupBy("board", "f_ord", "fixed").agg(F.min("id").alias("id"))
    last = at.groupBy("board", "id").agg(F.max_by("fixed", "f_ord").alias("fixed"))
    return cards.join(last, ["board", "id"], "left").withColumn("question", F.coalesce("fixed", "question")).drop("fixed")


def with_templates(templates: DataFrame, generated: DataFrame, keys: list[str]) -> DataFrame:
    """D14. Templates and generated rows, a template winning its place."""
    both = templates.withColumn("_p", F.lit(0)).unionByName(generated.withColumn("_p", F.lit(1)))
    rest = [c for c in both.columns if c not in (*keys, "_p")]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_p", *rest)).alias("r")).select(*keys, "r.*")


def provenance(boards: DataFrame, least: int) -> DataFrame:
    """D15. (board, enabled, failed, n_cards): where a board's cards come from, and why it fell back."""
    reason = F.when(~F.col("enabled"), "disabled").when(F.col("failed"), "error").when(F.col("n_cards") < least, "under-produced")
    return boards.withColumn("reason", reason).withColumn("degraded", F.col("enabled") & reason.isNotNull()).withColumn("source", F.when(reason.isNull(), "generated").otherwise("templates"))
