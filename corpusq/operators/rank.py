"""What happens to ranked lists: guards, lanes, cards, corpora, literature, figures, numbering."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import search, tag


def first_seen(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


# --- figures ----------------------------------------------------------------------------------------------------------


def off_target(topic, caption, regions: dict[str, list[str]], levels: dict[str, list[str]], nonanatomical: str | None = None) -> Column:
    """R16, R17. Why a caption does not fit a topic: not a plate, another region, another level; null if it does."""
    ct, tt = T.tags(caption, regions), T.tags(topic, regions)
    cl, tl = T.tags(caption, levels), T.tags(topic, levels)
    out = F.when(T.col(caption).rlike(nonanatomical), "nonanatomical") if nonanatomical else F.when(F.lit(False), "")
    return out.when((F.size(tt) > 0) & (F.size(ct) > 0) & ~F.arrays_overlap(ct, tt), "region").when((F.size(tl) > 0) & (F.size(cl) > 0) & (F.size(F.array_except(tl, cl)) > 0), "level")


@dataclass(frozen=True)
class Guards:
    """R16. The terms and books by which a figure is told to be off its topic; all lists are the domain's.

    not_content: a pattern of captions of pages without content. scans: terms of pictures that no board wants; angles: of such
    that no question wants either. sides: two names, each with its terms and its books' names. own: groups of terms that a
    caption may only have if the topic has one too; own_of: such groups for topics of one side. opposed: for topics of a side,
    pairs of groups of which a caption may not have only the other. levels: names with terms, for topics of the side level_of,
    looked for in caption and page; blocked: those that a topic has to name."""

    not_content: str
    sides: dict[str, tuple[list[str], list[str]]]
    scans: list[str] = ()
    angles: list[str] = ()
    own: list[list[str]] = ()
    own_of: dict[str, list[list[str]]] = field(default_factory=dict)
    opposed: dict[str, list[tuple[list[str], list[str]]]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    level_of: str = ""
    blocked: list[str] = ()


def no_content(caption, pattern: str) -> Column:
    """R17. A page of titles, contents or blanks, by its caption."""
    return F.coalesce(T.col(caption), F.lit("")).rlike(pattern)


def off_topic(topic, caption, guards: Guards, book=None, context=None, strict: bool = False) -> Column:
    """R16. Why a figure does not fit a topic, by the first guard that fires; null if it does. strict: only the guards that
    need no exact topic (content, angles, sides), for free questions."""
    low = lambda c: F.lower(F.coalesce(T.col(c), F.lit(""))) if c is not None else F.lit("")
    top, cap, shelf = low(topic), low(caption), low(book)
    page = F.concat_ws(" ", cap, low(context))

    def has(text: Column, terms) -> Column:
        return reduce(Column.__or__, [F.contains(text, F.lit(t.lower())) for t in terms], F.lit(False))

    (one, (one_terms, one_books)), (two, (two_terms, two_books)) = guards.sides.items()
    of = {s: (has(top, own), has(top, other)) for s, own, other in ((one, one_terms, two_terms), (two, two_terms, one_terms))}
    on = {one: of[one][0] & ~of[one][1], two: of[two][0] & ~of[two][1]}
    only = lambda text, yes, no: has(text, yes) & ~has(text, no)
    across = (on[one] & (only(cap, two_terms, one_terms) | has(shelf, two_books))) | (on[two] & (only(cap, one_terms, two_terms) | has(shelf, one_books)))
    foreign = lambda group: has(cap, group) & ~has(top, group)
    any_of = lambda conditions: reduce(Column.__or__, conditions, F.lit(False))

    reason = F.when(no_content(caption, guards.not_content), "no content")
    if not strict:
        reason = reason.when(has(cap, guards.scans), "scan")
    reason = reason.when(has(cap, guards.angles), "angle").when(across, "side")
    if strict:
        return reason
    asked, shown = T.tags(top, guards.levels), T.tags(page, {k: v for k, v in guards.levels.items() if k in guards.blocked})
    compartment = [of[s][0] & ((only(top, a, b) & only(cap, b, a)) | (only(top, b, a) & only(cap, a, b))) for s, pairs in guards.opposed.items() for a, b in pairs]
    reason = reason.when(any_of([foreign(g) for g in guards.own] + [of[s][0] & foreign(g) for s, groups in guards.own_of.items() for g in groups]), "own").when(any_of(compartment), "compartment")
    return reason.when(of[guards.level_of][0] & (F.size(F.array_except(shown, asked)) > 0), "level") if guards.levels else reason


def collect_figures(lanes: list[DataFrame], passages: DataFrame, guard: Column | None, cap: int, k: int) -> DataFrame:
    """R18. (query_id, path, book, page, rank, caption) lanes: each path at its best rank in a lane, lanes fused, the last
    lane's caption, guarded, then capped; a figure on a cited (book, page) takes that passage's number n, others go on."""
    best = [first_seen(lane, ["query_id", "path"], [F.col("rank")]).withColumn("lane", F.lit(i)) for i, lane in enumerate(lanes)]
    every = reduce(DataFrame.unionByName, best)
    fused = every.groupBy("query_id", "path").agg(F.round(F.sum(1 / (search.FUSION + F.col("rank"))), 9).alias("score"), F.max_by(F.struct("book", "page", "caption"), F.col("lane")).alias("m")).select("query_id", "path", "score", "m.*")
    if guard is not None:
        fused = fused.where(guard)
    top = search.top(fused, cap, ties="path")
    cited = passages.groupBy("query_id", "book", "page").agg(F.min("n").alias("n"))
    out = top.join(cited, ["query_id", "book", "page"], "left")
    fresh = F.row_number().over(W.partitionBy("query_id", F.col("n").isNull()).orderBy("rank"))
    return out.withColumn("number", F.coalesce("n", F.lit(k) + fresh)).drop("n")


def page_context(chunks: DataFrame, most: int = 6000) -> DataFrame:
    """R19. A page's chunks joined, cut to length."""
    parts = F.array_sort(F.collect_list(F.struct("i", "text")))
    return chunks.groupBy("book", "page").agg(F.left(F.array_join(F.transform(parts, lambda p: p["text"]), " "), F.lit(most)).alias("context"))


def round_robin(rows: DataFrame, cap: int, by: str = "case_id") -> DataFrame:
    """R31. The best of each intent, then the next of each, every path once, up to the cap."""
    once = first_seen(rows, [by, "path"], [F.col("rank"), F.col("intent_ord")])
    return once.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("rank", "intent_ord", "path"))).where(F.col("place") <= cap)


def card_figures(offers: DataFrame, cap: int = 8) -> DataFrame:
    """R33. (board, card_ord, path, rank): going through a board's cards, each takes its best figure that no card has taken,
    until the board has `cap`. Depends on what was taken before, so a board is a group; a board is small."""
    import pandas as pd

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for card, own in frame.sort_values(["card_ord", "rank", "path"], kind="stable").groupby("card_ord", sort=True):
            if len(out) >= cap:
                break
            free = next((p for p in own["path"] if p not in taken), None)
            if free is not None:
                taken.add(free)
                out.append((frame["board"].iloc[0], int(card), free))
        return pd.DataFrame(out, columns=["board", "card_ord", "path"])

    return offers.groupBy("board").applyInPandas(deal, "board string, card_ord long, path string")


# --- cards ------------------------------------------------------------------------------------------------------------


def prepared_cards(cards: DataFrame) -> DataFrame:
    """R22. (card_ord, question, answer, images, tags): empty ones go, a stable id, and equal ids merge: images and tags
    in the order of their first card."""
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    basis = F.concat(q, F.lit("␟"), a, F.when((q == "") & (a == ""), F.concat(F.lit("␟"), F.array_join(F.array_sort("images"), "|"))).otherwise(""))
    kept = cards.where((q != "") | (a != "") | (F.size("images") > 0)).withColumn("id", F.concat(F.lit("card-"), F.left(F.sha1(basis.cast("binary")), F.lit(16))))
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("card_ord", c))), lambda x: x[c])))
    return kept.groupBy("id").agg(F.min_by("question", "card_ord").alias("question"), F.min_by("answer", "card_ord").alias("answer"), ordered("images").alias("images"), ordered("tags").alias("tags"), F.count(F.lit(1)).alias("merged"))


def refined_cards(hits: DataFrame, k: int, weight: float = 0.05, keep_ratio: float = 0.0, stop: list[str] = T.STOP) -> DataFrame:
    """R21. (query_id, id, query, text, score): cards that name other levels than the query go; the score gets a bonus for
    each shared term; those under a share of the best go; k stay."""
    asked, named = tag.levels("query"), tag.levels("text")
    ok = (F.size(asked) == 0) | (F.size(named) == 0) | (F.size(F.array_except(asked, named)) == 0)
    terms = F.array_distinct(F.filter(T.tokens("query"), lambda t: (F.length(t) > 2) & ~t.isin(stop)))
    s = hits.where(ok).withColumn("score", F.round(F.col("score") + weight * F.size(F.array_intersect(terms, T.tokens("text"))), 6))
    if keep_ratio > 0:
        best = F.max("score").over(W.partitionBy("query_id"))
        s = s.withColumn("_b", best).where((F.col("_b") <= 0) | (F.col("score") >= keep_ratio * F.col("_b"))).drop("_b")
    return search.top(s, k)


def retrieved_cards(cards: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, reranked: bool = True, pool: int = 40, index: search.Index | None = None, **refine) -> DataFrame:
    """R20. (id, text) and (query_id, query, qvector): hybrid search, then reranking or a plain cut, then the refinement of R21."""
    found = search.hybrid(cards.select("id", "text"), vectors, queries, pool, index=index).join(queries.select("query_id", "query"), "query_id")
    found = search.rerank(found, search.lexical_score("query", "text"), pool) if reranked else found.where(F.col("rank") <= pool)
    return refined_cards(found.select("query_id", "id", "query", "text", "score"), k, **refine)


def low_confidence(tags, marks: list[str]) -> Column:
    """R23. The tokens of a tag text that are marks of low confidence."""
    return F.filter(T.words(tags), lambda t: t.isin(marks))


# --- corpora ----------------------------------------------------------------------------------------------------------


def routed(queries: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """R24. The domains whose keywords a query has; one that has none gets all."""
    found = T.tags("query", domains)
    return queries.withColumn("source_db", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(d) for d in domains]))))


def pooled(hits: DataFrame, boosts: dict[str, float], per_db: int, per_work: int, k: int) -> DataFrame:
    """R25. (query_id, id, source_db, work_id, section, score): the best of each database, boosted by section, pooled, so
    many of a work, k in all."""
    m = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    own = hits.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "source_db").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= per_db)
    own = own.withColumn("score", F.round(F.col("score") * F.coalesce(F.try_element_at(m, F.lower("section")), F.lit(1.0)), 6))
    own = own.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "work_id").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= per_work).drop("_r")
    return search.top(own, k)


def with_identifiers(rows: DataFrame, identifiers: DataFrame, schemes: list[str]) -> DataFrame:
    """R26. The first identifier of each scheme: (work_id, scheme, value, ord)."""
    wide = identifiers.where(F.col("scheme").isin(schemes)).groupBy("work_id").agg(*[F.min_by("value", F.when(F.col("scheme") == s, F.col("ord"))).alias(s) for s in schemes])
    return rows.join(wide, "work_id", "left")


# --- literature -------------------------------------------------------------------------------------------------------


def publication_tier(types: Column, tiers: dict[str, int]) -> Column:
    """R28. The tier of the first publication type that has one, else 3."""
    m = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])
    return F.coalesce(F.try_element_at(F.filter(F.transform(types, lambda t: F.try_element_at(m, F.lower(t))), lambda x: x.isNotNull()), F.lit(1)), F.lit(3))


def year_of(text) -> Column:
    """R28. The first year from 1900 on."""
    return F.nullif(F.regexp_extract(F.coalesce(T.col(text), F.lit("")), r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


def literature(hits: DataFrame, now_year: int, k: int, recent: int = 5, bucket: int = 5, boost: Column | None = None) -> DataFrame:
    """R27. (query_id, axis, rank, pmid, tier, year): each record once, where first seen, then by bucket of five ranks, tier,
    recent before old, newest first. boost: a record's number of buckets by which it goes up."""
    once = first_seen(hits, ["query_id", "pmid"], [F.col("rank"), F.col("axis")])
    if boost is not None:
        once = once.withColumn("rank", F.greatest(F.lit(1), F.col("rank") - boost * bucket))
    old = F.when(F.lit(now_year) - F.col("year") <= recent, 0).otherwise(1)
    order = W.partitionBy("query_id").orderBy(F.floor((F.col("rank") - 1) / bucket), "tier", old, F.desc_nulls_last("year"), "pmid")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def quality_floor(ranked: DataFrame, k: int) -> DataFrame:
    """R29. The records of tier 2 or better, k of them; if a query has none, its first record and a note."""
    good = F.max((F.col("tier") <= 2).cast("int")).over(W.partitionBy("query_id")) == 1
    r = ranked.withColumn("_g", good).where(~F.col("_g") | (F.col("tier") <= 2))
    r = r.withColumn("_p", F.row_number().over(W.partitionBy("query_id").orderBy("place")))
    return r.where(F.col("_p") <= F.when(F.col("_g"), k).otherwise(1)).withColumn("note", F.when(~F.col("_g"), "no strong evidence found")).drop("_g", "_p")


def topical(ranked: DataFrame, concepts: str = "concepts", text: str = "text") -> DataFrame:
    """R30. Records that name a concept of their query (all, if it has none); if nothing is left, the first record."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ok = (F.size(concepts) == 0) | F.exists(concepts, lambda c: F.contains(low, F.lower(c)))
    w = W.partitionBy("query_id")
    r = ranked.withColumn("_ok", ok).withColumn("_any", F.max(ok.cast("int")).over(w)).withColumn("_p", F.row_number().over(w.orderBy("place")))
    return r.where(F.col("_ok") | ((F.col("_any") == 0) & (F.col("_p") == 1))).drop("_ok", "_any", "_p")


def by_axis(queries: DataFrame, axes: dict[str, str]) -> DataFrame:
    """R38. (query_id, query) once for each axis, with the axis's suffix; an axis without one leaves the query as it is."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("suffix")) for a, s in axes.items()]))
    return queries.withColumn("a", each).select("query_id", "a.axis", T.trimmed(F.concat_ws(" ", "query", F.nullif(F.col("a.suffix"), F.lit("")))).alias("query"))


def record_fields(rows: DataFrame) -> DataFrame:
    """R38. (doi, authors, year_text, pmid, abstract): a DOI without prefix if it is one, at most three authors, year, url;
    records without an abstract go."""
    doi = F.regexp_replace(F.coalesce("doi", F.lit("")), r"(?i)^\s*doi:\s*", "")
    names = F.when(F.size("authors") <= 3, F.array_join("authors", ", ")).otherwise(F.concat(F.try_element_at("authors", F.lit(1)), F.lit(" et al.")))
    return rows.where(T.trimmed(F.coalesce("abstract", F.lit(""))) != "").withColumn("doi", F.when(doi.startswith("10."), doi)).withColumn("authors", names).withColumn("year", year_of("year_text")).withColumn("url", F.concat(F.lit("pmid:"), F.col("pmid").cast("string")))


# --- numbering and packing --------------------------------------------------------------------------------------------


def evidence_pool(rows: DataFrame, prefix: str = "T", most: int = 600) -> DataFrame:
    """R32. (case_id, intent_ord, rank, citation, text): each citation once, where first seen, numbered, with an excerpt."""
    once = first_seen(rows, ["case_id", "citation"], [F.col("intent_ord"), F.col("rank")])
    n = F.row_number().over(W.partitionBy("case_id").orderBy("intent_ord", "rank", "citation"))
    return once.withColumn("ref", F.concat(F.lit(prefix), n.cast("string"))).withColumn("excerpt", F.left(T.collapsed("text"), F.lit(most))).drop("text")


def citations(ranked: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """R34. Passages numbered 1 on in their order; figures that bring their own number after them; page_ref is the printed
    page, else the page."""
    p = ranked.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).withColumn("page_ref", F.coalesce(F.col("printed_page"), F.col("page").cast("string"))).select("query_id", "n", "book", "page_ref", "text")
    if figures is None:
        return p
    f = figures.select("query_id", F.col("number").alias("n"), "book", F.col("page").cast("string").alias("page_ref"), F.col("caption").alias("text"))
    return p.unionByName(f.join(p.select("query_id", "n"), ["query_id", "n"], "left_anti"))


def packed(cited: DataFrame, header: str = "Sources") -> DataFrame:
    """R35. One text a query: its numbered passages, in order."""
    parts = F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.coalesce("book", F.lit("")), F.lit(" p. "), F.coalesce("page_ref", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("t"))))
    return cited.groupBy("query_id").agg(F.concat(F.lit(header + "\n"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")).alias("context"), F.count(F.lit(1)).alias("n_sources"))


def evidence_rows(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """R36. Hits with a book and a page as evidence: its citation, and its figure if the asset exists."""
    h = hits.where("book is not null and page is not null").withColumn("citation", F.concat(F.col("book"), F.lit(" p. "), F.coalesce(F.col("printed_page"), F.col("page").cast("string"))))
    return h.join(assets.select("figure_path").withColumn("_a", F.lit(True)), "figure_path", "left").withColumn("figure_path", F.when(F.col("_a"), F.col("figure_path"))).drop("_a")


def gap_audit(scored: DataFrame, topics: DataFrame, strong_top: float, weak_top: float, least: int = 2, ratio: float = 0.6) -> DataFrame:
    """R37. (topic, score) hits of each topic's probe: its best score, hits of at least 0.6 of that, status, and priority."""
    best = scored.groupBy("topic").agg(F.max("score").alias("top_score"))
    n = scored.join(best, "topic").groupBy("topic", "top_score").agg(F.count_if(F.col("score") >= ratio * F.col("top_score")).alias("n_strong"))
    t = topics.join(n, "topic", "left").na.fill({"top_score": 0.0, "n_strong": 0})
    status = F.when((F.col("top_score") >= strong_top) & (F.col("n_strong") >= least), "covered").when(F.col("top_score") >= weak_top, "weak").otherwise("absent")
    return t.withColumn("status", status).withColumn("priority", F.col("consequence") * F.col("frequency"))
