"""Page cleaning, structure, and audits of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Patterns and labels of printed books. Fixed values.
REFERENCE_HEADING = r"(?i)^\s*(REFERENCES|BIBLIOGRAPHY)\s*$"
CITATION_LINE = r"^\s*[0-9]{1,3}\.\s+[A-Z][a-z]+\s+[A-Z]{1,3}[,.]"
CAPTION_LINE = r"(?i)^\s*(fig(ure)?|plate)\b[\s.:]*\S"
FOLIO = r"^[0-9]{1,4}(\.e[0-9]+)?$"
CHAPTER_MARK = r"CHAPTER\s+([0-9]{1,3})\b"
JUNK_LABEL = r"(?i)\.pdf|p\.[0-9]+-[0-9]+|^[A-Za-z0-9]{40,}$"
FRONT_MATTER = ["copyright", "dedication", "contributor", "contributors", "preface", "index", "front matter"]
NUMBERED_CHAPTER = r"^\s*[0-9]+\s*[-–]\s*\S"
FRONT_PREFIXES = ["copyright", "dedication", "contents", "table of contents", "title page", "contributors", "preface", "acknowledgment", "acknowledgement", "foreword", "index", "bibliography"]
FRONT_EXACT = ["cover", "cover page"]
LAST_CHAPTER = 470
MARKED_PAGES = 400
LABEL_GAP = 120


def without_references(pages: DataFrame) -> DataFrame:
    """P1. Text up to a reference heading, without numbered citation lines; removed_chars."""
    all_lines = T.lines("text")
    heading = F.array_position(F.transform(all_lines, lambda x: x.rlike(REFERENCE_HEADING)), True)
    before = F.when(heading > 0, F.slice(all_lines, 1, (F.greatest(heading, F.lit(1)) - 1).cast("int"))).otherwise(all_lines)
    clean = T.trimmed(F.array_join(F.filter(before, lambda x: ~x.rlike(CITATION_LINE)), "\n"))
    return pages.withColumn("clean_text", clean).withColumn("removed_chars", F.length(F.coalesce("text", F.lit(""))) - F.length("clean_text"))


def reference_share(pages: DataFrame, most: float = 0.4) -> DataFrame:
    """P2. Per book: share of characters that the reference strip removes, and whether that is too much."""
    p = without_references(pages).groupBy("book").agg(F.sum("removed_chars").alias("removed"), F.sum(F.length("clean_text")).alias("kept"))
    share = F.col("removed") / F.nullif(F.col("removed") + F.col("kept"), F.lit(0))
    return p.select("book", "removed", "kept", F.round(F.coalesce(share, F.lit(0.0)), 4).alias("share"), (F.coalesce(share, F.lit(0.0)) > most).alias("refused"))


def refuse(pages: DataFrame, most: float = 0.4) -> DataFrame:
    """P2. The pages, with an error as soon as a book has lost too much."""
    bad = reference_share(pages, most).where("refused").select("book")
    checked = pages.join(bad.withColumn("bad", F.lit(True)), "book", "left")
    return checked.withColumn("text", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("the reference strip took too much of "), F.col("book")))).otherwise(F.col("text"))).drop("bad")


def folios(spans: DataFrame) -> DataFrame:
    """P3. (book, page, pos, token, is_top) to each page's folio: its first token that looks like a page number."""
    return spans.groupBy("book", "page").agg(F.min_by("token", F.when(F.col("token").rlike(FOLIO), F.col("pos"))).alias("folio"))


def chapter_numbers(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """P4. The chapter that a page shows: a mark in its first ten lines, else a bare number at its top that is no folio."""
    head = F.array_join(F.slice(T.lines("text"), 1, 10), "\n")
    mark = F.expr("try_cast(nullif(regexp_extract(head, 'CHAPTER\\\\s+([0-9]{1,3})\\\\b', 1), '') as int)")
    shown = spans.join(folios(spans), ["book", "page"]).where(F.col("is_top") & F.col("token").rlike("^[0-9]{1,3}$") & ~F.col("token").eqNullSafe(F.col("folio")))
    number = F.col("token").cast("int")
    bare = shown.where((number > 1) & (number <= LAST_CHAPTER)).groupBy("book", "page").agg(F.min_by(number, "pos").alias("bare"))
    return pages.withColumn("head", head).withColumn("mark", mark).join(bare, ["book", "page"], "left").withColumn("chapter_number", F.coalesce("mark", "bare")).drop("head", "mark", "bare")


def filled_chapters(pages: DataFrame) -> DataFrame:
    """P5. chapter_number carried forward within its book, if one of the book's first pages shows any; else the label."""
    book = W.partitionBy("book")
    marked = F.max(F.when(F.col("page") <= MARKED_PAGES, F.col("chapter_number").isNotNull())).over(book)
    last = F.last("chapter_number", ignorenulls=True).over(book.orderBy("page"))
    return pages.withColumn("filled", F.when(F.coalesce(marked, F.lit(False)), last.cast("string")).otherwise(F.col("chapter")))


def is_junk(label: Column) -> Column:
    """P6. A label that no reader could use."""
    c = T.trimmed(F.coalesce(label, F.lit("")))
    return (c == "") | (F.length(c) > 60) | c.rlike(JUNK_LABEL) | F.lower(c).isin(FRONT_MATTER)


def is_numbered(label: Column) -> Column:
    """P7. "12 - Title"."""
    return F.coalesce(label, F.lit("")).rlike(NUMBERED_CHAPTER)


def is_front(label: Column) -> Column:
    """P7. Front matter, by its whole name or its first words."""
    c = F.lower(T.trimmed(F.coalesce(label, F.lit(""))))
    starts = F.lit(False)
    for p in FRONT_PREFIXES:
        starts = starts | c.startswith(p)
    return c.isin(FRONT_EXACT) | starts


def is_random(label: Column) -> Column:
    """P7. One long token with a digit, without space or slash."""
    c = T.trimmed(F.coalesce(label, F.lit("")))
    return ~F.contains(c, F.lit(" ")) & ~F.contains(c, F.lit("/")) & ~is_numbered(label) & (F.length(c) > 25) & c.rlike("[0-9]")


def toc_boundary(toc: DataFrame, foreign: str = r"^Chapter [0-9]+:", title: str | None = None) -> DataFrame:
    """P8. (book, page, title): last numbered chapter and the first foreign bookmark after it, per book."""
    last = toc.groupBy("book").agg(F.max(F.when(is_numbered(F.col("title")), F.col("page"))).alias("last_chapter"))
    alien = T.trimmed("title").rlike(foreign)
    if title:
        alien = alien | F.contains(F.lower("title"), F.lit(title))
    end = toc.join(last, "book").where(alien & (F.col("page") > F.col("last_chapter"))).groupBy("book").agg(F.min("page").alias("content_end"))
    return last.join(end, "book", "left")


def toc_labels(toc: DataFrame) -> DataFrame:
    """P8. The bookmarks that label chapters: before the boundary, neither front matter nor garbage."""
    kept = toc.join(toc_boundary(toc), "book").where("content_end is null or page < content_end")
    return kept.where(~is_front(F.col("title")) & ~is_random(F.col("title"))).select("book", "page", "title")


def before_boundary(pages: DataFrame, boundary: DataFrame) -> DataFrame:
    """P9. Pages before their book's content end."""
    return pages.join(boundary.select("book", "content_end"), "book", "left").where("content_end is null or page < content_end").drop("content_end")


def labelled(pages: DataFrame, labels: DataFrame, most_gap: int = LABEL_GAP) -> DataFrame:
    """As-of join: the nearest label at or before a page, unless that is too far back. A window over both, no pairs."""
    both = pages.select("book", "page", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("title")).unionByName(labels.select("book", "page", F.lit(0).alias("kind"), "title"))
    w = W.partitionBy("book").orderBy("page", "kind", "title")
    last = both.withColumn("at", F.last(F.when(F.col("kind") == 0, F.struct("page", "title")), ignorenulls=True).over(w)).where("kind = 1")
    return last.select("book", "page", F.when(F.col("page") - F.col("at.page") <= most_gap, F.col("at.title")).alias("label"))


def coverage(pages: DataFrame) -> DataFrame:
    """P10. Pages, those with text, their share, and those with figures, per book. The share is rounded as a binary number, as SQL
    does, not by its decimal digits."""
    some = F.count_if(F.length(F.coalesce("text", F.lit(""))) > 50)
    return pages.groupBy("book").agg(F.count(F.lit(1)).alias("pages"), some.alias("pages_with_text"), (F.round(1000 * (some / F.count(F.lit(1)))) / 1000).alias("coverage"), F.count_if("has_figure").alias("pages_with_figures"), F.countDistinct("chapter").alias("chapters"))


def probed(pages: DataFrame, least: float = 0.6) -> DataFrame:
    """P11. coverage with a verdict and its reason."""
    said = F.format_number("coverage", 2)  # of the binary value; format_string rounds the decimal digits
    return (
        coverage(pages)
        .withColumn("ok", (F.col("pages") > 0) & (F.col("coverage") >= least))
        .withColumn("reason", F.when(F.col("pages") == 0, "no pages").when(F.col("coverage") < least, F.concat(F.lit("text coverage "), said, F.lit(" is too low"))).otherwise(F.concat(F.lit("text coverage "), said)))
    )


def figure_area(boxes: DataFrame, threshold: float = 0.1) -> DataFrame:
    """P12. (book, page, x0, y0, x1, y1, page_area): share of the page that image boxes cover, overlaps counted twice. Areas are
    added as decimals, so the order in which tasks add them does not show."""
    area = F.sum(F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("decimal(24,6)")).cast("double")
    share = area / F.nullif(F.max("page_area"), F.lit(0))
    return boxes.groupBy("book", "page").agg(F.coalesce(share, F.lit(0.0)).alias("area")).withColumn("has_figure", F.col("area") >= threshold)


def plates(boxes: DataFrame, gap: float = 24.0, least: float = 0.03) -> DataFrame:
    """P13. Boxes of a page that touch, once grown by the gap, are one plate, transitively; small plates go; reading order."""
    import pandas as pd

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        todo, done = [list(map(float, r)) for r in frame[["x0", "y0", "x1", "y1"]].to_numpy()], []
        while todo:
            box = todo.pop()
            near = [b for b in todo if box[0] - gap <= b[2] and b[0] <= box[2] + gap and box[1] - gap <= b[3] and b[1] <= box[3] + gap]
            if near:
                todo = [b for b in todo if b not in near]
                near.append(box)
                todo.append([min(b[0] for b in near), min(b[1] for b in near), max(b[2] for b in near), max(b[3] for b in near)])
            else:
                done.append(box)
        page = float(frame["page_area"].max())
        done = sorted((b for b in done if (b[2] - b[0]) * (b[3] - b[1]) >= least * page), key=lambda b: (round(b[1] / 20), b[0]))
        return pd.DataFrame([(frame["book"].iloc[0], int(frame["page"].iloc[0]), i, *b) for i, b in enumerate(done)], columns=["book", "page", "ord", "x0", "y0", "x1", "y1"])

    return boxes.groupBy("book", "page").applyInPandas(merged, "book string, page int, ord int, x0 double, y0 double, x1 double, y1 double")


def box_captions(boxes: DataFrame, blocks: DataFrame, gap: float = -2.0) -> DataFrame:
    """P14. The text block that is a box's caption: the nearest labelled one in its column, else the nearest below it."""
    b = blocks.selectExpr("book", "page", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1", "text AS block")
    pairs = boxes.join(b, ["book", "page"]).where("bx0 < x1 and bx1 > x0")
    labelled_block = F.col("block").rlike(CAPTION_LINE)
    below = F.col("by0") - F.col("y1")
    distance = F.greatest(below, F.col("y0") - F.col("by1"), F.lit(0.0))
    rank = F.when(labelled_block, F.struct(F.lit(0).alias("c"), distance.alias("d"), F.col("by0").alias("y"), F.col("block").alias("t"))).when(below >= gap, F.struct(F.lit(1).alias("c"), below.alias("d"), F.col("by0").alias("y"), F.col("block").alias("t")))
    return pairs.groupBy("book", "page", "x0", "y0", "x1", "y1").agg(F.min(rank)["t"].alias("caption"))


def first_caption(c="text") -> Column:
    """P15. The first line that is a caption, trimmed."""
    return T.trimmed(F.try_element_at(F.filter(T.lines(c), lambda x: x.rlike(CAPTION_LINE)), F.lit(1)))


def effective_caption(figures: DataFrame, excluded: list[str] = (), assets: DataFrame | None = None) -> DataFrame:
    """P18. The curated caption (700 letters at most) or else the source's (320), of figures whose book is not excluded and
    whose asset exists."""
    out = figures.where(~F.col("book").isin(list(excluded))) if excluded else figures
    if assets is not None:
        out = out.join(assets.select("figure_path"), "figure_path", "left_semi")
    curated = F.nullif(T.trimmed("curated"), F.lit(""))
    return out.withColumn("effective", F.when(curated.isNotNull(), T.caption_head(curated, 700)).otherwise(T.caption_head("caption", 320)))


#: Character references that pages use. Fixed values.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """P19. An HTML text's words: br, p, div and li begin lines, alt texts stay, scripts' and styles' text stays as data."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<![^>]*>", "")
    t = F.regexp_replace(t, r"(?i)<(br|p|div|li)(\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"""(?i)<img\b[^>]*?\balt="([^"]+)"[^>]*>""", " $1 ")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, value in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(value))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return T.trimmed(F.regexp_replace(t, r"\n\s*\n+", "\n"))


def html_images(html: Column) -> Column:
    """P19. The sources of an HTML text's images, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""))


def label_counts(pages: DataFrame) -> DataFrame:
    """P6, P7. How many pages of a book have labels of each kind; `title` is the label."""
    c = F.col("title")
    return pages.groupBy("book").agg(F.count_if(is_junk(c)).alias("junk"), F.count_if(is_numbered(c)).alias("numbered"), F.count_if(is_front(c)).alias("front"), F.count_if(is_random(c)).alias("random"))


def sections(articles: DataFrame, headers: list[str]) -> DataFrame:
    """P21. (work_id, text) cut at lines that are a section header; what stands before the first is "other"; short parts go."""
    mark = "\u0001"
    pattern = r"(?im)^\s*(" + "|".join(headers) + r")\s*:?\s*$"
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), pattern, mark + "$1" + mark)
    parts = F.split(F.concat(F.lit("other" + mark), marked), mark)
    # parts: name, text, name, text ...
    pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(F.lower(F.element_at(parts, i + 1)).alias("section"), T.trimmed(F.element_at(parts, i + 2)).alias("content")))
    return articles.select("work_id", F.posexplode(F.filter(pairs, lambda p: F.length(p["content"]) >= 20)).alias("sequence", "p")).select("work_id", "sequence", "p.section", "p.content")


def canonical_section(label: Column, aliases: dict[str, str]) -> Column:
    """P22. A section's name by its aliases, else "other"."""
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(T.trimmed(label))), F.lit("other"))


def bibliography_like(c) -> Column:
    """P23. Six "et al" or more, or 40 signs of citation to a hundred words."""
    t = F.coalesce(T.col(c), F.lit(""))
    signs = F.regexp_count(t, F.lit(r"et al")) + F.regexp_count(t, F.lit(r"[0-9]{4};[0-9]+")) + F.regexp_count(t, F.lit(r"[A-Z][a-z]+ [A-Z]{1,3}[,.]"))
    return (F.regexp_count(t, F.lit("et al")) >= 6) | (signs / (F.greatest(F.size(T.words(c)), F.lit(1)) / 100) >= 40)


def label_agreement(chunks: DataFrame, books: str) -> DataFrame:
    """P23. Of chunks of matching books with a chapter number both in the text and in the label: the share that agree."""
    number = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    both = chunks.where(F.col("book").rlike(books)).select(number("text", r"CHAPTER ([0-9]{1,3})\b").alias("said"), number("chapter", r"(?:Chapter |^)([0-9]{1,3})\b").alias("labelled"))
    return both.where("said is not null and labelled is not null").agg(F.count(F.lit(1)).alias("labelled"), F.round(F.avg((F.col("said") == F.col("labelled")).cast("double")), 4).alias("agreement"))


def weak_folios(chunks: DataFrame, exempt: list[str] = (), least: float = 0.9) -> DataFrame:
    """P23. Books, but exempt ones, in which too few chunks have a printed page number."""
    rows = chunks.where(~F.col("book").isin(list(exempt))) if exempt else chunks
    return rows.groupBy("book").agg(F.round(F.avg((F.coalesce(F.length(F.col("printed_page").cast("string")), F.lit(0)) > 0).cast("double")), 4).alias("folio")).where(F.col("folio") < least)


def short_chunks(chunks: DataFrame, least: int = 50) -> DataFrame:
    """P23. Chunks of text alone, on no figure page and without a caption, of too few letters: their number."""
    return chunks.where(~F.coalesce("has_figure", F.lit(False)) & (F.length(F.coalesce("caption", F.lit(""))) == 0) & (F.length(F.coalesce("text", F.lit(""))) < least)).agg(F.count(F.lit(1)).alias("short"))


def invariants(chunks: DataFrame) -> DataFrame:
    """P23. (book, chapter, text, printed_page): one row a check over all chunks, with its value, target and verdict, which
    looks at the value before it is rounded; without chunks only the number of books. `folio` and `short` are shares of the
    whole corpus. The checks by book or of some books are label_agreement, weak_folios and short_chunks."""
    a = chunks.agg(
        F.avg(bibliography_like("text").cast("double")).alias("bibliography"),
        F.avg((is_junk(F.col("chapter")) & (T.trimmed(F.coalesce("chapter", F.lit(""))) != "")).cast("double")).alias("junk"),
        F.avg(F.col("printed_page").isNotNull().cast("double")).alias("folio"),
        F.avg((F.size(T.words("text")) < 20).cast("double")).alias("short"),
        F.countDistinct("book").cast("double").alias("books"),
    )
    long = a.unpivot([], ["bibliography", "junk", "folio", "short", "books"], "check", "value").where("value is not null")
    target = F.when(F.col("check").isin("bibliography", "junk"), F.lit(0.05)).when(F.col("check") == "folio", F.lit(0.9)).when(F.col("check") == "short", F.lit(0.0)).otherwise(F.lit(1.0))
    ok = F.when(F.col("check").isin("folio", "books"), F.col("value") >= F.col("target")).when(F.col("check") == "short", F.col("value") <= F.col("target")).otherwise(F.col("value") < F.col("target"))
    return long.withColumn("target", target).withColumn("ok", ok).select("check", F.round("value", 4).alias("value"), "target", "ok")


def contaminated_books(chunks: DataFrame, strong: list[str], legit: str, markers: list[str], least: int = 15) -> DataFrame:
    """P24. Books with at least so many chunks of a strong foreign signature: where the foreign part begins (after the last
    legitimate page below the first strong one), and if it is pure: no legitimate chapter inside, and a marker."""
    has = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(F.coalesce("text", F.lit(""))), t))
    c = chunks.withColumn("strong", has(strong)).withColumn("marked", has(markers)).withColumn("legit", F.coalesce("chapter", F.lit("")).rlike(legit))
    first = c.groupBy("book").agg(F.count_if("strong").alias("n_strong"), F.min(F.when(F.col("strong"), F.col("page"))).alias("first_strong")).where(F.col("n_strong") >= least)
    below = c.join(first, "book").groupBy("book", "n_strong", "first_strong").agg((F.coalesce(F.max(F.when(F.col("legit") & (F.col("page") < F.col("first_strong")), F.col("page"))), F.lit(0)) + 1).alias("boundary"))
    inside = c.join(below.select("book", "boundary"), "book").where("page >= boundary").groupBy("book").agg(F.count(F.lit(1)).alias("deletable"), (~F.max("legit") & F.max("marked")).alias("pure"))
    return below.join(inside, "book", "left").select("book", "n_strong", "first_strong", "boundary", F.coalesce("deletable", F.lit(0)).alias("deletable"), F.coalesce("pure", F.lit(False)).alias("pure"))


def marker_hits(chunks: DataFrame, audit: DataFrame, markers: list[str]) -> DataFrame:
    """P25. Pages with a marker outside the contaminated parts, to look at: each (book, page) once."""
    marked = chunks.where(F.exists(F.array(*[F.lit(t) for t in markers]), lambda t: F.contains(F.lower(F.coalesce("text", F.lit(""))), t)))
    parts = audit.select(F.col("book").alias("b"), "boundary")
    return marked.join(parts, (F.col("book") == F.col("b")) & (F.col("page") >= F.col("boundary")), "left_anti").select("book", "page").distinct()


def audit_verdict(audit: DataFrame, hits: DataFrame) -> DataFrame:
    """P25. One row: books and rows that can be deleted, impure books, markers elsewhere (which decide nothing), and the verdict."""
    of = audit.agg(F.coalesce(F.sum(F.when(F.col("pure"), F.col("deletable"))), F.lit(0)).alias("deletable"), F.count_if(F.col("pure") & (F.col("deletable") > 0)).alias("books"), F.count_if(~F.col("pure")).alias("impure"))
    return of.crossJoin(hits.agg(F.count(F.lit(1)).alias("marker_hits"))).withColumn("verdict", F.when((F.col("deletable") > 0) | (F.col("impure") > 0), "dirty").otherwise("clean"))


def purged(chunks: DataFrame, audit: DataFrame) -> DataFrame:
    """S22. Chunks outside the pure contaminated parts."""
    cut = audit.where("pure").select(F.col("book").alias("b"), "boundary")
    return chunks.join(cut, (F.col("book") == F.col("b")) & (F.col("page") >= F.col("boundary")), "left_anti")
