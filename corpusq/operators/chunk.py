"""Chunking: windows of words over pages, atoms, and a packer of atoms."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import written

LEAST_WORDS = 20


def chunk_pages(pages: DataFrame, most: int = 600, overlap: int = 80, text: str = "text", caption: str | None = None) -> DataFrame:
    """C1. Windows of at most `most` words, each `most - overlap` words after the one before, until one reaches the page's
    end. A page of under 20 words is dropped unless it has a figure or a caption, and a caption ends every chunk."""
    step = max(1, most - overlap)
    w = T.words(text)
    cap = T.trimmed(F.coalesce(F.col(caption), F.lit(""))) if caption else F.lit("")
    n = F.size("_w")
    count = F.when(n <= most, 1).otherwise(F.ceil((n - most) / step).cast("int") + 1)
    kept = pages.withColumn("_w", w).withColumn("_c", cap).where((n >= LEAST_WORDS) | ((n > 0) & (F.coalesce("has_figure", F.lit(False)) | (F.col("_c") != ""))))
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice("_w", i * step + 1, most), " "))
    out = kept.select(*[c for c in pages.columns if c != text], F.posexplode(windows).alias("i", "chunk"), "_c")
    suffix = F.when(F.col("_c") != "", F.concat(F.lit("\n\n"), F.col("_c"))).otherwise("")
    return out.withColumn("text", F.concat("chunk", suffix)).withColumn("id", F.concat_ws("::", "book", F.concat(F.lit("p"), F.col("page").cast("string")), F.col("i").cast("string"))).drop("chunk", "_c")


def page_atoms(pages: DataFrame) -> DataFrame:
    """C2. A page is an atom. All atoms have book, page, chapter, ord (their place in the book), atom, is_head."""
    return _atoms(pages, F.array(F.struct(F.lit(False).alias("h"), F.col("text").alias("t"))))


def paragraph_atoms(pages: DataFrame) -> DataFrame:
    """C2. Blank lines part paragraphs."""
    return _atoms(pages, F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda t: F.struct(F.lit(False).alias("h"), T.collapsed(t).alias("t"))))


def sentence_atoms(pages: DataFrame) -> DataFrame:
    """C2. Sentences of the page with its lines joined."""
    return _atoms(pages, F.transform(T.sentences(T.collapsed("text")), lambda t: F.struct(F.lit(False).alias("h"), t.alias("t"))))


def _atoms(pages: DataFrame, parts) -> DataFrame:
    return pages.select("book", "page", "chapter", F.posexplode(parts).alias("i", "a")).select("book", "page", "chapter", F.struct("page", "i").alias("ord"), F.col("a.t").alias("atom"), F.col("a.h").alias("is_head")).where(T.trimmed("atom") != "")


def is_heading(line):
    """C3. At most 8 words, no full stop at the end, and numbered or all in capitals."""
    s = T.trimmed(line)
    capitals = s.rlike(r"\p{L}") & ~s.rlike(r"\p{Ll}") & (F.upper(s) == s)
    return (s != "") & (F.size(T.words(s)) <= 8) & ~s.endswith(".") & (s.rlike(r"^\s*([0-9]+(\.[0-9]+)*)\s+[A-Z]") | capitals)


def heading_atoms(pages: DataFrame) -> DataFrame:
    """C3. Sections of a page, each from a heading line to the next. Each is a head."""
    # the lines folded into sections: a heading opens one unless it is the first line
    start = F.array().cast("array<string>")
    sections = F.aggregate(
        T.lines("text"),
        start,
        lambda acc, x: F.when((F.size(acc) == 0) | is_heading(x), F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit("\n"), x)))),
    )
    return _atoms(pages, F.transform(sections, lambda t: F.struct(F.lit(True).alias("h"), T.collapsed(t).alias("t"))))


def chapter_atoms(pages: DataFrame) -> DataFrame:
    """C4. Runs of pages with the same chapter, joined: gaps and islands over each book."""
    runs = _chapter_runs(pages)
    parts = F.array_sort(F.collect_list(F.when(T.trimmed("text") != "", F.struct("page", "text"))))
    return runs.groupBy("book", "run").agg(F.min("page").alias("page"), F.first("chapter").alias("chapter"), parts.alias("p")).select("book", "page", "chapter", F.struct("page", F.lit(0).alias("i")).alias("ord"), T.collapsed(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("atom"), F.lit(False).alias("is_head")).where("atom <> ''")


def _chapter_runs(pages: DataFrame) -> DataFrame:
    """Pages with the number of their run of one chapter."""
    book = W.partitionBy("book").orderBy("page")
    changed = ~F.col("chapter").eqNullSafe(F.lag("chapter").over(book)) | (F.row_number().over(book) == 1)
    return pages.withColumn("run", F.sum(changed.cast("int")).over(book))


def _chapter_counts(pages: DataFrame) -> DataFrame:
    """The numbers of words of chapter_atoms, added up over pages, so that no text is moved."""
    runs = _chapter_runs(pages.select("book", "page", "chapter", F.size(T.words("text")).alias("n")))
    whole = runs.groupBy("book", "run").agg(F.min("page").alias("page"), F.first("chapter").alias("chapter"), F.sum("n").alias("n"))
    return whole.where("n > 0").select("book", "page", "chapter", F.struct("page", F.lit(0).alias("i")).alias("ord"), F.lit(False).alias("is_head"), "n", F.col("run").cast("long").alias("same"))


#: Words in a place bucket: rows that may lie at the same place of a book meet by book and bucket.
PLACES = 128


def _by_place(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows once for each bucket of places that [first, last) lies in."""
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(first / PLACES), F.floor((last - 1) / PLACES))))


def _counted(atoms: DataFrame, text: str = "atom") -> DataFrame:
    """With words, n, and same, which tells atoms at one place apart; rows without words go."""
    return atoms.withColumn("words", T.words(text)).withColumns({"n": F.size("words"), "same": F.xxhash64("words")}).where("n > 0")


def _placed(atoms: DataFrame, carried: list[str]) -> DataFrame:
    """Atoms of n words with their words' places in the book, [lo, hi), and the place where their section begins. Words are counted
    by page, then pages by book, so that no task holds the atoms of a book. Of other columns, those that are carried stay."""
    page = [*_BOOK, "page_key"]
    keyed = atoms.select(
        "arm", "section", "book", "page", "chapter", *[c for c in carried if c not in ("book", "page", "chapter")],
        F.concat(F.when(F.col("book").isNull(), "").otherwise("="), F.coalesce("book", F.lit(""))).alias("book_key"),
        F.coalesce(F.col("page").cast("long"), F.lit(-(1 << 40))).alias("page_key"),
        F.col("n").cast("long").alias("n"), F.col("ord.i").alias("i"), "same", "is_head",
    )
    upto = W.partitionBy(*page).orderBy("i", "same").rowsBetween(W.unboundedPreceding, 0)
    inner = keyed.withColumn("to", F.sum("n").over(upto)).withColumn("head", F.max(F.when((F.col("section") == "heading") & F.col("is_head"), F.col("to") - F.col("n"))).over(upto))
    pages = inner.groupBy(*page).agg(F.sum("n").alias("page_n"), F.max("head").alias("last_head"), F.first("section").alias("section"), F.min_by("chapter", "i").alias("chapter"))
    book = W.partitionBy(*_BOOK).orderBy("page_key")
    base = F.sum("page_n").over(book.rowsBetween(W.unboundedPreceding, 0)) - F.col("page_n")
    cut = (F.col("section") == "page") | ((F.col("section") == "chapter") & ~F.col("chapter").eqNullSafe(F.lag("chapter").over(book)))
    pages = pages.withColumn("base", base).withColumn("cut", F.when(F.coalesce(cut, F.lit(False)), F.col("base")))
    begun = F.max(F.coalesce(F.col("base") + F.col("last_head"), "cut")).over(book.rowsBetween(W.unboundedPreceding, -1))
    pages = pages.select(*page, "base", F.coalesce("cut", begun, F.lit(0).cast("long")).alias("begun"))
    hi = F.col("base") + F.col("to")
    return inner.join(pages, page).select(*_BOOK, *carried, "n", (hi - F.col("n")).alias("lo"), hi.alias("hi"), F.coalesce(F.col("base") + F.col("head"), "begun").alias("sec"))


_BOOK = ["arm", "book_key"]
_SECTION = [*_BOOK, "sec"]


def _chained(narrow: DataFrame) -> DataFrame:
    """(arm, book_key, sec, most, overlap, lo, first, open): the atoms of narrow at which chunks begin. `first` is where the first
    of the windows that begin there does, `open` where the last does, which goes on over later atoms. Which atom overflows a chunk
    follows from the place where the chunk begins, and that from the atom before that overflowed; so each atom's successor is
    looked up by place, and the successors reached from a section's first chunk are marked by pointer jumping."""
    step = F.greatest(F.lit(1), F.col("most") - F.col("overlap"))
    windows = lambda n: F.when(n <= F.col("most"), 0).otherwise(F.ceil((n - F.col("most")) / step))
    at_place = _by_place(narrow.select(*_SECTION, F.col("lo").alias("next"), F.col("hi").alias("next_hi")), F.col("next"), F.col("next_hi"))

    def overflowed(rows: DataFrame) -> DataFrame:
        """With next, next_hi: the section's atom that holds the word `most` places after `open`; rows that have none go."""
        x = F.col("open") + F.col("most")
        return rows.withColumn("x", x).withColumn("bucket", F.floor(x / PLACES)).join(at_place, [*_SECTION, "bucket"]).where("next <= x and x < next_hi").drop("x", "bucket")

    key = [*_SECTION, "most", "overlap"]
    # atoms that alone are too long, before the section's first that is not
    heads = narrow.where("n <= most").groupBy(*key).agg(F.min("lo").alias("lo"))
    long = narrow.where("n > most").join(heads.select(*_SECTION, F.col("lo").alias("head")), _SECTION, "left").where("head is null or lo < head")
    alone = long.select(*key, "lo", F.col("lo").alias("first"), (F.col("lo") + windows(F.col("n")) * step).alias("open"), F.col("hi").alias("end"))
    # the first chunk with room, and the first atom that overflows it: less than the overlap may lie before that
    fresh = heads.withColumn("first", F.col("lo")).withColumn("open", F.col("lo"))
    second = overflowed(fresh).withColumn("first", F.greatest("open", F.col("next") - F.col("overlap")))
    second = written(second.withColumn("open", F.col("first") + windows(F.col("next_hi") - F.col("first")) * step).select(*key, F.col("next").alias("lo"), "first", "open"))
    # all later ones, whose whole overlap is always there
    full = narrow.join(second.select(*_SECTION, F.col("lo").alias("after")), _SECTION).where("lo > after")
    nodes = full.withColumn("open", F.col("lo") - F.col("overlap") + windows(F.col("overlap") + F.col("n")) * step).select(*key, "lo", "open")
    third = overflowed(second).select(*_SECTION, F.col("next").alias("lo")).withColumn("hit", F.lit(True))
    jumps = overflowed(nodes).select(*_SECTION, "lo", "next")
    state = written(nodes.join(jumps, [*_SECTION, "lo"], "left").join(third, [*_SECTION, "lo"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))))
    while not state.where("hit and next is not null").isEmpty():
        # after k rounds the first 2^k of a chain are marked, and next is 2^k further on
        hop = state.where("next is not null").select(*_SECTION, F.col("lo").alias("next"), F.col("next").alias("beyond"))
        marks = state.where("hit and next is not null").select(*_SECTION, F.col("next").alias("lo")).withColumn("now", F.lit(True))
        state = written(state.join(hop, [*_SECTION, "next"], "left").join(marks, [*_SECTION, "lo"], "left").select(*key, "lo", "open", F.col("beyond").alias("next"), (F.col("hit") | F.coalesce("now", F.lit(False))).alias("hit")))
    later = state.where("hit").select(*key, "lo", F.lit(None).cast("long").alias("first"), "open")
    ends = narrow.groupBy(*_SECTION).agg(F.max("hi").alias("sec_hi"))
    order = W.partitionBy(*_SECTION).orderBy("lo")
    chain = fresh.select(*key, "lo", "first", "open").unionByName(second).unionByName(later)
    # an overlap that is no less than a chunk is the whole chunk before
    chain = chain.withColumn("first", F.coalesce("first", F.greatest(F.lag("open").over(order), F.col("lo") - F.col("overlap")))).withColumn("then", F.lead("lo").over(order))
    return chain.join(ends, _SECTION).select(*key, "lo", "first", "open", F.coalesce("then", "sec_hi").alias("end")).unionByName(alone)


def pack_arms(atoms: DataFrame) -> DataFrame:
    """C5. Atoms of a book, in order, merged into chunks of at most `most` words; the last `overlap` words of a full chunk
    open the next. Columns beside the atoms': arm, most, overlap, and section, "page", "chapter" or "heading", which closes a
    chunk where that changes, or null. (arm, book, i, page, chapter, text): page and chapter are those of the atom at which the
    chunk began. Atoms without words are left out. No book is a group of one task: places, successors and chunks are joins on
    narrow rows; of texts, a task holds a page while its words are counted, and an atom or a chunk thereafter."""
    placed = written(_placed(_counted(atoms), ["most", "overlap", "book", "page", "chapter", "words"]), "placed")
    narrow = placed.select(*_SECTION, "most", "overlap", "n", "lo", "hi")
    step = F.greatest(F.lit(1), F.col("most") - F.col("overlap"))
    k = F.sequence(F.lit(0).cast("long"), ((F.col("open") - F.col("first")) / step).cast("long"))
    spans = F.transform(k, lambda x: F.struct((F.col("first") + x * step).alias("a"), F.when(F.col("first") + x * step < F.col("open"), F.col("first") + x * step + F.col("most")).otherwise(F.col("end")).alias("z")))
    chunks = _chained(narrow).select(*_BOOK, F.col("lo").alias("at"), F.posexplode(spans).alias("k", "s")).select(*_BOOK, "at", F.col("s.a").alias("a"), F.col("s.z").alias("z"), F.row_number().over(W.partitionBy(*_BOOK).orderBy("at", "k")).alias("i"))
    chunks = written(chunks, "chunks")
    # an atom and a chunk that share words meet in the first bucket that both lie in
    pieces = _by_place(chunks, F.col("a"), F.col("z")).join(_by_place(narrow.select(*_BOOK, "lo", "hi"), F.col("lo"), F.col("hi")), [*_BOOK, "bucket"])
    pieces = pieces.where("a < hi and lo < z").where(F.col("bucket") == F.floor(F.greatest("a", "lo") / PLACES))
    of_atom = pieces.groupBy(*_BOOK, "lo").agg(F.collect_list(F.struct("i", "a", "z", "at")).alias("pieces"))
    cut = placed.join(of_atom, [*_BOOK, "lo"])
    first = lambda p: F.greatest(p["a"] - F.col("lo"), F.lit(0).cast("long")).cast("int")
    last = lambda p: F.least(p["z"] - F.col("lo"), F.col("n")).cast("int")
    piece = F.transform("pieces", lambda p: F.struct(p["i"].alias("i"), F.col("lo").alias("lo"), F.array_join(F.slice(F.col("words"), first(p) + 1, last(p) - first(p)), " ").alias("t")))
    parts = cut.select(*_BOOK, F.explode(piece).alias("p")).groupBy(*_BOOK, "p.i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p.lo", "p.t"))), lambda x: x["t"]), " ").alias("text"))
    began = chunks.select(*_BOOK, "i", F.col("at").alias("lo")).join(placed.select(*_BOOK, "lo", "book", "page", "chapter"), [*_BOOK, "lo"])
    return began.join(parts, [*_BOOK, "i"]).select("arm", "book", (F.col("i") - 1).cast("int").alias("i"), F.col("page").cast("int").alias("page"), "chapter", "text")


def _arm(atoms: DataFrame, arm: str, most: int, overlap: int, group: str | None) -> DataFrame:
    if most < 1 or overlap < 0:
        raise ValueError("a chunk has at least one word, an overlap none or more")
    return atoms.select("*", F.lit(arm).alias("arm"), F.lit(most).cast("long").alias("most"), F.lit(overlap).cast("long").alias("overlap"), F.lit(group).cast("string").alias("section"))


def pack(atoms: DataFrame, most: int, overlap: int, group: str | None = None) -> DataFrame:
    """C5. pack_arms with one size, overlap and kind of section."""
    return pack_arms(_arm(atoms, "", most, overlap, group)).drop("arm")


STRATEGIES = {"page": (page_atoms, "page"), "paragraph": (paragraph_atoms, None), "sentence": (sentence_atoms, None), "heading": (heading_atoms, "heading"), "chapter": (chapter_atoms, "chapter")}


def chunk(pages: DataFrame, strategy: str, most: int, overlap: int) -> DataFrame:
    """C6. Chunks by a strategy's name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    atoms, group = STRATEGIES[strategy]
    return pack(atoms(pages), most, overlap, group)


def shape(chunks: DataFrame, by: list[str] = (), source: DataFrame | None = None) -> DataFrame:
    """C7. Number and sizes of chunks; with the arm's chunks without overlap as source, the share of repeated words."""
    counted = lambda rows: rows.groupBy(*by, F.size(T.words("text")).alias("w")).agg(F.count(F.lit(1)).alias("c"))
    return _shape_of(counted(chunks), by, None if source is None else counted(source))


def _shape_of(counts: DataFrame, by: list[str] = (), source: DataFrame | None = None) -> DataFrame:
    """shape() from (by, w, c): how many chunks have so many words."""
    n = F.sum("c")
    out = counts.groupBy(*by).agg(
        n.alias("n_chunks"),
        F.round(F.sum(F.col("w") * F.col("c")) / n, 1).alias("mean_words"),
        F.floor(F.percentile("w", F.lit(0.5), F.col("c"))).cast("int").alias("median_words"),
        F.max("w").alias("max_words"),
        F.round(100 * (F.sum(F.when(F.col("w") < 50, F.col("c")).otherwise(0)) / n), 1).alias("frag_pct_lt50w"),
        F.sum(F.col("w") * F.col("c")).alias("total_words"),
    )
    # p90 is the value at place int(0.9 n), from 0, of the sorted sizes: the first whose running count passes that
    w = W.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("c").over(w.orderBy("w"))).withColumn("n", F.sum("c").over(w))
    p90 = placed.where("upto > floor(0.9 * n)").groupBy(*by).agg(F.min("w").alias("p90_words"))
    out = out.join(p90, list(by)) if by else out.crossJoin(p90)
    if source is not None:
        base = source.groupBy(*by).agg(F.sum(F.col("w") * F.col("c")).alias("source_words"))
        out = (out.join(base, list(by)) if by else out.crossJoin(base)).withColumn("dup_pct", F.round(100 * (F.col("total_words") - F.col("source_words")) / F.nullif("total_words", F.lit(0)), 1))
    return out


def arms(sizes: list[int] = (600, 300), overlaps: list[int] = (80, 0)) -> list[tuple[str, int, int]]:
    """C8. Strategies at the first size and overlap, then sizes and overlaps of the first strategy, each arm once."""
    grid = [(s, sizes[0], overlaps[0]) for s in STRATEGIES] + [("page", m, overlaps[0]) for m in sizes] + [("page", sizes[0], o) for o in overlaps]
    return list(dict.fromkeys(grid))


#: Words of a block, about: a stretch of a book whose chunks are counted in one task.
BLOCK = 1 << 17


def _run(hi: list[int], lo: int, begins: list[int], most: int, overlap: int, held: int, sizes: dict[int, int] | None = None, ends: dict | None = None) -> int:
    """Pack a block's atoms (hi: where each ends; the first begins at lo), when so many words are held from before. begins: the
    atoms, by number, that open a section. How many words are held in the end. sizes counts the chunks that are closed; ends
    remembers what the states (atom, words held) came to."""
    step, seen = max(1, most - overlap), []

    def closed(w: int, c: int = 1) -> None:
        if sizes is not None and w > 0 and c > 0:
            sizes[w] = sizes.get(w, 0) + c

    for s, e in zip([0, *begins], [*begins, len(hi)]):
        if begins and s == begins[0] or s > 0:
            closed(held)
            held = 0
        i = s
        while i < e:
            if ends is not None:
                if (i, held) in ends:
                    held = ends[i, held]
                    break
                seen.append((i, held))
            at = hi[i - 1] if i else lo
            if not held and hi[i] - at > most:
                # an atom that alone is too long, with nothing before it
                n = hi[i] - at
                k = -((most - n) // step)
                closed(most, k)
                closed(n - k * step)
                i += 1
                continue
            first = at - held
            j = bisect_right(hi, first + most, i, e)
            if j == e:
                held = hi[e - 1] - first
                break
            at = hi[j - 1] if j else lo
            closed(at - first)
            a = max(first, at - overlap)
            n = hi[j] - a
            k = -((most - n) // step) if n > most else 0
            closed(most, k)
            held = n - k * step
            i = j + 1
    if ends is not None:
        ends.update(dict.fromkeys(seen, held))
    return held


def _block(frame):
    """hi, lo, begins of a block's atoms."""
    frame = frame.sort_values("lo", kind="stable")
    return frame["hi"].tolist(), int(frame["lo"].iloc[0]), (frame["sec"] == frame["lo"]).to_numpy().nonzero()[0].tolist()


def _sizes(placed: DataFrame, grid: list[tuple[str, int, int]]) -> DataFrame:
    """(arm, w, c): how many chunks of an arm have so many words. placed has strategies as arms; grid is the arms' strategies, sizes
    and overlaps. What is held where a block begins is 0 to `most` words: a first pass over the blocks finds what each would hold in
    the end for each of these; block by block of a book, that gives what each does hold; a second pass counts."""
    import pandas as pd

    of = {s: [(f"{s}/{m}/{o}", m, o) for t, m, o in grid if t == s] for s, _, _ in grid}
    key = [*_BOOK, "block"]
    blocks = placed.select(*key, "sec", "lo", "hi")

    def tried(frame: pd.DataFrame) -> pd.DataFrame:
        strategy, book, block = frame.iloc[0][key]
        hi, lo, begins = _block(frame)
        out = []
        for arm, most, overlap in of[strategy]:
            if begins:
                # what is held in the end follows from the last section's begin
                s = begins[-1]
                ends = [_run(hi[s:], hi[s - 1] if s else lo, [0], most, overlap, 0)]
            else:
                memory = {}
                ends = [_run(hi, lo, begins, most, overlap, h, ends=memory) for h in range(most + 1)]
            out.append((strategy, book, block, arm, ends))
        return pd.DataFrame(out, columns=[*key, "label", "ends"])

    def followed(frame: pd.DataFrame) -> pd.DataFrame:
        held, out = 0, []
        frame = frame.sort_values("block")
        for block, ends in zip(frame["block"], frame["ends"]):
            out.append((block, held))
            held = int(ends[min(held, len(ends) - 1)])
        first = frame.iloc[0]
        return pd.DataFrame([(first["arm"], first["book_key"], b, first["label"], h, b == out[-1][0]) for b, h in out], columns=[*key, "label", "held", "last"])

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        hi, lo, begins = _block(frame)
        entry, out = {e["label"]: e for e in frame["entries"].iloc[0]}, []
        for arm, most, overlap in of[frame["arm"].iloc[0]]:
            sizes: dict[int, int] = {}
            held = _run(hi, lo, begins, most, overlap, int(entry[arm]["held"]), sizes)
            if entry[arm]["last"] and held:
                sizes[held] = sizes.get(held, 0) + 1
            out += [(arm, w, c) for w, c in sizes.items()]
        return pd.DataFrame(out, columns=["arm", "w", "c"])

    keys = "arm string, book_key string, block long, label string"
    ends = blocks.groupBy(*key).applyInPandas(tried, f"{keys}, ends array<int>")
    held = ends.groupBy(*_BOOK, "label").applyInPandas(followed, f"{keys}, held int, last boolean")
    entries = held.groupBy(*key).agg(F.collect_list(F.struct("label", "held", "last")).alias("entries"))
    # a block's entries come with its first atom only
    entries = written(entries.join(blocks.groupBy(*key).agg(F.min("lo").alias("lo")), key), "entries")
    return blocks.join(entries, [*key, "lo"], "left").groupBy(*key).applyInPandas(lambda f: counted(f.sort_values("lo")), "arm string, w int, c long").groupBy("arm", "w").agg(F.sum("c").alias("c"))


def run_arms(pages: DataFrame, grid) -> DataFrame:
    """C8. The shape of every arm. Of texts only the words are counted, once for a strategy; arms of other sizes, and the same arms
    without overlap, go by the same places."""
    grid = list(dict.fromkeys(grid))
    base = {f"{s}/{m}/{o}": f"{s}/{m}/0" for s, m, o in grid}
    counts = lambda s: _chapter_counts(pages) if s == "chapter" else _counted(STRATEGIES[s][0](pages)).drop("atom", "words")
    each = [counts(s).withColumns({"arm": F.lit(s), "section": F.lit(STRATEGIES[s][1]).cast("string")}) for s in dict.fromkeys(s for s, _, _ in grid)]
    placed = written(_placed(reduce(DataFrame.unionByName, each), []).withColumn("block", F.floor(F.col("lo") / BLOCK)), "placed")
    sizes = written(_sizes(placed, list(dict.fromkeys([*grid, *((s, m, 0) for s, m, _ in grid)]))), "sizes")
    own = sizes.where(F.col("arm").isin(list(base)))
    of_base = sizes.sparkSession.createDataFrame(list(base.items()), "label string, arm string")
    return _shape_of(own, ["arm"], sizes.join(F.broadcast(of_base), "arm").drop("arm").withColumnRenamed("label", "arm"))


def boundaries(chunks: DataFrame, by: list[str] = ()) -> DataFrame:
    """C9. Per cent of chunks that begin like a sentence, and that end one."""
    t = T.trimmed("text")
    return chunks.groupBy(*by).agg(F.round(100 * F.avg(t.rlike(r"^[A-Z0-9(]").cast("double")), 1).alias("clean_start_pct"), F.round(100 * F.avg(t.rlike(r"[.!?]$").cast("double")), 1).alias("clean_end_pct"))
