"""Benchmark decontamination by Wu-Manber search for word windows.

A test string is a window of `window` consecutive words of a benchmark item; an item of fewer words, but not none, is
one. Strings of one length form a set of patterns. A set's shift table tells, for each block of two words that occurs
in some pattern, how far the search may advance; any other block lets it skip nearly a whole pattern. Where the shift is
0, the hash of the block selects a bucket of patterns that end in it; all words are compared by hash, and then the bytes of
the stretch with those of the pattern, which confirms an occurrence. Many stretches of text are searched in step, so that each step is a few array operations.

Every pass is a map over rows; texts are never shuffled, but for one join by row number where a large benchmark took several. Patterns are sent to all tasks in parts of at most
PART_BYTES of benchmark text, or one item; the benchmark's size is measured first. A larger benchmark takes more passes over
numbered rows, so only one part is held at a time. A pass writes row numbers, spans and items, the first one of all rows (with their
numbers of words), each later one of rows that are hit; no pass writes texts. In the end these are put together by row number.

Defined cases: null or empty text has no words, no hits, and is not contaminated; items without words give no pattern;
rows of one item id make one item, a null id is the empty string; rows with equal ids and texts, and with a null id, are
judged each by itself and all returned; a very long text is searched whole, by itself, in memory of a few times its size; an
empty benchmark finds nothing; columns other than those named are ignored (clean() returns them as they are).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, ALNUM, BATCH_BYTES, randoms, slices, stage, strings, words

WINDOW = 13
#: Benchmark text that is sent to all tasks at once.
PART_BYTES = 16 << 20
#: Word positions that one cursor goes through.
STRETCH = 512
_MULTIPLIERS = randoms(1 << 12, 5)


class Patterns:
    """Word patterns of one length: shift table, suffix buckets, and the items of each pattern."""

    def __init__(self, length: int, found: dict[bytes, tuple[bytes, set[int]]]):
        """found: a pattern's text (words with a space between) to the hashes of its words and its items."""
        self.length, self.block = length, min(2, length)
        self.texts = keys = sorted(found)
        self.words = np.frombuffer(b"".join(found[k][0] for k in keys), np.uint64).reshape(len(keys), length)
        self.items = [sorted(found[k][1]) for k in keys]
        blocks = self.blocks(self.words.ravel())  # those that straddle two patterns are never looked at
        self.most = length - self.block + 1
        at = np.arange(self.most)
        every = blocks[(np.arange(len(keys))[:, None] * length + at).ravel()]
        distance = np.tile(length - self.block - at, len(keys))
        order = np.lexsort((distance, every))
        first = np.unique(every[order], return_index=True)
        self.shift_keys, self.shifts = first[0], distance[order][first[1]]
        suffix = blocks[np.arange(len(keys)) * length + length - self.block]
        self.bucket_order = np.argsort(suffix, kind="stable")
        self.bucket_keys, starts = np.unique(suffix[self.bucket_order], return_index=True)
        self.bucket_starts = np.append(starts, len(keys))

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        """The block that starts at each word, but for the last words."""
        if self.block == 1:
            return hashes
        return hashes[:-1] * _MULTIPLIERS[0] + hashes[1:] * _MULTIPLIERS[1]

    def search(self, hashes: np.ndarray, rows: np.ndarray, text) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all occurrences; rows: first words of the rows, n + 1 offsets; text(a, z): the words from a
        to z with a space between."""
        none = np.zeros(0, np.int64)
        if len(hashes) < self.length or not len(self.words):
            return none, none
        blocks = self.blocks(hashes)
        # cursors stand on the place where a window's last block starts
        lead = self.length - self.block
        counts = np.maximum(rows[1:] - rows[:-1] - self.length + 1, 0)
        pieces = -(-counts // STRETCH)
        row = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = rows[row] + nth * STRETCH + lead
        end = np.minimum(at + STRETCH, rows[row] + counts[row] + lead)
        found, which = [], []
        while len(at):
            block = blocks[at]
            k = np.minimum(np.searchsorted(self.shift_keys, block), len(self.shift_keys) - 1)
            shift = np.where(self.shift_keys[k] == block, self.shifts[k], self.most)
            if len(zero := np.flatnonzero(shift == 0)):
                b = np.searchsorted(self.bucket_keys, block[zero])
                n = self.bucket_starts[b + 1] - self.bucket_starts[b]
                start = np.repeat(at[zero] - lead, n)
                pattern = self.bucket_order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bucket_starts[b], n)]
                same = np.ones(len(start), bool)
                for i in range(self.length):
                    same &= hashes[start + i] == self.words[pattern, i]
                start, pattern = start[same], pattern[same]
                equal = np.array([text(a, a + self.length) == self.texts[p] for a, p in zip(start.tolist(), pattern.tolist(), strict=True)], bool)
                found.append(start[equal])
                which.append(pattern[equal])
            at = at + np.maximum(shift, 1)
            going = at < end
            at, end = at[going], end[going]
        return (np.concatenate(found), np.concatenate(which)) if found else (none, none)


def _joined(data: np.ndarray, first: np.ndarray, last: np.ndarray):
    """The words from one to another, lowered, with a space between."""
    raw, first, last = _LOWER[data].tobytes(), first.tolist(), last.tolist()
    return lambda a, z: b" ".join([raw[first[k] : last[k]] for k in range(a, z)])


def patterns(items: list[tuple[str, str]], window: int) -> tuple[list[Patterns], list[str]]:
    """Pattern sets by length, and the item ids."""
    ids = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(ids)}
    by_length: dict[int, dict[bytes, tuple[bytes, set[int]]]] = {}
    data, offsets = strings(pa.array([t for _, t in items], pa.string()))
    hashes, first, last, rows = words(data, offsets, ALNUM)
    text = _joined(data, first, last)
    for (item, _), a, z in zip(items, rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        n = min(window, z - a)
        for i in range(a, z - n + 1 if n else a):
            by_length.setdefault(n, {}).setdefault(text(i, i + n), (hashes[i : i + n].tobytes(), set()))[1].add(number[item])
    return [Patterns(n, found) for n, found in sorted(by_length.items())], ids


def item_parts(benchmark: DataFrame, most: int):
    """(item id, text) in lists of at most so many bytes, or one item; sizes are measured before any text is collected."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").where("text is not null")
    size = F.octet_length("text") + F.octet_length("i")
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= most:
        if found := [tuple(r) for r in rows.collect()]:
            yield found
        return
    buckets = 64 * -(-total // most)
    rows = stage(rows.withColumn("bucket", F.pmod(F.xxhash64("i", "text"), F.lit(buckets))), "benchmark")
    ends, left = [], 0
    for bucket, n in sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.sum(size)).collect()):  # 64 numbers a part
        if not ends or n > left:
            ends.append([bucket, bucket])
            left = most
        ends[-1][1], left = bucket, left - n
    for a, z in ends:
        yield [(r["i"], r["text"]) for r in rows.where(F.col("bucket").between(a, z)).collect()]


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _searcher(spark, items, window: int, column: str, name: str, kept: list[str] | None = None, hits_only: bool = False):
    """Rows with a column of that name; with kept, those columns and the fields of FOUND instead, with hits_only of rows that are hit."""
    held = spark.sparkContext.broadcast(patterns(items, window))

    def search(frames):
        sets, ids = held.value
        for batch in frames:
            data, offsets = strings(batch.column(column))
            found = []
            for i, j in slices(offsets, BATCH_BYTES):
                own_bytes = data[offsets[i] : offsets[j]]
                hashes, first, last, rows = words(own_bytes, offsets[i : j + 1] - offsets[i], ALNUM)
                text = _joined(own_bytes, first, last)
                hit: dict[int, list] = {}
                for s in sets:
                    start, which = s.search(hashes, rows, text)
                    for row, a, p in zip(np.searchsorted(rows, start, "right") - 1, start, which, strict=True):
                        hit.setdefault(int(row), []).append((int(a - rows[row]), int(a - rows[row]) + s.length, s.items[p]))
                for r, n in enumerate(np.diff(rows).tolist()):
                    own = hit.get(r, [])
                    found.append({"n_words": n, "spans": _merged([x[:2] for x in own]), "items": sorted({ids[k] for x in own for k in x[2]})})
            if kept is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], [*batch.schema.names, name])
                continue
            at = [k for k, x in enumerate(found) if x["spans"] or not hits_only]
            which = pa.array(at, pa.int64())
            fields = pa.array([found[k] for k in at], _ARROW).flatten()
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(which) for c in kept], *fields], [*kept, *[f.name for f in _ARROW]])

    return search


def _united(frames):
    """(_row, n_words, spans of each pass, items of each pass) as (_row, _found)."""
    for batch in frames:
        n, spans, items = (batch.column(c).to_pylist() for c in ("n_words", "spans", "items"))
        found = [{"n_words": k, "spans": _merged([x for of in s for x in of]), "items": sorted({x for of in i for x in of})} for k, s, i in zip(n, spans, items, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, _ARROW)], ["_row", "_found"])


def _merged(spans):
    out = []
    for a, z in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return out


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores as tell it from the table's own columns."""
    while name in docs.columns:
        name += "_"
    return name


def search(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, column: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with a column of that name: n_words, the spans of hit words (first, after the last), the ids of items found."""
    spark, parts = docs.sparkSession, item_parts(benchmark, part_bytes)
    part, later = next(parts, []), next(parts, None)
    if later is None:
        return docs.mapInArrow(_searcher(spark, part, window, column, name), T.StructType([*docs.schema.fields, T.StructField(name, FOUND)]))
    row = free_name(docs, "_row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    texts = numbered.select(F.col(row).alias("_row"), F.col(column).alias("_text"))
    schema = T.StructType([T.StructField("_row", T.LongType()), *FOUND.fields])
    passes = [stage(texts.mapInArrow(_searcher(spark, part, window, "_text", "", ["_row"]), schema), "words")]
    for more in itertools.chain([later], parts):
        passes.append(stage(texts.mapInArrow(_searcher(spark, more, window, "_text", "", ["_row"], hits_only=True), schema), "hits"))
    # a row comes once from each pass that hit it
    by_row = functools.reduce(DataFrame.unionByName, passes).groupBy("_row").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    found = by_row.mapInArrow(_united, T.StructType([T.StructField("_row", T.LongType()), T.StructField("_found", FOUND)]))
    return numbered.join(found.select(F.col("_row").alias(row), F.col("_found").alias(name)), row).select(*[F.col(f"`{c}`") for c in docs.columns], name)


def n_hit(found):
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated(found):
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items and spans."""
    found = F.col("_found")
    return search(docs.select("doc_id", "text"), benchmark, "_found", window, part_bytes=part_bytes).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        contaminated(found).alias("contaminated"),
        found["items"].alias("items"),
        found["spans"].alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    name = free_name(docs, "_found")
    return search(docs, benchmark, name, window).where(~contaminated(F.col(name))).drop(name)
