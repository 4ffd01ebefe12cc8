"""Periodic runs of words, by Lyndon roots.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping q. Every run has a
Lyndon root that is the longest Lyndon word at its place under one of two orders of the words, the one or its reverse. So:
1. Grouping: suffixes are grouped by their first word, and the groups are gone through from the highest; each one's members
   refine the groups of the nearest places to their left that are still to come. This is the first phase of a suffix
   sorter; when a group's turn comes, its context is the longest Lyndon word at its members, so both Lyndon arrays come
   out directly (lyndon).
2. Each root is extended to both sides through the longest common extensions of its two ends; what is long enough is a run.

Only stretches that can hold a run are grouped. In a run of length l >= max(LEAST, 3 q), every group of K = 8 words but
those of the last period comes again q words on. Stretches of places whose K words come again in the text are found by one
sort of hashes for many texts; a run's repeated places are in one of them, at least max(LEAST * 2 / 3, 2 q) - K + 1 in a row,
each q or less from its next. A stretch that no period fits is left out, and others get the words that such a period can
reach beyond them. Equal words have equal hashes, so nothing is missed; words are compared themselves after that.

Defined cases: null and empty texts have no words and no runs; a text of fewer words than the shortest run has none; a very
long text is taken whole, by one task, in memory of a few times its size; rows of one doc_id, or without one, are judged each by itself;
the empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, batches, mix, randoms, words

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 24, 3
#: Words that are hashed together to find repeated places. LEAST is at least three halves of it.
K = 8
_R = randoms(K, 31)
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon(text: list[int]) -> list[int]:
    """The length of the longest Lyndon word at each place of a text of small numbers, smaller ones lower."""
    n = len(text)
    if not n:
        return []
    top = max(text) + 1
    members: list[list[int]] = [[] for _ in range(top)]
    for i, x in enumerate(text):
        members[x].append(i)
    group, context = list(text), [1] * top
    below, above = list(range(-1, top - 1)), [*range(1, top), -1]  # the next group down and up; -1: none
    left, right = list(range(-1, n)), list(range(1, n + 2))  # places still to come: a list with both links
    out = [1] * n
    now = top - 1
    while now >= 0:
        size = context[now]
        own = sorted(i for i in members[now] if group[i] == now)
        # How many members have each place as the nearest to the left whose group is lower.
        reached: dict[int, int] = {}
        for i in own:
            out[i] = size
            a, z = left[i], right[i]
            if a >= 0:
                right[a] = z
                reached[a] = reached.get(a, 0) + 1
            left[z] = a
        # Those of one group that are reached as often go to a new group just above it; the most often reached stand highest.
        parts: dict[tuple[int, int], list[int]] = {}
        for j, often in reached.items():
            parts.setdefault((often, group[j]), []).append(j)
        for often, old in sorted(parts, reverse=True):
            moved = parts[often, old]
            new, up = len(members), above[old]
            members.append(moved)
            context.append(context[old] + often * size)
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for j in moved:
                group[j] = new
        now = below[now]
    return out


def _equal_ahead(w: np.ndarray, i: int, j: int) -> int:
    """How many words from place j > i on are those from i on."""
    found, step = 0, 16
    while j + found < len(w):
        size = min(step, len(w) - j - found)
        differ = np.flatnonzero(w[i + found : i + found + size] != w[j + found : j + found + size])
        if len(differ):
            return found + int(differ[0])
        found, step = found + size, step * 2
    return found


def _equal_behind(w: np.ndarray, i: int, j: int) -> int:
    """How many words before place j > i are those before i."""
    found, step = 0, 16
    while found < i:
        size = min(step, i - found)
        differ = np.flatnonzero(w[i - found - size : i - found] != w[j - found - size : j - found])
        if len(differ):
            return found + size - 1 - int(differ[-1])
        found, step = found + size, step * 2
    return found


def runs_of(w: np.ndarray, stretches: list[tuple[int, int]] | None = None, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbered words that lie in the stretches (all of the text), by start and period."""
    found = set()
    for a, z in stretches if stretches is not None else [(0, len(w))]:
        _, ranks = np.unique(w[a:z], return_inverse=True)
        for order in (ranks, ranks.max(initial=0) - ranks):
            size = np.array(lyndon(order.tolist()), np.int64)
            place = np.arange(a, z)
            # the first root of a run is followed by the same, as it has three periods
            some = place + 2 * size <= len(w)
            some[some] = (w[place[some]] == w[place[some] + size[some]]) & (w[place[some] + size[some] - 1] == w[place[some] + 2 * size[some] - 1])
            last: dict[int, int] = {}  # where the last run of each period ends
            for i, q in zip(place[some].tolist(), size[some].tolist(), strict=True):
                if i + q <= last.get(q, -1):
                    continue
                e = i + q + _equal_ahead(w, i, i + q)
                s = i - _equal_behind(w, i, i + q)
                if e - s >= max(2 * q, 1):
                    last[q] = e
                    if e - s >= max(least, periods * q):
                        found.add((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches_of(hashes: np.ndarray, rows: np.ndarray, least: int = LEAST) -> dict[int, list[tuple[int, int]]]:
    """For texts as hashes of words (rows: where each starts, n + 1 offsets) the stretches that can hold a run."""
    n = len(hashes) - K + 1
    if n <= 0:
        return {}
    grams = hashes[:n] * _R[0]
    for i in range(1, K):
        grams = grams + hashes[i : n + i] * _R[i]
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[:n]
    whole = np.arange(n) + K <= rows[1:][doc]
    at = np.flatnonzero(whole)
    key = mix(grams[at]) + mix(doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    ahead = np.full(n + 1, -1, np.int64)
    ahead[at[order[:-1][same]]] = (at[order[1:]] - at[order[:-1]])[same]
    again = ahead[:n] > 0
    edge = np.diff(np.concatenate([[False], again, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a stretch ends before its text does: the last K - 1 places have no gram
    if not len(first):
        return {}
    nearest = np.minimum.reduceat(np.where(again, ahead[:n], np.iinfo(np.int64).max), first)
    size = last - first
    out: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(size >= np.maximum(2 * least // 3, 2 * nearest) - K + 1):
        d = int(doc[first[k]])
        reach = (size[k] + K - 1) // 2  # no period is longer
        a, z = int(first[k] - rows[d]), int(min(rows[d + 1], last[k] + reach + K) - rows[d])
        spans = out.setdefault(d, [])
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
        else:
            spans.append((a, z))
    return out


def collapsed_places(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when of each run only the first period does."""
    cover = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        cover[s + q] += 1
        cover[s + length] -= 1
    return np.cumsum(cover[:-1]) == 0


def detected(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, text) to one row a document: doc_id, n_words, its runs of at least so many words and periods, by start and period,
    and the text with words joined by one space and of each run the first period only. periods is at least 3, least at least 24."""
    if periods < PERIODS or least < LEAST:
        raise ValueError(f"runs have at least {PERIODS} periods and {LEAST} words")

    def run(frames):
        for batch, data, offsets in batches(frames):
            hashes, _, _, rows = words(data, offsets, NOT_SPACE, lower=False)
            spans = stretches_of(hashes, rows, least)
            raw, found, kept = data.tobytes(), [], []
            for d in range(batch.num_rows):
                own = raw[offsets[d] : offsets[d + 1]].split()  # bytes split at the same six characters
                runs = []
                if d in spans:
                    number: dict[bytes, int] = {}
                    runs = runs_of(np.array([number.setdefault(x, len(number)) for x in own], np.int64), spans[d], least, periods)
                    if runs:
                        own = [own[i] for i in np.flatnonzero(collapsed_places(len(own), runs)).tolist()]
                found.append([{"start": s, "length": size, "period": q} for s, size, q in runs])
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(rows)), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with, for a tenth of the ids, words from a place on repeated with a period, both from a hash of the id.
    Other documents stay as they are, and so do those without words or id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    own = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", h)
    chosen = chosen.withColumn("w", F.when(F.col("h") % 10 == 0, own)).withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))), " ")
    return chosen.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """detected()'s rows with their runs as digests: doc_id, n_runs, the run of the greatest length by period, and hashes."""
    r = F.col("runs")
    # a larger exponent first, compared without division
    better = lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)  # noqa: E731  of equal ones the earlier stays: runs are in order
    best = F.when(F.size(r) > 0, F.aggregate(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.get(r, F.lit(0)), better))
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(r).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
