"""Near duplicates by b-bit MinHash.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (of fewer words, their sequence as one). Documents
with equal sets are one class, linked outright. Each class has rows * bands minima (see layout); a band hashes `rows` of them, and
classes that share a band are candidates. Of every minimum only the low BITS bits are kept, packed into a signature:
counting equal ones and correcting for those equal by chance estimates the similarity of a candidate pair, and
pairs far below the threshold go no further. The rest are compared on their full sets.

Nothing is listed as pairs, whatever a band's bucket or a group of copies holds:
1. Classes of a bucket meet by signature (parts of PART classes, and a tile for each pair of parts), each pair at most
   once a bucket. Of the pairs that may be similar, each tile passes on a spanning forest of the likeliest.
2. These are compared on their full sets; classes that they link are one component from here on. The components of the
   likely pairs are families; most families are one component now, and are done.
3. In the other families the buckets' tiles are gone through again for likely pairs between different components.
   Families are cut into parts of TILE classes, and a class's set is sent to the parts in which it has such a pair, and
   only there. A tile of two parts compares likely pairs that share a band, but those whose classes have become linked.
So the links join the same components as all links do; what is sent grows with the likely pairs that buckets hold, by
tiles, and not with families.

Shingles are hashes of words whose bytes are scrambled eight at a time (see common.run_hashes): two shingles are taken for one
with probability 2^-64.

Defined cases: null text and text without words has the empty set and is linked with nothing; rows of one doc_id are one
document, each row linked by its own text (n_shingles is the largest, component_id the smallest); a row without doc_id
stands for no group: it shows its class's component, or null, is not marked as kept, and unique() leaves such rows as
they are; a very long text is one set, made in memory of a few times its size; the empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, batches, mix, randoms, slices, stage, words
from .graph import components

SHINGLE = 5
ROWS, BANDS, BITS = 8, 32, 2
#: Per cent.
THRESHOLD = 85
#: From this threshold on, so many minima in a band and bands: at it, a pair shares none with probability 4e-5 (8, 32) and
#: 1.3e-5 (7, 48).
LAYOUTS = {THRESHOLD: (ROWS, BANDS), 80: (7, 48)}
#: Estimates this far below the threshold (about five standard deviations) rule a pair out.
MARGIN = 0.13
#: Classes of a bucket that meet in one tile by signature, and of a family by set.
PART, TILE = 512, 64
#: Pairs of signatures that are compared at once.
PAIRS = 1 << 17
_MOST = max(rows * bands for rows, bands in LAYOUTS.values())
_A, _B = (randoms(_MOST, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (randoms(_MOST, 22) >> np.uint64(32)).astype(np.uint32)
_C, _D = randoms(_MOST, 23), randoms(64, 24)


def layout(threshold: int) -> tuple[int, int]:
    """Minima in a band, and bands, that miss hardly a pair of that similarity."""
    for least, found in sorted(LAYOUTS.items(), reverse=True):
        if threshold >= least:
            return found
    raise ValueError(f"no bands for a threshold of {threshold}")


def shingles(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, in order and with repeats, and each row's first (n + 1 offsets)."""
    hashes, _, _, rows = words(data, offsets, NOT_SPACE)
    n = np.diff(rows)
    counts = np.where(n >= length, n - length + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(ends[-1], np.uint64)
    if len(hashes) >= length:
        run = hashes[: len(hashes) - length + 1] * _D[0]
        for i in range(1, length):
            run = run + hashes[i : len(hashes) - length + 1 + i] * _D[i]
        full = np.repeat(n >= length, counts)
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - rows[:-1], counts)
        out[full] = run[place[full]]
    for k in np.flatnonzero((n > 0) & (n < length)):
        own = hashes[rows[k] : rows[k + 1]]
        out[ends[k]] = np.append(own * _D[: len(own)], _D[length + len(own)]).sum()
    return mix(out), ends


FEATURES = "doc_id long, n long, key binary, signature binary, bands array<long>"


def features(docs: DataFrame, length: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, text) to the size of each set, its 128-bit hash, its signature and its bands; null if empty."""
    n_minima, n_bands, mixed = rows * bands, bands, _C[: rows * bands]

    def run(frames):
        for batch, data, offsets in batches(frames):
            every, ends = shingles(data, offsets, length)
            n, keys = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for k in np.flatnonzero(np.diff(ends)):
                own = np.unique(every[ends[k] : ends[k + 1]])
                n[k], keys[k] = len(own), xxhash.xxh3_128_digest(own.tobytes())
            some = np.flatnonzero(n)
            signatures, found = [None] * batch.num_rows, [None] * batch.num_rows
            if len(some):
                short, starts = (every >> np.uint64(32)).astype(np.uint32), ends[:-1][some]
                minima = np.empty((n_minima, len(some)), np.uint32)
                for i in range(n_minima):
                    minima[i] = np.minimum.reduceat(short * _A[i] + _B[i], starts)
                spread = mix(minima.astype(np.uint64) * mixed[:, None] + mixed[::-1, None])
                low = (spread >> np.uint64(64 - BITS)).astype(np.uint8).T
                bits = np.stack([low >> i & 1 for i in range(BITS)], 1)  # one plane for each bit
                packed = np.packbits(bits.reshape(len(some), -1), axis=1)
                band = mix(spread.reshape(n_bands, rows, -1).sum(1, dtype=np.uint64) + mixed[:n_bands, None]).view(np.int64).T
                for k, s, b in zip(some.tolist(), packed, band, strict=True):
                    signatures[k], found[k] = s.tobytes(), b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n", "key", "signature", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FEATURES)


def sets(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to (doc_id, key, shingles): the sorted hashes as bytes."""

    def run(frames):
        for batch, data, offsets in batches(frames):
            every, ends = shingles(data, offsets, length)
            own = [np.unique(every[a:z]).tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(x) for x in own], pa.binary()), pa.array(own, pa.binary())], ["doc_id", "key", "shingles"])

    return docs.mapInArrow(run, "doc_id long, key binary, shingles binary")


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of all pairs of two stacks of signatures: the share of equal entries, less those equal by chance."""
    planes = np.bitwise_xor(x[:, None, :], y[None, :, :]).reshape(len(x), len(y), BITS, -1)
    differ = np.bitwise_count(np.bitwise_or.reduce(planes, axis=2)).sum(-1, dtype=np.int64)
    chance = 1 / 2**BITS
    return (1 - differ / (x.shape[1] * 8 // BITS) - chance) / (1 - chance)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The estimate for pairs of signatures, row by row."""
    planes = np.bitwise_xor(x, y).reshape(len(x), BITS, x.shape[1] // BITS)
    differ = np.bitwise_count(np.bitwise_or.reduce(planes, axis=1)).sum(-1, dtype=np.int64)
    chance = 1 / 2**BITS
    return (1 - differ / (x.shape[1] * 8 // BITS) - chance) / (1 - chance)


def _whole_tiles(frames, names):
    """(rows, ends of the tiles) of whole tiles from rows in their order; what a batch cuts is put together."""
    rest = None
    for batch in itertools.chain(frames, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
        if rest is None or not len(rest):
            continue
        keys = np.column_stack([rest[c].to_numpy() for c in names])
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if batch is None:
            ends = np.append(ends, len(keys))
        if len(ends):
            yield rest.slice(0, ends[-1]).combine_chunks(), ends
            rest = rest.slice(ends[-1])


def _likely(frames, names, threshold: int):
    """(rows, i, j, estimate) of pairs i < j of a tile that may be similar, for some tiles at a time."""
    for rows, ends in _whole_tiles(frames, names):
        n, p, q, part = (rows[c].to_numpy() for c in ("n", "p", "q", "part"))
        signatures = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(len(rows), -1)
        # row i meets i + 1, i + 2, ... up to the end of its tile, many rows at once
        left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(rows)) - 1
        starts = np.concatenate([[0], np.cumsum(left)])
        for a, z in slices(np.concatenate([[0], starts[ends]]), PAIRS):
            a, z = (int(starts[0 if k == 0 else ends[k - 1]]) for k in (a, z))
            i = np.searchsorted(starts, np.arange(a, z), "right") - 1
            j = i + 1 + np.arange(a, z) - starts[i]
            # in a tile of two parts, only pairs across them
            some = ((p[i] == q[i]) | (part[i] != part[j])) & (100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
            i, j = i[some], j[some]
            e = alike(signatures[i], signatures[j])
            near = e >= threshold / 100 - MARGIN
            yield rows, i[near], j[near], e[near]


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of n nodes: in each round every tree takes its heaviest edge to another."""
    root, a, z = np.arange(n), [], []
    order = np.lexsort((j, i, -weight))
    i, j = i[order], j[order]
    while len(i):
        u, v = root[i], root[j]
        out = u != v
        i, j, u, v = i[out], j[out], u[out], v[out]
        best = np.full(n, len(i))
        np.minimum.at(best, u, np.arange(len(i)))
        np.minimum.at(best, v, np.arange(len(i)))
        chosen = np.unique(best[best < len(i)])
        if not len(chosen):
            break
        a.append(i[chosen])
        z.append(j[chosen])
        # the chosen edges form no cycle, since no two of them weigh the same; label their trees
        label = np.arange(n)
        while True:
            low = np.minimum(label[u[chosen]], label[v[chosen]])
            before = label.copy()
            np.minimum.at(label, u[chosen], low)
            np.minimum.at(label, v[chosen], low)
            label = label[label]
            if (label == before).all():
                break
        root = label[root]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(z)) if a else (none, none)


def _spanning(threshold: int):
    def run(frames):
        for rows, i, j, e in _likely(frames, ("band", "p", "q"), threshold):
            base = int(i.min()) if len(i) else 0
            a, z = forest(int(j.max()) + 1 - base if len(j) else 0, i - base, j - base, e)
            rep = rows["rep"].to_numpy()[base:]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[z])), pa.array(np.maximum(rep[a], rep[z]))], ["a", "b"])

    return run


def _open(threshold: int):
    """(rep, word, bits): the family's parts that classes meet, those in which they have a likely pair in another component;
    a bit each, 64 to a word."""

    def run(frames):
        for rows, i, j, _ in _likely(frames, ("band", "p", "q"), threshold):
            rep, component, own = (rows[c].to_numpy() for c in ("rep", "component", "own"))
            apart = component[i] != component[j]
            i, j = i[apart], j[apart]
            who, meets = np.append(rep[i], rep[j]), np.append(own[j], own[i])
            order = np.lexsort((meets, who))
            who, word, bit = who[order], meets[order] // 64, np.uint64(1) << (meets[order] % 64).astype(np.uint64)
            first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (word[1:] != word[:-1]))[: len(who)])
            bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
            yield pa.RecordBatch.from_arrays([pa.array(who[first]), pa.array(word[first].astype(np.int32)), pa.array(bits.view(np.int64))], ["rep", "word", "bits"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (len(x) + len(y) - common)


def _tile(threshold: int):
    def links(frame: pd.DataFrame) -> pd.DataFrame:
        """Confirmed links between classes of a tile, no more than join them."""
        frame = frame.sort_values(["own", "rep"], kind="stable")
        reps, parts, n = frame["rep"].to_numpy(), frame["own"].to_numpy(), frame["n"].to_numpy()
        signatures = np.frombuffer(b"".join(frame["signature"]), np.uint8).reshape(len(frame), -1)
        bands = np.array(frame["bands"].tolist(), np.int64)
        own = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        left, right = np.flatnonzero(parts == parts.min()), np.flatnonzero(parts == parts.max())
        likely = estimate(signatures[left], signatures[right])
        near = likely >= threshold / 100 - MARGIN
        small, large = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
        near &= 100 * small >= threshold * large
        if parts.min() == parts.max():
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        shared = (bands[left[i]] == bands[right[j]]).any(axis=1)
        i, j = i[shared], j[shared]
        order = np.argsort(-likely[i, j], kind="stable")
        components_ = frame["component"].to_numpy()
        root = np.searchsorted(np.unique(components_), components_).tolist()
        root = [root.index(x) for x in root]  # classes linked before are one from the start

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for a, z in zip(left[i[order]].tolist(), right[j[order]].tolist(), strict=True):
            u, v = find(a), find(z)
            if u != v and _similar(own[a], own[z], threshold):
                root[max(u, v)] = min(u, v)
                out.append((int(reps[a]), int(reps[z])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return links


def _confirmed(threshold: int):
    """(a, b) of rows whose two sets are similar."""

    def run(frames):
        for batch in frames:
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tiles(rows: DataFrame, size: int, group: str) -> DataFrame:
    """Rows of a bucket of c to tiles (p, q) of two of its parts."""
    parts = F.ceil(F.col("c") / size).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other", "parts", "c").repartition(group, "p", "q").sortWithinPartitions(group, "p", "q", "rep")


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, length: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to one row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(features(docs, length, *layout(threshold)), "features")
    classes = stage(found.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min_by("signature", "doc_id").alias("signature"), F.min_by("bands", "doc_id").alias("bands")), "classes")

    # Buckets of two classes and more. A doc_id may stand for several classes, if its rows have several texts.
    band = classes.select("rep", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("band").alias("of"), "c")
    buckets = stage(band.join(shared, F.col("band") == F.col("of")).select("rep", "band", "c"), "buckets")
    by_rep = classes.select(F.col("rep").alias("r"), "n", "signature", "key")
    members = buckets.join(by_rep.hint("merge"), F.col("rep") == F.col("r")).select("rep", "band", "c", "n", "signature")
    likely = stage(_tiles(members, PART, "band").mapInArrow(_spanning(threshold), "a long, b long").where("a <> b").distinct(), "likely")

    # Full sets of classes with a likely partner, each made once.
    ends = stage(likely.select(F.col("a").alias("member")).unionByName(likely.select(F.col("b").alias("member"))).distinct(), "members")
    own = sets(docs.join(ends.hint("merge"), F.col("doc_id") == F.col("member"), "left_semi"), length).select(F.col("doc_id").alias("rep"), "key", "shingles")
    if not found.where("n > 0 and doc_id is not null").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        own = own.dropDuplicates(["rep", "key"])  # of rows with one id and text, one
    own = stage(own, "sets")
    one, two = own.select(F.col("rep").alias("ra"), F.col("shingles").alias("x")), own.select(F.col("rep").alias("rb"), F.col("shingles").alias("y"))
    pairs = likely.join(one.hint("merge"), F.col("a") == F.col("ra")).join(two.hint("merge"), F.col("b") == F.col("rb")).select("a", "b", "x", "y")
    first = stage(pairs.mapInArrow(_confirmed(threshold), "a long, b long"), "first-links")
    joined = components(first)

    # Families that are not one component yet: those with a likely pair between two.
    now = joined.select(F.col("id").alias("j"), F.col("component").alias("joined"))
    nodes = stage(ends.join(now.hint("merge"), F.col("member") == F.col("j"), "left").select("member", F.coalesce("joined", "member").alias("component")), "nodes")
    ca, cb = nodes.select(F.col("member").alias("ma"), F.col("component").alias("ca")), nodes.select(F.col("member").alias("mb"), F.col("component").alias("cb"))
    apart = stage(likely.join(ca.hint("merge"), F.col("a") == F.col("ma")).join(cb.hint("merge"), F.col("b") == F.col("mb")).where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "apart")
    if not apart.isEmpty():
        family = components(apart)
        family = family.unionByName(family.select(F.col("component").alias("id"), "component").distinct()).select("id", F.col("component").alias("family"))
        family = stage(nodes.join(family.hint("merge"), F.col("component") == F.col("id")).select("member", "family", "component"), "families")
        sizes = family.groupBy(F.col("family").alias("f")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("own_parts"))
        unfinished = stage(family.join(sizes, F.col("family") == F.col("f")).select("member", "family", "component", F.pmod(F.xxhash64("member"), F.col("own_parts")).cast("int").alias("own")), "unfinished")
        again = members.join(unfinished.hint("merge"), F.col("rep") == F.col("member")).select("rep", "band", "c", "n", "signature", "component", "own")
        bits = stage(_tiles(again, PART, "band").mapInArrow(_open(threshold), "rep long, word int, bits long").groupBy("rep", "word").agg(F.bit_or("bits").alias("bits")), "meets")
        meets = bits.select("rep", F.explode(F.filter(F.sequence(F.col("word") * 64, F.col("word") * 64 + 63), lambda m: F.getbit("bits", m % 64) == 1)).alias("meets"))
        full = classes.join(unfinished.hint("merge"), F.col("rep") == F.col("member")).join(own.select(F.col("rep").alias("s"), F.col("key").alias("set_key"), "shingles").hint("merge"), F.expr("rep = s and key = set_key"))
        tiled = full.join(meets.select(F.col("rep").alias("m"), "meets").hint("merge"), F.col("rep") == F.col("m")).withColumns({"p": F.least("own", "meets"), "q": F.greatest("own", "meets")})
        links = tiled.select("family", "p", "q", "own", "rep", "component", "n", "signature", "bands", "shingles").groupBy("family", "p", "q").applyInPandas(_tile(threshold), "a long, b long")
        joined = components(first.unionByName(stage(links, "more-links")))

    of_class = classes.select(F.col("key").alias("class_key"), "rep")
    each = found.join(of_class, F.col("key") == F.col("class_key"), "left").select("doc_id", "n", "rep")
    each = each.join(joined, F.col("rep") == F.col("id"), "left").select("doc_id", "n", F.coalesce("component", "rep", "doc_id").alias("component"))
    return each.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def unique(docs: DataFrame, threshold: int = THRESHOLD, length: int = SHINGLE) -> DataFrame:
    """One document of each group, with its columns; of rows with its id, one."""
    # Texts move once, by id, whatever the number of ids: a merge join at every size.
    marks = stage(deduplicated(docs, threshold, length).where("kept").select(F.col("doc_id").alias("_kept")), "kept").hint("merge")
    kept = docs.join(marks, docs["doc_id"] == marks["_kept"], "left_semi").unionByName(docs.where("doc_id is null"))
    again = stage(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 and _id is not null").select("_id"), "repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again["_id"], "left_anti")
    return once.unionByName(kept.join(again, kept["doc_id"] == again["_id"], "left_semi").dropDuplicates(["doc_id"]))
