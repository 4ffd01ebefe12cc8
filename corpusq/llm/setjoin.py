"""Jaccard join of n-gram sets, exact, by pigeonhole over partitions of the universe.

A document's set holds the 64-bit hashes of its distinct shingles. Two sets of sizes x <= y that are similar differ in at most
(100 - t)(x + y) / (100 + t) shingles, t being the threshold in per cent. Documents with equal sets are one class, linked
outright; for the others:

1. Sizes are cut into bands. A band cuts the universe of hashes into equal segments, and a set of x shingles keeps the first of its
   band's segments, as many as the differences that a partner of y >= x may have, plus one, plus a few to spare. A larger partner
   keeps these too: in the same band it keeps as many or more, and from the next band it keeps all of this one's.
2. Of each kept segment the hash of its shingles is a signature; of the first few (the deep ones) so are the hashes of what is
   left of it without any one shingle.
3. An allocation gives segment i the value 0, 1 or 2 (2 to deep ones only). If the values sum to more than the differences, then in one segment
   the two sets differ in less than its value: in nothing, so that both have its signature, or in one shingle at most, so that a
   signature of the one is the segment of the other without a shingle. So the smaller set looks where its values are, and finds every partner.
4. The allocation is by cost. Signatures that no other class has cost nothing; so do those whose classes are known to be linked to
   it already. Of the others the cheapest are taken, by the number of sets that have them, until the sum is reached. Most sets
   reach it with what costs nothing, and look nowhere.
5. What is found is compared by parity sketches: bits that are flipped by every shingle. Two sketches differ in no more bits than the
   sets do, so a pair that differs in too many is not similar. The rest are compared on their full sets.

As only components are asked for, no group is listed as pairs: first each class meets the class that comes first among
those with its signatures, most often; these links make components; then steps 4 and 5 go on between different components,
in tiles of PART classes of a signature, first with a spanning forest of the nearest pairs of each tile, then with all that
are left. Nothing is left out, so the components are those of all links.

Shingles are 64-bit hashes of words (common.run_hashes); two are taken for one with probability 2^-64.

Defined cases: null text and text without words has the empty set and is linked with nothing; fewer words than a shingle has are one
shingle; rows of one doc_id are one document, linked by each row's text (n_shingles is the largest); a row without doc_id links
nothing, it shows its class's component, or null; a very long text is one set, made in memory of a few times its size; the
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, mix, randoms, slices, stage
from .graph import components
from .neardup import _whole_tiles, forest, shingles

SHINGLE = 4
#: Per cent; no less than LEAST_THRESHOLD, so that partners are in a band or the next.
THRESHOLD, LEAST_THRESHOLD = 85, 70
RATIO = 1.6
#: One to spare for so many needed segments, and one deep segment for so many (2 and 1 at least).
SPARE, DEEP = 16, 48
#: Bits of a sketch: so many for a shingle, in powers of two within these bounds.
SKETCH, LEAST_SKETCH, MOST_SKETCH = 4, 64, 1 << 17
#: Bits by which tasks know, before any shuffle, most documents whose sets are not needed. Sent to all tasks; 4 MB at any size.
MARKS = 1 << 25
#: Classes of a signature that meet in one tile, and pairs that are compared at once.
PART, PAIRS = 512, 1 << 16
_C = randoms(2, 41)


class Bands:
    """Bands of sizes and their segments, for a threshold."""

    def __init__(self, threshold: int = THRESHOLD):
        if not LEAST_THRESHOLD <= threshold <= 100:
            raise ValueError(f"the threshold is {LEAST_THRESHOLD} to 100 per cent")
        self.t, self.starts = threshold, [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * RATIO)))
        self.layouts = [self.layout(k) for k in range(len(self.starts) - 1)]

    def differences(self, both: int) -> int:
        """The most differences of similar sets of so many shingles together."""
        return (100 - self.t) * both // (100 + self.t)

    def need(self, n: int) -> int:
        """What the values of a set sum to: one more than its differences from the largest partner."""
        return self.differences(n + 100 * n // self.t) + 1

    def layout(self, k: int) -> tuple[int, int, int]:
        """(segments, deep ones, spare) of a band; no segments if its sets are only similar to themselves."""
        need = self.need(self.starts[k + 1] - 1)
        if need == 1:
            return 0, 0, 0
        spare, deep = max(2, need // SPARE), max(1, need // DEEP)
        return need + spare - deep, deep, spare

    def kept(self, n: int) -> list[tuple[int, int, int, int, int]]:
        """(band, its segments, deep ones, segments that a set of n keeps, 0 for its own band and 1 for the one before)."""
        k = int(np.searchsorted(self.starts, n, "right")) - 1
        if self.need(n) == 1:
            return []
        m, deep, spare = self.layouts[k]
        out = [(k, m, deep, self.need(n) + spare - deep, 0)]
        if k and self.layouts[k - 1][0] and n <= 100 * (self.starts[k] - 1) // self.t:
            before = self.layouts[k - 1]
            out.append((k - 1, before[0], before[1], before[0], 1))
        return out

    def spare(self, n: int) -> int:
        return self.layouts[int(np.searchsorted(self.starts, n, "right")) - 1][2]


def signatures(own: np.ndarray, values: np.ndarray, band: int, m: int, deep: int, keep: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, signature) of a sorted set: place is 4 * segment + 2 * before + 1 if a shingle is left out."""
    segment = (((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    stop = int(np.searchsorted(segment, keep))
    segment, values = segment[:stop], values[:stop]
    content = np.zeros(keep, np.uint64)
    if stop:
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        content[segment[first]] = np.add.reduceat(values, first)
    salt = mix(np.arange(keep, dtype=np.uint64) + np.uint64(band + 1) * _C[:1])
    some = int(np.searchsorted(segment, deep))
    less = content[segment[:some]] - values[:some] + salt[segment[:some]]
    place = np.concatenate([np.arange(keep) * 4, segment[:some] * 4 + 1]) + 2 * before
    return place.astype(np.int32), mix(np.concatenate([content + salt, less])).view(np.int64)


def sketch(values: np.ndarray) -> bytes:
    bits = min(MOST_SKETCH, max(LEAST_SKETCH, 1 << (SKETCH * len(values) - 1).bit_length()))
    flips = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


FEATURES = "uid long, doc_id long, n long, key binary, spare int, sketch binary, places array<int>, buckets array<long>"


def features(docs: DataFrame, threshold: int = THRESHOLD, length: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to a number for each row, the size of its set, a 128-bit hash of it, its sketch and its signatures. To be
    written before it is used, since rows are numbered as they come."""

    def run(frames):
        bands, number = Bands(threshold), TaskContext.get().partitionId() << 36
        for batch, data, offsets in batches(frames):
            every, ends = shingles(data, offsets, length)
            n, keys, sketches, spare = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32)
            places, buckets, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], np.zeros(batch.num_rows, np.int64)
            for k in np.flatnonzero(np.diff(ends)).tolist():
                own = np.unique(every[ends[k] : ends[k + 1]])
                values = mix(own ^ _C[1])
                n[k], keys[k], sketches[k], spare[k] = len(own), xxhash.xxh3_128_digest(own.tobytes()), sketch(values), bands.spare(len(own))
                for kept in bands.kept(len(own)):
                    place, bucket = signatures(own, values, *kept)
                    places.append(place)
                    buckets.append(bucket)
                    sizes[k] += len(place)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            pieces = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (places, buckets)]
            uid = pa.array(np.arange(number, number + batch.num_rows))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([uid, batch.column("doc_id"), pa.array(n), pa.array(keys, pa.binary()), pa.array(spare), pa.array(sketches, pa.binary()), *pieces], ["uid", "doc_id", "n", "key", "spare", "sketch", "places", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FEATURES)


# --- sketches ---------------------------------------------------------------------------------------------------------


def folded(data: bytes, size: int) -> np.ndarray:
    """A sketch as one of fewer bytes."""
    out = np.frombuffer(data, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def distances(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which sketches of pairs differ, each pair at its shorter sketch."""
    sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
    common, out = np.minimum(sizes[i], sizes[j]), np.zeros(len(i), np.int64)
    for size in np.unique(common).tolist():
        pairs = np.flatnonzero(common == size)
        used = np.unique(np.concatenate([i[pairs], j[pairs]]))
        stack = np.stack([folded(sketches[k], size) for k in used.tolist()])
        x, y = np.searchsorted(used, i[pairs]), np.searchsorted(used, j[pairs])
        for a, z in slices(np.arange(len(pairs) + 1) * size, 1 << 23):
            out[pairs[a:z]] = np.bitwise_count(stack[x[a:z]] ^ stack[y[a:z]]).sum(1, dtype=np.int64)
    return out


def _possible(bands: Bands, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return 100 * small >= bands.t * large


def _close(threshold: int):
    """(a, b) of rows whose sketches (x, y) allow for similar sets."""

    def run(frames):
        bands = Bands(threshold)
        for batch in frames:
            n = np.concatenate([batch.column("nx").to_numpy(), batch.column("ny").to_numpy()])
            i = np.arange(batch.num_rows)
            j = i + batch.num_rows
            near = distances(batch.column("x").to_pylist() + batch.column("y").to_pylist(), i, j) <= (100 - threshold) * (n[i] + n[j]) // (100 + threshold)
            yield batch.select(["a", "b"]).filter(pa.array(near & _possible(bands, n, i, j)))

    return run


def _met(threshold: int, whole: bool):
    """Rows of tiles to pairs between components that sketches allow for, of which one looks for the other: all, or those
    that join the most, nearest first."""

    def run(frames):
        bands = Bands(threshold)
        for rows, ends in _whole_tiles(frames, ("bucket", "p", "q")):
            n, p, q, part, c, component, looks = (rows[x].to_numpy() for x in ("n", "p", "q", "part", "c", "component", "looks"))
            sketches = rows["sketch"].to_pylist()
            left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(rows)) - 1
            starts = np.concatenate([[0], np.cumsum(left)])
            for a, z in slices(np.concatenate([[0], starts[ends]]), PAIRS):
                a, z = (int(starts[0 if k == 0 else ends[k - 1]]) for k in (a, z))
                i = np.searchsorted(starts, np.arange(a, z), "right") - 1
                j = i + 1 + np.arange(a, z) - starts[i]
                some = ((p[i] == q[i]) | (part[i] != part[j])) & (component[i] != component[j]) & (looks[i] | looks[j]) & _possible(bands, n, i, j)
                i, j = i[some], j[some]
                d = distances(sketches, i, j)
                near = d <= (100 - threshold) * (n[i] + n[j]) // (100 + threshold)
                i, j, d = i[near], j[near], d[near]
                if not whole and len(i):
                    # a tile's components are its nodes; tiles are apart, as their rows are
                    tile = np.searchsorted(ends, i, "right")
                    nodes, at = np.unique(np.concatenate([np.column_stack([tile, component[i]]), np.column_stack([tile, component[j]])]), axis=0, return_inverse=True)
                    at = at.reshape(-1)
                    u, v = at[: len(i)], at[len(i) :]
                    order = np.lexsort((j, i, d, np.maximum(u, v), np.minimum(u, v)))  # of two components, the nearest pair
                    u, v, i, j, d = np.minimum(u, v)[order], np.maximum(u, v)[order], i[order], j[order], d[order]
                    first = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
                    u, v, i, j, d = u[first], v[first], i[first], j[first], d[first]
                    x, y = forest(len(nodes), u, v, -d.astype(float))
                    of = {pair: k for k, pair in enumerate(zip(u.tolist(), v.tolist(), strict=True))}
                    chosen = np.array([of[pair] for pair in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
                    i, j = i[chosen], j[chosen]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c[i], c[j])), pa.array(np.maximum(c[i], c[j]))], ["a", "b"])

    return run


def _similar(threshold: int):
    """(a, b) of rows whose full sets (x, y) are similar."""

    def run(frames):
        for batch in frames:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sets(docs: DataFrame, length: int, marks: np.ndarray) -> DataFrame:
    """(doc_id, key, shingles as bytes) of documents whose ids are marked, and of a few others."""
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def run(frames):
        bits = sent.value
        for frame in frames:
            at = frame.column("mark").to_numpy(zero_copy_only=False)
            wanted = frame.filter(pa.array(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1)).select(["doc_id", "text"])
            for batch, data, offsets in batches([wanted]):
                every, ends = shingles(data, offsets, length)
                own = [np.unique(every[a:z]).tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(x) for x in own], pa.binary()), pa.array(own, pa.binary())], ["doc_id", "key", "shingles"])

    return docs.where("doc_id is not null").select("doc_id", "text", _mark("doc_id").alias("mark")).mapInArrow(run, "doc_id long, key binary, shingles binary")


def _mark(c: str):
    return F.pmod(F.xxhash64(c), F.lit(MARKS))


def marked(ids: DataFrame) -> np.ndarray:
    """A bit for each id, by its hash, in MARKS bits: the more ids, the more others are marked too."""
    words = ids.select(_mark("id").alias("m")).groupBy(F.expr("m div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(m % 64 AS INT)))").alias("bits"))
    out = np.zeros(MARKS // 64, np.uint64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


# --- operator ---------------------------------------------------------------------------------------------------------


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows of a bucket of c_all to tiles (p, q) of two of its parts."""
    rows = rows.withColumn("parts", F.ceil(F.col("all") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other", "parts", "all").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "c")


def allocated(mixed: DataFrame) -> DataFrame:
    """Rows (bucket, c, place, spare, full: sets with this segment, less: sets with it and one shingle more) of signatures that
    classes of other components have to the segments in which each class looks: (c, segment, value). Those that cost most are left."""
    own = mixed.where(F.col("place") % 4 < 2).withColumns({"segment": F.expr("place div 4"), "short": F.col("place") % 2 == 1})
    once, twice = F.when(~F.col("short"), F.col("full") - 1).otherwise(0), F.when(F.col("short"), F.col("full")).otherwise(F.col("less"))
    by = own.groupBy("c", "segment").agg(F.sum(once).alias("one"), F.sum(twice).alias("two"), F.max("spare").alias("spare"))
    # value 2 includes value 1: it costs as much at least
    units = by.withColumn("unit", F.explode(F.array(F.struct(F.lit(1).alias("value"), F.col("one").alias("cost")), F.struct(F.lit(2).alias("value"), F.when(F.col("two") > 0, F.greatest("one", "two")).otherwise(0).alias("cost"))))).where("unit.cost > 0")
    whole = W.partitionBy("c")  # the segments of one set
    units = units.withColumn("costed", F.count(F.lit(1)).over(whole)).where(F.col("costed") > F.col("spare"))
    rank = F.row_number().over(whole.orderBy("unit.cost", "unit.value", "segment"))
    return units.withColumn("rank", rank).where(F.col("rank") <= F.col("costed") - F.col("spare")).groupBy("c", "segment").agg(F.max("unit.value").alias("value"))


def linked(docs: DataFrame, threshold: int = THRESHOLD, length: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to one row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(features(docs, threshold, length), "sets-features")
    named = found.where("n > 0 and doc_id is not null")
    classes = stage(named.groupBy("key").agg(F.min("uid").alias("c")), "set-classes")

    # Signatures that several classes have, with the first of these.
    first = classes.select(F.col("c").alias("of"))
    rows = found.join(first.hint("merge"), F.col("uid") == F.col("of"), "left_semi").select(F.col("uid").alias("c"), F.explode(F.arrays_zip("places", "buckets")).alias("piece")).select("c", F.col("piece.places").alias("place"), F.col("piece.buckets").alias("bucket"))
    several = rows.groupBy(F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("b")
    shared = stage(rows.join(several.hint("merge"), F.col("bucket") == F.col("b"), "left_semi").select("bucket", "c", "place"), "signatures")
    short = F.col("place") % 2 == 1

    by_uid = found.select("uid", "doc_id", "n", "key", "spare", "sketch")

    def of(name: str, *columns: str) -> DataFrame:
        return by_uid.select(F.col("uid").alias(f"u{name}"), *[F.col(x).alias(y) for x, y in (column.split(":") for column in columns)])

    sets_made: list[DataFrame] = []

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs of similar sets. A class's set is made once, for the first pairs that need it."""
        ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        for made in sets_made:
            ends = ends.join(made.select(F.col("c").alias("made")), F.col("c") == F.col("made"), "left_anti")
        ends = stage(ends.join(of("", "doc_id:id", "key:own"), F.col("c") == F.col("u")).select("c", "id", "own"), "set-ends")
        new = sets(docs, length, marked(ends.select("id"))).join(ends, F.expr("doc_id = id and key = own")).select("c", "shingles")
        # rows of one id and text have equal sets
        repeated = named.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        if not sets_made:
            again.append(not repeated.isEmpty())
        sets_made.append(stage(new.dropDuplicates(["c"]) if again[0] else new, "full-sets"))
        every = sets_made[0]
        for more in sets_made[1:]:
            every = every.unionByName(more)
        x, y = every.select(F.col("c").alias("cx"), F.col("shingles").alias("x")), every.select(F.col("c").alias("cy"), F.col("shingles").alias("y"))
        both = pairs.join(x.hint("merge"), F.col("a") == F.col("cx")).join(y.hint("merge"), F.col("b") == F.col("cy")).select("a", "b", "x", "y")
        return stage(both.mapInArrow(_similar(threshold), "a long, b long"), name)

    again: list[bool] = []
    # Each class and the one that comes first most often among those with its signatures.
    hubs = shared.where(~short).groupBy(F.col("bucket").alias("b")).agg(F.min("c").alias("hub"), F.max("c").alias("last")).where("hub < last").drop("last")
    often = shared.where(~short).join(hubs.hint("merge"), F.col("bucket") == F.col("b")).where("c <> hub").groupBy("c", "hub").agg(F.count(F.lit(1)).alias("often"))
    stars = often.groupBy(F.col("c").alias("b")).agg(F.max_by("hub", F.struct("often", -F.col("hub"))).alias("a"))
    sketched = stars.join(of("x", "n:nx", "sketch:x").hint("merge"), F.col("a") == F.col("ux")).join(of("y", "n:ny", "sketch:y").hint("merge"), F.col("b") == F.col("uy")).select("a", "b", "nx", "ny", "x", "y")
    likely = stage(sketched.mapInArrow(_close(threshold), "a long, b long"), "set-stars")
    links = confirmed(likely, "set-links")
    # Texts of one document are linked by it.
    mine = named.join(classes.select(F.col("key").alias("k"), F.col("c").alias("at")), F.col("key") == F.col("k")).groupBy("doc_id").agg(F.min("at").alias("a"), F.max("at").alias("z")).where("a <> z")
    if not mine.isEmpty():
        each = named.join(classes.select(F.col("key").alias("k"), F.col("c").alias("b")), F.col("key") == F.col("k")).select(F.col("doc_id").alias("id"), "b")
        links = stage(links.unionByName(mine.select("doc_id", "a").join(each, F.col("doc_id") == F.col("id")).where("a <> b").select("a", "b").distinct()), "set-links")
    joined = components(links)

    # What signatures of other components are left to look at.
    for whole in (False, True):
        now = joined.select(F.col("id").alias("j"), F.col("component").alias("root"))
        at = shared.join(now.hint("merge"), F.col("c") == F.col("j"), "left").select("bucket", "c", "place", F.coalesce("root", "c").alias("component"))
        at = stage(at, "signatures-now")
        apart = at.groupBy(F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("all"), F.count_if(~short).alias("full"), F.count_if(short).alias("less"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").drop("low", "high")
        mixed = stage(at.join(apart.hint("merge"), F.col("bucket") == F.col("b")).join(of("", "spare:spare").hint("merge"), F.col("c") == F.col("u")).select("bucket", "c", "place", "component", "spare", "all", "full", "less"), "signatures-apart")
        looks = stage(allocated(mixed), "allocation")
        if looks.isEmpty():
            break
        # a segment of value 1 is looked up whole, one of value 2 also without a shingle
        chosen = looks.select(F.col("c").alias("l"), "segment", "value")
        probes = mixed.where(F.col("place") % 4 < 2).join(chosen.hint("merge"), (F.col("c") == F.col("l")) & (F.expr("place div 4") == F.col("segment"))).where(~short | (F.col("value") == 2)).select(F.col("bucket").alias("pb"), F.col("c").alias("pc"))
        probes = stage(probes.distinct(), "probes")
        there = mixed.join(probes.select("pb").distinct().hint("merge"), F.col("bucket") == F.col("pb"), "left_semi").select("bucket", "c", "component", "all").distinct()
        there = there.join(probes.withColumn("looks", F.lit(True)).hint("merge"), (F.col("bucket") == F.col("pb")) & (F.col("c") == F.col("pc")), "left").select("bucket", "c", "component", "all", F.coalesce("looks", F.lit(False)).alias("looks"))
        there = there.join(of("", "n:n", "sketch:sketch").hint("merge"), F.col("c") == F.col("u")).select("bucket", "c", "component", "all", "looks", "n", "sketch")
        met = stage(_tiles(there).mapInArrow(_met(threshold, whole), "a long, b long").distinct(), "set-pairs")
        if met.isEmpty():
            break
        links = links.unionByName(confirmed(met, "more-set-links"))
        joined = components(links)

    of_class = classes.select(F.col("key").alias("class_key"), F.col("c").alias("class"))
    roots = joined.select(F.col("id").alias("member"), "component")
    each = found.select("doc_id", "n", "key").join(of_class, F.col("key") == F.col("class_key"), "left").join(roots, F.col("class") == F.col("member"), "left").select("doc_id", "n", F.coalesce("component", "class").alias("root"))
    each = stage(each, "set-rows")
    least = each.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("least"))
    out = each.join(least.hint("merge"), F.col("root") == F.col("r"), "left").select("doc_id", "n", F.coalesce("least", "doc_id").alias("least"))
    return out.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("least").alias("component_id"))
