"""R3, R4, R6. A full-text index in segments, of blocks with bounds.

A segment holds the documents of the keys (books) that arrived together; a key that comes again is replaced whole, by the
last segment that names it (see sources.versions, whose parts segments are). Segments have:
docs     each document with its terms, by bucket of its key
blocks   each term's postings in a range of documents, by bucket of the term, with the highest frequency and the least length in it.
         A range holds RANGE documents or so, whatever the term, so a term that all documents have is in many blocks
terms    how many documents have each term. Documents that the segment replaces count as -1, so sums over segments are of what is live
keys     the keys, their number of documents and digest

The parts of the log also note the numbers of documents and words that a segment adds. So a search takes idf and mean length
from sums over segments, which equal those of an index written anew.

A search reads only buckets of asked terms. From the blocks' frequencies and lengths it takes a bound on the score of any
document in a range; the FIRST ranges of the highest bounds are scored, and what the k-th document has there rules out all ranges
whose bound is lower. A range is scored with all of a query's terms, so scores are whole and the top k exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import store
from ..sources.versions import MANY_PARTS, Versions

#: Documents of a range, about; ranges of which four times so many are written by a task; documents to a bucket of terms, and buckets at least.
RANGE, GROUP, BUCKET_DOCUMENTS, LEAST_BUCKETS = 256, 64, 50_000, 8
#: Buckets of keys in a segment.
KEY_BUCKETS = 16
#: Ranges that are scored first.
FIRST = 4
#: What a bound and a rounded sum may differ by.
SLACK = 1e-5
TABLE = "index"


def bucket_of(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """An index as of one version: segments, and the number and mean length of its documents."""

    versions: Versions
    version: int
    parts: list[dict] = field(default_factory=list)

    @property
    def documents(self) -> int:
        return sum(p["documents"] for p in self.parts)

    @property
    def mean(self) -> float:
        return sum(p["words"] for p in self.parts) / self.documents if self.documents else 0.0

    def dataset(self, name: str) -> DataFrame:
        """A dataset of all segments, with their number."""
        read = [self.versions.dataset(p, name).withColumn("seq", F.lit(p["seq"])) for p in self.parts]
        return reduce(DataFrame.unionByName, read)

    def replaced(self) -> DataFrame | None:
        """(id, seq) of documents whose key a later segment names; null if there can be none."""
        if len(self.parts) < 2:
            return None
        held = self.versions.keys(TABLE, self.version).select("key", F.col("seq").alias("live"))
        return self.dataset("docs").select("key", "id", "seq").join(held, "key", "left").where("live is null or live <> seq").select("id", "seq")

    def of_terms(self, name: str, terms: DataFrame) -> DataFrame:
        """A dataset's rows of these terms; only their buckets are read. Their numbers, no more than there are buckets, go through the driver."""
        out = []
        numbered: dict[int, list[int]] = {}
        for p in self.parts:
            if p["buckets"] not in numbered:
                numbered[p["buckets"]] = [r[0] for r in terms.select(bucket_of("term", p["buckets"]).alias("b")).distinct().collect()]
            out.append(self.versions.dataset(p, name).where(F.col("bucket").isin(numbered[p["buckets"]])).drop("bucket").withColumn("seq", F.lit(p["seq"])))
        return reduce(DataFrame.unionByName, out).join(terms.select("term").distinct(), "term", "left_semi")


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    v = Versions(spark, path, "key")
    version = v.latest() if version is None else version
    return Index(v, version, v.entry(version)["tables"].get(TABLE, []))


def _tokens(stop: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z][a-z0-9-]{2,})"))
    return F.filter(found, lambda t: ~t.isin(stop))


def _segment(v: Versions, seq: int, docs: DataFrame, n: int, keys: DataFrame, dead: DataFrame | None) -> dict:
    """Write a segment of n documents (id, key, length, terms). dead: the terms of replaced documents, and their numbers."""
    buckets, ranges = max(LEAST_BUCKETS, n // BUCKET_DOCUMENTS), max(1, n // RANGE)
    part = v.part(seq, buckets=buckets, ranges=ranges)
    at = v.folder(part)
    keys.write.parquet(f"{at}/keys")
    ranged = docs.withColumns({"range": F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"), "kb": bucket_of("key", KEY_BUCKETS)})
    schemas = part["schemas"] = {}  # a dataset without rows has no files to tell it

    def written(rows: DataFrame, name: str, by: str) -> DataFrame:
        rows.write.partitionBy(by).parquet(f"{at}/{name}")
        schemas[name] = rows.schema.jsonValue()
        return v.dataset(part, name)

    ranged = written(ranged.select("id", "key", "length", "terms", "range", "kb"), "docs", "kb")
    # a range's documents move together once, terms as one string each; counting, gathering and writing its blocks needs no other shuffle.
    # A task writes a file a bucket, so tasks are as many as groups of ranges ask for, or as there are cores
    tasks = max(1, ranges // (4 * GROUP), min(ranges // 4, v.spark.sparkContext.defaultParallelism))
    moved = ranged.where("length > 0").select("range", "id", "length", F.array_join("terms", " ").alias("terms")).repartition(tasks, "range")
    tokens = moved.select("range", "id", "length", F.explode(F.split("terms", " ")).alias("term"))
    counted = tokens.groupBy("range", "term", "id", "length").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    blocks = counted.groupBy("range", "term").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"), F.array_sort(F.collect_list(F.struct("id", "tf", "length"))).alias("postings"))
    blocks = blocks.withColumn("bucket", bucket_of("term", buckets))
    blocks = written(blocks.sortWithinPartitions("bucket", "term", "range"), "blocks", "bucket")
    terms = blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    words, documents = ranged.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], n
    if dead is not None:
        gone = dead.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df")).withColumn("bucket", bucket_of("term", buckets))
        terms = terms.unionByName(gone).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
        less = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        documents, words = documents - less[0], words - less[1]
    written(terms.repartition("bucket"), "terms", "bucket")
    return part | {"documents": documents, "words": words}


def append(index: Index, rows: DataFrame, keys: DataFrame, note: dict | None = None, stop: list[str] = T.STOP) -> Index:
    """T2. A segment of rows (id, key, text), for keys (key, rows, digest): each is replaced by what rows hold of it, those with 0 rows
    are removed. The index is current from the log's next file on; a run that is lost before has changed nothing."""
    v, before = index.versions, index.parts
    keys = keys.select("key", "rows", "digest")
    dead = None
    if before:
        held = v.keys(TABLE, index.version).join(keys.select("key"), "key", "left_semi").select(F.col("key").alias("k"), "seq", F.lit(1).alias("one"))
        again = held.agg(F.count("one"), F.collect_set(bucket_of("k", KEY_BUCKETS))).first()
        if again[0]:
            docs = index.dataset("docs").where(F.col("kb").isin(again[1]))
            dead = docs.join(held.withColumnRenamed("seq", "of"), (F.col("key") == F.col("k")) & (F.col("seq") == F.col("of")), "left_semi").select("length", "terms")
    docs = rows.join(keys.where("rows > 0").select("key"), "key", "left_semi").select("id", "key", _tokens(stop).alias("terms")).withColumn("length", F.size("terms"))
    n = docs.select("id").count()
    part = _segment(v, max([p["seq"] for p in before], default=0) + 1, docs, n, keys, dead)
    version = v.commit(index.version, {TABLE: [*before, part]}, note)
    return Index(v, version, [*before, part])


def compact(index: Index, at_least: int = MANY_PARTS) -> Index:
    """Segments as one, from their own terms; texts are not read."""
    if len(index.parts) < at_least:
        return index
    v = index.versions
    docs = v.live(TABLE, "docs", "key", index.version).select("id", "key", "length", "terms")
    part = _segment(v, index.parts[-1]["seq"] + 1, docs, index.documents, v.keys(TABLE, index.version).select("key", "rows", "digest"), None)
    return Index(v, v.commit(index.version, {TABLE: [part]}, {"compacted": len(index.parts)} | v.entry(index.version)["note"]), [part])


def refresh(spark: SparkSession, path: str, digests: DataFrame, rows: Callable[[DataFrame], DataFrame], settings: str = "", stop: list[str] = T.STOP) -> Index:
    """R3. The index below path, brought to the state of its source: digests (key, rows, digest) of all keys there are now. Keys that
    are new or have another digest are indexed from rows(keys), those that have gone are removed; nothing is written if none
    has. An index of other settings (what makes rows of the source, stop words) is written anew."""
    index, want = open_index(spark, path), f"{settings}|{','.join(stop)}"
    v = index.versions
    if index.parts and v.entry(index.version)["note"].get("settings") != want:
        index = Index(v, index.version)
    if not index.parts:
        return append(index, rows(digests.select("key")), digests, {"settings": want}, stop)
    held = v.keys(TABLE, index.version).select(F.col("key").alias("k"), F.col("digest").alias("old"))
    both = digests.join(held, F.col("key") == F.col("k"), "full").where("not (digest <=> old)")
    changed = both.select(F.coalesce("key", "k").alias("key"), F.coalesce("rows", F.lit(0)).alias("rows"), "digest")
    if changed.isEmpty():
        return index
    return compact(append(index, rows(changed.where("rows > 0").select("key")), changed, {"settings": want}, stop))


# --- search -----------------------------------------------------------------------------------------------------------


def _weight(idf: Column, tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean)))


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, term) with df, the number of live documents that have the term; those that none has are left out."""
    df = index.of_terms("terms", terms).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return terms.join(df, "term")


def _without(index: Index, hits: DataFrame) -> DataFrame:
    gone = index.replaced()
    return hits if gone is None else hits.join(gone, ["id", "seq"], "left_anti")


def _asked(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, term, df, idf), staged: what blocks are joined to is then known to be small, and they are not moved for it."""
    idf = F.log(1 + (F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return store.written(frequencies(index, terms).withColumn("idf", idf), "asked")


def bounds(index: Index, terms: DataFrame, k1: float, b: float, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, seq, range, bound, postings): no document of the range scores higher. Reads no postings."""
    asked = _asked(index, terms) if asked is None else asked
    blocks = index.of_terms("blocks", asked).select("term", "seq", "range", "n", "most", "least").join(asked, "term")
    return blocks.groupBy("query_id", "seq", "range").agg(F.sum(_weight(F.col("idf"), F.col("most"), F.col("least"), index.mean, k1, b)).alias("bound"), F.sum("n").alias("postings"))


def _scored(index: Index, asked: DataFrame, k: int, k1: float, b: float, some: DataFrame | None) -> DataFrame:
    """The top k of each query, of some of its ranges or of all. The blocks of a range meet in one task, each once, however many
    queries ask for it; scores are added up there."""
    blocks = index.of_terms("blocks", asked).select("term", "seq", "range", "postings")
    if some is not None:
        blocks = blocks.join(some.groupBy("seq", "range").agg(F.collect_set("query_id").alias("here")), ["seq", "range"])
    else:
        blocks = blocks.repartition("seq", "range")
    blocks = blocks.join(asked, "term")
    if some is not None:
        blocks = blocks.where(F.array_contains("here", F.col("query_id")))
    hits = _without(index, blocks.select("query_id", "seq", "range", "idf", F.explode("postings").alias("p")).select("query_id", "seq", "range", "idf", "p.*"))
    scores = hits.withColumn("w", _weight(F.col("idf"), F.col("tf"), F.col("length"), index.mean, k1, b)).groupBy("seq", "range", "query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return scores.select("query_id", "id", "score").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def needed(index: Index, terms: DataFrame, k: int, k1: float, b: float, first: int = FIRST, asked: DataFrame | None = None) -> DataFrame:
    """The ranges that may hold one of a query's top k, with their postings."""
    asked = _asked(index, terms) if asked is None else asked
    every = bounds(index, terms, k1, b, asked)
    best = every.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "seq", "range"))).where(F.col("place") <= first)
    least = _scored(index, asked, k, k1, b, best).groupBy(F.col("query_id").alias("q")).agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).where(F.col("found") >= k)
    return every.join(least, F.col("query_id") == F.col("q"), "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query_id", "seq", "range", "postings")


def bm25(index: Index, terms: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """R4. The top k documents of each query by BM25, from (query_id, term)."""
    if not index.parts:
        return terms.sparkSession.createDataFrame([], "query_id long, id string, score double, rank int")
    few = sum(p["ranges"] for p in index.parts) <= 2 * FIRST
    asked = _asked(index, terms)
    return _scored(index, asked, k, k1, b, None if few else needed(index, terms, k, k1, b, asked=asked))


def all_terms(index: Index, terms: DataFrame, need: DataFrame) -> DataFrame:
    """R6. (query_id, id, have, score) of documents in ranges that have all of a query's terms; need: (query_id, need)."""
    asked = frequencies(index, terms)
    blocks = index.of_terms("blocks", terms).select("term", "seq", "range", "postings").join(asked, "term")
    full = index.of_terms("blocks", terms).select("term", "seq", "range").join(asked, "term").groupBy("query_id", "seq", "range").agg(F.count(F.lit(1)).alias("here")).join(need, "query_id").where("here = need")
    blocks = blocks.join(full.select("query_id", "seq", "range"), ["query_id", "seq", "range"], "left_semi")
    hits = _without(index, blocks.select("query_id", "seq", F.explode("postings").alias("p")).select("query_id", "seq", "p.*"))
    return hits.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("have"), F.sum("tf").cast("long").alias("score"))
