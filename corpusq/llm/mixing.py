"""Mixing sources to target weights.

Documents are laid end to end within their source and packed into blocks of `block_words` words. The mix is a sequence
of slots, dealt to output shards of `shard_slots` slots. The counts of slots that each source gets in each shard are
multinomial draws given their corpus-wide totals, which are the targets: slot g takes the point that a pseudorandom permutation
of all slots gives it and looks it up in the sources' cumulative counts. A source's k-th slot is mapped through its own
pseudorandom permutation of its blocks (a new one in each pass over the source), and slots join blocks by
(source, block). The last slot of a source is cut to the words that its target still lacks.

packed() has the mix as places: of every slot, the stretches of documents in it. shards() has it as text. mix() adds the
stretches up by document.

Main path: DataFrame functions only. Nothing is ordered or summed in one task but tables with a row per source
(or source and bucket; a bucket holds about BUCKET_ROWS documents): running totals over documents are taken in two steps.

Defined cases: null text or no words has size 0 and is never taken; null source is a source of its own, last; repeated
rows (also with the same doc_id, or none) are documents of their own; a very long text is laid over as many blocks as it takes;
where sizes tie, the order is by id and hash of the text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: Documents of a bucket, about: those of a source are put in order within buckets, each by itself.
BUCKET_ROWS = 16_384
LEAST_BUCKETS = 64
#: Rounds of the swap-or-not permutation.
ROUNDS = 24
MOST = 3
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
#: Slots that a task makes, about.
TASK_SLOTS = 16_384
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *keys: Column, back: bool = False) -> Column:
    """Where a pseudorandom permutation of 0 .. n-1, one for each value of the keys, takes x: in each round x and its
    mirror image about a random point swap or stay, as a hash of the larger of both says. back: the inverse."""
    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))])

    def one(at, i):
        other = F.pmod(F.pmod(F.xxhash64(*keys, i), n) - at, n)
        return F.when(F.xxhash64(*keys, i, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), one)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, rank, source_size, target): sources by code point, null last, share the total
    by repeating weights; none gets over `most` times its size, and what is over is shared by weight again."""
    by_name = W.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    # The share a source of weight w gets is level * w, and it is capped if that exceeds its cap; by cap / w ascending,
    # the level is known once all before are capped.
    by_cap = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", w)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))))
        .withColumn("free", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)["level"])
        .select("source", "rank", "source_size", F.when(F.col("free").isNull() | (F.col("ratio") <= F.col("free")), F.col("cap")).otherwise(F.col("free") * F.col("weight")).alias("target"))
    )


def placed(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc, rank, size) with each document's place `first` in the run of its source's words. Order within a source is
    pseudorandom: by bucket, then id. Only (source, bucket) totals cross buckets."""
    with_bucket = docs.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)))
    before = F.sum("words").over(W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = with_bucket.groupBy("rank", "bucket").agg(F.sum("size").alias("words")).select("rank", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("size").over(W.partitionBy("rank", "bucket").orderBy("doc").rowsBetween(W.unboundedPreceding, -1))
    return with_bucket.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["rank", "bucket"]).select("doc", "rank", "size", (F.col("start") + F.col("inside")).alias("first"))


def slots(sources: DataFrame, block_words: int, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """One row per slot of the mix: (shard, slot, rank, k, pass, block, cut), the k-th slot of the source. cut: words used of
    the block, null for all. `sources` has a row per source; slots are made in as many tasks as their number asks for."""
    last_block = F.col("blocks") - 1
    s = (
        sources.where("source_size > 0 and target > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words))
        .withColumn("short", F.col("blocks") * block_words - F.col("source_size"))
        .withColumn("want", F.round("target").cast("long"))
        .withColumn("passes", F.floor(F.col("want") / F.col("source_size")))
        .withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size"))
        # the short last block may come among the slots of the last, partial pass
        .withColumn("short_at", permuted(last_block, F.col("blocks"), F.lit(seed), F.col("rank"), F.col("passes"), back=True))
        .withColumn("full", F.ceil(F.col("rest") / block_words))
        .withColumn("part", F.when(F.col("short_at") < F.col("full"), F.least(F.col("blocks"), F.ceil((F.col("rest") + F.col("short")) / block_words))).otherwise(F.col("full")))
        .withColumn("n_slots", F.col("passes") * F.col("blocks") + F.col("part"))
        .withColumn("cut", F.when(F.col("rest") > 0, F.col("rest") - (F.col("part") - 1) * block_words + F.when(F.col("short_at") < F.col("part") - 1, F.col("short")).otherwise(0)))
        .withColumn("last", F.sum("n_slots").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("all_slots", F.sum("n_slots").over(W.partitionBy()))
        .select("rank", "blocks", "n_slots", (F.col("last") - F.col("n_slots")).alias("start"), "all_slots", "cut")
    )
    s = stage(s, "mix-plan")
    tasks = max(1, -(-(s.agg(F.max("all_slots")).first()[0] or 0) // TASK_SLOTS))
    # A source's slots are made in runs of at most shard_slots, so that no row grows with the source.
    runs = s.withColumn("run", F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {shard_slots})")))
    each = runs.repartition(tasks, "rank", "run").withColumn("k", F.explode(F.expr(f"sequence(run * {shard_slots}, least(n_slots, (run + 1) * {shard_slots}) - 1)")))
    slot = permuted(F.col("start") + F.col("k"), F.col("all_slots"), F.lit(seed), F.lit("slots"))
    turn = F.floor(F.col("k") / F.col("blocks"))
    return each.select("rank", F.col("k"), slot.alias("slot"), turn.alias("pass"), permuted(F.col("k") - turn * F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("rank"), turn).alias("block"), F.when(F.col("k") == F.col("n_slots") - 1, F.col("cut")).alias("cut")).withColumn("shard", F.floor(F.col("slot") / shard_slots))


def _sized(docs: DataFrame, weights, most: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, size, doc, rank, source_size, target) of every row, the sources, and the number of buckets. `doc` tells
    rows apart: those alike in id, source and text get a number each."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    counted = sized.groupBy("doc_id", "source", "size", "hash").agg(F.count(F.lit(1)).alias("rows"))
    sized = stage(counted.select("doc_id", "source", "size", "hash", F.explode(F.expr("sequence(1L, rows)")).alias("copy")), "mix-sizes")
    sources = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-sources")
    ranked = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", "size", "hash", "copy", F.struct("doc_id", "copy", "size", "hash").alias("doc"), "rank", F.col("source_size").cast("long").alias("source_size"), "target")
    return ranked, sources, max(LEAST_BUCKETS, sized.count() // BUCKET_ROWS)


def _pieces(ranked: DataFrame, buckets: int, block_words: int) -> DataFrame:
    """(doc, rank, block, a, z, from): the stretches of documents in blocks, from a to z in the block, and where in the
    document they begin."""
    b = F.lit(block_words)
    return (
        placed(ranked.where("size > 0").select("doc", "rank", "size"), buckets)
        .withColumn("block", F.explode(F.expr(f"sequence(first div {block_words}, (first + size - 1) div {block_words})")))
        .select("doc", "rank", "block", F.greatest(F.col("first") - F.col("block") * b, F.lit(0)).alias("a"), F.least(F.col("first") + F.col("size") - F.col("block") * b, b).alias("z"), F.greatest(F.col("block") * b - F.col("first"), F.lit(0)).alias("from"))
    )


def _in_slots(pieces: DataFrame, drawn: DataFrame) -> DataFrame:
    """Pieces with the slots that take their block, and how many words of the piece each takes."""
    words = F.greatest(F.least(F.col("z"), F.coalesce(F.col("cut"), F.col("z"))) - F.col("a"), F.lit(0))
    # Spark takes `drawn` for as small as the table of sources that it is made from, and would broadcast it.
    return pieces.join(drawn.hint("merge"), ["rank", "block"]).withColumn("words", words).where("words > 0")


def packed(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, most: int = MOST, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as places: shard, slot, rank (of the source), block, doc_id, row, at (in the slot), from (in the document), words."""
    ranked, sources, buckets = _sized(docs, weights, most)
    found = _in_slots(_pieces(ranked, buckets, block_words), slots(sources, block_words, shard_slots, seed))
    return found.select("shard", "slot", "rank", "block", F.col("doc.doc_id").alias("doc_id"), F.col("doc.copy").alias("row"), F.col("a").alias("at"), "from", "words")


def shards(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, most: int = MOST, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself, a row for each slot: shard, slot, source, words and text, words with a space between."""
    ranked, sources, buckets = _sized(docs, weights, most)
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").dropDuplicates(["doc_id", "hash"]).select(F.col("doc_id").alias("t"), F.col("hash").alias("h"), F.regexp_extract_all("text", F.lit(WORD), 0).alias("w"))
    of_doc = _pieces(ranked, buckets, block_words).groupBy("doc", "rank").agg(F.collect_list(F.struct("block", "a", "z", "from")).alias("stretches"))
    whole = of_doc.join(texts, F.col("doc.doc_id").eqNullSafe(F.col("t")) & (F.col("doc.hash") == F.col("h")))
    cut = F.transform("stretches", lambda p: F.struct(p["block"].alias("block"), p["a"].alias("a"), p["z"].alias("z"), F.slice("w", (p["from"] + 1).cast("int"), (p["z"] - p["a"]).cast("int")).alias("part")))
    pieces = whole.select("rank", F.explode(cut).alias("p")).select("rank", "p.block", "p.a", "p.z", "p.part")
    taken = _in_slots(pieces, slots(sources, block_words, shard_slots, seed)).withColumn("part", F.slice("part", 1, F.col("words").cast("int")))
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "part"))), lambda p: p["part"])), " ")
    out = taken.groupBy("shard", "slot", "rank").agg(F.sum("words").alias("words"), text.alias("text"))
    return out.join(sources.select("rank", "source"), "rank").select("shard", "slot", "source", "words", "text")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, most: int = MOST, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(doc_id, text, source) to one row per document: doc_id, size, source_size, target, taken, the number of slots that
    take of it, the first and last shard, and `row`, which tells rows of one id and text apart."""
    ranked, sources, buckets = _sized(docs, weights, most)
    found = _in_slots(_pieces(ranked, buckets, block_words), slots(sources, block_words, shard_slots, seed))
    taken = found.groupBy("doc", "rank").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("slots"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    return ranked.join(taken, ["doc", "rank"], "left").select("doc_id", F.col("copy").alias("row"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), "first_shard", "last_shard")


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, most: int = MOST, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The documents as the mix takes them, with their columns: for each pass over a source a row for each document that slots
    take of. A document that is taken whole keeps its text; of others there are the words of the stretches that are taken, in their
    order, with a space between (and n_chars, if there is such a column, is their length). So a source has the words of its target
    to within one. Of rows alike in id, source and text, the other columns are those of one."""
    key = "_mix"
    while any(c.startswith(key) for c in docs.columns):
        key += "_"
    ranked, sources, buckets = _sized(docs, weights, most)
    found = _in_slots(_pieces(ranked, buckets, block_words), slots(sources, block_words, shard_slots, seed))
    takes = found.groupBy("doc", "rank", "pass").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("from", "words"))).alias("stretches"))
    takes = takes.join(sources.select("rank", "source"), "rank").select(F.col("doc.doc_id").alias(key + "id"), F.col("doc.hash").alias(key + "hash"), F.col("source").alias(key + "source"), (F.col("taken") == F.col("doc.size")).alias(key + "whole"), F.col("stretches").alias(key + "stretches"))
    each = docs.withColumn(key + "h", F.xxhash64("text"))
    if not ranked.where("copy > 1").isEmpty():
        each = each.dropDuplicates(["doc_id", "source", key + "h"])
    same = F.col("doc_id").eqNullSafe(F.col(key + "id")) & (F.col(key + "h") == F.col(key + "hash")) & F.col("source").eqNullSafe(F.col(key + "source"))
    joined = each.join(stage(takes, "mix-takes").hint("merge"), same)
    # the words of a text, found once for all stretches of it
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), 0))
    part = F.transform(words, lambda w: F.array_join(F.flatten(F.transform(key + "stretches", lambda x: F.slice(w, (x["from"] + 1).cast("int"), x["words"].cast("int")))), " "))[0]
    out = joined.withColumn("text", F.when(F.col(key + "whole"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(key + "whole"), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
