"""Reading and writing the engine's tables: build sets, replace-by-book, resumption, checkpoints, fingerprints, exports."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that setCheckpointDir was given. Where both are unset, a local session
    (tests) gets a new one; on a cluster that is an error, since executors could not see it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package (on a cluster, ship it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusq/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder, read again: an iteration's lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_columns(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S1, S8. The table's columns of that schema; those it lacks are null, and a table that is not there is empty."""
    from pyspark.errors import AnalysisException

    want = spark.createDataFrame([], schema).schema
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], want)
    return found.select(*[F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields])


def build_set(pages: DataFrame, indexed: DataFrame | None, books: list[str] | None = None, new_only: bool = False) -> tuple[DataFrame, str]:
    """S2. The pages to index and how: named books are appended; new ones, those not indexed yet; else all, anew."""
    if books:
        return pages.where(F.col("book").isin(books)), "append"
    if new_only and indexed is not None:
        return pages.join(indexed.select("book").distinct(), "book", "left_anti"), "append"
    return pages, "overwrite"


def write_books(rows: DataFrame, path: str, mode: str = "append", files_per_book: int = 1) -> None:
    """S3, S4, S5. Overwrite the table, or replace only the books that rows hold: partitions by book, written anew, so a
    second run changes nothing. Each book's partition is compact."""
    out = rows.repartition("book") if files_per_book == 1 else rows.repartition(F.col("book"), F.pmod(F.xxhash64(*rows.columns), F.lit(files_per_book)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "static" if mode == "overwrite" else "dynamic").partitionBy("book").parquet(path)


def figure_rows(pages: DataFrame) -> DataFrame:
    """S5, S7. One row a plate of pages.figures (figure_path, caption), id by book and the path's stem."""
    f = pages.select("book", "page", F.posexplode("figures").alias("ord", "f")).select("book", "page", "ord", F.col("f.figure_path").alias("figure_path"), F.col("f.caption").alias("caption"))
    return f.withColumn("id", F.concat_ws("::", "book", F.regexp_extract("figure_path", r"([^/]+?)(\.[^./]*)?$", 1)))


def distinct_figures(chunks: DataFrame) -> DataFrame:
    """S7. Each figure path once, where it comes first."""
    return chunks.where("figure_path is not null").groupBy("book", "figure_path").agg(F.min(F.struct("page", "i")).alias("at")).select("book", "figure_path", "at.page")


def write_cards(cards: DataFrame, path: str, files: int = 1) -> None:
    """S6. The cards table (id, deck, question, answer, text, images, tags), written anew each time; a card without text is
    left out. Ids are deck and a hash of the question, so the same card keeps its id."""
    text = F.concat_ws("\n", F.nullif(T.trimmed("question"), F.lit("")), F.nullif(T.trimmed("answer"), F.lit("")))
    rows = cards.withColumn("text", text).where(F.col("text") != "").withColumn("id", F.concat_ws("::", "deck", F.left(F.sha1(F.coalesce("question", F.lit("")).cast("binary")), F.lit(16))))
    rows.select("id", "deck", "question", "answer", "text", "images", "tags").repartition(files, "id").write.mode("overwrite").parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S9. JSON lines; a torn line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def undone(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """S10. What is not done yet."""
    return items.join(done.select(key), key, "left_anti")


def id_range(manifest: DataFrame, start, end, key: str = "id", order: str = "ord") -> DataFrame:
    """S11. The enabled items from one id to another, both included, in the manifest's order; an unknown id is an error."""
    unknown = F.raise_error(F.lit("unknown id")).cast(manifest.schema[order].dataType)
    at = manifest.agg(*[F.max(F.when(F.col(key) == x, F.col(order))).alias(n) for n, x in (("a", start), ("z", end))])
    at = at.select(F.coalesce("a", unknown).alias("a"), F.coalesce("z", unknown).alias("z"))
    return manifest.where("enabled").crossJoin(at).where((F.col(order) >= F.col("a")) & (F.col(order) <= F.col("z"))).drop("a", "z")


def captions_applied(figures: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """S12. (id, line, caption): the last caption of an id that is not blank holds; without one the figure keeps its own."""
    last = checkpoint.where(T.trimmed(F.coalesce("caption", F.lit(""))) != "").groupBy(F.col("id").alias("c_id")).agg(F.max_by("caption", "line").alias("new"))
    out = figures.join(last, F.col("id") == F.col("c_id"), "left")
    return out.withColumn("status", F.when(F.col("new").isNotNull(), "captioned").otherwise("kept")).withColumn("caption", F.coalesce("new", "caption")).drop("c_id", "new")


def caption_candidates(figures: DataFrame, assets: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """S13. Figures whose asset exists and whose book's name has an included and no excluded part."""
    any_of = lambda terms: F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower("book"), t))
    out = figures.join(assets.select("figure_path"), "figure_path", "left_semi")
    out = out.where(any_of(include)) if include else out
    return out.where(~any_of(exclude)) if exclude else out


def works_merged(existing: DataFrame, incoming: DataFrame, key: str = "work_id") -> DataFrame:
    """S14. Incoming works replace those with their id."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def passages_of(works: DataFrame) -> DataFrame:
    """S14. (work_id, parts) to passages, numbered from 0, id work-number."""
    return works.select("work_id", F.posexplode("parts").alias("sequence", "content")).withColumn("id", F.concat(F.col("work_id").cast("string"), F.lit("-"), F.col("sequence").cast("string")))


def corpus_built(wanted: DataFrame, have: DataFrame, big: DataFrame, xml: DataFrame, plain: DataFrame) -> DataFrame:
    """S15. Per wanted work its passages from the first source that has it: what exists is left alone, then the large corpus,
    XML, plain text; else it is skipped. The title is its first passage."""
    out = wanted.join(have.select("work_id").withColumn("h", F.lit(True)), "work_id", "left")
    for name, t in (("big", big), ("xml", xml), ("plain", plain)):
        out = out.join(t.select("work_id", F.col("parts").alias(name)), "work_id", "left")
    outcome = F.when(F.col("h"), "have").when(F.col("big").isNotNull(), "copied").when(F.col("xml").isNotNull(), "xml").when(F.col("plain").isNotNull(), "plain").otherwise("skipped")
    parts = F.concat(F.array("title"), F.coalesce("big", "xml", "plain"))
    return out.select("work_id", outcome.alias("outcome"), F.when(outcome.isin("copied", "xml", "plain"), parts).alias("parts"))


def have_list(spark: SparkSession, path: str) -> DataFrame:
    """S16. A CSV list with a header; years and chapters that are no numbers are null, a chapter also from its folder's name."""
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumn("year", F.expr("try_cast(year as int)")).withColumn("chapter", F.coalesce(F.expr("try_cast(chapter as int)"), F.expr("try_cast(nullif(regexp_extract(folder, '(?i)ch([0-9]+)_', 1), '') as int)")))


def cached(queries: DataFrame, cache: DataFrame, now: Column, ttl: int) -> tuple[DataFrame, DataFrame]:
    """S17. Queries whose result is in the cache and not older than ttl seconds (an empty result counts), and the rest."""
    keyed = queries.withColumn("key", F.sha2(F.col("query"), 256))
    fresh = cache.where(now - F.col("ts") <= ttl).groupBy("key").agg(F.max_by("result", "ts").alias("result"))
    return keyed.join(fresh, "key"), keyed.join(fresh, "key", "left_anti")


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    """One row: number of rows, and a hash of the sorted keys. Keys are dealt to buckets by hash, as many as the rows ask for;
    a bucket's keys are sorted and hashed, then the buckets' hashes in order, in groups of up to 4 096, and the groups'."""
    digits = lambda n: F.substring(F.md5(F.col("k").cast("binary")), 1, n)
    deep = F.concat(digits(3), F.lit("/"), F.substring(F.md5(F.col("k").cast("binary")), 4, 3))
    b = rows.select(F.col(key).cast("string").alias("k")).withColumn("b", deep)
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    each = b.groupBy("b").agg(F.count(F.lit(1)).alias("n"), joined("k").alias("h"))
    ordered = lambda k: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "h"))), lambda x: x["h"]), "\n"), 256)
    groups = each.groupBy(F.substring_index("b", "/", 1).alias("g")).agg(F.sum("n").alias("n"), ordered("b").alias("h"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), ordered("g").alias("hash"))


def digest(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """S18, S19. (key, rows, digest) of rows by key, whatever their order: the four 32-bit parts of each row's 128-bit hash are added
    up, so that a row that is changed, added, removed or repeated changes its key's digest. Digests of parts add up as well."""
    parts = [F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    hashed = rows.select(F.col(key).alias("key"), F.md5(F.concat(*parts).cast("binary")).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(4)]
    return hashed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), *sums).select("key", "rows", F.concat_ws(".", *[f"s{i}" for i in range(4)]).alias("digest"))


def fingerprint(rows: DataFrame, key: str = "id") -> DataFrame:
    """S18. Number of rows, the sorted names of the columns, and a hash of the sorted ids. Buckets are the first six digits of the
    ids' hashes, so nothing larger than a 16-millionth of the ids, or 4 096 hashes, is brought together."""
    return _hashed(rows, key).select("rows", F.lit(",".join(sorted(rows.columns))).alias("schema"), F.col("hash").alias("fingerprint"))


def book_fingerprint(chunks: DataFrame, model: str) -> DataFrame:
    """S19. Books with the digest of their content and their number of chunks, and the model's name, as one hash: it changes if a
    text, a book, the chunks' size or the model does. Books are hashed by bucket, as ids are."""
    books = digest(chunks, "book", "id", "text")
    c = books.select(F.concat_ws(":", "key", "digest", F.col("rows").cast("string")).alias("line"))
    return _hashed(c, "line").select(F.col("rows").alias("books"), F.sha2(F.concat("hash", F.lit("\n" + model)), 256).alias("fingerprint"))


def text_fingerprint(texts: DataFrame, *columns: str) -> DataFrame:
    """S19. A set of texts, as prompts, as one digest, whatever their order: it changes if a text does."""
    return digest(texts.withColumn("_all", F.lit("all")), "_all", *columns).select("rows", F.sha2("digest", 256).alias("fingerprint"))


def exported(runs: DataFrame, column: str, run_id: str) -> DataFrame:
    """S20. One row for each element of a nested column, with its run."""
    return runs.select(F.lit(run_id).alias("run_id"), "question_id", F.posexplode(column).alias("ord", "e")).select("run_id", "question_id", "ord", "e.*")


def rerooted(path, root: str) -> Column:
    """S21. What follows the last folder of that name in a path, below the folder."""
    p = T.col(path)
    return F.when(F.contains(p, F.lit(f"/{root}/")), F.concat(F.lit(root + "/"), F.substring_index(p, f"/{root}/", -1))).otherwise(p)


def media_resolved(cards: DataFrame, media: DataFrame) -> DataFrame:
    """S23. (id, images) with each image's blob by its base name; how many are found and missing, per card."""
    each = cards.select("id", F.posexplode("images").alias("ord", "name")).withColumn("base", F.element_at(F.split("name", "/"), -1))
    found = each.join(media.select(F.col("name").alias("base"), "blob").dropDuplicates(["base"]), "base", "left")
    return found.groupBy("id").agg(F.count("blob").alias("resolved"), F.count_if(F.col("blob").isNull()).alias("missing"), F.countDistinct("blob").alias("blobs"))


def kept_lines(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """S22. Caption lines without those of deleted ids; lines that do not parse stay."""
    parsed = lines.withColumn("_id", F.from_json("line", "id string")["id"])
    return parsed.join(gone.select(F.col("id").alias("_gone")), F.col("_id") == F.col("_gone"), "left_anti").select(*lines.columns)
