"""WARC archives, written and read by Spark.

Writing: a record's head is a column of the head lines, and Spark's text writer ends each row with the blank lines that end
a record. So archives appear as tasks commit, on any store that Spark can write. Records with equal payloads (of at
least `least_bytes` bytes) are stored once: that of the largest page id is a response, the others are revisits of it.

Reading, by boundary-chain verification: Spark's text reader cuts the files, in ranges that tasks read side by side, where
the version line stands, be it a record's or part of some payload. From each such place a task emits a candidate: its
offset, and its successor's offset by its own Content-Length. A candidate is a record if the chain from its file's
start reaches it; pointer jumping finds those in as many rounds as the logarithm of the records of a file. Pieces that
are not reached belong to the payload of the record before them.

Offsets: a task counts bytes from the start of each range that it reads; the totals of a file's ranges are summed up in
order, one row a range.

Defined cases: null html is the empty payload; a null page id is written empty and is the smallest; of rows that are alike
in payload and have the largest id, each is a response; null urls are written empty, line ends in urls percent-coded;
the empty table gives empty archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, stage, strings

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Blocks of a file in which a piece of a payload looks for the record that it is part of.
NEAR = 1 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: eight groups of 20 bits, each five hexadecimal digits and four letters."""
    digest = F.sha1(data)
    group = lambda g: F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
    return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(group(g), shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in range(8) for shift in (15, 10, 5, 0)])


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) to (value): each record's text, without what ends it."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_bytes
    groups = stage(p.where(large).groupBy(F.col("digest").alias("group")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-groups")
    p = p.withColumn("own", F.when(large, F.col("digest"))).join(groups, F.col("own") == F.col("group"), "left")
    revisit = F.col("group").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.octet_length("html")).cast("string")),
    ]
    head = F.concat(F.lit(VERSION), F.concat_ws("\r\n", *lines), F.lit(END))
    return p.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    records(pages, least_bytes).write.option("lineSep", END).text(path)


_PIECE = "file string, block long, nth long, at long, size long, length long, type string, id string, digest string, refers string, url string, own_bytes long, own_digest string"


def _pieces(frames):
    """Of each place where a version line stands: its offset from the start of its range, and what its lines say."""
    file, block, at, nth = None, None, 0, 0
    for batch in frames:
        data, offsets = strings(batch.column("value"))
        raw = data.tobytes()
        out = {k: [] for k in ("file", "block", "nth", "at", "size", "length", "type", "id", "digest", "refers", "url", "own_bytes", "own_digest")}
        for f, b, a, z in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if (f, b) != (file, block):
                file, block, at, nth = f, b, 0, 0
            head_end = raw.find(END.encode(), a, z)
            fields = {}
            if head_end >= 0:
                for line in raw[a:head_end].split(b"\r\n"):
                    name, _, value = line.partition(b":")
                    fields.setdefault(name.strip().lower(), value.strip().decode("utf-8", "replace"))
            length = int(n) if (n := fields.get(b"content-length", "")).isdigit() else None
            body = head_end + len(END) if head_end >= 0 else z
            for k, v in (("file", f), ("block", b), ("nth", nth), ("at", at), ("size", z - a)):
                out[k].append(v)
            known = length is not None and b"warc-type" in fields
            # the head's bytes with the version line, the content, and what ends a record
            out["length"].append(len(VERSION) + body - a + length + len(END) if known else None)
            whole = known and body + length <= z
            content = raw[body : body + length] if whole else None
            for k, v in (("type", b"warc-type"), ("id", b"warc-record-id"), ("digest", b"warc-payload-digest"), ("refers", b"warc-refers-to"), ("url", b"warc-target-uri")):
                out[k].append(fields.get(v) if known else None)
            out["own_bytes"].append(length if whole else None)
            out["own_digest"].append(base64.b32encode(hashlib.sha1(content).digest()).decode() if whole else None)
            at += z - a + len(VERSION)
            nth += 1
        types = {"block": pa.int64(), "nth": pa.int64(), "at": pa.int64(), "size": pa.int64(), "length": pa.int64(), "own_bytes": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.string())) for k, v in out.items()], list(out))


def reachable(links: DataFrame) -> DataFrame:
    """(file, at, next) to the (file, at) that the chain from offset 0 of each file reaches, by pointer jumping: in each
    round all that is reached jumps as far as all rounds before, and every pointer doubles its length. Chains only go
    forward, so no offset is reached twice."""
    jump = stage(links.select("file", "at", "next"), "jumps")
    reached = stage(jump.where("at = 0").select("file", "at"), "reached")
    while not jump.isEmpty():
        # Paths compress so well that Spark takes these tables for small and would broadcast them.
        to = jump.select(F.col("file").alias("f"), F.col("at").alias("a"), F.col("next").alias("then")).hint("merge")
        new = reached.join(to, F.expr("file = f and at = a")).select("file", F.col("then").alias("at"))
        reached = stage(reached.unionByName(new), "reached")
        jump = stage(jump.join(to, F.expr("file = f and next = a")).select("file", "at", F.col("then").alias("next")), "jumps")
    return reached


def _values(frames):
    """The pieces with their range and number."""
    file, block, nth = None, None, 0
    for batch in frames:
        numbers = []
        for f, b in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if (f, b) != (file, block):
                file, block, nth = f, b, 0
            numbers.append(nth)
            nth += 1
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(numbers, pa.int64()), batch.column("value")], ["f", "b", "n", "value"])


def read(spark, path: str) -> DataFrame:
    """Per record: file, at, type, id, url, digest and refers as its head has them, and payload_bytes and payload_digest
    of its content."""
    raw = spark.read.option("lineSep", VERSION).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = stage(raw.mapInArrow(_pieces, _PIECE), "warc-pieces")
    totals = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(VERSION)).alias("bytes"))
    before = F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("file", "block", F.coalesce(before, F.lit(0)).alias("start"))
    # What stands before the first version line of a file is no record.
    at = F.col("start") + F.col("at") - len(VERSION)
    placed = stage(pieces.join(starts, ["file", "block"]).withColumn("at", at).where("at >= 0").drop("start"), "warc-placed")
    found = stage(reachable(placed.where("length is not null").select("file", "at", (F.col("at") + F.col("length")).alias("next"))), "warc-records")
    records = placed.join(found.hint("merge"), ["file", "at"], "left_semi").where("length is not null")
    columns = ["file", "at", "type", "id", "url", "digest", "refers"]
    whole = records.where("own_digest is not null").select(*columns, F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"))
    cut = stage(records.where("own_digest is null").select(*columns, "length"), "warc-cut")
    if cut.isEmpty():
        return whole

    # Contents that hold a version line: their pieces are read again and put together, a record at a time.
    last = F.col("at") + F.col("length")
    spans = cut.select(F.col("file").alias("f"), F.col("at").alias("first"), last.alias("last"), F.explode(F.expr(f"sequence(at div {NEAR}, (at + length) div {NEAR})")).alias("near"))
    wanted = placed.join(spans, F.expr(f"file = f and at div {NEAR} = near and at >= first and at < last")).select("file", "block", "nth", "at", "first")
    read_again = raw.mapInArrow(_values, "f string, b long, n long, value string")
    parts = read_again.join(wanted, F.expr("f = file and b = block and n = nth")).groupBy(F.col("file").alias("f"), "first").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), VERSION)
    head = F.octet_length(F.substring_index(text, END, 1)) + len(END)
    size = (F.col("length") - len(VERSION) - len(END) - head).cast("int")
    content = F.substring(text.cast("binary"), head + 1, size)
    joined = cut.join(parts, F.expr("file = f and at = first")).select(*columns, F.octet_length(content).cast("long").alias("payload_bytes"), base32_sha1(content).alias("payload_digest"))
    return whole.unionByName(joined)


def resolved(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's payload is that of the
    response with its digest."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1) as long)")
    rows = stage(records.select(page("id").alias("page_id"), "type", F.substring_index("digest", ":", -1).alias("digest"), page("refers").alias("refers_to"), "payload_bytes", "payload_digest"), "warc-read")
    responses = rows.where("type = 'response'")
    of = stage(responses.groupBy(F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("bytes")), "warc-responses")
    revisits = rows.where("type = 'revisit'").join(of, F.col("digest") == F.col("of")).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("of").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def written_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least_bytes)
    return resolved(read(spark, path))
