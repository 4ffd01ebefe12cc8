"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of all ids; its continuation bitmap has a
1 for each id that has a further chunk, which stands in level 1 at the rank of that 1, and so on. A rank directory holds
the number of 1s before each stretch of 512 bits. So any token is found by a few lookups, and no block is decoded.

One segment is such a code with its documents' ids and ends, as bytes in the column `payload`; its header has the number of
ids before it in its shard. Segments are written by Spark, as rows of a Parquet table in the shared folder (any store that
Spark can write, files that appear only when a task has committed), without compression, so that a payload is read as it
stands; shards hold ranges of doc_id in ascending order, as many as the bytes of the texts ask for. A second table, the
directory, has a row for each segment: its shard, number, first and last doc_id, and the ids before it in all shards.
token() and document() go from a doc_id to its segment by the directory, and to a place in it by rank.

Segment format, little-endian: magic "DAC2"; u8 levels; u64 ids before it in the shard, u32 documents, u32 of these without
an id (which come first), u64 ids; i64 id of each document (0 for none); u64 end (exclusive) of each document; for each level:
u64 number of chunks, the chunks, and but for the last level the bitmap as u64 words and the directory as u32 (one for each
8 words).

Defined cases: null and empty texts have the end id alone; repeated ids stand one after the other, by a hash of the text, and
so may be in several shards; a null doc_id comes first; a very long text is encoded whole and is in one segment; the empty
table writes no segment; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BATCH_BYTES, new_path, same_runs, slices, strings, words

END_ID = 0
#: Ids in a segment, as near as whole documents allow.
SEGMENT_IDS = 1 << 18
#: Bytes of text in a shard, about.
SHARD_BYTES = 16 << 20
#: Distinct parts of texts whose ids a worker remembers, at about 40 bytes each.
MOST_PIECES = 1_500_000
#: Bytes of such parts, beyond which a worker forgets them all.
MOST_PIECE_BYTES = 64 << 20


# --- directly addressable codes -----------------------------------------------------------------------------------------


def pack(ids: np.ndarray, ends: np.ndarray, before: int, doc_ids: list) -> bytes:
    """One segment: ids as unsigned 32-bit numbers, the end of each document, the ids before it in the shard, and the documents'
    ids, nulls first."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 256
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    out = [b"DAC2", struct.pack("<BQIIQ", len(levels), before, len(ends), sum(x is None for x in doc_ids), len(ids)), names.tobytes(), ends.astype("<u8").tobytes()]
    for k, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if k < len(levels) - 1:
            bits = np.zeros(-(-len(more) // 64) * 64, np.uint8)
            bits[: len(more)] = more
            packed = np.packbits(bits, bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int64)
            before_word = np.cumsum(ones) - ones
            out += [packed.tobytes(), before_word[::8].astype("<u4").tobytes()]
    return b"".join(out)


class Segment:
    """Reads a segment's tokens by their place."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC2":
            raise ValueError("not a segment")
        n_levels, self.before, n_docs, self.unnamed, self.n = struct.unpack_from("<BQIIQ", payload, 4)
        at = 29
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        at += 8 * n_docs
        self.ends = np.frombuffer(payload, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunk = np.frombuffer(payload, np.uint8, n, at + 8)
            at += 8 + n
            bits = rank = None
            if k < n_levels - 1:
                n_words = -(-n // 64)
                bits = np.frombuffer(payload, "<u8", n_words, at)
                at += 8 * n_words
                rank = np.frombuffer(payload, "<u4", -(-n_words // 8), at)
                at += 4 * len(rank)
            self.levels.append((chunk, bits, rank))

    def token(self, i: int) -> int:
        """The i-th id of the segment."""
        value = 0
        for k, (chunk, bits, rank) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if bits is None or not int(bits[i // 64]) >> i % 64 & 1:
                return value
            word = i // 64
            ones = int(rank[word // 8]) + int(np.bitwise_count(bits[word // 8 * 8 : word]).sum())
            i = ones + (int(bits[word]) & ((1 << i % 64) - 1)).bit_count()
        return value

    def tokens(self, a: int, z: int) -> np.ndarray:
        """The ids from place a to z: each level's run starts at a rank."""
        parts = []
        for chunk, bits, rank in self.levels:
            if bits is None:
                parts.append((chunk[a:z], None))
                break
            more = np.unpackbits(bits[a // 64 : -(-z // 64)].view(np.uint8), bitorder="little")[a % 64 : a % 64 + z - a].astype(bool)
            parts.append((chunk[a:z], more))
            word = a // 64
            ones = int(rank[min(word // 8, len(rank) - 1)]) + int(np.bitwise_count(bits[word // 8 * 8 : word]).sum()) if len(rank) else 0
            if a % 64:
                ones += (int(bits[word]) & ((1 << a % 64) - 1)).bit_count()
            a, z = ones, ones + int(more.sum())
        value = np.zeros(0, np.uint32)
        for chunk, more in reversed(parts):
            if more is None:
                value = chunk.astype(np.uint32)
            else:
                low = chunk.astype(np.uint32)
                low[more] |= value << np.uint32(8)
                value = low
        return value

    def start(self, d: int) -> int:
        return int(self.ends[d - 1]) if d else 0

    def document(self, d: int) -> np.ndarray:
        return self.tokens(self.start(d), int(self.ends[d]))

    def find(self, doc_id: int) -> int | None:
        """The place of the first document of that id."""
        named = self.doc_ids[self.unnamed :]
        d = int(np.searchsorted(named, doc_id))
        return self.unnamed + d if d < len(named) and named[d] == doc_id else None


# --- encoding ---------------------------------------------------------------------------------------------------------


class Encoder:
    """A byte-level BPE tokenizer of the tokenizers library over many texts.

    Such a tokenizer cuts a text into pieces by a fixed pattern, and codes each by itself. The pattern always cuts before
    a single space, but for one between white space. So a text is split at its spaces, and each distinct part (found by
    the hash of its bytes, and if it opens the text, and then compared byte by byte) is coded by the library once, with its
    space, and remembered. A text that has another space, a special token's string, or a part whose hash is that of
    another part, goes to the library whole, and so does every text for another kind of tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        cutter = spec.get("pre_tokenizer") or {}
        self.plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec.get("normalizer")
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        vocabulary = self.whole.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # a space, as such vocabularies write it
        self.forget()

    def forget(self) -> None:
        """The hashes of the parts, sorted, and where the ids of each stand, and how many."""
        self.known, self.table, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The bytes of the parts, and where those of each stand, and how many.
        self.bytes, self.byte_starts, self.byte_sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, parts: list[bytes], head: np.ndarray) -> None:
        coded: list = [None] * len(parts)
        texts = [p.decode() for p in parts]
        alone = np.array([h or _blank(t[0]) or _blank(t[-1]) for h, t in zip(head, texts, strict=True)])
        own, rest = np.flatnonzero(alone), np.flatnonzero(~alone)
        for k, x in zip(own, self.ids([texts[k] if head[k] else " " + texts[k] for k in own]), strict=True):
            coded[k] = x
        # The others are coded as texts of a thousand parts: only a part's first id begins with a space.
        runs = [rest[i : i + 1000] for i in range(0, len(rest), 1000)]
        for run, x in zip(runs, self.ids([" " + " ".join(texts[k] for k in run) for run in runs]), strict=True):
            cuts = np.append(np.flatnonzero(self.spaced[x]), len(x)).tolist()
            for i, k in enumerate(run.tolist()):
                coded[k] = x[cuts[i] : cuts[i + 1]]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.starts = np.insert(self.starts, at, len(self.table) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.table = np.concatenate([self.table, *coded])
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.byte_starts = np.insert(self.byte_starts, at, len(self.bytes) + np.cumsum(lengths) - lengths)
        self.byte_sizes = np.insert(self.byte_sizes, at, lengths)
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(parts), np.uint8)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text; texts as UTF-8 bytes and n + 1 offsets."""
        n = len(offsets) - 1
        if not self.plain:
            return self.ids([data[a:z].tobytes().decode() for a, z in zip(offsets[:-1], offsets[1:], strict=True)])
        hashes, first, last, rows = words(data, offsets, NOT_BLANK, lower=False)
        head = np.isin(first, offsets[:-1])
        hashes = np.where(head, ~hashes, hashes)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        fresh[inside] = self.known[at[inside]] != distinct[inside]
        size = last - first
        # parts like the first of their hash in the batch, and like the one that is remembered
        like = size == size[where][back]
        like[like] = same_runs(data, first[like], data, first[where][back][like], size[like])
        old = np.flatnonzero(~fresh)
        alike = size[where[old]] == self.byte_sizes[at[old]]
        alike[alike] = same_runs(data, first[where[old[alike]]], self.bytes, self.byte_starts[at[old[alike]]], size[where[old[alike]]])
        other = np.zeros(len(distinct), bool)
        other[old[~alike]] = True
        unlike = ~like | other[back]
        if fresh.any():
            if len(self.known) + fresh.sum() > MOST_PIECES or len(self.bytes) > MOST_PIECE_BYTES:
                self.forget()
                fresh[:] = True
            w, raw = where[fresh], data.tobytes()
            self.learn(distinct[fresh], [raw[a:z] for a, z in zip(first[w].tolist(), last[w].tolist(), strict=True)], head[w])
            at = np.searchsorted(self.known, distinct)
        starts, sizes = self.starts[at][back], self.sizes[at][back]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.table[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        out = np.split(flat, ends[rows][1:-1]) if n else []
        whole = self.whole_only(data, offsets)
        whole[np.searchsorted(rows, np.flatnonzero(unlike), "right") - 1] = True
        for k in np.flatnonzero(whole):
            out[k] = self.ids([data[offsets[k] : offsets[k + 1]].tobytes().decode()])[0]
        return out

    def whole_only(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that cannot be split at spaces: with a space after a space, at the end, or between white space (any
        byte that can end or begin such a character counts), or with a special token."""
        found = np.zeros(len(offsets) - 1, bool)
        before, after = np.full(len(data) + 1, 1, np.uint8), np.full(len(data) + 1, 1, np.uint8)
        before[1:], after[:-2] = data, data[1:]
        before[offsets] = 0x61  # nothing stands before a text
        after[offsets[1:] - 1] = 0x20  # nothing after it, which is as bad as a space
        space = np.flatnonzero(data == 0x20)
        b, a = before[space], after[space]
        bad = space[(b == 0x20) | (_ENDS[b] & _BEGINS[a])]
        bad = np.concatenate([bad, offsets[1:][offsets[1:] > offsets[:-1]] - 1])
        bad = bad[data[bad] == 0x20] if len(bad) else bad
        found[np.searchsorted(offsets, bad, "right") - 1] = True
        raw = data.tobytes()
        for token in self.special:
            i = raw.find(token)
            while i >= 0:
                found[np.searchsorted(offsets, i, "right") - 1] = True
                i = raw.find(token, i + 1)
        return found


NOT_BLANK = np.arange(256) != 0x20
#: Bytes that may end white space (control characters, continuation bytes), and that may begin it.
_ENDS = np.isin(np.arange(256), [*range(0x21), 0x7F, *range(0x80, 0xC0)])
_BEGINS = np.isin(np.arange(256), [*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3])


def _blank(c: str) -> bool:
    return c.isspace() or not c.isprintable()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SEGMENTS = "shard int, segment int, first_doc long, last_doc long, documents long, ids long, payload binary"


def encode(docs: DataFrame, tokenizer_path: str, partitions: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """(doc_id, text) to segments: doc_id ranges are shards, in order."""

    def run(frames):
        own, shard, segment, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, size = [], [], 0

        def done():
            nonlocal ids, doc_ids, size, segment, before
            payload = pack(np.concatenate(ids), np.cumsum([len(x) for x in ids]), before, doc_ids)
            values = (shard, segment, doc_ids[0], doc_ids[-1], len(ids), size, payload)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["shard", "segment", "first_doc", "last_doc", "documents", "ids", "payload"])
            ids, doc_ids, segment, before, size = [], [], segment + 1, before + size, 0
            return row

        end = np.array([END_ID], np.uint32)
        for batch in frames:
            names, (data, at) = batch.column("doc_id").to_pylist(), strings(batch.column("text"))
            for i, j in slices(at, BATCH_BYTES):
                for name, x in zip(names[i:j], own.encode(data[at[i] : at[j]], at[i : j + 1] - at[i]), strict=True):
                    ids.append(np.concatenate([x, end]))
                    doc_ids.append(name)
                    size += len(x) + 1
                    if size >= segment_ids:
                        yield done()
        if ids:
            yield done()

    # rows of one id, or of none, are dealt by their texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    return rows.repartitionByRange(partitions, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text").mapInArrow(run, SEGMENTS)


def write(docs: DataFrame, tokenizer_path: str, path: str, partitions: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Segments and their directory, below path."""
    spark = docs.sparkSession
    if not partitions:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        partitions = max(2 * spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    encode(docs, tokenizer_path, partitions, segment_ids).write.option("compression", "none").parquet(f"{path}/segments")
    segments = segments_at(spark, path).drop("payload")
    # one row a shard
    totals = segments.groupBy("shard").agg(F.sum("ids").alias("n"))
    bases = totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ids").over(W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    segments.withColumn("inside", inside).join(bases, "shard").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside").write.parquet(f"{path}/directory")


def segments_at(spark, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments")


def directory_at(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/directory")


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""

    def run(frames):
        for batch in frames:
            for shard, number, payload in zip(batch.column("shard").to_pylist(), batch.column("segment").to_pylist(), batch.column("payload"), strict=True):
                s = Segment(payload.as_buffer())
                starts = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(s.document(d).astype("<u4").tobytes()) for d in range(len(s.ends))]
                names = pa.array(s.doc_ids, mask=np.arange(len(s.ends)) < s.unnamed)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(names), pa.int32()), pa.array([number] * len(names), pa.int32()), names, pa.array(starts), pa.array(s.ends - starts), pa.array(crc, pa.int64())], ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = segments_at(spark, path).select("shard", "segment", "payload").mapInArrow(run, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(directory_at(spark, path).select("shard", "segment", F.col("start").alias("before")), ["shard", "segment"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _segments_of(spark, path: str, doc_id: int):
    for at in directory_at(spark, path).where((F.col("first_doc") <= doc_id) | F.col("first_doc").isNull()).where(F.col("last_doc") >= doc_id).select("shard", "segment").orderBy("shard", "segment").toLocalIterator():
        yield Segment(segments_at(spark, path).where((F.col("shard") == at[0]) & (F.col("segment") == at[1])).first()["payload"])


def token(spark, path: str, doc_id: int, place: int) -> int | None:
    """The id at that place of the (first) document of that id, found without decoding any other; null if there is none."""
    for s in _segments_of(spark, path, doc_id):
        if (d := s.find(doc_id)) is not None:
            at = s.start(d) + place
            return s.token(at) if 0 <= place and at < s.ends[d] else None
    return None


def document(spark, path: str, doc_id: int) -> np.ndarray | None:
    """All ids of the (first) document of that id."""
    for s in _segments_of(spark, path, doc_id):
        if (d := s.find(doc_id)) is not None:
            return s.document(d)
    return None


def write_and_read(docs: DataFrame, tokenizer_path: str, partitions: int | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, path, partitions, segment_ids)
    return read(docs.sparkSession, path)
