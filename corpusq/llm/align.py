"""Alignment of two tokenizers over a corpus, by inverted pair bitmaps.

Each text is coded by a byte-level BPE of the tokenizers library (A, given a space and the text) and by a sentencepiece BPE
(B, which adds the space itself). Token bytes of both cover the same bytes; offsets at which a token of each ends cut them into
groups, and a link is a pair of token occurrences whose byte ranges overlap.

1. Postings: a block is a run of documents of one task, of BLOCK_BYTES of text or so and at most 65 536 documents, numbered
   from 0. For every id pair of a block one row holds the documents that link it, as a compressed bitmap (a list of 16-bit numbers or
   plain bits, whichever is shorter), ORed together from the bitmaps of the block's slices of text, and, as bitmaps again,
   the planes of its multiplicity: plane j has the documents in whose number of links less 1 bit j is set.
2. Counts: a pair's documents are the bits of its bitmaps, its links these and 2^j times the bits of plane j, summed over blocks.
   Within an id of B, the pair of most links is best.
3. Scores come back along the postings: each row gets its pair's count, and a block's rows are decoded by themselves
   into sums by document. A block holds what a few megabytes of text do, whatever a pair's share of the corpus.

Neither tokenizer joins anything over a space between two characters that are no white space, so texts are cut there and
each distinct part is coded, checked byte by byte and aligned once in a worker, which then remembers it. Parts are looked up by
themselves, not by hashes.

Defined cases: null and empty texts, and texts whose joined token bytes differ from a space and the text (such as those with U+2581),
have no tokens, zeros, and '' for the digest; strings of special tokens are plain text; rows of one doc_id, or without one, stand each by
itself; pairs of equal counts are all best; a very long text is coded whole, in one block; the empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BATCH_BYTES, slices, stage, strings

#: Bytes of text in a block, about, and documents at most.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 16
#: Distinct parts of texts that a worker remembers, and their bytes; beyond either it forgets them all.
MOST_PARTS, MOST_PART_BYTES = 400_000, 48 << 20
#: A pair is A's id times this and B's id.
PAIR = 1 << 16
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.n, self.data = 0, np.zeros(1024, kind)

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(len(self.data), 2 * len(more)), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Coder:
    """Both tokenizers, and the alignment of every part of a text that it remembers."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_level(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes, self.texts = 0, []
        self.tokens_a, self.tokens_b, self.groups, self.links, self.starts = (_Grown(np.int64) for _ in range(5))
        self.pairs = _Grown(np.uint32)

    def learn(self, parts: list[str]) -> None:
        """Code and align new parts, each after a space. One whose token bytes are not its own gets -1 tokens."""
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        b_ids = self.b.encode(parts, num_threads=1)
        for k, p in enumerate(parts):
            own = (" " + p).encode()
            if b"".join([self.a_bytes[i] for i in a_ids[k]]) != own or b"".join([self.b_bytes[i] for i in b_ids[k]]) != own:
                a_ids[k], b_ids[k] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # tokens of B from the one that holds a token's first byte to the one that holds its last
        low, high = np.searchsorted(b_end, a_end - self.a_size[a], "right"), np.searchsorted(b_end, a_end, "left")
        each = high - low + 1
        ends = np.concatenate([[0], np.cumsum(each)])
        b_of = np.arange(ends[-1]) + np.repeat(low - ends[:-1], each)
        pairs = np.repeat(a, each) * PAIR + b[b_of]
        part_a, part_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        links = ends[part_a[1:]] - ends[part_a[:-1]]
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        cut_a, cut_b = np.searchsorted(a_end, both) + 1, np.searchsorted(b_end, both) + 1  # the tokens up to each group's end
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        from_a, from_b = [0, *cut_a.tolist()], [0, *cut_b.tolist()]
        cut = [",".join(names_a[from_a[g] : from_a[g + 1]]) + "|" + ",".join(names_b[from_b[g] : from_b[g + 1]]) for g in range(len(both))]
        at = np.searchsorted(cut_a, part_a, "right")  # each part's first group
        spans = at.tolist()
        self.texts += [";".join(cut[i:j]).encode() for i, j in zip(spans[:-1], spans[1:], strict=True)]
        bad = n_a == 0
        self.tokens_a.extend(np.where(bad, -1, n_a))
        self.tokens_b.extend(n_b)
        self.groups.extend(np.diff(at))
        self.links.extend(links)
        self.starts.extend(self.pairs.n + ends[part_a[:-1]])
        self.pairs.extend(pairs.astype(np.uint32))
        for p in parts:
            self.known[p] = len(self.known)
            self.bytes += len(p)

    def coded(self, texts: list[str | None], keep: bool = False):
        """For each text n_a, n_b, n_groups, n_links, digest and groups (if kept), and its parts: (places of parts, and
        each text's first)."""
        if len(self.known) > MOST_PARTS or self.bytes > MOST_PART_BYTES:
            self.forget()
        flat, sizes = [], []
        for text in texts:
            own = _CUT.split(text) if text else []
            flat += own
            sizes.append(len(own))
        new = list(dict.fromkeys(p for p in flat if p not in self.known))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        rows = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

        def total(x: _Grown) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x.data[at])])
            return sums[rows[1:]] - sums[rows[:-1]]

        bad = np.concatenate([[0], np.cumsum(self.tokens_a.data[at] < 0)])
        fine = (bad[rows[1:]] == bad[rows[:-1]]) & (np.diff(rows) > 0)
        numbers = [np.where(fine, total(x), 0) for x in (self.tokens_a, self.tokens_b, self.groups, self.links)]
        digests, kept, places = [], [], at.tolist()
        for d in range(len(texts)):
            joined = b";".join([self.texts[i] for i in places[rows[d] : rows[d + 1]]]) if fine[d] else b""
            digests.append(hashlib.sha256(joined).hexdigest() if fine[d] else "")
            if keep:
                kept.append(joined.decode())
        doc = np.repeat(np.arange(len(texts)), np.diff(rows))
        return numbers, digests, kept, at[fine[doc]], doc[fine[doc]]

    def postings(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts by document (numbers below BLOCK_DOCS) to sorted keys of pair and document, and the links of each."""
        key, often = np.unique(doc * (1 << 40) + at, return_counts=True)
        at, doc = key & ((1 << 40) - 1), key >> 40
        each = self.links.data[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        pairs = self.pairs.data[np.arange(ends[-1]) + np.repeat(self.starts.data[at] - ends[:-1], each)]
        key = pairs.astype(np.uint64) * np.uint64(BLOCK_DOCS) + np.repeat(doc, each).astype(np.uint64)
        order = np.argsort(key)
        key, often = key[order], np.repeat(often, each)[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        return key[first], np.add.reduceat(often, first) if len(first) else often


_coders: dict[tuple[str, str], Coder] = {}


def coder(a_path: str, b_path: str) -> Coder:
    if (a_path, b_path) not in _coders:
        _coders[a_path, b_path] = Coder(a_path, b_path)
    return _coders[a_path, b_path]


# --- bitmaps ----------------------------------------------------------------------------------------------------------


def packed(documents: np.ndarray, width: int) -> bytes:
    """Sorted documents below width as a list or as bits, whichever is shorter."""
    if 16 * len(documents) <= width:
        return b"L" + struct.pack("<I", len(documents)) + documents.astype("<u2").tobytes()
    bits = np.zeros(width, np.uint8)
    bits[documents] = 1
    return b"B" + struct.pack("<I", -(-width // 8)) + np.packbits(bits, bitorder="little").tobytes()


def bitmaps(documents: np.ndarray, links: np.ndarray, width: int) -> bytes:
    """The documents of a pair and the planes of their links less one."""
    out, more = [packed(documents, width)], links - 1
    top = int(more.max())
    for j in range(top.bit_length()):
        out.append(packed(documents[more >> j & 1 == 1], width))
    return b"".join(out)


def unpacked(payload: bytes):
    """(documents, weight) of the bitmap and of each plane."""
    at, weight, found = 0, 1, []
    while at < len(payload):
        (size,) = struct.unpack_from("<I", payload, at + 1)
        if payload[at : at + 1] == b"L":
            documents, size = np.frombuffer(payload, "<u2", size, at + 5), 2 * size
        else:
            documents = np.flatnonzero(np.unpackbits(np.frombuffer(payload, np.uint8, size, at + 5), bitorder="little"))
        found.append((documents, weight))
        weight = 1 if len(found) == 1 else weight * 2
        at += 5 + size
    return found


# --- operator -----------------------------------------------------------------------------------------------------------

NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
#: Rows of documents have no pair, those of pairs no place.
POSTINGS = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pair long, docs long, links long, bitmaps binary"


def postings(docs: DataFrame, a_path: str, b_path: str, keep: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text) to a row for each document, with its block and place in it, and a row for each pair of a block.
    keep adds the groups as text. To be written before it is used, since it is read several times."""

    def run(frames):
        own, number, schema = coder(a_path, b_path), TaskContext.get().partitionId() << 32, None
        keys, counts, held, width = [], [], 0, 0

        def rows(n: int, **columns) -> pa.RecordBatch:
            nonlocal schema
            if schema is None:
                kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
                schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in POSTINGS.split(", "))])
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def done():
            """The block's pairs."""
            nonlocal keys, counts, held, width, number
            key, links = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, links = key[order], links[order]
            pair, document = (key // np.uint64(BLOCK_DOCS)).astype(np.int64), (key % np.uint64(BLOCK_DOCS)).astype(np.int64)
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
            last = np.append(first[1:], len(pair))
            for i in range(0, len(first), 10_000):
                a, z = first[i : i + 10_000], last[i : i + 10_000]
                maps = [bitmaps(document[s:e], links[s:e], width) for s, e in zip(a.tolist(), z.tolist(), strict=True)]
                yield rows(len(a), block=np.full(len(a), number), pair=pair[a], docs=z - a, links=np.add.reduceat(links[a[0] : z[-1]], a - a[0]), bitmaps=maps)
            keys, counts, held, width, number = [], [], 0, 0, number + 1

        for batch in frames:
            _, offsets = strings(batch.column("text"))
            for i, j in slices(offsets, BATCH_BYTES):
                for k in range(i, j, BLOCK_DOCS):
                    part = batch.slice(k, min(j, k + BLOCK_DOCS) - k)
                    if width + part.num_rows > BLOCK_DOCS and keys:
                        yield from done()
                    numbers, digests, kept, at, doc = own.coded(part.column("text").to_pylist(), keep)
                    key, links = own.postings(at, doc + width)
                    more = {"groups": kept} if keep else {}
                    yield rows(part.num_rows, block=np.full(part.num_rows, number), place=np.arange(width, width + part.num_rows), doc_id=part.column("doc_id"), groups_sha256=digests, **dict(zip(NUMBERS, numbers, strict=True)), **more)
                    keys.append(key)
                    counts.append(links)
                    width += part.num_rows
                held += int(offsets[j] - offsets[i])
                if held >= block_bytes:
                    yield from done()
        if keys:
            yield from done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, POSTINGS)


def pair_counts(found: DataFrame) -> DataFrame:
    """Written postings to a row for each id pair: pair, a, b, docs, links, and best: no pair of its b has more links."""
    counts = found.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    counts = counts.withColumns({"a": F.expr(f"pair div {PAIR}"), "b": F.col("pair") % PAIR})
    # an id of B has as many pairs as A has ids, at most
    return counts.withColumn("best", F.col("links") == F.max("links").over(W.partitionBy("b")))


def _returned(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """A block's pairs, with their counts, to sums by document."""
    found = [(documents, weight, k) for k, payload in enumerate(frame["bitmaps"]) for documents, weight in unpacked(payload)]
    place = np.concatenate([x[0] for x in found]).astype(np.int64)
    sizes = np.fromiter((len(x[0]) for x in found), np.int64, len(found))
    weight, row = np.fromiter((x[1] for x in found), np.int64, len(found)), np.fromiter((x[2] for x in found), np.int64, len(found))
    best, total = np.zeros(place.max() + 1, np.int64), np.zeros(place.max() + 1, np.int64)
    np.add.at(best, place, np.repeat(weight * frame["best"].to_numpy(bool)[row], sizes))
    np.add.at(total, place, np.repeat(weight * frame["count"].to_numpy(np.int64)[row], sizes))
    some = np.unique(place)
    return pd.DataFrame({"in_block": key[0], "at": some.astype(np.int32), "n_best": best[some], "count_sum": total[some]})


def aligned(docs: DataFrame, a_path: str, b_path: str, keep: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text) to a row for each: doc_id, n_a, n_b, n_groups, n_links, n_best (links of best pairs), count_sum (the links
    of its links' pairs in the whole corpus, summed), groups_sha256, and the groups themselves if kept."""
    found = stage(postings(docs, a_path, b_path, keep, block_bytes), "alignment")
    scores = pair_counts(found).select(F.col("pair").alias("of"), F.col("links").alias("count"), "best")
    scored = found.where("pair is not null").select("block", "pair", "bitmaps").join(scores, F.col("pair") == F.col("of")).select("block", "bitmaps", "count", "best")
    back = scored.groupBy("block").applyInPandas(_returned, "in_block long, at int, n_best long, count_sum long")
    each = found.where("pair is null").join(back, (F.col("block") == F.col("in_block")) & (F.col("place") == F.col("at")), "left")
    zero = F.lit(0).cast("long")
    return each.select("doc_id", *NUMBERS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *(["groups"] if keep else []))
