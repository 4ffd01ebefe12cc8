"""Language ID by hyperdimensional profiles.

Every letter has a random vector of SIZE entries +1 and -1. A trigram's vector binds those of its letters, each permuted
by its place (rotated two, one and no steps), by multiplying them entry by entry. A text's vector bundles, that is sums,
the vectors of its trigrams, taken within words with one boundary at each end; a language's prototype sums those of its
texts. The prototype with the largest cosine to a text's vector names its language, and that cosine is the score.

Prototypes are sums, so they are learnt from all texts of the learning folds: each task returns a sum per language,
and Spark adds them. They stay in a table, SIZE numbers for each language; PART languages at a time are sent to the tasks,
and a text keeps the best that it has met, so any number of languages does, each PART of them a pass over the texts.

Letters are what Unicode calls letters, lowered; a to z and the accented letters of western Europe have a vector each, and the
other letters share the same vectors by a hash.

Defined cases: null text, and text without a letter, is "und" with score 0, as is any text if nothing was learnt; a
negative cosine counts as 0; ties, also of zeros, go to the first language by code point; repeated documents are judged each by itself;
rows with null lang or null doc_id are not learnt from; a null doc_id counts as held out; a very long text is one bundle, made
in memory of some times its size; the empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, held_out, randoms, stage

SIZE = 1024
#: Languages whose prototypes are sent to the tasks at once.
PART = 4096
UNKNOWN = "und"
_OWN = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
#: Letter vectors, the first for the boundary.
_LETTERS = (np.unpackbits(randoms(64 * SIZE // 64, 31).view(np.uint8)).reshape(64, SIZE).astype(np.int8) * 2 - 1).astype(np.int8)
_PLACED = [np.roll(_LETTERS, k, axis=1) for k in (2, 1, 0)]
#: Texts whose counts stand in one dense matrix.
ROWS = 128
_tables: list[np.ndarray] = []


def letters() -> np.ndarray:
    """The letter number, 1 to 63, of every code point, 0 for what is no letter; built once a worker."""
    if not _tables:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x40, 0x33480):  # no letters are assigned beyond
            if (x := chr(c)).isalpha():
                low = x.lower()[:1]
                out[c] = 1 + (_OWN.index(low) if low in _OWN else ord(low) * 2654435761 % (1 << 32) >> 8) % 63
        _tables.append(out)
    return _tables[0]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram as 18 bits, row) of all trigrams."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    symbol = np.insert(letters()[points], starts, 0)  # a boundary before each row and after the last
    keep = symbol != 0
    keep[1:] |= symbol[:-1] != 0
    keep[starts + np.arange(n + 1)] = True
    row = np.searchsorted(starts + np.arange(n + 1), np.flatnonzero(keep), "right") - 1
    symbol = symbol[keep].astype(np.int64)
    if len(symbol) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = symbol[1:-1] != 0
    code = symbol[:-2] << 12 | symbol[1:-1] << 6 | symbol[2:]
    return code[middle], row[1:-1][middle]


def vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams."""
    return (_PLACED[0][codes >> 12] * _PLACED[1][codes >> 6 & 63] * _PLACED[2][codes & 63]).astype(np.float32)


def bundles(data: np.ndarray, offsets: np.ndarray):
    """(first row, vectors of the rows from there on), ROWS at a time."""
    code, row = trigrams(data, offsets)
    present = np.flatnonzero(np.bincount(code, minlength=1 << 18))
    column = np.zeros(1 << 18, np.int64)
    column[present] = np.arange(len(present))
    bound = vectors(present)
    cuts = np.searchsorted(row, np.arange(0, len(offsets) - 1 + ROWS, ROWS))
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = min(ROWS, len(offsets) - 1 - k * ROWS)
        counts = np.bincount((row[a:z] - k * ROWS) * len(present) + column[code[a:z]], minlength=m * len(present)).reshape(m, len(present)) if len(present) else np.zeros((m, 0))
        yield k * ROWS, counts.astype(np.float32) @ bound


def learn(docs: DataFrame) -> DataFrame:
    """The prototypes (lang, i, x), SIZE rows a language, from (text, lang). Written."""

    def run(frames):
        sums: dict[str, np.ndarray] = {}
        for batch, data, offsets in batches(frames):
            langs = np.array(batch.column("lang").to_pylist(), object)
            code, row = trigrams(data, offsets)
            for lang in set(langs):
                of = (langs == lang)[row]
                count = np.bincount(code[of], minlength=1 << 18)
                own = np.flatnonzero(count)
                part = np.zeros(SIZE)
                for i in range(0, len(own), 4096):
                    part += count[own[i : i + 4096]].astype(np.float64) @ vectors(own[i : i + 4096]).astype(np.float64)
                sums[lang] = sums.get(lang, 0) + part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype(np.int64) for x in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])

    parts = docs.select("lang", F.col("text").cast("string").alias("text")).where("lang is not null and text is not null").mapInArrow(run, "lang string, bundle array<long>")
    return stage(parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")), "prototypes")


def _parts(prototypes: DataFrame, part: int):
    """(languages by code point, their prototypes as rows of length 1), so many at a time."""
    names = sorted(r["lang"] for r in prototypes.where("x <> 0").select("lang").distinct().collect())
    for k in range(0, len(names), part):
        own = names[k : k + part]
        out = {name: np.zeros(SIZE) for name in own}
        for r in prototypes.where(F.col("lang").between(own[0], own[-1])).collect():
            if r["lang"] in out:
                out[r["lang"]][r["i"]] = r["x"]
        yield own, np.array([x / np.linalg.norm(x) for x in out.values()])


PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(docs: DataFrame, prototypes: DataFrame, prefix: str = "", column: str = "text", part: int = PART) -> DataFrame:
    """docs with the columns lang_pred and score, each behind the prefix."""
    lang, score = (prefix + f.name for f in PREDICTED)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(prefix + f.name, f.dataType) for f in PREDICTED]])

    def matched(names: list[str], rows: np.ndarray, again: bool):
        held = docs.sparkSession.sparkContext.broadcast((names, rows.T.astype(np.float32)))

        def run(frames):
            known, against = held.value
            for batch, data, offsets in batches(frames, column=column):
                langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                if again:
                    langs, scores = batch.column(lang).to_pylist(), batch.column(score).to_numpy().copy()
                if known:
                    for first, bundle in bundles(data, offsets):
                        length = np.sqrt((bundle.astype(np.float64) ** 2).sum(1))
                        cosine = np.maximum(0, (bundle @ against) / np.maximum(length, 1e-9)[:, None])
                        best = cosine.argmax(1)
                        for i in np.flatnonzero(length > 0):
                            own = min(1.0, float(cosine[i, best[i]]))
                            if langs[first + i] == UNKNOWN or own > scores[first + i]:
                                langs[first + i], scores[first + i] = known[best[i]], own
                kept = [c for c in batch.schema.names if c not in (lang, score)] if again else batch.schema.names
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(langs, pa.string()), pa.array(scores)], [*kept, lang, score])

        return run

    out, again = docs, False
    for names, rows in _parts(prototypes, part):
        out = (stage(out, "languages") if again else out).mapInArrow(matched(names, rows, again), schema)
        again = True
    return out if again else docs.mapInArrow(matched([], np.zeros((0, SIZE)), False), schema)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) to doc_id, held_out, lang_pred, score; learnt from the folds that are not held out."""
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), prototypes)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
