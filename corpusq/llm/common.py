"""What several operators share: the shared folder, written stages, and words as arrays inside tasks."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once. A longer document is taken whole, by itself.
BATCH_BYTES = 1 << 19
#: Size of the batches that Spark hands to a task's Python, so that its memory does not grow with the length of texts.
ARROW_BYTES = "8m"
#: The share of documents that models learn from is those with a remainder other than 0.
FOLDS = 5


def ready(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package (on a cluster, ship it with --py-files), and bound the
    batches that they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that setCheckpointDir was given. Where both are unset, a local session
    (tests) gets a new one; on a cluster that is an error, since executors could not see it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            return held.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-corpusq-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpusq/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and later steps read only the
    columns they need."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file of a public tokenizer, in that folder or the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id):
    """True for the fifth of the documents that no model learns from. A null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


# --- inside tasks -----------------------------------------------------------------------------------------------------


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts, n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    width = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(offsets: np.ndarray, most: int = BATCH_BYTES):
    """Row ranges of at most so many bytes, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def batches(frames, most: int = BATCH_BYTES, column: str = "text"):
    """(batch of rows, bytes, offsets) of bounded text size, from a mapInArrow iterator."""
    for batch in frames:
        data, at = strings(batch.column(column))
        for i, j in slices(at, most):
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes after A-Z are lowered: all but white space; or digits, a-z and everything beyond ASCII.
NOT_SPACE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ALNUM = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words of more bytes are hashed one by one.
LONG = 64
_SEED = 0xD1B54A32D192ED03
_PART = (np.uint64(1) << np.arange(64, dtype=np.uint64)[::8]) - np.uint64(1)  # of eight bytes, the first 0 to 7


def run_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes: eight bytes at a time, scrambled after each; words of one length of up to eight bytes
    never collide, others only by chance."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = last - first
    out = mix(size.astype(np.uint64) + np.uint64(_SEED))
    rest = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        left = size[rest] - k
        chunk = eight[first[rest] + k]
        short = left < 8
        chunk[short] &= _PART[left[short]]
        out[rest] = mix(out[rest] ^ chunk)
        rest = rest[left > 8]
        if not len(rest):
            break
    for k in np.flatnonzero(size > LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[first[k] : last[k]].tobytes(), _SEED)
    return out


def same_runs(x: np.ndarray, x_first: np.ndarray, y: np.ndarray, y_first: np.ndarray, size: np.ndarray, most: int = BATCH_BYTES) -> np.ndarray:
    """Of pairs of runs of bytes of one size (at least 1): whether they are equal, byte by byte."""
    out = np.ones(len(size), bool)
    ends = np.concatenate([[0], np.cumsum(size)])
    for i, j in slices(ends, most):
        place = np.arange(ends[i], ends[j])
        back = np.repeat(ends[i:j], size[i:j])
        equal = x[place - back + np.repeat(x_first[i:j], size[i:j])] == y[place - back + np.repeat(y_first[i:j], size[i:j])]
        out[i:j] = np.logical_and.reduceat(equal, ends[i:j] - ends[i])
    return out


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of every word, and each row's first word (n + 1 offsets).
    A word is a run of word_bytes (after lowering A-Z); its hash depends on its bytes alone. Hashes may collide by chance:
    where equality decides a result, bytes are compared as well."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    low = _LOWER[data] if lower else data
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word_bytes[low]
    cut = np.zeros(n + 1, bool)  # a row starts here
    cut[offsets] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    last = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return run_hashes(low, first, last), first, last, np.searchsorted(first, offsets)
