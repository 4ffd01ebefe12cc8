"""Toxicity by subword bags: embeddings of character n-grams, averaged, under a linear softmax.

A text's words (letters, digits and all beyond ASCII, A-Z lowered) stand between spaces; a word's subwords are its
n-grams of bytes, n in LENGTHS, that have a space at most at an end. Subwords are hashed to BUCKETS embeddings. A stretch of
text is the mean of the embeddings of its subwords and some empty ones, times a gain; a softmax over two classes follows.
Embeddings and softmax are trained together, in numpy, so a misspelling that no label ever showed still scores by the
n-grams that it shares.

A label says that a text is toxic, not where, and one mean over a whole text would thin a short insult away. So a text is
scored by its windows of WINDOW words, one by one, and the largest score decides. Which windows to learn from is first told by
how much oftener their subwords are in toxic texts than in clean ones. Then, ROUNDS times, the model is trained on the windows
that score highest, one of each text, and some more of clean texts, and its own scores choose the next. Last, a logistic fit on
the learning texts turns the largest score, and the logarithm of the number of windows, into a probability; toxic texts count
TOXIC_WEIGHT times in it.

The model is fitted on at most MOST_TOXIC + MOST_CLEAN labelled texts, chosen by a hash of doc_id (a documented bound; whole
texts of any length). Tasks go through these texts; the driver only sees windows' buckets, counts and features, and trains. Every document is scored over its whole text, without a shuffle. Of a trained model a window's
score only needs one number for each bucket, so BUCKETS floats are sent to the tasks.

Defined cases: null and empty texts, and those without words, have one empty window and score by the softmax's bias alone;
repeated documents are scored each by itself; of windows that tie any one decides, with the same score; a null doc_id counts
as held out and is scored like others; an id with two labels counts as toxic if any says so; labels with null id or mark
are ignored; a very long text is scored whole, by itself, in memory of some times its size; with no label of either class the
score is the share of toxic labels, 0 without labels; the empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, ALNUM, batches, held_out, mix, randoms, stage, words

LENGTHS = (3, 4, 5)
BUCKETS = 1 << 18
SIZE = 4
#: Words of a window; one begins at every word.
WINDOW = 2
#: Subwords of weight 0 that a window has besides its own, so that few letters don't decide alone.
STEADY = 8
GAIN = 10.0
EPOCHS, ROUNDS, BATCH, RATE = 4, 3, 64, 0.1
#: Windows of clean texts that are learnt from besides the highest ones, for each clean text.
MORE_CLEAN = 6
#: A bucket is learnt if so many of the stretches have it; the others stay at 0.
LEAST_STRETCHES = 3
#: Added to the numbers of texts that have a subword, before they are compared.
SMOOTH = 3.0
#: Tasks that go through the learning texts.
TASKS = 16
TOXIC_WEIGHT = 4.0
MOST_TOXIC, MOST_CLEAN = 1500, 4500
_K = randoms(8, 41)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all subwords."""
    low = _LOWER[data]
    inside = ALNUM[low]
    # one space for each run of other bytes, and one before each row and after the last
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    text = np.zeros(len(data) + n + 1, np.uint8)
    place = np.arange(len(data)) + np.searchsorted(offsets, np.arange(len(data)), "right") if len(data) else np.zeros(0, np.int64)
    text[place] = np.where(inside, low, 0)
    keep = text != 0
    keep[1:] |= text[:-1] != 0
    keep[at] = True
    row = np.searchsorted(at, np.flatnonzero(keep), "right") - 1
    text = text[keep].astype(np.uint64)
    letter = text != 0
    found, rows = [], []
    for length in LENGTHS:
        if len(text) < length:
            continue
        m = len(text) - length + 1
        whole = np.ones(m, bool)
        for i in range(1, length - 1):
            whole &= letter[i : i + m]
        code = text[:m][whole] * _K[0]
        for i in range(1, length):
            code += text[i : i + m][whole] * _K[i]
        found.append((mix(code + _K[length]) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
        rows.append(row[1 : m + 1][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(rows)


def by_word(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets in order of word, where each word's begin (n words + 1), and each row's first word (n rows + 1)."""
    _, first, last, rows = words(data, offsets, ALNUM)
    ends = np.concatenate([[0], np.cumsum(last - first)])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1] - first, last - first)
    bucket, word = subwords(data[place], ends)
    starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(first)))])
    return bucket[np.argsort(word, kind="stable")], starts, rows


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, row) of all windows, in order of row; each row has one at least."""
    n = np.diff(rows)
    count = np.maximum(1, n - WINDOW + 1)
    row = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + rows[row]
    return first, np.minimum(first + WINDOW, rows[row + 1]), row


def _scores(weight: np.ndarray, bucket: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The mean weight of windows' subwords, and STEADY empty ones."""
    word = np.add.reduceat(np.append(weight[bucket], 0).astype(np.float64), starts[:-1]) if len(starts) > 1 else np.zeros(0)
    word[np.diff(starts) == 0] = 0
    word = np.append(word, np.zeros(WINDOW))
    total = sum(np.where(first + k < last, word[first + k], 0) for k in range(WINDOW))
    return total / (starts[last] - starts[first] + STEADY)


def _train(stretches: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, gain: float, seed: int) -> tuple[np.ndarray, float]:
    """A weight for each bucket and a bias, from (distinct buckets, their shares) of stretches of text."""
    having = np.zeros(BUCKETS, np.int64)
    for own, _ in stretches:
        having[own] += 1
    learnt = having >= min(LEAST_STRETCHES, max(1, len(stretches) // 40))
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.01, (BUCKETS, SIZE)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full_like(x, 1e-6) for x in (embedding, softmax, bias)]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(len(stretches)), -(-len(stretches) // BATCH)):
            bucket, share = (np.concatenate([stretches[k][i] for k in part]) for i in (0, 1))
            row = np.repeat(np.arange(len(part)), [len(stretches[k][0]) for k in part])
            some = learnt[bucket]
            own, column = np.unique(bucket[some], return_inverse=True)
            x = np.zeros((len(part), len(own)), np.float32)
            x[row[some], column] = share[some] * gain
            hidden = x @ embedding[own]
            logits = hidden @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), toxic[part]] -= 1
            p /= len(part)
            step = x.T @ (p @ softmax.T)
            squares[0][own] += step**2
            embedding[own] -= rate * step / np.sqrt(squares[0][own])
            for value, square, step in ((softmax, squares[1], hidden.T @ p), (bias, squares[2], p.sum(0))):
                square += step**2
                value -= rate * step / np.sqrt(square)
    embedding[~learnt] = 0
    return embedding @ (softmax[:, 1] - softmax[:, 0]) * gain, float(bias[1] - bias[0])


def _highest(score: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The first of the highest windows of each row."""
    order = np.lexsort((-score, row))
    return order[np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))]


def _features(score: np.ndarray, row: np.ndarray, bias: float) -> np.ndarray:
    """The largest score of each row, the logarithm of its number of windows, and 1."""
    count = np.bincount(row)
    return np.column_stack([np.maximum.reduceat(score, np.cumsum(count) - count) + bias, np.log(count), np.ones(len(count))])


class Model:
    """A weight for each bucket, the softmax's bias, and three numbers that turn a text's features into a logit."""

    def __init__(self, weight: np.ndarray, bias: float, scale: np.ndarray):
        self.weight, self.bias, self.scale = weight, bias, scale

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        bucket, starts, rows = by_word(data, offsets)
        first, last, row = windows(rows)
        logit = _features(_scores(self.weight, bucket, starts, first, last), row, self.bias) @ self.scale
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _having(frames):
    """(bucket, toxic, n): texts of a mark that have a bucket."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch, data, offsets in batches(frames):
        bucket, starts, rows = by_word(data, offsets)
        toxic = batch.column("toxic").to_numpy()
        for k in range(batch.num_rows):
            total[toxic[k], np.unique(bucket[starts[rows[k]] : starts[rows[k + 1]]])] += 1
    mark, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(mark), pa.array(total[mark, bucket])], ["bucket", "toxic", "n"])


def _chosen(held, seed: int):
    """(doc_id, toxic, nth, buckets, size) of windows to learn from: the highest of each text, and of clean ones some more."""

    def run(frames):
        weight = held.value
        for batch, data, offsets in batches(frames):
            bucket, starts, rows = by_word(data, offsets)
            first, last, row = windows(rows)
            high = _highest(_scores(weight, bucket, starts, first, last), row)
            names, toxic, hashes = (batch.column(c).to_pylist() for c in ("doc_id", "toxic", "hash"))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for k in range(batch.num_rows):
                places = [high[k]]
                if not toxic[k]:
                    places += np.random.default_rng([seed, hashes[k] & 0xFFFFFFFF]).integers(ends[k], ends[k + 1], MORE_CLEAN).tolist()
                out += [(names[k], toxic[k], i, bucket[starts[first[w]] : starts[last[w]]].astype(np.int32)) for i, w in enumerate(places)]
            names, toxic, nth, buckets = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(toxic, pa.int32()), pa.array(nth, pa.int32()), pa.array(buckets, pa.list_(pa.int32()))], ["doc_id", "toxic", "nth", "buckets"])

    return run


def _found(held):
    """(doc_id, toxic, largest, windows) of texts."""

    def run(frames):
        weight, bias = held.value
        for batch, data, offsets in batches(frames):
            bucket, starts, rows = by_word(data, offsets)
            first, last, row = windows(rows)
            x = _features(_scores(weight, bucket, starts, first, last), row, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "toxic", "largest", "windows"])

    return run


def fit(texts: DataFrame, seed: int = 0) -> Model:
    """The model of labelled texts (doc_id, toxic, hash, text)."""
    spark = texts.sparkSession
    count = dict(tuple(r) for r in texts.groupBy("toxic").count().collect())
    if len(count) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, np.array([0, 0, 40.0 if 1 in count else -40.0]))
    having = texts.mapInArrow(_having, "bucket long, toxic long, n long").groupBy("bucket", "toxic").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * BUCKETS
    texts_with = np.zeros((2, BUCKETS))
    texts_with[having["toxic"].to_numpy(), having["bucket"].to_numpy()] = having["n"].to_numpy()
    weight, bias = np.log((texts_with[1] + SMOOTH) / (count[1] + 2 * SMOOTH)) - np.log((texts_with[0] + SMOOTH) / (count[0] + 2 * SMOOTH)), 0.0
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(weight.astype(np.float32))
        some = texts.mapInArrow(_chosen(held, seed), "doc_id long, toxic int, nth int, buckets array<int>").toArrow().sort_by([("doc_id", "ascending"), ("nth", "ascending")])
        stretches = []
        for own in some["buckets"].combine_chunks():
            own, times = np.unique(np.array(own.values, np.int32), return_counts=True)
            stretches.append((own, (times / (times.sum() + STEADY)).astype(np.float32)))
        weight, bias = _train(stretches, some["toxic"].to_numpy().astype(np.int64), GAIN, seed)
        held.unpersist()
    held = spark.sparkContext.broadcast((weight, bias))
    found = texts.mapInArrow(_found(held), "doc_id long, toxic int, largest double, windows double").toArrow().sort_by("doc_id")
    x, y = np.column_stack([found["largest"], found["windows"], np.ones(len(found))]), found["toxic"].to_numpy()
    scale, times = np.array([1.0, 0, 0]), np.where(y == 1, TOXIC_WEIGHT, 1.0)
    for _ in range(50):  # Newton's steps of a logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        scale = scale - np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), x.T @ (times * (p - y)) + 1e-3 * scale)
    return Model(weight, bias, scale)


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """Labelled texts to learn from (doc_id, toxic, hash, text), none of them held out, of either class up to its bound."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = stage(marks, "labels")
    near = marks.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("hash", F.xxhash64("doc_id"))
    bounded = [near.where(F.col("toxic") == mark).orderBy("hash", "doc_id").limit(most) for mark, most in ((1, most_toxic), (0, most_clean))]
    ids = stage(bounded[0].unionByName(bounded[1]), "toxicity-ids").select(F.col("doc_id").alias("id"), "toxic", "hash")
    # at most that many ids; of rows with one id, one
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("doc_id", "toxic", "hash").agg(F.min("text").alias("text"))
    return stage(rows.repartition(TASKS, "doc_id"), "toxicity-texts")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text) and labels (doc_id, toxic) to doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(fit(sample(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels)))

    def run(frames):
        for batch, data, offsets in batches(frames):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.scores(data, offsets))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
