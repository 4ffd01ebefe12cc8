"""Language-model scoring by masked pseudo-likelihood.

A token is a word (white space parts them, A-Z lowered). A small network reads the SIDE tokens before and after a place, the token
there being masked: the embeddings of the neighbours, each by its own place, are summed and squashed, and a softmax over
groups and one over a group's members give the probability of the token's class. The classes are the WORDS most frequent
words of the corpus and RARE classes of all others, by hash; such a word's share of its class is its count over its
class's count. A document's score is the sum of the log-probabilities of all its tokens, each given both sides.

Counts of words are taken over all documents: they name the classes, are the softmax's first biases, and give every word its
share. The shares of about HEAD words are sent to the tasks, those of all others come by a join with the written counts.

The network is trained on every token of every document. Documents fall into ROUNDS parts by a hash of doc_id; for each part
tasks add up the gradients of their own tokens, Spark adds those of the tasks, and the driver takes a step (Adagrad). The
network has a fixed size. Texts are turned into classes once; training and scoring read these.

Defined cases: null text and text without words has no tokens, log_prob 0 and a null perplexity; repeated documents are
scored each by itself; the empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, batches, new_path, stage, words

SIDE = 2
GROUPS = MEMBERS = 32
RARE = 64
CLASSES = GROUPS * MEMBERS
WORDS = CLASSES - RARE
NOTHING = CLASSES  # stands beyond a text's ends
SIZE = 24
ROUNDS, RATE = 20, 0.1
#: Adagrad's sums of squares start at this.
LEAST_SQUARE = 1e-12
#: Tokens that a task passes through the network at once.
BATCH = 16384
#: Words whose counts are sent to the tasks, at most, and the parts in which gradients are added up.
HEAD, SLICES = 1 << 17, 16
#: Tasks whose gradients are added up at once.
TASKS = 64
#: Distinct words that a task counts before it passes them on.
MOST_COUNTED = 1 << 20


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; a task passes on a row for each of its distinct words."""

    def run(frames):
        held, n, size = [], [], 0

        def summed():
            word, back = np.unique(np.concatenate(held), return_inverse=True)
            return word, np.bincount(back, np.concatenate(n)).astype(np.int64)

        def rows():
            word, count = summed()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "n"])

        for _, data, offsets in batches(frames):
            word, count = np.unique(words(data, offsets, NOT_SPACE)[0], return_counts=True)
            held.append(word)
            n.append(count)
            size += len(word)
            if size > MOST_COUNTED:
                word, count = summed()
                held, n, size = [word], [count], len(word)
                if size > MOST_COUNTED // 2:
                    yield rows()
                    held, n, size = [], [], 0
        if held:
            yield rows()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Classes of words by their hash: the frequent ones by rank, the others by hash."""

    def __init__(self, frequent: np.ndarray, head: np.ndarray | None = None, counts: np.ndarray | None = None):
        """head: words whose counts are at hand in tasks."""
        ranked = frequent.view(np.uint64)
        self.order = np.argsort(ranked)
        self.known = ranked[self.order]
        head = np.zeros(0, np.uint64) if head is None else head.view(np.uint64)
        order = np.argsort(head)
        self.head, self.logs = head[order], np.log(np.zeros(0) if counts is None else counts[order])

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        rare = WORDS + (hashes >> np.uint64(58)).astype(np.int64)  # 64 classes
        if not len(self.known):
            return rare
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.order[at], rare)

    def log_counts(self, hashes: np.ndarray) -> np.ndarray:
        """Of the words at hand; NaN for others."""
        if not len(self.head):
            return np.full(len(hashes), np.nan)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        return np.where(self.head[at] == hashes, self.logs[at], np.nan)


def sides(classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The neighbours' classes of every token, SIDE before and SIDE after; rows: first tokens of the texts, n + 1 offsets."""
    n = len(classes)
    text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    out = np.full((n, 2 * SIDE), NOTHING)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, z = max(0, -step), min(n, n - step)
        if z > a:
            out[a:z, k] = np.where(text[a:z] == text[a + step : z + step], classes[a + step : z + step], NOTHING)
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    x /= x.sum(1, keepdims=True)
    return x


class Network:
    """Predicts a token's class from both sides."""

    def __init__(self, class_counts: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = class_counts.reshape(GROUPS, MEMBERS) + 0.5
        self.p = {
            "embedding": rng.normal(0, 0.1, (2 * SIDE, CLASSES + 1, SIZE)),
            "bias": np.zeros(SIZE),
            "group": rng.normal(0, 0.1, (SIZE, GROUPS)),
            "group_bias": np.log(n.sum(1) / n.sum()),
            "member": rng.normal(0, 0.1, (GROUPS, SIZE, MEMBERS)),
            "member_bias": np.log(n / n.sum(1, keepdims=True)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        #: What a word's log-probability loses to its class; the log of its own count is added to it.
        self.share = np.zeros(CLASSES)
        self.share[WORDS:] = np.log(np.maximum(1, class_counts[WORDS:]))
        self.squares = {k: np.full(v.shape, LEAST_SQUARE) for k, v in self.p.items()}

    def hidden(self, context: np.ndarray) -> np.ndarray:
        e = self.p["embedding"]
        return np.tanh(sum((e[k][context[:, k]] for k in range(2 * SIDE)), self.p["bias"]))

    def log_probs(self, classes: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of each token's class (less the log of its count if it is rare), given its neighbours."""
        h = self.hidden(context)
        group, member = classes // MEMBERS, classes % MEMBERS
        out = _log_softmax(h @ self.p["group"] + self.p["group_bias"])[np.arange(len(h)), group].astype(np.float64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
        for g in range(GROUPS):
            own = order[cuts[g] : cuts[g + 1]]
            if len(own):
                out[own] += _log_softmax(h[own] @ self.p["member"][g] + self.p["member_bias"][g])[np.arange(len(own)), member[own]]
        return out - self.share[classes]

    def gradients(self, classes: np.ndarray, context: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of the tokens' negative log-probabilities."""
        h, group, member, m = self.hidden(context), classes // MEMBERS, classes % MEMBERS, len(classes)
        dg = _softmax(h @ self.p["group"] + self.p["group_bias"])
        dg[np.arange(m), group] -= 1
        dh = dg @ self.p["group"].T
        out = {"group": h.T @ dg, "group_bias": dg.sum(0, dtype=np.float64), "member": np.zeros((GROUPS, SIZE, MEMBERS)), "member_bias": np.zeros((GROUPS, MEMBERS))}
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
        for g in range(GROUPS):
            own = order[cuts[g] : cuts[g + 1]]
            if len(own):
                dm = _softmax(h[own] @ self.p["member"][g] + self.p["member_bias"][g])
                dm[np.arange(len(own)), member[own]] -= 1
                dh[own] += dm @ self.p["member"][g].T
                out["member"][g], out["member_bias"][g] = h[own].T @ dm, dm.sum(0, dtype=np.float64)
        dh = (dh * (1 - h**2)).astype(np.float64)
        out["bias"] = dh.sum(0)
        columns = np.ascontiguousarray(dh.T)
        out["embedding"] = np.stack([np.stack([np.bincount(context[:, k], x, CLASSES + 1) for x in columns], axis=1) for k in range(2 * SIDE)])
        return out

    def packed(self, gradients: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([gradients[k].ravel() for k in self.p])

    def step(self, packed: np.ndarray) -> None:
        """Along the mean gradient, packed."""
        at = 0
        for k, v in self.p.items():
            g = packed[at : at + v.size].reshape(v.shape)
            at += v.size
            self.squares[k] += g**2
            self.p[k] = (v - RATE * g / np.sqrt(self.squares[k])).astype(np.float32)


def vocabulary_of(docs: DataFrame) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """The written counts of all words, the vocabulary, and the counts of the classes."""
    table = stage(counts(docs), "word-counts")
    top = table.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    frequent = np.array([r["word"] for r in top], np.int64)
    # The most frequent words by sixteenths of powers of two, as many whole steps as have at most HEAD words.
    height = F.floor(F.log2("n") * 16)
    size, least = 0, None
    for r in sorted(table.groupBy(height.alias("height")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["height"]):
        size += r["words"]
        if size > HEAD:
            break
        least = r["height"]
    head = table.where(height >= least).toArrow() if least is not None else None
    held = () if head is None else (head["word"].to_numpy(), head["n"].to_numpy())
    # of rare classes (the top six bits of the hash): occurrences of their words, frequent words aside
    known = docs.sparkSession.createDataFrame([(int(w),) for w in frequent], "word long")
    code = F.shiftrightunsigned("word", 58).cast("int")
    rare = table.join(F.broadcast(known), "word", "left_anti").groupBy(code.alias("c")).agg(F.sum("n").alias("n")).collect()
    class_counts = np.zeros(CLASSES)
    class_counts[: len(frequent)] = [r["n"] for r in top]
    for r in rare:
        class_counts[WORDS + r["c"]] = r["n"]
    return table, Vocabulary(frequent, *held), class_counts


CODED = "doc_id long, n_tokens long, classes binary, log_counts double, tail array<long>, times array<long>"


def coded(docs: DataFrame, vocabulary: Vocabulary, seed: int = 0) -> DataFrame:
    """(doc_id, text) to the classes of all tokens, the sum of log-counts of rare words at hand, and the other rare words with
    their numbers in the document; `row` tells rows apart. Written."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames):
        v = held.value
        for batch, data, offsets in batches(frames):
            hashes, _, _, rows = words(data, offsets, NOT_SPACE)
            classes, n = v.classes(hashes), np.diff(rows)
            text = np.repeat(np.arange(len(n)), n)
            rare = np.flatnonzero(classes >= WORDS)
            logs = v.log_counts(hashes[rare])
            far = np.isnan(logs)
            near = np.bincount(text[rare[~far]], logs[~far], len(n)).astype(np.float64)
            # runs of one word in one text
            word, of = hashes[rare[far]], text[rare[far]]
            order = np.lexsort((word, of))
            word, of = word[order], of[order]
            first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (of[1:] != of[:-1]))[: len(word)])
            ends = pa.array(np.searchsorted(of[first], np.arange(len(n) + 1)), pa.int32())
            times = np.diff(np.append(first, len(word)))
            bytes_ = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((rows * 2).astype(np.int32)), pa.py_buffer(classes.astype(np.uint16))])
            columns = [batch.column("doc_id"), pa.array(n.astype(np.int64)), bytes_, pa.array(near), pa.ListArray.from_arrays(ends, pa.array(word[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "classes", "log_counts", "tail", "times"])

    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(ROUNDS)).cast("int")
    # by part, so that a step of training reads its own part only
    rows, path = docs.mapInArrow(run, CODED).withColumns({"row": F.monotonically_increasing_id(), "part": part}), new_path(docs.sparkSession, "classes")
    rows.write.partitionBy("part").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _classes(frames):
    """(batch, classes, neighbours' classes, first tokens of the rows) of coded rows."""
    for batch, data, offsets in batches(frames, column="classes"):
        rows = offsets // 2
        classes = np.frombuffer(data.tobytes(), np.uint16).astype(np.int64)
        yield batch, classes, sides(classes, rows), rows


def gradient(rows: DataFrame, network: Network) -> np.ndarray | None:
    """The mean gradient of all tokens of coded rows, packed; null if there are none."""
    held = rows.sparkSession.sparkContext.broadcast(network)

    def run(frames):
        total, n = 0, 0
        for _, classes, context, _ in _classes(frames):
            for i in range(0, len(classes), BATCH):
                total = total + held.value.packed(held.value.gradients(classes[i : i + BATCH], context[i : i + BATCH]))
            n += len(classes)
        if n:
            own = [x.astype(np.float64).tobytes() for x in np.array_split(total, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(own, pa.binary())], ["slice", "n", "total"])

    def added(t: pa.Table) -> pa.Table:
        t = t.sort_by("task")
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in t["total"])
        return pa.table({"slice": t["slice"].slice(0, 1), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "total": pa.array([total.tobytes()], pa.binary()), "task": t["task"].slice(0, 1)})

    schema = "slice int, n long, total binary, task int"
    sums = rows.select("classes").mapInArrow(run, "slice int, n long, total binary").withColumn("task", F.spark_partition_id())
    # in two steps, so that no group holds a row of every task
    some = sums.groupBy("slice", F.expr(f"task div {TASKS}")).applyInArrow(lambda t: added(t.select(["slice", "n", "total", "task"])), schema)
    found = some.groupBy("slice").applyInArrow(added, schema).collect()
    held.unpersist()
    if not found:
        return None
    return np.concatenate([np.frombuffer(r["total"], np.float64) for r in sorted(found, key=lambda r: r["slice"])]) / found[0]["n"]


def trained(rows: DataFrame, class_counts: np.ndarray, seed: int = 0) -> Network:
    """The network after a step for each part of the coded rows."""
    network = Network(class_counts, seed)
    for k in range(ROUNDS):
        mean = gradient(rows.where(F.col("part") == k), network)
        if mean is not None:
            network.step(mean)
    return network


def fitted(docs: DataFrame, seed: int = 0) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of the documents (doc_id, text)."""
    _, vocabulary, class_counts = vocabulary_of(docs)
    return vocabulary, trained(coded(docs, vocabulary, seed), class_counts, seed)


def scored(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, text) to doc_id, n_tokens, log_prob (the sum over all tokens) and perplexity."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table, vocabulary, class_counts = vocabulary_of(docs)
    rows = coded(docs, vocabulary, seed)
    held = docs.sparkSession.sparkContext.broadcast(trained(rows, class_counts, seed))

    def run(frames):
        for batch, classes, context, at in _classes(frames):
            n = np.diff(at)
            each = np.concatenate([held.value.log_probs(classes[i : i + BATCH], context[i : i + BATCH]) for i in range(0, len(classes), BATCH)] or [np.zeros(0)])
            total = np.bincount(np.repeat(np.arange(len(n)), n), each, len(n)) + batch.column("log_counts").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(total)], ["row", "doc_id", "n_tokens", "own"])

    of_classes = rows.select("row", "doc_id", "n_tokens", "classes", "log_counts").mapInArrow(run, "row long, doc_id long, n_tokens long, own double")
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select(F.col("row").alias("of"), F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    rest = tail.join(table.hint("merge"), "word").groupBy("of").agg(F.sum(F.col("times") * F.ln("n")).alias("rest"))
    out = of_classes.join(rest.hint("merge"), F.col("row") == F.col("of"), "left").select("doc_id", "n_tokens", (F.col("own") + F.coalesce("rest", F.lit(0.0))).alias("log_prob"))
    return out.withColumn("perplexity", F.exp(-F.col("log_prob") / F.nullif("n_tokens", F.lit(0))))
