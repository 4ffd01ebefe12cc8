"""Nearest vectors by inner product, from a forest of random-projection trees.

Vectors that are equal are one point; of its ids only the smallest k + 1 can ever be among the k nearest of another row.
A point gets one more coordinate, sqrt(M^2 - |x|^2) with the largest norm M, and a query 0, so that the largest inner
product is the smallest distance. Each level of a tree cuts along a random direction, at the median of those sampled points
that came there. Trees are fitted on at most SAMPLE points, chosen by a hash of their ids; every point is put into a
leaf of every tree.

A query goes through all trees with one priority queue: the branch whose cuts lie nearest comes next, and its leaf is
taken, until the leaves taken hold a budget of points. The budget is measured: for TRIED queries, chosen by a hash, the true
neighbours are found by a pass over all points, and the budget is the least that reaches RECALL of them. In unstructured
vectors the nearest lie little nearer than others and no index prunes much; where there is structure, few leaves do.

Leaves that stand side by side form groups of at most GROUP points (a larger leaf is dealt to several groups). A point
is sent once for each tree, to its leaf's group; a query is sent once to each group in which it takes a leaf. A task holds
the points of one group, in order of leaf, and queries go by in batches; only the best k + 1 of each query leave it. Scores
are computed from the original vectors in double precision, and cut by score, then id.

Only the cuts, the leaves' sizes and groups, and the tried queries are sent to all tasks: at most TREES * 2^DEPTH
numbers of each kind, and TRIED vectors.

Defined cases: rows without an id, and vectors that are null, empty, all zero, of another length than most, or hold a null
or a non-finite number, take no part; rows equal in id and vector are one row; ties go to the smaller id; fewer than k other
rows are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, stage

TREES, LEAF, DEPTH = 2, 64, 13
SAMPLE = 1 << 16
#: Share of the true neighbours that the budget of points reaches on TRIED queries.
RECALL, TRIED = 0.93, 128
#: Points that a task holds, at most, and groups of leaves that there are at least, where GROUP_LEAST points allow.
GROUP, GROUP_LEAST, LEAST_GROUPS = 1 << 16, 1024, 24
#: Scores that stand in one dense matrix.
CELLS = 1 << 22
#: Queries that a task takes through the trees, about.
TASK_QUERIES = 4096
K = 20


class Forest:
    """Directions and cuts of the trees; the cuts of level d are an array of 2^d."""

    def __init__(self, sample: np.ndarray, n: int, norm: float, trees: int = TREES, leaf: int = LEAF, seed: int = 0):
        self.norm = norm
        self.depth = int(max(0, min(DEPTH, np.ceil(np.log2(max(1, n / leaf))), np.floor(np.log2(max(1, len(sample) / 8))))))
        rng = np.random.default_rng(seed)
        directions = rng.normal(size=(trees, self.depth, sample.shape[1] + 1))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.cuts = []
        x = self.lifted(sample)
        for t in range(trees):
            node, cuts = np.zeros(len(x), np.int64), []
            for d in range(self.depth):
                p = x @ self.directions[t, d]
                order = np.lexsort((p, node))
                count = np.bincount(node, minlength=1 << d)
                middle = np.cumsum(count) - count + count // 2
                cuts.append(p[order][np.minimum(middle, len(x) - 1)])
                node = node * 2 + (p > cuts[d][node])
            self.cuts.append(cuts)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(1)))])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        x, out = self.lifted(x), np.zeros((len(x), len(self.cuts)), np.int64)
        for t, cuts in enumerate(self.cuts):
            for d in range(self.depth):
                out[:, t] = out[:, t] * 2 + (x @ self.directions[t, d] > cuts[d][out[:, t]])
        return out

    def visit(self, q: np.ndarray):
        """The (tree, leaf) that the queue takes for a query, one after the other."""
        p = self.directions[:, :, :-1] @ q
        queue = [(0.0, t, 0, 0) for t in range(len(self.cuts))]
        while queue:
            far, t, d, node = heapq.heappop(queue)
            while d < self.depth:
                margin = p[t, d] - self.cuts[t][d][node]
                heapq.heappush(queue, (far + margin * margin, t, d + 1, node * 2 + int(margin <= 0)))
                node, d = node * 2 + int(margin > 0), d + 1
            yield t, node


def _stack(column) -> np.ndarray:
    """Vectors of one length, without nulls, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    x = x.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    size = x.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return x.where(F.size("embedding") == (size[0][0] if size else 0))


def _best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of each query's best by score, then id; scores are those of all pairs, -inf for none."""
    least = np.full(len(q), -np.inf)
    if scores.shape[1] > most:
        least = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    row, at = np.nonzero((scores >= (least - 1e-9 * (1 + np.abs(least, where=np.isfinite(least), out=np.zeros(len(q)))))[:, None]) & (scores > -np.inf))
    # the same sum for the same two vectors, whatever stands around them
    exact = (x[at] * q[row]).sum(1)
    order = np.lexsort((ids[at], -exact, row))
    row, at, exact = row[order], at[order], exact[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[keep], ids[at][keep], exact[keep]


def _scoring(k: int):
    """Each query's best k + 1 of a group; rows come by group, points first and by leaf."""

    def run(frames):
        group, points, ready = None, [], None
        for batch in frames:
            if not batch.num_rows:
                continue
            groups, query = batch.column("group").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            ids, vectors, leaves = batch.column("id").to_numpy(), _stack(batch.column("vector")), batch.column("leaves")
            cuts = (np.flatnonzero((groups[1:] != groups[:-1]) | (query[1:] != query[:-1])) + 1).tolist()
            for a, z in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if groups[a] != group:
                    group, points, ready = groups[a], [], None
                own = leaves.slice(a, z - a)
                if not query[a]:
                    points.append((ids[a:z], vectors[a:z], own.flatten().to_numpy()))
                    continue
                if not points:
                    continue
                if ready is None:
                    pid, x, leaf = (np.concatenate(c) for c in zip(*points, strict=True))
                    names, starts = np.unique(leaf, return_index=True)
                    ready = pid, x, names, np.append(starts, len(leaf))
                pid, x, names, starts = ready
                taken = np.zeros((z - a, len(names)), bool)
                flat, sizes = own.flatten().to_numpy(), np.diff(own.offsets.to_numpy())
                at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                there = names[at] == flat  # of a leaf that is dealt out, this group may have no point
                taken[np.repeat(np.arange(z - a), sizes)[there], at[there]] = True
                step = max(1, CELLS // len(x))
                for i in range(0, z - a, step):
                    q, t = vectors[a + i : min(z, a + i + step)], taken[i : i + step]
                    scores = np.full((len(q), len(x)), -np.inf)
                    for j, (u, v) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                        rows = np.flatnonzero(t[:, j])
                        if len(rows):
                            scores[rows, u:v] = q[rows] @ x[u:v].T
                    row, rep, score = _best(x, pid, q, scores, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + i + row]), pa.array(rep), pa.array(score)], ["q", "rep", "score"])

    return run


def budget(index: DataFrame, asked: DataFrame, forest: Forest, sizes: np.ndarray, k: int, recall: float, tried: int, seed: int) -> float:
    """Points that the leaves taken for a query have to hold: the least that reach that share of the true neighbours of
    `tried` queries."""
    some = asked.select("q", "embedding").dropDuplicates(["q"]).orderBy(F.xxhash64("q", F.lit(seed + 1)), "q").limit(tried).collect()
    queries = np.array([r["embedding"] for r in some], np.float64)
    names = np.array([r["q"] for r in some], np.int64)
    held = index.sparkSession.sparkContext.broadcast((names, queries))

    def run(frames):
        ids, q = held.value
        for batch in frames:
            x, reps = _stack(batch.column("embedding")), batch.column("rep").to_numpy()
            if not len(x):
                continue
            scores = q @ x.T
            scores[ids[:, None] == reps[None, :]] = -np.inf
            row, rep, score = _best(x, reps, q, scores, k)
            place = np.searchsorted(reps, rep, sorter=(by := np.argsort(reps)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(rep), pa.array(score), batch.column("leaves").take(pa.array(by[place]))], ["q", "rep", "score", "leaves"])

    found = index.mapInArrow(run, "q long, rep long, score double, leaves array<int>").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k)
    true: dict[int, list] = {}
    for r in found.select("q", "leaves").collect():  # at most tried * k
        true.setdefault(r["q"], []).append(r["leaves"])
    costs = []
    for name, q in zip(names.tolist(), queries, strict=True):
        left, taken = true.get(name, []), 0
        for t, leaf in forest.visit(q):
            if not left:
                break
            taken += sizes[t, leaf]
            far = [x for x in left if x[t] != leaf]
            costs += [taken] * (len(left) - len(far))
            left = far
    return float(np.quantile(costs, recall, method="higher")) if costs else float(sizes.sum())


def nearest(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL, trees: int = TREES, leaf: int = LEAF, seed: int = 0, tried: int = TRIED, group_points: int = GROUP) -> DataFrame:
    """(vec_id, embedding) and a condition for queries to query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors).distinct(), "vectors")
    by_vector = W.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("rn", F.row_number().over(by_vector)).where(F.col("rn") <= k + 1)
    members = stage(kept.withColumn("rep", F.min("vec_id").over(W.partitionBy("embedding"))), "members")
    points = members.where("rn = 1").select("rep", "embedding")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    n, norm = points.agg(F.count(F.lit(1)), F.max(F.sqrt(square))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    of = points.select(F.col("rep").alias("q"), F.col("embedding").alias("e"))
    asked = stage(rows.where(is_query).join(of, F.col("embedding") == F.col("e")).select(F.col("vec_id").alias("query_id"), "q", "embedding"), "queries")
    if not (n_asked := asked.count()):
        return spark.createDataFrame([], schema)
    sample = points.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(SAMPLE).select("embedding").toArrow()
    forest = Forest(_stack(sample["embedding"].combine_chunks()), n, norm, trees, leaf, seed)
    held = spark.sparkContext.broadcast(forest)

    def put(frames):
        for batch in frames:
            leaves = held.value.leaves(_stack(batch.column("embedding"))) if batch.num_rows else np.zeros((0, trees), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaves.astype(np.int32)), pa.list_(pa.int32()))], [*batch.schema.names, "leaves"])

    element = points.schema["embedding"].dataType.simpleString()
    index = stage(points.mapInArrow(put, f"rep long, embedding {element}, leaves array<int>"), "index")
    in_tree = index.select("rep", "embedding", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, 1 << forest.depth), np.int64)
    for t, node, c in in_tree.groupBy("tree", "leaf").count().collect():  # at most trees * 2^DEPTH
        sizes[t, node] = c
    enough = budget(index, asked, forest, sizes, k, recall, tried, seed)

    # Groups of leaves: side by side in a tree, or several for one leaf. `first` and `parts` tell each leaf's groups.
    most = min(group_points, max(GROUP_LEAST, -(-n * trees // LEAST_GROUPS)))
    first, parts, groups = np.zeros_like(sizes), np.maximum(1, -(-sizes // most)), 0
    for t in range(trees):
        full = 0
        for j in range(sizes.shape[1]):
            if full and full + sizes[t, j] > most:
                groups, full = groups + 1, 0
            first[t, j], full = groups, full + sizes[t, j]
            if parts[t, j] > 1:
                groups, full = groups + int(parts[t, j]), 0
        groups += 1
    of_leaf = spark.sparkContext.broadcast((first, parts))

    def go(frames):
        first, parts = of_leaf.value
        for batch in frames:
            out = []
            for x in _stack(batch.column("embedding")):
                left, own = enough, {}
                for t, node in held.value.visit(x):
                    if left <= 0:
                        break
                    left -= sizes[t, node]
                    for g in range(first[t, node], first[t, node] + parts[t, node]):
                        own.setdefault(int(g), []).append(node)
                out.append([{"group": g, "leaves": v} for g, v in own.items()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(out, pa.list_(pa.struct([("group", pa.int32()), ("leaves", pa.list_(pa.int32()))])))], ["id", "embedding", "taken"])

    def dealt(frames):
        first, parts = of_leaf.value
        for batch in frames:
            t, node, rep = (batch.column(c).to_numpy() for c in ("tree", "leaf", "rep"))
            yield pa.RecordBatch.from_arrays([pa.array((first[t, node] + (mix(rep.astype(np.uint64)) % parts[t, node].astype(np.uint64)).astype(np.int64)).astype(np.int32)), *(batch.column(c) for c in ("rep", "embedding", "leaf"))], ["group", "rep", "embedding", "leaf"])

    once = asked.select(F.col("q").alias("id"), "embedding").dropDuplicates(["id"])
    # vectors are few bytes, but each takes a walk through the trees
    visits = once.repartition(max(spark.sparkContext.defaultParallelism, -(-n_asked // TASK_QUERIES)), "id").mapInArrow(go, f"id long, embedding {element}, taken array<struct<group:int,leaves:array<int>>>")
    queries = visits.withColumn("t", F.explode("taken")).select("t.group", F.lit(True).alias("query"), "id", F.col("embedding").alias("vector"), "t.leaves")
    stored = in_tree.mapInArrow(dealt, f"group int, rep long, embedding {element}, leaf int").select("group", F.lit(False).alias("query"), F.col("rep").alias("id"), F.col("embedding").alias("vector"), F.array("leaf").alias("leaves"))
    in_order = queries.unionByName(stored).repartition(groups, "group").sortWithinPartitions("group", "query", "leaves", "id")
    scored = in_order.mapInArrow(_scoring(k), "q long, rep long, score double")

    best = W.partitionBy("q").orderBy(F.desc("score"), "rep")
    top = scored.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    ids = members.select(F.col("rep").alias("m"), "vec_id")
    listed = top.join(ids, F.col("rep") == F.col("m")).withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    listed = stage(listed.select(F.col("q").alias("l"), "vec_id", "score"), "nearest")
    own = asked.select("query_id", "q").join(listed, F.col("q") == F.col("l")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
