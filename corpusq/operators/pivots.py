"""R1, R13. Exact nearest neighbours that leave out what the triangle inequality rules out.

Every vector belongs to its nearest pivot, at a distance r. With d the distance of a query from that pivot, the vector is no
nearer to the query than |d - r|. A first round scores the pivots nearest to each query that hold k vectors; the k-th score there
is a bound t. The second takes only pivots some of whose vectors can be within t, and of these only vectors with
|d - r| <= t. Both rounds keep k in each batch of a task; no vector is shuffled.

Batches of vectors are multiplied with the queries' matrix. That tells which pairs may be among the k best; only these are scored
as the expressions of scored() do, term by term, and ranked by the rounded score.

Cosines are distances of vectors of length one. Vectors without a direction (zero, or not finite) have no distance to go by: they
are compared with every query. So are the vectors for queries without one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import written

#: The pivot of vectors that are compared with every query.
LOOSE = -1
#: Pivots, at most, and what rounded scores may differ by.
PIVOTS, SLACK = 256, 2e-6


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def scored(pairs: DataFrame, measure: str) -> DataFrame:
    score = -distance("vector", "qvector") if measure == "l2" else dot("vector", "qvector") / F.coalesce(F.nullif(norm("vector") * norm("qvector"), F.lit(0.0)), F.lit(1.0))
    return pairs.select("query_id", "id", F.round(score, 6).alias("score"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


class Ringed:
    """Vectors with their pivot and distance from it, and what is known of each pivot."""

    def __init__(self, rows: DataFrame, centres: dict[int, np.ndarray], rings: DataFrame):
        self.rows, self.centres, self.rings = rows, centres, rings


def _points(column: pa.Array) -> list[np.ndarray | None]:
    return [None if x is None or any(y is None for y in x) else np.array(x, np.float64) for x in column.to_pylist()]


def _unit(x: np.ndarray, measure: str) -> np.ndarray | None:
    """The point that stands for a vector; none without a direction."""
    if not np.isfinite(x).all():
        return None
    if measure == "l2":
        return x
    size = np.sqrt((x * x).sum())
    return x / size if size > 0 else None


def _ring(centres: dict[int, np.ndarray], measure: str, column: str, every: bool):
    """Rows with (pivot, far): the nearest pivot and the distance from it, or, of every pivot, a row each. LOOSE without one."""

    def run(frames):
        for batch in frames:
            rows, pivots, far = [], [], []
            for i, x in enumerate(_points(batch.column(column))):
                u = None if x is None else _unit(x, measure)
                own = centres.get(len(x)) if u is not None else None
                if own is None:
                    if x is not None:
                        rows.append(i), pivots.append(LOOSE), far.append(0.0)
                    continue
                d = np.sqrt(np.maximum(((own - u) ** 2).sum(1), 0.0))
                some = range(len(own)) if every else [int(d.argmin())]
                rows += [i] * len(some)
                pivots += [len(x) << 20 | j for j in some]
                far += d[list(some)].tolist()
            kept = batch.select(["query_id"] if every else batch.schema.names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(pivots, pa.int64()), pa.array(far, pa.float64())], [*kept.schema.names, "pivot", "far"])

    return run


def ringed(vectors: DataFrame, measure: str, most: int = PIVOTS) -> Ringed:
    """(id, vector) by pivot, written. Pivots are the vectors whose ids' hashes come first, `most` at most of all sizes."""
    vectors = vectors.where("vector is not null").select("id", "vector")
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").collect()
    centres: dict[int, list] = {}
    for (x,) in first:
        u = None if any(y is None for y in x) else _unit(np.array(x, np.float64), measure)
        if u is not None:
            centres.setdefault(len(u), []).append(u)
    stacks = {size: np.unique(np.stack(x), axis=0) for size, x in centres.items()}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", pivot long, far double"
    rows = written(vectors.mapInArrow(_ring(stacks, measure, "vector", False), schema), "ringed")
    rings = written(rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")), "rings")
    return Ringed(rows, stacks, rings)


def pairs_left(own: Ringed, queries: DataFrame, k: int, measure: str) -> DataFrame:
    """(query_id, id, vector, qvector) of the pairs that may be among a query's k nearest."""
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", "qvector").where("qvector is not null").mapInArrow(_ring(own.centres, measure, "qvector", True), f"query_id {kind}, pivot long, far double")
    # a row for each query and pivot; queries come in parts of a checked size, pivots are bounded
    asked = written(asked.withColumnRenamed("far", "d"), "asked")
    rings = F.broadcast(own.rings)
    loose = asked.where(F.col("pivot") == LOOSE).select("query_id").crossJoin(rings.select("pivot", F.lit(0.0).alias("d"), F.lit(float("inf")).alias("t")))
    each = asked.where(F.col("pivot") != LOOSE).join(rings, "pivot")
    near = F.greatest(F.lit(0.0), F.col("d") - F.col("high"), F.col("low") - F.col("d"))
    order = W.partitionBy("query_id").orderBy("d", "pivot")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = each.withColumn("before", before).where(F.col("before") < k).select("query_id", "pivot", "d", F.lit(float("inf")).alias("t"))
    k_th = _best(scored(_met(own, queries, first), measure), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).where(F.col("found") >= k)
    least = F.col("least") - SLACK
    t = -least if measure == "l2" else F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * least))
    bound = k_th.select("query_id", (t + SLACK).alias("t"))
    second = each.join(bound, "query_id", "left").withColumn("t", F.coalesce("t", F.lit(float("inf")))).where(near <= F.col("t")).select("query_id", "pivot", "d", "t")
    always = queries.select("query_id").crossJoin(F.broadcast(own.rings.where(F.col("pivot") == LOOSE).select("pivot"))).select("query_id", "pivot", F.lit(0.0).alias("d"), F.lit(float("inf")).alias("t"))
    return _met(own, queries, second.unionByName(loose).unionByName(always).dropDuplicates(["query_id", "pivot"]))


def _met(own: Ringed, queries: DataFrame, asked: DataFrame) -> DataFrame:
    at = own.rows.join(F.broadcast(asked.withColumnRenamed("pivot", "p")), F.expr("pivot = p and abs(d - far) <= t"))
    q = F.broadcast(queries.select(F.col("query_id").alias("q"), "qvector"))
    return at.join(q, (F.col("query_id") == F.col("q")) & (F.size("vector") == F.size("qvector"))).select("query_id", "id", "vector", "qvector")


# --- by batches -------------------------------------------------------------------------------------------------------

#: Queries that a batch of vectors is multiplied with at a time.
AT_A_TIME = 512


def _by_size(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, rows, values, lacking) of the vectors of each size that are not null; lacking: those with null components, which
    stand as not a number."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    null = flat.is_null().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = []
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        at = starts[rows][:, None] + np.arange(size)
        out.append((size, rows, values[at], null[at].any(1)))
    return out


@dataclass(frozen=True)
class Asked:
    """Queries of one size. Of each pivot: d, the queries' distances, and whether a query's bound t reaches into it; null without pivots."""

    ids: pa.Array
    points: np.ndarray
    lacking: np.ndarray
    d: np.ndarray | None = None
    reached: np.ndarray | None = None
    t: np.ndarray | None = None


def asked(queries: DataFrame) -> dict[int, Asked]:
    """Queries, of a checked number of bytes, by size."""
    table = queries.select("query_id", "qvector").where("qvector is not null").toArrow().combine_chunks()
    column = lambda name: pa.concat_arrays(table.column(name).chunks) if table.num_rows else table.column(name).combine_chunks()
    return {size: Asked(column("query_id").take(pa.array(rows)), points, lacking) for size, rows, points, lacking in _by_size(column("qvector"))}


def _exact(points: np.ndarray, ri: np.ndarray, asked_points: np.ndarray, qi: np.ndarray, measure: str) -> np.ndarray:
    """Scores of pairs of rows and queries, added up in the order of the components."""
    if len(ri) > 1 << 16:
        parts = range(0, len(ri), 1 << 16)
        return np.concatenate([_exact(points, ri[i : i + (1 << 16)], asked_points, qi[i : i + (1 << 16)], measure) for i in parts])

    def total(a, b):
        out = np.zeros(len(a))
        for j in range(a.shape[1]):
            out = out + a[:, j] * b[:, j]
        return out

    x, q = points[ri], asked_points[qi]
    with np.errstate(all="ignore"):
        if measure == "l2":
            return -np.sqrt(total(x - q, x - q))
        size = np.sqrt(total(x, x)) * np.sqrt(total(q, q))
        return total(x, q) / np.where(size == 0, 1.0, size)


def _millionths(score: np.ndarray) -> np.ndarray:
    """Rounded scores, in millionths, as Spark rounds: halves of the decimal digits go up. What is not a number is the highest."""
    with np.errstate(all="ignore"):
        up = np.abs(score) * 1e6
        out = np.sign(score) * np.floor(up + 0.5)
        near = np.flatnonzero(np.isfinite(up) & (np.abs(up - np.floor(up) - 0.5) < 1e-3))
    for i in near:
        out[i] = float((Decimal(repr(float(score[i]))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(score), np.inf, out)


def _scan(every, k: int, measure: str):
    """(query_id, id, score), not rounded, of batches of (id, vector), and of (pivot, far) if the queries have bounds: all that may be
    among a query's k best, and of each batch no more than k a query."""

    def run(frames):
        least = {size: np.full(len(a.points), -np.inf) for size, a in every.value.items()}
        for batch in frames:
            order = pc.array_sort_indices(batch.column("id"), null_placement="at_start").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            for size, rows, points, lacking in _by_size(batch.column("vector")):
                if size not in every.value:
                    continue
                own = every.value[size]
                pivot = far = None
                if own.t is not None:
                    pivot, far = (batch.column(c).to_numpy()[rows] for c in ("pivot", "far"))
                    by = np.argsort(pivot, kind="stable")
                    rows, points, lacking, pivot, far = rows[by], points[by], lacking[by], pivot[by], far[by]
                for first in range(0, len(own.points), AT_A_TIME):
                    some = slice(first, first + AT_A_TIME)
                    qi, ri = _candidates(own, some, points, pivot, far, k, measure, least[size])
                    score = _exact(points, ri, own.points, qi, measure)
                    none = lacking[ri] | own.lacking[qi]
                    keys = np.where(none, -np.inf, _millionths(score))
                    sort = np.lexsort((place[rows[ri]], -keys, qi))
                    qi, ri, score, none = qi[sort], ri[sort], score[sort], none[sort]
                    begins = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, int)
                    nth = np.arange(len(qi)) - np.repeat(begins, np.diff(np.r_[begins, len(qi)]))
                    kept = nth < k
                    yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(qi[kept])), batch.column("id").take(pa.array(rows[ri[kept]])), pa.array(score[kept], mask=none[kept])], ["query_id", "id", "score"])

    return run


def _candidates(own: Asked, some: slice, points, pivot, far, k: int, measure: str, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and of rows of the pairs that may be among the k best. least: what each query's k-th best of this task comes to,
    at least; it is raised."""
    q, low = own.points[some], least[some]
    with np.errstate(all="ignore"):
        xx, qq = (points * points).sum(1), (q * q).sum(1)
        odd, odd_q = ~(xx < 1e300), ~(qq < 1e300)
        x, y = np.where(odd[:, None], 0.0, points), np.where(odd_q[:, None], 0.0, q)
        xx, qq = np.where(odd, 0.0, xx), np.where(odd_q, 0.0, qq)
        if measure == "cosine":
            x, y = x / np.where(xx > 0, np.sqrt(xx), 1.0)[:, None], y / np.where(qq > 0, np.sqrt(qq), 1.0)[:, None]
    near = np.full((len(q), len(x)), -np.inf)
    stretches = [(0, len(x), None)]
    if pivot is not None:
        ends = np.flatnonzero(np.r_[pivot[1:] != pivot[:-1], True]) + 1
        stretches = [(s, e, pivot[s]) for s, e in zip(np.r_[0, ends[:-1]], ends)]
    for s, e, p in stretches:
        at = np.arange(len(q))
        if p is not None and p != LOOSE:
            at = np.flatnonzero(own.reached[some, p & 0xFFFFF])
            if not len(at):
                continue
        score = y[at] @ x[s:e].T
        if measure == "l2":
            score = 2 * score - qq[at][:, None] - xx[s:e][None]
        if p is not None and p != LOOSE:
            out = ~(np.abs(own.d[some, p & 0xFFFFF][at][:, None] - far[s:e][None]) <= own.t[some][at][:, None])
            score[out] = -np.inf
        near[at, s:e] = score

    def slackened(v):
        # by what the product, and the rounded score, may differ
        if measure == "cosine":
            return v - SLACK
        error = 1e-12 * (xx.max(initial=0.0) + qq)
        return -((np.sqrt(np.maximum(-v, 0.0) + error) + SLACK) ** 2) - error

    near[:, odd] = -np.inf
    maybe = near >= np.where(np.isneginf(low), -np.inf, slackened(low))[:, None]
    maybe &= ~np.isneginf(near)
    many = np.flatnonzero(maybe.sum(1) > 2 * k) if near.shape[1] > k else []
    if len(many):
        k_th = np.partition(near[many], near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        low[many] = np.maximum(low[many], k_th)
        bound = np.where(np.isneginf(low), -np.inf, slackened(low))
        maybe[many] &= near[many] >= bound[many][:, None]
    # what has no distance to go by is compared with everything
    maybe[:, odd] = True
    maybe[odd_q] = True
    qi, ri = np.nonzero(maybe)
    return qi + some.start, ri


def scanned(rows: DataFrame, every: dict[int, Asked], queries: DataFrame, k: int, measure: str) -> DataFrame:
    """(query_id, id, score) with each query's k best of these rows, and rank."""
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(every)
    found = rows.mapInArrow(_scan(sent, k, measure), f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return _best(found.withColumn("score", F.round("score", 6)), k)


def knn(own: Ringed, queries: DataFrame, k: int, measure: str) -> DataFrame:
    """The k best by both rounds; queries come in parts of a checked size."""
    rings = {r["pivot"]: r for r in own.rings.collect()}  # a row for each pivot
    first, every = {}, asked(queries)
    for size, a in every.items():
        centres = own.centres.get(size, np.zeros((0, size)))
        units = [None if lacking else _unit(x, measure) for x, lacking in zip(a.points, a.lacking)]
        loose = np.array([u is None for u in units], bool)
        at = np.stack([np.zeros(size) if u is None else u for u in units])
        d = np.stack([np.sqrt(((at - c) ** 2).sum(1)) for c in centres], 1) if len(centres) else np.zeros((len(at), 0))
        n, low, high = (np.array([rings[size << 20 | j][c] if size << 20 | j in rings else (0 if c == "n" else np.inf) for j in range(len(centres))], float) for c in ("n", "low", "high"))
        order = np.argsort(d, axis=1, kind="stable")
        before = np.empty_like(d)
        np.put_along_axis(before, order, np.cumsum(n[order], 1) - n[order], 1)
        t = np.full(len(at), np.inf)
        first[size] = replace(a, d=d, reached=(before < k) | loose[:, None], t=t)
        with np.errstate(all="ignore"):
            near = np.maximum(0.0, np.maximum(d - high, low - d))
        every[size] = replace(a, d=d, reached=near, t=np.where(loose, np.inf, -1.0))
    k_th = scanned(own.rows, first, queries, k, measure).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).where(F.col("found") >= k)
    least = F.col("least") - SLACK
    bound = -least if measure == "l2" else F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * least))
    bounds = {r[0]: r[1] for r in k_th.select("query_id", (bound + SLACK).alias("t")).collect()}  # a number for each query of the part
    for size, a in every.items():
        t = np.array([bounds.get(i) for i in a.ids.to_pylist()], float)
        t = np.where(np.isnan(t) | np.isinf(a.t), np.inf, t)
        every[size] = replace(a, t=t, reached=(a.reached <= t[:, None]) | np.isinf(t)[:, None])
    return scanned(own.rows, every, queries, k, measure)
