"""Operator 1: approximate nearest neighbours by stable projections in a kd-tree.

Inner-product search becomes Euclidean by one added coordinate that gives all
vectors the largest norm; queries are scaled to it.  Vectors are projected to
``DIMS`` Gaussian (2-stable) dimensions, in which the squared distance of a
pair, divided by its true squared distance, follows a chi-square law.  A
kd-tree over the projections is split between cells (its upper levels, fitted
on a bounded sample) and blocks (its lower levels, built in tasks).  A query
first takes its own cell, for a ``k``-th distance, then verifies on the full
vectors all projected neighbours but those so far away that the chi-square
probability of meeting a better vector nearer by reaches ``CONFIDENCE``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm import search as SE
from spanlake.llm import tables as TA

DIMS = 8            # even, for the closed form of the chi-square law
CONFIDENCE = 0.97   # expected recall is at least this
LEAF = 64
BLOCK = 1 << 21     # components of a block of vectors or queries (16 MB)
GROUP = 2048        # vectors, and
CHUNK = 1024        # queries, scored at a time
PIECE = 1 << 16     # pairs scored exactly at a time


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function of the chi-square law with ``DIMS`` degrees of freedom."""
    h = np.minimum(np.asarray(x, np.float64) / 2, 700.0)
    return 1 - np.exp(-h) * sum(h ** i / math.factorial(i) for i in range(DIMS // 2))


def reach() -> float:
    """Ratio of squared projected to true distance at which the stopping test holds."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid) < CONFIDENCE else (lo, mid)
    return hi


def split_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimensions and thresholds of a complete kd-tree (heap order), at medians of the widest dimension."""
    dim, cut = np.zeros(2 ** depth, np.int64), np.zeros(2 ** depth)
    parts = {1: points}
    for node in range(1, 2 ** depth):
        own = parts.pop(node)
        if len(own):
            dim[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            cut[node] = np.median(own[:, dim[node]])
        low = own[:, dim[node]] <= cut[node]
        parts[2 * node], parts[2 * node + 1] = own[low], own[~low]
    return dim, cut


def cell_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    node = np.ones(len(points), np.int64)
    for _ in range(depth):
        node = 2 * node + (points[np.arange(len(points)), tree[0][node]] > tree[1][node])
    return node - 2 ** depth


def kd_leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a block's own kd-tree."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        wide = int(np.argmax(points[own].max(axis=0) - points[own].min(axis=0)))
        half = len(own) // 2
        order = np.argpartition(points[own, wide], half)
        todo += [own[order[:half]], own[order[half:]]]
    return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (queries x dims) to boxes (boxes x dims)."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[:, j] - q[:, j, None], q[:, j, None] - high[:, j]), 0)
        out += gap * gap
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products added up component by component: equal vectors score alike wherever they lie."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += a[:, j, None] * b[:, j]
    return out


def exact(qx: np.ndarray, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """:func:`inner` of the pairs ``qx[row], x[at]``."""
    out = np.zeros(len(row))
    for lo in range(0, len(row), PIECE):
        a, b = qx[row[lo:lo + PIECE]], x[at[lo:lo + PIECE]]
        for j in range(x.shape[1]):
            out[lo:lo + PIECE] += a[:, j] * b[:, j]
    return out


def first_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that ``k`` equal vectors of smaller ids stand before, whichever id a query may not find."""
    _, same = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    often = np.unique(ids, return_counts=True)[1].max()
    return np.sort(order[rank < k + often])


def closest(qx: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, admit: Callable[[slice], np.ndarray],
            least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows (ascending), ids and inner products of every query's ``k`` best vectors in its admitted leaves (ties to the smaller id).

    ``leaf`` numbers the vectors' leaves, ascending; ``admit`` gives a chunk of
    queries x leaves; products below ``least`` do not count.  Products in single
    precision leave out pairs that cannot count, however they were rounded;
    all others are computed as ``inner`` does.
    """
    size, big = np.sqrt((qx * qx).sum(axis=1)), np.sqrt((x * x).sum(axis=1).max())
    q1, x1 = (qx / size[:, None]).astype(np.float32), (x / big).astype(np.float32)
    slack = (x.shape[1] + 8) * 2.0 ** -23   # of unit vectors' products
    out = []
    for lo in range(0, len(qx), CHUNK):
        part = slice(lo, min(lo + CHUNK, len(qx)))
        admitted, unit = admit(part), size[part] * big
        floor = least[part] / unit - slack
        row, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for a in range(0, len(x), GROUP):
            b = min(a + GROUP, len(x))
            on = np.flatnonzero(admitted[:, leaf[a]:leaf[b - 1] + 1].any(axis=1))
            if not len(on):
                continue
            s = q1[part][on] @ x1[a:b].T
            new = np.flatnonzero(np.isneginf(floor[on]))
            if len(new) and b - a > k:   # nothing is known yet: the k-th product here is a first floor
                known = np.where(admitted[on[new]][:, leaf[a:b]] & (qid[part][on[new]][:, None] != ids[a:b]), s[new], -np.inf)
                floor[on[new]] = -np.partition(-known, k - 1, axis=1)[:, k - 1].astype(np.float64) - 2 * slack
            r, c = np.nonzero(s >= floor[on][:, None])
            r, c = on[r], a + c
            fine = admitted[r, leaf[c]] & (qid[part][r] != ids[c])
            r, c = r[fine], c[fine]
            row, at, score = np.concatenate((row, r)), np.concatenate((at, c)), np.concatenate((score, exact(qx[part], x, r, c)))
            if len(row) > 2 * k * len(admitted) or b == len(x):
                row, at, score = _best(row, at, score, ids, k)
                kth = np.flatnonzero(np.bincount(row, minlength=len(admitted)) == k)
                last = np.searchsorted(row, kth, side="right") - 1
                floor[kth] = np.maximum(floor[kth], score[last] / unit[kth] - slack)
        row, at, score = _best(row, at, score, ids, k)
        reach = score >= least[part][row]
        out.append((lo + row[reach], ids[at[reach]], score[reach]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def _best(row: np.ndarray, at: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    kept = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row)))) < k
    return row[kept], at[kept], score[kept]


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, seed: int = 3) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for every query.

    Scores are exact (double precision, original vectors); which vectors are
    found is approximate, with expected recall of at least ``CONFIDENCE``.  A
    query never finds its own id.  Vectors (and queries) that are null, zero,
    of another length than the longest, or hold null or non-finite components
    take no part; ties go to the smaller id; repeated rows count once; empty
    tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    data = SE.clean_vectors(vectors, id_col, vector_col, single=True)
    data = data.withColumn("n2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).where("n2 > 0")
    n, top, dim = data.agg(F.count("*"), F.max("n2"), F.max(F.size("vec"))).first()
    out_type = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not n:
        return spark.createDataFrame([], out_type)
    data = data.where(F.size("vec") == dim).select("id", "vec")
    asks = SE.clean_vectors(queries, id_col, vector_col, single=True).where((F.size("vec") == dim) & F.exists("vec", lambda x: x != 0))
    norm = math.sqrt(top)
    axes = np.random.default_rng(seed).standard_normal((dim + 1, DIMS))
    wide = max(1, BLOCK // dim)
    block = min(wide, max(512, -(-n // 32)))   # large, so that queries are sent to few blocks
    depth = max(0, min(SE.MAX_CELLS.bit_length() - 1, math.ceil(math.log2(max(1, n / block)))))

    def project(x: np.ndarray, is_query: bool) -> np.ndarray:
        size = np.sqrt((x * x).sum(axis=1))
        if is_query:
            return (x * (norm / size)[:, None]) @ axes[:-1]
        return x @ axes[:-1] + np.sqrt(np.maximum(top - size * size, 0))[:, None] * axes[-1]

    def doubles(column) -> np.ndarray:
        return SE.matrix(column).astype(np.float64)

    tree = split_tree(project(SE.sample_matrix(data).astype(np.float64), False), depth)

    def place(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = cell_of(project(doubles(batch.column(1)), is_query), tree, depth)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1)], names=["cell", "id", "vec"])
        return run

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = project(doubles(batch.column(2)), False)
                cell, at, c = np.unique(batch.column(0).to_numpy(), return_inverse=True, return_counts=True)
                low, high = np.full((len(cell), DIMS), np.inf), np.full((len(cell), DIMS), -np.inf)
                np.minimum.at(low, at, y)
                np.maximum.at(high, at, y)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(c, pa.int64()), SE.lists(low), SE.lists(high)], names=["cell", "c", "low", "high"])

    # vectors travel as they are; projections are cheaper to make again than to send
    schema = T.StructType([T.StructField("cell", T.IntegerType()), data.schema["id"], data.schema["vec"]])
    asked = T.StructType([T.StructField("cell", T.IntegerType()), asks.schema["id"], asks.schema["vec"]])
    data, asks = data.mapInArrow(place(False), schema), asks.mapInArrow(place(True), asked)
    each = [f(F.col(side)[j]).alias(f"{name}{j}") for j in range(DIMS) for name, side, f in (("lo", "low", F.min), ("hi", "high", F.max))]
    cells = data.mapInArrow(extents, "cell int, c long, low array<double>, high array<double>").groupBy("cell").agg(F.sum("c").alias("c"), *each).collect()  # at most MAX_CELLS rows
    number = np.array([r["cell"] for r in cells], np.int32)
    low, high = (np.array([[r[f"{w}{j}"] for j in range(DIMS)] for r in cells]) for w in ("lo", "hi"))
    counts = {r["cell"]: r["c"] for r in cells}
    ratio = reach()

    def search(d: dict, q: dict):
        x, ids = doubles(d["vec"]), d["id"].to_numpy()
        qx, qid = doubles(q["vec"]), q["id"].to_numpy()
        start, y = q["far"].to_numpy(zero_copy_only=False), project(x, False)
        leaves = kd_leaves(y)
        low, high = np.array([y[r].min(axis=0) for r in leaves]), np.array([y[r].max(axis=0) for r in leaves])
        first = np.zeros(len(x), bool)
        first[first_copies(x, ids, k)] = True
        kept = [r[first[r]] for r in leaves]
        order, leaf = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(r) for r in kept])

        def admit(part: slice) -> np.ndarray:
            return box_distance(project(qx[part], True), low, high) <= (ratio * start[part] * (1 + 1e-9))[:, None]

        return closest(qx, qid, x[order], ids[order], leaf, admit, q["least"].to_numpy(), k)

    def searched(routed: DataFrame) -> DataFrame:
        # a cell may be somewhat larger than a block without being cut in two
        return SE.ranked(SE.blocked_search(data, routed, counts, SE.cell_counts(routed), block * 3 // 2, search, T.DoubleType(), wide, alone=True), k)

    # first the query's own cell, for a first k-th distance; then all cells that the test does not exclude
    home = asks.withColumns({"far": F.lit(float("inf")), "least": F.lit(float("-inf"))})
    home = home.join(spark.createDataFrame([(int(c),) for c in number], "cell int"), "cell", "left_semi")
    first = searched(home)
    kth = TA.written(first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth")), "kth")
    asks = asks.join(kth, "id", "left").select("cell", "id", "vec", "kth")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                qx = doubles(part.column(2))
                worst = part.column(3).to_numpy(zero_copy_only=False)
                far = 2 * top - 2 * norm / np.sqrt((qx * qx).sum(axis=1)) * worst
                far = np.where(np.isnan(far), np.inf, np.maximum(far, 0))
                row, cell = np.nonzero(box_distance(project(qx, True), low, high) <= (ratio * far * (1 + 1e-9))[:, None])
                take = pa.array(row)
                least = np.where(np.isnan(worst), -np.inf, worst)   # the final k-th score is no smaller
                yield pa.RecordBatch.from_arrays([pa.array(number[cell]), *(part.column(i).take(take) for i in (1, 2)), pa.array(far[row]), pa.array(least[row])],
                                                 names=["cell", "id", "vec", "far", "least"])

    routed = asks.mapInArrow(route, T.StructType([*asked.fields, T.StructField("far", T.DoubleType()), T.StructField("least", T.DoubleType())]))
    return searched(routed)
