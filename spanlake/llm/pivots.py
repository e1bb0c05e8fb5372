"""Operator 4: exact top-k inner products with a pivot-distance index.

One added coordinate gives all vectors the same norm, so that the largest inner
product is the smallest distance.  Every vector is keyed by its nearest pivot
and its distance to it; annuli of that distance are the cells.  A query first
searches the annulus nearest to it, which gives a k-th distance; by the
triangle inequality, an annulus around pivot p can hold a better vector only if
its radii come within that distance of the query's own distance to p.  Inside a
task, a block's sorted distances are expanded outwards from the query's in the
same way.  All scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm import search as SE
from spanlake.llm import tables as TA

PIVOTS = 32
MAX_ANNULI = SE.MAX_CELLS // PIVOTS
LEAF = 64
WIDEST = 1 << 28   # whole-number components are held to this range, so that scores fit a long
NONE = np.int64(-(1 << 62))


def whole(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, vec`` with components ``floor(scale * x)`` as doubles of whole value."""
    v = F.transform("vec", lambda x: F.greatest(F.lit(-float(WIDEST)), F.least(F.lit(float(WIDEST)), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x * scale))).cast("double"))))
    return SE.clean_vectors(df, id_col, vector_col).select("id", v.alias("vec"))


def centres(points: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Pivots: means of a few rounds of nearest-centre assignment over the sample."""
    points = np.unique(points, axis=0)
    c = points[np.random.default_rng(seed).permutation(len(points))[:n]]
    for _ in range(5):
        own = np.argmin(((c * c).sum(axis=1) - 2 * points @ c.T), axis=1)
        c = np.array([points[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c


def distances(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = (points * points).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * points @ c.T
    return np.sqrt(np.maximum(out, 0))


def top_products(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of ``floor(scale * x)`` vectors, exactly.

    A query never finds its own id; ties go to the smaller id.  Vectors (and
    queries) that are null, of another length than the longest, or hold null or
    non-finite components take no part, zero vectors do; components beyond
    ``WIDEST`` after scaling count as that; repeated rows count once; empty
    tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    data = whole(vectors, id_col, vector_col, scale)
    size2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, top, dim, big = data.agg(F.count("*"), F.max(size2), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    out_type = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    if not n:
        return spark.createDataFrame([], out_type)
    data = data.where(F.size("vec") == dim)
    asks = whole(queries, id_col, vector_col, scale).where(F.size("vec") == dim)
    norm = math.sqrt(top)
    slack = 1e-6 * max(norm, 1.0)   # far above the rounding error of a distance
    block = SE.rows_per_block(n)
    in_double = dim * max(big, 1.0) ** 2 < 2 ** 53   # whole numbers stay exact in double products

    def lifted(x: np.ndarray, is_query: bool) -> np.ndarray:
        s2 = (x * x).sum(axis=1)
        if is_query:
            s = np.where(s2 > 0, norm / np.sqrt(np.maximum(s2, 1e-300)), 1.0)
            return np.column_stack((x * s[:, None], np.zeros(len(x))))
        return np.column_stack((x, np.sqrt(np.maximum(top - s2, 0))))

    sample = lifted(SE.sample_matrix(data), False)
    pivots = centres(sample, PIVOTS)
    near = distances(sample, pivots)
    own = near.argmin(axis=1)
    rings = max(1, min(MAX_ANNULI, math.ceil(n / (block * len(pivots)))))
    edge = np.array([np.quantile(near[own == p, p], np.arange(1, rings) / rings) if (own == p).any() else np.zeros(rings - 1) for p in range(len(pivots))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(SE.matrix(batch.column(1)), False), pivots)
                p = d.argmin(axis=1)
                r = d[np.arange(len(d)), p]
                ring = (r[:, None] > edge[p]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array((p * rings + ring).astype(np.int32)), *batch.columns, pa.array(r)], names=["cell", "id", "vec", "r"])

    data = data.mapInArrow(place, "cell int, id long, vec array<double>, r double")
    cells = data.groupBy("cell").agg(F.count("*").alias("c"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()  # at most MAX_CELLS rows
    number = np.array([c["cell"] for c in cells], np.int32)
    low, high = np.array([c["lo"] for c in cells]), np.array([c["hi"] for c in cells])
    counts = {c["cell"]: c["c"] for c in cells}

    def far_from(qx: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Distance of a score; infinite where there is none."""
        s2 = (qx * qx).sum(axis=1)
        known = worst > NONE
        with_norm = np.sqrt(np.maximum(2 * top - 2 * norm / np.sqrt(np.maximum(s2, 1e-300)) * np.where(known, worst, 0), 0))
        return np.where(known, np.where(s2 > 0, with_norm, norm), np.inf)

    def search(d: dict, q: dict):
        r = d["r"].to_numpy()
        order = np.argsort(r, kind="stable")
        x, ids, r = SE.matrix(d["vec"])[order], d["id"].to_numpy()[order], r[order]
        qx, qid, qr = SE.matrix(q["vec"]), q["id"].to_numpy(), q["qr"].to_numpy()
        start = q["far"].to_numpy()
        leaves = [np.arange(a, min(a + LEAF, len(r))) for a in range(0, len(r), LEAF)]
        lo, hi = np.array([r[a[0]] for a in leaves]), np.array([r[a[-1]] for a in leaves])
        bound = np.maximum(np.maximum(lo - qr[:, None], qr[:, None] - hi), 0)
        best = SE.Best(len(qx), k, np.int64, NONE)

        def limit(rows):
            return np.minimum(start[rows], far_from(qx[rows], best.worst()[rows])) + slack

        def scores(rows, own):
            s = (qx[rows] @ x[own].T).astype(np.int64) if in_double else qx[rows].astype(np.int64) @ x[own].astype(np.int64).T
            s[qid[rows][:, None] == ids[own]] = NONE
            return s

        SE.expand(bound, leaves, limit, scores, ids, best)
        return best.found(q["least"].to_numpy())

    def route(nearest_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    qx = SE.matrix(part.column(1))
                    qr = distances(lifted(qx, True), pivots)[:, number // rings]
                    gap = np.maximum(np.maximum(low - qr, qr - high), 0)
                    if nearest_only:
                        far, worst = np.full(len(qx), np.inf), np.full(len(qx), NONE)
                        row, cell = np.arange(len(qx)), np.lexsort((np.broadcast_to(number, qr.shape), qr, gap), axis=1)[:, 0]
                    else:
                        worst = part.column(2).fill_null(int(NONE)).to_numpy()
                        far = far_from(qx, worst)
                        row, cell = np.nonzero(gap <= (far + slack)[:, None])
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(number[cell]), part.column(0).take(take), part.column(1).take(take), pa.array(qr[row, cell]), pa.array(far[row]), pa.array(worst[row])],
                                                     names=["cell", "id", "vec", "qr", "far", "least"])
        return run

    schema = "cell int, id long, vec array<double>, qr double, far double, least long"
    home = asks.mapInArrow(route(True), schema)
    first = SE.ranked(SE.blocked_search(data, home, counts, SE.cell_counts(home), block, search, T.LongType()), k)
    kth = TA.written(first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth")), "kth")
    routed = asks.join(kth, "id", "left").select("id", "vec", "kth").mapInArrow(route(False), schema)
    return SE.ranked(SE.blocked_search(data, routed, counts, SE.cell_counts(routed), block, search, T.LongType()), k)
