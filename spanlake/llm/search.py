"""Shared parts of operators 1 and 4: vectors dealt to cells, searched in blocks.

An index assigns every vector to one of a bounded number of cells.  A query is
sent to the cells its bounds do not rule out; inside a task, a block of a
cell's vectors meets a block of queries.  Blocks hold a bounded number of rows
whatever the cell's size (many equal vectors fall into one cell), so no key is
one task and no pair of rows is ever a table row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm import tables as TA

QUERY_BLOCK = 512
SAMPLE = 8192      # rows an index is fitted on
MAX_CELLS = 1024


def clean_vectors(df: DataFrame, id_col: str, vector_col: str, single: bool = False) -> DataFrame:
    """``id, vec`` (array<double>; with ``single`` array<float> where it is one) without null, empty or not fully finite vectors, and without null ids."""
    v = F.col(vector_col)
    if not (single and df.schema[vector_col].dataType.simpleString() == "array<float>"):
        v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where((F.size("vec") > 0) & fine)


def matrix(column) -> np.ndarray:
    """Rows of equal length of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(m: np.ndarray) -> pa.Array:
    rows, width = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width) if width else np.zeros(rows + 1, int), pa.int32()), pa.array(m.ravel()))


def rows_per_block(n: int) -> int:
    """Rows of a data block: larger for larger tables, so that queries are sent to fewer of them."""
    return min(8192, max(512, n // 128))


def sample_matrix(vectors: DataFrame) -> np.ndarray:
    """At most ``SAMPLE`` vectors, the first in order of a hash of the id, for fitting an index."""
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    return matrix(got.column(0))


def blocked_search(data: DataFrame, queries: DataFrame, counts: dict[int, int], asked: dict[int, int], block: int,
                   search: Callable[[dict, dict], tuple[np.ndarray, np.ndarray, np.ndarray]], score_type: T.DataType,
                   query_block: int = QUERY_BLOCK, alone: bool = False) -> DataFrame:
    """``query_id, ids, scores`` (one row, with lists) of the best that each query finds in each block of its cells.

    ``data``: ``cell, id`` and its columns; ``queries``: ``cell, id`` and its
    columns, one row per cell to visit; ``counts`` and ``asked`` give the rows of
    either per cell (bounded tables: one entry per cell).  ``search(data,
    queries)`` gets dictionaries of Arrow columns and returns query row numbers
    (ascending), vector ids and scores.  With ``alone`` few pairs of blocks share
    a task, for blocks that are much work each.
    """
    nd = {c: -(-n // block) for c, n in counts.items()}
    nq = {c: -(-n // query_block) for c, n in asked.items() if c in nd}

    def mapped(m: dict[int, int]) -> Column:
        keys = sorted(m) or [-1]
        return F.element_at(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.lit(m.get(k, 0)) for k in keys))), F.col("cell"))

    def dealt(df: DataFrame, own: dict[int, int], other: dict[int, int], side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col("_own")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col("_other") - 1)).alias("_o")
        df = df.withColumns({"_own": mapped(own), "_other": mapped(other)}).where("_own > 0 and _other > 0")
        df = df.select("*", mine.alias("_m"), each)
        place = ["cell", "_m", "_o"] if side == 0 else ["cell", "_o", "_m"]
        return df.select(F.xxhash64(*place).alias("g"), F.lit(side).alias("side"), *[c for c in df.columns if c not in ("cell", "_own", "_other", "_m", "_o")])

    left, right = dealt(data, nd, nq, 0), dealt(queries, nq, nd, 1)
    both = left.unionByName(right, allowMissingColumns=True)
    names = both.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in TA.sorted_groups(batches):
            is_query = pc.equal(group.column(1), 1)
            q, d = group.filter(is_query), group.filter(pc.invert(is_query))
            if not q.num_rows or not d.num_rows:
                continue
            row, vec_id, score = search(dict(zip(names, d.columns, strict=True)), dict(zip(names, q.columns, strict=True)))
            own = np.unique(row)
            at = pa.array(np.append(np.searchsorted(row, own), len(row)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(q.column(2).to_numpy()[own]), pa.ListArray.from_arrays(at, pa.array(vec_id)),
                                              pa.ListArray.from_arrays(at, pa.array(score))], names=["query_id", "ids", "scores"])

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(score_type))])
    pairs = sum(nd[c] * nq[c] for c in nq)
    both = both.repartition(min(4 * pairs, MAX_CELLS), "g") if alone and pairs > 1 else both.repartition("g")
    return both.sortWithinPartitions("g").mapInArrow(run, schema)


class Best:
    """The ``k`` best scores of each query so far (larger first, ties to the smaller id)."""

    def __init__(self, n: int, k: int, dtype, none):
        self.score = np.full((n, k), none, dtype)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.none = none

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``score`` (rows x m) of the vectors ``ids`` (m) to the queries ``rows``; ``none`` marks no candidate."""
        k = self.score.shape[1]
        if score.shape[1] > 4 * k:  # keep what reaches the k-th score, ties included
            cut = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            some = np.flatnonzero((score >= cut[:, None]).any(axis=0))
            score, ids = score[:, some], ids[some]
        score = np.concatenate((self.score[rows], score), axis=1)
        own = np.concatenate((self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))), axis=1)
        own = np.where(score == self.none, np.iinfo(np.int64).max, own)
        order = np.lexsort((own, -score), axis=1)[:, :k]
        self.score[rows], self.ids[rows] = np.take_along_axis(score, order, axis=1), np.take_along_axis(own, order, axis=1)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def found(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, ids and scores of what reaches each query's ``least`` score."""
        row, col = np.nonzero((self.ids < np.iinfo(np.int64).max) & (self.score >= least[:, None]))
        return row, self.ids[row, col], self.score[row, col]


def expand(bound: np.ndarray, leaves: list[np.ndarray], limit: Callable[[np.ndarray], np.ndarray],
           scores: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray, best: Best) -> None:
    """Each query takes leaves in order of its lower bound (queries x leaves) until the bound exceeds its limit.

    Queries whose next leaf is the same are scored together.  ``limit(rows)``
    follows the best scores found so far.
    """
    order = np.argsort(bound, axis=1, kind="stable")
    active = np.arange(len(bound))
    for step in range(len(leaves)):
        leaf = order[active, step]
        go = bound[active, leaf] <= limit(active)
        active, leaf = active[go], leaf[go]
        if not len(active):
            return
        for one in np.unique(leaf).tolist():
            rows = active[leaf == one]
            best.add(rows, scores(rows, leaves[one]), ids[leaves[one]])


def cell_counts(df: DataFrame) -> dict[int, int]:
    """Rows per cell: at most ``MAX_CELLS`` entries."""
    return {r[0]: r[1] for r in df.groupBy("cell").count().collect()}


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best over all blocks (repeated rows of a vector count once)."""
    score_type = found.schema["scores"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in TA.sorted_groups(batches):
            ids, score = (group.column(i).flatten().to_numpy() for i in (1, 2))
            order = np.lexsort((ids, -score))
            ids, score = ids[order], score[order]
            new = np.append(True, (ids[1:] != ids[:-1]) | (score[1:] != score[:-1]))
            ids, score = ids[new][:k], score[new][:k]
            query = np.full(len(ids), group.column(0)[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.arange(1, len(ids) + 1, dtype=np.int32)), pa.array(ids), pa.array(score)],
                                             names=["query_id", "rank", "vec_id", "score"])

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", score_type)])
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, schema)
