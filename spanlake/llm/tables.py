"""Intermediate tables, sorted groups inside tasks, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.session import scratch_dir


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read again (cuts the lineage); its shuffle files go when it is written."""
    path = scratch_dir(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT_KEYS = 1024


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values`` (one row per key) without a hot task.

    ``weight`` says how many rows have the key.  The ``HOT_KEYS`` heaviest keys,
    a fixed number, are broadcast; no key of the rest has more than a
    ``1 / HOT_KEYS`` part of all rows and they meet by a plain equi-join.  Both
    sides are read twice: pass written tables.
    """
    hot = values.orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    hot = written(hot, "hot")
    names = F.broadcast(hot.select(*keys))
    rest = rows.join(names, keys, "left_anti").join(values.join(names, keys, "left_anti"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def sorted_groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of one group at a time, from batches sorted by a non-null long ``column``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        if held and held[0].column(column)[0].as_py() != ids[0]:
            yield _joined(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield _joined([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


EDGES = 1 << 20   # links whose forest one task builds at a time (16 MB)


def contracted(edges: DataFrame) -> DataFrame:
    """``u, v`` (u > v): for every ``EDGES`` links ``u, v`` of a task, those from each node to the smallest of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, EDGES):
                part = batch.slice(lo, EDGES)
                if size + part.num_rows > EDGES:
                    yield forest(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield forest(held)

    def forest(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        trees = Forest(len(nodes))
        for x, y in zip(at[:len(u)].tolist(), at[len(u):].tolist(), strict=True):
            trees.join(x, y)
        stars = np.array(trees.stars(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(nodes[stars[:, 0]]), pa.array(nodes[stars[:, 1]])], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of undirected ``a, b`` edges of longs.

    Every task first replaces its links by a forest.  While more than ``EDGES``
    are left, large-star and small-star steps alternate, each round two
    equi-joins and minimum aggregates, contracted in its tasks and cut by a
    written table; the last ``EDGES`` or fewer meet in one task.  A node of
    very many edges is pre-aggregated before its shuffle and its join side can
    be split.  Null ends and self loops are ignored; no edges give no rows.
    """
    e = written(contracted(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    for _ in range(max_rounds):
        if e.count() <= EDGES:
            e = written(contracted(e.coalesce(1)), "stars")
            break
        if _is_star_forest(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(contracted(low.select("u", F.col("m").alias("v")).unionByName(hung).distinct()), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _is_star_forest(e: DataFrame) -> bool:
    """Whether every node has at most one smaller neighbour and no node has both smaller and larger ones."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


class Forest:
    """Union-find over row numbers inside a task; a tree's root is its smallest row."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def stars(self) -> list[tuple[int, int]]:
        """Every row that is not a root, with its root."""
        return [(i, r) for i in range(len(self.up)) if (r := self.root(i)) != i]
