"""Operator 8: near-duplicate documents by MinHash with tensored banding.

``m`` short collections of ``a`` minhashes are computed for a left and a right
side; the key of table (i, j) joins left collection i with right collection j,
so ``m * m`` tables of ``2 * a`` minhashes each cost only ``2 * m * a``
minhashes.  Two sets of similarity s miss every table with probability at most
``2 * (1 - s**a)**m``; with the default a=3, m=9 that is 4e-4 at s=0.85 and
2e-5 at s=0.9.

Links come from exact comparison only, and no table of pairs is ever made:

1. equal sets are one class (grouped by set fingerprint and size);
2. in each table bucket every class is compared with the bucket's hub by the
   share of equal minhashes (the cut lies far below what linked sets show), and
   the classes that differ from the hub among themselves, block by block; those
   still outside the hub's component then meet all that is alike to the hub;
   each gives a number of links linear in the rows, and their components are
   candidate clusters;
3. within a cluster, full sets are compared exactly, block against block inside
   tasks, and each block returns a forest of links; in a cluster of many blocks
   the rows linked to its first row need not meet each other, and where blocks
   would copy rows more often than that, only rows meet that share one of their
   rarest shingles, as every linked pair does;
4. components of the exact links give each document's group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm import collocations as CO
from spanlake.llm import tables as TA
from spanlake.llm import textbytes as TB
from spanlake.session import shuffle_partitions

U64 = np.uint64
BLOCK = 512  # rows of a block that is compared pair by pair
FREQUENT = (32, 1024)  # more rows than these hold a shingle that is frequent, very frequent


@dataclass(frozen=True)
class Similarity:
    """Word ``shingle`` sets are linked when ``100 * intersection >= percent * union``."""

    shingle: int = 5
    percent: int = 80
    lower: bool = True

    def agreement(self, hashes: int) -> int:
        """Equal minhashes that a linked pair shows but for odds below 1e-6 (five standard deviations)."""
        s = self.percent / 100
        return max(1, int(hashes * s - 5 * (hashes * s * (1 - s)) ** 0.5))


def multipliers(n: int, seed: int) -> np.ndarray:
    return TB.mix(np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) | U64(1)


def minhashes(values: np.ndarray, offsets: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over each row's shingles (rows without any: all ones)."""
    n = len(offsets) - 1
    out = np.full((n, len(mult)), np.iinfo(U64).max, U64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        first = offsets[some]
        for h, a in enumerate(mult):
            out[some, h] = np.minimum.reduceat(values * a, first)
    return TB.mix(out)


def set_facts(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit order-free fingerprint of each row's distinct shingles."""
    n = len(offsets) - 1
    size, fa, fb = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
    at = offsets.tolist()
    for i in range(n):
        if at[i + 1] > at[i]:
            u = np.unique(values[at[i]:at[i + 1]])
            size[i] = len(u)
            fa[i] = np.add.reduce(u)
            fb[i] = np.add.reduce(TB.mix(u ^ U64(0xA0761D6478BD642F)))
    return size, fa.view(np.int64), fb.view(np.int64)


def collection_keys(mins: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of consecutive collections of ``width`` minhashes."""
    rows, n = mins.shape
    parts = mins.reshape(rows, n // width, width)
    return TB.mix((parts * multipliers(width, 77)).sum(axis=2, dtype=U64)).view(np.int64)


def features(docs: DataFrame, carry: list[str], text_col: str, sim: Similarity, n_hashes: int, width: int,
             min_words: int = 0) -> DataFrame:
    """``carry`` columns plus set size ``n``, fingerprint ``fa, fb``, ``keys`` of all collections and a byte ``sketch``.

    Rows of fewer than ``min_words`` words (if it exceeds the shingle length) are left out; no other column is read.
    """
    mult = multipliers(n_hashes, 1)
    n_keys = n_hashes // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in TB.slices(batch.column(len(carry))):
                values, at = TB.text_shingles(data, offsets, sim.shingle, sim.lower)
                rows = np.flatnonzero(np.diff(at) > min_words - sim.shingle) if min_words > sim.shingle else np.arange(hi - lo)
                if len(rows) < hi - lo:
                    counts = np.diff(at)[rows]
                    values, at = values[TB.gather_ranges(at[rows], counts)], np.concatenate(([0], np.cumsum(counts)))
                size, fa, fb = set_facts(values, at)
                mins = minhashes(values, at, mult)
                keys = collection_keys(mins, width).ravel()
                take, rows = pa.array(rows + lo), len(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(len(carry))), pa.array(size), pa.array(fa), pa.array(fb),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, rows * n_keys + 1, n_keys), pa.int32()), pa.array(keys)),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(n_hashes), rows, [None, pa.py_buffer((mins & U64(255)).astype(np.uint8).tobytes())]).cast(pa.binary())],
                    names=[*carry, "n", "fa", "fb", "keys", "sketch"])

    src = docs.select(*carry, text_col)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kept}, n long, fa long, fb long, keys array<long>, sketch binary")


def overlaps(pairs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """``a, b`` of those pairs whose full shingle sets are linked; ``texts`` has ``uid, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (shingle_sets(batch.column(c), sim) for c in (2, 3))
            inter = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)), np.int64, batch.num_rows)
            total = np.fromiter((len(x) + len(y) for x, y in zip(left, right, strict=True)), np.int64, batch.num_rows) - inter
            yield batch.select([0, 1]).filter(pa.array(inter * 100 >= total * sim.percent))

    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def shingle_sets(column, sim: Similarity) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of every text of a column."""
    out: list[np.ndarray] = []
    for lo, hi, data, offsets in TB.slices(column):
        values, at = TB.text_shingles(data, offsets, sim.shingle, sim.lower)
        out += [np.unique(values[at[i]:at[i + 1]]) for i in range(hi - lo)]
    return out


def deal_blocks(rows: DataFrame, group: str, carry: list[str], cross: bool = False) -> DataFrame:
    """Rows dealt to pairs of blocks ``g`` so that any two rows of a group meet unless both are settled.

    With ``cross`` only a settled row and one that is not need to meet.

    ``settled`` marks rows that need not meet each other.  A block holds about
    ``BLOCK`` rows; small groups are one block and their rows are dealt once.
    """
    side = rows.groupBy(group).agg(F.count_if(~F.col("settled")).alias("loose"), F.count_if("settled").alias("fixed")).where("loose > 0 and fixed > 0" if cross else "loose > 0 and loose + fixed > 1")
    side = side.select(F.col(group).alias("_of"), F.ceil(F.col("loose") / BLOCK).alias("nl"), F.ceil(F.col("fixed") / BLOCK).alias("nf"))
    own = rows.join(side, F.col(group) == F.col("_of"))
    own = own.withColumn("blk", F.pmod(F.xxhash64("uid"), F.when(F.col("settled"), F.col("nf")).otherwise(F.col("nl"))))
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    here = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    alone = (F.col("nl") == 1) & (F.col("nf") <= 1)
    with_fixed = F.transform(span(F.col("nf")), lambda j: here(0, F.col("blk"), j))
    with_loose = F.transform(span(F.col("nl")), lambda j: here(1, F.least("blk", j), F.greatest("blk", j)))
    to = F.when(alone, F.array(here(1, F.lit(0).cast("long"), F.lit(0).cast("long"))))
    to = to.when(~F.col("settled"), with_fixed if cross else F.concat(with_fixed, with_loose)).otherwise(F.transform(span(F.col("nl")), lambda i: here(0, i, F.col("blk"))))
    dealt = own.select(group, *carry, F.explode(to).alias("t")).select(F.xxhash64(group, "t.kind", "t.i", "t.j").alias("g"), *carry)
    # an explicit number: the work of a partition is far larger than its bytes suggest
    return dealt.repartition(shuffle_partitions(rows), "g").sortWithinPartitions("g")


def alike_links(failed: DataFrame, sketches: DataFrame, sim: Similarity, hashes: int) -> DataFrame:
    """Links ``a, b`` that connect rows of one bucket (``key, uid``) with enough equal minhashes: a forest per block.

    If there is a column ``settled``, only rows that differ in it need to meet.
    """
    need = sim.agreement(hashes)
    settled = F.col("settled") if "settled" in failed.columns else F.lit(False)
    rows = failed.select("key", "uid", settled.alias("settled")).join(sketches.select("uid", "n", "sketch"), "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in TA.sorted_groups(batches):
            m = group.num_rows
            group = group.take(pa.array(np.argsort(group.column(1).to_numpy())))
            uid, n = (group.column(i).to_numpy() for i in (1, 2))
            sk = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint8).reshape(m, hashes)
            trees = TA.Forest(m)
            for i in range(m - 1):
                fits = np.minimum(n[i + 1:], n[i]) * 100 >= np.maximum(n[i + 1:], n[i]) * sim.percent
                hit = np.flatnonzero(fits) + i + 1
                for j in hit[(sk[hit] == sk[i]).sum(axis=1) >= need].tolist():
                    trees.join(i, j)
            for i, j in trees.stars():
                a.append(int(uid[i]))
                b.append(int(uid[j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return deal_blocks(rows, "key", ["uid", "n", "sketch"], "settled" in failed.columns).mapInArrow(run, "a long, b long")


def exact_links(rows: DataFrame, sim: Similarity) -> DataFrame:
    """Links ``a, b`` that connect what is linked by full sets within a cluster: a forest per block.

    ``rows`` has ``cluster, uid, text, settled``.  Intersection sizes of all
    rows of a block come from products of 0/1 matrices over shingles that
    occur more than once in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in TA.sorted_groups(batches):
            m = group.num_rows
            if m < 2:
                continue
            group = group.take(pa.array(np.argsort(group.column(1).to_numpy())))
            uid = group.column(1).to_numpy()
            for i, j in linked_pairs(shingle_sets(group.column(2), sim), sim.percent):
                a.append(int(uid[i]))
                b.append(int(uid[j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return deal_blocks(rows, "cluster", ["uid", "text"]).mapInArrow(run, "a long, b long")


def linked_pairs(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of a row and its component's first row, over all rows linked by ``100 * intersection >= percent * union``."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    row = np.repeat(np.arange(m), size)
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[which] > 1
    number = np.cumsum(count > 1) - 1
    row, col = row[shared], number[which[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((m, m), np.float32)
    width = min(int(col[-1]) + 1 if len(col) else 1, max(256, (1 << 22) // m))
    cuts = np.searchsorted(col, np.arange(0, (int(col[-1]) + 1 if len(col) else 0) + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((m, width), np.float32)
        part[row[lo:hi], col[lo:hi] - k * width] = 1
        inter += part @ part.T
    inter = np.rint(inter).astype(np.int64)
    i, j = np.nonzero(np.triu(inter * 100 >= (size[:, None] + size[None, :] - inter) * percent, 1))
    trees = TA.Forest(m)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        trees.join(x, y)
    return trees.stars()


def by_rare_shingles(rows: DataFrame, sim: Similarity) -> DataFrame:
    """``rows`` (``cluster, uid, text, settled``) once for each of a row's rarest shingles, with cluster and shingle as the new ``cluster``.

    In any common order of all shingles, two linked sets of sizes n share one of
    their first ``n - ceil(n * percent / 100) + 1``, so no link is lost.  The order
    puts frequent shingles last (bitmaps of bounded size; collisions only move a
    shingle, for all rows alike), so a phrase that many rows hold brings none together.
    """

    def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            sets = shingle_sets(batch.column(0), sim)
            if sets:
                yield TB.mix(np.concatenate(sets)).view(np.int64)

    counts = rows.select("text").mapInArrow(lambda batches: CO.counted(shingles_of(batches)), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = TA.written(counts.where(F.col("c") > FREQUENT[0]), "frequent")
    sent = [rows.sparkSession.sparkContext.broadcast(CO.bitmap_of(counts.where(F.col("c") > n).select("h")).bits) for n in FREQUENT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), sim)
            if not sets:
                continue
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            row, h = np.repeat(np.arange(len(sets)), size), TB.mix(np.concatenate(sets))
            level = sum(CO.Bitmap(s.value).has(h.view(np.int64)).astype(np.int8) for s in sent)
            order = np.lexsort((h, level, row))
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            first = order[place < (size + (-size * sim.percent) // 100 + 1)[row]]
            take = pa.array(row[first])
            group = TB.mix(h[first] ^ TB.mix(batch.column(0).to_numpy().view(U64)[row[first]])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(group), *(batch.column(i).take(take) for i in (1, 2, 3))], names=["cluster", "uid", "text", "settled"])

    return rows.select("cluster", "uid", "text", "settled").mapInArrow(run, "cluster long, uid long, text string, settled boolean")


def class_components(classes: DataFrame, keys: DataFrame, text_of: Callable[[DataFrame], DataFrame], sim: Similarity, hashes: int) -> DataFrame:
    """``node, component`` over classes linked by exact similarity (classes without a link have no row).

    ``classes``: ``uid, n, sketch``, one row per different set; ``keys``: ``uid,
    key``, the table keys; ``text_of(uids)`` gives ``uid, text``.
    """
    hubs = TA.written(keys.groupBy("key").agg(F.min("uid").alias("hub"), F.count("*").alias("size")).where("size > 1"), "hubs")
    members = TA.written(keys.join(hubs, "key").where("uid <> hub").select("key", "uid", "hub"), "members")
    # candidate clusters: rows alike to their bucket's hub by minhashes, and the others of a bucket among themselves
    sketch = lambda c: classes.select(F.col("uid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    pairs = members.select("uid", "hub").distinct().join(sketch("uid"), "uid").join(sketch("hub"), "hub")
    fits = F.least("n_uid", "n_hub") * 100 >= F.greatest("n_uid", "n_hub") * sim.percent
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(hashes)), lambda i: F.substring("s_uid", i, 1) == F.substring("s_hub", i, 1)))
    alike = TA.written(pairs.where(fits & (same >= sim.agreement(hashes))).select(F.col("uid").alias("a"), F.col("hub").alias("b")), "alike")
    failed = members.join(alike, (F.col("uid") == F.col("a")) & (F.col("hub") == F.col("b")), "left_anti").select("key", "uid")
    failed = TA.written(failed, "failed")
    clusters = TA.written(TA.components(alike.unionByName(alike_links(failed, classes, sim, hashes))), "candidates")
    # rows that are still outside their hub's cluster meet what is alike to the hub, once a hub, not once a bucket
    home = lambda c: clusters.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    outside = failed.join(members, ["key", "uid"]).select("uid", "hub").distinct().join(home("uid"), "uid", "left").join(home("hub"), "hub", "left")
    outside = TA.written(outside.where(~F.col("c_uid").eqNullSafe(F.col("c_hub")) | F.col("c_uid").isNull()).select(F.col("hub").alias("key"), "uid"), "outside")
    beside = alike.select(F.col("b").alias("key"), F.col("a").alias("uid")).join(outside.select("key").distinct(), "key", "left_semi")
    cross = outside.withColumn("settled", F.lit(False)).unionByName(beside.withColumn("settled", F.lit(True)))
    joined = clusters.select(F.col("node").alias("a"), F.col("component").alias("b"))
    clusters = TA.components(joined.unionByName(alike_links(cross, classes, sim, hashes)))
    clusters = TA.written(clusters.select(F.col("node").alias("uid"), F.col("component").alias("cluster")), "clusters")
    texts = TA.written(text_of(clusters.select("uid")), "texts")
    # rows of a cluster of many blocks that are linked to its first row are settled: they need not meet each other
    large = clusters.groupBy("cluster").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("cluster")
    hung = clusters.join(large, "cluster", "left_semi").where("uid <> cluster").select(F.col("uid").alias("a"), F.col("cluster").alias("b"))
    star = TA.written(overlaps(hung, texts, sim), "star")
    rows = clusters.join(star.select(F.col("a").alias("uid"), F.lit(True).alias("s")), "uid", "left")
    rows = TA.written(rows.select("cluster", "uid", F.coalesce("s", F.lit(False)).alias("settled")), "dealt")
    # blocks copy a row as often as there are blocks of unsettled rows: where that is more than its rarest shingles, those deal the rows
    rare = F.col("n") * (100 - sim.percent) / 100 + 1
    wide = rows.join(large, "cluster", "left_semi").join(classes.select("uid", "n"), "uid").groupBy("cluster").agg(F.count_if(~F.col("settled")).alias("loose"), F.avg(rare).alias("rare"))
    wide = TA.written(wide.where(F.col("loose") > BLOCK * F.col("rare")).select("cluster"), "wide")
    links = star.unionByName(exact_links(rows.join(wide, "cluster", "left_anti").join(texts, "uid"), sim))
    if not wide.isEmpty():
        spread = TA.written(by_rare_shingles(rows.join(wide, "cluster", "left_semi").join(texts, "uid"), sim), "spread")
        links = links.unionByName(exact_links(spread, sim))
    return TA.components(links)


def near_duplicates(docs: DataFrame, sim: Similarity, *, id_col: str = "doc_id", text_col: str = "text",
                    tables: int = 9, width: int = 3) -> DataFrame:
    """Group documents whose word-shingle sets are similar; one output row per input row.

    Columns: the id, ``n_shingles`` (size of the set), ``component_id`` (smallest
    id reachable over links, itself included) and ``kept`` (id equals
    component id).  A null or blank text has an empty set and is linked with
    nothing; a row without an id is grouped by its text like any other, has no
    say in its group's id and is kept only if no row of its group has an id;
    rows that repeat an id share its fate when they share the text; an empty
    table gives no rows; other columns are not read.
    """
    hashes = 2 * tables * width
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = features(src, ["id"], "text", sim, hashes, width).withColumn("uid", F.monotonically_increasing_id())
    base = TA.written(base, "sets")
    by_set = base.where("n > 0").groupBy("n", "fa", "fb").agg(F.min("uid").alias("uid"), F.count("*").alias("c"), F.min("id").alias("least"))
    by_set = TA.written(by_set, "by-set")
    classes = TA.written(base.join(by_set.select("uid"), "uid", "left_semi"), "classes")
    sides = classes.select("uid", F.slice("keys", 1, tables).alias("l"), F.slice("keys", tables + 1, tables).alias("r"))
    keys = sides.select("uid", "r", F.posexplode("l").alias("i", "lk")).select("uid", "i", "lk", F.posexplode("r").alias("j", "rk"))
    keys = keys.select("uid", F.xxhash64(F.col("i") * tables + F.col("j"), "lk", "rk").alias("key"))

    def text_of(uids: DataFrame) -> DataFrame:
        want = classes.join(uids, "uid", "left_semi").select("uid", F.col("id").alias("want"), "fa", "fb")
        some = src.join(want, F.col("id").eqNullSafe(F.col("want"))).select("uid", "fa", "fb", "text")
        return same_set(some, sim).dropDuplicates(["uid"])

    found = class_components(classes.select("uid", "n", "sketch"), keys, text_of, sim, hashes)
    return group_rows(base, by_set, found, id_col)


def same_set(rows: DataFrame, sim: Similarity) -> DataFrame:
    """``uid, text`` of the rows whose text has the stated set fingerprint (ids may repeat with other texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in TB.slices(batch.column(3)):
                _, fa, fb = set_facts(*TB.text_shingles(data, offsets, sim.shingle, sim.lower))
                part = batch.slice(lo, hi - lo)
                ok = (fa == part.column(1).to_numpy()) & (fb == part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3)], names=["uid", "text"]).filter(pa.array(ok))

    return rows.select("uid", "fa", "fb", "text").mapInArrow(run, "uid long, text string")


def group_rows(base: DataFrame, by_set: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Component of every row, from its set's class and the components of classes.

    ``by_set``: one row per different set, with its class ``uid``, its number of
    rows ``c`` and its ``least`` id; classes learn their group's id first, rows
    from their class, so that copies by the thousand make no hot task.
    """
    rows = base.select("id", "n", "fa", "fb")
    linked = by_set.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("group", F.coalesce("component", "uid"))
    linked = TA.written(linked.select("n", "fa", "fb", "c", "least", "group"), "linked")
    first = TA.written(linked.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "first")
    values = TA.lookup(linked.drop("least"), first, ["group"], "size").drop("group", "size")
    out = TA.lookup(rows.where("n > 0"), TA.written(values, "values"), ["n", "fa", "fb"], "c").select("id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, sim: Similarity, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the documents that ``near_duplicates`` does not keep (same columns and edge cases).

    An id stays if any of its rows is kept; rows without an id count as one id.
    """
    groups = near_duplicates(docs, sim, id_col=id_col, text_col=text_col)
    name = "_gone"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = groups.groupBy(F.col(id_col).alias(name)).agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select(name)
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")
