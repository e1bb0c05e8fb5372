"""Folds, global ranks, unions, batches.

Global ranks (a ``row_number`` over a whole table or over one language) are
computed in two levels so that no single task sees a whole stratum:

1. a hash bucket per row (leading hex digits of the order key);
2. a local ``row_number`` inside ``(stratum, bucket)``;
3. bucket sizes -> running offsets per stratum (a table of at most
   ``strata x 16^digits`` rows);
4. ``rank = offset + local``.

The result equals the single-partition ``row_number`` over the same total
order, which is what the oracle computes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import order_key

MAIN_FOLD_SEED = 9353
EXTERNAL_FOLD = -1
BINS = 4096


def global_rank(df: DataFrame, order: list[Column | str], strata: list[str] | None = None, out: str = "rank",
                bucket_digits: int = 3) -> DataFrame:
    """1-based rank by ``order`` (first element must be an md5 hex string) within ``strata``.

    ``order[0]`` spreads rows evenly over ``16^bucket_digits`` buckets, so a
    hot stratum (one language holding a third of all rows) is split across
    many tasks; only the per-bucket counts are shuffled to build the offsets.
    """
    strata = strata or []
    okey = order[0] if isinstance(order[0], Column) else F.col(order[0])
    b = df.withColumn("_bucket", F.substring(okey, 1, bucket_digits))
    local_w = Window.partitionBy(*strata, "_bucket").orderBy(*order)
    b = b.withColumn("_local", F.row_number().over(local_w))
    counts = b.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(run), F.lit(0))).drop("_n")
    # the offsets have at most (#strata x 16^digits) rows; Spark broadcasts them if that is small; a NULL stratum is a stratum
    same = F.col("_bucket") == F.col("_o_bucket")
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    offsets = offsets.select(F.col("_bucket").alias("_o_bucket"), "_off", *[F.col(c).alias(f"_o_{c}") for c in strata])
    j = b.join(offsets, same)
    return (j.withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_bucket", "_local", "_off", "_o_bucket", *[f"_o_{c}" for c in strata]))


def stratified_kfold(df: DataFrame, k: int = 5, by: str = "language", seed: int = MAIN_FOLD_SEED,
                     id_col: str = "id", out: str = "kfold") -> DataFrame:
    """Shuffled, per-class balanced fold ids ``0..k-1``.

    Within each class, rows are ordered by ``md5(id:seed)`` (then id) and dealt
    round-robin, so per-class fold sizes differ by at most one and the result
    does not depend on partitioning.
    """
    key = order_key(id_col, F.lit(seed))
    r = global_rank(df.withColumn("_okey", key), [F.col("_okey"), F.col(id_col)], [by], out="_rk")
    return r.withColumn(out, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk", "_okey")


def assign_ids(df: DataFrame, order: list[str], prefix: str = "ext-", out: str = "id") -> DataFrame:
    """Sequential ids ``<prefix>1..n`` over a total order (namespaced, so they
    cannot collide with the ids of the main table)."""
    r = global_rank(df.withColumn("_okey", order_key(*order)), [F.col("_okey"), *[F.col(c) for c in order]],
                    out="_rk")
    return r.withColumn(out, F.concat(F.lit(prefix), F.col("_rk").cast("string"))).drop("_rk", "_okey")


def with_constant_fold(df: DataFrame, fold: int = EXTERNAL_FOLD, out: str = "kfold") -> DataFrame:
    """A literal fold column (``-1`` = always in training)."""
    return df.withColumn(out, F.lit(fold).cast("int"))


def split_by_fold(df: DataFrame, fold: int, col: str = "kfold") -> tuple[DataFrame, DataFrame]:
    """``(train, valid)`` = ``kfold != fold`` / ``kfold == fold``; NULL counts as -1 (train)."""
    f = F.coalesce(F.col(col), F.lit(EXTERNAL_FOLD))
    return df.where(f != fold), df.where(f == fold)


def union_examples(*frames: DataFrame) -> DataFrame:
    """Union by column name, missing columns as NULL (bag semantics, no de-duplication)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def id_uniqueness(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``n`` rows vs ``n_distinct`` ids (duplicates are an input error for us)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("n_distinct"))


def require_unique_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The input, or an error when it is read if an id repeats (counted per id, partial counts first)."""
    seen = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_c"))
    fine = F.when(F.col("_c") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("repeated id: "), F.coalesce(F.col("_id").cast("string"), F.lit("NULL")))).cast("boolean"))
    return df.join(seen.where(fine).select("_id"), F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")


def first_by_id(df: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """One row per id, the first in ``order`` (a total order); row number is limited before the shuffle."""
    w = Window.partitionBy(id_col).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def epoch_batches(df: DataFrame, epoch: int, seed: int, batch_size: int, keys: list[str]) -> DataFrame:
    """F10 + W6: per-epoch shuffle without replacement and consecutive batches.

    Rows are ordered by ``md5(keys:epoch:seed)`` (a fresh order per epoch,
    reproducible and partition-independent); ``batch = floor((rank - 1) / batch_size)``,
    so the last batch may be partial.
    """
    okey = order_key(*keys, F.lit(epoch), F.lit(seed))
    r = global_rank(df.withColumn("_okey", okey), [F.col("_okey"), *[F.col(c) for c in keys]], out="_rk")
    return (r.withColumn("epoch", F.lit(epoch).cast("int"))
            .withColumn("batch", F.floor((F.col("_rk") - 1) / batch_size).cast("int"))
            .drop("_rk", "_okey"))


def nth_value(df: DataFrame, col: str, n: int, descending: bool = False) -> tuple | None:
    """The exact ``n``-th smallest (largest) value of a numeric column, and how many rows come strictly before it.

    Counts rows in ``BINS`` ranges and goes on inside the range that holds row
    ``n`` until that range is one value: a few aggregates of at most ``BINS``
    rows each, whatever the size of the table.  Whole numbers and decimals are
    binned by exact integer arithmetic (keys beyond 2^53 too), floating-point
    numbers by their value, with the infinities as ranges of their own.  NULL and
    NaN are not counted; fewer than ``n`` rows give None.  Runs its aggregates
    when called.
    """
    kind = df.select(col).schema[0].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
        return _nth_double(x, n, descending)
    digits = kind.scale if isinstance(kind, T.DecimalType) else 0
    x = df.select((F.col(col) * F.lit(10 ** digits).cast(f"decimal({digits + 1},0)")).cast("decimal(38,0)").alias("x") if digits
                  else F.col(col).cast("decimal(38,0)").alias("x")).where(F.col("x").isNotNull())
    found = _nth_whole(x, n, descending)
    if found is None:
        return None
    value = Decimal(found[0]).scaleb(-digits) if isinstance(kind, T.DecimalType) else found[0]
    return value, found[1]


def _in_order(rows: list, n: int, before: int, descending: bool):
    """The counted range that holds row ``n``, and how many rows lie before it."""
    for r in sorted(rows, key=lambda r: r["lo"], reverse=descending):
        if before + r["n"] >= n:
            return r, before
        before += r["n"]
    return None, before


def _nth_whole(x: DataFrame, n: int, descending: bool) -> tuple[int, int] | None:
    lo, hi, total = x.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    if n < 1 or total < n:
        return None
    lo, hi, before = int(lo), int(hi), 0
    big = lambda v: F.lit(Decimal(v)).cast("decimal(38,0)")
    while lo != hi:
        width = -(-(hi - lo + 1) // BINS)
        start = F.col("x") - big(lo)
        bins = x.where(F.col("x").between(big(lo), big(hi))).groupBy(((start - start % big(width)).cast("decimal(38,0)")).alias("b"))
        r, before = _in_order(bins.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), n, before, descending)
        lo, hi = int(r["lo"]), int(r["hi"])
    return lo, before


def _nth_double(x: DataFrame, n: int, descending: bool) -> tuple[float, int] | None:
    whole = F.when(F.abs("x") == float("inf"), F.col("x")).otherwise(F.lit(0.0))
    r, before = _in_order(x.groupBy(whole.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), n, 0, descending)
    if n < 1 or r is None:
        return None
    lo, hi = r["lo"], r["hi"]
    while lo != hi:
        part = x.where(F.col("x").between(F.lit(lo), F.lit(hi)))
        scale = 2.0 ** -14 if max(abs(lo), abs(hi)) > 1e300 else 1.0  # a difference that would pass the largest double
        width = (hi * scale - lo * scale) / BINS
        b = F.least(F.floor((F.col("x") * scale - lo * scale) / width), F.lit(BINS - 1)) if width > 0 else F.col("x")
        r, before = _in_order(part.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), n, before, descending)
        if (r["lo"], r["hi"]) == (lo, hi):  # the range does not get finer: its few values are counted one by one
            r, before = _in_order(part.groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumns({"lo": F.col("x"), "hi": F.col("x")}).collect(), n, before, descending)
        lo, hi = r["lo"], r["hi"]
    return lo, before
