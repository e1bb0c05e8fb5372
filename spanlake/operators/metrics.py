"""Jaccard, G1-G3, G6, M4, W4, W7: scores, meters and the decode sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import jaccard

ROUND = 6


def with_jaccard(df: DataFrame, truth: str = "answer_text", pred: str = "prediction") -> DataFrame:
    return df.withColumn("jaccard", jaccard(truth, pred))


def evaluate(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """``examples left join predictions`` on id, then per-row Jaccard."""
    j = examples.join(predictions.select("id", "prediction"), "id", "left")
    return with_jaccard(j.withColumn("prediction", F.coalesce("prediction", F.lit(""))))


def mean_by_language(scored: DataFrame, lang: str = "language", value: str = "jaccard") -> DataFrame:
    """G1: unweighted mean overall and per language in one grouping-sets aggregate.

    ``language, is_total, mean_jaccard, n`` (``n`` counts rows; NULL Jaccard
    rows are left out of the mean).  Partial aggregation happens before the
    shuffle, so a language holding most rows does not make a hot task.
    """
    g = scored.groupingSets([[lang], []], lang).agg(
        F.avg(value).alias("_m"), F.count(F.lit(1)).alias("n"), F.grouping(lang).alias("_g"))
    return g.select(
        F.col(lang).alias("language"),
        (F.col("_g") == 1).alias("is_total"),
        F.round("_m", ROUND).alias("mean_jaccard"),
        "n",
    )


def count_by_primary(df: DataFrame, primary: str, lang: str = "language") -> DataFrame:
    """Rows of the primary language (code 0) vs everything else (code 1, NULL included)."""
    code = F.when(F.col(lang).eqNullSafe(F.lit(primary)), 0).otherwise(1)
    return df.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def meter(df: DataFrame, key: str | list[str], seq: str, val: str = "val", n: str = "n", seeded_bounds: bool = True) -> DataFrame:
    """The reference's average meter as one aggregate per key (a column or several).

    ``last`` = value of the last update, ``sum = sum(val * n)``, ``count = sum(n)``,
    ``avg = sum / count``; with ``seeded_bounds`` the maximum starts at 0 and the
    minimum at 1e5, as in the reference.
    """
    keys = [key] if isinstance(key, str) else key
    agg = df.groupBy(*keys).agg(
        F.max_by(val, seq).alias("last"),
        F.sum(F.col(val) * F.col(n)).alias("sum"),
        F.sum(n).alias("count"),
        F.max(val).alias("_max"),
        F.min(val).alias("_min"),
    )
    mx = F.greatest(F.col("_max"), F.lit(0.0)) if seeded_bounds else F.col("_max")
    mn = F.least(F.col("_min"), F.lit(1e5)) if seeded_bounds else F.col("_min")
    return agg.select(
        *keys,
        F.round("last", ROUND).alias("last"),
        F.round(F.col("sum") / F.col("count"), ROUND).alias("avg"),
        F.round("sum", ROUND).alias("sum"),
        F.col("count").cast("bigint").alias("count"),
        F.round(mx, ROUND).alias("max"),
        F.round(mn, ROUND).alias("min"),
    )


def running_meter(df: DataFrame, key: str, seq: str, val: str = "val", n: str = "n", seeded_bounds: bool = True,
                  bucket_width: int = 1024, exact_scale: int | None = None) -> DataFrame:
    """Every meter field after each update, per key in ``seq`` order.

    Two levels, so a key holding most rows is not one task: rows fall into
    ``seq`` ranges of ``bucket_width``; a running frame inside each
    ``(key, range)`` plus the totals of all earlier ranges of the key (a table
    of one row per key and range) gives the running value.
    Output: ``key, seq, n_rows, avg, max, min``.  With ``exact_scale`` the
    weighted sums are accumulated as decimals of that scale, so the result does
    not depend on the order in which partial sums are combined.
    """
    exact = exact_scale is not None
    # exact: integer units of 10^-scale, so partial sums combine without rounding error
    v = F.round(F.col(val) * (10 ** exact_scale)).cast("bigint") if exact else F.col(val)
    b = df.withColumn("_b", F.floor(F.col(seq) / bucket_width)).withColumn("_vn", v * F.col(n))
    w = Window.partitionBy(key, "_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loc = b.select(key, seq, "_b", F.sum("_vn").over(w).alias("_s"), F.sum(n).over(w).alias("_c"),
                   F.max(val).over(w).alias("_mx"), F.min(val).over(w).alias("_mn"),
                   F.count(F.lit(1)).over(w).alias("_k"))
    tot = b.groupBy(key, "_b").agg(F.sum("_vn").alias("_ts"), F.sum(n).alias("_tc"), F.max(val).alias("_tmx"),
                                   F.min(val).alias("_tmn"), F.count(F.lit(1)).alias("_tk"))
    prev = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.select(F.col(key).alias("_key"), F.col("_b").alias("_pb"), F.sum("_ts").over(prev).alias("_ps"), F.sum("_tc").over(prev).alias("_pc"),
                     F.max("_tmx").over(prev).alias("_pmx"), F.min("_tmn").over(prev).alias("_pmn"),
                     F.sum("_tk").over(prev).alias("_pk"))
    j = loc.join(pre, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_pb")))  # a NULL key is a key
    s_ = F.coalesce("_ps", F.lit(0)) + F.col("_s")
    c_ = F.coalesce("_pc", F.lit(0)) + F.col("_c")
    if exact:
        # average in units of 1e-6, rounded half up on exact integers
        x = s_ * (10 ** (ROUND - exact_scale))
        avg = F.floor((x * 2 + c_) / (c_ * 2)) / F.lit(10.0 ** ROUND)
    else:
        avg = F.round(s_ / c_, ROUND)
    mx = F.greatest("_pmx", "_mx")
    mn = F.least("_pmn", "_mn")
    if seeded_bounds:
        mx, mn = F.greatest(mx, F.lit(0.0)), F.least(mn, F.lit(1e5))
    return j.select(key, seq, (F.coalesce("_pk", F.lit(0)) + F.col("_k")).alias("n_rows"),
                    avg.alias("avg"), F.round(mx, ROUND).alias("max"),
                    F.round(mn, ROUND).alias("min"))


def log_every(df: DataFrame, seq: str, every: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keep progress rows whose 0-based index is a multiple of ``every``, and the last one.

    ``df`` has a dense 0-based index column ``seq`` (per ``keys``).  Rows are
    looked at in blocks of ``every``: the first of a block is a progress row,
    and the largest index per key (one row per key, from the blocks' own
    maxima) is the last one, so no window spans a whole key.
    """
    block = Window.partitionBy(*keys, F.floor(F.col(seq) / every)).orderBy(F.desc(seq))
    ends = df.withColumn("_end", F.row_number().over(block) == 1).where((F.col(seq) % every == 0) | F.col("_end"))
    # a block's last row stays if the next block has no first row: at most two rows per block take part
    firsts = ends.where(F.col(seq) % every == 0).select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col(seq) - 1).alias("_before"))
    same = F.col(seq) == F.col("_before")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    last = ends.join(firsts, same, "left")
    return last.where((F.col(seq) % every == 0) | F.col("_before").isNull()).select(*df.columns)
