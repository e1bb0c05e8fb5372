"""Run history (one row per run and epoch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INITIAL_BEST = 0.0  # the reference starts the best Jaccard at 0.0


def best_epoch(history: DataFrame) -> DataFrame:
    """Epoch with the strictly highest Jaccard (first on ties) and its validation loss."""
    b = history.groupBy("run").agg(F.max_by(F.struct("epoch", "jaccard", "val_loss"),
                                            F.struct("jaccard", -F.col("epoch"))).alias("b"))
    return b.select("run", "b.epoch", "b.jaccard", "b.val_loss")


def early_stop(history: DataFrame, patience: int) -> DataFrame:
    """The counter resets when the Jaccard beats the best so far, else grows by one;
    training stops at the first epoch where it reaches ``patience``.

    ``run, stop_epoch`` (NULL = never stopped), ``best_epoch`` (last improving
    epoch up to the stop; NULL if none).  Gaps-and-islands over a per-run
    running frame; a run has one row per epoch, so the window is small.
    """
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = history.withColumn("_best_before", F.greatest(F.coalesce(F.max("jaccard").over(before), F.lit(INITIAL_BEST)),
                                                      F.lit(INITIAL_BEST)))
    h = h.withColumn("_improved", F.col("jaccard") > F.col("_best_before"))
    h = h.withColumn("_last_imp", F.max(F.when(F.col("_improved"), F.col("epoch"))).over(upto))
    h = h.withColumn("_counter", F.col("epoch") - F.coalesce(F.col("_last_imp"), F.lit(-1)))
    g = h.groupBy("run").agg(F.min(F.when(F.col("_counter") == patience, F.col("epoch"))).alias("stop_epoch"),
                             F.collect_list(F.struct("epoch", "_improved")).alias("_e"))
    best = F.array_max(F.transform(
        F.filter("_e", lambda x: x["_improved"] & (F.col("stop_epoch").isNull() | (x["epoch"] <= F.col("stop_epoch")))),
        lambda x: x["epoch"]))
    return g.select("run", F.col("stop_epoch").cast("int").alias("stop_epoch"), best.cast("int").alias("best_epoch"))


def epoch_times(history: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Total and mean epoch duration per run."""
    return history.groupBy("run").agg(F.sum(seconds).cast("bigint").alias("total"),
                                      F.round(F.avg(seconds), 6).alias("mean"))
