"""ST1 / ST2 / M3: streaming forms of the meter, the row-level repairs and the decoder.

Sources are file streams over a shared folder (one table's file or folder of
files); sinks and checkpoints live under the session's checkpoint folder, so a
restarted query resumes from its checkpoint instead of recomputing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators.align import repair_answer_offsets
from spanlake.operators.metrics import meter
from spanlake.plans.fixtures import qa_from_documents
from spanlake.session import scratch_dir


def file_stream(spark: SparkSession, folder: str, table_name: str, max_files: int | None = None) -> DataFrame:
    """A streaming read of ``<folder>/<table_name>.parquet``, one file or a folder of files, with the batch schema.

    A micro-batch takes what has arrived, or at most ``max_files`` files.
    """
    path = f"{folder.rstrip('/')}/{table_name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    # a pattern that only this name fits: a stream takes a plain path for a folder, a pattern for whatever it finds
    return stream.parquet(f"{path[:-1]}[t]")


def stream_meter(events: DataFrame, key: str = "event_type", val: str = "value") -> DataFrame:
    """ST1: running meter per key as a streaming aggregate (state = one row per key)."""
    return events.groupBy(key).agg(F.round(F.avg(val), 6).alias("avg"), F.count(F.lit(1)).alias("count"),
                                   F.round(F.max(val), 6).alias("max"), F.round(F.min(val), 6).alias("min"))


def run_complete_to_table(agg: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a streaming aggregate to completion (``availableNow``) in complete mode.

    Each micro-batch's full result replaces a parquet table (``foreachBatch``),
    so the table always holds the latest complete answer; it is read back as a
    batch DataFrame.
    """
    out = scratch_dir(spark, f"{name}-out")
    ckpt = scratch_dir(spark, f"{name}-ckpt")

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_append_to_table(rows: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stateless stream to completion with a parquet file sink (append mode)."""
    out = scratch_dir(spark, f"{name}-out")
    ckpt = scratch_dir(spark, f"{name}-ckpt")
    q = (rows.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_align(documents: DataFrame) -> DataFrame:
    """ST2: the qa examples and their offset repair on a stream (no state)."""
    return repair_answer_offsets(qa_from_documents(documents)).select("id", "repair")


def stream_window_meter(events: DataFrame, key: str = "event_type", time: str = "ts", seq: str = "event_id", val: str = "val", n: str = "n",
                        *, width: str = "1 day", delay: str = "2 days", seeded_bounds: bool = True) -> DataFrame:
    """ST1 in event time: every meter field per tumbling window of ``width`` and key.

    The watermark follows the largest time seen by ``delay``.  A row is late, and
    left out, when its window had ended by the watermark that earlier
    micro-batches set; rows of one micro-batch never make each other late, and
    rows without a time belong to no window.  A window's state (one row per key)
    goes when the watermark passes its end.  Times without a zone are read as
    UTC, and windows start at multiples of ``width`` since 1970 UTC.  On a batch
    frame the result is the meter over all rows.
    """
    timed = events.where(F.col(time).isNotNull())
    if timed.schema[time].dataType == T.TimestampNTZType():
        timed = timed.withColumn(time, F.concat(F.col(time).cast("string"), F.lit("Z")).cast("timestamp"))
    timed = timed.withWatermark(time, delay).withColumn("window", F.window(time, width))
    return meter(timed, ["window", key], seq, val, n, seeded_bounds)


def run_each_batch(rows: DataFrame, spark: SparkSession, folder: str, transform: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived and read all that is in ``folder``: the result's columns and ``batch``.

    Micro-batch i, as ``transform`` makes it, becomes ``batch=i`` as a whole,
    overwriting what an earlier attempt at it left, so a repeated batch is never
    doubled.  Progress is kept in ``folder`` too: a run with the same folder goes
    on behind the last batch that ended.
    """
    change = transform or (lambda batch: batch)
    out = f"{folder.rstrip('/')}/rows"

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder.rstrip('/')}/progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out)


def latest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key of an update stream's ``rows`` (with ``batch``), by one aggregate."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
