"""Session helpers for tests, the bench and local runs.

Library operators never create a session; only entry points do.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "spanlake", shuffle_partitions: int | None = None,
                  event_log_dir: str | None = None) -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UI off)."""
    parts = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPANLAKE_DRIVER_MEMORY", _default_driver_memory()))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if event_log_dir:
        b = (b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
             .config("spark.eventLog.compress", "false"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _default_driver_memory() -> str:
    """16g, or about 60% of physical memory on smaller hosts (local mode: the driver is the executor)."""
    try:
        total_mb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // (1024 * 1024)
    except (ValueError, OSError, AttributeError):
        return "16g"
    return f"{max(1024, min(16 * 1024, int(total_mb * 0.6)))}m"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a scratch one only in local mode, when unset (tests).

    On a cluster a folder that one machine sees would lose data, so an unset
    ``spark.checkpoint.dir`` is an error there.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="spanlake-ckpt-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", current)
    if current not in _CHECKPOINT_DIRS:
        spark.sparkContext.setCheckpointDir(current)
        _CHECKPOINT_DIRS.add(current)
    return current


_CHECKPOINT_DIRS: set[str] = set()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Shuffle files of a query that runs inside go when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(df) -> int:
    """The session's ``spark.sql.shuffle.partitions`` (sized for the cluster)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ship_by_value(fn) -> None:
    """Serialise a scorer defined in this package by value, so Python workers do
    not need the package on their import path (a plain user function from an
    installed module is shipped by reference as usual)."""
    import sys

    from pyspark import cloudpickle

    mod = sys.modules.get(getattr(fn, "__module__", "") or "")
    if mod is not None and mod.__name__.split(".")[0] == __name__.split(".")[0]:
        cloudpickle.register_pickle_by_value(mod)
