"""Spark session defaults for audits.

On a cluster the session already exists and carries its own settings; we only
fill in what is unset. ``spark.checkpoint.dir`` is read from the session and
only set to a local scratch folder when nothing is configured (tests, laptop).
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML rows are a few KB to a few MB; keep Arrow batches moderate so one
    # batch of large pages does not blow the Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # Dimension tables (bots, phrases, weights, owners) are tiny literals;
    # anything that grows with the data is never broadcast by hint.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "siteaudit") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        _fill_defaults(active)
        return active
    b = SparkSession.builder.appName(app_name)
    given = SparkConf().get("spark.master", None)     # what spark-submit says stands
    if master or not given:
        b = b.master(master or os.environ.get("SITEAUDIT_MASTER", "local[*]"))
    b = b.config("spark.ui.enabled", "false")
    b = b.config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", os.environ.get("SITEAUDIT_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _fill_defaults(spark)
    return spark


def _fill_defaults(spark: SparkSession) -> None:
    for k, v in _DEFAULTS.items():
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        except Exception:  # static or locked conf on a managed cluster
            pass
    checkpoint_dir(spark)


#: Bytes of an Arrow batch that goes to a Python worker, where the session sets no limit of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: texts differ in length by orders of magnitude, so a number of rows bounds nothing."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Uses ``spark.checkpoint.dir`` when the cluster names one; only when it is
    unset (local tests) a scratch folder is created and configured.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        # Unset: only the case for local tests and benches.
        d = tempfile.mkdtemp(prefix="siteaudit-ckpt-")
    sc.setCheckpointDir(d)
    return d
