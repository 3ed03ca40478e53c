"""Session set-up and the few cluster-facing helpers the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may hold to be broadcast on our own request. Beyond it the join is left to AQE.
BROADCAST_ROWS = 100_000
# Keys treated as hot by skew_join. A bound by construction: every key beyond the N most frequent
# holds at most 1/(N+1) of the rows.
HOT_KEYS = 1_000
# Up to here a relation as a whole is less than a task's work, so no key in it can be hot.
SMALL_ROWS = 10_000


def build_session(app_name: str = "colscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; everything can be overridden."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    A temporary folder stands in for it only on a local master, where driver and
    executors are one machine; on a cluster the setting has to be there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            configured = tempfile.mkdtemp(prefix="colscope-")
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a source that arrives in fewer pieces than there are cores.

    For work that is heavy per row, on few large row groups. A source of many pieces is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def holds_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; never counts further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row count; a larger side is joined by shuffle instead."""
    return F.broadcast(df) if holds_at_most(df, rows) else df


def skew_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with the per-key table ``lookup`` when a few keys may hold most rows.

    The ``HOT_KEYS`` most frequent keys are joined by broadcast, so their rows stay where
    they are; every other key holds at most ``1/(HOT_KEYS+1)`` of the rows and is shuffled.
    ``lookup`` holds a bounded number of rows per key. ``how`` is ``inner``, ``left`` or ``left_semi``. ``rows`` is
    read three times and should be stored or cheap.
    """
    if holds_at_most(rows, SMALL_ROWS):
        return rows.join(lookup, key, how)
    hot = (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.col(key))
        .limit(HOT_KEYS)
        .select(key)
    )
    hot_lookup = lookup.join(F.broadcast(hot), key, "left_semi")
    hot_rows = rows.join(F.broadcast(hot), key, "left_semi") if how == "left" else rows
    on_hot = hot_rows.join(F.broadcast(hot_lookup), key, how)
    on_cold = rows.join(F.broadcast(hot), key, "left_anti").join(lookup, key, how)
    return on_hot.unionByName(on_cold)
