"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its counted rows times this bound stay below the limit.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "tidepanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and a UTC clock.

    Shuffle partitions are left to the cluster: adaptive execution coalesces them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, set for checkpoints too.

    A temporary folder is made only for a local master that names none.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tidepanel-checkpoint-")
        context.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def durable(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so lost executors cost no recomputation."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def checked_broadcast(side: DataFrame, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast only after counting the side; beyond the bound leave it to the planner.

    The count is an aggregate (a limit before it would send rows to one task), so the side should
    be cheap to read twice: a dimension, or a durable frame. Larger sides become a shuffled join,
    where adaptive execution splits hot keys.
    """
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


def spread(scan: DataFrame) -> DataFrame:
    """Even out a scan that has fewer input splits than the cluster has cores.

    For heavy work per row on a table of few files or row groups. A scan with a split per core or
    more, as any large table has, is returned as it is: no shuffle is added at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
