"""Session settings the operators count on, and where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Most rows of one key that a single window task is asked to hold.
ROWS_PER_TASK_CONF = "spark.trackplace.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 4_000_000


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings results depend on (UTC) and the ones plans are written for."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK_CONF, str(DEFAULT_ROWS_PER_TASK)))


def _set_checkpoint_folder(spark: SparkSession) -> None:
    """The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="trackplace-checkpoint-")
        context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, not made yet, that every executor can reach."""
    _set_checkpoint_folder(spark)
    base = re.sub(r"^file:/(?!/)", "file:///", spark.sparkContext.getCheckpointDir())
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there."""
    _set_checkpoint_folder(df.sparkSession)
    return df.checkpoint()
