"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "tarnis", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only in local mode, where none may be set."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    current = spark.sparkContext.getCheckpointDir()
    if configured is None and current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tarnis-checkpoint-")
    if current is None:
        spark.sparkContext.setCheckpointDir(configured)
        current = spark.sparkContext.getCheckpointDir()
    return (configured or current).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table written between two steps of a job."""
    return f"{shared_dir(spark)}/tarnis-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows, their partitions and their order are fixed from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Later steps read the stored rows instead of computing them again, and since the size of a stored
    table is known the optimiser broadcasts it exactly when it is small enough.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
