"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # every table stores UTC instants
    "spark.sql.session.timeZone": "UTC",
    # later stages overwrite earlier keys when attempt contexts are merged
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: What one task gets from a shuffle, compressed; its sorts and hash tables take about forty times as much. A session may name less.
TASK_MB = 8


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    given = spark.conf.get(ADVISORY, None)
    if given is None or _bytes(given) > TASK_MB << 20:
        spark.conf.set(ADVISORY, f"{TASK_MB}m")
    return spark


def _bytes(size: str) -> int:
    """Bytes of a size as Spark writes it (``64MB``, ``16k``, plain numbers are bytes)."""
    digits = size.strip().lower().rstrip("kmgtpib")
    unit = size.strip().lower()[len(digits) :][:1]
    return int(digits) << 10 * " kmgtp".index(unit if unit not in ("", "b") else " ")


def build_session(master: str | None = None, app_name: str = "feedweir", **conf: str) -> SparkSession:
    """Create a session; cluster settings given to spark-submit stay in force."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that several branches read to the shared folder, so it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates and stream checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may leave it unset (tests on one machine): a
    fresh local folder is then used and recorded in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
