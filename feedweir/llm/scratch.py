"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from feedweir.session import shared_dir

#: Rows handed to a Python worker at once; texts may be long, so a batch is kept small.
BATCH_ROWS = 512
#: Bytes handed over at once, or one row where it is longer: a row may be a whole shard of an index.
BATCH_BYTES = 16 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch of texts holds and keep joins free to be split when keys are hot."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


class Scratch:
    """Tables written once under ``spark.checkpoint.dir``: they cut lineage and survive lost executors.

    ``drop`` removes tables that nothing reads any more; what the returned result still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = configure(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
