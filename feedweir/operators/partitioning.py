"""Partitioning helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Session setting: partitions into which inputs of heavy per-row work are dealt. Unset, the scan's splits stay.
SPREAD_CONF = "spark.feedweir.spread"


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Deal rows into as many partitions as the session asks for, for small inputs of few splits; else leave them.

    With a ``key`` rows are dealt by it always, if not asked otherwise into as many partitions as a shuffle has: short rows that cost
    much work each lie by the million in one split. The number is given, else few bytes would be put together into few tasks again.
    """
    conf = df.sparkSession.conf
    parts = conf.get(SPREAD_CONF, None)
    if key:
        return df.repartition(int(parts or conf.get("spark.sql.shuffle.partitions")), key)
    return df.repartition(int(parts)) if parts else df


def time_chunk(ts: str | Column, width_seconds: int = 3600) -> Column:
    """Time slice of a row. Slices cut a busy key into bounded, ordered pieces."""
    return F.floor(F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts) / width_seconds)


def id_chunk(key: str | Column, width: int = 1_000_000) -> Column:
    """Id range of a row, for tables ordered by id."""
    return F.floor((F.col(key) if isinstance(key, str) else key) / width)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, descending: bool = False, out: str = "rn"
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per key.

    Rows are numbered inside (key, chunk); a per-chunk count gives the offset of each chunk. ``chunk`` must be
    monotone in the first order column (``descending`` names its direction). The offsets are one row per (key, chunk)
    and join on the partitioning the numbering already has.
    """
    sliced = df.withColumn("_chunk", chunk)
    position = F.col("_chunk").desc() if descending else F.col("_chunk").asc()
    counts = sliced.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = sliced.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order)))
    return (
        numbered.join(offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_rn") + F.col("_offset")).cast("bigint"))
        .drop("_chunk", "_rn", "_offset")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, out: str = "rn") -> DataFrame:
    """First ``limit`` rows per key; each task keeps at most ``limit`` rows per key before the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= limit)
