"""What a task gets from a shuffle is bounded, so that its memory does not grow with the input."""

import pytest

from feedweir.session import ADVISORY, TASK_MB, _bytes, prepare


def test_sizes_are_read_as_spark_writes_them():
    assert [_bytes(s) for s in ("64MB", "67108864b", "16k", "1g", "512", "8m")] == [64 << 20, 64 << 20, 16 << 10, 1 << 30, 512, 8 << 20]


@pytest.mark.parametrize("given, kept", [(None, f"{TASK_MB}m"), ("64MB", f"{TASK_MB}m"), ("1g", f"{TASK_MB}m"), ("16k", "16k")])
def test_a_session_may_ask_for_smaller_tasks_only(spark, given, kept):
    other = spark.newSession()
    other.conf.unset(ADVISORY)
    if given:
        other.conf.set(ADVISORY, given)
    assert prepare(other).conf.get(ADVISORY) == kept


def test_tasks_of_a_join_and_a_grouping_stay_small(spark):
    """Rows that the default size puts into a few tasks are dealt into more of them."""
    other = prepare(spark.newSession())
    other.conf.set("spark.sql.shuffle.partitions", "64")
    rows = other.range(0, 6_000_000, 1, 8).selectExpr("id", "sha2(cast(id % 3000000 AS string), 256) AS k").groupBy("k").count()
    assert rows.rdd.getNumPartitions() >= 16
