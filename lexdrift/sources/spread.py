"""Parallelism right after a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASKS_PER_CORE = 2


def spread(df: DataFrame, key: str = "seq") -> DataFrame:
    """Give the analysis enough tasks when the scan alone would not.

    A scan with at least two tasks per core is left as it is, so a large corpus is never
    shuffled for this. Below that the input is less than about two splits per core and
    the shuffle is small, or it comes from a few files that cannot be split. Hashing on the
    position makes retries repeatable.

    ``df`` must be a plain scan: asking a plan with a shuffle for its number of tasks
    would run the shuffle."""
    if df.isStreaming:
        return df
    enough = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    tasks = df.rdd.getNumPartitions()
    if tasks == 0 or tasks >= enough:
        return df
    return df.repartition(enough, F.col(key))
