"""Tables written between jobs, in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one gets a
    temporary folder; on a cluster that would not be visible to every machine."""
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="lexdrift-")
    sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; not created."""
    return f"{shared_folder(spark)}/lexdrift-{label}-{uuid4().hex}"


@contextmanager
def _no_shuffle_files_left(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files on the machines' disks when it has ended; otherwise
    they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: the lineage ends at the files, so later
    steps neither repeat the work nor depend on the executors that did it."""
    spark = df.sparkSession
    path = path or new_folder(spark, label)
    with _no_shuffle_files_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
