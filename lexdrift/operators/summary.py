"""Run counters and metadata as a one-row DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


COUNTERS = ("total_processed", "difference_count", "skipped_count", "failed_count", "rejected_count")


@dataclass(frozen=True)
class RunInfo:
    """What a run was given and when it ran; times are UTC wall clock."""

    old_analyzer: str
    new_analyzer: str
    source_path: str
    source_type: str
    max_records: int = -1
    start_time: datetime | None = None
    end_time: datetime | None = None
    old_components: Sequence[str] = field(default_factory=tuple)
    new_components: Sequence[str] = field(default_factory=tuple)
    run_id: str | None = None
    #: Input files that could not be read to their end; None where they were not looked for.
    broken_files: int | None = None

    @property
    def duration_ms(self) -> int:
        if self.start_time is None or self.end_time is None:
            return 0
        elapsed = self.end_time - self.start_time
        return (elapsed.days * 86_400 + elapsed.seconds) * 1000 + elapsed.microseconds // 1000


def _time(value: datetime | None) -> Column:
    text = None if value is None else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def count_records(compared: DataFrame) -> DataFrame:
    """The counters in one pass: partial counts per task, one small final row.

    Failed records count only as failed; skipped ones count as processed. Pages that were
    rejected (column ``reject``, where the source has one) count only as rejected."""
    ok = F.col("error").isNull()
    rejected = F.col("reject").isNotNull() if "reject" in compared.columns else F.lit(False)
    return compared.agg(
        F.count_if(ok).alias("total_processed"),
        F.count_if(ok & F.col("has_difference")).alias("difference_count"),
        F.coalesce(F.sum(F.when(ok, F.col("skipped").cast("bigint"))), F.lit(0)).alias(
            "skipped_count"
        ),
        F.count_if(~ok & ~rejected).alias("failed_count"),
        F.count_if(rejected).alias("rejected_count"),
    )


def _rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, part.cast("double") / total.cast("double") * 100.0).otherwise(0.0)


def run_summary(compared: DataFrame, info: RunInfo) -> DataFrame:
    """Metadata, counters, match count and rates."""
    total, different = F.col("total_processed"), F.col("difference_count")
    counts = count_records(compared).withColumn("match_count", total - different)
    return counts.select(
        F.lit(info.run_id).cast("string").alias("run_id"),
        F.lit(info.old_analyzer).alias("old_analyzer"),
        F.lit(info.new_analyzer).alias("new_analyzer"),
        _texts(info.old_components).alias("old_components"),
        _texts(info.new_components).alias("new_components"),
        F.lit(info.source_path).alias("source_path"),
        F.lit(info.source_type).alias("source_type"),
        F.lit(info.max_records).cast("bigint").alias("max_records"),
        _time(info.start_time).alias("start_time"),
        _time(info.end_time).alias("end_time"),
        F.lit(info.duration_ms).cast("bigint").alias("duration_ms"),
        "total_processed",
        "difference_count",
        "match_count",
        "skipped_count",
        "failed_count",
        "rejected_count",
        F.lit(info.broken_files).cast("bigint").alias("broken_files"),
        _rate(different, total).alias("diff_rate"),
        _rate(F.col("match_count"), total).alias("match_rate"),
    )
