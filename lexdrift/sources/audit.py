"""Parquet file check: size and magic bytes at both ends, as a distributed job.

A file in a store that Arrow has no driver for is judged by what Spark's own reader makes of it: one that it can
read rows of is valid, one that it skips as corrupt is not. A file there without rows cannot be told from
a corrupt one, so it is not checked (``valid`` is NULL) and stops no job."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The Parquet magic bytes and the smallest possible file.
MAGIC = "PAR1"
MIN_LENGTH = 8

UNCHECKED = "not checked"

AUDIT_SCHEMA = "path STRING, length BIGINT, valid BOOLEAN, reason STRING"


def audit_parquet(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """``(path, length, valid, reason)`` for every file under ``path``.

    The listing reads no content; each task then reads eight bytes per file. A path
    that does not exist fails when the DataFrame is built."""
    paths = [path] if isinstance(path, str) else path
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select("path", "length")
    )
    magic, min_length = MAGIC.encode("ascii"), MIN_LENGTH

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def reason(location: str, length: int) -> str | None:
            if length < min_length:
                return "too small"
            # Hadoop spells local and S3 locations differently from Arrow.
            uri = re.sub(r"^s3a?:", "s3:", location)
            try:
                if uri.startswith(("file:", "/")):
                    source, name = fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
                else:
                    source, name = fs.FileSystem.from_uri(quote(uri, safe="/:@=,+"))
            except (OSError, ValueError, ImportError, NotImplementedError) as error:
                return f"{UNCHECKED}: {error}"
            try:
                with source.open_input_file(name) as handle:
                    head = handle.read(len(magic))
                    handle.seek(length - len(magic))
                    tail = handle.read(len(magic))
            except (OSError, ValueError) as error:
                return f"not readable: {error}"
            return None if head == magic and tail == magic else "bad magic"

        for batch in batches:
            reasons = [reason(p, n) for p, n in zip(batch["path"], batch["length"])]
            yield pd.DataFrame({
                "path": batch["path"],
                "length": batch["length"],
                "valid": [None if r and r.startswith(UNCHECKED) else r is None for r in reasons],
                "reason": reasons,
            })

    checked = files.mapInPandas(check, AUDIT_SCHEMA)
    return _judged_by_spark(checked, paths, pattern) if _foreign(paths) else checked


def _foreign(paths: list[str]) -> bool:
    """Whether some path is in a store that Arrow cannot open."""
    from pyarrow import fs

    def opens(path: str) -> bool:
        uri = re.sub(r"^s3a?:", "s3:", path)
        if uri.startswith(("file:", "/")) or ":" not in uri:
            return True
        try:
            fs.FileSystem.from_uri(quote(uri, safe="/:@=,+"))
            return True
        except (OSError, ValueError, ImportError, NotImplementedError):
            return False

    return not all(map(opens, paths))


def _judged_by_spark(checked: DataFrame, paths: list[str], pattern: str) -> DataFrame:
    """``checked`` with what Spark's reader says of the files that were not checked. No column is read: rows are
    counted from the footers."""
    rows = (
        checked.sparkSession.read.schema("none INT")
        .option("ignoreCorruptFiles", "true")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .parquet(*paths)
    )
    name = F.col("_metadata.file_path")
    read = rows.groupBy(name.alias("read_path")).count().select(_plain(F.col("read_path")).alias("read_path"))
    found = checked.join(read, _plain(F.col("path")) == F.col("read_path"), "left")
    unchecked, seen = F.col("valid").isNull(), F.col("read_path").isNotNull()
    return found.select(
        "path",
        "length",
        F.when(unchecked & seen, True).otherwise(F.col("valid")).alias("valid"),
        F.when(unchecked & seen, F.lit(None)).otherwise(F.col("reason")).alias("reason"),
    )


def _plain(path: Column) -> Column:
    """A path without escapes and with one slash behind its scheme."""
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+:)/+", "$1/")


def is_parquet(spark: SparkSession, path: str) -> bool:
    """True when the path exists, holds files and all of them pass the check."""
    from pyspark.errors import AnalysisException

    try:
        total, bad = _counts(audit_parquet(spark, path))
    except AnalysisException:
        return False
    return total > 0 and bad == 0


def require_parquet(spark: SparkSession, path: str | list[str]) -> None:
    """Raise unless every file under ``path`` passes the check."""
    audit = audit_parquet(spark, path)
    total, bad = _counts(audit)
    if total == 0:
        raise ValueError(f"no input files in {path}")
    if bad:
        first = audit.filter(~F.col("valid")).select("path", "reason").head()
        raise ValueError(
            f"{bad} of {total} input files are not complete Parquet files, "
            f"for example {first['path']}: {first['reason']}"
        )


def _counts(audit: DataFrame) -> tuple[int, int]:
    row = audit.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("valid")).alias("bad")
    ).head()
    return row["total"], row["bad"]
