"""Input order: the ``seq`` key, running numbers and the record limit.

``seq`` is ``STRUCT<file, block, idx>`` and orders records as they were read. Sorting
is left to the report writers; nothing here sorts the whole input or sends it through
one task. A *chunk* is at most ``CHUNK_ROWS`` consecutive positions of one split, so
its size does not depend on how large a single input file is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536


def _chunk(seq: str, rows: int) -> list[Column]:
    key = F.col(seq)
    return [
        key["file"].alias("_file"),
        key["block"].alias("_block"),
        F.call_function("div", key["idx"], F.lit(rows)).alias("_part"),
    ]


def chunk_offsets(df: DataFrame, seq: str = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    """``(_file, _block, _part, _rows, _offset)``: rows in and before each chunk.

    Counts are combined before the shuffle. The running sum goes over the chunks of
    each file and over one row per input file (a list the driver holds anyway)."""
    chunks = df.groupBy(*_chunk(seq, rows)).agg(F.count(F.lit(1)).alias("_rows"))
    files = chunks.groupBy("_file").agg(F.sum("_rows").alias("_file_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        "_file", F.coalesce(F.sum("_file_rows").over(before), F.lit(0)).alias("_file_offset")
    )
    inside = (
        Window.partitionBy("_file")
        .orderBy("_block", "_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        chunks.withColumn("_before", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .join(files, "_file")
        .select(
            "_file",
            "_block",
            "_part",
            "_rows",
            (F.col("_file_offset") + F.col("_before")).alias("_offset"),
        )
    )


def with_ordinal(
    df: DataFrame, name: str = "ordinal", seq: str = "seq", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add the 1-based position of each row in input order, without gaps.

    Rows are numbered inside their chunk and shifted by the chunk's offset. ``df`` is
    evaluated twice, so pass a stored table when it is expensive."""
    chunk = ["_file", "_block", "_part"]
    offsets = chunk_offsets(df, seq, rows).select(*chunk, "_offset")
    placed = df.select("*", *_chunk(seq, rows))
    position = F.row_number().over(Window.partitionBy(*chunk).orderBy(seq))
    return (
        placed.withColumn(name, position.cast("bigint"))
        .join(offsets, chunk)
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop(*chunk, "_offset")
    )


def limit_records(
    df: DataFrame,
    max_records: int,
    seq: str = "seq",
    rows: int = CHUNK_ROWS,
    counted: Column | None = None,
) -> DataFrame:
    """The first ``max_records`` rows in input order; -1 keeps all.

    Finds the ``seq`` of the last wanted row from chunk counts and filters on it, so
    the kept rows are neither shuffled nor gathered in one task, however many they
    are. The condition on the file name also skips later Parquet files at listing.
    Rows for which ``counted`` does not hold are kept up to there without being counted."""
    if max_records == -1:
        return df
    if max_records < 1:
        raise ValueError("max_records must be -1 (no limit) or positive")
    records = df if counted is None else df.filter(counted)
    last = (
        chunk_offsets(records, seq, rows)
        .filter(
            (F.col("_offset") < max_records)
            & (F.col("_offset") + F.col("_rows") >= max_records)
        )
        .head()
    )
    if last is None:
        return df
    key = F.col(seq)
    low = last["_part"] * rows
    cut = (
        records.select(seq)
        .filter(
            (key["file"] == last["_file"])
            & (key["block"] == last["_block"])
            & key["idx"].between(low, low + rows - 1)
        )
        .orderBy(key["idx"])
        .limit(max_records - last["_offset"])
        .agg(F.max(key["idx"]).alias("idx"))
        .head()
    )
    file, block, idx = (F.lit(v) for v in (last["_file"], last["_block"], cut["idx"]))
    return df.filter(
        (key["file"] <= file)
        & (
            (key["file"] < file)
            | (key["block"] < block)
            | ((key["block"] == block) & (key["idx"] <= idx))
        )
    )


def in_input_order(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows in input order (a range-partitioned sort)."""
    return df.orderBy(seq)
