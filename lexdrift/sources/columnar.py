"""Article tables in Parquet, read by column position."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.functions.text import decode_utf8, derive_title
from lexdrift.sources.spread import spread

# The three splits and their file names.
SPLIT_FILES = {
    "train": "train.parquet",
    "validation": "validation.parquet",
    "test": "test.parquet",
}
ALL_SPLITS = "all"


def with_sequence(rows: DataFrame, extra: Sequence[str]) -> DataFrame:
    """``(seq, id, text)`` and ``extra`` over a Parquet scan."""
    first, second = rows.columns[0], rows.columns[1]
    meta = F.col("_metadata")
    return rows.select(
        F.struct(
            meta["file_path"].alias("file"),
            F.lit(0).cast("bigint").alias("block"),
            meta["row_index"].alias("idx"),
        ).alias("seq"),
        decode_utf8(F.col(first)).alias("id"),
        decode_utf8(F.col(second)).alias("text"),
        *extra,
    )


def drop_empty(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither NULL nor empty.

    Applied to the stored column, before decoding, the test reaches the scan."""
    empty = F.lit(b"") if dict(rows.dtypes)[column] == "binary" else F.lit("")
    return rows.filter(F.col(column).isNotNull() & (F.col(column) != empty))


def read_columns(
    spark: SparkSession, path: str | list[str], extra: Iterable[str] = ()
) -> DataFrame:
    """``(seq, id, text)`` from the first two columns, whatever their names.

    The rest is pruned at the scan unless named in ``extra``. ``seq`` is the file
    and row position, so it needs no sort and no shuffle to obtain."""
    paths = [path] if isinstance(path, str) else path
    return with_sequence(spark.read.parquet(*paths), list(extra))


def to_articles(scan: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Articles of a Parquet scan: empty text dropped, title from the first line, text
    untouched. There is no annotation and no revision time in this format."""
    rows = spread(with_sequence(drop_empty(scan, scan.columns[1]), list(extra)))
    return rows.select(
        "seq",
        "id",
        derive_title(F.col("text")).alias("title"),
        F.lit(None).cast("string").alias("title_annotation"),
        "text",
        F.lit(None).cast("timestamp_ntz").alias("last_modified"),
        *extra,
    )


def read_articles(
    spark: SparkSession, path: str | list[str], extra: Iterable[str] = ()
) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return to_articles(spark.read.parquet(*paths), list(extra))


def split_names(split: str) -> list[str]:
    """``train``, ``validation``, ``test`` or ``all`` in any case."""
    wanted = split.lower()
    if wanted == ALL_SPLITS:
        return list(SPLIT_FILES)
    if wanted not in SPLIT_FILES:
        raise ValueError(
            f"unknown split {split!r}; use one of {', '.join(SPLIT_FILES)} or {ALL_SPLITS}"
        )
    return [wanted]


def read_split(
    spark: SparkSession, root: str, split: str = ALL_SPLITS, extra: Iterable[str] = ()
) -> DataFrame:
    """Rows of one split or of all three, with the split name as a column.

    Only the files of the wanted splits are listed, so nothing else is opened."""
    names = split_names(split)
    paths = [f"{root.rstrip('/')}/{SPLIT_FILES[name]}" for name in names]
    rows = read_columns(spark, paths, extra)
    # A split may be one file or a folder of part files of that name.
    pattern = rf"/({'|'.join(names)})\.parquet(?:/[^/]*)?$"
    return rows.withColumn("split", F.regexp_extract(F.col("seq.file"), pattern, 1))
