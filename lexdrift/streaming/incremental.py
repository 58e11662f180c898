"""Compare article shards as they arrive.

The same row-wise logic as the batch job over a stream of Parquet shards or dump files. The comparison has no
state: every shard is finished on its own, and the checkpoint remembers which shards are done. Running
counters are the state of a second stream, over the table that the first one appends to: each of its
rows is counted once, whatever is started again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexdrift.operators.analyzers import Analyzer, LexiconAnalyzer, resolve
from lexdrift.operators.compare import compare
from lexdrift.operators.row_lexicon import fits_rows
from lexdrift.operators.summary import COUNTERS, count_records
from lexdrift.plans.jobs import lean
from lexdrift.sources import columnar, dump


def read_shards(
    spark: SparkSession, path: str, schema=None, files_per_trigger: int = 1000, extra=()
) -> DataFrame:
    """Articles of a folder that receives Parquet shards. Without ``schema`` the one of
    the shards already there is used."""
    schema = schema or spark.read.parquet(path).schema
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
    return columnar.to_articles(rows, list(extra))


def read_dump_shards(
    spark: SparkSession, path: str, page_tag: str = dump.PAGE_TAG, files_per_trigger: int = 1000, strict: bool = False
) -> DataFrame:
    """Articles of a folder that receives dump files, plain or compressed; pages that cannot be parsed are
    rows with ``reject``."""
    pages = dump.stream_pages(spark, path, page_tag, files_per_trigger)
    return dump.articles_of_pages(pages, strict, page_tag, keep_rejects=True)


def start_compare(
    shards: DataFrame,
    sink_path: str,
    checkpoint_path: str,
    old: Analyzer | str,
    new: Analyzer | str,
    distinct_types: bool = False,
    keep_results: str = "differing",
) -> StreamingQuery:
    """Compare every shard not seen before and append to the table at ``sink_path``; the
    query ends when the shards present at its start are done.

    A lexicon takes part if it is small enough to be looked up in the row: the lookup by
    shuffle regroups tokens, which in a stream would be state without an end."""
    old, new = resolve(old), resolve(new)
    lexicons = [a for a in (old, new) if isinstance(a, LexiconAnalyzer)]
    if lexicons and not fits_rows(lexicons):
        names = ", ".join(a.name for a in lexicons)
        raise ValueError(f"the lexicons of {names} are too large to be looked up in a stream")
    keep_all = keep_results == "all"
    compared = lean(compare(shards, old, new, distinct_types, all_results=keep_all), keep_all)
    return (
        compared.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def start_counters(spark: SparkSession, sink_path: str, checkpoint_path: str) -> StreamingQuery:
    """Add the rows of the table at ``sink_path`` that were not counted yet to the counters kept under
    ``checkpoint_path``; ends when the rows present at its start are counted."""
    rows = spark.readStream.schema(spark.read.parquet(sink_path).schema).parquet(sink_path)
    return (
        count_records(rows)
        .writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def read_counters(spark: SparkSession, checkpoint_path: str) -> DataFrame:
    """The counters as the engine keeps them, one row; see :func:`lexdrift.operators.summary.count_records`."""
    state = spark.read.format("statestore").load(checkpoint_path)
    # The engine names a counter by its function, so they are told by place; without rejects there is no last one.
    kept = COUNTERS[: len(state.schema["value"].dataType.fields)]
    value = F.col("value").cast(f"struct<{', '.join(f'{c}: bigint' for c in kept)}>")
    counts = state.select(value.alias("value")).select("value.*")
    none = F.lit(0).cast("bigint")
    return counts.agg(*[(F.coalesce(F.sum(c), none) if c in kept else none).alias(c) for c in COUNTERS])
