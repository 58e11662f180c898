"""What both vector searches share: valid vectors, and joins of query blocks with row blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.llm.arrow import matrix
from lexdrift.plans.workspace import stored

#: Rows of the table, and queries, that meet in one task at once.
ROWS, QUERIES = 1024, 4096


def finite(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def split_of(place: Column, counts: dict[int, int]) -> tuple[Column, Column]:
    """Blocks of at most about ROWS rows: the first block and the number of blocks of each
    ``place`` (a bin or cell, of which there are few)."""
    first, parts, upto = [], [], 0
    for k, n in sorted(counts.items()):
        part = max(1, math.ceil(n / ROWS))
        first += [F.lit(k), F.lit(upto)]
        parts += [F.lit(k), F.lit(part)]
        upto += part
    return F.create_map(*first)[place], F.create_map(*parts)[place]


def meet(queries: DataFrame, rows: DataFrame, n_queries: int, function: Callable) -> DataFrame:
    """(query_id, vec_id, score): ``function`` of each block of ``queries`` (block, query_id, vector,
    bound) and of ``rows`` (block, vec_id, vector). Each row meets the queries sent to its block, in
    chunks of about QUERIES of them; both sides of a call are bounded."""
    chunks = max(1, math.ceil(n_queries / QUERIES))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    if chunks > 1:
        # A row is copied for those chunks only that send a query to its block.
        queries = stored(queries, "sent")
        wanted = queries.select("block", F.col("chunk").alias("wanted")).distinct()
        rows = rows.join(wanted, "block").select("block", "vec_id", "vector", F.col("wanted").alias("chunk"))
    else:
        rows = rows.select("block", "vec_id", "vector", F.lit(0).cast("bigint").alias("chunk"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = function(_side(left, "query_id"), _side(right, "vec_id"))
        return pa.table({n: pa.array(a) for n, a in zip(("query_id", "vec_id", "score"), found)}).cast(kind)

    floating = function.floating
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64() if floating else pa.int64())])
    score = "double" if floating else "bigint"
    return (
        queries.groupBy("block", "chunk")
        .cogroup(rows.groupBy("block", "chunk"))
        .applyInArrow(run, f"query_id bigint, vec_id bigint, score {score}")
    )


def _side(table: pa.Table, name: str) -> tuple:
    table = table.combine_chunks()
    vector = table.column("vector").combine_chunks()
    dim = int(vector.value_lengths().to_numpy(zero_copy_only=False).max())
    bound = table.column("bound").to_numpy() if "bound" in table.column_names else None
    numeric = np.int64 if pa.types.is_integer(vector.type.value_type) else np.float64
    return table.column(name).to_numpy(), matrix(vector, dim, numeric), bound


def widened(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def ranked(found: DataFrame, best: Column, k: int) -> DataFrame:
    """The first ``k`` of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(best, F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def first_k(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` smallest scores, ties to the smaller id."""
    order = np.lexsort((vec, score, query))
    run = query[order]
    start = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    place = np.arange(len(run)) - np.maximum.accumulate(np.where(start, np.arange(len(run)), 0)) if len(run) else run
    return order[place < k]
