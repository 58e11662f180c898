"""Exact top-k search by inner product.

Vectors are binned by length, the longest first, and a bin is cut into blocks of bounded size. All
are turned by the rotation that the singular vectors of the whole table give, so that the first
coordinates carry most of every product. A query first meets the block of the longest vectors,
which gives it k products to beat; after that it is sent to those bins only whose longest vector could
reach them by Cauchy-Schwarz. In a block, rows are taken by descending length: the product of
the leading coordinates plus the product of the residual lengths bounds each product from above,
and what can still reach the k-th best is computed exactly, in integers.

Only sums over the table (d x d moments, bins) come to the driver; d is the number of
dimensions.

Products are exact: sums wrap around at 64 bits, so those that fit come out right, and one that does not
stops the job, as does a component that is no 64-bit integer.

Defined cases: vectors that are null, empty or hold null or non-finite components and rows with a
null id take no part; shorter vectors
count as padded with zeros; ties go to the smaller id, repeated vectors are candidates each;
rows with the query's id are its own; a query id that comes twice is one query; fewer candidates than k give
fewer rows, an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.arrow import matrix
from lexdrift.llm.vectors import ROWS, finite, first_k, meet, ranked, split_of, widened
from lexdrift.plans.workspace import stored

K = 5
SCALE = 256
#: Products are known to fit 64 bits below it, as are components.
LARGEST = 2.0**63 * (1 - 1e-9)
BINS = 32
CHUNK = 256


def quantized(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) with integer components floor(scale * x)."""
    valid = table.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    too_large = F.raise_error(F.lit("a component is no 64-bit integer")).cast("bigint")

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled).cast("bigint")).otherwise(too_large)

    ints = F.transform("embedding", whole)
    return valid.select("vec_id", ints.alias("vector"))


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all rows, from the sum of their outer products."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["m"])

    # One array of each task.
    parts = rows.select("vector").mapInArrow(moments, "m array<double>")
    sums = parts.select(F.posexplode("m").alias("place", "m")).groupBy("place").agg(F.sum("m").alias("m")).collect()
    total = np.zeros(dim * dim)
    for row in sums:
        total[row["place"]] = row["m"]
    _, vectors = np.linalg.eigh(total.reshape(dim, dim))
    return vectors[:, ::-1]


def exact_products(q: np.ndarray, x: np.ndarray, turned_q: np.ndarray, turned_x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; their turned forms tell in floating point whether one fits 64 bits."""
    about = np.einsum("ij,ij->i", turned_q, turned_x)
    if np.abs(about).max(initial=0) >= LARGEST:
        raise OverflowError("a product does not fit 64 bits")
    return np.einsum("ij,ij->i", q, x)


def search(queries: tuple, rows: tuple, turn: np.ndarray, k: int) -> tuple:
    """The best ``k`` of a block for each query, if they reach its bound."""
    (query_ids, q, bound), (vec_ids, x, _), dim = queries, rows, len(turn)
    q, x = widened(q, dim), widened(x, dim)
    lengths = np.linalg.norm(x.astype(np.float64), axis=1)
    order = np.argsort(-lengths, kind="stable")
    x, vec_ids, lengths = x[order], vec_ids[order], lengths[order]
    turned_x, turned_q = x @ turn, q @ turn
    lead = max(1, dim // 4)
    rest_x, rest_q = (np.linalg.norm(t[:, lead:], axis=1) for t in (turned_x, turned_q))
    q_lengths = np.linalg.norm(q.astype(np.float64), axis=1)
    least = np.where(np.isnan(bound), -np.inf, bound)
    kept = [np.zeros(0, np.int64)] * 3  # query place, vector place, negative product
    for low in range(0, len(x), CHUNK):
        high = min(low + CHUNK, len(x))
        for q_low in range(0, len(q), CHUNK):
            part = slice(q_low, q_low + CHUNK)
            # Rounding errors are far below the slack.
            slack = 1e-9 * q_lengths[part] * lengths[low] + 0.5
            if (q_lengths[part] * lengths[low] + slack < least[part]).all():
                continue
            most = turned_q[part, :lead] @ turned_x[low:high, :lead].T + np.outer(rest_q[part], rest_x[low:high])
            a, b = np.nonzero(most + slack[:, None] >= least[part, None])
            a, b = a + q_low, b + low
            other = query_ids[a] != vec_ids[b]
            a, b = a[other], b[other]
            product = exact_products(q[a], x[b], turned_q[a], turned_x[b])
            high_enough = product >= least[a]
            kept = [np.concatenate(c) for c in zip(kept, (a[high_enough], b[high_enough], -product[high_enough]))]
        best = first_k(kept[0], vec_ids[kept[1]], kept[2], k)
        kept = [c[best] for c in kept]
        full = np.bincount(kept[0], minlength=len(q)) == k
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, kept[0], -kept[2])
        least = np.where(full, np.maximum(least, worst), least)
    return query_ids[kept[0]], vec_ids[kept[1]], -kept[2]


def _bin_of(length: Column, bounds: list[float]) -> Column:
    """The number of bounds above the length: bin 0 holds the longest vectors."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > length))


def top_k(table: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer products of every row of
    ``table`` (vec_id, embedding) that ``is_query`` holds for."""
    rows = quantized(table)
    squares = F.aggregate("vector", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x)
    rows = stored(rows.withColumn("length", F.sqrt(squares)), "vectors")
    shares = [n / BINS for n in range(1, BINS)]
    head = rows.agg(F.percentile_approx("length", shares, 1000).alias("b"), F.max(F.size("vector")).alias("d")).first()
    bounds, dim = sorted(set(head["b"] or [0.0])), head["d"] or 1
    turn = rotation(rows, dim)

    rows = rows.withColumn("bin", _bin_of(F.col("length"), bounds))
    bins = {r["bin"]: r for r in rows.groupBy("bin").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}
    queries = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    queries = stored(queries, "queries")
    n_queries = queries.count()
    if not n_queries:
        return queries.select("query_id", F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("score"))
    first, parts = split_of(F.col("bin"), {b: r["n"] for b, r in bins.items()})
    block = (first + F.pmod(F.xxhash64("vec_id"), parts)).cast("int")
    rows = stored(rows.select(block.alias("block"), "vec_id", "vector"), "blocks")

    def best(left: tuple, right: tuple) -> tuple:
        return search(left, right, turn, k)

    best.floating = False
    none = F.lit(None).cast("double")
    seeds = queries.select(F.lit(0).alias("block"), "query_id", "vector", none.alias("bound"))
    seeded = stored(meet(seeds, rows.where("block = 0"), n_queries, best), "seeds")
    bound = seeded.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score").cast("double")).alias("bound")
    )
    longest = [(b, float(r["longest"])) for b, r in sorted(bins.items())]
    q_length = F.sqrt(F.aggregate("vector", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x))
    options = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(n).alias("longest")) for b, n in longest])
    sent = (
        queries.join(bound, "query_id", "left")
        .withColumn("length", q_length)
        .withColumn("option", F.explode(options))
        .where("bound IS NULL OR length * option.longest * (1 + 1e-9) + 0.5 >= bound")
        .withColumn("bin", F.col("option.bin"))
        .withColumn("block", F.explode(F.sequence(first, first + parts - 1)))
        .where("block > 0")
        .select("block", "query_id", "vector", "bound")
    )
    found = seeded.unionByName(meet(sent, rows.where("block > 0"), n_queries, best))
    return ranked(found, F.desc("score"), k)
