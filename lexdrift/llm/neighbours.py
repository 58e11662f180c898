"""Approximate nearest neighbours: a kd-tree over a few 2-stable projections.

Vectors are projected onto ``PROJECTIONS`` Gaussian directions; for a vector at distance d, the squared projected
distance over d^2 is chi-square distributed. The upper levels of a kd-tree are fitted on a bounded sample of
projected rows and every row is put into its cell; a cell is cut into blocks of bounded
size, each with a kd-tree of its own. A query searches its own cell first. Then it visits leaf
after leaf by projected distance and verifies what they hold in the original space, until the
next leaf's projected distance exceeds the chi-square quantile of the k-th distance found: a
vector as near as that would lie so far off with probability 1 - CERTAINTY only. Cells for which the
test holds at once are not visited. No candidate is capped.

On the driver are the sample of at most ``SAMPLE`` rows and the boxes of at most ``CELLS`` cells.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and
rows with a null id take no part; shorter vectors count as padded with zeros; ties go to the smaller id, repeated
vectors are candidates each; rows with the query's id are its own; a query id that comes twice is one query; fewer
candidates than k give fewer rows, an empty table none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.arrow import matrix, per_batch
from lexdrift.llm.vectors import ROWS, finite, first_k, meet, ranked, split_of, widened
from lexdrift.plans.workspace import stored

K = 10
PROJECTIONS = 8
CERTAINTY = 0.98
SAMPLE = 16_384
CELLS = 1024
LEAF = 32
SEED = 11


def chi_square_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""

    def share(x: float) -> float:
        term, total = 1.0, 1.0
        for n in range(1, freedom // 2):
            term *= x / 2 / n
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if share(middle) < p else (low, middle)
    return high


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def split_tree(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, below, above) of a kd-tree; a leaf is (-1, 0, its cell, 0)."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(part: np.ndarray, want: int) -> int:
        nonlocal made
        place = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        spread = np.ptp(part, axis=0) if len(part) > 1 else np.zeros(PROJECTIONS)
        axis = int(spread.argmax())
        cut = float(np.median(part[:, axis])) if spread[axis] > 0 else 0.0
        below = part[:, axis] < cut
        if want < 2 or not 0 < below.sum() < len(part):
            nodes[place] = (-1, 0.0, made, 0)
            made += 1
        else:
            a = grow(part[below], want // 2)
            nodes[place] = (axis, cut, a, grow(part[~below], want - want // 2))
        return place

    grow(points, cells)
    return nodes


def cells_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        axis, cut, a, b = nodes[node]
        if axis < 0:
            out[rows] = a
        elif len(rows):
            below = points[rows, axis] < cut
            todo += [(a, rows[below]), (b, rows[~below])]
    return out


def _leaves(points: np.ndarray) -> np.ndarray:
    """Rows of a kd-tree's leaves of at most LEAF points, -1 where a leaf has fewer."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            done.append(np.pad(rows, (0, LEAF - len(rows)), constant_values=-1))
            continue
        values = points[rows]
        rows = rows[np.argsort(values[:, np.ptp(values, axis=0).argmax()], kind="stable")]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return np.stack(done)


def search(queries: tuple, rows: tuple, turn: np.ndarray, k: int, quantile: float) -> tuple:
    """The nearest ``k`` that each query finds in a block; ``bound`` is a k-th distance known."""
    (query_ids, q, bound), (vec_ids, x, _), dim = queries, rows, len(turn)
    q, x = widened(q, dim), widened(x, dim)
    projected, points = q @ turn, x @ turn
    leaves = _leaves(points)
    filled = np.where((leaves >= 0)[..., None], points[leaves], np.nan)
    low, high = np.nanmin(filled, axis=1), np.nanmax(filled, axis=1)
    apart = np.stack([(np.maximum(0, np.maximum(low - p, p - high)) ** 2).sum(axis=1) for p in projected])
    order = np.argsort(apart, axis=1)
    best = np.where(np.isnan(bound), np.inf, bound)
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    open_ = np.arange(len(q))
    for turn_no in range(len(leaves)):
        # The stopping test: the next leaf is too far in projection for a nearer vector.
        leaf = order[open_, turn_no]
        open_ = open_[apart[open_, leaf] <= quantile * best[open_] ** 2]
        if not len(open_):
            break
        places = leaves[order[open_, turn_no]]
        apart_now = x[places] - q[open_, None, :]
        distance = np.sqrt((apart_now * apart_now).sum(axis=2))
        good = (places >= 0) & (distance <= best[open_, None]) & (vec_ids[places] != query_ids[open_, None])
        a, b = np.nonzero(good)
        if not len(a):
            continue
        kept = [np.concatenate(c) for c in zip(kept, (open_[a], places[a, b], distance[a, b]))]
        chosen = first_k(kept[0], vec_ids[kept[1]], kept[2], k)
        kept = [c[chosen] for c in kept]
        full = np.bincount(kept[0], minlength=len(q)) == k
        worst = np.zeros(len(q))
        np.maximum.at(worst, kept[0], kept[2])
        best = np.where(full, np.minimum(best, worst), best)
    return query_ids[kept[0]], vec_ids[kept[1]], kept[2]


def nearest(table: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row of ``table``
    (vec_id, embedding) that ``is_query`` holds for, by Euclidean distance."""
    not_zero = F.exists("embedding", lambda x: x != 0)
    valid = table.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & not_zero)
    rows = valid.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    turn = directions(head["d"] or 1)

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch.column(1), len(turn)) @ turn

    def projections(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(project(batch)))], names=["point"])

    # Of the sample only its projections come to the driver.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    points = per_batch(sample, projections, "point array<double>").toArrow()["point"].to_pylist()
    nodes = split_tree(
        np.array(points, np.float64).reshape(-1, PROJECTIONS), min(CELLS, max(1, math.ceil(head["n"] / ROWS)))
    )

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        projected = project(batch)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(list(projected)), pa.array(cells_of(nodes, projected))],
            names=["vec_id", "vector", "point", "cell"],
        )

    schema = "vec_id bigint, vector array<double>, point array<double>, cell bigint"
    rows = stored(per_batch(rows, place, schema), "cells")
    axes = range(PROJECTIONS)
    sides = [f(F.col("point")[a]).alias(f"{n}{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]
    boxes = rows.groupBy("cell").agg(F.count("*").alias("n"), *sides).collect()
    first, parts = split_of(F.col("cell"), {r["cell"]: r["n"] for r in boxes} or {0: 1})
    block = (first + F.pmod(F.xxhash64("vec_id"), parts)).cast("int")
    blocks = stored(rows.select(block.alias("block"), "vec_id", "vector"), "blocks")

    queries = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(
        F.min_by(F.struct("vector", "point", "cell"), "vector").alias("row")
    )
    queries = stored(queries.select("query_id", "row.*"), "queries")
    n_queries = queries.count()
    quantile = chi_square_quantile(CERTAINTY, PROJECTIONS)

    def best(left: tuple, right: tuple) -> tuple:
        return search(left, right, turn, k, quantile)

    best.floating = True
    own = queries.withColumn("block", F.explode(F.sequence(first, first + parts - 1))).select(
        "block", "query_id", "vector", F.lit(None).cast("double").alias("bound")
    )
    near = stored(meet(own, blocks, n_queries, best), "near")
    near = ranked(near, F.asc("score"), k)
    bound = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("bound"))

    box = F.array(
        *[
            F.struct(
                F.lit(r["cell"]).alias("cell"),
                F.array(*[F.lit(r[f"low{a}"]) for a in axes]).alias("low"),
                F.array(*[F.lit(r[f"high{a}"]) for a in axes]).alias("high"),
            )
            for r in boxes
        ]
    )
    gap = sum(
        F.pow(F.greatest(F.lit(0.0), F.col("box.low")[a] - F.col("point")[a], F.col("point")[a] - F.col("box.high")[a]), 2)
        for a in axes
    )
    sent = (
        queries.join(bound, "query_id", "left")
        .withColumn("box", F.explode(box) if boxes else F.explode(F.array().cast("array<struct<cell:bigint,low:array<double>,high:array<double>>>")))
        .where(F.col("box.cell") != F.col("cell"))
        .where(F.col("bound").isNull() | (gap <= quantile * F.pow("bound", 2)))
        .withColumn("cell", F.col("box.cell"))
        .withColumn("block", F.explode(F.sequence(first, first + parts - 1)))
        .select("block", "query_id", "vector", "bound")
    )
    found = near.select("query_id", "vec_id", "score").unionByName(meet(sent, blocks, n_queries, best))
    return ranked(found, F.asc("score"), k)
