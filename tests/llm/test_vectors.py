from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.llm import inner_product, neighbours, queries

from .conftest import table


def valid(sf_dir, zero_too):
    rows = {}
    for r in table(sf_dir, "embeddings"):
        v = r["embedding"]
        if v and all(x is not None and math.isfinite(x) for x in v) and (zero_too or any(v)):
            rows[r["vec_id"]] = np.array(v, np.float64)
    return rows


@pytest.mark.parametrize("rows_in_block", [1024, 64])
def test_top_k_is_exact(spark, sf_dir, rows_in_block, monkeypatch):
    monkeypatch.setattr("lexdrift.llm.vectors.ROWS", rows_in_block)
    monkeypatch.setattr("lexdrift.llm.vectors.QUERIES", 4 * rows_in_block // 64)
    rows = {k: np.floor(256 * v).astype(np.int64) for k, v in valid(sf_dir, True).items()}
    want = {}
    for q in rows:
        if q % 50 == 0:
            best = sorted((-int(rows[q] @ x), k) for k, x in rows.items() if k != q)[:5]
            want |= {(q, n): (k, -s) for n, (s, k) in enumerate(best, 1)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in queries.op1_topk(spark, sf_dir).collect()}
    assert got == want


def test_large_components_take_part(spark):
    rng = np.random.default_rng(4)
    rows = {n: (rng.standard_normal(6) * 10.0 ** rng.integers(0, 7)).tolist() for n in range(400)}
    rows |= {0: [1.0, -2.0, 0, 0, 0, 0], 50: [300_000.0, 1, 0, 0, 0, 0], 100: [0, 0, 0, 0, 0, 3.0e6], 401: [2.0**50, 0, 0, 0, 0, 0]}
    rows = {k: [float(x) for x in v] for k, v in rows.items()}
    frame = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    ints = {k: [math.floor(256 * x) for x in v] for k, v in rows.items()}
    got = defaultdict(list)
    for r in inner_product.top_k(frame.where("vec_id <> 401"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, 400, 50):
        scores = ((-sum(a * b for a, b in zip(ints[q], x)), k) for k, x in ints.items() if k not in (q, 401))
        assert got[q] == [(k, -s) for s, k in sorted(scores)[:5]]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        inner_product.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    with pytest.raises(Exception, match="no 64-bit integer"):
        inner_product.top_k(frame.select("vec_id", F.transform("embedding", lambda x: x * 1e30).alias("embedding")), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("rows_in_block", [1024, 64])
def test_nearest(spark, sf_dir, rows_in_block, monkeypatch):
    monkeypatch.setattr("lexdrift.llm.vectors.ROWS", rows_in_block)
    monkeypatch.setattr("lexdrift.llm.neighbours.ROWS", rows_in_block)
    monkeypatch.setattr("lexdrift.llm.vectors.QUERIES", 4 * rows_in_block // 64)
    rows = valid(sf_dir, False)
    got = defaultdict(list)
    for r in sorted(queries.op5_neighbours(spark, sf_dir).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    hits = total = 0
    for q in rows:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((rows[q] - x) ** 2).sum())), k) for k, x in rows.items() if k != q)[:10]
            assert len(got[q]) == len(best) and got[q] == sorted(got[q])
            for s, k in got[q]:
                assert s == pytest.approx(float(np.linalg.norm(rows[q] - rows[k])), abs=1e-12)
            hits += len({k for _, k in best} & {k for _, k in got[q]})
            total += len(best)
    assert hits / total >= 0.95


def test_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_every_row_has_a_cell():
    points = np.random.default_rng(0).standard_normal((500, 8))
    points[:200] = points[0]
    nodes = neighbours.split_tree(points, 16)
    cells = neighbours.cells_of(nodes, points)
    assert len(set(cells)) > 4 and len(set(cells[:200])) == 1
