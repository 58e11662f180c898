from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexdrift.operators import limit_records, with_ordinal


@pytest.fixture(scope="module")
def rows(spark):
    """Positions with gaps over three files; the second holds most rows and two splits."""
    rng = random.Random(1)
    seqs = [("a", 0, i) for i in range(0, 60, 2)]
    seqs += [("b", block, i) for block in (0, 128) for i in range(400) if rng.random() < 0.7]
    seqs += [("c", 0, i) for i in range(5)]
    shuffled = list(enumerate(seqs))
    rng.shuffle(shuffled)
    df = spark.createDataFrame(
        [(n, f, b, i) for n, (f, b, i) in shuffled], "n bigint, file string, block bigint, idx bigint"
    ).select("n", F.struct("file", "block", "idx").alias("seq"))
    return df.repartition(7).cache(), len(seqs)


def test_ordinal_is_the_gapless_input_position(rows):
    df, total = rows
    got = with_ordinal(df, "pos", rows=16).collect()
    assert len(got) == total
    assert all(r["pos"] == r["n"] + 1 for r in got)


def test_limit_keeps_exactly_the_first_rows(rows):
    df, total = rows
    for wanted in (1, 2, 29, 30, 31, 47, 200, total - 1, total, total + 1, 10**9):
        got = sorted(r["n"] for r in limit_records(df, wanted, rows=16).collect())
        assert got == list(range(min(wanted, total))), wanted


def test_limit_without_bound(rows):
    df, total = rows
    assert limit_records(df, -1) is df
    for bad in (0, -2):
        with pytest.raises(ValueError):
            limit_records(df, bad)


def test_limit_of_nothing(rows):
    df, _ = rows
    assert limit_records(df.filter("n < 0"), 5).collect() == []
