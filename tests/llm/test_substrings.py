from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from lexdrift.llm import queries, substrings

from .test_contracts import documents, words_of


def brute(docs):
    """First start of every window, then the words of later ones."""
    last = 1 << 63
    order = sorted(docs, key=lambda d: last if d[0] is None else d[0])
    first = {}
    for doc_id, text, _ in order:
        words = words_of(text)
        for k in range(len(words) - 19):
            first.setdefault(tuple(words[k : k + 20]), (last if doc_id is None else doc_id, k))
    out = Counter()
    for doc_id, text, _ in docs:
        words = words_of(text)
        gone = set()
        for k in range(len(words) - 19):
            if first[tuple(words[k : k + 20])] < (last if doc_id is None else doc_id, k):
                gone |= set(range(k, k + 20))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[(doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("chunk", [400_000, 300])
def test_against_brute_force(spark, sf_dir, chunk, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    got = Counter(tuple(r) for r in queries.op4_substrings(spark, sf_dir).collect())
    assert got == brute(documents(sf_dir))
    assert sum(k[2] for k in got) > 0


def test_random_repeats(spark, monkeypatch):
    """Many overlapping repeats over few words, in small batches and chunks."""
    monkeypatch.setattr(substrings, "CHUNK", 200)
    rng = np.random.default_rng(4)
    passages = [[f"w{x}" for x in rng.integers(0, 6, 50)] for _ in range(6)]
    docs = []
    for k in range(150):
        words = []
        for _ in range(rng.integers(1, 5)):
            p = passages[rng.integers(0, 6)]
            a = rng.integers(0, 25)
            words += p[a : a + rng.integers(5, 45)] + [f"u{x}" for x in rng.integers(0, 3, rng.integers(0, 4))]
        docs.append((k, " ".join(words), None))
    frame = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id bigint, text string").repartition(5)
    rows = substrings.deduplicated(frame).collect()
    got = Counter((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows)
    assert got == brute(docs)


def test_rows_without_ids_and_repeated_ids(spark):
    """Rows are told apart where ids don't: null ids, and one id with two texts."""
    passage, other = ([f"{c}{k}" for k in range(25)] for c in "pq")
    clean = [f"c{k}" for k in range(60)]
    docs = [
        (None, " ".join(passage + clean[:30])),
        (None, " ".join(clean[30:] + [f"d{k}" for k in range(30)])),
        (None, " ".join(other)),
        (None, " ".join(other)),
        (None, "short text"),
        (None, "short text"),
        (1, " ".join(passage)),
        (2, " ".join([*passage, "x", "y"])),
        (2, " ".join([f"e{k}" for k in range(40)])),
    ]
    rows = substrings.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    want = [
        (None, 55, 25, " ".join(clean[:30])),
        (None, 60, 0, docs[1][1]),
        (None, 25, 0, docs[2][1]),
        (None, 25, 25, ""),
        (None, 2, 0, "short text"),
        (None, 2, 0, "short text"),
        (1, 25, 0, docs[6][1]),
        (2, 27, 25, "x y"),
        (2, 40, 0, docs[8][1]),
    ]
    assert Counter(map(tuple, rows)) == Counter(want)
