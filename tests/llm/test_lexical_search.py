"""Ranked search against scores of all documents; bounds and skipping on single shards."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexdrift.llm import lexical_search, queries

from .conftest import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def ranked(docs, text, k=10):
    held = [(d["doc_id"], c, c.total()) for d in docs if (c := terms_of(d["text"]))]
    documents, total = len(held), sum(n for _, _, n in held)
    found = []
    weights = {}
    for term, times in terms_of(text).items():
        df = sum(term in c for _, c, _ in held)
        weights[term] = times * math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    for doc_id, counts, n in held:
        m = 25 + 75 * n * documents // total
        score = sum(w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m)) for t, w in weights.items())
        if score > 0:
            found.append((-score, doc_id is None, doc_id))
    return [(doc_id, -score) for score, _, doc_id in sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k]]


def results(df):
    out = defaultdict(list)
    item = "item" if "item" in df.columns else "item_id"
    for r in sorted(df.collect(), key=lambda r: (r[item], r["rank"])):
        out[r["item_id"], r[item]].append((r["rank"], r["doc_id"], r["score"]))
    return out


def check(spark, sf_dir, items_dir, df):
    docs, items = table(sf_dir, "documents"), table(items_dir, "benchmark")
    want = Counter()
    for item in items:
        if found := ranked(docs, item["text"]):
            want[item["item_id"], tuple((k, *f) for k, f in enumerate(found, 1))] += 1
    got = Counter((item_id, tuple(rows)) for (item_id, _), rows in results(df).items())
    assert got == want


@pytest.fixture(scope="module")
def items_dir(tmp_path_factory, edge_dir):
    """Items over the edge documents: null, empty, without terms, unknown and repeated terms, a repeated id."""
    rng = random.Random(4)
    texts = [d["text"] for d in table(edge_dir, "documents") if d["text"]]
    items = [None, "", " .,; ", "zzzz unknown", "same Same SAME", "\x85y z", "A", texts[-1][:20000], texts[20], texts[20]]
    items += [" ".join(rng.sample(rng.choice(texts).split() or ["x"], 1) * rng.randint(1, 3) + rng.choice(texts).split()[:9]) for _ in range(25)]
    ids = [*range(len(items) - 2), 7, None]
    path = str(tmp_path_factory.mktemp("items"))
    pq.write_table(pa.table({"item_id": pa.array(ids, pa.int64()), "text": items, "doc_id": ["clash"] * len(items)}), f"{path}/benchmark.parquet")
    return path


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    df = queries.QUERIES["op11_lexical_search"](spark, sf_dir)
    check(spark, sf_dir, sf_dir, df)


@pytest.mark.parametrize("group_terms, matrix", [(1 << 14, 1 << 23), (60, 1)])
def test_edge_cases_equal_brute_force(spark, edge_dir, items_dir, group_terms, matrix, monkeypatch):
    monkeypatch.setattr(lexical_search, "MATRIX", matrix)
    docs, items = (spark.read.parquet(f"{d}/{n}.parquet") for d, n in ((edge_dir, "documents"), (items_dir, "benchmark")))
    check(spark, edge_dir, items_dir, lexical_search.search(docs, items, group_terms=group_terms))


def test_empty_tables(spark, edge_dir, items_dir):
    docs, items = (spark.read.parquet(f"{d}/{n}.parquet") for d, n in ((edge_dir, "documents"), (items_dir, "benchmark")))
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []


def made_shard(seed: int, n_docs: int = 600, vocabulary: int = 80):
    """Documents of a few topics, and items of those topics."""
    rng = np.random.default_rng(seed)
    topics = [rng.choice(vocabulary, 12, replace=False) for _ in range(8)]
    rows = [np.unique(np.concatenate([rng.choice(topics[d % 8], 6), rng.choice(vocabulary, 2)])) for d in range(n_docs)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    impacts = rng.integers(1, 900_000, offsets[-1])
    places = [np.unique(rng.choice(topics[k], 5)) for k in range(8)]
    made = lexical_search.Queries(places, [rng.integers(1, 9000, len(p)) for p in places], vocabulary)
    ids = rng.permutation(n_docs)
    return lexical_search.Shard(ids, np.zeros(n_docs, bool), offsets, np.concatenate(rows), impacts, made)


@pytest.mark.parametrize("seed", range(4))
def test_summaries_bound_every_document_of_their_block(seed):
    shard = made_shard(seed)
    for term, holders in enumerate(shard.queries.holders):
        if not holders:
            continue
        docs, starts = shard.blocks(term)
        assert sorted(docs) == np.flatnonzero(shard.matrix[:, term]).tolist()
        coordinates = shard.queries.coordinates(term)
        largest = shard.summaries(docs, starts, coordinates)
        for low, high, top in zip(starts, np.append(starts[1:], len(docs)), largest):
            assert 0 < high - low <= 2 * lexical_search.BLOCK
            assert (top == shard.matrix[docs[low:high]][:, coordinates].max(axis=0)).all()


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_skipped_and_the_best_are_found(seed):
    shard = made_shard(seed)
    best = [lexical_search.Best(10) for _ in shard.queries.places]
    scored = shard.search(best)
    blocks = sum(len(shard.blocks(t)[1]) * len(h) for t, h in enumerate(shard.queries.holders))
    assert scored < blocks
    for item, found in enumerate(best):
        scores = shard.matrix[:, shard.queries.places[item]].astype(np.int64) @ shard.queries.weights[item]
        order = np.lexsort([shard.ids, -scores])[:10]
        assert found.scores.tolist() == scores[order].tolist()
        assert found.ids.tolist() == shard.ids[order].tolist()
    assert shard.search(best) <= scored  # the same documents again: all bounds are held against the full list


def test_equal_scores_go_by_id_and_null_last():
    best = lexical_search.Best(3)
    best.add(np.array([5, 5, 5]), np.array([9, 0, 4]), np.array([False, True, False]))
    best.add(np.array([5, 0, 7]), np.array([2, 1, 8]), np.zeros(3, bool))
    assert best.ids.tolist() == [8, 2, 4] and best.scores.tolist() == [7, 5, 5] and best.least == 5
