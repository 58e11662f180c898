from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexdrift.llm import queries, toxicity

from .conftest import table


def test_every_document_is_scored(spark, sf_dir):
    rows = queries.op7_toxicity(spark, sf_dir).collect()
    docs = table(sf_dir, "documents")
    assert Counter(r["doc_id"] for r in rows) == Counter(d["doc_id"] for d in docs)
    for r in rows:
        want = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == want
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_score_is_the_mean_of_words(spark):
    model = toxicity.train([b"bad idiot here", b"good day here"] * 20, [1, 0] * 20, 0.5)
    one = model.score(b"idiot", {})
    assert one > 0.5 > model.score(b"day", {})
    # An unseen misspelling shares n-grams with the word it comes from.
    assert model.score(b"idiots", {}) > 0.5
    assert model.score(b"", {}) == pytest.approx(model.score(b" ,. ", {}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=12), min_size=1, max_size=8))
def test_means_of_all_words_at_once(words):
    weights = np.random.default_rng(1).standard_normal(toxicity.BUCKETS).astype(np.float32)
    want = [weights[toxicity.features(w)].astype(np.float64).mean() for w in words]
    assert toxicity.word_means(words, weights) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_scores_against_brute_force(spark, sf_dir):
    """Every document's score from the model's weights, word by word."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(docs, model, ["doc_id"]).collect())
    want = Counter()
    for d in table(sf_dir, "documents"):
        words = toxicity.words_of((d["text"] or "").encode())
        means = [model.weights[toxicity.features(w)].astype(np.float64).mean() for w in words]
        logit = model.bias + (sum(means) / len(means) if means else 0)
        want[d["doc_id"], round(1 / (1 + math.exp(-logit)), 9)] += 1
    assert got == want


def brute_training(texts, labels, prior, seed=7):
    """The vectors and the softmax written out letter by letter: one document at a time, every bucket of it."""
    rng = np.random.default_rng(seed)
    size, dim = toxicity.BUCKETS, toxicity.DIM
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    bags = []
    for text in texts:
        words = toxicity.words_of(text)
        bag = defaultdict(float)
        for w in words:
            found = toxicity.features(w)
            for bucket in found:
                bag[bucket] += 1 / len(found) / len(words)
        bags.append(bag)
    rare = [b for b, n in Counter(b for bag in bags for b in bag).items() if n < toxicity.LEAST_DOCS]
    softmax, bias = np.zeros((2, dim)), np.zeros(2)
    seen, seen_softmax, seen_bias = defaultdict(lambda: 1e-10), np.full((2, dim), 1e-8), np.full(2, 1e-8)
    order = np.arange(len(bags))
    epochs = min(30, max(6, toxicity.STEPS // len(bags)))
    for epoch in range(epochs):
        rate = toxicity.RATE * (1 - epoch / epochs)
        rng.shuffle(order)
        for n in order:
            bag = {b: s for b, s in bags[n].items() if b not in rare}
            mean = toxicity.GAIN * sum((s * vectors[b].astype(float) for b, s in bag.items()), np.zeros(dim))
            odds = np.exp(softmax @ mean + bias)
            error = odds / odds.sum() - np.eye(2)[labels[n]]
            down = toxicity.GAIN * (error @ softmax)
            for c in range(2):
                for d in range(dim):
                    seen_softmax[c, d] += (error[c] * mean[d]) ** 2
                    softmax[c, d] -= rate * error[c] * mean[d] / math.sqrt(seen_softmax[c, d])
                seen_bias[c] += error[c] ** 2
                bias[c] -= rate * error[c] / math.sqrt(seen_bias[c])
            for b, s in bag.items():
                seen[b] += s * s * float(down @ down) / dim
                vectors[b] -= rate * s / math.sqrt(seen[b]) * down
    share = sum(labels) / len(labels)
    shift = math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    weights = {b: toxicity.GAIN * float(vectors[b] @ (softmax[1] - softmax[0])) for bag in bags for b in bag if b not in rare}
    return weights, bias[1] - bias[0] + shift


def test_training_against_brute_force():
    texts = [b"you bad idiot", b"a good day", b"bad bad luck idiot", b"good luck, all day", b"idiots are bad", b"day by day"] * 4
    labels = [1, 0, 1, 0, 1, 0] * 4
    model = toxicity.train(texts, labels, 0.3)
    weights, bias = brute_training(texts, labels, 0.3)
    assert model.bias == pytest.approx(bias, abs=1e-3)
    for bucket, weight in weights.items():
        assert model.weights[bucket] == pytest.approx(weight, rel=0.02, abs=0.02)


def test_a_repeated_id_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 6)
    rows = [(1, f"bad text {n}") for n in range(50)] + [(n, f"good day {n}") for n in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1)] + [(n, 0) for n in range(3, 40)], "doc_id bigint, toxic int")
    sizes = []
    monkeypatch.setattr(toxicity, "train_bags", lambda bags, of, prior: sizes.append(Counter(of)))
    toxicity.fit(docs, labels)
    assert sizes == [Counter({1: 6, 0: 6})]


def test_one_class_only_gives_the_prior():
    model = toxicity.train([b"a"], [0], 0.25)
    assert model.score(b"anything", {}) == pytest.approx(0.25)


def test_held_out_accuracy(spark):
    import os

    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    truth = {r["doc_id"]: r["toxic"] for r in table(sf_dir, "labels")}
    rows = [r for r in queries.op7_toxicity(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in truth]
    hit = [r["predicted"] for r in rows if truth[r["doc_id"]] == 1]
    false = [r["predicted"] for r in rows if truth[r["doc_id"]] == 0]
    assert sum(hit) / len(hit) > 0.55 and sum(false) / len(false) < 0.05
