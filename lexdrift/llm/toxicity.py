"""Toxicity by subword-bag embeddings.

A word is the bag of its character n-grams and itself, hashed into buckets, so an unseen
misspelling shares most of its vectors with the word it comes from. A text is the average
of its words' vectors; a linear softmax over it is trained jointly with the vectors, in numpy
(Adagrad, one document at a time). As the model is linear in the average, what ships to the
executors is one number per bucket (2^17 of them, 0.5 MB), and a text's score is the mean of
its words' numbers.

The classifier is fitted on the driver on at most ``SAMPLE`` labelled documents of each class, the
first by a hash of their id; the shares of all labelled rows set the prior. Texts are
scored whole.

Defined cases: a null text is empty, and an empty text gets the score of the prior; a null label,
or a label without its document, is not learned from; when there is no example of
one class every score is that of the (smoothed) prior; repeated rows count as often as they come; null ids are
scored; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexdrift.llm.arrow import byte_slices, give_back, per_batch, texts_of
from lexdrift.plans.workspace import stored

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIM = 8
#: Documents seen in training, over and over; never fewer than 6 or more than 30 passes.
STEPS = 40_000
RATE = 0.03
#: Averages of long texts are small: the softmax sees them times this.
GAIN = 64.0
#: Buckets in fewer documents are not learned.
LEAST_DOCS = 3
#: Most documents of each class that the model is fitted on.
SAMPLE = 2000
THRESHOLD = 0.3
EDGES = ".,;:!?\"'()[]"
CACHE_WORDS = 200_000
TEXT_BYTES = 4 << 20
#: New words whose features are hashed at a time.
NEW_WORDS = 1 << 14
#: Of CRC-32, lowest bit first.
POLYNOMIAL = np.uint32(0xEDB88320)


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its n-grams, edges marked."""
    marked = f"<{word}>"
    grams = [marked] + [marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1)]
    crc32 = zlib.crc32
    return [crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams]


def words_of(text: bytes) -> list[str]:
    words = [w.strip(EDGES) for w in text.decode("utf-8", "replace").lower().split()]
    return [w for w in words if w]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (POLYNOMIAL * (table & np.uint32(1)))
    return table


def word_means(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The mean of the weights of each word's `features`, all n-grams of all words at once."""
    marked = [f"<{w}>" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.repeat(np.cumsum(sizes), sizes)  # of each letter's word
    word = np.repeat(np.arange(len(marked)), sizes)
    n_bytes = 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)
    # UTF-8: the first byte tells the length, the others hold six bits each.
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[n_bytes]
    octets = []
    for k in range(int(n_bytes.max(initial=0))):
        shift = (6 * np.maximum(n_bytes - 1 - k, 0)).astype(np.uint32)
        part = letters >> shift
        octets.append((lead | part) if k == 0 else (0x80 | part & np.uint32(0x3F)))
    table, full = _crc_table(), np.uint32(0xFFFFFFFF)
    crc32 = zlib.crc32
    sums = weights[np.fromiter((crc32(m.encode()) % BUCKETS for m in marked), np.int64, len(marked))].astype(np.float64)
    counts = np.ones(len(marked))
    for n in GRAMS:
        places = np.flatnonzero(np.arange(len(letters)) + n <= ends)
        crc = np.full(len(places), full, np.uint32)
        for j in range(n):
            for k, octet in enumerate(octets):
                after = table[(crc ^ octet[places + j]) & np.uint32(255)] ^ (crc >> np.uint32(8))
                crc = after if k == 0 else np.where(n_bytes[places + j] > k, after, crc)
        sums += np.bincount(word[places], weights[(crc ^ full) % np.uint32(BUCKETS)], minlength=len(marked))
        counts += np.bincount(word[places], minlength=len(marked))
    return sums / counts


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes, known: dict[str, float]) -> float:
        return float(self.scores(pa.array([text.decode("utf-8", "replace")]), known)[0])

    def scores(self, texts: pa.Array, known: dict[str, float]) -> np.ndarray:
        """``known`` keeps the means of words as written; those that are nothing but edges have none (nan)."""
        lists = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words, rows = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
        raw = words.dictionary.to_pylist()
        if len(known) > CACHE_WORDS:
            known.clear()
        new = [(w, c) for w in raw if w not in known and (c := w.lower().strip(EDGES))]
        for low in range(0, len(new), NEW_WORDS):
            written, cleaned = zip(*new[low : low + NEW_WORDS])
            known.update(zip(written, word_means(list(cleaned), self.weights).tolist()))
        means = np.array([known.get(w, math.nan) for w in raw])
        value = means[words.indices.to_numpy()]
        held = ~np.isnan(value)
        totals = np.bincount(rows[held], value[held], minlength=len(texts))
        counts = np.bincount(rows[held], minlength=len(texts))
        logits = self.bias + totals / np.maximum(counts, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -500.0, 500.0)))


def _bag(text: bytes, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, each once, and their shares of the average."""
    words = words_of(text)
    places = []
    for w in words:
        found = known.get(w)
        if found is None:
            found = known[w] = np.array(features(w), np.int32)
        places.append(found)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    sizes = np.array([len(p) for p in places])
    shares = np.repeat((1.0 / (sizes * len(words))).astype(np.float32), sizes)
    buckets, where = np.unique(np.concatenate(places), return_inverse=True)
    return buckets, np.bincount(where, shares).astype(np.float32)


def train(texts: list[bytes], labels: list[int], prior: float, seed: int = 7) -> Model:
    """Fit vectors and softmax; ``prior`` is the share of label 1 among all labelled rows."""
    return train_bags([_bag(text, {}) for text in texts], labels, prior, seed)


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float, seed: int = 7) -> Model:
    """The same from texts as buckets and their shares; the list is used up."""
    share = sum(labels) / len(labels) if labels else 0.0
    prior_logit = math.log(prior / (1 - prior))
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), prior_logit)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    seen = np.full(BUCKETS, 1e-10, np.float32)
    softmax, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    seen_softmax, seen_bias = np.full((2, DIM), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    # A bucket that few documents have can only be learned by heart: it stays at zero.
    holders = np.zeros(BUCKETS, np.int32)
    for buckets, _ in bags:
        holders[buckets] += 1
    common = holders >= LEAST_DOCS
    vectors[~common] = 0
    for n, (buckets, shares) in enumerate(bags):  # one by one: the whole ones may be parts of larger arrays
        held = common[buckets]
        bags[n] = buckets[held], shares[held]
    order = np.arange(len(bags))
    epochs = min(30, max(6, STEPS // len(bags)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(order)
        for n in order:
            buckets, shares = bags[n]
            mean = GAIN * (shares @ vectors[buckets])
            logits = softmax @ mean + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[n]] -= 1
            down = GAIN * (error @ softmax)
            step = np.outer(error, mean)
            seen_softmax += step * step
            softmax -= rate * step / np.sqrt(seen_softmax)
            seen_bias += error * error
            bias -= rate * error / np.sqrt(seen_bias)
            if len(buckets):
                scale = shares * shares * float(down @ down / DIM)
                seen[buckets] += scale
                vectors[buckets] -= rate * (shares / np.sqrt(seen[buckets]))[:, None] * down
    weights = GAIN * (vectors @ (softmax[1] - softmax[0]))
    shift = prior_logit - math.log(share / (1 - share))
    return Model(weights.astype(np.float32), float(bias[1] - bias[0]) + shift)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _bagged(rows: DataFrame) -> DataFrame:
    """(doc_id, hash, toxic, times, buckets, shares) of labelled texts."""
    known: dict[str, np.ndarray] = {}

    def bag(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in texts_of(batch.column(4)):
            if len(known) > 50_000:
                known.clear()
            found.append(_bag(text, known))
        buckets, shares = zip(*found)
        columns = [*batch.columns[:4], pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "toxic", "times", "buckets", "shares"])

    schema = "doc_id bigint, hash bigint, toxic int, times bigint, buckets array<int>, shares array<float>"
    return per_batch(rows.select("doc_id", "hash", "toxic", "times", "text"), bag, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled documents that are not held out."""
    given = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    counts = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))

    def first(found: DataFrame, value: int, *order: str) -> DataFrame:
        return found.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), *order).limit(SAMPLE)

    # Only ids are sorted; at most 2 * SAMPLE rows of two numbers go on to meet the texts: a proven bound for a
    # broadcast. An id may be that of many rows, so the bound is kept again behind the join.
    ids = F.broadcast(reduce(DataFrame.unionByName, [first(given, value, "doc_id") for value in (0, 1)]))
    met = stored(rows.select("doc_id", "hash").join(ids, "doc_id"), "labelled")
    chosen = reduce(DataFrame.unionByName, [first(met, value, "doc_id", "hash") for value in (0, 1)])
    chosen = chosen.groupBy("doc_id", "hash", "toxic").agg(F.count("*").alias("times"))
    # Texts become bags where they are: no more than BUCKETS numbers of each come to the driver.
    texts = rows.join(F.broadcast(chosen), ["doc_id", "hash"])
    batches = _bagged(texts).dropDuplicates(["doc_id", "toxic", "hash"]).toArrow().to_batches()
    rows_of = []
    while batches:
        batch = batches.pop()
        keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "hash", "times")))
        for key, buckets, shares in zip(keys, batch.column("buckets"), batch.column("shares")):
            rows_of.append((key, (buckets.values.to_numpy(), shares.values.to_numpy())))
    batch = buckets = shares = None
    rows_of.sort(key=lambda r: r[0])
    labels_of = [key[1] for key, _ in rows_of for _ in range(key[3])]
    bags = [bag for key, bag in rows_of for _ in range(key[3])]
    rows_of.clear()
    model = train_bags(bags, labels_of, prior)
    bags.clear()
    give_back()
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the score of its text."""
    columns = [c for c in keep if c != "score"]
    known: dict[str, float] = {}  # each task starts with its own, empty one

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = len(columns)
        parts = [model.scores(some.column(place), known) for some in byte_slices(batch, place, TEXT_BYTES)]
        found = np.concatenate(parts)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(columns)], pa.array(found, pa.float64())], names=[*columns, "score"]
        )

    kept = docs.select(*columns)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    return per_batch(docs.select(*columns, F.col("text").alias("text to score")), one, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, by a model learned from ``labels``."""
    scored = score(docs, fit(docs, labels), docs.columns)
    return scored.where(F.col("score") < THRESHOLD).select(*docs.columns)
