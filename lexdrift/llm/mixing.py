"""Mixing sources to target weights.

Each source's words, document after document, are packed into blocks of ``block`` words. The
mix has as many slots as its targets ask for, dealt out to output shards of ``shard`` slots:
how many slots of a shard go to each source is a multinomial draw under the condition that
all shards together give every source its quota. The draw halves the range of shards again and again,
so any task finds the counts of its shards and the number of earlier slots of each source
from the seed alone. A source's slot j reads the block at ``j mod blocks`` of a pseudorandom
permutation, another one for every pass over the source. Slots and blocks are joined by index.

On the driver are one row of sums per source and nothing else; the number of sources is taken
to be moderate (a shard's counts are one number per source by definition).

Defined cases: a null text has no words; null is a source of its own, after all others; a
document without words is taken zero times; repeated rows and ids count as documents of their
own; an empty table gives an empty mix. Blocks are joined on (source, index), so a hot source
is spread like any other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexdrift.llm.arrow import WORD, per_batch, texts_of
from lexdrift.plans.workspace import stored

WEIGHTS = (5, 2, 1)
#: A source is read at most so many times.
CEILING = 3
BLOCK = 32
SHARD = 4096
SEED = 20_231
WORDS, BLANKS = re.compile(rb"[^\x20\x09-\x0D]+"), b" \t\n\v\f\r"
#: Documents of one source that one window numbers.
BUCKET = 1000
#: The generator's limit of a draw without replacement.
DRAW_LIMIT = 1_000_000_000
#: From this variance on a draw is taken as normal.
NORMAL = 10_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of the total by weight; none above CEILING times its size, the excess reshared."""
    held: set[int] = set()
    total = float(sum(sizes))
    while True:
        rest = total - sum(CEILING * sizes[k] for k in held)
        weight = sum(w for k, w in enumerate(weights) if k not in held)
        found = [
            float(CEILING * n) if k in held else rest * w / weight for k, (n, w) in enumerate(zip(sizes, weights))
        ]
        above = {k for k, (t, n) in enumerate(zip(found, sizes)) if k not in held and t > CEILING * n}
        if not above:
            return found
        held |= above


def sources(sized: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS) -> tuple[list[Source], int]:
    """All sources by code point, null last, with their targets; and the number of documents."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    wanted = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))]) if rows else []
    made = []
    for row, size, target in zip(rows, sizes, wanted):
        blocks = -(-size // block)
        # In blocks of the source's mean length, since its last one may be short.
        slots = min(CEILING * blocks, round(target * blocks / size)) if size else 0
        made.append(Source(row["source"], size, target, blocks, slots))
    return made, sum(r["n"] for r in rows)


def source_table(spark: SparkSession, made: list[Source]) -> DataFrame:
    rows = [(s.name, s.size, s.target) for s in made]
    table = spark.createDataFrame(rows, "source string, source_size bigint, target double")
    return table.select(source_key(F.col("source")).alias("key"), "source_size", "target")


def numbered(sized: DataFrame, documents: int) -> DataFrame:
    """``sized`` (source, size, doc_id, ...) with ``key`` and ``at``, the words of its source
    before each row: sums over buckets of documents, then within a bucket."""
    buckets = max(1, math.ceil(documents / BUCKET))
    text = [F.xxhash64("text")] if "text" in sized.columns else []
    # One id, or none, may be that of many documents.
    rows = sized.withColumn("key", source_key(F.col("source"))).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "size", *text), F.lit(buckets))
    )
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words")
    rows = rows.join(sums.select("key", "bucket", before.alias("base")), ["key", "bucket"])
    # Rows that agree in all of the order are alike, whichever comes first.
    order = [F.col("doc_id"), F.col("size"), *text]
    own = F.sum("size").over(
        Window.partitionBy("key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return rows.withColumn("at", F.col("base") + own - F.col("size")).drop("bucket", "base")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """What of each document lies in each block: (key, index, at, start, words)."""
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    spread = rows.where("size > 0").select("key", "at", "size", F.explode(F.sequence(first, last)).alias("index"))
    start = F.greatest(F.col("index") * block - F.col("at"), F.lit(0))
    end = F.least((F.col("index") + 1) * block - F.col("at"), F.col("size"))
    return spread.select("key", "index", "at", start.alias("start"), (end - start).alias("words"))


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: four Feistel rounds over the next
    power of four, walked on until the value lies below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng([SEED, seed, n]).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= key
            left, right = right, left ^ ((mixed >> np.uint64(32)) & low)
        return left << shift | right

    out = once(index.astype(np.uint64))
    while len(todo := np.flatnonzero(out >= n)):
        out[todo] = once(out[todo])
    return out.astype(np.int64)


def _drawn(count: int, rest: int, taken: int, rng: np.random.Generator) -> int:
    """How many of ``count`` are among ``taken`` drawn without replacement from them and ``rest`` others.

    The generator draws from fewer than 10^9. Of more, a draw is binomial but for a relative error of
    1 / 10^9 each if either number is small, and normal with the same mean and variance otherwise."""
    total = count + rest
    if total < DRAW_LIMIT:
        return int(rng.hypergeometric(count, rest, taken)) if taken else 0
    low, high = max(0, taken - rest), min(count, taken)
    mean = count * (taken / total)
    variance = mean * (rest / total) * ((total - taken) / (total - 1))
    if variance > NORMAL:
        found = round(rng.normal(mean, math.sqrt(variance)))
    elif 2 * count <= total and 2 * taken <= total:
        found = int(rng.binomial(high, max(count, taken) / total))
    elif 2 * count > total:
        found = taken - _drawn(rest, count, taken, rng)
    else:
        found = count - _drawn(count, rest, total - taken, rng)
    return min(max(found, low), high)


def _halved(counts: np.ndarray, taken: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's slots are among ``taken`` drawn from all without replacement."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for k, count in enumerate(counts.tolist()):
        rest -= count
        out[k] = _drawn(count, rest, taken, rng)
        taken -= int(out[k])
    return out


def shard_counts(slots: list[int], shard: int, seed: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of shard ``number`` by source, and the numbers of slots before it."""
    counts = np.array(slots, np.int64)
    before, low, high = np.zeros_like(counts), 0, -(-int(counts.sum()) // shard)
    while high - low > 1:
        middle = (low + high) // 2
        left = _halved(counts, (middle - low) * shard, np.random.default_rng([seed, low, high]))
        if number < middle:
            counts, high = left, middle
        else:
            counts, before, low = counts - left, before + left, middle
    return counts, before


def slots(spark: SparkSession, made: list[Source], shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The plan of the mix: (shard, slot, key, pass, index), one row per slot."""
    quota, blocks = [s.slots for s in made], [s.blocks for s in made]
    names = pa.array(["" if s.name is None else f"={s.name}" for s in made])
    shards = -(-sum(quota) // shard)

    def rows(number: int) -> pa.RecordBatch:
        counts, before = shard_counts(quota, shard, seed, number)
        source = np.repeat(np.arange(len(counts)), counts)
        turn, index = np.zeros(len(source), np.int64), np.zeros(len(source), np.int64)
        for k in np.flatnonzero(counts):
            j = before[k] + np.arange(counts[k])
            turn[source == k] = j // blocks[k]
            out = np.empty(len(j), np.int64)
            for t in np.unique(j // blocks[k]):
                at = j // blocks[k] == t
                out[at] = permuted(j[at] % blocks[k], blocks[k], int(k) * CEILING + int(t) + seed)
            index[source == k] = out
        place = np.random.default_rng([seed, number]).permutation(len(source))
        columns = [np.full(len(source), number), place, turn, index]
        a, b, c, d = (pa.array(x.astype(np.int64)) for x in columns)
        return pa.RecordBatch.from_arrays(
            [a, b, names.take(pa.array(source)), c, d], names=["shard", "slot", "key", "pass", "index"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield rows(number)

    schema = "shard bigint, slot bigint, key string, pass bigint, index bigint"
    return spark.range(shards).mapInArrow(run, schema)


@dataclass(frozen=True)
class Mix:
    """``rows``: the documents with key and at; ``parts``: (shard, slot, key, pass, index, at,
    start, words), the words ``start`` up to ``start + words`` of the document (key, at)."""

    sources: list[Source]
    rows: DataFrame
    parts: DataFrame


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """Mix ``docs`` (doc_id, source, size, ...) to the target weights."""
    spark = docs.sparkSession
    made, documents = sources(docs, block)
    rows = stored(numbered(docs, documents), "numbered")
    # The planner takes the plan of slots for as small as the range it is made from.
    plan = slots(spark, made, shard, seed).hint("merge")
    parts = plan.join(pieces(rows, block).hint("merge"), ["key", "index"])
    return Mix(made, rows, parts)


def taken(mixed: Mix) -> DataFrame:
    """Every document with its source's size and target and the words that the mix takes."""
    spark = mixed.rows.sparkSession
    sums = mixed.parts.groupBy("key", "at").agg(F.sum("words").alias("taken")).hint("merge")
    # A document without words shares its place with the next one.
    rows = mixed.rows.withColumn("place", F.when(F.col("size") > 0, F.col("at")))
    rows = rows.join(sums.withColumnRenamed("at", "place"), ["key", "place"], "left")
    return rows.join(source_table(spark, mixed.sources), "key").withColumn(
        "taken", F.coalesce("taken", F.lit(0)).cast("bigint")
    )


def cut_words(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Words ``start`` up to ``start + n`` of a text as written, for ascending spans: what lies between words that
    follow each other stays, where words are missing a line ends."""
    starts = [m.start() for m in WORDS.finditer(body)]
    starts.append(len(body))
    out, last = [], None
    for start, n in spans:
        if last is not None and start != last:
            out.append(b"\n")
        part = body[starts[start] : starts[min(start + n, len(starts) - 1)]]
        last = start + n
        out.append(part)
    return b"".join(out).rstrip(BLANKS)


def mixed_texts(mixed: Mix, text: str = "text") -> DataFrame:
    """The documents as mixed: for each pass over its source a row with the words taken then, as they are
    written; with the columns of ``mixed.rows``."""
    drawn = mixed.parts.groupBy("key", "at", "pass").agg(
        F.array_sort(F.collect_list(F.struct("start", "words"))).alias("drawn")
    )
    rows = mixed.rows.where("size > 0").join(drawn.hint("merge"), ["key", "at"])
    # Starts and numbers of words travel as two lists beside the text.
    rows = rows.withColumn("starts", F.col("drawn.start")).withColumn("counts", F.col("drawn.words"))
    columns = mixed.rows.columns
    place = columns.index(text)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(columns)
        spans = zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())
        made = [cut_words(body, list(zip(*pair))) for body, pair in zip(texts_of(batch.column(place)), spans)]
        kept = batch.columns[:n]
        kept[place] = pa.array(made, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(kept, names=columns)

    return per_batch(rows.select(*columns, "starts", "counts"), cut, mixed.rows.schema)
