"""Removal of passages that repeat: every window of ``WIDTH`` words whose words also start
earlier in the corpus.

A window is recognized by content. Of the ``GRAM``-word sequences in a window the one with the
smallest hash is its anchor, so equal windows have equal anchors; consecutive windows with the
same anchor form a context, about one for every eight words. Contexts meet by anchor and hash of
their words: each but the first of its kind is removed as a whole. Where an anchor has contexts of
different words (at the edges of a repeated passage), the windows of the first ones meet once
more, one by one, by the hash of their words. Each meeting is one shuffle of narrow rows, sorted and
streamed: a task keeps one row, however often a passage comes. Copies within a chunk of
documents are settled before the shuffle, so a frequent passage sends a row per chunk.

Words are hashed to 64 bits; contexts and windows are told apart by 128.

Why no suffix automata broadcast by shard: see the README.

Defined cases: a null text has no words; texts shorter than a window lose nothing; documents are
ordered by id, null last, and under one id by a hash of the text; rows that repeat id and text are
one document, and lose the same; rows without ids are a document each, so of equal texts among
them one stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.arrow import texts_of
from lexdrift.plans.workspace import stored

WIDTH = 20
GRAM = 6
#: Words that a task handles at once (or one document, if longer).
CHUNK = 400_000
LAST = (1 << 63) - 1
#: A place in a document: start * STEP + 2 * number of windows + flag.
STEP = 256
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.ones(n, np.uint64)
    powers[1:] = base
    return np.multiply.accumulate(powers)


class Hashes:
    """Hashes of any run of words, from sums of powers (modulo 2^64)."""

    def __init__(self, words: np.ndarray, which: int):
        base, n = _BASES[which], len(words) + 1
        own = _mixed(words + np.uint64(which))
        self.back = _powers(pow(base, -1, 1 << 64), n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(own * _powers(base, n)[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def word_hashes(text: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.split()], np.uint64)


def _windows(ends: np.ndarray, n: int) -> np.ndarray:
    """Starts of all windows; no window crosses the end of a document."""
    starts = np.arange(n)
    return starts[starts + WIDTH <= np.repeat(ends, np.diff(np.concatenate([[0], ends])))]


def contexts(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, content, start, windows) of the contexts of documents that end at ``ends``."""
    at = _windows(ends, len(words))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    first = Hashes(words, 0)
    grams = np.arange(len(words) - GRAM + 1)
    gram = first.of(grams, grams + GRAM)
    least, place = gram[at], at.copy()
    for k in range(1, WIDTH - GRAM + 1):
        here = gram[at + k]
        less = here < least
        least = np.where(less, here, least)
        place = np.where(less, at + k, place)
    new = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(at) != 1)])
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(at)))
    start = at[begin]
    return least[begin], Hashes(words, 1).of(start, start + windows - 1 + WIDTH), start, windows


def _settled(a: np.ndarray, b: np.ndarray, doc: np.ndarray, sub: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Rows of which an equal one (a, b) comes strictly earlier among the given."""
    order = np.lexsort((code, sub, doc, b, a))
    a, b, doc, sub, code = a[order], b[order], doc[order], sub[order], code[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    late = (doc != doc[first]) | (sub != sub[first]) | (code // STEP != code[first] // STEP)
    out = np.zeros(len(a), bool)
    out[order] = late
    return out


NAMES = ["a", "b", "doc", "sub", "code"]
ROWS = "a bigint, b bigint, doc bigint, sub bigint, code bigint"
#: A document: its id, and the hash of its text.
KEY = ["doc", "sub"]


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=names)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], list]]:
    """Documents of about CHUNK words: keys, word hashes, and the fourth column if there is one."""
    ids, words, more, held = [], [], [], 0
    for batch in batches:
        extra = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for key, text, last in zip(keys, texts_of(batch.column(2)), extra):
            if batch.num_columns > 3 and not last:
                continue
            ids.append(key)
            words.append(word_hashes(text))
            more.append(last)
            held += len(words[-1])
            if held >= CHUNK:
                yield ids, words, more
                ids, words, more, held = [], [], [], 0
    if ids:
        yield ids, words, more


def _emit(a: np.ndarray, b: np.ndarray, doc: np.ndarray, sub: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    """Rows to meet by (a, b); settled ones carry the flag and any key."""
    late = _settled(a, b, doc, sub, code)
    key = np.where(late, _mixed(doc.view(np.uint64) * np.uint64(STEP) + code.view(np.uint64)), a)
    return _batch(NAMES, [key, b, doc, sub, code + late])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, words, _ in _chunks(batches):
        ends = np.cumsum([len(w) for w in words])
        anchor, content, start, windows = contexts(np.concatenate(words), ends)
        doc = np.searchsorted(ends, start, side="right")
        begins = np.concatenate([[0], ends])[doc]
        code = (start - begins) * STEP + 2 * windows
        own, sub = np.array(ids, np.int64)[doc].T
        yield _emit(anchor, content, np.ascontiguousarray(own), np.ascontiguousarray(sub), code)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, words, codes in _chunks(batches):
        first, second, docs, subs, places = [], [], [], [], []
        for (doc, sub), own, marked in zip(ids, words, codes):
            marked = np.array(marked, np.int64)
            count = (marked % STEP) // 2
            start = np.repeat(marked // STEP, count) + _within(count)
            first.append(Hashes(own, 0).of(start, start + WIDTH))
            second.append(Hashes(own, 1).of(start, start + WIDTH))
            docs.append(np.full(len(start), doc, np.int64))
            subs.append(np.full(len(start), sub, np.int64))
            places.append(start * STEP + 2)
        yield _emit(*(np.concatenate(c) for c in (first, second, docs, subs, places)))


def _within(count: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``count``."""
    ends = np.cumsum(count)
    return np.arange(int(count.sum())) - np.repeat(ends - count, count)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (a, b, doc, sub, code): (doc, sub, code) to remove, and with the flag, the first
    of each (a, b) whose a has several b. What is kept between batches is one row."""
    last = None  # a, b, doc, sub and code of the first row of the current (a, b); whether a has several b
    for batch in batches:
        a, b, doc, sub, code = (c.to_numpy() for c in batch.columns)
        done = (code & 1) == 1
        out = [(doc[done], sub[done], code[done] - 1)]
        a, b, doc, sub, code = (c[~done] for c in (a, b, doc, sub, code))
        if len(a):
            if last is not None:
                a, b, doc, sub, code = (np.concatenate([[x], y]) for x, y in zip(last[:5], (a, b, doc, sub, code)))
            new_a = np.concatenate([[True], a[1:] != a[:-1]])
            new = new_a | np.concatenate([[True], b[1:] != b[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            late = (doc != doc[first]) | (sub != sub[first]) | (code // STEP != code[first] // STEP)
            out.append((doc[late], sub[late], code[late]))
            run = np.cumsum(new_a) - 1
            several = np.bincount(run, new) > 1
            reported = last is not None and last[5]
            several[0] |= reported
            heads = new & several[run]
            heads[0] &= not reported
            # The last (a, b) goes on: it is reported once its a is known to have several b.
            out.append((doc[heads], sub[heads], code[heads] + 1))
            end = first[-1]
            last = (a[end], b[end], doc[end], sub[end], code[end], bool(several[-1]))
        docs, subs, codes = (np.concatenate(c) for c in zip(*out))
        if len(docs):
            yield _batch([*KEY, "code"], [docs, subs, codes])


def _meeting(rows: DataFrame, task: Callable) -> DataFrame:
    sent = rows.mapInArrow(task, ROWS).repartition("a")
    return sent.sortWithinPartitions(*NAMES).mapInArrow(_met, "doc bigint, sub bigint, code bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    sub = F.xxhash64("text", F.col("doc_id").isNull())
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), sub.alias("sub"), "text")


def removed(docs: DataFrame) -> DataFrame:
    """(doc, sub, codes): for each document that loses something its removed windows."""
    rows = _keyed(docs).select(*KEY, "text")
    met = stored(_meeting(rows, _context_rows), "contexts")
    flag = F.col("code").bitwiseAND(1)
    open_ = met.where(flag == 1).groupBy(*KEY).agg(F.collect_set(F.col("code") - 1).alias("codes"))
    windows = _meeting(rows.join(open_, KEY).select(*KEY, "text", "codes"), _window_rows)
    sure = met.where(flag == 0).unionByName(windows.where(flag == 0))
    return sure.groupBy(*KEY).agg(F.collect_set("code").alias("codes"))


def kept_words(text: bytes, codes: list[int] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if not codes or not words:
        return words, len(words)
    codes = np.array(codes, np.int64)
    start = np.minimum(codes // STEP, len(words))
    end = np.minimum(start + (codes % STEP) // 2 - 1 + WIDTH, len(words))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, end, -1)
    stays = np.cumsum(cover[:-1]) == 0
    return [w for w, s in zip(words, stays.tolist()) if s], len(words)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document with the text of its kept words."""
    rows = _keyed(docs)
    # Equal texts without ids: one row stands for all, the others lose every window.
    nameless = rows.where("doc_id IS NULL").groupBy("doc_id", *KEY).agg(F.min("text").alias("text"), F.count("*").alias("n"))
    rows = rows.where("doc_id IS NOT NULL").withColumn("n", F.lit(1).cast("bigint")).unionByName(nameless)
    rows = rows.join(removed(docs), KEY, "left").select("doc_id", "text", "codes", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kept_words(t, c) for t, c in zip(texts_of(batch.column(1)), batch.column(2).to_pylist())]
            columns = [
                batch.column(0),
                batch.column(3),
                pa.array([n for _, n in found], pa.int64()),
                pa.array([n - len(w) for w, n in found], pa.int64()),
                pa.array([b" ".join(w) for w, _ in found], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "n_words", "n_removed", "kept"])

    found = rows.mapInArrow(run, "doc_id bigint, n bigint, n_words bigint, n_removed bigint, kept string")
    # The first of n rows is the one found; a text shorter than a window loses nothing.
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy")
    gone = (F.col("copy") > 1) & (F.col("n_words") >= WIDTH)
    return found.select("*", copy).select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, "").otherwise(F.col("kept")).alias("kept"),
    )
