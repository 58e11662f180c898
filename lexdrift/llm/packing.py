"""Packing documents into fixed-length windows, in their order.

Documents follow each other as they lie in each input split, and windows are cut from that
stream. Cuts are allowed at ends of documents (free), at ends of sentences and at a grid
inside long sentences (each for a penalty); the cheapest set of cuts is found by dynamic
programming, cost = padding + penalties. The best start of a window that ends at a given
place is the minimum over a sliding window of places, kept in a monotone queue; windows
whose length is a power of two need no padding and are tried beside it.

A task holds the tokens of about ``BLOCK`` tokens or one document at a time: it packs these, emits all
windows but the last, and goes on with that one. There is no shuffle. A lost task is repeated
over the same split; give it a table or a sorted frame as input.

Defined cases: a null text is empty; an empty text is the end token alone; null ids, repeated
rows and texts without any sentence end are packed like others; an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lexdrift.llm.arrow import byte_slices, give_back
from lexdrift.llm.pieces import Encode, PieceIds, joined, whole_tokenizer

WIDTH = 4096
END = 2
#: In tokens of padding: a cut at a sentence's end, a cut inside one, a window as such.
SENTENCE, INSIDE, WINDOW = 16, 48, 64
GRID = 64
BLOCK = 1 << 20
TEXT_BYTES = 4 << 20
SENTENCE_ENDS = b".!?"
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def cuts(places: np.ndarray, penalties: np.ndarray, width: int = WIDTH) -> list[int]:
    """The cheapest places to end windows, the last place included. ``places`` ascend from
    above 0 by steps of ``width`` at most; a penalty is paid by each cut."""
    at = np.concatenate([[0], places])
    shortcuts: list[list[int]] = [[] for _ in at]
    power = max(1, width // 64)
    while power < width:
        found = np.searchsorted(at, at - power)
        for j in np.flatnonzero((at >= power) & (at[found] == at - power)).tolist():
            shortcuts[j].append(int(found[j]))
        power *= 2
    at, penalty = at.tolist(), [0, *penalties.tolist()]
    cost, origin, queue = [0], [0], deque()  # queue: places by rising cost + place
    for j in range(1, len(at)):
        key = cost[j - 1] + at[j - 1]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j - 1))
        here = at[j]
        while at[queue[0][1]] < here - width:
            queue.popleft()
        best, start = queue[0]
        best += width - here
        for k in shortcuts[j]:
            if cost[k] < best:
                best, start = cost[k], k
        cost.append(best + penalty[j] + WINDOW)
        origin.append(start)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = origin[j]
    return out[::-1]


class Encoder:
    """Token ids of whole texts and the places where they may be cut, word by word: the pre-tokenizer
    drops white space, so no token crosses it. Each distinct word of a call is tokenized once."""

    def __init__(self, path: str):
        encode = Encode(whole_tokenizer(path))
        words = sum(encode.whole(["Ab", "c,", "D.e"]), [])
        parted = encode.whole(["Ab c,\n D.e", "  Ab \tc,   D.e\n"])
        if parted != [words, words]:
            raise ValueError(f"{path}: texts can only be packed word by word if white space is dropped")
        self.words = PieceIds.of_process(path, lambda: PieceIds(encode))

    def __call__(self, texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Of each text its ids, and the places and penalties of all cuts."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        held = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        words, rows = words.filter(pa.array(held)).cast(pa.large_binary()), rows[held]
        ids, upto = joined(*self.words(words))
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        upto = np.concatenate([[0], upto])
        ends = _ends_sentence(words)
        for low, high in zip(bounds, bounds[1:]):
            after = upto[low + 1 : high + 1] - upto[low]
            yield _with_cuts(ids[upto[low] : upto[high]], after, ends[low:high])


def _ends_sentence(words: pa.Array) -> np.ndarray:
    """Whether each (not empty) word ends with a mark that ends a sentence."""
    last = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + len(words) + 1] - 1
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return np.isin(data[last], np.frombuffer(SENTENCE_ENDS, np.uint8)) if len(last) else np.empty(0, bool)


def _with_cuts(found: np.ndarray, upto: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Ids of one text with the end id, and its cuts; ``upto``: ids to the end of each word."""
    total = len(found)
    sentence = upto[ends & (upto > 0) & (upto < total)]
    sentence = sentence[np.concatenate([[True], np.diff(sentence) > 0])] if len(sentence) else sentence
    bounds = np.concatenate([[0], sentence, [total]])
    places, penalties = [np.append(sentence, total + 1)], [np.append(np.full(len(sentence), SENTENCE), 0)]
    for k in np.flatnonzero(np.diff(bounds) > GRID):
        inside = np.arange(bounds[k] + GRID, bounds[k + 1], GRID)
        places.append(inside)
        penalties.append(np.full(len(inside), INSIDE))
    places, penalties = np.concatenate(places), np.concatenate(penalties)
    if len(places) > len(sentence) + 1:
        order = np.argsort(places, kind="stable")
        places, penalties = places[order], penalties[order]
    return np.append(found, END).astype("<u4").tobytes(), places, penalties


@dataclass
class _Part:
    """A document, or what is left of one: its ids from token ``start`` on."""

    doc_id: int | None
    start: int
    ids: bytes
    places: np.ndarray
    penalties: np.ndarray
    tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def tail(self, n: int) -> _Part:
        later = self.places > n
        return _Part(
            self.doc_id, self.start + n, self.ids[4 * n :], self.places[later] - n, self.penalties[later], self.tokens
        )


def _packed(parts: list[_Part], width: int, everything: bool) -> tuple[list[list[tuple]], list[_Part]]:
    """Windows as lists of pieces, and the parts of the last one if not ``everything``."""
    base = np.cumsum([0, *(p.length for p in parts)])
    places = np.concatenate([p.places + b for p, b in zip(parts, base)])
    ends = cuts(places, np.concatenate([p.penalties for p in parts]), width)
    if not everything:
        ends.pop()
    windows, k, done, low = [], 0, 0, 0
    for high in ends:
        pieces = []
        while low < high:
            part = parts[k]
            n = min(high - low, part.length - done)
            pieces.append((part, done, n))
            low, done = low + n, done + n
            if done == part.length:
                k, done = k + 1, 0
        windows.append(pieces)
    rest = [parts[k].tail(done), *parts[k + 1 :]] if k < len(parts) else []
    return windows, rest


def _batch(windows: list[list[tuple]], first: int) -> pa.RecordBatch:
    rows = []
    for number, pieces in enumerate(windows, first):
        offset = 0
        for part, done, n in pieces:
            rows.append((part.doc_id, part.start + done, n, part.ids[4 * done : 4 * (done + n)], part.tokens, number, offset))
            offset += n
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH) -> DataFrame:
    """One row per piece of a document in a sequence. ``tokenizer`` is the path of a
    tokenizer file that every machine has; ``ids`` are little-endian unsigned 32-bit ids."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        parts: list[_Part] = []
        held = 0
        for batch in batches:
            for some in byte_slices(batch, 1, TEXT_BYTES):
                for doc_id, (ids, places, penalties) in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    parts.append(_Part(doc_id, 0, ids, places, penalties, len(ids) // 4))
                    held += len(ids) // 4
                    if held >= BLOCK:
                        windows, parts = _packed(parts, width, False)
                        held = sum(p.length for p in parts)
                        if windows:
                            yield _batch(windows, number)
                            number += len(windows)
        if parts:
            yield _batch(_packed(parts, width, True)[0], number)
        parts.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA)
