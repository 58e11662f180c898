"""Bigram language model with Katz backoff, over tables dealt out by n-gram.

Documents are gathered into blocks of about ``BLOCK`` tokens. A block sends each of its different
words and bigrams once, with its count in the training part, to the partition of the n-gram
(the leading bits of its 64-bit hash); the partition adds the counts up and sends the totals back to the
blocks that asked. So no task holds more than its block or its partition of a
table, a frequent n-gram is one number per block, and the tables grow with the corpus. Each bigram type has
one owner among its blocks, which adds the type to the sums of its history; the sums
meet by history in the same way and give the backoff weights. A history that no other block has
needs no such meeting: its block has all its bigrams and knows the weight.

    P(w | h) = d(c) c(h, w) / c(h)     if the bigram was seen c > 0 times in training
             = alpha(h) P(w)           otherwise
    P(w)     = (c(w) + 1) / (N + V + 1)

d is Katz's Good-Turing discount for c <= K (where the counts of counts don't allow one, and above
K, half a count is taken away, so that every history keeps some mass); alpha(h) makes each
history's probabilities sum to one, the unknown word included. A history that was not seen has
P(w | h) = P(w).

Defined cases: a null text is empty; an empty text is one end token; null ids are held out;
repeated rows count as often as they come; without any training document every word is unknown
(probability 1); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.arrow import texts_of
from lexdrift.plans.workspace import stored

#: Tokens of a block, and bytes of its texts.
BLOCK, BLOCK_BYTES = 600_000, 16 << 20
K = 5
#: Partitions of a table: at least so many, and about so many n-grams in each.
LEAST_PARTS, PART = 64, 2_000_000
END, START = np.uint64(0x1F3D5B79A2C4E688), np.uint64(0xE5D4C3B2A1908F7E)
WORDS, BIGRAMS = 0, 1
BODIES = "block bigint, ids binary, held binary, sizes binary, body binary"
ASKED = "kind int, part int, block bigint, keys binary, counts binary"
TOLD = "kind int, part int, block bigint, totals binary, flags binary, stats array<bigint>"
SCORED = "part int, block bigint, ids binary, numbers binary, asked binary, places binary, keys binary, sums binary"


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def _bodies(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=6).compress
    ids, held, texts, size, held_bytes = [], [], [], 0, 0

    def row(number: int) -> pa.RecordBatch:
        empty = np.array([i is None for i in ids])
        flags = np.array(held, np.uint8) + 2 * empty.astype(np.uint8)
        columns = [
            np.array([0 if i is None else i for i in ids], np.int64).tobytes(),
            flags.tobytes(),
            np.array([len(t) for t in texts], np.int64).tobytes(),
            pack(b"".join(texts)),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *(pa.array([c], pa.binary()) for c in columns)], names=["block", "ids", "held", "sizes", "body"]
        )

    for batch in batches:
        flags = batch.column(2).to_pylist()
        for doc, text, flag in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), flags):
            ids.append(doc)
            held.append(flag)
            texts.append(text.lower())
            size += len(text.split()) + 1
            held_bytes += len(text)
            if size >= BLOCK or held_bytes >= BLOCK_BYTES:
                yield row(number)
                number, ids, held, texts, size, held_bytes = number + 1, [], [], [], 0, 0
    if ids:
        yield row(number)


def blocks(docs: DataFrame) -> DataFrame:
    """Documents gathered as they lie in each input split, one row per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _bodies(batches, TaskContext.get().partitionId() << 32)

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")).mapInArrow(run, BODIES)


@dataclass
class _Tokens:
    """A block's tokens: places of words and bigrams among the block's different ones."""

    ids: np.ndarray
    flags: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    word: np.ndarray
    bigrams: np.ndarray
    bigram: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Tokens:
        sizes = np.frombuffer(row["sizes"], np.int64)
        body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=int(sizes.sum()) + 1)
        digest, hashes, counts, low = xxhash.xxh64_intdigest, [], [], 0
        for size in sizes.tolist():
            own = [digest(w) for w in body[low : low + size].split()]
            low += size
            hashes.append(np.array([*own, int(END)], np.uint64))
            counts.append(len(own) + 1)
        token = np.concatenate(hashes)
        before = np.concatenate([[START], token[:-1]])
        before[np.concatenate([[0], np.cumsum(counts)[:-1]])] = START
        pair = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (before >> np.uint64(29))
        pair = (pair + token) * np.uint64(0xC2B2AE3D27D4EB4F)
        pair ^= pair >> np.uint64(32)
        pair *= np.uint64(0xBF58476D1CE4E5B9)
        words, word = np.unique(token, return_inverse=True)
        bigrams, bigram = np.unique(pair, return_inverse=True)
        doc = np.repeat(np.arange(len(sizes)), counts)
        ids, flags = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["held"], np.uint8)
        return cls(ids, flags, doc, words, word, bigrams, bigram)

    @property
    def trained(self) -> np.ndarray:
        return (self.flags[self.doc] & 1) == 0


def _planes(values: np.ndarray) -> bytes:
    """Bytes of like weight together: they compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    n = len(planes) // width
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _bounds(keys: np.ndarray, bits: int) -> list[int]:
    """Where the parts of sorted keys begin and end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return [*np.searchsorted(keys, edges).tolist(), len(keys)]


def _asked(tables: DataFrame, bits: int) -> DataFrame:
    """Every block's different n-grams with their counts in training, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _Tokens.of(row)
                trained, out = tokens.trained, []
                for kind, keys, place in ((WORDS, tokens.words, tokens.word), (BIGRAMS, tokens.bigrams, tokens.bigram)):
                    counts = np.bincount(place[trained], minlength=len(keys)).astype(np.uint32)
                    ends = _bounds(keys, bits)
                    out += [
                        (kind, part, row["block"], _planes(keys[a:b]), _planes(counts[a:b]))
                        for part, (a, b) in enumerate(zip(ends, ends[1:]))
                        if b > a
                    ]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "part", "block", "keys", "counts"])

    return tables.mapInArrow(run, ASKED)


def _told(asked: DataFrame) -> DataFrame:
    """Totals of each part, for each block that asked, with a flag for each: of a word, that no other block has
    it; of a bigram, that the block owns it. One row has the part's counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [_values(r["keys"], np.uint64) for r in rows]
        counts = np.concatenate([_values(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(known), np.int64)
        np.add.at(totals, place, counts)
        if rows[0]["kind"] == WORDS:
            flagged = (np.bincount(place) == 1)[place]
        else:
            # A type's owner is the first block with a training count.
            seen = np.flatnonzero(counts > 0)
            flagged = np.zeros(len(counts), bool)
            flagged[seen[np.unique(place[seen], return_index=True)[1]]] = True
        few = np.bincount(np.minimum(totals, K + 2), minlength=K + 3)
        stats = [int((totals > 0).sum()), int(totals.sum()), *few[1 : K + 2].tolist()]
        out, low = [], 0
        for n, row in enumerate(rows):
            high = low + len(keys[n])
            told = totals[place[low:high]].astype(np.uint64)
            flags = np.packbits(flagged[low:high])
            out.append((row["kind"], row["part"], row["block"], _planes(told), flags.tobytes(), None if n else stats))
            low = high
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["kind", "part", "block", "totals", "flags", "stats"]
    return asked.groupBy("kind", "part").applyInArrow(run, TOLD)


def discounts(counts: list[int]) -> np.ndarray:
    """Factors for counts 0..K from the numbers of types seen 1..K+1 times."""
    n = [0, *counts]
    out = np.array([1.0] + [1 - 0.5 / r for r in range(1, K + 1)])
    if n[1] and (K + 1) * n[K + 1] < n[1]:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r]:
                factor = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                if 0 < factor < 1:
                    out[r] = factor
    return out


@dataclass(frozen=True)
class Model:
    """What is known of all training tokens: their number, the different words, the documents, the discounts."""

    tokens: int
    vocabulary: int
    documents: int
    factors: np.ndarray

    def single(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.tokens + self.vocabulary + 1)

    def lowered(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(count <= K, self.factors[np.minimum(count, K)] * count, count - 0.5)


def _answers(rows: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])
    totals = [_values(r["totals"], np.uint64).astype(np.int64) for r in own]
    flags = [np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=len(t)).astype(bool) for r, t in zip(own, totals)]
    return np.concatenate(totals), np.concatenate(flags)


def _weight(mass: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 of backoff weights from the sums of P(w | h) and P(w) over the words seen after each history.
    Rounding may not make a mass that is left vanish."""
    return np.log10(np.maximum(1 - mass, 1e-12)) - np.log10(np.maximum(1 - lower, 1e-12))


def _block_scores(row: dict, told: list[dict], model: Model, bits: int) -> list[tuple]:
    """A block's sums per document but for the backoff weights; what it asks and adds by history."""
    tokens = _Tokens.of(row)
    word_total, only = _answers(told, WORDS)
    bigram_total, owned = _answers(told, BIGRAMS)
    n = len(tokens.ids)
    first = np.concatenate([[True], np.diff(tokens.doc) > 0])
    before = np.concatenate([[0], tokens.word[:-1]])
    history_key = np.where(first, START, tokens.words[before])
    history_total = np.where(first, model.documents, word_total[before])
    history_only = ~first & only[before]
    total, joint = word_total[tokens.word], bigram_total[tokens.bigram]
    single = np.log10(model.single(total))
    seen = joint > 0
    value = np.where(
        seen, np.log10(np.maximum(model.lowered(joint), 1e-300)) - np.log10(np.maximum(history_total, 1)), single
    )
    backed = ~seen & (history_total > 0)
    # One token of each bigram type that this block owns, and what it adds to its history's sums.
    one = np.full(len(tokens.bigrams), -1)
    one[tokens.bigram[::-1]] = np.arange(len(tokens.bigram))[::-1]
    one = one[owned]
    lower, mass = model.single(total[one]), model.lowered(joint[one]) / history_total[one]
    own = history_only[one]
    lowers, masses = (np.bincount(before[one[own]], part[own], minlength=len(tokens.words)) for part in (lower, mass))
    known = backed & history_only
    value = value + np.where(known, _weight(masses, lowers)[before], 0.0)
    backed &= ~history_only
    numbers = np.stack(
        [
            np.bincount(tokens.doc, minlength=n).astype(np.float64),
            np.bincount(tokens.doc[total > 0], minlength=n).astype(np.float64),
            np.bincount(tokens.doc, single, minlength=n),
            np.bincount(tokens.doc, value, minlength=n),
            tokens.flags.astype(np.float64),
        ]
    )
    wanted, place = np.unique(history_key[backed], return_inverse=True)
    given, spot = np.unique(history_key[one[~own]], return_inverse=True)
    sums = np.stack([np.bincount(spot, part[~own], minlength=len(given)) for part in (lower, mass)])
    places = np.stack([tokens.doc[backed], place]).astype(np.uint32)
    out = [(-1, row["block"], tokens.ids.tobytes(), numbers.tobytes(), None, places.tobytes(), None, None)]
    ask, give = _bounds(wanted, bits), _bounds(given, bits)
    for part in range(1 << bits):
        a, b, c, d = ask[part], ask[part + 1], give[part], give[part + 1]
        if b > a or d > c:
            pair = np.ascontiguousarray(sums[:, c:d])
            out.append((part, row["block"], None, None, _planes(wanted[a:b]), None, _planes(given[c:d]), pair.tobytes()))
    return out


def _scored(bodies: DataFrame, told: DataFrame, model: Model, bits: int) -> DataFrame:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        out = _block_scores(row, right.to_pylist(), model, bits)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return bodies.groupBy("block").cogroup(told.drop("stats").groupBy("block")).applyInArrow(run, SCORED)


def _weights(scored: DataFrame) -> DataFrame:
    """(block, part, weights): log10 of the backoff weights that a block asked for, in its order."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])  # sums in one order, whichever row came first
        keys = np.concatenate([_values(r["keys"], np.uint64) for r in rows])
        sums = np.concatenate([np.frombuffer(r["sums"]).reshape(2, -1) for r in rows], axis=1)
        known, place = np.unique(keys, return_inverse=True)
        lower, mass = (np.bincount(place, s, minlength=len(known)) for s in sums)
        weight = _weight(mass, lower)
        out = []
        for r in rows:
            asked = _values(r["asked"], np.uint64)
            if len(asked):
                out.append((r["block"], r["part"], weight[np.searchsorted(known, asked)].tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[], [], []], kinds)]
        return pa.table(columns, names=["block", "part", "weights"])

    parts = scored.where("part >= 0").select("part", "block", "asked", "keys", "sums")
    return parts.groupBy("part").applyInArrow(run, "block bigint, part int, weights binary")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document,
    learned from those that are not held out."""
    size = docs.agg(
        F.sum(F.length("text")).alias("n"), F.count(F.when(~held_out(F.col("doc_id")), 1)).alias("documents")
    ).first()
    parts = max(LEAST_PARTS, (size["n"] or 0) // 6 // PART + 1)
    bits = (parts - 1).bit_length()
    bodies = stored(blocks(docs), "bodies")
    told = stored(_told(_asked(bodies, bits)), "totals")
    stats = told.where("stats IS NOT NULL").groupBy("kind").agg(
        *[F.sum(F.col("stats")[n]).alias(f"s{n}") for n in range(K + 3)]
    )
    found = {r["kind"]: [r[f"s{n}"] for n in range(K + 3)] for r in stats.collect()}
    types, tokens, *_ = found.get(WORDS, [0] * (K + 3))
    model = Model(tokens, types, size["documents"], discounts(found.get(BIGRAMS, [0] * (K + 3))[2:]))
    scored = stored(_scored(bodies, told, model, bits), "scores")
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        ids = np.frombuffer(row["ids"], np.int64)
        count, known, base, value, flags = np.frombuffer(row["numbers"]).reshape(5, len(ids))
        doc, place = np.frombuffer(row["places"], np.uint32).reshape(2, -1)
        told = sorted(right.to_pylist(), key=lambda r: r["part"])
        weights = np.concatenate([np.zeros(0), *(np.frombuffer(r["weights"]) for r in told)])
        value = value + np.bincount(doc, weights[place], minlength=len(ids))
        flags = flags.astype(np.int64)
        columns = [
            pa.array(ids, mask=flags >= 2),
            pa.array(flags & 1 == 1),
            pa.array(count.astype(np.int64)),
            pa.array(known.astype(np.int64)),
            pa.array(np.full(len(ids), model.tokens)),
            pa.array(base),
            pa.array(value),
        ]
        return pa.table(columns, names=names).cast(pa.schema(list(zip(names, kinds))))

    owners = scored.where("part = -1").select("block", "ids", "numbers", "places")
    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    return owners.groupBy("block").cogroup(_weights(scored).groupBy("block")).applyInArrow(finish, schema)
