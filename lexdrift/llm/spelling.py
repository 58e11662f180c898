"""Grouping of spelling variants: words of a corpus, their near words and forms.

Words are counted, and the frequent ones make the vocabulary. Two words are near if one inserted,
deleted or replaced code point makes one of the other. Every word generates its deletions and its
replacements by later letters; an insertion is the other word's deletion and a replacement by an earlier
letter is the other word's replacement, so each near pair is generated once. Generated edits are known by
a hash that follows from the word's own in a few operations and are probed against blocked Bloom filters,
one for each word length, that every machine holds. Only positives become strings and are shuffled, to a
join with the vocabulary that removes the false ones.

The filters have ``BITS`` bits a word and ``FILTER_BYTES`` bytes in all at most: beyond that they let more
edits through, and the join grows, but no pair is lost. A word's form is its most frequent near word, if that is
``RATIO`` times as frequent; roots are found by joining the table of forms with itself until none moves,
each round doubling the steps.

Defined cases: null and empty texts have no words; a null id is empty text where an occurrence is chosen to
lose a letter; repeated ids and rows count like others; ties of forms go to the smaller word by code
points; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.arrow import byte_slices
from lexdrift.plans.workspace import stored

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One occurrence in so many, chosen by checksum, loses a code point. 0: none does.
DAMAGE = 199
BITS = 16
FILTER_BYTES = 64 << 20
PROBES = 6
#: Edits that are probed at a time.
EDITS = 1 << 19
TEXT_BYTES = 32 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Of CRC-32, lowest bit first.
POLYNOMIAL = np.uint32(0xEDB88320)
#: Words of up to so many bytes are checked by table.
SHORT = 64


def _zero_byte_tables(longest: int) -> np.ndarray:
    """``tables[n][k][b]``: what byte ``k`` of a CRC-32 turns to when ``n`` zero bytes follow. CRCs are
    linear, so that of two joined texts is the first one's after as many zeros, xor the second one's."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ (POLYNOMIAL * (step & np.uint32(1)))
    tables = np.empty((longest + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        tables[n + 1] = (tables[n] >> np.uint32(8)) ^ step[tables[n] & np.uint32(255)]
    return tables


def letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z lower-cased, and the row of each.
    In UTF-8 the latter are the characters that start with C3."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    folded = data | np.uint8(32)
    letter = (folded >= 97) & (folded <= 122) & (data < 128)
    lower = np.where(letter, folded, data)
    first = data == 0xC3
    letter |= first
    letter[1:] |= first[:-1]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    edges = np.unique(bounds)
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(letter & ~before)
    ends = np.flatnonzero(letter & ~after) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    held = pa.py_buffer(lower[letter].tobytes())
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), held])
    return words, np.searchsorted(bounds, starts, "right") - 1


def word_counts(docs: DataFrame, damage: int = DAMAGE, least_length: int = LEAST_LENGTH) -> DataFrame:
    """The distinct words of whole texts and how often they occur: (word, n)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _zero_byte_tables(SHORT)
        for batch in batches:
            for some in byte_slices(batch, 1, TEXT_BYTES):
                runs, rows = letter_runs(some.column(1))
                if not len(runs):
                    continue
                runs = runs.dictionary_encode()
                codes, raw = runs.indices.to_numpy(), runs.dictionary.to_pylist()
                cut: Counter[str] = Counter()
                if damage:
                    ids = some.column(0).to_pylist()
                    prefixes = ["" if i is None else str(i) for i in ids]
                    heads = np.array([zlib.crc32(f"{p}:".encode()) for p in prefixes], np.uint32)
                    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                    own = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
                    head, size = heads[rows], np.minimum(sizes, SHORT)[codes]
                    sums = own[codes]
                    for k in range(4):
                        sums ^= tables[size, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
                    for at in np.flatnonzero(sizes[codes] > SHORT).tolist():
                        sums[at] = zlib.crc32(raw[codes[at]], int(head[at]))
                    hit = np.flatnonzero(sums % damage == 0)
                    for code, total in zip(codes[hit].tolist(), sums[hit].tolist()):
                        word = raw[code].decode()
                        at = total % len(word)
                        cut[word[:at] + word[at + 1 :]] += 1
                    codes = np.delete(codes, hit)
                counts = np.bincount(codes, minlength=len(raw))
                words = runs.dictionary.cast(pa.large_string()).cast(pa.string())
                found = pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], names=["word", "n"])
                long = pc.greater_equal(pc.utf8_length(words), least_length)
                yield found.filter(pc.and_(long, pc.greater(found.column(1), 0)))
                if cut := {w: n for w, n in cut.items() if len(w) >= least_length}:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cut.keys(), pa.string()), pa.array(cut.values(), pa.int64())], names=["word", "n"]
                    )

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(counted, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def word_hash(letters: np.ndarray) -> np.ndarray:
    """The sum of code points times powers of a constant, modulo 2^64."""
    return (letters * _powers(letters.shape[1] - 1)).sum(axis=1, dtype=np.uint64)


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and the bits from which its places in the block are taken."""
    h = _mixed(h)
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), _mixed(h ^ BASE)


def _bit(bits: np.ndarray, k: int) -> np.ndarray:
    return (bits >> np.uint64(9 * k)) & np.uint64(511)


class BloomShards:
    """Blocked Bloom filters of 512-bit blocks, one filter for each word length."""

    def __init__(self, filters: dict[int, np.ndarray]):
        self.filters = filters  # 8 words of 64 bits for each block

    @staticmethod
    def blocks(counts: dict[int, int]) -> dict[int, int]:
        """Blocks of each length's filter: all together stay within ``FILTER_BYTES``."""
        bits = min(BITS, 8 * FILTER_BYTES / max(1, sum(counts.values())))
        return {length: max(1, int(n * bits / 512)) for length, n in counts.items()}

    @classmethod
    def build(cls, vocabulary: DataFrame) -> BloomShards:
        """Filled in the executors; the driver gets the finished blocks, bounded by ``FILTER_BYTES`` and
        one block for each length."""
        counts = {r["length"]: r["n"] for r in vocabulary.groupBy("length").agg(F.count("*").alias("n")).collect()}
        blocks = cls.blocks(counts)
        names = [f"w{k}" for k in range(8)]

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for length, words in _by_length(batch.column(0).to_pylist()):
                    block, bits = _places(word_hash(_letters(words)), blocks[length])
                    found, at = np.unique(block, return_inverse=True)
                    rows = np.zeros((len(found), 8), np.uint64)
                    for k in range(PROBES):
                        place = _bit(bits, k)
                        np.bitwise_or.at(rows, (at, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
                    columns = [pa.array(np.full(len(found), length)), pa.array(found), *(pa.array(c) for c in rows.view(np.int64).T)]
                    yield pa.RecordBatch.from_arrays(columns, names=["length", "block", *names])

        schema = ", ".join(f"{c} bigint" for c in ("length", "block", *names))
        rows = vocabulary.select("word").mapInArrow(filled, schema).groupBy("length", "block").agg(*[F.bit_or(c).alias(c) for c in names])
        filters = {length: np.zeros((n, 8), np.uint64) for length, n in blocks.items()}
        whole = rows.toArrow()
        lengths, places = (whole[c].to_numpy() for c in ("length", "block"))
        values = np.stack([whole[c].to_numpy() for c in names], axis=1).astype(np.int64).view(np.uint64)
        for length, held in filters.items():
            mine = lengths == length
            held[places[mine]] = values[mine]
        return cls(filters)

    def probe(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that the filter of a length may hold."""
        held = self.filters.get(length)
        if held is None or not len(h):
            return np.empty(0, np.int64)
        block, bits = _places(h, len(held))
        left = np.arange(len(h))
        for k in range(PROBES):
            place = _bit(bits, k)
            hit = (held[block, (place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            left, block, bits = left[hit], block[hit], bits[hit]
        return left


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    shards: dict[int, list[str]] = {}
    for word in words:
        shards.setdefault(len(word), []).append(word)
    yield from shards.items()


def positive_edits(words: list[str], alphabet: np.ndarray, filters: BloomShards) -> Iterator[tuple[int, str]]:
    """(place of the word, edit) of all deletions and replacements by later letters that pass the filters.
    ``words`` have one length."""
    letters = _letters(words)
    length = letters.shape[1]
    powers = _powers(length)
    whole = letters * powers[:length]
    h = whole.sum(axis=1, dtype=np.uint64)
    below = np.zeros(len(words), np.uint64)  # of the letters before the place
    # What follows a deleted letter moves down by one power: all other powers move up instead.
    for at in range(length):
        rest = h - below - whole[:, at]
        moved = below * BASE + rest
        fresh = np.ones(len(words), bool) if at == 0 else letters[:, at] != letters[:, at - 1]
        rows = np.flatnonzero(fresh)
        inverse = moved[rows] * INVERSE
        for row in rows[filters.probe(length - 1, inverse)].tolist():
            yield row, words[row][:at] + words[row][at + 1 :]
        for low in range(0, len(words), max(1, EDITS // len(alphabet))):
            part = slice(low, low + max(1, EDITS // len(alphabet)))
            rows, new = np.nonzero(alphabet > letters[part, at, None])
            change = (alphabet[new] - letters[part, at][rows]) * powers[at]
            found = filters.probe(length, h[part][rows] + change)
            for row, letter in zip((rows[found] + low).tolist(), alphabet[new[found]].tolist()):
                yield row, words[row][:at] + chr(letter) + words[row][at + 1 :]
        below = below + whole[:, at]


#: Powers of the constant are odd, so they have inverses modulo 2^64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """Each pair of near words once: (word, n, near, near_n). ``vocabulary``: a stored table (word, n, length)
    without repeated words."""
    spark = vocabulary.sparkSession
    filters = spark.sparkContext.broadcast(BloomShards.build(vocabulary))
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    # Letters of one class of 90: never more rows.
    alphabet = sorted(ord(r["letter"]) for r in letters.collect() if r["letter"])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(alphabet, np.uint64)
        for batch in batches:
            counts = dict(zip(*(c.to_pylist() for c in batch.columns[:2])))
            for _, words in _by_length(list(counts)):
                found = list(positive_edits(words, known, filters.value))
                if found:
                    rows, edits = zip(*found)
                    own = [words[r] for r in rows]
                    columns = [pa.array(own), pa.array([counts[w] for w in own], pa.int64()), pa.array(edits)]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "near"])

    # Probing takes some microseconds a word, so even a small vocabulary is worth more than one task.
    spread = vocabulary.select("word", "n").repartition("word")
    edits = spread.mapInArrow(edited, "word string, n bigint, near string")
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return edits.join(known, "near").select("word", "n", "near", "near_n")


def with_forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word of a stored vocabulary."""
    pairs = near_pairs(vocabulary)
    both = F.explode(
        F.array(
            F.struct("word", "n", "near", "near_n"),
            F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
        )
    )
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    rows = pairs.select(both.alias("p")).select("p.*").unionByName(alone)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("order"), "near", "near_n")))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    is_form = F.col("best.near_n") >= ratio * F.col("n")
    return found.select(
        "word",
        "n",
        "n_near",
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, F.col("best.near_n")).alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. A form is more frequent than its word, so chains end; their
    length is bounded by the logarithm of the largest count."""
    found = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    found = stored(found, "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = found.join(onward, "root", "left")
        moved = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return found


def spelling_groups(docs: DataFrame) -> DataFrame:
    """Every word of the vocabulary with its form and the root that its forms lead to."""
    counts = word_counts(docs).filter(F.col("n") >= LEAST_COUNT)
    vocabulary = stored(counts.withColumn("length", F.length("word").cast("bigint")), "vocabulary")
    forms = stored(with_forms(vocabulary), "forms")
    rooted = forms.join(roots(forms), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
