"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level ``k`` holds the ``k``-th chunks of all ids that
have one, a continuation bitmap tells which of them go on, and a rank directory holds the number of ones
before every 512th bit. So the chunk of an id on the next level is found by one directory entry and a
popcount of at most 64 bytes, and any token is read without decoding those around it.

A segment holds whole documents in ascending order, and is closed when it has ``SEGMENT`` tokens: its
size is bounded by that and by the longest document. It is one row of a Parquet folder, so that any store
Spark writes to can hold the files::

    part, number   place of the segment: range partition, and running number in it
    first          ids of the part before it
    doc_ids, starts, sizes
                   directory: the documents of the segment, where each begins, and its number of ids
    codes          the ids of all of them, one after the other

``codes`` is little-endian: ``DAC1``, uint32 levels, uint64 number of ids of each level; then for each
level its chunks, and for all but the last its bitmap (uint64 words, lowest bit first) and its rank
directory (uint64), each starting at a multiple of 8 bytes.

Texts are tokenized by the tokenizers library. Its pre-tokenizer never joins what stands before a run
of white space with the run, so texts are cut there, and each distinct piece of a batch is tokenized once.
Strings of special tokens in a text are ordinary text.

Defined cases: a null or empty text is the end id alone; null ids come last; repeated ids and rows are
documents of their own, ordered by text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.llm.arrow import byte_slices, give_back
from lexdrift.llm.pieces import Encode, PieceIds, joined, whole_tokenizer

END = 2
SEGMENT = 1 << 18
#: Places of a segment that are looked up together.
STRETCH = 1 << 16
MAGIC = b"DAC1"
BLOCK_BITS = 512
#: Text that is tokenized at a time.
TEXT_BYTES = 8 << 20

SEGMENTS = "part bigint, number bigint, first bigint, doc_ids array<bigint>, starts array<bigint>, sizes array<bigint>, codes binary"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def encode_ids(ids: np.ndarray) -> bytes:
    """The codes of a sequence of ids below 2^32."""
    rest, counts, parts = np.ascontiguousarray(ids, np.uint32), [], []
    while True:
        counts.append(len(rest))
        parts.append(_padded(rest.astype(np.uint8).tobytes()))
        goes_on = rest > 255
        if not goes_on.any():
            break
        bitmap = _padded(np.packbits(goes_on, bitorder="little").tobytes())
        ones = np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK_BITS), dtype=np.uint64)
        parts += [bitmap, (np.cumsum(ones) - ones).astype("<u8").tobytes()]
        rest = rest[goes_on] >> np.uint32(8)
    head = MAGIC + np.uint32(len(counts)).astype("<u4").tobytes() + np.array(counts, "<u8").tobytes()
    return head + b"".join(parts)


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


class Codes:
    """A view of encoded ids; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no directly addressable codes")
        levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        counts = np.frombuffer(data, "<u8", levels, 8).astype(int).tolist()
        at = 8 + 8 * levels
        self.chunks, self.bits, self.ranks = [], [], []
        for level, n in enumerate(counts):
            self.chunks.append(np.frombuffer(data, np.uint8, n, at))
            at += n + -n % 8
            if level < levels - 1:
                words, blocks = -(-n // 64), -(-n // BLOCK_BITS)
                self.bits.append(np.frombuffer(data, np.uint8, 8 * words, at))
                at += 8 * words
                self.ranks.append(np.frombuffer(data, "<u8", blocks, at))
                at += 8 * blocks

    def __len__(self) -> int:
        return len(self.chunks[0])

    def __getitem__(self, at: int) -> int:
        """One id."""
        value = 0
        for level, chunks in enumerate(self.chunks):
            value |= int(chunks[at]) << 8 * level
            if level == len(self.bits) or not self.bits[level][at >> 3] >> (at & 7) & 1:
                break
            at = self.rank(level, at)
        return value

    def rank(self, level: int, at: int) -> int:
        """Ones of a level's bitmap before a place."""
        block = at // BLOCK_BITS
        whole = self.bits[level][block * BLOCK_BITS // 8 : at >> 3]
        last = int(self.bits[level][at >> 3]) & ((1 << (at & 7)) - 1)
        return int(self.ranks[level][block]) + int(np.bitwise_count(whole).sum()) + last.bit_count()

    def decode(self) -> np.ndarray:
        """All ids."""
        out = self.chunks[0].astype(np.uint32)
        places = np.arange(len(out))
        for level, bits in enumerate(self.bits):
            goes_on = np.unpackbits(bits, count=len(places), bitorder="little").astype(bool)
            places = places[goes_on]
            out[places] |= self.chunks[level + 1].astype(np.uint32) << np.uint32(8 * (level + 1))
        return out


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes of blanks at which a run of white space begins. A place after a character
    that may be white space outside ASCII is left out; pieces are longer there."""
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces > 2]
    last, second, third = data[spaces - 1], data[spaces - 2], data[spaces - 3]
    plain = (last > 32) & (last < 128)
    wide = (last >= 128) & (second != 0xC2) & ((third < 0xE1) | (third > 0xE3) | (second > 0x81) & (second != 0x9A))
    return spaces[plain | wide]


class PieceTokenizer:
    """Ids of texts by the tokenizers library, piece by piece."""

    def __init__(self, path: str):
        tokenizer = whole_tokenizer(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        kind = type(tokenizer.pre_tokenizer).__name__
        if tokenizer.normalizer is not None or kind != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError(f"{path}: only byte-level tokenizers without normalizer or prefix can be cut into pieces")
        self.pieces = PieceIds.of_process(path, lambda: PieceIds(Encode(tokenizer)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with an end id after each, and how many each text has."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2] or pa.py_buffer(b"")
        held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        cut = np.zeros(len(held) + 1, bool)
        cut[cut_places(held)] = True
        cut[bounds - bounds[0]] = True
        cuts = np.flatnonzero(cut) + bounds[0]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), data])
        ids, upto = joined(*self.pieces(pieces))
        ends = np.concatenate([[0], upto])[np.searchsorted(cuts, bounds[1:])]
        return np.insert(ids, ends, END), np.diff(ends, prepend=0) + 1


def write(docs: DataFrame, tokenizer: str, folder: str) -> None:
    """Write the ids of all documents to ``folder``, in ascending order of ``doc_id``."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = PieceTokenizer(tokenizer), TaskContext.get().partitionId()
        number = first = held = 0
        ids, doc_ids, starts, sizes = [], [], [], []

        def row() -> pa.RecordBatch:
            values = [part, number, first, doc_ids, starts, sizes, encode_ids(np.concatenate(ids))]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            names = [c.split()[0] for c in SEGMENTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for some in byte_slices(batch, 1, TEXT_BYTES):
                taken, counts = encode(some.column(1))
                done = 0
                for doc_id, n in zip(some.column(0).to_pylist(), counts.tolist()):
                    ids.append(taken[done : done + n])
                    doc_ids.append(doc_id)
                    starts.append(held)
                    sizes.append(n)
                    done, held = done + n, held + n
                    if held >= SEGMENT:
                        yield row()
                        number, first, held = number + 1, first + held, 0
                        ids, doc_ids, starts, sizes = [], [], [], []
        if ids:
            yield row()
        give_back()

    order = [F.col("doc_id").asc_nulls_last(), F.col("by_text"), F.col("by_place")]
    placed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text"),
        F.xxhash64("text").alias("by_text"),
        F.monotonically_increasing_id().alias("by_place"),  # a repeated row must not be one key
    )
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(segments, SEGMENTS).write.parquet(folder)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with ``base``, the ids of all parts before theirs. The codes are read only if asked for."""
    found = spark.read.schema(SEGMENTS).parquet(folder)
    sizes = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n)
    # One row for each range partition: a few bytes for every shuffle task.
    of_parts = found.groupBy("part").agg(F.sum(sizes).alias("tokens")).orderBy("part").collect()
    upto = np.cumsum([0, *(r["tokens"] for r in of_parts)]).tolist()
    bases = spark.createDataFrame([(r["part"], b) for r, b in zip(of_parts, upto)], "part bigint, base bigint")
    return found.join(F.broadcast(bases), "part")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document: the ids before it, how many it has, and their checksum."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                base, doc_ids, starts, sizes, data = (c[n].as_py() for c in batch.columns)
                raw = memoryview(Codes(data).decode().astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts, sizes)]
                columns = [doc_ids, [base + s for s in starts], sizes, sums]
                names = [c.split()[0] for c in DOCUMENTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    found = segments(spark, folder).select((F.col("base") + F.col("first")).alias("base"), "doc_ids", "starts", "sizes", "codes")
    return found.mapInArrow(documents, DOCUMENTS)


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The ids at ``wanted`` (doc_id, at), each read by its address: rows (doc_id, at, id). Places outside
    their document, null places and ids, and unknown documents give no row; of documents that share an id
    each answers. Repeated places are answered once."""
    found = spark.read.schema(SEGMENTS).parquet(folder)
    rows = F.explode(F.arrays_zip("doc_ids", "starts", "sizes")).alias("d")
    directory = found.select("part", "number", rows).select("part", "number", "d.*").withColumnRenamed("doc_ids", "doc_id")
    asked = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("at").cast("bigint").alias("at")).distinct()
    placed = asked.join(directory, "doc_id").filter("at >= 0 and at < sizes")
    # A group has one row for each place of a stretch of the segment at most.
    stretch = F.floor((F.col("starts") + F.col("at")) / STRETCH)
    asked = placed.groupBy("part", "number", stretch.alias("stretch")).agg(
        F.collect_list("doc_id").alias("doc_ids"),
        F.collect_list("at").alias("ats"),
        F.collect_list(F.col("starts") + F.col("at")).alias("places"),
    )

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                doc_ids, ats, places, data = (c[n].as_py() for c in batch.columns)
                codes = Codes(data)
                columns = [doc_ids, ats, [codes[place] for place in places]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "at", "id"])

    codes = found.select("part", "number", "codes")
    joined = asked.join(codes, ["part", "number"]).select("doc_ids", "ats", "places", "codes")
    return joined.mapInArrow(answers, "doc_id bigint, at bigint, id bigint")
