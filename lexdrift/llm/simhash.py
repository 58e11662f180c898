"""Near-duplicate classes by SimHash: fingerprints, pigeonhole blocks, Hamming check.

A fingerprint's 64 bits are cut into four parts, and what a part leaves into four again: of
two fingerprints that differ in three bits or fewer, some part agrees each time. So close
pairs share one of 16 blocks of 28 bits and meet by a join on blocks. A block that more than
``BLOCK`` different fingerprints share is cut further in the same way; at the last cut at
most 2^20 fingerprints can share a block, and these meet chunk by chunk. No group is ever
larger than two chunks, no pair is lost and none is emitted: each group returns a
spanning forest of its links, which keeps every class.

Texts of a given similarity are found by several fingerprints over their word sets, linked in the same way, and
verified on their shingles, and the links that no fingerprint shows by the first of their shingles in an order of
all (`representatives`).

Joins of exploded or unpacked rows are told to merge: the planner goes by the bytes of the files that they are read
from, and what few of them hold can be larger than the driver, which would collect it for a broadcast.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like
any other; repeated rows and copies share a fingerprint; documents with null ids are classed
and a class of them alone has a null id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexdrift.llm.arrow import per_batch, texts_of
from lexdrift.llm.components import components
from lexdrift.plans.workspace import stored

SEED = 42
#: Fingerprints over word sets by which similar texts are found.
SETS = 5
MIXERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)
#: Most differing bits of a link; four parts of the bits find it.
DISTANCE = 3
PARTS = DISTANCE + 1
#: Different fingerprints of one block that one task compares at once.
BLOCK = 512
CUTS = 4
#: First shingles that similar sets must share, if they are large enough for so many.
SHARED = 3
#: Sets with a shingle beyond which these meet its central ones first, and how many of these there are.
CROWD = 64
CENTRES = 4
#: Shingles at most that are told to be seen often.
OFTEN = 100_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash over the word shingles of ``text``, ASCII letters in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    line, count = b" ".join(words), max(1, len(words) - width + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:count].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    hashed, seed = xxhash.xxh64_intdigest, SEED
    values = np.array([hashed(line[a:b], seed) for a, b in zip(starts, ends)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, count, 8192):
        bits = np.unpackbits(values[k : k + 8192].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row and fp, the fingerprint's bits as a long."""
    columns = [c for c in keep if c != "fp"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width) for t in texts_of(batch.column(len(columns)))], np.uint64)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(columns)], pa.array(fps.view(np.int64))], names=[*columns, "fp"]
        )

    kept = docs.select(*columns)
    schema = T.StructType([*kept.schema.fields, T.StructField("fp", T.LongType())])
    return per_batch(docs.select(*columns, F.col("text").alias("text to hash")), run, schema)


def _cut(mask: int) -> list[int]:
    """``mask`` with each of the parts of the bits that it leaves."""
    left = [b for b in range(64) if not mask >> b & 1]
    bounds = [round(k * len(left) / PARTS) for k in range(PARTS + 1)]
    return [mask | sum(1 << b for b in left[x:y]) for x, y in zip(bounds, bounds[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _masks() -> list[list[int]]:
    """Per cut the masks of all blocks; those of a mask follow each other in the next cut."""
    levels = [_cut(0)]
    while len(levels) < CUTS:
        levels.append([m for mask in levels[-1] for m in _cut(mask)])
    return levels


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within ``values`` (different fingerprints)."""
    edges, left = [], values
    while len(left) > 1:
        members, at = [left[0]], 0
        left = left[1:]
        while at < len(members) and len(left):
            near = np.bitwise_count(left ^ members[at]) <= DISTANCE
            if near.any():
                members.extend(left[near])
                left = left[~near]
            at += 1
        # Laid out as a binary heap, so that no node becomes a hub.
        edges += [(int(members[k]), int(members[(k - 1) // 2])) for k in range(1, len(members))]
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the runs of equal (block, key) in sorted rows; a run may span batches."""
    rest = None
    for last, batch in _with_last(batches):
        rows = np.stack([c.to_numpy() for c in batch.columns]) if batch is not None else np.zeros((3, 0), np.int64)
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        new = np.flatnonzero((np.diff(rows[:2], axis=1) != 0).any(axis=0)) + 1
        bounds = np.concatenate([[0], new, [rows.shape[1]] if last else []]).astype(np.int64)
        rest = rows[:, bounds[-1] :]
        fps = rows[2].view(np.uint64)
        sizes = np.diff(bounds)
        pairs = bounds[:-1][sizes == 2]
        close = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= DISTANCE
        found = [(fps[pairs[close]], fps[pairs[close] + 1])]
        for k in np.flatnonzero(sizes > 2):
            edges = _forest(np.unique(fps[bounds[k] : bounds[k + 1]]))
            if edges:
                found.append(tuple(np.array(edges, np.uint64).T))
        a, b = (np.concatenate(side).view(np.int64) for side in zip(*found))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _with_last(batches: Iterator) -> Iterator:
    for batch in batches:
        if batch.num_rows:
            yield False, batch
    yield True, None


def _linked(rows: DataFrame, place: Column) -> DataFrame:
    """Links within groups of equal (place, key)."""
    groups = rows.select(place.cast("bigint").alias("place"), "key", "fp").repartition("place", "key")
    return groups.sortWithinPartitions("place", "key").mapInArrow(_forests, "a bigint, b bigint")


def links(fps: DataFrame) -> DataFrame:
    """Forests of all links between the different fingerprints ``fps`` (fp)."""
    levels, found = _masks(), []
    masks = F.array(*[F.lit(_signed(m)) for m in levels[1]])
    rows = fps.select("fp", F.posexplode(masks).alias("block", "mask"))
    for level in range(1, CUTS):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
        rows = stored(rows.join(sizes.hint("merge"), ["block", "key"]), "blocks")
        found.append(_linked(rows.where(F.col("n") <= BLOCK), F.col("block")))
        rows = rows.where(F.col("n") > BLOCK)
        if rows.isEmpty():
            break
        if level + 1 < CUTS:
            next_masks = [[F.lit(_signed(m)) for m in _cut(mask)] for mask in levels[level]]
            cut = F.element_at(F.array(*[F.array(*ms) for ms in next_masks]), F.col("block") + 1)
            rows = rows.select("fp", "block", F.posexplode(cut).alias("part", "mask")).select(
                "fp", (F.col("block") * PARTS + F.col("part")).alias("block"), "mask"
            )
        else:
            found.append(_chunked(rows))
    return reduce(DataFrame.unionByName, found)


def _chunked(rows: DataFrame) -> DataFrame:
    """Links within blocks too large for one task: chunks meet pair by pair."""
    chunks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("fp"), chunks)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    pair = F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other"))
    # Pairs of chunks whose hashes agree only make a group larger.
    return _linked(rows, pair)


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component, component_id) of every row: its class as the class's smallest
    fingerprint and as its smallest doc_id."""
    prints = stored(fingerprints(docs, width), "fingerprints")
    return prints.join(_classes(prints), "fp")


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, component, component_id) of all fingerprints of a stored table (doc_id, fp, ...)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fp")))
    classed = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "first"
    )
    smallest = classed.groupBy("component").agg(F.min("first").alias("component_id"))
    return classed.join(smallest, "component").select("fp", "component", "component_id")


def word_set_fingerprints(text: bytes, n: int = SETS) -> list[int]:
    """Independent SimHashes over the different words of a text, ASCII letters in lower case; zeros without words.

    A changed word changes one of its features, where it changes five of the shingles of five words: texts that
    share most shingles differ in fewer bits here, and long texts do not become alike by their frequent words."""
    words = set(text.lower().split())
    if not words:
        return [0] * n
    hashed = np.array(sorted(map(xxhash.xxh64_intdigest, words)), np.uint64)
    out = []
    for k in range(n):
        mixed = (hashed ^ np.uint64(k)) * MIXERS[0]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIXERS[1]
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones = bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(mixed), bitorder="little").view("<u8")[0]))
    return out


def _set_fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, hash, f0, f1, ...) of rows (doc_id, hash, text)."""
    names = [f"f{k}" for k in range(n)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([word_set_fingerprints(t, n) for t in texts_of(batch.column(2))], np.uint64).view(np.int64)
        columns = [batch.column(0), batch.column(1), *(pa.array(c) for c in found.T)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", *names])

    schema = ", ".join(f"{c} bigint" for c in ("doc_id", "hash", *names))
    return per_batch(docs.select(F.col("doc_id").cast("bigint"), "hash", "text"), run, schema)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the different word shingles; fewer words are one shingle, none have none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    lines = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    return np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines)).view(np.int64)


def _shingled(texts: DataFrame, width: int) -> DataFrame:
    """(hash, shingles) of rows (hash, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, width) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["hash", "shingles"])

    return per_batch(texts.select("hash", "text"), run, "hash bigint, shingles array<bigint>")


def similar_texts(prints: DataFrame, texts: DataFrame, n: int, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between hashes of different texts that share ``similarity`` of their shingles; what they reach is
    what all such pairs reach.

    Candidates come from the pigeonhole blocks of each of ``n`` fingerprints: a text and the one that stands for its
    fingerprint, and those that stand for two linked ones. All are verified on the texts' shingles. Pairs that this
    leaves in different classes meet by their shingles (`_left_over`), so that none is lost."""
    nodes = prints.drop("doc_id").dropDuplicates(["hash"])
    pairs = []
    for k in range(n):
        fp = F.col(f"f{k}")
        first = stored(nodes.groupBy(fp.alias("fp")).agg(F.min("hash").alias("first")), "first")
        star = nodes.join(first.hint("merge"), fp == first["fp"]).select(F.col("hash").alias("a"), F.col("first").alias("b"))
        linked = links(first.select("fp"))
        for c in ("a", "b"):
            linked = linked.join(first.select(F.col("fp").alias(c), F.col("first").alias(f"first {c}")).hint("merge"), c)
        both = star.unionByName(linked.select(F.col("first a").alias("a"), F.col("first b").alias("b"))).where("a <> b")
        # Written one by one: a plan of all together is large for the driver.
        pairs.append(stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs"))
    found = stored(reduce(DataFrame.unionByName, pairs).distinct(), "candidates")
    seen = stored(_verified(found, texts, width, similarity), "seen")
    return seen.unionByName(_left_over(seen, texts, width, similarity))


def _verified(found: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of a stored table whose texts share ``similarity`` of their shingles."""
    ends = found.select(F.col("a").alias("hash")).unionByName(found.select(F.col("b").alias("hash"))).distinct()
    sets = stored(_shingled(texts.join(ends, "hash", "left_semi").dropDuplicates(["hash"]), width), "shingles")
    of_a, of_b = (sets.select(F.col("hash").alias(c), F.col("shingles").alias(f"of {c}")) for c in ("a", "b"))
    met = found.join(of_a.hint("merge"), "a").join(of_b.hint("merge"), "b")
    shared = F.size(F.array_intersect("of a", "of b"))
    total = F.size("of a") + F.size("of b") - shared
    return met.where((total == 0) | (shared >= similarity * total)).select("a", "b")


def _left_over(seen: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links between the classes of ``seen``.

    In any order of all shingles, two sets that share ``similarity`` of their shingles have some in common among the
    first of each. The order is that of the hashes, often seen shingles last, so that few sets meet without being
    alike. Equal sets are linked to one of them, which meets the others. Where many share a shingle, they first meet
    few central ones: most copies of a text are then of one class, and what is of one class is not paired any more."""
    often = _often_seen(texts, width)
    firsts = _firsts(texts.dropDuplicates(["hash"]), width, similarity, often)
    firsts = stored(firsts, "first shingles")
    same = firsts.where("place = 0").groupBy("whole").agg(F.min("hash").alias("first"), F.count("*").alias("n"))
    same = stored(same.where("n > 1"), "same")
    star = firsts.where("place = 0").join(same, "whole").where("hash <> first").select(
        F.col("hash").alias("a"), F.col("first").alias("b")
    )
    rows = firsts.join(same.select("whole", "first"), "whole", "left").where("first is null or first = hash").drop("first")
    rows = stored(_may_meet(rows, similarity), "meeting")
    seen = seen.unionByName(star)
    central = stored(_central(_with_class(rows.where(F.col("n") > CROWD), seen), similarity), "central")
    central = stored(_verified(central, texts, width, similarity), "links to central")
    found = stored(_met(_with_class(rows, seen.unionByName(central)), similarity), "left over")
    return star.unionByName(central).unionByName(_verified(found, texts, width, similarity))


def _may_meet(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, hash, size, place, n) of the rows in which a set can meet a similar one: see `_meeting`. The smallest set
    with the key is the one that could be met at the last place; ``n`` counts the key's rows before."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("least")).where("n > 1")
    other = F.greatest("least", similarity * F.col("size"))
    needed = F.ceil(similarity / (1 + similarity) * (F.col("size") + other) - 1e-6)
    rows = rows.join(sizes.hint("merge"), "key").where(F.col("place") < F.col("size") - needed + SHARED)
    return rows.select("key", "hash", "size", "place", "n")


def _with_class(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (hash, ...) with the component that ``links`` give, their own hash without one."""
    classes = components(links).select(F.col("node").alias("hash"), "component")
    return rows.join(classes.hint("merge"), "hash", "left").withColumn("component", F.coalesce("component", "hash"))


def _central(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes: a set, and those of its keys' sets that have the fewest other keys before, one
    in each part of a key's sets. Few pairs for each row, however many sets have the key."""
    rows = stored(rows, "classed")
    part = F.pmod(F.xxhash64("hash"), F.lit(CENTRES)).alias("part")
    best = rows.groupBy("key", part).agg(F.min(F.struct("place", "hash", "component", "size")).alias("best"))
    best = best.groupBy("key").agg(F.collect_list("best").alias("best"))

    def near(c: Column) -> Column:
        place, size = F.col("place"), F.col("size")
        most = F.least(place, c["place"]) + F.least(size - place, c["size"] - c["place"])
        return (c["component"] != F.col("component")) & (most * (1 + similarity) >= similarity * (size + c["size"]) - 1e-6)

    met = rows.join(best.hint("merge"), "key").select("hash", F.explode(F.filter("best", near)["hash"]).alias("other"))
    return met.select(F.least("hash", "other").alias("a"), F.greatest("hash", "other").alias("b")).distinct()


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes that share enough of their first shingles.

    Sets with the same key meet chunk by chunk; those of the key's largest class only meet the others."""
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
    sizes = sizes.agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main")).where("n > main.n")
    rows = rows.drop("n").join(sizes.hint("merge"), "key")
    main, few = F.col("component") == F.col("main.component"), F.col("n") <= BLOCK
    mains, others = F.ceil(F.col("main.n") / BLOCK), F.ceil((F.col("n") - F.col("main.n")) / BLOCK)
    turn, zero = F.xxhash64("hash"), F.lit(0).cast("bigint")
    own = F.when(few, zero).when(main, others + F.pmod(turn, mains)).otherwise(F.pmod(turn, others))
    last = F.when(few, zero).when(main, others - 1).otherwise(others + mains - 1)
    parted = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(zero, last)))
    meeting = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("bigint")
    names = ["meeting", "key", "hash", "component", "size", "place", "side"]
    groups = parted.withColumn("meeting", meeting).withColumn("side", side).select(*names).repartition("meeting", "key")
    pairs = groups.sortWithinPartitions("meeting", "key").mapInArrow(_meeting(similarity), "a bigint, b bigint, wanted bigint")
    found = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("wanted").alias("wanted"))
    return found.where("n >= wanted").select("a", "b")


def _often_seen(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that many texts of a part of all share. They only order shingles: no link depends on them."""
    some = _shingled(texts.where(F.pmod("hash", F.lit(16)) == 0), width).select(F.explode("shingles").alias("key"))
    often = some.groupBy("key").agg(F.count("*").alias("n")).where("n > 4").orderBy(F.desc("n"), "key").limit(OFTEN)
    return np.sort(np.array([r["key"] for r in often.select("key").collect()], np.int64))


def _firsts(texts: DataFrame, width: int, similarity: float, often: np.ndarray) -> DataFrame:
    """(key, hash, size, place, whole) of the first shingles of each text: those of which one is shared by any
    text as similar. ``whole`` stands for the set; texts without words have one row with the size 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for node, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            keys = np.sort(shingles(text, width))
            size = len(keys)
            whole = xxhash.xxh64_intdigest(keys.tobytes(), SEED) - (1 << 63)
            if len(often) and size:
                last = often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys
                keys = np.concatenate([keys[~last], keys[last]])
            keys = keys[: size - math.ceil(similarity * size - 1e-9) + 1] if size else np.zeros(1, np.int64)
            part = np.empty((5, len(keys)), np.int64)
            part[0], part[1], part[2], part[3], part[4] = keys, node, size, np.arange(len(keys)), whole
            parts.append(part)
        columns = np.concatenate(parts, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "hash", "size", "place", "whole"])

    schema = ", ".join(f"{c} bigint" for c in ("key", "hash", "size", "place", "whole"))
    return per_batch(texts.select("hash", "text"), run, schema)


def _meeting(similarity: float):
    """Pairs of different classes within the runs of equal (meeting, key) in sorted rows that may be similar
    by their sizes and by the places of the key, and how many keys they must share; a run may span batches.

    Of the shingles that two similar sets share, ``needed`` at least, the first k have ``needed - k`` more behind them
    in both sets: only places that leave so many count, and k such places there must be."""

    def pairs_of(rows: np.ndarray) -> Iterator[np.ndarray]:
        node, component, size, place, side = rows[2:]
        for k in range(len(node) - 1):
            other = slice(k + 1, None)
            near = (component[k] != component[other]) & ((side[k] == 0) | (side[k] != side[other]))
            if not near.any():
                continue
            sizes, places = size[other], place[other]
            needed = np.ceil(similarity / (1 + similarity) * (size[k] + sizes) - 1e-6)
            wanted = np.minimum(needed - np.ceil(similarity * np.maximum(size[k], sizes) - 1e-6) + 1, SHARED)
            most = np.minimum(place[k], places) + np.minimum(size[k] - place[k], sizes - places)
            near &= (most >= needed) & (np.maximum(place[k] - size[k], places - sizes) < wanted - needed)
            found = node[other][near]
            if len(found):
                yield np.stack([np.minimum(found, node[k]), np.maximum(found, node[k]), wanted[near].astype(np.int64)])

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], names=["a", "b", "wanted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found, held = np.zeros((7, 0), np.int64), [], 0
        for last, batch in _with_last(batches):
            rows = rest if batch is None else np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            new = np.flatnonzero((np.diff(rows[:2], axis=1) != 0).any(axis=0)) + 1
            bounds = np.concatenate([[0], new, [rows.shape[1]] if last else []]).astype(np.int64)
            rest = rows[:, bounds[-1] :]
            for k in np.flatnonzero(np.diff(bounds) > 1):
                for some in pairs_of(rows[:, bounds[k] : bounds[k + 1]]):
                    found.append(some)
                    held += some.shape[1]
                    if held >= 1 << 16:
                        yield out(found)
                        found, held = [], 0
        if found:
            yield out(found)

    return run


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8, n: int = SETS) -> DataFrame:
    """One row of each class of near duplicates: texts that share ``similarity`` of their shingles of ``width``
    words are linked, classes are what links reach. The row with the smallest id stays, null last, and of
    several rows with that id the one whose text has the smallest hash; rows that agree in id and text are one.

    Texts are told apart by 64-bit hashes."""
    # Other columns may be named like the operator's own: they travel as one.
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text", F.struct("*").alias("row"))
    prints = stored(_set_fingerprints(docs, n), "fingerprints")
    linked = stored(similar_texts(prints, docs.select("hash", "text"), n, width, similarity), "similar")
    found = components(linked).withColumnRenamed("node", "hash")
    classed = prints.join(found.hint("merge"), "hash", "left").withColumn("component", F.coalesce("component", "hash"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"))
    chosen = classed.groupBy("component").agg(F.min(order).alias("first")).select("first.*")
    keys = chosen.select(F.col("doc_id").alias("its id"), F.col("hash").alias("its hash"))
    same = (F.col("hash") == F.col("its hash")) & F.col("doc_id").eqNullSafe(F.col("its id"))
    return docs.join(keys, same, "left_semi").dropDuplicates(["doc_id", "hash"]).select("row.*")
